"""The flagship plan: bars to adjusted closes, moving averages, crosses, and the strongest codes of the last day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.adjust import adjust
from ..operators.factors import lookback
from ..operators.indicators import S
from .views import bars, factors


def strongest(spark: SparkSession, sf: str, n: int = 5) -> DataFrame:
    """Each code's latest bar with its averages, last cross and 20-bar return; the n highest returns."""
    df = adjust(bars(spark, sf), factors(spark, sf), ["close"]).where("close_front IS NOT NULL")
    df = df.withColumns({"fast": S.ma("close_front", 5), "slow": S.ma("close_front", 20), "r": lookback("close_front", 20)})
    df = df.withColumn("golden", S.cross(F.col("fast") > F.col("slow")))
    newest = df.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("dt")))).where("n = 1")
    top = newest.orderBy(F.desc_nulls_last("r"), "code").limit(n)
    return top.select("code", F.col("dt").cast("string").alias("dt"), *[F.round(c, 6).alias(c) for c in ("close_front", "fast", "slow", "r")], "golden")
