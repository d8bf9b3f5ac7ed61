"""Moving averages with a constant weight in two levels of expressions: blocks of rows, then what one block hands to the next.

A row maps the average before it to ``a * x + (1 - a) * average``.  Maps of a
block compose to one map of the same form, so rows of a block need the average
at its start only, and the starts follow from the blocks' maps in one fold over
a code's blocks.  Everything stays in expressions; a block's rows are few
enough that powers of the weight keep their precision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at most; fewer for heavy weights, whose powers fall fast.
BLOCK, SMALLEST = 64, 1e-30


def block_rows(weight: float) -> int:
    """How many rows a block may have so that the weight's last power stays above ``SMALLEST``."""
    keep, rows = 1.0 - weight, 1
    while rows < BLOCK and keep ** (rows + 1) >= SMALLEST:
        rows += 1
    return rows


def smoothed(df: DataFrame, x: str, weight: float, out: str, by: str = "code", order: str = "dt") -> DataFrame:
    """Adds the average of ``x`` that starts with its first value; rows without a value keep the average before them."""
    keep, rows = 1.0 - weight, block_rows(weight)
    series = Window.partitionBy(by).orderBy(order)
    v = F.col(x).cast("double")
    numbered = df.withColumns({"_seen": F.count(v).over(series)})  # values so far, this one too
    numbered = numbered.withColumn("_block", F.greatest(F.floor((F.col("_seen") - 1) / rows), F.lit(0)))
    place = F.col("_seen") - 1 - F.col("_block") * rows
    scaled = F.when(F.col("_seen") == 1, v).otherwise(weight * v) / F.pow(F.lit(keep), place) if keep else v
    within = Window.partitionBy(by, "_block").orderBy(order)
    if not keep:  # the whole weight is on the last value
        return df.withColumn(out, F.last(v, True).over(series))
    local = F.coalesce(F.sum(scaled).over(within), F.lit(0.0)) * F.pow(F.lit(keep), place)
    made = numbered.withColumns({"_local": local, "_power": F.pow(F.lit(keep), place + 1)})

    ends = made.where(v.isNotNull()).groupBy(by, "_block").agg(F.max_by(F.struct(F.col("_local").alias("b"), F.col("_power").alias("a")), "_seen").alias("map"))
    lists = ends.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_block", "map"))).alias("blocks"))
    kind = "array<struct<_block:bigint,start:double>>"

    def fold(done, block):
        last = F.try_element_at(done, F.lit(-1))
        start = F.coalesce(last["start"], F.lit(0.0))  # of this block: what the one before has handed on
        return F.concat(done, F.array(F.struct((block["_block"] + 1).alias("_block"), (block["map"]["b"] + block["map"]["a"] * start).alias("start"))).cast(kind))

    starts = lists.select(by, F.explode(F.aggregate("blocks", F.array().cast(kind), fold)).alias("s")).select(by, "s.*")
    joined = made.join(starts, [by, "_block"], "left")
    value = F.when(F.col("_seen") > 0, F.col("_local") + F.col("_power") * F.coalesce("start", F.lit(0.0)))
    return joined.withColumn(out, value).select(*df.columns, out)


def ema(df: DataFrame, x: str, n: float, out: str, by: str = "code", order: str = "dt") -> DataFrame:
    """The exponential moving average of span ``n``."""
    return smoothed(df, x, 2.0 / (n + 1), out, by, order)
