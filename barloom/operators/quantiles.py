"""Exact quantiles of a whole column without bringing it to one task.

Approximate quantiles bound the value of each wanted rank, exact counts tell
how many rows lie below and between the bounds, and the range between them is
searched again until it is small.  Only that range is put in order, folded by
value, so ties of any number are one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_path

#: Rows of a range that is put in order at once, and the accuracy of the approximate quantiles.
LEAF, ACCURACY = 100_000, 10_000


@dataclass
class Range:
    """Of one wanted rank: bounds of its value, the rows below them and those between them."""

    low: float
    high: float
    below: int
    size: int
    margin: float = 2.0


def ranked(values: DataFrame, ranks: Sequence[int], n: int, leaf: int = LEAF) -> dict[int, float]:
    """The values at places ``ranks`` (from 0) of the one column ``v`` of ``n`` rows in ascending order."""
    v, found = F.col("v"), {r: Range(-math.inf, math.inf, 0, n) for r in ranks}
    open_ = [r for r in ranks if n > leaf]
    while open_:
        within = [F.when(v.between(found[r].low, found[r].high), v) for r in open_]
        shares = []
        for r in open_:
            of, place = found[r], r - found[r].below
            shares.append([min(1.0, max(0.0, place / of.size + of.margin * s / ACCURACY)) for s in (-1, 1)])
        got = values.agg(*[F.percentile_approx(w, s, ACCURACY).alias(f"b{i}") for i, (w, s) in enumerate(zip(within, shares, strict=True))]).first()
        counts = [x for b in got for x in (F.count_if(v < b[0]), F.count_if(v.between(b[0], b[1])))]
        told = values.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
        still = []
        for i, r in enumerate(open_):
            below, size, of = told[2 * i], told[2 * i + 1], found[r]
            if not below <= r < below + size:
                of.margin *= 8  # the approximation was further off
                still.append(r)
                continue
            shrunk = size < of.size
            found[r] = Range(got[i][0], got[i][1], below, size)
            if size > leaf and shrunk and got[i][0] < got[i][1]:
                still.append(r)
        open_ = still
    out = {r: x.low for r, x in found.items() if x.low == x.high}
    rest = [r for r in found if r not in out]
    if rest:
        of = F.explode(F.array_compact(F.array(*[F.when(v.between(found[r].low, found[r].high), F.lit(i)) for i, r in enumerate(rest)])))
        folded = values.select("v", of.alias("i")).groupBy("i", "v").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
        wanted = F.array(*[F.lit(r - found[r].below) for r in rest])[F.col("i")]
        met = folded.withColumn("upto", upto).where(F.col("upto") > wanted).groupBy("i").agg(F.min("v").alias("v")).collect()  # a row per rank
        out |= {rest[row.i]: row.v for row in met}
    return out


def quantiles(df: DataFrame, value: str, shares: Sequence[float], leaf: int = LEAF) -> list[float | None]:
    """Exact quantiles of a column over all rows, between two rows in proportion; null without any value.

    The column is stored once, as each round reads it twice.
    """
    spark = df.sparkSession
    at = shared_path(spark, "values")
    df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL").write.parquet(at)
    values = spark.read.schema("v double").parquet(at)
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    found = ranked(values, sorted({r for p in places for r in (math.floor(p), math.ceil(p))}), n, leaf)
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]
