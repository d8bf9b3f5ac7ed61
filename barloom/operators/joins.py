"""Joins in time: as-of, interval and range joins, precedence and alignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str | Sequence[str], left_time: str, right_time: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """Every left row with the values of the latest right row at or before its time, null where there is none.

    Both sides go into one window over their union: one shuffle on the key,
    and no row is multiplied.  Of right rows with the same time the one with
    the largest values counts.
    """
    keys = [by] if isinstance(by, str) else list(by)
    own = [c for c in left.columns if c not in keys]
    left_side = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_left") if own else F.lit(None).alias("_left"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_right"))
    right_side = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left_side.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    joined = left_side.unionByName(right_side).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return joined.select(*keys, *[F.col(f"_left.{c}").alias(c) for c in own], *[F.col(f"_found.{v}").alias(prefix + v) for v in values])


def range_minimum(left: DataFrame, right: DataFrame, by: str, time: str, value: str, back: int, out: str) -> DataFrame:
    """Every left row with the minimum of right values in [time - back, time], null where there is none."""
    own = [c for c in left.columns if c != by]
    a = left.select(by, F.col(time).alias("_t"), F.struct(*own).alias("_left"), F.lit(None).cast("double").alias("_v"))
    b = right.select(by, F.col(time).alias("_t"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.col(value).cast("double").alias("_v"))
    w = Window.partitionBy(by).orderBy("_t").rangeBetween(-back, 0)
    return a.unionByName(b).withColumn(out, F.min("_v").over(w)).where("_left IS NOT NULL").select(by, *[F.col(f"_left.{c}").alias(c) for c in own], out)


def latest(df: DataFrame, by: str | Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    keys = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def next_in_calendar(events: DataFrame, day: str, calendar: DataFrame, within: int, out: str) -> DataFrame:
    """Events with the first calendar day after them, within some days; others are dropped.

    ``calendar`` has one row per day in the column ``day``.
    """
    keys = events.columns
    ahead = events.withColumn("_d", F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, within))))
    met = ahead.join(calendar.select(F.col("day").alias("_d")), "_d")
    return met.groupBy(*keys).agg(F.min("_d").alias(out))


def member_at(intervals: DataFrame, at: Column, start: str = "from_day", end: str = "to_day") -> DataFrame:
    """Rows whose interval holds ``at``; both ends belong to it and an open end never ends."""
    return intervals.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at)))


def overlaps(intervals: DataFrame, by: str, identity: str, label: str, start: str = "from_day", end: str = "to_day", days: int = 91) -> DataFrame:
    """Pairs in a group that overlap (kind positive) or share one day (touch), with whether their labels differ.

    The later of two that meet starts within the other, so intervals are dealt
    to the buckets of ``days`` that they reach, up to the last start of all,
    and meet those that start in the bucket; a group's rows are not all paired.
    """
    far = F.lit("9999-12-31").cast("date")
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    whole = intervals.where(F.col(start).isNotNull())
    last = whole.agg(F.max(start)).first()[0]
    one = whole.select(by, F.col(identity).alias("id_o"), F.col(label).alias("label_o"), F.col(start).alias("fo"), F.coalesce(end, far).alias("to"))
    two = whole.select(by, F.col(identity).alias("id_l"), F.col(label).alias("label_l"), F.col(start).alias("fl"), F.coalesce(end, far).alias("tl"), bucket(F.col(start)).alias("_bucket"))
    reach = F.least("to", F.lit(last).cast("date"))
    one = one.withColumn("_bucket", F.explode(F.when(reach >= F.col("fo"), F.sequence(bucket(F.col("fo")), bucket(reach)))))
    later = (F.col("fo") < F.col("fl")) | ((F.col("fo") == F.col("fl")) & (F.col("id_o") < F.col("id_l")))
    met = one.join(two, [by, "_bucket"]).where(later & (F.col("fl") <= F.least("to", "tl")))
    swap = F.col("id_o") > F.col("id_l")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = met.select(by, pick("id_o", "id_l").alias("id_a"), pick("id_l", "id_o").alias("id_b"), pick("label_o", "label_l").alias("label_a"), pick("label_l", "label_o").alias("label_b"), F.col("fo").alias("fa"), F.col("to").alias("ta"), F.col("fl").alias("fb"), F.col("tl").alias("tb"))
    kind = F.when(F.greatest("fa", "fb") < F.least("ta", "tb"), "positive").otherwise("touch")
    return pairs.select(by, "id_a", "id_b", kind.alias("kind"), (F.col("label_a") != F.col("label_b")).alias("differs"))


def by_precedence(by: str, tables: Sequence[tuple[str, DataFrame]], name: str = "source_table") -> DataFrame:
    """Rows of the first table, in order, that has any row of the key."""
    union = reduce(DataFrame.unionByName, [df.withColumn("_p", F.lit(i)).withColumn(name, F.lit(n)) for i, (n, df) in enumerate(tables)])
    return union.withColumn("_first", F.min("_p").over(Window.partitionBy(by))).where("_p = _first").drop("_p", "_first")


def with_proxy(bars: DataFrame, wanted: DataFrame, proxies: DataFrame) -> DataFrame:
    """Bars of wanted codes; a code without bars takes those of its proxy under its own name.

    ``proxies`` maps code to proxy, a small table that Spark may broadcast.
    """
    own = bars.join(wanted, "code", "left_semi")
    lacking = wanted.join(bars.select("code").distinct(), "code", "left_anti").join(proxies, "code")
    lent = bars.withColumnRenamed("code", "proxy").join(lacking, "proxy").select(*bars.columns)
    return own.withColumn("via_proxy", F.lit(False)).unionByName(lent.withColumn("via_proxy", F.lit(True)))


def align(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """One row: matched and missing keys, duplicated keys, and mismatches and largest difference per column."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), *[F.max(c).alias(f"{c}_{name}") for c in columns])

    both = side(left, "l").join(side(right, "r"), list(keys), "full")
    off = {c: F.abs(F.col(f"{c}_l") - F.col(f"{c}_r")) for c in columns}
    matched = F.col("n_l").isNotNull() & F.col("n_r").isNotNull()
    return both.agg(
        F.count_if(matched).alias("matched"), F.count_if(F.col("n_r").isNull()).alias("missing_right"), F.count_if(F.col("n_l").isNull()).alias("missing_left"),
        F.count_if(F.col("n_l") > 1).alias("duplicates_left"), F.count_if(F.col("n_r") > 1).alias("duplicates_right"),
        *[F.count_if(matched & ((off[c] > tolerance) | (F.col(f"{c}_l").isNull() != F.col(f"{c}_r").isNull()))).alias(f"{c}_mismatch") for c in columns],
        *[F.max(off[c]).alias(f"{c}_max_diff") for c in columns],
    )
