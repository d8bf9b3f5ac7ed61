"""Row rules with rejected rows kept, and counts of the same rules over stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def required(column: str) -> Column:
    """Null, or blank text."""
    return F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")


def bad_code(column: str = "code", pattern: str = r"^\d{6}") -> Column:
    return F.coalesce(~F.col(column).rlike(pattern), F.lit(True))


def bad_time(column: str = "time") -> Column:
    t = F.col(column).try_cast("bigint")
    return F.coalesce((t <= 0) | (t > 4 * 10**12), F.lit(True))


def bad_relation(o: str = "open", h: str = "high", low: str = "low", c: str = "close") -> Column:
    """All four there, and high below or low above the others."""
    o, h, low, c = (F.col(x) for x in (o, h, low, c))
    there = o.isNotNull() & h.isNotNull() & low.isNotNull() & c.isNotNull()
    return there & ((h < F.greatest(c, o, low) - 1e-9) | (low > F.least(c, o, h) + 1e-9))


def bad_unit(amount: str = "amount", close: str = "close", volume: str = "volume") -> Column:
    a, c, v = F.col(amount), F.col(close), F.col(volume)
    ok = (a > 0) & (c > 0) & (v > 0) & (v != INF)
    return F.coalesce(ok & ~F.try_divide(a, c * v).between(0.5, 2.0), F.lit(False))


def bad_type(column: str, kind: str) -> Column:
    return F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()


def not_in(column: str, values: Sequence) -> Column:
    return F.coalesce(~F.col(column).isin(list(values)), F.lit(False))


def below(column: str, least: float, strictly: bool = False) -> Column:
    """Below the least value; if ``strictly``, at it as well.  Null passes."""
    x = F.col(column)
    return F.coalesce((x <= least) if strictly else (x < least), F.lit(False))


def infinite(column: str) -> Column:
    return F.coalesce(F.abs(F.col(column)) == INF, F.lit(False))


def off_grid(time: str, minutes: int) -> Column:
    return F.coalesce(F.pmod(F.col(time), F.lit(minutes * 60000)) != 0, F.lit(False))


#: Stored frequencies of minute tables with their minutes.  Fixed values.
MINUTE_LABELS = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "60min": 60}


def frequency_rules(columns: Sequence[str], freq: str = "freq", time: str = "time", expected: str | None = None) -> dict[str, Column]:
    """Rules of a minute row's frequency: its column is missing, its label is none, it is another than expected, its time is off its own grid."""
    if freq not in columns:
        return {"FrequencyMissing": F.lit(True)}
    minutes = F.lit(None).cast("int")
    for label, n in MINUTE_LABELS.items():
        minutes = F.when(F.col(freq) == label, n).otherwise(minutes)
    rules = {"FrequencyInvalid": minutes.isNull()}
    if expected is not None:
        rules["FrequencyMismatch"] = minutes.isNotNull() & (F.col(freq) != expected)
    if time in columns:
        rules["FrequencyGrid"] = F.coalesce(F.pmod(F.col(time).try_cast("bigint"), minutes.cast("long") * 60000) != 0, F.lit(False))
    return rules


def side_rules(side: str, columns: Sequence[str]) -> dict[str, Column]:
    """Rules of one adjusted side of a bar (open, high, low, close with the side's suffix); a column that is not there has no values.

    Incomplete: one to three of the four have a value.  Of complete ones: not
    positive, or else the bar's relation is broken.
    """
    o, h, low, c = (F.col(f"{n}_{side}") if f"{n}_{side}" in columns else F.lit(None).cast("double") for n in ("open", "high", "low", "close"))
    have = reduce(lambda a, b: a + b, [(x.isNotNull() & ~F.isnan(x)).cast("int") for x in (o, h, low, c)])
    full = have == 4
    positive = F.least(o, h, low, c) > 0
    broken = (h < F.greatest(o, low, c) - 1e-9) | (low > F.least(o, h, c) + 1e-9)
    return {"AdjustmentCompleteness": have.between(1, 3), "AdjustmentPositive": full & ~positive, "AdjustmentOHLC": full & positive & broken}


def bad_side(columns: Sequence[str]) -> dict[str, Column]:
    """Rules of one adjusted side: incomplete, not positive."""
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return {"AdjustmentCompleteness": n.between(1, len(columns) - 1), "AdjustmentPositive": F.coalesce(F.least(*columns) <= 0, F.lit(False))}


def ratio_spread(adjusted: Sequence[str], raw: Sequence[str]) -> Column:
    """Largest relative distance of the ratios of adjusted to raw prices from their mean."""
    ratios = F.array(*[F.try_divide(F.col(a), F.col(r)) for a, r in zip(adjusted, raw, strict=True)])
    mean = F.aggregate(ratios, F.lit(0.0), lambda x, v: x + v) / len(raw)
    return F.array_max(F.transform(ratios, lambda v: F.abs(F.try_divide(v, mean) - 1)))


def inconsistent_ratios(adjusted: Sequence[str], raw: Sequence[str], most: float = 0.02) -> Column:
    return F.coalesce(ratio_spread(adjusted, raw) > most, F.lit(False))


def bar_rules(now_ms: int = 4 * 10**12) -> dict[str, Column]:
    """The rules of a daily bar, by name."""
    return {
        "RequiredValueNull": required("close"), "CodeFormat": bad_code(), "DateValid": F.coalesce((F.col("time") <= 0) | (F.col("time") > now_ms), F.lit(True)), "OHLCLogic": bad_relation(),
        "UnitCheck": bad_unit(), "PositiveNumeric": below("close", 0, True), "InfCheck": infinite("volume"), "EnumCheck": not_in("data_source", ["alpha", "beta"]),
    }


def judge(df: DataFrame, rules: Mapping[str, Column], values: Mapping[str, str] | None = None) -> DataFrame:
    """Adds the names of all rules that a row breaks, and the offending values by field."""
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    out = df.withColumn("failed_rules", names)
    if values:
        pairs = F.array_compact(F.array(*[F.when(rules[r], F.struct(F.lit(field).alias("key"), F.coalesce(F.col(field).cast("string"), F.lit("null")).alias("value"))) for r, field in values.items()]))
        out = out.withColumn("error_values", pairs)
    return out


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passed rows without, and rejected rows with the judgement."""
    bad = F.size("failed_rules") > 0
    extra = [c for c in ("failed_rules", "error_values") if c in judged.columns]
    return judged.where(~bad).drop(*extra), judged.where(bad)


def fix_duplicates(df: DataFrame, keys: Sequence[str], position: str, flag: str | None = None) -> DataFrame:
    """One row per key: with a flag the highest (null as -1), the first on ties; else the last."""
    order = [F.desc(F.coalesce(F.col(flag), F.lit(-1))), F.col(position)] if flag else [F.desc(position)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def gate(judged: DataFrame, most: float = 0.0001) -> DataFrame:
    """One row: raw, passed and rejected rows, and whether the batch passes."""
    n = judged.agg(F.count("*").alias("raw"), F.count_if(F.size("failed_rules") > 0).alias("rejected"))
    n = n.withColumn("passed", F.col("raw") - F.col("rejected"))
    ok = (F.col("raw") == 0) | ((F.col("passed") > 0) & (F.try_divide("rejected", "raw") <= most))
    return n.withColumn("ok", F.coalesce(ok, F.lit(False)))


def audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row with the count of each rule's broken rows, in one pass."""
    return df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])


def tall(counts: DataFrame) -> DataFrame:
    """(rule, n) from one row of counts."""
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in counts.columns])).alias("x")).select("x.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def snapshot_status(members: DataFrame, expected: DataFrame) -> DataFrame:
    """Status of each (index, month) by violations, registration and the fixed count (null where it varies)."""
    per = members.groupBy("index_code", "month").agg(F.count_distinct("code").alias("n"), F.count_if(F.coalesce(F.col("weight") <= 0, F.lit(True))).alias("violations"))
    joined = per.join(expected.withColumn("registered", F.lit(True)), "index_code", "left")
    status = F.when(F.col("violations") > 0, "invalid").when(F.col("registered").isNull(), "unknown").when(F.col("expected").isNull() | (F.col("n") >= F.col("expected")), "complete").otherwise("partial")
    return joined.select("index_code", "month", "n", status.alias("status"))


def conservation(ledger: DataFrame) -> DataFrame:
    """Batches whose stage counts do not add up."""
    return ledger.where((F.col("aligned") != F.col("passed") + F.col("rejected") + F.col("fixed")) | (F.col("written") > F.col("passed")))


def worst(rows: DataFrame, by: str, status: str, order: Sequence[str], out: str, keys: DataFrame | None = None, none: str = "no_data") -> DataFrame:
    """The worst status of each key, the first of the order being the worst; of given keys those without any row have ``none``."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status))
    got = rows.groupBy(by).agg(F.element_at(F.array(*[F.lit(s) for s in order]), F.min(place).cast("int")).alias(out))
    return got if keys is None else keys.select(by).distinct().join(got, by, "left").withColumn(out, F.coalesce(out, F.lit(none)))


def profile(tables: Mapping[str, DataFrame], times: Mapping[str, str], marks: DataFrame | None = None) -> DataFrame:
    """Rows and bounds of the time column of each table, with its high-water mark (name, mark) where marks are given."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.min(times[name]).cast("string").alias("first"), F.max(times[name]).cast("string").alias("last")) for name, df in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows if marks is None else rows.join(F.broadcast(marks), "name", "left")  # one row per table
