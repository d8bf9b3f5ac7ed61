"""Audits of whole tables: reports with counts, samples and a verdict, and changes that take effect only where the verdict is good.

A verdict is a one-row frame, so no table is collected to decide it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins, validate
from .quantiles import quantiles

FAR = "9999-12-31"


def required_columns(spark, tables: Mapping[str, DataFrame | None], required: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(name, present, n, missing, severity): ``required`` gives each table's columns with the severity of their absence."""
    parts = []
    for name, columns in required.items():
        df = tables.get(name)
        lacking = sorted(c for c in columns if df is None or c not in df.columns)
        severity = "error" if df is None or "error" in [columns[c] for c in lacking] else "warning" if lacking else "ok"
        rows = (df if df is not None else spark.range(0)).agg(F.count("*").alias("n"))
        parts.append(rows.select(F.lit(name).alias("name"), F.lit(df is not None).alias("present"), "n", F.lit(",".join(lacking)).alias("missing"), F.lit(severity).alias("severity")))
    return reduce(DataFrame.unionByName, parts)


def factor_by_source(rows: DataFrame, adjusted: Sequence[str], raw: Sequence[str], source: str, limits: Mapping[str, tuple[float, str]], default: tuple[float, str] = (0.02, "error")) -> DataFrame:
    """Per source: rows, rows whose adjusted-to-raw ratios differ by more than the source's limit, and the severity of having any."""
    def by(i: int) -> Column:
        known = F.create_map(*[F.lit(x) for name, limit in limits.items() for x in (name, limit[i])])
        return F.coalesce(F.try_element_at(known, F.col(source)), F.lit(default[i]))

    off = F.coalesce(validate.ratio_spread(adjusted, raw) > by(0), F.lit(False))
    got = rows.groupBy(source).agg(F.count("*").alias("n"), F.count_if(off).alias("off"))
    return got.withColumn("severity", F.when(F.col("off") > 0, by(1)).otherwise("ok"))


def anchors_off(rows: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Per code: the back ratio on the first day and the front ratio on the last one with a positive close, and whether they are off 1."""
    kept = rows.where((F.col("close") > 0) & F.col("close_front").isNotNull() & F.col("close_back").isNotNull())
    got = kept.groupBy("code").agg(F.min_by(F.col("close_back") / F.col("close"), "dt").alias("at_first"), F.max_by(F.col("close_front") / F.col("close"), "dt").alias("at_last"))
    return got.withColumns({"first_off": F.abs(F.col("at_first") - 1) > tolerance, "last_off": F.abs(F.col("at_last") - 1) > tolerance})


def stage_audit(ledger: DataFrame, quarantine: DataFrame, since: Column) -> DataFrame:
    """One row: batches, those whose counts do not add up or that wrote more than passed, failures since a day, and those with fewer rows in quarantine than rejected."""
    held = quarantine.groupBy("batch_id").agg(F.count("*").alias("_held"))
    joined = ledger.join(held, "batch_id", "left")
    return joined.agg(
        F.count("*").alias("batches"), F.count_if(F.col("aligned") != F.col("passed") + F.col("rejected") + F.col("fixed")).alias("unbalanced"), F.count_if(F.col("written") > F.col("passed")).alias("overwritten"),
        F.count_if((F.col("status") == "failed") & (F.col("day") >= since)).alias("failed_recent"), F.count_if(F.coalesce("_held", F.lit(0)) < F.col("rejected")).alias("not_in_quarantine"),
    )


def quarantine_audit(rows: DataFrame, required: Sequence[str], pending: str = "pending_repair") -> DataFrame:
    """One row: rows, pending ones, and nulls in each required field."""
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == pending).alias("pending"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required])


def interactive(df: DataFrame, rules: Mapping[str, Column], order: Sequence[str], samples: int = 20) -> DataFrame:
    """For each rule that any row breaks: all rows of the table, the rule's total, and up to ``samples`` rows in order."""
    broken = validate.judge(df, rules).where(F.size("failed_rules") > 0).select(F.explode("failed_rules").alias("rule"), *order)
    totals = broken.groupBy("rule").agg(F.count("*").alias("total")).crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))
    first = broken.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy(*order))).where(F.col("place") <= samples)
    # as many rows as there are rules
    return first.join(F.broadcast(totals), "rule")


def snapshot_quality(members: DataFrame, meta: DataFrame) -> DataFrame:
    """Registered snapshots with their members' number and weight; a snapshot without members has none."""
    per = members.groupBy("index_code", "month").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return meta.join(per, ["index_code", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def interval_quality(intervals: DataFrame, by: str, identity: str, label: str, known: DataFrame | None) -> DataFrame:
    """One row on intervals: overlaps and touches, backward ranges, keys with several open intervals, labels that are not known, and the verdict.

    Without a table of known labels the report is not complete and the verdict is bad.
    """
    counts = intervals.agg(F.count("*").alias("rows"), F.count_distinct(by).alias("codes"), F.count_if(F.col("from_day") > F.col("to_day")).alias("bad_ranges"))
    pairs = joins.overlaps(intervals, by, identity, label).agg(F.count_if(F.col("kind") == "positive").alias("overlaps"), F.count_if(F.col("kind") == "touch").alias("touches"))
    several = intervals.where("to_day IS NULL").groupBy(by).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi_current"))
    if known is None:
        orphans = counts.select(F.lit(None).cast("long").alias("orphans"))
    else:
        orphans = intervals.join(known.select(label).distinct(), label, "left_anti").agg(F.count("*").alias("orphans"))
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [counts, pairs, several, orphans])
    good = (F.col("rows") > 0) & (F.col("multi_current") == 0) & (F.col("orphans") == 0) & (F.col("bad_ranges") == 0)
    return out.withColumns({"complete": F.lit(known is not None), "ok": F.coalesce(good, F.lit(False))})


def staged_gate(staged: DataFrame, current: DataFrame, known: DataFrame | None, by: str, identity: str, label: str, rows: int, labels: int) -> tuple[DataFrame, DataFrame]:
    """A report on staged intervals, and the table that results: the staged one where all is as expected, else the current one.

    Expected are the numbers of rows and labels, no overlap and a good ``interval_quality``.
    """
    report = interval_quality(staged, by, identity, label, known).crossJoin(F.broadcast(staged.agg(F.count_distinct(label).alias("labels"))))
    report = report.withColumn("pass", F.col("ok") & (F.col("rows") == rows) & (F.col("labels") == labels) & (F.col("overlaps") == 0))
    return report, chosen(report.select("pass"), staged, current)


def chosen(verdict: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of one of two tables of the same columns, by a one-row verdict."""
    name = verdict.columns[0]
    one = good.crossJoin(F.broadcast(verdict)).where(F.col(name)).drop(name)
    return one.unionByName(bad.crossJoin(F.broadcast(verdict)).where(~F.col(name)).drop(name))


def source_differences(sources: Mapping[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """For each two sources: matched rows, mean, median, median size and 95th percentile of the size of their difference."""
    names, parts = list(sources), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            met = sources[a].select(*keys, F.col(value).alias("_a")).join(sources[b].select(*keys, F.col(value).alias("_b")), list(keys)).withColumn("d", F.col("_a") - F.col("_b"))
            (med,) = quantiles(met, "d", [0.5])
            abs_med, p95 = quantiles(met.select(F.abs("d").alias("d")), "d", [0.5, 0.95])
            exact = [F.lit(x).cast("double").alias(name) for name, x in (("med", med), ("abs_med", abs_med), ("p95", p95))]
            parts.append(met.agg(F.lit(f"{a}-{b}").alias("pair"), F.count("d").alias("n"), F.avg("d").alias("mean")).select("*", *exact))
    return reduce(DataFrame.unionByName, parts)


def rank_overlap(sources: Mapping[str, DataFrame], key: str, value: str, picked: DataFrame, n: int) -> DataFrame:
    """For each source: how many of its ``n`` keys of the highest value (ties by key) are among the picked ones, and their share of them."""
    parts = []
    for name, df in sources.items():
        top = df.groupBy(key).agg(F.max(value).alias("v")).orderBy(F.desc("v"), key).limit(n)
        met = top.join(picked.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
        parts.append(met.agg(F.lit(name).alias("source"), F.count("_in").alias("common"), F.try_divide(F.count("_in"), F.count("*")).alias("share")))
    return reduce(DataFrame.unionByName, parts)


def purge(table: DataFrame, source: str, authority: str, due: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table with the authority's rows alone, and a report; the table as it was where the keys that remain are not those due."""
    kept = table.where(F.col(source) == authority)
    left = kept.select(*keys).distinct().withColumn("_kept", F.lit(True))
    met = left.join(due.select(*keys).distinct().withColumn("_due", F.lit(True)), list(keys), "full")
    check = met.agg(F.count_if(F.col("_kept").isNull()).alias("lacking"), F.count_if(F.col("_due").isNull()).alias("extra"))
    report = table.agg(F.count("*").alias("before"), F.count_if(F.col(source) == authority).alias("authority_rows")).crossJoin(F.broadcast(check))
    report = report.withColumn("done", (F.col("lacking") == 0) & (F.col("extra") == 0))
    return chosen(report.select("done"), kept, table), report


def additive_deviation(rows: DataFrame, columns: Sequence[str], eps: float = 1e-9, notable: float = 0.01) -> DataFrame:
    """How far adjusted prices are from raw ones less the gap of the closes: per code and over all (code null).

    Share of notable deviations, 99th percentile, maximum, mean ratio to the
    gap where there is one, and correlation with the gap and the day's range.
    """
    gap = F.col("close") - F.col("close_front")
    parts = F.array(*[F.abs((F.col(c) - F.col(f"{c}_front")) - gap) for c in columns])
    base = rows.select("code", F.explode(parts).alias("d"), F.abs(gap).alias("gap"), (F.col("high") - F.col("low")).alias("range")).where("d IS NOT NULL")
    told = [
        F.count("*").alias("n"), F.avg((F.col("d") > notable).cast("int")).alias("share"), F.max("d").alias("most"),
        F.avg(F.when(F.col("gap") > eps, F.col("d") / F.col("gap"))).alias("to_gap"), F.corr("d", "gap").alias("with_gap"), F.corr("d", "range").alias("with_range"),
    ]
    per = base.groupBy("code").agg(*told, F.percentile("d", F.lit(0.99)).alias("p99"))  # a code's days are bounded
    (p99,) = quantiles(base, "d", [0.99])
    return per.unionByName(base.agg(*told).select(F.lit(None).cast("string").alias("code"), "*", F.lit(p99).cast("double").alias("p99")))


def tolerance_review(rows: DataFrame, segment: Sequence[str], stored: str, fresh: str, most: float, share: float, exact: float = 1e-6) -> DataFrame:
    """Segments that only differ in price (no value missing on one side): largest difference, share of rows that differ, and whether both are within limits."""
    d = F.abs(F.col(stored) - F.col(fresh))
    got = rows.groupBy(*segment).agg(F.count_if(F.col(stored).isNull() != F.col(fresh).isNull()).alias("_gone"), F.max(d).alias("most"), F.avg(F.coalesce(d > exact, F.lit(False)).cast("int")).alias("off"))
    return got.where((F.col("_gone") == 0) & (F.col("most") > exact)).drop("_gone").withColumn("within", (F.col("most") <= most) & (F.col("off") <= share))


def backfill_audit(members: DataFrame, status: DataFrame, source: str, days: Sequence[str]) -> DataFrame:
    """Per index and expected day: the snapshot as of the day with its members, the index's statuses, and the sources of its rows."""
    per = members.groupBy("index_code", "month").agg(F.count_distinct("code").alias("members"))
    states = status.groupBy("index_code").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "partial", "invalid", "unknown")])
    of = members.groupBy("index_code").agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))
    wanted = of.withColumn("day", F.explode(F.array(*[F.lit(d).cast("date") for d in days])))
    found = joins.asof(wanted, per.withColumn("as_of", F.col("month")), "index_code", "day", "month", ["as_of", "members"])
    return found.join(states, "index_code", "left")


def pending_audit(pending: DataFrame, triggers: DataFrame, key: str, origin: Sequence[str], payload: str) -> DataFrame:
    """One row: pending slots, those without a trigger, those whose trigger has another origin or payload, and whether there are none of these.

    Several triggers of a slot count once.
    """
    of = triggers.groupBy(key).agg(F.collect_set(F.struct(*origin)).alias("_origins"), F.collect_set(payload).alias("_payloads"))
    joined = pending.join(of, key, "left")
    other = lambda held, own: F.coalesce(F.size(F.filter(held, lambda x: x != own)) > 0, F.lit(False))
    out = joined.agg(F.count("*").alias("pending"), F.count_if(F.col("_origins").isNull()).alias("without_trigger"), F.count_if(other(F.col("_origins"), F.struct(*origin))).alias("other_origin"), F.count_if(other(F.col("_payloads"), F.col(payload))).alias("other_payload"))
    return out.withColumn("ok", (F.col("without_trigger") == 0) & (F.col("other_origin") == 0) & (F.col("other_payload") == 0))


def workflow_monitor(tables: Mapping[str, DataFrame], today: Column, overdue_days: int, waiting: Sequence[str], alarms: Mapping[tuple[str, str], int]) -> DataFrame:
    """(name, status, n, overdue, alarm) of tables with status and day: an alarm where a status has more rows than its limit, or any are overdue."""
    parts = [df.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(list(waiting)) & (F.datediff(today, "day") > overdue_days)).alias("overdue")).withColumn("name", F.lit(name)) for name, df in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    limit = reduce(lambda out, kv: F.when((F.col("name") == kv[0][0]) & (F.col("status") == kv[0][1]), F.lit(kv[1])).otherwise(out), alarms.items(), F.lit(None).cast("int"))
    return rows.select("name", "status", "n", "overdue", (F.coalesce(F.col("n") > limit, F.lit(False)) | (F.col("overdue") > 0)).alias("alarm"))


def adjust_coverage(rows: DataFrame, side: str = "close_front") -> DataFrame:
    """Per code: rows without an adjusted side."""
    return rows.groupBy("code").agg(F.count_if(F.col(side).isNull()).alias("no_side"))


def return_consistency(rows: DataFrame, most: float = 1.0, side: str = "close_front") -> DataFrame:
    """Per code: days whose adjusted and raw returns differ by more than so many per cent."""
    w = Window.partitionBy("code").orderBy("dt")
    pct = lambda c: (F.col(c) / F.lag(c).over(w) - 1) * 100
    return rows.withColumn("_off", F.abs(pct(side) - pct("close")) > most).groupBy("code").agg(F.count_if(F.col("_off")).alias("off"))


def watermark_state(marks: DataFrame, last: DataFrame, key: str = "code") -> DataFrame:
    """Whether each mark is ahead of, behind or equal to the last row."""
    state = F.when(F.col("mark") > F.col("last"), "ahead").when(F.col("mark") < F.col("last"), "behind").otherwise("equal")
    return marks.join(last, key).select(key, state.alias("state"))


def dividend_checks(dividends: DataFrame) -> DataFrame:
    """One row: negative cash, events not carried out yet, stock above cash, and whether all cash is missing."""
    return dividends.agg(
        F.count_if(F.col("cash") < 0).alias("negative"), F.count_if(F.col("proc") != "implemented").alias("planned"), F.count_if(F.col("stock") > F.col("cash")).alias("inverted"), (F.count("cash") == 0).alias("all_null")
    )


def queue_age(queue: DataFrame, today: Column, day: str = "dt", dead: int = 365, overdue: int = 90, stale: int = 30) -> DataFrame:
    """Entries of a queue by how old they are in days."""
    age = F.datediff(today, day)
    state = F.when(age > dead, "dead").when(age > overdue, "overdue").when(age > stale, "stale").otherwise("fresh")
    return queue.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def resolved_intervals(intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals without those that end before they start (overlaps stay), and one row with the numbers before and after."""
    good = F.col("to_day").isNull() | (F.col("from_day") <= F.col("to_day"))
    return intervals.where(good), intervals.agg(F.count("*").alias("raw"), F.count_if(good).alias("kept"))
