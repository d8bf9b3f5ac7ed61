"""The quarantine sink: rejected rows by batch, admitted against a capacity, archived by age, with alerts by rule and day.

The sink is a table of the manifest with a folder per batch.  What waits for
repair is counted from the listed files, without reading them; archiving lists
an old batch's files under another table, without writing them again.  Writers
that meet (of concurrent batches) start again from the version that came
before them, so the capacity holds for all of them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest as m

SINK = "batch_id string, table string, source string, payload string, failed_rules string, day string"
PENDING, ARCHIVED = "quarantine", "quarantine_archived"
#: A writer starts again so often when others commit before it.
TRIES = 20


def sink_rows(rejected: DataFrame, batch_id: str, table: str, source: str, day: str) -> DataFrame:
    """Rejected rows as the sink keeps them: the row as JSON, and the names of its rules in order."""
    fields = [c for c in rejected.columns if c not in ("failed_rules", "error_values")]
    lits = [F.lit(v).alias(n) for n, v in (("batch_id", batch_id), ("table", table), ("source", source))]
    return rejected.select(*lits, F.to_json(F.struct(*fields)).alias("payload"), F.array_join(F.array_sort("failed_rules"), ",").alias("failed_rules"), F.lit(day).alias("day"))


def admit(spark: SparkSession, root: str, rows: DataFrame, batch_id: str, day: str, capacity: int = 500_000, keep_days: int = 7) -> dict:
    """Puts a batch into the sink unless ``capacity`` rows or more wait there already; the whole batch is taken or refused.

    Batches older than ``keep_days`` are archived first, which makes room.  A
    batch that is in the sink is not taken again.
    """
    fresh = m.stage(rows, root, f"{PENDING}/{batch_id}", "day")
    fresh = fresh.withColumn("table", F.lit(PENDING))
    offered = fresh.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for _ in range(TRIES):
        base = m.latest(spark, root)
        files = m.entries(spark, root, base)
        old = (F.col("table") == PENDING) & (F.col("high") < F.date_sub(F.lit(day).cast("date"), keep_days).cast("string"))
        files = files.withColumn("_old", old)
        again = F.col("path").contains(f"/{PENDING}/{batch_id}/")
        told = files.agg(F.sum(F.when((F.col("table") == PENDING) & ~F.col("_old"), F.col("n"))).alias("pending"), F.sum(F.when(F.col("_old"), F.col("n"))).alias("archived"), F.count_if(again).alias("again")).first()
        pending, archived = told.pending or 0, told.archived or 0
        files = files.withColumn("table", F.when(F.col("_old"), ARCHIVED).otherwise(F.col("table"))).drop("_old")
        taken = pending < capacity and not told.again and offered > 0
        if taken:
            files = files.unionByName(fresh)
        report = {"batch_id": batch_id, "offered": offered, "written": offered if taken else 0, "archived": archived, "pending": pending + (offered if taken else 0)}
        if not taken and not archived:
            return report
        try:
            m.commit(spark, root, base, files)
            return report
        except m.Conflict:
            continue
    raise m.Conflict(f"batch {batch_id} met other writers {TRIES} times")


def waiting(spark: SparkSession, root: str) -> DataFrame:
    return m.read(spark, root, PENDING, SINK)


def archived(spark: SparkSession, root: str) -> DataFrame:
    return m.read(spark, root, ARCHIVED, SINK)


def alerts(sink: DataFrame, most: int = 1000) -> DataFrame:
    """(day, failed_rules, n): rules that put ``most`` rows or more into the sink on one day."""
    return sink.groupBy("day", "failed_rules").agg(F.count("*").alias("n")).where(F.col("n") >= most)
