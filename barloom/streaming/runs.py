"""A run of the ingest: micro-batches are judged and staged, and one commit after the last of them shows rows and marks, or neither.

Rows and rejects are counted inside the write of each micro-batch.  The gate
looks at the sums of the whole run.  Beyond it the run's files are held: no
reader sees them and no mark moves, until ``release`` commits them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import validate as v
from ..sources import manifest as m

LEDGER = "run string, raw long, passed long, rejected long, written long, status string, day string"
REJECTED = "payload string, failed_rules array<string>"


def passes(raw: int, rejected: int, most: float) -> bool:
    """Nothing at all passes; else some rows must have passed, and no more than a share be rejected."""
    return not raw or raw > rejected and rejected / raw <= most


def run(spark: SparkSession, source: str, schema: str, root: str, table: str, checkpoint: str, rules: Callable[[], Mapping[str, Column]], keys: Sequence[str], order: str, by: str, mark: Sequence[str], most_rejected: float = 0.0001, files_per_batch: int = 4) -> DataFrame:
    """Takes all files that came since the last run; returns the run's row of the ledger.

    ``mark`` names the key of the marks; a mark is the largest ``by`` of its rows.  ``by`` belongs to the keys.
    """
    name, counts = uuid.uuid4().hex, {}

    def batch(df: DataFrame, number: int) -> None:
        seen = Observation(f"batch-{number}")
        judged = v.judge(df, rules())
        ok = F.size("failed_rules") == 0
        kept = judged.select(*df.columns, F.when(~ok, F.to_json(F.struct(*df.columns))).alias("payload"), "failed_rules", ok.alias("ok"))
        # one write: readers take the rows and the rejects from their folders; files are ranges, so that few meet each other
        dealt = kept.repartitionByRange("ok", by)
        told = dealt.observe(seen, F.count("*").alias("raw"), F.count_if(~F.col("ok")).alias("rejected"))  # behind the exchange, which reads its input twice
        # of a batch the last row of each key: the ranges have all rows of a key together, so this needs no further exchange
        last = F.row_number().over(Window.partitionBy("ok", *keys).orderBy(F.desc(order)))
        told = told.withColumn("_n", last).where("_n = 1 OR NOT ok").drop("_n").sortWithinPartitions("ok", by)
        told.write.mode("overwrite").partitionBy("ok").parquet(f"{root}/{table}/run={name}/batch={number}")
        counts[number] = seen.get

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    raw, rejected = (sum(c[k] for c in counts.values()) for k in ("raw", "rejected"))
    good = passes(raw, rejected, most_rejected)
    base = m.latest(spark, root)
    held = m.entries(spark, root, base)
    number = 1 + (held.where(F.col("table").isin(table, f"{table}_held")).agg(F.max("batch")).first()[0] or 0)
    files, refused = m.entries(spark, root, -1), m.entries(spark, root, -1)
    for k in sorted(counts):
        at = f"{root}/{table}/run={name}/batch={k}"
        if counts[k]["raw"] > counts[k]["rejected"]:
            files = files.unionByName(m.describe(spark, f"{at}/ok=true", table if good else f"{table}_held", by, number + k - min(counts)))
        if counts[k]["rejected"]:
            refused = refused.unionByName(m.describe(spark, f"{at}/ok=false", f"{table}_rejected", by, number + k - min(counts)))
    day = files.agg(F.max("high")).first()[0]
    status = "empty" if not raw else "success" if good else "failed"
    row = spark.createDataFrame([(name, raw, raw - rejected, rejected, raw - rejected if good else 0, status, day)], LEDGER)
    files = held.unionByName(files).unionByName(refused).unionByName(m.stage(row, root, "ledger", "run", number))
    m.commit(spark, root, base, with_marks(spark, root, files, table, mark, by, number) if good and raw > rejected else files)
    return row


def with_marks(spark: SparkSession, root: str, files: DataFrame, table: str, mark: Sequence[str], by: str, since: int) -> DataFrame:
    """The files with the table's marks advanced by those of its batches from ``since`` on."""
    marks = f"{table}_marks"
    fresh = [r.path for r in files.where((F.col("table") == table) & (F.col("batch") >= since)).select("path").collect()]
    old = [r.path for r in files.where(F.col("table") == marks).select("path").collect()]
    new = spark.read.parquet(*fresh).groupBy(*mark).agg(F.max(by).alias("mark"))
    both = new.unionByName(spark.read.schema(new.schema).parquet(*old)) if old else new
    return files.where(F.col("table") != marks).unionByName(m.stage(both.groupBy(*mark).agg(F.max("mark").alias("mark")), root, marks, mark[0]))


def release(spark: SparkSession, root: str, table: str, mark: Sequence[str], by: str) -> int:
    """Commits the files that failed runs have left held, with their marks."""
    base = m.latest(spark, root)
    files = m.entries(spark, root, base)
    held = F.col("table") == f"{table}_held"
    since = files.where(held).agg(F.min("batch")).first()[0]
    if since is None:
        return base
    shown = files.withColumn("table", F.when(held, table).otherwise(F.col("table")))
    return m.commit(spark, root, base, with_marks(spark, root, shown, table, mark, by, since))


def rows(spark: SparkSession, root: str, table: str, schema, keys: Sequence[str], order: str, by: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """The table's current rows, the last of each key."""
    return m.read(spark, root, table, schema, low=low, high=high, keys=keys, order=order, by=by)


def marks(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    return m.read(spark, root, f"{table}_marks", schema)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    return m.read(spark, root, "ledger", LEDGER)


def rejects(spark: SparkSession, root: str, table: str) -> DataFrame:
    return m.read(spark, root, f"{table}_rejected", REJECTED)
