"""Incremental ingest by Structured Streaming: validate, upsert, keep rejects, move the high-water mark.

The table is a folder with one sub-folder per batch.  A replayed batch writes
its own folder again, so every batch counts once; readers take the latest row
of each key, and ``compact`` folds the batches into one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import validate as v


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, rules: Callable[[], Mapping[str, Column]], files_per_batch: int = 4, most_rejected: float = 1.0) -> None:
    """Streams all files of a folder that were not taken yet through the rules into the target's folders.

    A batch is judged once, into one table that has the passed rows and the
    payloads of the others by ``ok``; rows, rejects and the ledger are read from it.
    """

    def batch(df: DataFrame, number: int) -> None:
        judged = v.judge(df, rules())
        bad = F.size("failed_rules") > 0
        payload = F.when(bad, F.to_json(F.struct(*df.columns)))
        at = f"{target}/judged/batch={number}"
        kept = judged.select(*df.columns, payload.alias("payload"), "failed_rules", (~bad).alias("ok"))
        kept.write.mode("overwrite").partitionBy("ok").parquet(at)
        stored = spark.read.schema(kept.schema).parquet(at)
        folder = f"batch={number}"
        stored.where("ok").select(*df.columns).write.mode("overwrite").parquet(f"{target}/rows/{folder}")
        stored.where("NOT ok").select("payload", F.array_join("failed_rules", ",").alias("failed_rules")).write.mode("overwrite").parquet(f"{target}/rejected/{folder}")
        counts = v.gate(stored, most_rejected).withColumn("last", F.lit(None).cast("string"))
        counts.write.mode("overwrite").parquet(f"{target}/ledger/{folder}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_table(spark: SparkSession, target: str, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row of each key: of the latest batch, there the last by order."""
    rows = spark.read.parquet(f"{target}/rows")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def compact(spark: SparkSession, target: str, keys: Sequence[str], order: str, to: str) -> None:
    """Folds all batches into a new table."""
    read_table(spark, target, keys, order).write.mode("overwrite").parquet(f"{to}/rows/batch=0")


def guarded_mark(stored: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored mark, but never beyond the real maximum."""
    return stored.join(actual, list(keys), "left").select(*keys, F.least("mark", F.coalesce("real", "mark")).alias("mark"))


def commit_marks(marks: DataFrame, candidates: DataFrame, gates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks with the candidates of groups all of whose tables passed; others wait."""
    ok = gates.groupBy("grp").agg(F.bool_and("ok").alias("all_ok"))
    moved = candidates.join(ok, "grp").where("all_ok").select(*keys, F.col("candidate"))
    return marks.join(moved, list(keys), "left").select(*keys, F.coalesce("candidate", "mark").alias("mark"))


def commit(spark: SparkSession, current: str, target: str, candidates: DataFrame, gates: DataFrame, keys: Sequence[str]) -> None:
    """Writes the next version of the marks table in one go: readers see all moved marks or none."""
    commit_marks(spark.read.parquet(current), candidates, gates, keys).write.mode("overwrite").parquet(target)


def late_days(changes: DataFrame, last_sync: Column, day: str = "dt") -> DataFrame:
    """Days with changes after the last synchronisation; without one there are none."""
    return changes.where(F.coalesce(F.col("updated") > last_sync, F.lit(False))).select(day).distinct()


def two_pass(spark: SparkSession, factors: str, prices: str, target: str, checkpoint: str, column: str = "close") -> None:
    """First pass: every code's latest factor over the whole run.  Second pass: a stream of the price shards, adjusted by it.

    A price whose code has no factor is an error, as anchors must cover the run.
    """
    anchors = spark.read.parquet(factors).groupBy("code").agg(F.max_by("adj_factor", "dt").alias("_anchor"))
    anchors.write.parquet(f"{target}/anchors")
    held = spark.read.parquet(f"{target}/anchors")
    missing = F.raise_error(F.concat(F.lit("no factor for "), F.col("code"))).cast("double")

    def batch(df: DataFrame, number: int) -> None:
        met = df.join(held, "code", "left").withColumn(column, F.col(column) * F.when(F.col("_anchor").isNull(), missing).otherwise(F.col("_anchor")))
        met.drop("_anchor").write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    stream = spark.readStream.schema(spark.read.parquet(prices).schema).parquet(prices)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def blocked_batches(ledger: DataFrame, by: str, order: str, most: float = 0.05, run: int = 3) -> DataFrame:
    """Every batch with whether the table is blocked after it: one batch above ``most`` rejects, or ``run`` bad ones in a row, until a good one."""
    share = F.try_divide("rejected", "raw")
    w = Window.partitionBy(by).orderBy(order)
    bad = ledger.withColumns({"bad": F.col("rejected") > 0, "severe": F.coalesce(share > most, F.lit(False)), "_i": F.row_number().over(w)})
    since = F.col("_i") - F.coalesce(F.max(F.when(~F.col("bad"), F.col("_i"))).over(w), F.lit(0))
    bad = bad.withColumn("bad_run", since)
    severe = F.coalesce(F.max(F.when(F.col("severe"), F.col("_i"))).over(w), F.lit(0)) > F.coalesce(F.max(F.when(~F.col("bad"), F.col("_i"))).over(w), F.lit(0))
    return bad.withColumn("blocked", (F.col("bad_run") >= run) | severe).drop("_i")
