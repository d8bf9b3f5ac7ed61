"""Files: shards, exports in other encodings, event and log texts, upserts and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words for the two directions in platform exports.  Fixed values.
DIRECTIONS = {"买入": "buy", "买": "buy", "buy": "buy", "卖出": "sell", "卖": "sell", "sell": "sell"}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share; only a local session may name none."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_shards(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, codes: Sequence[str] = (), columns: Sequence[str] = ()) -> DataFrame:
    """Rows of parquet shards in a date window, of wanted six-digit codes; filters and columns reach the scan."""
    df = spark.read.parquet(path).where(F.col("code").rlike(r"^\d{6}$"))
    if start:
        df = df.where(F.col("dt") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("dt") <= F.lit(end).cast("date"))
    if codes:
        df = df.where(F.col("code").isin(list(codes)))
    return df.select(*columns) if columns else df


def read_export(spark: SparkSession, path: str, header: Sequence[str], schema: str, encoding: str = "GBK") -> DataFrame:
    """A platform's CSV export; a header other than the expected one is an error.

    Spark reads charsets beyond UTF and ISO-8859-1 only where the session allows Java's, so this is set.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    found = spark.read.option("encoding", encoding).option("header", "true").csv(path).columns
    if found != list(header):
        raise ValueError(f"unexpected header {found}")
    return spark.read.option("encoding", encoding).option("header", "true").schema(schema).csv(path)


def direction(word: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    return F.try_element_at(known, F.trim(word))


def import_events(spark: SparkSession, path: str, columns: Mapping[str, str], event_type: str) -> DataFrame:
    """Events of a CSV file: rows whose date cannot be read are dropped, and the key is a digest of the row as JSON."""
    raw = spark.read.option("header", "true").csv(path)
    named = raw.select(*[F.col(source).alias(target) for target, source in columns.items()])
    day = F.try_to_date(F.col("event_date"), "yyyy-MM-dd")
    key = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    return named.withColumn("source_key", key).withColumn("event_date", day).withColumn("event_type", F.lit(event_type)).where("event_date IS NOT NULL")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with a header, as text, and ``source_row_id``: a row's place in its file, from 0.

    A large file is read in splits by several tasks.  A row's place is its place
    in its split and the rows of the file's splits before it; rows are stored
    once, so that both are of the same reading.
    """
    raw = spark.read.option("header", "true").csv(path)
    at = shared_path(spark, "lines")
    raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")).write.parquet(at)
    rows = spark.read.parquet(at)
    splits = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))  # a row per split
    return rows.join(F.broadcast(splits), ["_file", "_block"]).withColumn("source_row_id", F.col("_id") + F.col("_shift")).select(*raw.columns, "source_row_id")


def replace_events(spark: SparkSession, path: str, columns: Mapping[str, str], event_type: str, target: str) -> None:
    """Imports a CSV file's events in place of all stored ones of their type; the other types' files are not touched.

    A row whose date cannot be read is dropped, but counts for the places of
    the others.  The key is a digest of type, fields and place, so equal rows
    are events of their own; the payload is the whole row.
    """
    rows = numbered_lines(spark, path)
    lacking = sorted(set(columns.values()) - set(rows.columns)) + sorted({"event_date", "code"} - set(columns))
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    payload = F.to_json(F.struct(*[c for c in rows.columns if c != "source_row_id"]))
    named = rows.select(*[F.col(source).alias(name) for name, source in columns.items()], "source_row_id", payload.alias("payload"))
    named = named.withColumn("code", F.lpad(F.regexp_extract(F.trim("code"), r"^(\d+)", 1), 6, "0"))
    key = F.sha2(F.to_json(F.struct(F.lit(event_type).alias("event_type"), *sorted(columns), "source_row_id", "payload")), 256)
    made = named.withColumn("source_key", key).withColumn("event_date", F.try_to_date(F.substring("event_date", 1, 10), "yyyy-MM-dd")).where("event_date IS NOT NULL")
    made = made.withColumn("event_type", F.lit(event_type))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_type").parquet(target)


def extract_log(lines: DataFrame, marker: str = "buy_stocks") -> DataFrame:
    """(day, code) of log lines with a day and a list of codes behind the marker; suffixes are cut."""
    inside = F.regexp_extract("value", marker + r":\s*\[([^\]]*)\]", 1)
    found = lines.select(F.regexp_extract("value", r"(\d{4}-\d{2}-\d{2})", 1).alias("day"), inside.alias("list")).where("day <> '' AND list <> ''")
    codes = F.transform(F.split("list", ","), lambda x: F.regexp_extract(x, r"(\d{6})", 1))
    return found.select("day", F.explode(codes).alias("code")).where("code <> ''")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Existing rows with incoming ones in place of those with the same key; of repeated incoming keys the last by order."""
    both = existing.select(*existing.columns, F.lit(0).alias("_new")).unionByName(incoming.select(*existing.columns, F.lit(1).alias("_new")))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def upsert_counts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys that are new, and keys that are updated."""
    joined = incoming.select(*keys).distinct().join(existing.select(*keys).distinct().withColumn("_known", F.lit(True)), list(keys), "left")
    return joined.agg(F.count_if(F.col("_known").isNull()).alias("new"), F.count("_known").alias("updated"))


def changed_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Incoming rows that are new or differ, nulls compared as values, in any column that is not excluded."""
    compared = [c for c in incoming.columns if c not in keys and c not in exclude]
    old = existing.select(*keys, F.struct(*compared).alias("_old"))
    return incoming.join(old, list(keys), "left").where(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.struct(*compared))).select(*incoming.columns)


def stamped(df: DataFrame, source: str, label: str | None = None) -> DataFrame:
    return df.withColumn("data_source", F.lit(label or source))


def export_by_code(bars: DataFrame, path: str, freq: str = "daily") -> None:
    """Parquet by market, frequency and code; the market follows from the first digit.

    Rows are dealt by code before, so that a code is not one small file of every
    task; Spark splits a partition that a large code makes too large.
    """
    market = F.when(F.substring("code", 1, 1).isin("5", "6", "9"), "SH").otherwise("SZ")
    bars.withColumns({"market": market, "freq": F.lit(freq)}).hint("rebalance", "code").write.partitionBy("market", "freq", "code").parquet(path)


def quarantine(rejected: DataFrame, table: str, batch: str) -> DataFrame:
    """Rejected rows as payload with rules and status, ready to append."""
    fields = [c for c in rejected.columns if c not in ("failed_rules", "error_values")]
    return rejected.select(F.lit(batch).alias("batch_id"), F.lit(table).alias("table"), F.to_json(F.struct(*fields)).alias("payload"), F.array_join("failed_rules", ",").alias("failed_rules"), F.lit("pending_repair").alias("status"))


def marked(sink: DataFrame, fixed: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """The sink with the status of some rows changed."""
    joined = sink.join(fixed.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left")
    return joined.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def windows(start: str, end: str, days: int, spark: SparkSession, grid: bool = False) -> DataFrame:
    """Fixed windows (first, last) of a range of days; a grid counts from 1970-01-01 so that all ranges share edges."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    first = F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(F.datediff(s, F.lit("1970-01-01").cast("date")) / days) * days).cast("int")) if grid else s
    starts = spark.range(1).select(F.explode(F.sequence(first, e, F.expr(f"INTERVAL {days} DAYS"))).alias("w"))
    return starts.select(F.greatest("w", s).alias("first"), F.least(F.date_add("w", days - 1), e).alias("last"))


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], order: str, partition: str) -> None:
    """Upsert into a table stored by a partition column, which belongs to the key: only partitions that incoming rows touch are read and written again."""
    existing = spark.read.parquet(path)
    touched = incoming.select(partition).distinct()
    merged = upsert(existing.join(touched, partition, "left_semi"), incoming, keys, order)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def browse(table: DataFrame, by: str, time: str) -> DataFrame:
    """Per key: rows, first and last time, and the number of the table's columns."""
    return table.groupBy(by).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.lit(len(table.columns)).alias("columns"))


def preview(table: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """The first rows of a table."""
    return table.orderBy(*order).limit(n)
