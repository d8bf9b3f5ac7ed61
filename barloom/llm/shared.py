"""Small helpers that several operators use: shared storage and text columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session (tests on one machine) may name none; there a
    temporary folder is made and set.  A cluster without one is refused, as
    its executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that costly stages run once, and survives the loss of
    executors, as the files are on shared storage.
    """
    return stored(df, fresh_path(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` has written and that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that nothing refers to any more, which it does when the driver collects its garbage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


class Scratch:
    """Tables in a folder of their own on shared storage, deleted together when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, fresh_path(spark, name), 0

    def fresh(self) -> str:
        self.n += 1
        return f"{self.path}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        return stored(df, self.fresh())

    def drop(self) -> None:
        remove(self.spark, self.path)


#: Bytes of a batch that Spark hands to Python; by rows alone, long texts would make batches of any size.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches of this session's Python stages by bytes, where the session does not do so itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: A sieve has 16 bits for each hash in it, up to so many in all.
SIEVE_BITS = 1 << 24


def positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def sifted(h: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in the sieve, an array of 64-bit words; those that are in it always may."""
    return np.all([(sieve[p >> 6] >> (p & 63)) & 1 for p in positions(h, 64 * len(sieve))], axis=0)


def bit_sieve(hashes: DataFrame, n: int) -> np.ndarray:
    """The bit sieve of about ``n`` hashes (h, signed), two bits each; its size is bounded, whatever their number."""
    bits = min(SIEVE_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    at = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1)))).alias("at"))
    some = at.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    sieve = np.zeros(bits // 64, np.int64)
    sieve[some.column("slot").to_numpy()] = some.column("bits").to_numpy()
    return sieve


#: A side of a join is broadcast up to so many rows.
BROADCAST_ROWS = 50_000
SALTS = 8


def keyed_join(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row for each key at most and is on shared storage.

    A small ``keyed`` is broadcast.  Else both sides get a salt, so that a key
    that many rows have is dealt to several tasks by the column ``spread``.
    """
    if keyed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), keys)
    return salted_join(rows, keyed, keys, spread)


def dealt(side: DataFrame) -> DataFrame:
    """A side of a join that has no bound: both sides are shuffled.

    Spark's estimate would have it broadcast where it is the size of a small
    file, though it is compressed there, or made of more rows by an explode.
    """
    return side.hint("merge")


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join with ``keyed``, which has one row for each key at most; the rows of a key are dealt to several tasks."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    every = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(dealt(every), [*keys, "__salt"]).drop("__salt")


def places(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in order over all its rows, on shared storage: ``at`` is a row's place in its partition ``part``.

    Rows are dealt by ranges of the whole order, so that rows with equal leading
    columns are dealt to several tasks; partitions follow each other by ``part``.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(dealt.withColumns({"part": F.spark_partition_id(), "at": at}), "places")


def crc32_sql(rows: str) -> str:
    """DuckDB SQL that adds ``crc``, the unsigned CRC-32 of the bytes in the hex column ``h``, to the query ``rows``."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor(3988292384, {0} >> 1) ELSE {0} >> 1 END"
    return f"""WITH RECURSIVE bits AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) r(i)
            UNION ALL SELECT i, {step.format("v")}, k + 1 FROM bits WHERE k < 8),
        crcs AS MATERIALIZED (SELECT list(v ORDER BY i) AS of FROM bits WHERE k = 8),
        pairs AS MATERIALIZED (SELECT map(list(printf('%02X', CAST(i AS INTEGER))), list(CAST(i AS BIGINT))) AS of FROM range(256) r(i))
        SELECT * EXCLUDE (at_, of_), xor(4294967295, list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: at_[x]),
            lambda acc, b: xor(acc >> 8, of_[1 + (xor(acc, b) & 255)]), CAST(4294967295 AS BIGINT))) AS crc
        FROM ({rows}) CROSS JOIN (SELECT of AS of_ FROM crcs) CROSS JOIN (SELECT of AS at_ FROM pairs)"""


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of one column; a larger value is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, until - at)
        at = until
    pa.default_memory_pool().release_unused()  # workers are used again and would keep what one batch took


def text_or_empty(column: str = "text") -> Column:
    """The whole text, null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
