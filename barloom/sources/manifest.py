"""Several tables that change together: each version lists the data files of all of them, and one pointer file makes it the current one.

Data files are never changed.  A commit writes a list of files (the manifest)
and then creates the pointer of the next version, which fails if another
writer has created it.  Readers take the files of one version, so they see the
change of every table or of none, also while a commit goes on.

Every file is listed with its rows and the range of one column (a day or a
text), so reads and upserts open only files that can hold what they look for.
The driver handles file names and ranges, never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRIES = "table string, path string, n long, low string, high string, batch long"


class Conflict(Exception):  # noqa: N818
    """Another writer has committed, or is committing, since the version that this change was made from."""


@dataclass
class Change:
    """Rows to put into a table: the last by ``order`` of each key replaces what the table has under it; files are cut by ``by``."""

    rows: DataFrame
    keys: Sequence[str]
    order: str
    by: str


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """All versions with the names of their manifests; a version that is being committed has an empty name."""
    fs, p = _at(spark, f"{root}/_versions")
    if not fs.exists(p):
        return {}
    out = {}
    for found in fs.listStatus(p):
        name = found.getPath().getName()
        if name.isdigit():
            out[int(name)] = (spark.read.option("wholetext", "true").text(found.getPath().toString()).head() or [""])[0].strip() if found.getLen() else ""
    return out


def latest(spark: SparkSession, root: str) -> int:
    """The current version; -1 if there is none."""
    return max((v for v, name in versions(spark, root).items() if name), default=-1)


def entries(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The files of a version, the current one by default: see ``ENTRIES``."""
    known = versions(spark, root)
    version = max((v for v, name in known.items() if name), default=-1) if version is None else version
    if version < 0:
        return spark.createDataFrame([], ENTRIES)
    return spark.read.schema(ENTRIES).parquet(f"{root}/_manifests/{known[version]}")


def describe(spark: SparkSession, path: str, table: str, by: str, batch: int = 0) -> DataFrame:
    """Entries of a folder's files, from the one column that their ranges are of."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:  # nothing was written into it
        return spark.createDataFrame([], ENTRIES)
    value = F.col(by).cast("string")
    found = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.select(F.lit(table).alias("table"), "path", "n", "low", "high", F.lit(batch).cast("long").alias("batch"))


def stage(rows: DataFrame, root: str, table: str, by: str, batch: int = 0) -> DataFrame:
    """Writes rows into files of their own, each a range of ``by``, which no reader sees before a commit; returns their entries."""
    path = f"{root}/{table}/{uuid.uuid4().hex}"
    rows.repartitionByRange(by).sortWithinPartitions(by).write.parquet(path)
    return describe(rows.sparkSession, path, table, by, batch)


def commit(spark: SparkSession, root: str, base: int, files: DataFrame) -> int:
    """Makes ``files`` the version after ``base``, or raises Conflict and leaves the tables as they are."""
    name = uuid.uuid4().hex
    files.coalesce(1).write.parquet(f"{root}/_manifests/{name}")
    known = versions(spark, root)
    if any(v > base for v in known):
        raise Conflict(f"version {max(known)} was committed after {base}")
    fs, p = _at(spark, f"{root}/_versions/{base + 1:010d}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise Conflict(f"version {base + 1} is taken") from e
    out.writeBytes(name)
    out.close()
    return base + 1


def abandon(spark: SparkSession, root: str) -> None:
    """Removes pointers that writers have left unfinished; only for use when no writer is at work."""
    for v, name in versions(spark, root).items():
        if not name:
            fs, p = _at(spark, f"{root}/_versions/{v:010d}")
            fs.delete(p, False)


def overlapping(held: DataFrame, ranges: DataFrame) -> DataFrame:
    """Entries whose range meets one of ``ranges`` (low, high); null bounds meet all."""
    r = ranges.select(F.col("low").alias("_l"), F.col("high").alias("_h")).distinct()
    meets = F.coalesce(F.col("low") <= F.col("_h"), F.lit(True)) & F.coalesce(F.col("high") >= F.col("_l"), F.lit(True))
    return held.join(F.broadcast(r), meets, "left_semi")  # a row per file on either side


def last_of(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(spark: SparkSession, root: str, changes: Mapping[str, Change]) -> int:
    """Puts the changes of all tables into one new version; reads and writes again only files whose range they meet."""
    base = latest(spark, root)
    held, files = entries(spark, root, base), None
    for table, change in changes.items():
        own = held.where(F.col("table") == table)
        fresh = stage(last_of(change.rows, change.keys, change.order), root, table, change.by)
        met = overlapping(own, fresh)
        paths = [r.path for r in met.select("path").collect()]
        if paths:
            old = spark.read.schema(change.rows.schema).parquet(*paths).withColumn("_new", F.lit(0))
            new = spark.read.schema(change.rows.schema).parquet(*[r.path for r in fresh.select("path").collect()]).withColumn("_new", F.lit(1))
            fresh = stage(last_of(old.unionByName(new), change.keys, "_new").drop("_new"), root, table, change.by)
        kept = own.join(F.broadcast(met.select("path")), "path", "left_anti").select(*own.columns)
        files = kept.unionByName(fresh) if files is None else files.unionByName(kept).unionByName(fresh)
    rest = held.where(~F.col("table").isin(list(changes)))
    return commit(spark, root, base, rest.unionByName(files) if files is not None else rest)


def read(spark: SparkSession, root: str, table: str, schema, version: int | None = None, low: str | None = None, high: str | None = None, keys: Sequence[str] = (), order: str = "", by: str = "") -> DataFrame:
    """A table's rows, of a range of its column if one is given.

    Of a table that batches are appended to, give ``keys`` and ``order``: the
    last row of each key is taken, of the latest batch first.  Only files whose
    ranges meet those of another batch are put together for that; the others
    are read as they are.
    """
    files = entries(spark, root, version).where(F.col("table") == table)
    if low is not None or high is not None:
        files = overlapping(files, spark.createDataFrame([(low, high)], "low string, high string"))
    found = sorted(files.collect(), key=lambda r: (r.low or "", r.high or ""))
    groups: list[list] = []
    top = ""
    for r in found:  # ranges that meet, one after the other
        if groups and r.low is not None and r.low > top:
            groups.append([r])
        elif groups:
            groups[-1].append(r)
        else:
            groups.append([r])
        top = max(top, r.high or "￿") if len(groups[-1]) > 1 else r.high or "￿"
    alone = [r.path for g in groups if not keys or len({r.batch for r in g}) == 1 for r in g]
    mixed = [r for g in groups if keys and len({r.batch for r in g}) > 1 for r in g]
    out = spark.read.schema(schema).parquet(*alone) if alone else spark.createDataFrame([], schema)
    if mixed:
        parts = None
        for batch in sorted({r.batch for r in mixed}):
            part = spark.read.schema(schema).parquet(*[r.path for r in mixed if r.batch == batch]).withColumn("_batch", F.lit(batch))
            parts = part if parts is None else parts.unionByName(part)
        out = out.unionByName(last_of(parts, keys, "_batch", order).drop("_batch"))
    if by and low is not None:
        out = out.where(F.col(by) >= F.lit(low).cast(out.schema[by].dataType))
    if by and high is not None:
        out = out.where(F.col(by) <= F.lit(high).cast(out.schema[by].dataType))
    return out
