"""Operator 1, URL filters: a Bloom filter cascade with longest-match rules.

The cascade holds a list of keys exactly over a known universe of keys: level 1
is a Bloom filter of the listed keys, level 2 one of the unlisted keys that
level 1 lets through, level 3 one of the listed keys that level 2 lets through,
and so on until a level lets nothing through.  Every key of the universe is
then answered exactly by walking the levels, so that rows need no join with
the list.

The universe is dealt to shards by hash, each with a cascade of its own, so no
task ever holds more than one shard's keys.  Cascades of up to
``BROADCAST_BYTES`` together are broadcast.  Larger ones are never on one
machine as a whole: rows are dealt by shard, each task reads the levels of a
shard before the shard's rows, and holds those of one shard at a time.  A
shard's rows are dealt to ``SALTS`` tasks, so one frequent url does not fall to
a single task.

Keys are told apart by two independent 64-bit hashes; a third one tells if
two keys of the universe share both, which is refused with an error.

Defined results: a null url or one without ``://`` has the empty host and
path; it fits no rule, and the key of such rows is the empty string.  An empty
list allows all keys; listed keys that no row has, and null keys, do not
matter; an empty table gives no rows.  Repeated rows are judged each on its
own, very long urls whole.  Extra columns do not matter, only the named ones
are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
KEYS_PER_SHARD = 4096
MIN_SHARDS = 64
MAX_LEVELS = 64
BROADCAST_BYTES = 32 << 20
SALTS = 16


class Rule(NamedTuple):
    """``verdict`` for the host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), upper, upper.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, k: int, m: int) -> np.ndarray:
    """Bit numbers of each key in the filter of a level: k rows of len(h1)."""
    steps = (np.arange(k, dtype=np.uint64) + np.uint64(level * 37 + 1))[:, None]
    z = h1[None, :] + steps * (h2[None, :] | np.uint64(1))
    z ^= z >> np.uint64(33)
    z *= np.uint64(0xFF51AFD7ED558CCD)
    z ^= z >> np.uint64(33)
    return z % np.uint64(m)


def _holds(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int, k: int, m: int) -> np.ndarray:
    at = _positions(h1, h2, level, k, m)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def cascade_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray, first_rate: float) -> list[tuple[int, int, bytes]]:
    """The levels (k, m, bits) of the cascade of one shard's keys."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, int, bytes]] = []
    while len(inside):
        if len(levels) >= MAX_LEVELS:
            raise ValueError("the levels do not come to an end")
        rate = first_rate if not levels else 0.5
        k = max(1, round(-np.log2(rate)))
        m = max(8, int(np.ceil(len(inside) * k / np.log(2) / 8)) * 8)
        bits = np.zeros(m // 8, np.uint8)
        at = _positions(h1[inside], h2[inside], len(levels), k, m).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        passed = _holds(bits, h1[outside], h2[outside], len(levels), k, m)
        levels.append((k, m, bits.tobytes()))
        inside, outside = outside[passed], inside
    return levels


def cascade_answer(levels: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the parity of the first level that rejects it."""
    listed = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for number, (k, m, bits) in enumerate(levels):
        passed = _holds(bits, h1[left], h2[left], number, k, m)
        listed[left[~passed]] = number % 2 == 1
        left = left[passed]
    listed[left] = len(levels) % 2 == 1
    return listed


def key_hashes(key: Column) -> tuple[Column, Column, Column]:
    """Independent hashes; Spark seeds the hash of a later value by that of the ones before it."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key), F.xxhash64(F.lit("third"), key)


def build_cascade(universe: DataFrame, listed: Column | DataFrame, shards: int, first_rate: float = 2**-4) -> DataFrame:
    """Cascades of all shards: rows (shard, level, k, m, bits), on shared storage.

    ``universe`` has the column key.  ``listed`` is an expression over its
    columns, or a table with the column key.  Repeated keys are folded first,
    listed if any of the rows is.
    """
    names = [h.alias(f"h{i}") for i, h in enumerate(key_hashes(F.col("key")), 1)]
    if isinstance(listed, DataFrame):
        marked = universe.select(*names, F.lit(False).alias("listed"), F.lit(True).alias("present"))
        marked = marked.unionByName(listed.where(F.col("key").isNotNull()).select(*names, F.lit(True).alias("listed"), F.lit(False).alias("present")))
    else:
        marked = universe.select(*names, F.coalesce(listed, F.lit(False)).alias("listed"), F.lit(True).alias("present"))
    refused = F.raise_error(F.lit("two keys share both hashes")).cast("boolean")
    folded = F.when(F.min("h3") == F.max("h3"), F.max("listed")).otherwise(refused)
    keys = marked.groupBy("h1", "h2").agg(folded.alias("listed"), F.max("present").alias("present")).where("present")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = cascade_levels(
            pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64).view(np.uint64), pdf["listed"].to_numpy(bool), first_rate
        )
        return pd.DataFrame(
            [(int(pdf["shard"].iloc[0]), i, k, m, b) for i, (k, m, b) in enumerate(made)], columns=["shard", "level", "k", "m", "bits"]
        )

    dealt = keys.select("h1", "h2", "listed", F.pmod("h1", F.lit(shards)).cast("int").alias("shard"))
    return materialise(dealt.groupBy("shard").applyInPandas(build, "shard int, level int, k int, m long, bits binary"), "cascade")


def listed_by_cascade(df: DataFrame, key: Column, cascade: DataFrame, shards: int, out: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds the boolean column ``out``: whether the row's key is listed."""
    total = cascade.agg(F.coalesce(F.sum(F.octet_length("bits") + 64), F.lit(0))).first()[0]
    return (_by_broadcast if total <= broadcast_bytes else _by_shard)(df, key, cascade, shards, out)


def _by_broadcast(df: DataFrame, key: Column, cascade: DataFrame, shards: int, out: str) -> DataFrame:
    """Cascades of at most BROADCAST_BYTES together: no shuffle of the rows."""
    held: dict[int, list] = {}
    for row in cascade.orderBy("shard", "level").toLocalIterator():
        held.setdefault(row.shard, []).append((row.k, row.m, bytes(row.bits)))
    sent = df.sparkSession.sparkContext.broadcast(held)
    h1, h2, _ = key_hashes(key)

    @F.pandas_udf("boolean")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ready = {s: [(k, m, np.frombuffer(b, np.uint8)) for k, m, b in levels] for s, levels in sent.value.items()}
        for a, b in batches:
            signed = a.to_numpy(np.int64)
            x, y = signed.view(np.uint64), b.to_numpy(np.int64).view(np.uint64)
            numbers = signed % shards
            order = np.argsort(numbers, kind="stable")
            answer = np.zeros(len(x), bool)
            starts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
            for rows in np.split(order, starts[1:]) if len(order) else []:
                if levels := ready.get(int(numbers[rows[0]])):
                    answer[rows] = cascade_answer(levels, x[rows], y[rows])
            yield pd.Series(answer)

    return df.withColumn(out, ask(h1, h2))


def _by_shard(df: DataFrame, key: Column, cascade: DataFrame, shards: int, out: str) -> DataFrame:
    """Cascades of any size: rows and levels are dealt by shard, the levels of a shard before its rows."""
    h1, h2, _ = key_hashes(key)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    shard = F.pmod(h1, F.lit(shards)).cast("int")
    asked = df.select(shard.alias("shard"), F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int").alias("salt"), F.lit(-1).alias("level"), h1.alias("h1"), h2.alias("h2"), row.alias("row"))
    none = F.lit(None).cast(asked.schema["row"].dataType)
    levels = cascade.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("shard", "salt", "level", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), none.alias("row"), "k", "m", "bits")
    both = asked.withColumns({"k": F.lit(None).cast("int"), "m": F.lit(None).cast("long"), "bits": F.lit(None).cast("binary")}).unionByName(levels)
    order = F.when(F.col("level") >= 0, F.col("level")).otherwise(F.lit(MAX_LEVELS))
    dealt = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", order).select("shard", "level", "h1", "h2", "k", "m", "bits", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], -1
        for batch in batches:
            numbers, level = batch.column("shard").to_numpy(), batch.column("level").to_numpy()
            x, y = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            answer = np.zeros(batch.num_rows, bool)
            change = np.flatnonzero(np.diff(numbers * 2 + (level < 0), prepend=-9))
            for a, b in zip(change, [*change[1:], batch.num_rows], strict=True):
                if numbers[a] != of or level[a] == 0:
                    held, of = [], numbers[a]
                if level[a] >= 0:
                    held += [(batch.column("k")[i].as_py(), batch.column("m")[i].as_py(), np.frombuffer(batch.column("bits")[i].as_py(), np.uint8)) for i in range(a, b)]
                elif held:
                    answer[a:b] = cascade_answer(held, x[a:b], y[a:b])
            keep = pa.array(level < 0)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(keep), pa.array(answer).filter(keep)], names=["row", "answer"])

    schema = asked.select("row", F.lit(True).alias("answer")).schema
    return dealt.mapInArrow(run, schema).select("row.*", F.col("answer").alias(out))


def parsed_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host and path of every url."""
    return pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], listed: Column | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every url: the longest rule's verdict, else block if its key is listed.

    The key is host and path; ``listed`` is a table of keys (column key), or
    an expression over host and path that marks the keys of the list among
    all keys of the corpus.  Returns id, host, path, rule, verdict, listed.
    """
    parsed = parsed_urls(pages, id_col, url_col)
    key = F.concat("host", "path")
    shards = max(MIN_SHARDS, -(-pages.count() // KEYS_PER_SHARD))
    cascade = build_cascade(parsed.withColumn("key", key), listed, shards)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    answered = listed_by_cascade(parsed, key, cascade, shards, "listed")
    return answered.select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed"
    )
