"""Operator 2, exact top-k search over a bit-sliced index.

Vectors are quantised to integers and stored in blocks of rows.  In a block
each dimension, shifted to be non-negative, is cut into bit slices: one bitmap
over the rows per bit.  A query adds the slices of all dimensions, weighted by
its own integers, with carry-save bitmap arithmetic; negative weights use the
complement of a slice.  The sum is again bit-sliced, and the top rows are
selected from the most significant slice downward; rows that tie at the
boundary are taken by the smallest id.

Queries are a stated set (``is_query``).  A block stays in its task, and the
queries, which are small, stream past it; each meeting returns at most k rows
per query, and a window over these picks the final k.  Where there are fewer
blocks than tasks could run, each is held by several that share the queries,
so the index is never copied more often than that.  Nothing is broadcast or
collected.

Defined results: vectors that are null or hold a null, a NaN or an infinity take
no part, nor do rows whose id is null.  A vector whose scores might not fit a
long (scaled squares that add up to 2**62 or more) is refused with an error.  Shorter vectors count as padded with
zeros, so an empty vector scores 0 with all.  A repeated row is a candidate of
its own: only the query's own row is left out.  Further columns are not read,
whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Half of what a long holds; no score is larger than the largest sum of squares.
MOST_SQUARES = float(1 << 62)
#: A block's integers, 8 bytes each, take at most this (one row at least).
BLOCK_BYTES = 32 << 20
INDEX = "block int, n int, dims int, ids binary, low array<bigint>, bits array<int>, slices binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): valid rows with v = floor(scale * x), x as double."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(float(scale)) * x.cast("double"), 2))
    message = F.concat(F.lit("scores of vector "), F.col(id_col).cast("string"), F.lit(" may not fit a long"))
    ints = F.when(squares < MOST_SQUARES, whole).otherwise(F.raise_error(message).cast("array<bigint>"))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _words(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the first row of data in the lowest bit."""
    width = -(-flags.shape[-1] // 64) * 64
    padded = np.zeros((*flags.shape[:-1], width), np.uint8)
    padded[..., : flags.shape[-1]] = flags
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def slice_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of rows as bit slices; rows lie in ascending order of id."""
    pdf = pdf.sort_values(["vec_id", "pos"], kind="stable")
    m = _matrix(pdf["v"])
    low = m.min(axis=0)
    m -= low
    bits = [int(x).bit_length() for x in m.max(axis=0)]
    planes = [_words(((m[:, d] >> b) & 1).astype(bool)) for d in range(m.shape[1]) for b in range(bits[d])]
    return pd.DataFrame(
        {
            "block": [int(pdf["block"].iloc[0])], "n": [len(pdf)], "dims": [m.shape[1]], "ids": [pdf[["vec_id", "pos"]].to_numpy(np.int64).tobytes()],
            "low": [low.tolist()], "bits": [bits], "slices": [b"".join(p.tobytes() for p in planes)],
        }
    )


def add_slices(planes: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Sum of bitmaps by carry-save addition.

    planes: for each power of two the bitmaps that count with it.  Returns one
    bitmap for each bit of the sum, lowest first.
    """
    waiting = defaultdict(list, {p: [x] for p, x in planes.items() if len(x)})
    out, p = [], 0
    while waiting:
        if p not in waiting:
            out.append(None)
            p += 1
            continue
        x = np.concatenate(waiting.pop(p)) if len(waiting[p]) > 1 else waiting.pop(p)[0]
        while len(x) > 2:
            n = len(x) // 3
            a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
            half = a ^ b
            waiting[p + 1].append((a & b) | (half & c))
            half ^= c
            x = np.concatenate([half, x[3 * n :]]) if len(x) > 3 * n else half
        if len(x) == 2:
            waiting[p + 1].append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        out.append(x[0])
        p += 1
    width = next(x for x in out if x is not None).shape if out else (0,)
    return [np.zeros(width, np.uint64) if x is None else x for x in out]


def top_rows(sums: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest sums among the marked rows, ties to the lower position."""
    sure, open_ = np.zeros_like(among), among.copy()
    if int(np.bitwise_count(among).sum()) > k:
        for s in reversed(sums):
            with_bit = open_ & s
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(with_bit).sum())
            if n > k:
                open_ = with_bit
            else:
                sure = sure | with_bit
                open_ = open_ & ~s
                if n == k:
                    open_ = np.zeros_like(open_)
                    break
    positions = lambda w: np.flatnonzero(np.unpackbits(w.view(np.uint8), bitorder="little"))
    chosen = positions(sure)
    return np.concatenate([chosen, positions(open_)[: max(0, k - len(chosen))]])


class Block:
    """The slices of one block, ready for queries."""

    def __init__(self, n: int, low: list[int], bits: list[int], slices: bytes):
        width = -(-n // 64)
        self.low, self.bits = np.array(low, np.int64), np.array(bits, np.int64)
        straight = np.frombuffer(slices, np.uint64).reshape(-1, width)
        self.count = len(straight)
        self.planes = np.concatenate([straight, ~straight])  # complements serve negative weights
        self.first = np.concatenate([[0], np.cumsum(self.bits)]).astype(np.int64)
        self.rows = _words(np.ones(n, bool))

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the best k rows; own: position to leave out, or -1."""
        dims = min(len(query), len(self.low))
        base, wanted = int(query[:dims] @ self.low[:dims]), defaultdict(list)
        for d in np.flatnonzero((query[:dims] != 0) & (self.bits[:dims] > 0)):
            weight, at = int(query[d]), int(self.first[d])
            if weight < 0:
                base += weight * ((1 << int(self.bits[d])) - 1)
                weight, at = -weight, at + self.count
            for j in range(weight.bit_length()):
                if weight >> j & 1:
                    for b in range(int(self.bits[d])):
                        wanted[j + b].append(at + b)
        sums = add_slices({p: self.planes[rows] for p, rows in wanted.items()})
        among = self.rows
        if own >= 0:
            among = among.copy()
            among[own >> 6] &= ~np.uint64(1 << (own & 63))
        at = top_rows(sums, among, k)
        # the score fits a long, so base and slices may wrap around
        scores = np.full(len(at), (base + (1 << 63)) % (1 << 64) - (1 << 63), np.int64)
        for p, s in enumerate(sums[:64]):
            scores += ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << p
        return at, scores


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, v) with a number of their own, on shared storage."""
    return materialise(rows.withColumn("pos", F.monotonically_increasing_id()), "bsi-rows")


def build_index(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Bit-sliced blocks of all numbered rows, on shared storage, and how many there are at most."""
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // max(1, block_bytes // (8 * max(1, dims)))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "pos"), F.lit(blocks)).cast("int"))
    return materialise(dealt.groupBy("block").applyInPandas(slice_block, INDEX), "bsi"), blocks


FOUND = "query_id long, query_pos long, vec_id long, pos long, score long"


def searcher(k: int):
    """A function from rows that begin with a block and go on with queries to each query's best k of the block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ids = where = number = None
        for batch in batches:
            out = []
            is_block, numbers = batch.column("n").is_valid().to_pylist(), batch.column("block").to_pylist()
            for i, new in enumerate(is_block):
                if new:
                    number = numbers[i]
                    row = {c: batch.column(c)[i].as_py() for c in ("n", "low", "bits", "slices", "ids")}
                    block, ids = Block(row["n"], row["low"], row["bits"], row["slices"]), np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
                    where = {int(p): j for j, p in enumerate(ids[:, 1])}
                elif numbers[i] == number:  # a block that no row fell to is not there
                    pos = batch.column("query_pos")[i].as_py()
                    at, scores = block.search(np.array(batch.column("v")[i].as_py(), np.int64), where.get(pos, -1), k)
                    own = np.broadcast_to(np.array([batch.column("query_id")[i].as_py(), pos], np.int64), (len(at), 2))
                    out.append(np.concatenate([own, ids[at], scores[:, None]], axis=1))
            made = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in made.T], names=["query_id", "query_pos", "vec_id", "pos", "score"])

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each query's k highest inner products: query_id, rank, vec_id, score.

    ``is_query`` is an expression over vec_id.
    """
    rows = numbered_rows(quantised(vectors, id_col, vector_col, scale))
    index, blocks = build_index(rows, block_bytes)
    lanes = max(1, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // blocks))
    lane = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    held = index.withColumn("lane", lane(lanes)).withColumns({"query_id": none("long"), "query_pos": none("long"), "v": none("array<bigint>")})
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("pos").alias("query_pos"), "v", lane(blocks).alias("block"), F.pmod(F.xxhash64("pos"), F.lit(lanes)).cast("int").alias("lane"))
    asked = asked.withColumns({f.name: none(f.dataType) for f in index.schema if f.name != "block"})
    columns = ["block", "lane", "n", "low", "bits", "slices", "ids", "query_id", "query_pos", "v"]
    met = held.select(*columns).unionByName(asked.select(*columns)).repartition(blocks * lanes, "block", "lane")
    ready = met.sortWithinPartitions("block", "lane", F.col("n").isNull())
    found = ready.mapInArrow(searcher(k), FOUND)
    best = Window.partitionBy("query_id", "query_pos").orderBy(F.desc("score"), "vec_id", "pos")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
