"""Operator 6, SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has a bit set where over half of its shingles' 64-bit
hashes have it.  Fingerprints that differ in at most three bits are linked.
A fingerprint is cut into two halves, so that of two linked ones at least one
half differs in at most one bit.  Each half is indexed under its 32 variants
with one bit left out; fingerprints that meet under a variant are compared in
full.

Equal fingerprints are folded first.  A bucket (one variant) of up to
``BUCKET`` fingerprints is searched in one task; a larger one is cut by the
bits that its members may still differ in: with at most three differing bits,
one of four pieces is equal, so members meet again under each piece.  Four
such cuts leave at most 2**12 fingerprints in any bucket, without leaving out
any pair.  A bucket gives links that connect what is connected in it (at most
one link fewer than members), never all pairs, and connected components follow
by alternating large-star and small-star steps on shared storage.

Defined results: a null or wordless text has the fingerprint zero and is linked
like any other; very long texts are read whole.  Repeated rows each get a row.
Null ids are never chosen as a component's id unless the component has no
other.  Other columns are not read, whatever their names; ``keep_one`` returns
them all.  An empty table gives no rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, SALTS, Scratch, bit_sieve, bound_batches, dealt, fresh_path, materialise, release, remove, salted_join, sifted, slices, spare_name, stored, text_or_empty

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
BUCKET = 2048
CUTS = 4
#: Words of a shingle by which near copies are found.
NEAR_WORDS = 5
#: About so many sets under one shingle are compared with all first; then, of up to SMALL all, of more about PIVOTS.
FIRST, SMALL, PIVOTS = 2, 40, 8
#: Bytes of a set's sketch, counts of its shingles by their lowest byte.
SKETCH = 256
#: Parities of a set's shingles by the bits above the lowest byte, in longs that go with its rows to where pairs meet.
PARITIES = 512
PARITY = [f"parity{i}" for i in range(PARITIES // 64)]
#: Links of near copies up to so many are united in one task, more by star steps.
ONE_TASK = BROADCAST_ROWS
#: Size classes grow by this factor; the sizes of similar sets lie 1.25 apart at most, which is so many classes.
STEP, STEPS = 1.03, 8
#: Wider classes of sizes, a little over 1.25 apart, so that those of similar sets are neighbours at most.
WIDE = 1.26
#: Of groups by what sets must share, those of up to so many are compared at once, larger ones in rounds of so many times more turns.
AT_ONCE, MORE = 256, 64
#: Texts read, and shingles kept, to put common shingles last.
SAMPLE_TEXTS = 20_000
MOST_COMMON = 20_000
#: Texts of about so many bytes are worked on at once.
SLICE_BYTES = 4 << 20
LOW_HALF = 0xFFFFFFFF
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(raw: bytes, size: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a UTF-8 text; bytes.lower and bytes.split touch ASCII only."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(text, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes; of none, none."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS_OF_BYTE for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, on shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                made = np.array([fingerprint(t or b"", size) for t in some.column("text").cast(pa.large_binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialise(rows.mapInArrow(run, "doc_id long, fp long"), "simhash")


def connect(members: np.ndarray) -> list[tuple[int, int]]:
    """Links among distinct fingerprints that join exactly what is connected within MOST_BITS."""
    links, rest = [], members
    while len(rest) > 1:
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            x = open_.pop()
            near = np.bitwise_count(rest ^ x) <= MOST_BITS
            if near.any():
                found, rest = rest[near], rest[~near]
                links += [(x, y) for y in found]
                open_ += list(found)
    return links


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of buckets; rows come sorted by bucket, and a bucket may go on in the next batch."""
    left = None
    for pdf in batches:
        if left is not None:
            pdf = pd.concat([left, pdf])
        buckets = pdf["bucket"].to_numpy()
        cut = int(np.searchsorted(buckets, buckets[-1], side="left")) if len(pdf) else 0
        left, done = pdf.iloc[cut:], pdf.iloc[:cut]
        yield _links(done)
    if left is not None:
        yield _links(left)


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    buckets, fps = pdf["bucket"].to_numpy(), pdf["fp"].to_numpy(np.int64).view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(buckets)))
    twos = starts[sizes == 2]
    near = twos[np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= MOST_BITS]
    a, b = [fps[near]], [fps[near + 1]]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        if links := connect(fps[s : s + n]):
            pairs = np.array(links, np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    one, two = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    return pd.DataFrame({"a": np.maximum(one, two), "b": np.minimum(one, two)})


def _sized(rows: DataFrame, both_sides: bool) -> DataFrame:
    """Rows of buckets that can hold a link, with the bucket's size.

    Of a variant with bit j left out only pairs that differ in j matter,
    but for j = 0, which also serves equal halves.  Sizes are aggregated and
    joined (a join is dealt anew where one bucket is large; a window is not).
    """
    counts = [F.count("*").alias("size")]
    if both_sides:
        counts += [(F.max("side") - F.min("side")).alias("sides"), F.min("bit").alias("least")]
    sizes = rows.groupBy("bucket").agg(*counts).where(F.col("size") > 1)
    if both_sides:
        sizes = sizes.where((F.col("least") == 0) | (F.col("sides") > 0)).drop("sides", "least")
    return rows.join(dealt(sizes), "bucket")


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a > b) among distinct fingerprints (fp), enough to connect all that are connected; they read from ``scratch``."""
    variant = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("variant"))
    bit = F.col("variant") % 32
    half = F.when(F.col("variant") < 32, F.col("fp").bitwiseAND(F.lit(LOW_HALF))).otherwise(F.shiftrightunsigned("fp", 32))
    other = F.when(F.col("variant") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(LOW_HALF)))
    one = F.expr("shiftleft(1L, variant % 32)")
    kept = half.bitwiseAND(F.bitwise_not(one))
    bucket = F.expr("shiftleft(CAST(variant AS BIGINT), 32)").bitwiseOR(kept)
    start = variant.select("fp", bit.alias("bit"), bucket.alias("bucket"), F.when(half.bitwiseAND(one) != 0, 1).otherwise(0).alias("side"))
    met = scratch.keep(_sized(start, True).select("fp", "bucket", "size"))

    parts = [met.where(F.col("size") <= BUCKET).select("fp", "bucket")]
    big = met.where(F.col("size") > BUCKET)
    if not big.isEmpty():
        # the half that the bucket does not fix holds at most three differing bits
        low_fixed = F.shiftrightunsigned("bucket", 32) < 32
        free = F.when(low_fixed, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(LOW_HALF)))
        rows = big.select("fp", "bucket", free.alias("free"), F.lit(32).alias("width"))
        for number in range(1, CUTS + 1):
            piece = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(3))))
            size = "(width + 3 - piece) DIV 4"
            offset = "(piece * (width DIV 4) + least(piece, width % 4))"
            value = f"(shiftrightunsigned(free, CAST({offset} AS INT)) & (shiftleft(1L, CAST({size} AS INT)) - 1))"
            rest = f"(shiftleft(shiftrightunsigned(free, CAST({offset} + {size} AS INT)), CAST({offset} AS INT)) | (free & (shiftleft(1L, CAST({offset} AS INT)) - 1)))"
            cut = piece.select("fp", F.expr(f"xxhash64(bucket, piece, {value})").alias("bucket"), F.expr(rest).alias("free"), F.expr(f"CAST(width - {size} AS INT)").alias("width"))
            cut = scratch.keep(_sized(cut, False))
            last = number == CUTS
            parts.append((cut if last else cut.where(F.col("size") <= BUCKET)).select("fp", "bucket"))
            rows = cut.where(F.col("size") > BUCKET).drop("size")
            if last or rows.isEmpty():
                break
    found = None
    for part in parts:
        one_level = part.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_search, "a long, b long")
        found = one_level if found is None else found.unionByName(one_level)
    return found.distinct()


def star(edges: DataFrame) -> DataFrame:
    """The edges (a > b) after one large-star and one small-star step, which connect what was connected before.

    Every step replaces neighbours by a minimum found with a partial aggregate,
    and a hub's rows are dealt to several tasks.  Only minima that a neighbour
    is moved to are dealt: in large-star those of nodes with a greater
    neighbour, in small-star those of nodes with several smaller ones.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most")).where("most > a").select("a", F.least("a", "m").alias("m"))
    large = salted_join(both.where("b > a"), least, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"))
    small = salted_join(large, down.where("most > m").drop("most"), ["a"], "b")
    moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(down.select("a", F.col("m").alias("b"))).distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each linked node with the smallest of its component, but for the smallest, from all the edges (a, b) in one task."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            one, two = top(a), top(b)
            above[max(one, two)] = min(one, two)
    nodes = [x for x in above if top(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["a", "b"])


def united(edges: DataFrame) -> DataFrame | None:
    """The components of stored edges as edges (a, b) to their smallest nodes, or none where these are too many for one task."""
    return edges.repartition(1).mapInArrow(_united, "a long, b long") if edges.count() <= ONE_TASK else None


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, for nodes that are not the root.

    Alternates large-star and small-star steps until the edges stay the same.
    Only the last round's edges stay on shared storage (in ``scratch``, if one
    is given).
    """
    spark = edges.sparkSession
    fresh = scratch.fresh if scratch else lambda: fresh_path(spark, "edges")
    path = fresh()
    edges, before = stored(edges.select("a", "b"), path), None
    while True:
        last, path = path, fresh()
        edges = stored(star(edges), path)
        remove(spark, last)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = fingerprints(docs, size)
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    scratch = Scratch(docs.sparkSession, "variants")
    found = components(links(nodes.select("fp"), scratch))
    scratch.drop()
    labelled = nodes.join(dealt(found), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(salted_join(labelled, ids, ["root"], "fp").select("fp", "component_id"), "named")
    return salted_join(prints, named, ["fp"], "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(raw: bytes, size: int = NEAR_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; a shorter text is one shingle, a wordless one has none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    size = min(size, len(words))
    z = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        z = (z ^ hashes[k : len(words) - size + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
    return np.unique(z)


def prefix(shingles: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in one order for all texts, as many as two sets of similarity 0.8 must share one of.

    Shingles in ``hot`` (ascending) come last, by their ``rank``.
    """
    n = len(shingles)
    place = np.zeros(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        place = np.where(hot[at] == shingles, rank[at] + 1, 0)
    return shingles[np.argsort(place, kind="stable")][: n - (4 * n + 4) // 5 + 1 if n else 0]


def sketch(shingles: np.ndarray) -> bytes:
    """Counts of the shingles in SKETCH classes, up to 255: the counts of two sets differ by no more than the sets do."""
    return np.minimum(np.bincount((shingles % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the shingles in each of PARITIES classes are odd in number, as bits of signed longs: those of two sets differ in no more bits than the sets do."""
    at = (shingles >> np.uint64(8)) % np.uint64(PARITIES)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several texts of a sample, ascending, and their ranks, the most common last.

    They only set the order of shingles, so the sample changes the work and not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                made = [shingle_set(t or b"") for t in some.column("text").cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64))], names=["shingle"])

    share = max(1, rows.count() // SAMPLE_TEXTS)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text").mapInArrow(run, "shingle long")
    counts = some.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 3")
    found = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    hot = found.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], (len(hot) - np.arange(len(hot)))[order]


def _alike(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets have a similarity of 0.8 or more, by whole sets; by sketches those that may have it.

    Such sets of n and m shingles share 4/9 (n + m) or more, and so differ in
    (n + m) / 9 or fewer, as many as the counts in their sketches at least.
    """
    for batch in batches:
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
        one, two = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
        if whole:
            met = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(one, two, strict=True)]
            keep = np.array(met, np.int64) >= (4 * (n + m) + 8) // 9
        else:
            x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, SKETCH).astype(np.int16) for z in (one, two))
            keep = 9 * np.abs(x - y).sum(axis=1, dtype=np.int64) <= n + m
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])


def compared(pairs: DataFrame, sets: DataFrame, whole: bool, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that ``sets`` (key, n, shingles), whole ones or sketches, do not rule out; in ``scratch``."""
    of = lambda end: sets.select(F.col("key").alias(end), F.col("n").alias(f"n_{end}"), F.col("shingles").alias(f"set_{end}"))
    return scratch.keep(pairs.join(dealt(of("a")), "a").join(dealt(of("b")), "b").mapInArrow(lambda batches: _alike(batches, whole), "a long, b long"))


def whole_sets(wanted: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The whole sets (key, n, shingles) of some keys, dealt by key, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                made = [shingle_set(t or b"") for t in some.column("text").cast(pa.large_binary()).to_pylist()]
                own = pa.array([_name(x) == name for x, name in zip(made, some.column("name").to_pylist(), strict=True)], pa.bool_())  # an id may have several texts
                sizes = pa.array([len(x) for x in made], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column("key"), sizes, pa.array([x.tobytes() for x in made], pa.binary())], names=["key", "n", "shingles"]).filter(own)

    named = scratch.keep(nodes.join(dealt(wanted.distinct()), "key").select("key", "name", F.col("least").alias("doc_id")))
    return salted_join(rows, named, ["doc_id"], "text").select("key", "name", "text").mapInArrow(run, "key long, n int, shingles binary").dropDuplicates(["key"])


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of set keys that are similar, by the sets of their texts."""
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    return compared(pairs, whole_sets(ends, rows, nodes, scratch), True, scratch)


def _name(shingles: np.ndarray) -> bytes:
    """A set's name: 128 bits, so that other sets do not share it."""
    return xxhash.xxh3_128_digest(shingles.tobytes(), SEED)


def exploded(sets: DataFrame, sieve: np.ndarray | None = None) -> DataFrame:
    """A row per shingle of (key, n, shingles): its place and itself; with a sieve, of those that pass it."""
    told = sets.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "shingles", SLICE_BYTES):
                parts = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
                sizes = np.array([len(x) for x in parts], np.int64)
                of = np.repeat(np.arange(batch.num_rows), sizes)
                at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                every = np.concatenate([np.zeros(0, np.uint64), *parts])
                if told.value is not None:
                    good = np.flatnonzero(sifted(every, told.value))
                    of, at, every = of[good], at[good], every[good]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), batch.column("n").take(pa.array(of)), pa.array(at.astype(np.int32)), pa.array(every.view(np.int64))], names=["key", "n", "at", "shingle"])

    return sets.mapInArrow(run, "key long, n int, at int, shingle long")


def postings(spread: DataFrame) -> DataFrame:
    """Shingles that several sets have, with two hashes of these (one, two): shingles that share both are of the same sets."""
    h = F.xxhash64("key")
    return spread.groupBy("shingle").agg(F.bit_xor(h).alias("one"), F.min(h).alias("two")).where("one <> two")


def shared_rows(sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of (key, n, shingles): the shingles that several sets have (shingle, one, two), and the rows of all sets with them."""
    several = scratch.keep(postings(exploded(sets)))
    sieve = bit_sieve(several.select(F.col("shingle").alias("h")), several.count())
    return several, salted_join(exploded(sets, sieve), several, ["shingle"], "key")


def step(n: int) -> int:
    """The size class of a set; similar sets are ``STEPS`` classes apart at most."""
    i = int(np.log(max(1, n)) / np.log(STEP))
    while int(np.ceil(STEP**i)) > n:
        i -= 1
    while int(np.ceil(STEP ** (i + 1))) <= n:
        i += 1
    return i


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set and each pair of size classes that it can be in, what similar sets of these classes have in common.

    Two similar sets of n and m shingles share 4/9 (n + m) or more, so what
    weighs more than the larger one can miss is in both.
    """
    for batch in batches:
        out: list[tuple] = []
        for key, n, kinds in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "kinds")), strict=True):
            own = step(n)
            kinds = sorted((k["one"], k["two"], k["weight"]) for k in kinds)
            for low in range(own - STEPS, own + 1):
                for high in [own] if low < own else range(own, own + STEPS + 1):
                    least, most = max(1, int(np.ceil(STEP**low))), int(np.ceil(STEP ** (high + 1))) - 1
                    must = [k[:2] for k in kinds if 9 * k[2] > 5 * most - 4 * least]
                    role = 2 if low == high else int(own == high)
                    out.append((key, role, np.uint64(xxhash.xxh3_64_intdigest(repr((low, high, must)).encode())).astype(np.int64)))
        keys, roles, signs = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(roles, pa.int32()), pa.array(signs, pa.int64())], names=["key", "role", "sign"])


def refined(left: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of large groups in groups by what the sets must have in common beyond the shingle under which they met.

    Shingles that the same sets have (a passage's) are one kind, as heavy as
    they are many; a set is described by its kinds of over a tenth of it.
    """
    left = scratch.keep(left.select("key", "n", "at", "under").distinct())
    _, common = shared_rows(whole_sets(left.select("key"), rows, nodes, scratch), scratch)
    weights = common.groupBy("key", "n", "one", "two").agg(F.count("*").alias("weight")).where("10 * weight > n")
    described = weights.groupBy("key").agg(F.collect_list(F.struct("one", "two", "weight")).alias("kinds"))
    all_ = left.select("key", "n").distinct().join(dealt(described), "key", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<struct<one:bigint,two:bigint,weight:bigint>>")))
    signs = all_.mapInArrow(_signatures, "key long, role int, sign long")
    under = scratch.keep(left.join(dealt(signs), "key").withColumn("group", F.xxhash64("under", "sign")).drop("sign", "under"))
    sizes = under.groupBy("group").agg(F.count("*").alias("size"), F.min("role").alias("low"), F.max("role").alias("high")).where("size > 1 AND (high = 2 OR low < high)")
    return scratch.keep(salted_join(under, sizes.select("group", "size"), ["group"], "key"))


def by_size(groups: DataFrame) -> DataFrame:
    """The rows of groups in groups of two neighbouring classes of sizes, each as wide as the sizes of similar sets are apart.

    A set is the lower of the two in one group (role 2) and the upper in another
    (role 1); of the upper ones pairs are met in the other group.
    """
    wide = F.floor(F.log("n") / F.lit(float(np.log(WIDE)))).cast("int")
    split = groups.withColumn("at_size", F.explode(F.array(wide, wide - 1))).withColumn("role", F.when(F.col("at_size") == wide, 2).otherwise(1))
    split = split.withColumn("group", F.xxhash64("group", "at_size")).drop("at_size", "size")
    sizes = split.groupBy("group").agg(F.count("*").alias("size"), F.max("role").alias("high")).where("size > 1 AND high = 2").drop("high")
    return salted_join(split, sizes, ["group"], "key")


def meetings(groups: DataFrame, done: int, until: int, small: int = 0) -> DataFrame:
    """Pairs (a, b) that can be similar: in each group those of the sets whose turn it is with all whose turn comes later.

    A row of ``groups`` is a set (key, n, root) in a group, at a place of its
    order, in a role; a set's turn in a group of ``size`` is a hash below it.
    In groups of up to ``small`` it is every set's turn.  Where rows have their
    sets' parities, pairs whose parities differ in more bits than similar sets
    can do not leave the join.
    """
    rows = groups.withColumn("turn", F.pmod(F.xxhash64("key", "group"), F.col("size")))
    salts = F.when(F.col("size") > SMALL, SALTS).otherwise(1)  # the rows of a large group are dealt to several tasks
    now = rows.where((F.col("turn") >= done) & (F.col("turn") < until) | (F.col("size") <= small))
    one = now.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).alias("x")
    two = rows.withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int")).alias("y")
    x, y = lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")
    shared = 1 + F.least(x("n") - x("at") - 1, y("n") - y("at") - 1)
    able = (F.struct(x("turn"), x("key")) < F.struct(y("turn"), y("key"))) & (x("root") != y("root")) & (9 * shared >= 4 * (x("n") + y("n")))
    able = able & (5 * F.least(x("n"), y("n")) >= 4 * F.greatest(x("n"), y("n"))) & ((x("role") == 2) | (x("role") != y("role")))
    if apart := [F.bit_count(x(c).bitwiseXOR(y(c))) for c in PARITY if c in groups.columns]:
        able = able & (9 * reduce(operator.add, apart) <= x("n") + y("n"))
    pairs = one.join(dealt(two), (x("group") == y("group")) & (x("salt") == y("salt"))).where(able)
    return pairs.select(F.greatest(x("key"), y("key")).alias("a"), F.least(x("key"), y("key")).alias("b")).distinct()


def linked_prints(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets (key, fp) whose fingerprints are equal or linked, enough to connect all such."""
    folded = scratch.keep(prints.groupBy("fp").agg(F.min("key").alias("least")))
    variants = Scratch(prints.sparkSession, "variants")
    near = links(folded.select("fp"), variants)
    of = lambda end: folded.select(F.col("fp").alias(end), F.col("least").alias(f"key_{end}"))
    near = near.join(dealt(of("a")), "a").join(dealt(of("b")), "b").select(F.greatest("key_a", "key_b").alias("a"), F.least("key_a", "key_b").alias("b"))
    equal = salted_join(prints, folded, ["fp"], "key").where("key > least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    pairs = scratch.keep(near.unionByName(equal))
    variants.drop()
    release(prints.sparkSession)
    return pairs


def similar_documents(docs: DataFrame) -> DataFrame:
    """(node, root) over document ids: near copies with the smallest id of their group, for documents that are not it.

    Documents are linked where the sets of their five-word shingles have a
    Jaccard similarity of 0.8 or more.  In an order of all shingles, two such
    sets share one of their first n - ceil(0.8 n) + 1; they meet under it, and
    each pair that meets is compared in full unless its sizes or the places
    of the shingle rule it out.  Equal sets are folded first, and of shingles
    that the same sets have only the first is kept.

    The first pairs are those of linked fingerprints of the sets, found as in
    this operator (``linked_prints``), and under each shingle ``FIRST`` sets with
    all.  Where several components are left, of up to ``SMALL`` sets all are
    compared; larger groups are split ``by_size``, and of those still larger some
    ``PIVOTS`` are compared with all.  What stays unconnected even so (texts put
    together of the same passages) is grouped anew by all that similar sets must
    have in common, see ``refined``; where this leaves groups of over ``AT_ONCE``,
    ever more sets have their turn, with those that nothing links to them yet,
    until all have had it.  Pairs whose parities allow it leave the join, are
    compared by sketches, and what these let through by whole sets.  The links
    are kept as a forest: flat while they are ``ONE_TASK`` or fewer, else one that
    grows flatter by star steps.
    """
    scratch = Scratch(docs.sparkSession, "near")
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    hot, rank = common_shingles(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                sets = [shingle_set(t or b"") for t in some.column("text").cast(pa.large_binary()).to_pylist()]
                first = [prefix(x, hot, rank).tobytes() for x in sets]
                odd = np.array([parities(x) for x in sets], np.int64).reshape(-1, len(PARITY))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([_name(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array(first, pa.binary()), pa.array([sketch(x) for x in sets], pa.binary()), pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64)), *(pa.array(x) for x in odd.T)],
                    names=["doc_id", "name", "n", "shingles", "sketch", "fp", *PARITY],
                )

    at = scratch.fresh()
    made = stored(rows.mapInArrow(run, "doc_id long, name binary, n int, shingles binary, sketch binary, fp long, " + ", ".join(f"{c} long" for c in PARITY)), at)
    folded = made.groupBy("name").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "shingles", "sketch", "fp", *PARITY)), F.count("*").alias("copies"))
    prefixes = scratch.keep(folded.withColumn("key", F.monotonically_increasing_id()))
    made = scratch.keep(made.select("doc_id", "name"))
    remove(docs.sparkSession, at)
    nodes, sketches = prefixes.select("key", "name", "least"), prefixes.select("key", "n", F.col("sketch").alias("shingles"))

    _, common = shared_rows(prefixes.select("key", "n", "shingles"), scratch)
    # shingles of the same sets are one group, at the place of their first
    met = scratch.keep(common.groupBy("key", "n", F.xxhash64("one", "two").alias("group")).agg(F.min("at").alias("at")))
    sizes = met.groupBy("group").agg(F.count("*").alias("size"))
    met = scratch.keep(salted_join(met.join(dealt(prefixes.select("key", *PARITY)), "key"), sizes, ["group"], "key"))
    release(docs.sparkSession)

    forest = None

    def compare(pairs: DataFrame) -> None:
        """Adds the pairs that are similar to the forest, which is made flat, or flatter by one step, and kept small."""
        nonlocal forest
        found = verified(compared(scratch.keep(pairs), sketches, False, scratch), rows, nodes, scratch)
        edges = found if forest is None else forest.unionByName(found)
        forest = scratch.keep(star(edges) if (flat := united(edges)) is None else flat)
        release(docs.sparkSession)  # each round's shuffles would else stay until the driver happens to collect its garbage

    def unconnected(groups: DataFrame, most: int) -> DataFrame:
        """Rows of groups of over ``most`` sets that the forest shows more than one component of."""
        labels = forest.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("root"))
        left = groups.where(F.col("size") > most).drop("root").join(dealt(labels), "key", "left").withColumn("root", F.coalesce("root", "key"))
        several = left.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("group")
        return scratch.keep(salted_join(left, several, ["group"], "key"))

    groups = met.withColumns({"role": F.lit(2), "under": F.col("group"), "root": F.col("key")})
    compare(linked_prints(prefixes.select("key", "fp"), scratch).unionByName(meetings(groups, 0, FIRST)).distinct())
    groups = unconnected(groups, FIRST)
    small = groups.where(F.col("size") <= SMALL)
    groups = scratch.keep(small.unionByName(by_size(groups.where(F.col("size") > SMALL))))
    compare(meetings(groups, 0, PIVOTS, SMALL))
    groups = unconnected(groups, max(SMALL, PIVOTS))
    if not groups.isEmpty():
        roots = groups.select("key", "root", *PARITY).distinct()
        groups, done, until, small = refined(groups, rows, nodes, scratch).join(dealt(roots), "key"), 0, PIVOTS, AT_ONCE
        while True:
            compare(meetings(groups, done, until, small))
            groups = unconnected(groups, max(small, until))
            if groups.isEmpty():
                break
            done, until, small = until, until * MORE, 0

    ends = forest.join(dealt(nodes.select(F.col("key").alias("a"), F.col("least").alias("la"))), "a").join(dealt(nodes.select(F.col("key").alias("b"), F.col("least").alias("lb"))), "b")
    between = ends.where("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b"))
    repeated = prefixes.where("copies > 1").select("name", "least")
    equal = salted_join(made.select("doc_id", "name"), repeated, ["name"], "doc_id").where("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    edges = scratch.keep(between.unionByName(equal))
    flat = united(edges)
    out = components(edges.distinct()) if flat is None else materialise(flat.toDF("node", "root"), "copies")
    scratch.drop()
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, with its own columns.

    Of exact repetitions of an id all rows stay or go together; rows without an id stay.
    """
    name = spare_name(docs, "copy")
    copies = similar_documents(docs).select(F.col("node").alias(name))
    return docs.join(copies, F.col("doc_id").cast("long") == F.col(name), "left_anti")
