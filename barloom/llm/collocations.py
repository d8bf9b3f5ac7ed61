"""Operator 11, phrase collocations by weighted acyclic automata.

Texts are stored once as shards (some millions of words of one task) of word
numbers.  A shard's n-grams are counted and sorted, and a count transducer is
built from them incrementally: states are frozen as soon as the sorted
order has left them, and equal ones are shared.  Its labels are words, and the
final weight of the state that a phrase leads to is the phrase's count.
Transducers are cut by prefix range (of the hashed order of the first two words,
so that what follows one hot word is spread), and those of a range are united
with their weights summed.

Words and pairs are counted first, then longer phrases of frequent pairs, as no
part of a phrase is rarer than the phrase.  (Leaving out pairs of rare words as
well would only help small corpora: of a large one nearly all words are
frequent.)  The frequent pairs are told to the second pass by a bit sieve of
bounded size; a false hit in it is counted like any phrase and drops out by its
exact count, so the sieve's size sets the work and never the result.

Parts of candidates are looked up by composing the acceptor of all parts in a
prefix range with the range's counts.  Scores are whole-number quotients of
38-digit decimals.

Defined results: a null language is ``und``; null and empty texts have no words.
Very long texts are read whole, piece by piece.  Repeated rows count each time,
null ids too.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bit_sieve, bound_batches, dealt, keyed_join, materialise, sifted, slices, text_or_empty

MOST_WORDS = 5
#: All signs that end a piece become this one.
BREAK = b"."
SIGNS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
#: Texts are split in chunks of about so many bytes, and counted in shards of so many words.
CHUNK, SHARD_WORDS = 4 << 20, 6_000_000
#: Words counted, or phrases looked up, in a prefix range.
RANGE_WORDS, RANGE_PHRASES = 4_000_000, 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def small(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def large(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


@dataclass
class Transducer:
    """An acyclic automaton over words: the last state is the root; a phrase's count is its state's final weight."""

    words: list[bytes]
    finals: np.ndarray
    ends: np.ndarray
    labels: np.ndarray
    targets: np.ndarray

    @staticmethod
    def build(words: list[bytes], keys: np.ndarray, counts: np.ndarray) -> Transducer:
        """Of distinct phrases in ascending order: rows of word numbers, -1 after the last one; numbers follow ``words``."""
        n, wide = keys.shape
        same, shared = np.ones(max(0, n - 1), bool), np.zeros(n, np.int64)
        for d in range(wide):
            same &= (keys[1:, d] == keys[:-1, d]) & (keys[1:, d] >= 0)
            shared[1:] += same
        register: dict[tuple, int] = {}
        arcs: list[list[int]] = [[] for _ in range(wide + 1)]
        weights, path = [0] * (wide + 1), []

        def freeze(depth: int) -> None:
            for d in range(len(path), depth, -1):
                state = register.setdefault((weights[d], *arcs[d]), len(register))
                arcs[d - 1] += (path[d - 1], state)
                arcs[d], weights[d] = [], 0

        for key, size, depth, count in zip(keys.tolist(), (keys >= 0).sum(axis=1).tolist(), shared.tolist(), counts.tolist(), strict=True):
            freeze(depth)
            path = key[:size]
            weights[size] = count
        freeze(0)
        states = [*register, (weights[0], *arcs[0])]  # the root has no arc to it, so it is no other state
        sizes = np.array([len(s) // 2 for s in states], np.int64)
        flat = np.fromiter(chain.from_iterable(s[1:] for s in states), np.int32, 2 * int(sizes.sum())).reshape(-1, 2)
        return Transducer(words, np.array([s[0] for s in states], np.int64), np.cumsum(sizes).astype(np.int32), flat[:, 0].copy(), flat[:, 1].copy())

    def pack(self) -> tuple[bytes, bytes]:
        """Words and arrays, compressed; labels of a state ascend and are close, so they go as differences."""
        head = np.array([len(self.finals), len(self.labels)], np.int64)
        arrays = (head, self.finals, np.diff(self.ends, prepend=np.int32(0)), np.diff(self.labels, prepend=np.int32(0)), self.targets)
        return small(b"\n".join(self.words)), small(b"".join(x.tobytes() for x in arrays))

    @staticmethod
    def unpack(words: bytes, raw: bytes) -> Transducer:
        words, raw = large(words), large(raw)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        at, parts = 16, []
        for kind, k in ((np.int64, n), (np.int32, n), (np.int32, m), (np.int32, m)):
            parts.append(np.frombuffer(raw, kind, k, at))
            at += parts[-1].nbytes
        finals, ends, labels, targets = parts
        return Transducer(words.split(b"\n"), finals, np.cumsum(ends, dtype=np.int32), np.cumsum(labels, dtype=np.int32), targets)

    def steps(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs out of ``states``: which of them each leaves, and the arc."""
        ends = self.ends[states].astype(np.int64)
        starts = np.where(states > 0, self.ends[states - 1], 0).astype(np.int64)
        sizes = ends - starts
        origin = np.repeat(np.arange(len(states)), sizes)
        return origin, np.arange(len(origin)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)

    def entries(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases (rows of word numbers) and counts, by length, each in order."""
        states, paths = np.array([len(self.finals) - 1]), np.zeros((1, 0), np.int32)
        while len(states):
            if paths.shape[1]:
                hit = self.finals[states] > 0
                yield paths[hit], self.finals[states[hit]]
            origin, arc = self.steps(states)
            paths, states = np.hstack([paths[origin], self.labels[arc, None]]), self.targets[arc].astype(np.int64)

    def compose(self, asked: Transducer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The asked phrases (in ``asked``'s word numbers) that this one has, with its counts, by length."""
        number = {w: i for i, w in enumerate(self.words)}
        own = np.array([number.get(w, -1) for w in asked.words], np.int64)
        sources = np.repeat(np.arange(len(self.finals)), np.diff(self.ends, prepend=0))
        wide = len(self.words) + 1
        arcs = sources * wide + self.labels  # ascending: by state, and labels of a state ascend
        one, two, paths = np.array([len(self.finals) - 1]), np.array([len(asked.finals) - 1]), np.zeros((1, 0), np.int32)
        while len(one) and len(arcs):
            if paths.shape[1]:
                hit = (self.finals[one] > 0) & (asked.finals[two] > 0)
                yield paths[hit], self.finals[one[hit]]
            origin, arc = asked.steps(two)
            label = own[asked.labels[arc]]
            key = one[origin] * wide + label
            at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            both = (label >= 0) & (arcs[at] == key)
            paths = np.hstack([paths[origin[both]], asked.labels[arc[both], None]])
            one, two = self.targets[at[both]].astype(np.int64), asked.targets[arc[both]].astype(np.int64)

    @staticmethod
    def union(parts: list[Transducer]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
        """All words, and by length the phrases with the sums of their weights, each in order."""
        words = sorted(set(chain.from_iterable(p.words for p in parts)))
        number = {w: i for i, w in enumerate(words)}
        by: dict[int, list] = defaultdict(list)
        for p in parts:
            own = np.array([number[w] for w in p.words], np.int32)
            for keys, counts in p.entries():
                by[keys.shape[1]].append((own[keys], counts))
        out = []
        for _, some in sorted(by.items()):
            keys, counts = np.vstack([k for k, _ in some]), np.concatenate([c for _, c in some])
            if len(keys):
                order = np.lexsort(keys.T[::-1])
                keys = keys[order]
                starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
                out.append((keys[starts], np.add.reduceat(counts[order], starts)))
        return words, out


def padded(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of several lengths as rows of one width."""
    wide = max((k.shape[1] for k, _ in some), default=0)
    keys = [np.pad(k, ((0, 0), (0, wide - k.shape[1])), constant_values=-1) for k, _ in some]
    return (np.vstack(keys), np.concatenate([c for _, c in some])) if some else (np.zeros((0, 0), np.int32), np.zeros(0, np.int64))


def tokens(raw: bytes) -> Iterator[list[bytes]]:
    """Words of texts end to end, and BREAK between pieces, chunk by chunk; chunks end at the end of a piece."""
    raw = raw.lower().translate(SIGNS)
    at = 0
    while at < len(raw):
        until = len(raw)
        if until - at > CHUNK:
            until = raw.rfind(BREAK, at, at + CHUNK) + 1 or raw.find(BREAK, at + CHUNK) + 1 or len(raw)
        yield raw[at:until].replace(BREAK, b" . ").split()
        at = until


def hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def mixed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    x = (one * MIX) ^ (two + (one >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def sieve_of(pairs: DataFrame, n: int) -> np.ndarray:
    """The bit sieve of ``n`` frequent pairs (phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [p.split(b" ") for p in batch.column("phrase").to_pylist()]
            h = mixed(hashes([s[0] for s in split]), hashes([s[1] for s in split]))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return bit_sieve(pairs.mapInArrow(run, "h long"), n)


def grams(ids: np.ndarray, starts: np.ndarray, length: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of one length at ``starts``, in order, and their counts; ids are below ``wide``."""
    if length == 1:
        counts = np.bincount(ids[starts], minlength=wide)
        found = np.flatnonzero(counts)
        return found[:, None].astype(np.int32), counts[found]
    code, size, firsts = ids[starts].astype(np.int64), wide, wide**length >= 1 << 62
    for k in range(1, length):
        if size * wide >= 1 << 62:
            known, code = np.unique(code, return_inverse=True)
            size = len(known)
        code, size = code * wide + ids[starts + k], size * wide
    if firsts:
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        return ids[starts[first][:, None] + np.arange(length)].astype(np.int32), counts.astype(np.int64)
    code, counts = np.unique(code, return_counts=True)
    keys = np.empty((len(code), length), np.int32)
    for k in range(length - 1, -1, -1):
        code, keys[:, k] = np.divmod(code, wide)
    return keys, counts.astype(np.int64)


def shard(ids: np.ndarray, words: list[bytes], low: int, high: int, sieve: np.ndarray | None, ranges: int) -> Iterator[tuple[int, Transducer]]:
    """The transducers of a shard's phrases of ``low`` to ``high`` words, by prefix range; with a sieve, of its pairs only.

    Ids follow ``words``, which ascend; -1 is a break.
    """
    alive, h = ids >= 0, hashes(words)
    if sieve is not None:  # of pairs
        two = np.flatnonzero(alive[1:] & alive[:-1])
        two = two[sifted(mixed(h[ids[two]], h[ids[two + 1]]), sieve)]
        pair = np.zeros(len(ids), bool)
        pair[two] = True
    good, some = alive, []
    for length in range(1, high + 1):
        if length > 1:
            alive = alive[:-1] & (good[length - 1 :] if sieve is None else pair[length - 2 : len(ids) - 1])
        if length >= low:
            some.append(grams(ids, np.flatnonzero(alive), length, max(1, len(words))))
    keys, counts = padded(some)
    if not len(keys):
        return
    second = np.where(keys[:, 1] >= 0, h[keys[:, 1]], np.uint64(0))
    place = ((mixed(h[keys[:, 0]], second) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    if len(some) > 1:
        order = np.lexsort([*keys.T[::-1], place])
    else:  # phrases are in order already
        order = np.argsort(place, kind="stable")
    keys, counts, place = keys[order], counts[order], place[order]
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
    for a, b in pairwise(cuts):
        own = np.unique(keys[a:b])
        own = own[own >= 0]
        local = np.where(keys[a:b] >= 0, np.searchsorted(own, keys[a:b]), -1)
        yield int(place[a]), Transducer.build([words[i] for i in own.tolist()], local, counts[a:b])


def shards(rows: DataFrame) -> DataFrame:
    """(lang, words, ids): the texts in shards, each with its words in order and the words' numbers, -1 between pieces; on shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, defaultdict[bytes, int]] = {}
        held: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, ids in held.items():
                names = list(known[lang])  # BREAK is number 0
                order = sorted(range(1, len(names)), key=names.__getitem__)
                rank = np.full(len(names), -1, np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                words = small(b"\n".join([names[i] for i in order]))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([words], pa.binary()), pa.array([small(rank[np.concatenate(ids)].tobytes())], pa.binary())], names=["lang", "words", "ids"])
            known.clear()
            held.clear()
            pa.default_memory_pool().release_unused()

        size = 0
        for batch in batches:
            for some in slices(batch, "text", CHUNK):
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(some.column("lang").to_pylist(), some.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    for words in tokens(BREAK.join(own)):
                        if lang not in known:
                            known[lang] = defaultdict()
                            known[lang].default_factory = known[lang].__len__
                            _ = known[lang][BREAK]
                        ids = np.fromiter(map(known[lang].__getitem__, words), np.int32, len(words))
                        held.setdefault(lang, []).append(np.append(ids, np.int32(0)))
                        size += len(ids)
                        if size >= SHARD_WORDS:
                            yield from flush()
                            size = 0
        yield from flush()

    return materialise(rows.mapInArrow(run, "lang string, words binary, ids binary"), "shards")


def counted(texts: DataFrame, low: int, high: int, least: int, ranges: int, sieve: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, size, f): phrases of ``low`` to ``high`` words in ``shards`` that occur ``least`` times or more.

    A further row of each language and range, without a phrase, has the number of its words.  On shared storage.
    """
    told = texts.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, ids in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "ids")), strict=True):
                names = large(words).split(b"\n")
                if not names[0]:
                    continue  # a shard without words
                made = [(place, lang, *t.pack()) for place, t in shard(np.frombuffer(large(ids), np.int32), names, low, high, told.value, ranges)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["range", "lang", "words", "automaton"])
            pa.default_memory_pool().release_unused()

    def unite(table: pa.Table) -> pa.Table:
        parts = [Transducer.unpack(w, a) for w, a in zip(table.column("words").to_pylist(), table.column("automaton").to_pylist(), strict=True)]
        lang, out, total = table.column("lang")[0].as_py(), [], 0
        words, by = Transducer.union(parts)
        for keys, counts in by:
            total += int(counts.sum()) if keys.shape[1] == 1 else 0
            often = counts >= least
            out += [(b" ".join([words[i] for i in key]), len(key), f) for key, f in zip(keys[often].tolist(), counts[often].tolist(), strict=True)]
        out.append((None, low, total))
        phrase, size, f = zip(*out, strict=True)
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "phrase": pa.array(phrase, pa.binary()), "size": pa.array(size, pa.int32()), "f": pa.array(f, pa.int64())})

    blocks = texts.mapInArrow(run, "range int, lang string, words binary, automaton binary")
    return materialise(blocks.groupBy("range", "lang").applyInArrow(unite, "lang string, phrase binary, size int, f long"), "counts")


def looked_up(parts: DataFrame, counts: DataFrame, ranges: int) -> DataFrame:
    """(lang, part, f) of the asked parts (lang, part): their acceptor composed with the counts, by prefix range."""
    place = lambda c: F.pmod(F.xxhash64(F.substring_index(F.col(c).cast("string"), " ", 2)), F.lit(ranges)).cast("int")
    both = counts.select(place("phrase").alias("range"), "lang", "phrase", "f").unionByName(parts.select(place("part").alias("range"), "lang", F.col("part").alias("phrase"), F.lit(None).cast("long").alias("f")))

    def automaton(phrases: list[bytes], counts: np.ndarray) -> Transducer:
        split = [p.split(b" ") for p in phrases]
        words = sorted(set(chain.from_iterable(split)))
        number = {w: i for i, w in enumerate(words)}
        wide = max(map(len, split), default=0)
        keys = np.array([[number[w] for w in s] + [-1] * (wide - len(s)) for s in split], np.int32).reshape(len(split), wide)
        order = np.lexsort(keys.T[::-1]) if wide else np.zeros(0, np.int64)
        return Transducer.build(words, keys[order], counts[order])

    def run(table: pa.Table) -> pa.Table:
        asked = table.column("f").is_null()
        have, want = table.filter(pa.compute.invert(asked)), table.filter(asked)
        wanted = automaton(want.column("phrase").to_pylist(), np.ones(want.num_rows, np.int64))
        part, f = [], []
        for keys, counts in automaton(have.column("phrase").to_pylist(), have.column("f").to_numpy()).compose(wanted):
            part += [b" ".join([wanted.words[i] for i in key]) for key in keys.tolist()]
            f += counts.tolist()
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(f), pa.string()), "part": pa.array(part, pa.binary()), "f": pa.array(f, pa.int64())})

    return materialise(both.groupBy("range", "lang").applyInArrow(run, "lang string, part binary, f long"), "parts")


def phrase_counts(docs: DataFrame, least: int = 100, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``most_words`` words that occur ``least`` times or more (lang, phrase, size, f), and all words of each language (lang, n)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = shards(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text")))
    first = counted(rows, 1, 2, least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    totals = first.where("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = first.where("phrase IS NOT NULL")
    pairs = frequent.where("size = 2")
    n, occurrences = pairs.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    longer = counted(rows, 3, most_words, least, 1 + occurrences // RANGE_WORDS, sieve_of(pairs, n)).where("phrase IS NOT NULL")
    return frequent.unionByName(longer), totals


def collocations(docs: DataFrame, least: int = 100, first: int = 2000, inside: int = 100) -> DataFrame:
    """Each language's ``first`` phrases of 2 to 5 words by score: lang, rank, phrase, a, l, r, n, score.

    Phrases that stand in a longer candidate with ``inside`` hundredths of their count or more are left out.
    """
    counts, totals = phrase_counts(docs, least)
    words = F.split(F.col("phrase").cast("string"), " ")
    candidates = counts.where("size > 1").select("lang", F.col("phrase").cast("string").alias("phrase"), "size", F.col("f").alias("a"), words.alias("w"))
    joined = lambda a, n: f"array_join(slice(w, {a}, {n}), ' ')"

    subs = F.expr(f"flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> {joined('s', 'm')})))")
    longer = candidates.where("size > 2").select("lang", F.explode(subs).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(dealt(longer), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select("lang", "phrase", "a", "k", F.expr(joined("1", "k")).alias("head"), F.expr(joined("k + 1", "size - k")).alias("tail"))
    cuts = materialise(cuts, "cuts")
    parts = cuts.select("lang", F.explode(F.array("head", "tail")).alias("part")).distinct().withColumn("part", F.col("part").cast("binary"))
    found = looked_up(parts, counts, 1 + counts.count() // RANGE_PHRASES).withColumn("part", F.col("part").cast("string"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = keyed_join(cuts, found.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side], "phrase")
    cuts = cuts.join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")), "under": wide("l") * wide("r")}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x")).select("lang", "phrase", "x.*")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^ \t]+') AS w FROM d),
    o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
    g AS (SELECT lang, list_slice(w, i, i + m - 1) AS g, count(*) AS f FROM o, range(1, 6) r(m) WHERE i + m - 1 <= len(w) GROUP BY 1, 2 HAVING max(m) = 1 OR count(*) >= 100),
    n AS (SELECT lang, sum(f) AS n FROM g WHERE len(g) = 1 GROUP BY 1),
    c AS (SELECT lang, array_to_string(g, ' ') AS phrase, g, f AS a, len(g) AS m FROM g WHERE len(g) > 1),
    s AS (SELECT lang, array_to_string(list_slice(g, i, i + k - 1), ' ') AS phrase, max(a) AS longer FROM c, range(1, 5) r(i), range(2, 5) q(k) WHERE k < m AND i + k - 1 <= m GROUP BY 1, 2),
    e AS (SELECT c.* FROM c LEFT JOIN s USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
    f AS (SELECT lang, array_to_string(g, ' ') AS part, f FROM g),
    x AS (SELECT e.lang, e.phrase, e.a, l.f AS l, r.f AS r, n.n, k, (1000 * CAST(e.a AS HUGEINT) * CAST(n.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
        FROM e JOIN range(1, 5) q(k) ON k < m JOIN n USING (lang) JOIN f l ON l.lang = e.lang AND l.part = array_to_string(list_slice(g, 1, k), ' ') JOIN f r ON r.lang = e.lang AND r.part = array_to_string(list_slice(g, k + 1, m), ' ')),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM x),
    t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE first = 1)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000"""
