"""Operators 11 to 13 against brute force, and on odd input: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import collocations, prefix_trie, queries, sharding, shared

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def spread(spark):
    """Many small partitions, so that groups and paths cross their boundaries."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# 11


def phrases(docs):
    """All phrases of 1 to 5 words of (lang, text) rows, counted one by one."""
    out, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                out[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return out, totals


def brute_collocations(docs, least, first, inside=100):
    counts, totals = phrases(docs)
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered[p[i : i + m]], a)
        found = []
        for p, a in often.items():
            if p in covered and 100 * covered[p] >= inside * a:
                continue
            score, _, lr = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, (f[p[:k]], f[p[k:]])) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), *lr))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, n, p, a, left, right, totals[lang], score) for n, (score, a, p, left, right) in enumerate(found[:first], 1)]
    return sorted(out)


ODD_TEXTS = ["", None, " \t ", "one", "a b. a b, A B! a\tb", "ab cd " * 40 + "x", "É ñ É ñ ß 字 字", "x" * 9000, "a b c d e f g " * 60, "...", "a\x01b c a\x01b c\n" * 9, "\x1c a  b a  b"]


def test_collocations_against_brute_force(spark, spread):
    random.seed(5)
    made = [(i, " ".join(random.choice(["alpha", "beta", "gamma,", "delta.", "of", "of", "x"]) for _ in range(random.randint(0, 60))), random.choice(["en", "de", None, "und"])) for i in range(150)]
    made += [(i, t, "en") for i, t in enumerate(ODD_TEXTS)] + [(7, "a b c", "en"), (7, "a b c", "en"), (None, "a b c", None)]
    docs = spark.createDataFrame(made, DOCS).withColumns({"f": F.lit(0), "phrase": F.lit("clash"), "range": F.lit(1), "n": F.lit(2)}).repartition(5)
    for least, first in ((2, 50), (4, 2000)):
        got = sorted(rows(collocations.collocations(docs, least=least, first=first)))
        assert got == brute_collocations([(r[2], r[1]) for r in made], least, first)
    assert rows(collocations.collocations(docs.limit(0))) == []


def test_collocations_in_small_shards(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(rows(collocations.collocations(docs, least=20)))
    monkeypatch.setattr(collocations, "RANGE_WORDS", 5_000)
    monkeypatch.setattr(collocations, "RANGE_PHRASES", 50)
    monkeypatch.setattr(shared, "SIEVE_BITS", 1 << 6)  # so full that it lets nearly all through: the result stays
    again = sorted(rows(collocations.collocations(docs, least=20)))
    assert whole == again == brute_collocations(rows(docs.select("lang", "text")), 20, 2000) and len(whole) > 5


def test_score_beyond_64_bits(spark, monkeypatch):
    """1000 * a * n passes 64 bits; the quotient is exact."""
    counts = spark.createDataFrame([("en", b"a", 1, 3_000_000_019), ("en", b"b", 1, 2_999_999_937), ("en", b"a b", 2, 2_000_000_011)], "lang string, phrase binary, size int, f long")
    totals = spark.createDataFrame([("en", 9_007_199_254_740_993)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, least: (counts, totals))
    (got,) = rows(collocations.collocations(None))
    assert got[-1] == 1000 * 2_000_000_011 * 9_007_199_254_740_993 // (3_000_000_019 * 2_999_999_937)


def transducer(counter):
    words = sorted({w for k in counter for w in k})
    number, wide, keys = {w: i for i, w in enumerate(words)}, max(map(len, counter)), sorted(counter)
    return collocations.Transducer.build(words, np.array([[number[w] for w in k] + [-1] * (wide - len(k)) for k in keys], np.int32), np.array([counter[k] for k in keys]))


def held(words, entries):
    return {tuple(words[i] for i in k): c for keys, counts in entries for k, c in zip(keys.tolist(), counts.tolist(), strict=True)}


def test_transducers():
    random.seed(6)
    for _ in range(100):
        made = [Counter(tuple(random.choice([b"a", b"b", b"\xc3\xa9", b"d"]) for _ in range(random.randint(1, 4))) for _ in range(random.randint(1, 60))) for _ in range(3)]
        built = [collocations.Transducer.unpack(*transducer(x).pack()) for x in made]
        assert [held(t.words, t.entries()) for t in built] == [dict(x) for x in made]
        assert held(*collocations.Transducer.union(built)) == dict(made[0] + made[1] + made[2])
        assert held(built[1].words, built[0].compose(built[1])) == {k: made[0][k] for k in made[1] if k in made[0]}
    same = transducer(Counter({(b"a", b"x"): 2, (b"b", b"x"): 2, (b"c", b"x"): 2}))
    assert len(same.finals) == 3  # root, one state for a, b and c, and one end


# 12


def brute_trie(turns):
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        ends = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        kids = sum(len(q) == len(path) + 1 for q in below)
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_against_brute_force(spark, spread):
    random.seed(7)
    for few in (2, 5):
        made = []
        for c in [*range(0, 260, 3), 100, 200, 1000, 1001, 1105]:
            made += [(c, None if random.random() < 0.1 else random.randint(0, 4), random.choice(["user", None, ""]), random.choice(["", None, "x", "é字", "y" * few][:few])) for _ in range(random.randint(1, 9))]
        made += [(c, t, "user", "same") for c in range(300, 420) for t in range(3)]  # copies and one common path over many partitions
        made += [(c, t, "user", "long" * 500) for c in (501, 502, 1301) for t in range(40)] + [(None, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "user", "x")]
        turns = spark.createDataFrame(made, TURNS).withColumns({"part": F.lit(1), "depth": F.lit("clash"), "digests": F.lit(0)}).repartition(4)
        assert sorted(rows(prefix_trie.conversation_trie(turns)), key=str) == brute_trie(made)
    assert rows(prefix_trie.conversation_trie(turns.limit(0))) == []


def test_trie_of_turnless_conversations(spark):
    # 1 to 99 have no first conversation; those whose h covers their only turn are left without any
    made = [(c, 0, "user", "t") for c in range(1, 40)]
    got = rows(prefix_trie.conversation_trie(spark.createDataFrame(made, TURNS)))
    assert sorted(got, key=str) == brute_trie(made) and any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in got)


def test_branching_nodes_by_union_find():
    random.seed(8)
    for _ in range(200):
        seqs = sorted({tuple(random.randint(0, 2) for _ in range(random.randint(0, 5))) for _ in range(random.randint(1, 12))})
        keys = [b"".join(bytes([x]) * 16 for x in s) for s in seqs]
        edges = prefix_trie.common(keys)
        assert edges.tolist() == [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(seqs, seqs[1:], strict=False)]
        depth, parent, first, last = prefix_trie.merge([len(s) for s in seqs], edges)
        got = {(depth[v], first[v], last[v]) for v in range(len(depth))}
        prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
        branching = {p for p in prefixes if p in seqs or len({s[len(p)] for s in seqs if s[: len(p)] == p and len(s) > len(p)}) > 1}
        spans = {(len(p), min(i for i, s in enumerate(seqs) if s[: len(p)] == p), max(i for i, s in enumerate(seqs) if s[: len(p)] == p)) for p in branching}
        assert got == spans and all(depth[parent[v]] < depth[v] for v in range(len(depth)) if parent[v] >= 0)


# 13


def brute_shards(docs, shards):
    groups = Counter()
    size = lambda t: len((t or "").encode()) + 1
    for _, text in docs:
        groups[text or ""] += size(text)
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    heap, home = [(0, s) for s in range(shards)], {}
    for text, weight in sorted(groups.items(), key=lambda x: (-x[1], digest(x[0]))):
        load, home[text] = heap[0]
        heapq.heapreplace(heap, (load + weight, home[text]))
    seats = defaultdict(list)
    for i, text in docs:
        seats[home[text or ""]].append((i is not None, i or 0, digest(text or ""), i, text))
    return sorted(((i, size(t), zlib.crc32((t or "").encode()), s, n) for s, of in seats.items() for n, (_, _, _, i, t) in enumerate(sorted(of, key=lambda x: x[:3]))), key=str)


def test_shards_against_brute_force(spark, spread):
    random.seed(9)
    made = [(i, random.choice(["", None, "a", "b", "éé", "x" * 7000, *map(str, range(300))])) for i in range(1500)] + [(i, "hot " * 30) for i in range(2000, 2800)]
    made += [(5, "again"), (5, "again"), (None, "again"), (None, None), (None, "b")]
    docs = spark.createDataFrame(made, "doc_id long, text string").withColumns({"key": F.lit(1), "part": F.lit("clash"), "size": F.lit(-1)}).repartition(6)
    for shards in (8, 3):
        got = rows(sharding.by_bytes(docs, shards).select("doc_id", "size", "text_crc32", "shard", "slot"))
        assert sorted(got, key=str) == brute_shards(made, shards)
    assert rows(sharding.by_bytes(docs.limit(0))) == []


def test_runs_of_picks_equal_the_heap():
    random.seed(10)
    for _ in range(500):
        n = random.choice([1, 2, 3, 8])
        heap, due = [(0, s) for s in range(n)], [(0, s) for s in range(n)]
        for _ in range(random.randint(1, 6)):
            weight, count = random.randint(1, 40), random.choice([1, 5, 64, 100, 300, 1000])
            runs = sharding.picks(heap, weight, count)
            got = [next(t[(j - a) % len(t)] for a, t in reversed(runs) if a <= j) for j in range(count)]
            one_by_one = []
            for _ in range(count):
                load, shard = due[0]
                heapq.heapreplace(due, (load + weight, shard))
                one_by_one.append(shard)
            assert got == one_by_one and sorted(heap) == sorted(due) and len(runs) < 20


def test_shards_of_the_query(spark):
    got = queries.op13_sharding(spark, SF).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert list(loads.index) == list(range(8)) and loads.max() - loads.min() <= got["size"].max() and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for _, some in got.groupby("shard"):
        assert sorted(some["slot"]) == list(range(len(some)))
