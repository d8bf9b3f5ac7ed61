"""Each operator against a brute-force version, and on odd input: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import io
import itertools
import re
import wave
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import bsi_topk, media_wav, mixing, pii_sanitise, quality_fm, queries, shared, simhash, sp_viterbi, token_orc, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "one", "two words", "a b c d e f", "a b c d e f", "x" * 5000, "word " * 3000, "É ñ ß 字 ▁ \x00 \n\t", "don't  stop", " lead", "trail "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(ODD)] + [(3, "one", None, None, 3), (None, "one", "en", "s", 3)]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit(9), "fp": F.lit("x"), "spans": F.lit(1), "number": F.lit(1), "topic": F.lit("t"), "p": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1


def test_urls_by_rule_and_list(spark):
    urls = ["https://A.Example.COM/en/71?x", "http://www.example.com/en/8", "https://x.net/de/1", "http://a.example.net/de/8#y", None, "nonsense", "http://spam-farm.example.org", "http://spam-farm.example.org", "ftp://org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.filter_urls(pages, queries.RULES, F.col("host").rlike(queries.LISTED_HOSTS)).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(9)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), ("org/es/", "block")]
    assert got[0].host == "a.example.com" and got[0].path == "/en/71" and got[4].host == "" and got[6].path == ""
    assert rows(url_filter.filter_urls(pages.limit(0), queries.RULES, F.lit(True))) == []


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(30000).select(F.concat(F.lit("k"), "id").alias("key"), (F.xxhash64("id") % 10 == 0).alias("listed"))
    table = keys.where("listed").select("key").unionByName(spark.createDataFrame([("not in the corpus",), (None,)], "key string"))
    for listed in (F.col("listed"), table):
        cascade = url_filter.build_cascade(keys, listed, 64, first_rate=0.25)
        assert cascade.agg(F.max("level")).first()[0] >= 2
        for most in (32 << 20, 0):  # broadcast, and dealt by shard
            rows_ = keys.unionByName(keys.where("key = 'k7' or key = 'k8'")).withColumns({"h1": F.lit(0), "row": F.lit("r"), "shard": F.lit(1.5)})
            out = url_filter.listed_by_cascade(rows_, F.col("key"), cascade, 64, "answer", most)
            assert out.where("answer <> listed").count() == 0 and out.count() == 30002 and out.columns == [*rows_.columns, "answer"]


def test_keys_that_share_hashes_are_refused(spark, monkeypatch):
    first = lambda key: (F.xxhash64(F.substring(key, 1, 1)), F.xxhash64(F.lit("second"), F.substring(key, 1, 1)), F.xxhash64(F.lit("third"), key))
    monkeypatch.setattr(url_filter, "key_hashes", first)
    keys = spark.createDataFrame([("a1", True), ("a2", False), ("b", True)], "key string, listed boolean")
    with pytest.raises(Exception, match="share both hashes"):
        url_filter.build_cascade(keys, F.col("listed"), 4)


def test_hashes_are_independent(spark):
    h1, h2, h3 = url_filter.key_hashes(F.lit("key"))
    got = spark.range(1).select(h1.alias("a"), h2.alias("b"), F.xxhash64(F.lit("key"), F.lit("second")).alias("c"), h3.alias("d")).first()
    assert len({got.a, got.b, got.c, got.d}) == 4


# 2


def brute_top(vectors, k):
    ids, v = [i for i, _ in vectors], np.array([np.floor(64 * np.array(x, float)) for _, x in vectors], np.int64)
    out = []
    for a in range(len(ids)):
        if ids[a] % 20 == 0:
            scores = sorted((-int(v[a] @ v[b]), ids[b]) for b in range(len(ids)) if b != a)
            out += [(ids[a], n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [32 << 20, 64 * 9 * 8, 1])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(0, 0.2, 9).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(i, vectors[5][1]) for i in range(300, 340)]  # ties
    bad = [(1000, None), (1020, [1.0, None]), (1040, [float("nan")]), (None, [1.0]), (1060, [float("inf")])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    assert sorted(rows(bsi_topk.top_k(df, F.col("vec_id") % 20 == 0, block_bytes=block))) == brute_top(vectors, 20)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, (rng.normal(0, 1, 768) * 10.0 ** rng.integers(0, 6)).tolist()) for i in range(60)]
    vectors += [(60, [-1e6] * 768), (61, [1e6] * 768)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(rows(bsi_topk.top_k(df, F.col("vec_id") % 20 == 0))) == brute_top(vectors, 20)
    with pytest.raises(Exception, match="may not fit a long"):
        bsi_topk.top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], df.schema), F.col("vec_id") == 0).collect()


def test_top_k_small_and_repeated(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (20, [1.0, 2.0]), (7, [0.5]), (9, [])], "vec_id long, embedding array<double>")
    got = sorted(rows(bsi_topk.top_k(df, F.col("vec_id") % 20 == 0)))
    assert got == sorted(2 * [(20, 1, 20, 64 * 64 * 5), (20, 2, 7, 32 * 64), (20, 3, 9, 0)])
    assert rows(bsi_topk.top_k(df.limit(0), F.lit(True))) == []


# 3


def test_mixing_meets_its_targets(spark, odd, empty):
    made = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"))
    targets = {"source": mixing.Target(temper=0.5), "lang": mixing.Target({"en": 0.5, "de": 0.5})}
    got = mixing.mix(made.withColumn("topic", F.lit(1)), targets, 0.3, 12)
    share = {r.lang: r.n for r in got.groupBy("lang").agg((F.sum(F.col("tokens") * F.col("probability")) / 80000).alias("n")).collect()}
    assert abs(share["en"] - 0.15) < 1e-3 and abs(share["de"] - 0.15) < 1e-3
    assert abs(got.where("sampled").count() / 20000 - 0.3) < 0.02
    assert mixing.sample(made, targets, 0.3, 12).columns == made.columns
    assert mixing.sample(made, targets, 0.3, 12).count() == got.where("sampled").count()
    assert mixing.mix(odd, queries.TARGETS).count() == odd.count() and rows(mixing.mix(empty, queries.TARGETS)) == []
    assert mixing.sample(odd, queries.TARGETS).columns == odd.columns


def test_margins_tell_what_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 100), ("b", "x", 10), ("b", "y", 10)], "source string, lang string, tokens long")
    targets = {"source": mixing.Target({"a": 0.5, "b": 0.5}), "lang": mixing.Target({"x": 0.5, "y": 0.5})}
    got = {(r.dim, r.category): (r.wanted, r.expected) for r in mixing.margins(mixing.rake(cells, targets, 0.5, 30), targets).collect()}
    assert got["source", "b"] == pytest.approx((55, 20)) and got["source", "a"] == pytest.approx((55, 90), abs=36) and got["lang", "x"][0] == pytest.approx(55)


def test_mixing_in_one_partition_equals_distributed(spark, sf, monkeypatch):
    one = sorted(rows(queries.op3_mixing(spark, sf)))
    monkeypatch.setattr(mixing, "ONE_PARTITION_CELLS", 0)
    monkeypatch.setattr(queries, "ITERATIONS", 10)
    assert sorted(rows(queries.op3_mixing(spark, sf))) == one


# 4


def test_machine_scores_by_the_identity():
    m = quality_fm.FactorisationMachine(50, 4)
    m.bias, m.w = 0.1, np.random.default_rng(2).normal(size=50).astype(np.float32)
    ids, x = np.array([3, 7, 9, 1]), np.array([1.0, 0.5, 2.0, 1.0], np.float32)
    pairs = sum(float(m.v[a] @ m.v[b]) * xa * xb for (a, xa), (b, xb) in itertools.combinations(list(zip(ids, x, strict=True))[:3], 2))
    due = 0.1 + float(m.w[ids[:3]] @ x[:3]) + pairs
    assert abs(m.margin(ids, x, np.array([0, 3, 4]))[0][0] - due) < 1e-4


def test_quality_scores_equal_all_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one two two three", "", None, "A | B !!\nx"])], "doc_id long, text string")
    m = quality_fm.FactorisationMachine(quality_fm.FEATURES, 4)
    m.bias, m.w = 0.2, np.random.default_rng(3).normal(0, 0.3, quality_fm.FEATURES).astype(np.float32)
    monkeypatch.setattr(quality_fm, "train", lambda *_: m)
    got = {r.doc_id: r for r in quality_fm.classify(docs, docs).collect()}
    for r in docs.collect():
        ids, x, _ = quality_fm.features([r.text or ""], quality_fm.HashedWords(quality_fm.WORD_BUCKETS))
        z = m.bias + float((m.w[ids] * x).sum()) + sum(float(m.v[i] @ m.v[j]) * a * b for (i, a), (j, b) in itertools.combinations(list(zip(ids, x, strict=True)), 2))
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-5 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_the_fit_learns_what_only_pairs_tell():
    rng = np.random.default_rng(4)
    y = rng.random(600) < 0.5
    pairs = [(0, 2) if (t == (rng.random() < 2)) else (0, 3) for t in y]  # word 0 with 2 is good, with 3 bad; word 1 the other way round
    pairs = [(p if rng.random() < 0.5 else (1, 5 - p[1])) for p in pairs]
    ids, starts = np.array(pairs, np.int32).ravel(), np.arange(0, 1201, 2)
    m = quality_fm.FactorisationMachine(4, 4).fit(ids, np.ones(1200, np.float32), starts, y.astype(np.float32), epochs=60, rate=0.2)
    assert ((m.score(ids, np.ones(1200, np.float32), starts) > 0.5) == y).mean() > 0.95


def test_quality_held_out(spark, odd, empty):
    got = queries.op4_quality_fm(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(right) > 500 and np.mean(right) > 0.97
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (5, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    assert quality_fm.classify(odd, labels).where("score between 0 and 1").count() == odd.count()
    assert quality_fm.classify(odd, labels.limit(0)).where("score = 1 and predicted = 1").count() == odd.count()
    assert rows(quality_fm.classify(empty, labels)) == []
    kept = quality_fm.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    held = {r.doc_id: r.held_out for r in quality_fm.classify(odd, labels).collect() if r.doc_id is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


# 5


def test_toxicity_grades(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.grade_toxicity(docs, labels).withColumnRenamed("toxic", "flag").join(labels, "doc_id").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert np.mean([r.flag for r in toxic]) > 0.9 and np.mean([r.flag for r in clean]) < 0.03
    assert all(0 <= r.severity <= 3 and r.severity >= r.p_toxic for r in got)
    few = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.grade_toxicity(odd, few).count() == odd.count()
    assert toxicity.grade_toxicity(odd, few.limit(0)).where("severity = 0 and not toxic").count() == odd.count()
    assert rows(toxicity.grade_toxicity(empty, few)) == []


def test_toxicity_equals_its_formula(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "train", lambda *_: model)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert model.weights and min(model.weights.values()) >= 0 and (np.diff(model.thresholds) > 0).all()
    for r in toxicity.grade_toxicity(docs, labels).collect():
        names = set()
        margin = 0.0
        for raw in (texts[r.doc_id] or "").lower().split():
            w = raw.strip(toxicity.SIGNS)
            if w and w not in names:
                names.add(w)
                margin += sum(model.weights.get(zlib.crc32(f.encode()) % toxicity.BUCKETS, 0.0) for f in [w] + ["^" + w[:n] for n in (4, 5, 6) if len(w) > n])
        p = [1.0] + [float(1 / (1 + np.exp(-min(30.0, max(-30.0, margin - t))))) for t in model.thresholds] + [0.0]
        each = [a - b for a, b in itertools.pairwise(p)]
        assert abs(r.severity - sum(p[1:4])) < 1e-9 and abs(r.p_toxic - p[1]) < 1e-9 and r.toxic == (p[1] >= 0.5) and each[r.grade] >= max(each) - 1e-9


def test_ordinal_fit_climbs_to_the_best_likelihood():
    rng = np.random.default_rng(12)
    toxic = np.arange(400) < 200
    texts = [np.array(sorted(set(rng.integers(1000, 9000, 20).tolist()) | ({int(x) for x in rng.integers(0, 12, 6)} if t else set()))) for t in toxic]
    m = toxicity.OrdinalRegression().fit(texts, toxic)
    eta = np.array([sum(m.weights.get(int(f), 0.0) for f in t) for t in texts])
    assert ((m.at_least(eta)[:, 0] >= 0.5) == toxic).mean() > 0.99 and set(m.weights) <= set(range(12))


def test_repeated_labelled_ids_are_learned_once(spark):
    docs = spark.createDataFrame([(i % 2, f"bad{j} w{j}" if i % 2 else f"fine w{j}") for i in range(2) for j in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    fit = toxicity.OrdinalRegression.fit
    toxicity.OrdinalRegression.fit = lambda self, rows, toxic, *a: seen.append(len(rows)) or fit(self, rows, toxic, *a)
    try:
        toxicity.train(docs, labels)
    finally:
        toxicity.OrdinalRegression.fit = fit
    assert seen == [2]


# 6


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 3:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return label


def test_fingerprints_and_components(spark, odd, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[x] for x in brute_components(prints)]
    assert simhash.near_duplicates(odd).count() == odd.count() and rows(simhash.near_duplicates(empty)) == []
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {0, 3, 4}


def linked(spark, fps):
    edges = simhash.links(spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long"), shared.Scratch(spark, "links"))
    return {(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in edges.collect()}


@pytest.mark.parametrize("bucket", [2048, 4])
def test_links_join_what_is_connected(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    fps = {int(x) for x in rng.integers(0, 2**64, 40, np.uint64)}
    for base in list(fps)[:8]:
        for _ in range(12):
            base ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), False))
            fps.add(base)
    fps = sorted(fps)
    pairs = linked(spark, fps)
    assert all(bin(a ^ b).count("1") <= 3 for a, b in pairs)
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[max(root(a), root(b))] = min(root(a), root(b))
    due = brute_components(fps)
    assert [root(f) for f in fps] == [root(fps[x]) for x in due] and len({root(f) for f in fps}) == len(set(due))


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200 + i, 100) for i in range(1, 50)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 100 for i in range(1, 50)}}


def brute_copies(texts):
    """The smallest index of each text's group by Jaccard similarity of five-word shingles."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("pivots,common,small", [(8, 20_000, 16), (1, 0, 1)])
def test_near_copies_are_those_of_similar_shingles(spark, monkeypatch, pivots, common, small):
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "FIRST", 2 if small > 1 else 0)
    monkeypatch.setattr(simhash, "MOST_COMMON", common)
    rng = np.random.default_rng(7)
    texts = ["a b c d e f g h", "h g f e d c b a", "a a b b c d e f g h", "", " ", "x y", "y x", "x  Y"]
    for size in (12, 60, 200):  # copies with more and more changed words, and a shared passage
        base = [f"w{i}" for i in rng.integers(0, 400, size)]
        for changes in [0, 0] + list(range(1, 14)):
            words = list(base)
            for at in rng.choice(size, min(size, changes), False):
                words[at] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
        texts += [" ".join(base[: size // 2] + [f"own{i}x{j}" for j in range(size)]) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    due = brute_copies(texts)
    got = {r.node: r.root for r in simhash.similar_documents(docs).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == due
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(due))


def passages(count, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{i}" for i in rng.integers(0, 3000, int(rng.integers(40, 80)))) for _ in range(count)]


def test_near_copies_among_texts_of_common_passages(spark, monkeypatch):
    """Groups by what similar sets must share lose no link, whatever the passages' number and size."""
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    monkeypatch.setattr(simhash, "SMALL", 1)
    monkeypatch.setattr(simhash, "FIRST", 0)
    rng = np.random.default_rng(4)
    texts = []
    for parts, stock in ((5, passages(9, 1)), (9, passages(12, 2)), (20, [p[:60] for p in passages(24, 3)])):
        for _ in range(25):
            chosen = rng.choice(len(stock), parts, False)
            texts.append(" ".join(stock[i] for i in chosen))
            kind = rng.integers(0, 3)
            if kind == 0:  # without one passage, or with one more
                texts.append(" ".join(stock[i] for i in chosen[:-1]))
            if kind == 1:  # in another order, with some words changed
                words = " ".join(stock[i] for i in rng.permutation(chosen)).split()
                words[:: max(20, len(words) // 8)] = [f"new{rng.integers(0, 9999)}"] * len(words[:: max(20, len(words) // 8)])
                texts.append(" ".join(words))
    due = brute_copies(texts)
    assert 20 < len(texts) - len(set(due)) < len(texts) // 2
    got = {r.node: r.root for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == due


def test_pairs_that_meet_grow_with_the_texts(spark, monkeypatch):
    """Texts of five of 14 passages, none similar to another: twice the texts, about twice the pairs."""
    stock = passages(14, 5)
    combos = list(itertools.combinations(range(14), 5))
    np.random.default_rng(6).shuffle(combos)
    real, counts = simhash.meetings, []
    for n in (400, 800):  # more than are compared as small groups
        counts_of = []
        monkeypatch.setattr(simhash, "meetings", lambda *a, c=counts_of: (c.append((d := real(*a)).count()), d)[1])
        docs = spark.createDataFrame([(i, " ".join(stock[j] for j in c)) for i, c in enumerate(combos[:n])], "doc_id long, text string")
        assert simhash.similar_documents(docs).count() == 0
        counts.append(sum(counts_of))
    assert counts[1] < 2.5 * counts[0] and counts[1] < 800 * 799 / 2 / 8


def test_near_copies_are_linked_by_fingerprints_first(spark, monkeypatch):
    """The first pairs that are compared are those of equal and linked fingerprints of the sets."""
    rng = np.random.default_rng(3)
    texts = ["", "x y", "x Y", *passages(6, 8)]
    for _ in range(6):
        words = [f"w{i}" for i in rng.integers(0, 5000, 1500)]
        texts += [" ".join(words), " ".join([*words[:-1], "new"]), " ".join(words[: len(words) // 2])]
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    real, seen = simhash.linked_prints, []
    monkeypatch.setattr(simhash, "linked_prints", lambda *a: (d := real(*a), seen.extend((r.key, r.fp) for r in a[0].collect()), seen.append({(r.a, r.b) for r in d.collect()}))[0])
    got = {r.node: r.root for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == brute_copies(texts)
    pairs, prints = seen.pop(), dict(seen)
    assert sorted(np.uint64(np.int64(p)) if p >= 0 else int(p) + 2**64 for p in prints.values()) == sorted(simhash.majority(x) for x in {x.tobytes(): x for x in sets}.values())
    near = {(a, b) for a, b in itertools.permutations(prints, 2) if a > b and bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 3}
    assert len(pairs) >= 5 and pairs <= near


def test_large_groups_by_what_sets_share_are_met_in_rounds(spark, monkeypatch):
    """Every set has its turn in the end; a round stores seven tables, not twelve."""
    for name, value in (("PIVOTS", 1), ("SMALL", 1), ("FIRST", 0), ("AT_ONCE", 2), ("MORE", 8)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(12)
    stock = [" ".join(p.split()[:30]) for p in passages(20, 9)]
    texts = [" ".join(stock[i] for i in rng.choice(20, 10, False)) for _ in range(40)]
    texts += [t.rsplit(" ", 9)[0] for t in texts[::5]]
    met, kept, real, keep = [], [], simhash.meetings, shared.Scratch.keep
    monkeypatch.setattr(simhash, "meetings", lambda *a: (met.append(a[1:]), real(*a))[1])
    monkeypatch.setattr(shared.Scratch, "keep", lambda *a: (kept.append(1), keep(*a))[1])
    got = {r.node: r.root for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == brute_copies(texts)
    assert len(met) >= 4 and met[3] == (1, 8, 0) and len(kept) <= 14 + 7 * len(met)


def test_only_minima_that_a_neighbour_is_moved_to_are_dealt(spark, monkeypatch):
    """Of stars that are flat already no leaf is copied for the salts, and nothing in small-star."""
    dealt, real = [], simhash.salted_join
    monkeypatch.setattr(simhash, "salted_join", lambda rows, keyed, *a: (dealt.append(keyed.count()), real(rows, keyed, *a))[1])
    edges = [(100 * i + j, 100 * i) for i in range(30) for j in range(1, 21)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict(edges) and dealt == [30, 0] * 2


def test_unlike_texts_with_a_passage_in_common_do_not_meet(spark, monkeypatch):
    """Of 36 texts with one passage only near copies leave the join; every pair of sets of the same sizes did."""
    rng = np.random.default_rng(21)
    own = [f"w{i}" for i in range(20_000)]
    texts = [" ".join([*passages(1, 30), *rng.choice(own, 300)]) for _ in range(36)]
    texts += [t.rsplit(" ", 20)[0] for t in texts[:3]]
    met, real = [], simhash.meetings
    monkeypatch.setattr(simhash, "meetings", lambda *a: (d := real(*a), met.append(d.count()))[0])
    got = {r.node: r.root for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    due = brute_copies(texts)
    assert [got.get(i, i) for i in range(len(texts))] == due and len(set(due)) == 36
    assert sum(met) <= 6


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(22)
    for n in (0, 1, 5, 300, 5000):
        one = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for lost in (0, 1, n // 10, n):
            two = np.unique(np.concatenate([one[: len(one) - lost], rng.integers(0, 2**64, lost, np.uint64)]))
            assert np.bitwise_count(simhash.parities(one) ^ simhash.parities(two)).sum() <= len(np.setxor1d(one, two))


@pytest.mark.parametrize("most", [50_000, 0])
def test_few_links_are_united_without_star_steps(spark, monkeypatch, most):
    """Chains, copies and an id with two texts; the same result where star steps are taken."""
    monkeypatch.setattr(simhash, "ONE_TASK", most)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 200]) for i in range(0, 120, 12)]  # each is similar to the next only
    docs = [*enumerate(texts), (20, texts[4]), (21, "a b"), (22, "A  B"), (22, texts[9]), (23, "c"), (24, "d")]
    steps, real = [], simhash.star
    monkeypatch.setattr(simhash, "star", lambda e: (steps.append(1), real(e))[1])
    got = {r.node: r.root for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in [*range(1, 10), 20, 21, 22]}
    assert bool(steps) == (most == 0)


def test_groups_split_by_size_meet_the_same_pairs(spark):
    sizes = [int(1.013**i) + 1 for i in range(500)]
    groups = spark.createDataFrame([(i, n, 0, 7, 7, i, 2, len(sizes)) for i, n in enumerate(sizes)], "key long, n int, at int, group long, under long, root long, role int, size long")
    split = simhash.by_size(groups)
    due = {(b, a) for a, b in itertools.combinations(range(len(sizes)), 2) if 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])}
    assert {(r.a, r.b) for r in simhash.meetings(split, 0, 1 << 30).collect()} == due
    assert split.count() <= 2 * len(sizes) and max(r.size for r in split.collect()) < len(sizes) / 5


def test_sizes_of_similar_sets_are_few_classes_apart():
    for n in range(1, 3000):
        assert simhash.step(n) <= simhash.step(n + 1) and simhash.step(5 * n // 4) - simhash.step(n) <= simhash.STEPS


# 7


def test_tokens_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    t, before = Tokenizer.from_file(token_orc.tokenizer_path()), 0
    got = token_orc.store_tokens(odd).collect()
    order = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in order]
    for r, due in zip(got, order, strict=True):
        ids = t.encode(due.text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    assert rows(token_orc.store_tokens(empty)) == []


def test_pieces_give_the_whole_texts_ids():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice([*" \n\tab1!'é\x1c　.$ñZ字", "\n\n", "<|endoftext|>"], rng.integers(0, 25))) for _ in range(6000)]
    texts += [" ".join(rng.choice(["the", "Été.", "a$$$", "x\ny", "don't.", "'s", "e\u0301", "\n", "4,5", "ß<|endoftext|>"], 30)) for _ in range(500)] + ["", "z" * 5000]
    encode, t = token_orc.Encoder(token_orc.tokenizer_path()), Tokenizer.from_file(token_orc.tokenizer_path())
    assert encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids + [2], "<i4").tobytes() for x in texts]


def test_token_files_find_documents(spark, sf):
    path = token_orc.fresh_path(spark, "orc-test")
    token_orc.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path, token_orc.tokenizer_path())
    assert {r.doc_id for r in token_orc.tokens_of(spark, path, [3, 77]).collect()} == {3, 77}


# 8


def test_media_round_trip(spark, odd, empty):
    got = sorted(media_wav.fingerprint_media(media_wav.store_media(odd)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes))
    texts = sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, len((r.text or "").encode())))
    for r, due in zip(got, texts, strict=True):
        raw = (due.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
    same = [r for r in got if r.doc_id in (5, 6)]
    assert same[0].hash == same[1].hash and same[0].time == same[1].time
    assert rows(media_wav.to_media(empty)) == []


def brute_pairs(payload):
    """The pairs by a plain Fourier transform of each frame."""
    x = np.concatenate([np.zeros(24), np.frombuffer(payload, np.uint8).astype(float) - 128, np.zeros(24 + -len(payload) % 16)])
    spectra = [np.abs(np.fft.rfft(x[a : a + 48] * np.hanning(48), 256)) ** 2 for a in range(0, len(x) - 47, 16)]
    bands = [(2, 12), (12, 32), (32, 64), (64, 129)]
    top = [[(int(np.argmax(s[a:b])) + a, s[a:b].max()) for a, b in bands] for s in spectra]
    power = lambda t, i: top[t][i][1] if 0 <= t < len(top) else -1
    peak = lambda t, i: power(t, i) > 1e-3 and power(t, i) > power(t - 1, i) and power(t, i) >= power(t + 1, i)
    out = []
    for t in range(len(top)):
        for step in (1, 2, 3):
            if t + step < len(top):
                out += [(t, top[t][i][0] << 16 | top[t + step][j][0] << 8 | step) for i in range(4) for j in range(4) if peak(t, i) and peak(t + step, j)]
    return sorted(out)


def test_pairs_equal_a_plain_transform():
    rng = np.random.default_rng(10)
    for n in (64, 128, 640, 6400):
        payload = bytes(rng.integers(60, 123, n, np.uint8))
        assert list(zip(*map(np.ndarray.tolist, media_wav.peak_pairs(payload)), strict=True)) == brute_pairs(payload)


def test_peaks_find_a_tone():
    t = np.arange(4000)
    tone = (128 + 50 * np.sin(2 * np.pi * 40 / 256 * t)).astype(np.uint8).tobytes()
    assert (media_wav.band_peaks(tone)[0][:, 2] == 40).all()
    assert len(media_wav.peak_pairs(b"\x80" * 4000)[0]) == 0


def test_short_payloads_and_last_samples_count():
    rng = np.random.default_rng(9)
    for units in range(1, 9):
        one = bytes(rng.integers(97, 123, 64 * units, np.uint8))
        two = one[:-32] + bytes(rng.integers(97, 123, 32, np.uint8))
        assert len(media_wav.peak_pairs(one)[0]) > 0
        assert [x.tolist() for x in media_wav.peak_pairs(one)] != [x.tolist() for x in media_wav.peak_pairs(two)]


# 9


def brute_best(m, text):
    if not text:
        return 0.0
    s = "▁" + text.replace("▁", sp_viterbi.LITERAL_MARK).replace(" ", "▁")
    best = [0.0] + [float("-inf")] * len(s)
    for e in range(1, len(s) + 1):
        options = [best[b] + m.scores[s[b:e]] for b in range(max(0, e - 16), e) if s[b:e] in m.scores]
        if s[e - 1] not in m.singles:
            options.append(best[e - 1] + m.skip)
        best[e] = max(options)
    return best[-1]


def score_of(m, ids):
    total, at, bytes_ = 0.0, 0, set(m.bytes.values())
    while at < len(ids):
        if ids[at] in bytes_:
            lead = m.text[ids[at]][0]
            total, at = total + m.skip, at + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)
        else:
            total, at = total + m.scores[m.text[ids[at]].decode().replace(" ", "▁")], at + 1
    return total


def test_segmentation_is_best_and_reversible(spark, odd, empty):
    m, rng = sp_viterbi.PieceModel(sp_viterbi.model_path()), np.random.default_rng(4)
    texts = [t for t in ODD if t and len(t) < 3000] + ["".join(rng.choice(list("  \nabtheing1!é▁字😀"), rng.integers(1, 25))) for _ in range(400)]
    for t in texts:
        ids = np.frombuffer(m.encode(t), "<i4").tolist()
        assert m.decode(ids) == t and abs(score_of(m, ids) - brute_best(m, t)) < 1e-6
    made = sp_viterbi.encode(odd)
    assert made.where("not round_trip").count() == 0 and made.count() == odd.count()
    assert {(r.doc_id, r.text) for r in sp_viterbi.decode(made).collect()} == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert rows(sp_viterbi.encode(empty)) == []


# 10


def brute_spans(text):
    def kept(kind, pattern, ok):
        return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m.group())]

    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = kept("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
    out += kept("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split(".")))
    out += kept("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)))
    out += kept("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)
    return sorted(out, key=lambda s: (s[1], pii_sanitise.KINDS.index(s[0])))


def test_base_spans_equal_the_plain_patterns(spark, sf):
    rng = np.random.default_rng(5)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["".join(rng.choice(list("0123456789..  --++()@@ab"), rng.integers(0, 60))) for _ in range(6000)]
    texts += ["a@b.c@d.e", "@x.y", "a@b", "x@y..z", "1.2.3.4.5.6.7.8", "001.002.003.0004", "+1 (578) 555-6437 4918187128635271", "9" * 6000, "a" * 20000, "4111 1111 1111 1111"]
    assert all(pii_sanitise.base_spans(t) == brute_spans(t) for t in texts)


def test_terms_that_reveal_an_entity(spark, odd, empty):
    rng = np.random.default_rng(6)
    common = ["the", "and", "for", "with", "that", "from", "this", "they"]
    filler = lambda n: " ".join(rng.choice(common, n))
    texts = [f"{filler(9)} Zaphod mail zb@x.org {filler(9)}" for _ in range(4)] + [f"{filler(9)} mail q{i}@x.org {filler(9)}" for i in range(30)] + [filler(20) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in pii_sanitise.detect(docs).collect()}
    assert [got[i].n_term for i in range(5)] == [1, 1, 1, 1, 0] and all(got[i].n_email == 1 for i in range(34))
    at = texts[0].index("Zaphod")
    mail = texts[0].index("zb@")
    assert got[0].spans == f"term:{at}:{at + 6},email:{mail}:{mail + 8}"
    assert got[0].base_sha256 == hashlib.sha256(f"email:{mail}:{mail + 8}".encode()).hexdigest()
    clean = {r.doc_id: r for r in pii_sanitise.sanitise(docs).collect()}
    assert "Zaphod" not in clean[0].text and "<EMAIL>" in clean[0].text and clean[40].text == texts[40] and clean[0].n_chars == len(clean[0].text)
    assert pii_sanitise.detect(odd).count() == odd.count() and rows(pii_sanitise.detect(empty)) == []
    same = pii_sanitise.sanitise(odd)
    assert same.columns == odd.columns and sorted(map(str, rows(same))) == sorted(map(str, rows(odd)))


def brute_terms(texts):
    """All spans of each text, by counting every pair of entity and term."""
    base = [brute_spans(t) for t in texts]
    terms = [[m for m in re.finditer(r"[^\x00-/:-@\[-`{-\x7f]+", t)] for t in texts]
    lower = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x)
    free = [[m for m in ms if not any(m.start() < b and a < m.end() for _, a, b in s)] for ms, s in zip(terms, base, strict=True)]
    ents = [{f"{k}:{lower(t[a:b])}" for k, a, b in s} for t, s in zip(texts, base, strict=True)]
    all_, own = [{lower(m.group()) for m in ms} for ms in terms], [{lower(m.group()) for m in ms} for ms in free]
    n, out = len(texts), []
    for i, t in enumerate(texts):
        spans = list(base[i])
        for m in free[i]:
            best = 0.0
            for e in ents[i]:
                ce, ct = sum(e in x for x in ents), sum(lower(m.group()) in x for x in all_)
                both = sum(e in x and lower(m.group()) in y for x, y in zip(ents, own, strict=True))
                if both >= 2 and np.log2(n / ce) >= pii_sanitise.LEAST_BITS:
                    best = max(best, np.log2(both * n / (ce * ct)) / np.log2(n / ce))
            if best >= pii_sanitise.GENERALISE:
                spans.append(("term", m.start(), m.end()))
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], pii_sanitise.KINDS.index(s[0]), s[2]))))
    return out


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_term_spans_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(240):
        words = [f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(3, 30)) if x < 500]
        for who in rng.choice(25, rng.integers(0, 4) if rng.random() < 0.4 else 0, False):
            words += [f"p{who}@x.org", f"Name{who}", *([f"near{who}x{int(rng.integers(3))}"] if rng.random() < 0.7 else [])]
        rng.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:20] + [" ".join(f"p{w}@x.org Name{w} city{w}" for w in range(25)), "名 p1@x.org", "名 p1@x.org q", "a1 4111111111111111 ÀB", "ÀB 4111111111111111 a1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii_sanitise.detect(docs).collect()}
    due = brute_terms(texts)
    assert [got[i] for i in range(len(texts))] == due and sum("term" in x for x in due) > 30


def test_a_long_list_of_mentions_takes_one_sweep():
    import time

    text = " ".join(f"Name{i} n{i}@x.org" for i in range(8000))
    began = time.process_time()
    assert len(pii_sanitise.terms_outside(text, pii_sanitise.base_spans(text))) == 8000 and time.process_time() - began < 2


# pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf)
        if name != "sentencepiece":
            docs = p.materialise(docs, "test")
            assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    assert docs.where("not round_trip").count() == 0
    assert queries.pipeline(spark, sf).count() == n


def test_pipeline_stages_on_odd_input(spark, odd, empty, sf):
    import corpus_pipeline as p

    stages, whole = dict(p.STAGES), sorted(map(str, odd.collect()))
    for stage in stages.values():
        assert stage(spark, empty, sf).count() == 0
    texts = {i: t for i, t in enumerate(ODD)}
    good = {r.doc_id: r.score for r in quality_fm.classify(odd, spark.read.parquet(f"{sf}/labels.parquet")).where("doc_id IS NOT NULL").collect()}
    kept = stages["quality"](spark, odd, sf)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()} == {i for i, score in good.items() if score >= quality_fm.THRESHOLD}

    due = brute_copies([texts[i] for i in sorted(texts)])
    kept = stages["near_dedup"](spark, odd, sf)
    of = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and set(of) == set(due) | {None} and of.count(3) == 2 * (3 in due) and of.count(None) == 1

    cleaned = stages["pii"](spark, odd, sf)
    assert cleaned.columns == odd.columns and sorted(r.doc_id or -1 for r in cleaned.collect()) == sorted(r.doc_id or -1 for r in odd.collect())
    assert {(r.doc_id, r.text) for r in cleaned.collect()} == {(r.doc_id, r.text) for r in odd.collect()}  # nothing personal in them

    mixed = sorted(map(str, stages["mixing"](spark, odd, sf).collect()))
    assert all(mixed.count(r) <= whole.count(r) for r in mixed)
    encoded = stages["sentencepiece"](spark, odd, sf).collect()
    assert len(encoded) == len(whole) and all(r.round_trip for r in encoded)
