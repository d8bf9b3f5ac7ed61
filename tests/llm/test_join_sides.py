"""Sides of joins that have no bound are not broadcast by Spark's estimate, which knows no explode and no compression."""

from pyspark.sql import functions as F

from barloom.llm import collocations, pii_sanitise, simhash
from barloom.llm.shared import Scratch, materialise, salted_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_side_is_shuffled(spark):
    keyed = materialise(spark.range(60_000).select("id", F.col("id").alias("of")), "keyed")
    out = salted_join(spark.range(100_000), keyed, ["id"], "id")
    assert "BroadcastHashJoin" not in plan(out) and "SortMergeJoin" in plan(out)
    assert out.count() == 60_000


def test_buckets_of_variants_are_shuffled(spark):
    rows = materialise(spark.range(2_000).select(F.col("id").alias("fp")), "fp")
    rows = rows.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bucket"))
    assert "BroadcastHashJoin" not in plan(simhash._sized(rows, False))


def test_meetings_are_shuffled(spark):
    rows = [(k, 10, k % 5, 0, 400, 2, k) for k in range(2_000)]
    groups = materialise(spark.createDataFrame(rows, "key long, n int, group long, at int, size long, role int, root long"), "groups")
    assert "BroadcastHashJoin" not in plan(simhash.meetings(groups, 0, 2))


def test_longer_phrases_are_shuffled(spark, monkeypatch):
    plans = []
    real = collocations.materialise
    monkeypatch.setattr(collocations, "materialise", lambda df, name: (plans.append(plan(df)) if name == "cuts" else None, real(df, name))[1])
    docs = spark.createDataFrame([(i, "en", "one two three four") for i in range(30)], "doc_id long, lang string, text string")
    assert collocations.collocations(docs, 10, 5, 100).count() == 1
    assert plans and all("BroadcastHashJoin" not in p for p in plans)


def test_terms_are_shuffled(spark, monkeypatch):
    kept = []
    real = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: (kept.append((df.columns, plan(df))), real(self, df))[1])
    text = lambda i: f"mail a{i % 3}@b.org secret{i % 3} word{i} common"
    docs = spark.createDataFrame([(i, text(i)) for i in range(200)], "doc_id long, text string")
    pii_sanitise.detect(docs).count()
    rare = [p for columns, p in kept if columns == ["term", "in_docs"]]
    assert rare and "BroadcastHashJoin" not in rare[0]
