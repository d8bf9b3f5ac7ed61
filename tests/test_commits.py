"""Commits of several tables, reads between their writes, files that a change touches, and the gate at the end of a run."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from barloom.sources import manifest as m
from barloom.streaming import runs

SCHEMA = "code string, dt date, n int, close double"
DAYS = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-") + "/tables"


def bars(spark, days=DAYS, close=1.0, n=0):
    return spark.createDataFrame([(c, d, n, close) for c in "AB" for d in days], SCHEMA)


def change(rows):
    return m.Change(rows, ["code", "dt"], "n", "dt")


def held(spark, root, table, **more):
    return sorted((r.code, str(r.dt), r.close) for r in m.read(spark, root, table, SCHEMA, **more).collect())


def test_readers_see_all_tables_or_none(spark, root):
    assert m.latest(spark, root) == -1 and m.upsert(spark, root, {"a": change(bars(spark)), "b": change(bars(spark))}) == 0
    before = {t: held(spark, root, t) for t in "ab"}
    seen, real = [], m.stage

    def staged(*a, **k):  # a reader between the writes
        out = real(*a, **k)
        seen.append({t: held(spark, root, t) for t in "ab"})
        return out

    m.stage = staged
    try:
        assert m.upsert(spark, root, {"a": change(bars(spark, close=2.0, n=1)), "b": change(bars(spark, DAYS[:3], 3.0, 1))}) == 1
    finally:
        m.stage = real
    assert len(seen) >= 4 and all(s == before for s in seen)
    assert {c for _, _, c in held(spark, root, "a")} == {2.0} and sum(c == 3.0 for _, _, c in held(spark, root, "b")) == 6 and len(held(spark, root, "b")) == 80
    assert {t: held(spark, root, t, version=0) for t in "ab"} == before


def test_a_change_touches_files_of_its_range(spark, root):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    m.upsert(spark, root, {"a": change(bars(spark)), "other": change(bars(spark))})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    old = {r.path: (r.low, r.high) for r in m.entries(spark, root).collect()}
    m.upsert(spark, root, {"a": change(bars(spark, DAYS[7:8], 9.0, 1))})
    new = {r.path for r in m.entries(spark, root).collect()}
    gone = [p for p in old if p not in new]
    assert len(old) >= 4 and len(gone) == 1 and old[gone[0]][0] <= str(DAYS[7]) <= old[gone[0]][1]
    got = held(spark, root, "a")
    assert len(got) == 80 and [x for x in got if x[2] == 9.0] == [(c, str(DAYS[7]), 9.0) for c in "AB"]
    day = m.read(spark, root, "a", SCHEMA, low=str(DAYS[20]), high=str(DAYS[20]), by="dt")
    assert day.count() == 2 and len(day.inputFiles()) == 1


def test_two_writers_from_one_version(spark, root):
    m.upsert(spark, root, {"a": change(bars(spark))})
    files = m.entries(spark, root)
    assert m.commit(spark, root, 0, files) == 1
    with pytest.raises(m.Conflict):
        m.commit(spark, root, 0, files)
    fs, p = m._at(spark, f"{root}/_versions/{2:010d}")
    fs.create(p, False).close()  # a writer that was lost
    assert m.latest(spark, root) == 1 and len(held(spark, root, "a")) == 80
    with pytest.raises(m.Conflict):
        m.commit(spark, root, 1, files)
    m.abandon(spark, root)
    assert m.commit(spark, root, 1, files) == 2


def rules():
    return {"close": F.col("close") <= 0}


def taken(spark, root, folder, most):
    return runs.run(spark, f"{folder}/in", SCHEMA, root, "bars", f"{folder}/state", rules, ["code", "dt"], "n", "dt", ["code"], most_rejected=most, files_per_batch=2).first()


def test_gate_and_marks_at_the_end_of_a_run(spark, root):
    folder = tempfile.mkdtemp(prefix="spark-")
    bars(spark, DAYS[:10]).repartition(5).write.mode("append").parquet(f"{folder}/in")
    first = taken(spark, root, folder, 0.0)
    assert (first.raw, first.rejected, first.status) == (20, 0, "success")
    marks = lambda: {r.code: str(r.mark) for r in runs.marks(spark, root, "bars", "code string, mark date").collect()}
    shown = lambda **k: sorted((r.code, str(r.dt), r.close) for r in runs.rows(spark, root, "bars", SCHEMA, ["code", "dt"], "n", "dt", **k).collect())
    assert set(marks().values()) == {str(DAYS[9])} and len(shown()) == 20

    # the second run's rejects are spread over its batches; together they are too many
    bars(spark, DAYS[9:14], 5.0, 1).withColumn("close", F.when(F.col("dt") == DAYS[12], -1.0).otherwise(F.col("close"))).repartition(4).write.mode("append").parquet(f"{folder}/in")
    second = taken(spark, root, folder, 0.05)
    assert (second.raw, second.rejected, second.written, second.status) == (10, 2, 0, "failed")
    assert set(marks().values()) == {str(DAYS[9])} and len(shown()) == 20 and runs.rejects(spark, root, "bars").count() == 2

    runs.release(spark, root, "bars", ["code"], "dt")
    assert set(marks().values()) == {str(DAYS[13])} and len(shown()) == 26 and ("A", str(DAYS[9]), 5.0) in shown()
    assert sorted(r.status for r in runs.ledger(spark, root).collect()) == ["failed", "success"]
    assert taken(spark, root, folder, 0.0).status == "empty" and len(shown()) == 26
    assert shown(low=str(DAYS[13])) == [(c, str(DAYS[13]), 5.0) for c in "AB"]


def test_only_files_that_meet_are_put_together(spark, root):
    folder = tempfile.mkdtemp(prefix="spark-")
    for days, close in ((DAYS[:10], 1.0), (DAYS[10:20], 1.0), (DAYS[19:20], 7.0)):
        bars(spark, days, close).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        taken(spark, root, folder, 0.0)
    got = runs.rows(spark, root, "bars", SCHEMA, ["code", "dt"], "n", "dt")
    assert sorted((r.code, str(r.dt)) for r in got.where("close = 7").collect()) == [(c, str(DAYS[19])) for c in "AB"] and got.count() == 40
    early = runs.rows(spark, root, "bars", SCHEMA, ["code", "dt"], "n", "dt", high=str(DAYS[9]))
    plan = early._jdf.queryExecution().toString()
    assert early.count() == 20 and "Window" not in plan  # a replayed day leaves the others alone


def test_gate_of_a_run():
    assert runs.passes(0, 0, 0.0) and not runs.passes(3, 3, 1.0) and runs.passes(100, 1, 0.01) and not runs.passes(100, 2, 0.01)
