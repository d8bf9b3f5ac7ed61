"""The quarantine sink among several writers, and the places of rows in files that are read in splits."""

import os
import tempfile

import pytest

from barloom.sources import manifest as m
from barloom.sources import quarantine as q
from barloom.sources import storage as s


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-") + "/sink"


def rejected(spark, n, rules=("B", "A")):
    return spark.createDataFrame([(f"{i:06d}", float(i), list(rules)) for i in range(n)], "code string, close double, failed_rules array<string>")


def put(spark, root, batch, n, day, **more):
    return q.admit(spark, root, q.sink_rows(rejected(spark, n), batch, "bars", "alpha", day), batch, day, **more)


def test_capacity_age_and_alerts(spark, root):
    assert put(spark, root, "b1", 5, "2020-01-01", capacity=8) == {"batch_id": "b1", "offered": 5, "written": 5, "archived": 0, "pending": 5}
    assert put(spark, root, "b2", 5, "2020-01-02", capacity=8)["pending"] == 10  # room was left when it came
    assert put(spark, root, "b3", 1, "2020-01-03", capacity=8)["written"] == 0
    assert put(spark, root, "b1", 5, "2020-01-03", capacity=80)["written"] == 0  # the same batch again
    assert put(spark, root, "b4", 0, "2020-01-03", capacity=80)["written"] == 0
    report = put(spark, root, "b5", 2, "2020-01-09", capacity=6)
    assert (report["archived"], report["written"], report["pending"]) == (5, 2, 7)
    assert q.waiting(spark, root).count() == 7 and q.archived(spark, root).count() == 5
    row = q.archived(spark, root).where("payload LIKE '%000003%'").first()
    assert row.failed_rules == "A,B" and row.batch_id == "b1" and '"close":3.0' in row.payload
    assert [(r.day, r.n) for r in q.alerts(q.waiting(spark, root), 5).collect()] == [("2020-01-02", 5)]


def test_writers_that_meet_share_the_capacity(spark, root, monkeypatch):
    real, met = m.commit, []

    def commit(spark, at, base, files):
        if not met:  # another writer fills the sink first
            met.append(1)
            assert put(spark, root, "other", 9, "2020-01-01", capacity=8)["written"] == 9
        return real(spark, at, base, files)

    monkeypatch.setattr(m, "commit", commit)
    report = put(spark, root, "mine", 4, "2020-01-01", capacity=8)
    assert report["written"] == 0 and report["pending"] == 9 and q.waiting(spark, root).count() == 9


def test_rows_of_a_split_file_are_numbered_in_its_order(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, rows in (("a", 4000), ("b", 700)):
        with open(os.path.join(folder, f"{name}.csv"), "w") as f:
            f.write("Date,Security,Signal\n" + "".join(f"2020-01-{i % 28 + 1:02d},{i},{name}{i}\n" for i in range(rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = s.numbered_lines(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 4700 and all(r.Signal[1:] == str(r.source_row_id) for r in got)


def test_one_type_is_replaced(spark):
    folder = tempfile.mkdtemp(prefix="spark-")

    def file(name, lines):
        path = os.path.join(folder, name)
        with open(path, "w") as f:
            f.write("Date,Security,Signal,More\n" + "\n".join(lines) + "\n")
        return path

    columns = {"event_date": "Date", "code": "Security", "signal": "Signal"}
    one, two = file("1.csv", ["2020-01-02,1.SZ,up,x", "2020-01-02,1.SZ,up,x", "never,2,up,x"]), file("2.csv", ["never,2,down,", "2020-01-05 10:00:00,3,down,"])
    for path, kind in ((one, "p"), (one, "q"), (two, "q")):
        s.replace_events(spark, path, columns, kind, f"{folder}/events")
    got = sorted((r.event_type, r.code, str(r.event_date), r.source_row_id, r.signal) for r in spark.read.parquet(f"{folder}/events").collect())
    assert got == [("p", "000001", "2020-01-02", 0, "up"), ("p", "000001", "2020-01-02", 1, "up"), ("q", "000003", "2020-01-05", 1, "down")]
    assert len({r.source_key for r in spark.read.parquet(f"{folder}/events").collect()}) == 3
    with pytest.raises(ValueError, match="missing"):
        s.replace_events(spark, one, {"event_date": "Day", "code": "Security"}, "p", f"{folder}/events")
