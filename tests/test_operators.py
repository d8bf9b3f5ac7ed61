"""Operators on small frames that show a rule the tables cannot."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import normalize as n
from barloom.operators import adjust, factors, joins, pit, results, validate
from barloom.sources import storage
from barloom.streaming import ingest

D = datetime.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_asof_takes_the_latest_and_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), ("a", 7, 4)], "code string, t int, id int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("a", 6, None), ("c", 1, 1.0)], "code string, t int, v double")
    assert sorted(rows(joins.asof(left, right, "code", "t", "t", ["v"]).select("id", "v"))) == [(1, 50.0), (2, None), (3, None), (4, None)]


def test_anchor_is_the_latest_factor_not_the_largest(spark):
    days = [D(2026, 1, i) for i in (2, 5, 6)]
    bars = spark.createDataFrame([("x", d, 10.0) for d in days], "code string, dt date, close double")
    f = spark.createDataFrame([("x", d, i, v) for i, (d, v) in enumerate(zip(days, (2.0, 1.0, 1.5), strict=True))], "code string, dt date, time int, adj_factor double")
    got = sorted(rows(adjust.adjust(bars, f, ["close"]).select("dt", "close_front", "close_back")))
    assert [g[1] for g in got] == pytest.approx([40 / 3, 20 / 3, 10]) and [g[2] for g in got] == pytest.approx([10, 5, 7.5])


def test_restore_without_a_factor_fails(spark):
    bars = spark.createDataFrame([("x", D(2026, 1, 2), 10.0)], "code string, dt date, q double")
    none = spark.createDataFrame([], "code string, dt date, time int, adj_factor double")
    with pytest.raises(Exception, match="no factor"):
        adjust.restore(bars, none, "q", "raw").collect()


def test_price_view_decides_by_code(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 9.0), ("b", 3.0, None)], "code string, close double, close_front double")
    assert sorted(rows(pit.price_view(df, "pre", ["close"]).select("code", "close")), key=str) == [("a", 9.0), ("a", None), ("b", 3.0)]
    assert pit.price_view(df, "none", ["close"]) is df


def test_versions_compare_with_the_accepted_value(spark):
    seen = spark.createDataFrame([("k", i, v) for i, v in enumerate((1.0, 1.0 + 9e-7, 1.0 + 1.8e-6, 2.0))], "code string, batch int, v double")
    assert rows(adjust.versions(seen, ["code"], "batch", "v", 1e-6, 0.0)) == [("k", 2.0, 2, 1)]


def test_segments_measure_from_their_first_value():
    assert adjust.segment_series(np.array([1.0, 1.0004, 1.0008, 2.0, 2.0005])).tolist() == [0, 0, 1, 2, 2]


def test_split_bands(spark):
    rows_ = [("a", D(2026, 1, i + 1), 10.0, 10.0 / r) for i, r in enumerate((1.0, 2.002, 1.05, 0.5, 1.0))]
    got = adjust.split_ratio(spark.createDataFrame(rows_, "code string, dt date, close double, pre_close double")).orderBy("dt")
    assert [(r.kind, r.applied) for r in got.collect()] == [("split", 2.0), ("cash", 1.0), ("merge", 0.5), ("none", 1.0)]


def test_rank_variants(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 2.0, None)] + [(2, 5.0)], "dt int, x double")
    got = df.withColumns({"a": factors.rank_average("x"), "l": factors.rank_last("x"), "b": factors.rank_below("x")}).collect()
    by = {(r.dt, r.x): (r.a, r.l, r.b) for r in got}
    assert by[1, 1.0] == pytest.approx((1 / 3, 0, 0)) and by[1, 2.0] == pytest.approx((2.5 / 3, 100, 0.5))
    assert by[1, None] == (0, 50, None) and by[2, 5.0] == (1, 50, 1)


def test_buffer_keeps_holders(spark):
    ranked = spark.createDataFrame([(1, f"c{i}", i) for i in range(1, 9)], "dt int, code string, place int")
    holders = spark.createDataFrame([(1, "c4"), (1, "c8")], "dt int, code string")
    assert sorted(r.code for r in factors.buffered(ranked, holders, 5, 3).collect()) == ["c1", "c2", "c4"]


def test_all_rules_are_reported(spark):
    df = spark.createDataFrame([("12345X", 1, 5.0, 4.0, 6.0, 5.5, 1.0, 1.0, "alpha"), ("123456", 1, 5.0, 6.0, 4.0, 5.5, 2.0, 11.0, "beta")], "code string, time long, open double, high double, low double, close double, volume double, amount double, data_source string")
    judged = validate.judge(df, validate.bar_rules(), {"CodeFormat": "code"})
    passed, rejected = validate.split(judged)
    assert passed.count() == 1 and set(rejected.first().failed_rules) == {"CodeFormat", "OHLCLogic", "UnitCheck"}
    assert rejected.first().error_values[0].value == "12345X"
    assert rows(validate.gate(judged, 0.5)) == [(2, 1, 1, True)]
    assert validate.gate(judged.limit(0)).first().ok


def test_duplicates_by_flag(spark):
    df = spark.createDataFrame([("a", 0, 1, None), ("a", 1, 2, 3), ("a", 2, 3, 3), ("b", 3, 4, None), ("b", 4, 5, None)], "code string, pos int, v int, flag int")
    assert sorted(rows(validate.fix_duplicates(df, ["code"], "pos", "flag").select("code", "v"))) == [("a", 2), ("b", 4)]
    assert sorted(rows(validate.fix_duplicates(df, ["code"], "pos").select("code", "v"))) == [("a", 3), ("b", 5)]


def test_times_and_codes(spark):
    df = spark.createDataFrame([("20240102",), ("1704124800",), ("1704124800000",), ("2024-01-02",), ("junk",), ("7",)], "v string")
    assert [r[0] for r in df.select(n.to_ms(F.col("v"))).collect()] == [1704124800000, 1704124800000, 1704124800000, 1704124800000, None, 7]
    assert n.ms_to_day(F.lit(1704124800000)) is not None
    assert rows(spark.range(1).select(n.ms_to_day(F.lit(1704124800000 - 1)), n.ms_to_day(F.lit(1704124800000)))) == [("2024-01-01", "2024-01-02")]
    codes = spark.createDataFrame([("600000.SH",), ("sz.000001",), ("x600001y",), ("no",), (None,)], "c string")
    assert [r[0] for r in codes.select(n.normalize_code(F.col("c"), "baostock_to_raw")).collect()] == ["600000", "000001", "600001", None, None]
    with pytest.raises(Exception, match="unknown exchange"):
        spark.range(1).select(n.to_suffixed(F.lit("600000.XX"))).collect()


def test_round_trips_and_costs(spark):
    t = spark.createDataFrame([(D(2024, 1, 2), "a", "buy", 10.0, 100.0, 1), (D(2024, 1, 3), "a", "buy", 11.0, 100.0, 1), (D(2024, 1, 4), "a", "sell", 12.0, 100.0, 1)], "dt date, code string, action string, price double, volume double, i int")
    assert rows(results.round_trips(t, ["i"]).select("profit")) == [(200.0,)]
    assert rows(results.cost_position_wins(t, ["i"])) == [("a", 1, 1)]
    got = t.withColumns(results.trade_cost(F.col("price"), F.col("volume"), F.col("action"), F.col("dt"))).collect()
    assert got[0].filled == 10.01 and got[0].fee == pytest.approx(5 + 1001 * 1e-5) and got[2].fee == pytest.approx(5 + 1199 * 5e-4 + 1199 * 1e-5)


def test_upsert_and_snapshot_diff(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None)], "code string, seq int, v double")
    new = spark.createDataFrame([("b", 2, None), ("b", 3, 5.0), ("c", 2, 7.0)], "code string, seq int, v double")
    assert sorted(rows(storage.upsert(old, new, ["code"], "seq"))) == [("a", 1, 1.0), ("b", 3, 5.0), ("c", 2, 7.0)]
    assert rows(storage.upsert_counts(old, new, ["code"])) == [(1, 1)]
    assert sorted(rows(storage.changed_rows(old, new, ["code"], ["seq"]))) == [("b", 3, 5.0), ("c", 2, 7.0)]


def test_export_with_a_wrong_header_fails(spark, tmp_path):
    spark.createDataFrame([("1", "2")], "a string, b string").write.option("header", "true").csv(f"{tmp_path}/x")
    with pytest.raises(ValueError):
        storage.read_export(spark, f"{tmp_path}/x", ["a", "c"], "a string, c string", "UTF-8")


def test_stream_takes_each_file_once_and_replays_to_the_same_table(spark, tmp_path):
    schema = "code string, time long, open double, high double, low double, close double, volume double, amount double, data_source string, copy int"
    make = lambda c, k, v: (c, 1, v, v, v, v, 1.0, v, "alpha", k)
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([make("000001", 0, 1.0), make("00000X", 0, 1.0)], schema).coalesce(1).write.parquet(source)
    ingest.ingest(spark, source, schema, target, f"{tmp_path}/state", validate.bar_rules)
    spark.createDataFrame([make("000001", 1, 2.0), make("000002", 0, 3.0)], schema).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(spark, source, schema, target, f"{tmp_path}/state", validate.bar_rules)
    assert sorted(rows(ingest.read_table(spark, target, ["code"], "copy").select("code", "close"))) == [("000001", 2.0), ("000002", 3.0)]
    assert spark.read.parquet(f"{target}/rejected").count() == 1 and spark.read.parquet(f"{target}/rows").count() == 3
    ingest.compact(spark, target, ["code"], "copy", f"{tmp_path}/compact")
    assert ingest.read_table(spark, f"{tmp_path}/compact", ["code"], "copy").count() == 2


def test_round_trips_equal_the_queue(spark):
    rng = np.random.default_rng(1)
    made = [(D(2024, 1, 1) + datetime.timedelta(int(d)), f"c{rng.integers(3)}", str(rng.choice(["buy", "sell"])), float(rng.integers(1, 50)), 100.0, i) for i, d in enumerate(np.sort(rng.integers(0, 90, 300)))]
    queue, due = {}, []
    for day, code, action, price, volume, _ in made:
        if action == "buy":
            queue.setdefault(code, []).append((day, price))
        elif queue.get(code):
            bought, paid = queue[code].pop(0)
            due.append((code, bought, day, (price - paid) * volume))
    t = spark.createDataFrame(made, "dt date, code string, action string, price double, volume double, i int")
    got = results.round_trips(t, ["i"]).select("code", "buy_day", "sell_day", "profit")
    assert sorted(rows(got)) == sorted(due)


def test_costs_are_carried_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = [(D(2024, 1, 1 + i), c, "buy" if i % 3 < 2 else "sell", 10.0 + i, 100.0, i) for c in "ab" for i in range(20)]
        t = spark.createDataFrame(made, "dt date, code string, action string, price double, volume double, i int")
        assert sorted(rows(results.cost_position_wins(t, ["i"]))) == [("a", 6, 6), ("b", 6, 6)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("block", [128, 2])
def test_covariance_equals_numpy_over_the_trimmed_series(spark, block):
    rng = np.random.default_rng(2)
    series = {f"c{i}": rng.normal(size=n) for i, n in enumerate((30, 25, 28, 40, 26))}
    made = [(c, D(2024, 1, 1) + datetime.timedelta(i), float(x)) for c, v in series.items() for i, x in enumerate(v)]
    got = factors.covariance(spark.createDataFrame(made, "code string, dt date, r double"), block).collect()
    last = np.stack([v[-25:] for v in series.values()])
    due = np.cov(last)
    assert len(got) == 15
    for r in got:
        i, j = int(r.code_a[1]), int(r.code_b[1])
        assert i <= j and r.n == 25 and abs(r.cov - due[i, j]) < 1e-12 and abs(r.mean_a - last[i].mean()) < 1e-12


@pytest.mark.parametrize("days", [1, 7, 91])
def test_overlaps_equal_all_pairs(spark, days):
    rng = np.random.default_rng(3)
    made = []
    for i in range(120):
        start = D(2024, 1, 1) + datetime.timedelta(int(rng.integers(0, 200)))
        made.append((f"c{rng.integers(4)}", i, str(rng.integers(3)), start, None if rng.random() < 0.1 else start + datetime.timedelta(int(rng.integers(-3, 40)))))
    got = joins.overlaps(spark.createDataFrame(made, "code string, id int, label string, from_day date, to_day date"), "code", "id", "label", days=days)
    far, due = D(9999, 12, 31), []
    for x in made:
        for y in made:
            if x[0] == y[0] and x[1] < y[1] and max(x[3], y[3]) <= min(x[4] or far, y[4] or far):
                due.append((x[0], x[1], y[1], "positive" if max(x[3], y[3]) < min(x[4] or far, y[4] or far) else "touch", x[2] != y[2]))
    assert sorted(rows(got)) == sorted(due)


def test_stop_and_reverse_lines():
    from barloom.operators import recursive

    up = np.arange(1.0, 41)
    line = recursive.parabolic(up + 1, up, 4)
    assert np.isnan(line[:4]).all() and (line[4:] < up[4:]).all() and (np.diff(line[4:]) > 0).all()
    both = np.concatenate([up, up[::-1]])
    bounded = recursive.parabolic_bounded(both + 1, both)
    assert (bounded[:40] <= both[:40]).all() and (bounded[-5:] > both[-5:]).all()
    assert np.allclose(recursive.parabolic_bounded(-both, -both - 1)[1:], -recursive.parabolic_bounded(both + 1, both)[1:], atol=3) and len(recursive.parabolic(up[:3], up[:3])) == 3


def test_purge_is_undone_where_keys_differ(spark):
    from barloom.operators import audit

    t = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "x")], "code string, dt int, src string")
    due = spark.createDataFrame([("a", 1), ("c", 1)], "code string, dt int")
    table, report = audit.purge(t, "src", "x", due, ["code", "dt"])
    assert table.count() == 2 and report.first().done
    table, report = audit.purge(t, "src", "x", due.where("code = 'a'"), ["code", "dt"])
    assert table.count() == 3 and not report.first().done and report.first().extra == 1


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([("a", 1, 0, 1995), ("b", 1, 0, 1996)], "code string, v int, i int, year int").write.partitionBy("year").parquet(path)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "year=1995").iterdir()}
    storage.upsert_partitions(spark, path, spark.createDataFrame([("b", 2, 1, 1996), ("c", 3, 1, 1997)], "code string, v int, i int, year int"), ["code"], "i", "year")
    assert sorted(rows(spark.read.parquet(path).select("code", "v"))) == [("a", 1), ("b", 2), ("c", 3)]
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "year=1995").iterdir()}


def test_a_price_without_factor_stops_the_second_pass(spark, tmp_path):
    spark.createDataFrame([("a", D(2024, 1, 2), 2.0)], "code string, dt date, adj_factor double").write.parquet(f"{tmp_path}/f")
    spark.createDataFrame([("a", 3.0), ("b", 1.0)], "code string, close double").write.parquet(f"{tmp_path}/p")
    with pytest.raises(Exception, match="no factor"):
        ingest.two_pass(spark, f"{tmp_path}/f", f"{tmp_path}/p", f"{tmp_path}/out", f"{tmp_path}/state")
