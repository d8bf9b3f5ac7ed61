"""Queries against their DuckDB SQL on small tables with codes, times and sums that the given ones lack."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_queries import ORACLES, QUERIES, normal

LINE = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP"
EVENT = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR"


def tables(folder, **rows):
    """Parquet files of ``lineitem`` and ``events``; a connection that sees them."""
    con = duckdb.connect()
    for name, schema in (("lineitem", LINE), ("events", EVENT)):
        con.execute(f"CREATE TABLE {name} ({schema})")
        if rows.get(name):
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (schema.count(',') + 1))})", rows[name])
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return con


def agree(spark, folder, con, name):
    assert normal(QUERIES[name](spark, str(folder)).toPandas()) == normal(con.execute(ORACLES[name]).fetchdf())


def line(i, supplier, day, price=100.0):
    return (i, i, supplier, 1, 2.0, price, 0.0, 0.0, "N", "O", datetime.datetime(1997, 1, 1) + datetime.timedelta(day))


def test_codes_from_900_have_bars(spark, tmp_path):
    con = tables(tmp_path, lineitem=[line(i, c, i % 3) for i, c in enumerate([1, 2, 3, 4, 7, 900, 901, 903, 904] * 3)])
    agree(spark, tmp_path, con, "J18_proxy")


@pytest.mark.parametrize("name", ["A23_sample_bars", "N5_cloud_time", "P6_minute_range", "P6_minute_view", "P7_last_n_minutes", "Q9_minute_grid", "V10_frequency", "V10_frequency_labels", "N22_session", "P8_exclusive_cutoff", "A6_daily_factor"])
def test_minutes_before_1970_and_without_values(spark, tmp_path, name):
    pick = random.Random(3)
    start = {0: datetime.datetime(1969, 12, 20), 1: datetime.datetime(1970, 1, 1), 2: datetime.datetime(1931, 5, 5)}
    rows = []
    for i in range(900):
        minute = 569 + pick.randrange(5) if i % 4 == 0 else pick.randrange(1440)
        at = start[i % 3] + datetime.timedelta(pick.randrange(9), 60 * minute + pick.choice([0, 30, 59]), pick.choice([0, 499, 999_999]))
        rows.append((i, at, pick.randrange(24), "view", None if i % 7 == 0 else pick.randrange(10_000) / 100, "{}"))
    agree(spark, tmp_path, tables(tmp_path, events=rows), name)


def test_quarantine_is_marked_as_it_was_stored(spark, monkeypatch):
    """Rejected rows whose last digits differ each time they are computed, as sums of doubles do."""
    from barloom.queries import storage

    digit = F.udf(lambda _: random.SystemRandom().random(), T.DoubleType()).asNondeterministic()
    monkeypatch.setattr(storage, "rejected", lambda spark, sf: spark.range(40).select(digit("id").alias("amount"), F.array(F.when(F.col("id") % 2 == 0, "UnitCheck").otherwise("InfCheck")).alias("failed_rules")))
    assert {r["status"]: r["n"] for r in storage.s13(spark, "").collect()} == {"fixed": 20, "pending_repair": 20}


def test_a_code_is_one_file_of_an_export(spark, tmp_path):
    from barloom.sources import storage

    rows = spark.range(0, 400, 1, 8).select(F.concat(F.lit("00000"), F.col("id") % 5).alias("code"), "id")
    storage.export_by_code(rows, f"{tmp_path}/out")
    assert len(list(tmp_path.glob("out/*/*/*/*.parquet"))) == 5
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(400))


def test_observations_are_not_shuffled_by_batch(spark):
    import re

    from barloom.operators import revisions

    rows = [(f"c{i % 3}", f"2024-01-{1 + i % 28:02}", i // 28, 1.0 + i % 5) for i in range(84)]
    plan = revisions.observe(spark.createDataFrame(rows, "code string, dt string, batch long, value double"))._jdf.queryExecution().executedPlan().toString()
    assert {re.sub(r"#\d+", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)} <= {"code", "code, dt"}


def test_factors_are_read_once_for_all_batches(spark, tmp_path):
    from barloom.queries import revisions

    tables(tmp_path, lineitem=[line(i, i % 3, i % 40) for i in range(60)])
    plan = revisions.observed(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_covariance_in_few_blocks_and_strips(spark, monkeypatch):
    import numpy as np

    from barloom.operators import factors

    monkeypatch.setattr(factors, "BLOCKS", 3)
    monkeypatch.setattr(factors, "PAIRS", 4)
    series = {f"c{i}": np.random.default_rng(i).normal(size=8) for i in range(9)}
    made = [(c, datetime.date(2024, 1, 1 + i), float(x)) for c, v in series.items() for i, x in enumerate(v)]
    out = factors.covariance(spark.createDataFrame(made, "code string, dt date, r double"), 1)
    assert "sequence(0, 2" in out._jdf.queryExecution().analyzed().toString()  # a series goes to three tasks, not to nine
    due = np.cov(np.stack(list(series.values())))
    got = {(r.code_a, r.code_b): r.cov for r in out.collect()}
    assert len(got) == 45 and all(abs(v - due[int(a[1]), int(b[1])]) < 1e-12 for (a, b), v in got.items())
