"""Holdings carried from trades, and moving averages in two levels, against their plain definitions."""

import random

import numpy as np
import pandas as pd
import pytest

from barloom.operators import adjust, affine, results
from barloom.operators import validate as v


def brute_overlap(left, right):
    """Day by day: sets of held codes."""
    days = sorted({d for d, _, _, _ in left} | {d for d, _, _, _ in right})
    since, out, sets = min((d for d, _, _, _ in right), default=None), [], [set(), set()]
    for day in days:
        for held, side in zip(sets, (left, right), strict=True):
            for _, code, action, _ in sorted((t for t in side if t[0] == day), key=lambda t: t[3]):
                (held.add if action == "buy" else held.discard)(code)
        if any(t[0] == day for t in left) and since is not None and day >= since and sets[0] | sets[1]:
            out.append((day, len(sets[0] & sets[1]), len(sets[0] | sets[1])))
    return out


def test_carried_holdings_equal_the_days_one_by_one(spark):
    random.seed(4)
    schema = "dt string, code string, action string, n int"
    for rows in (40, 200):
        sides = [[(f"d{random.randint(10, 40)}", random.choice("ABCDE"), random.choice(["buy", "sell"]), i) for i in range(rows)] for _ in "lr"]
        sides[1] = [t for t in sides[1] if t[0] > "d14"]
        left, right = (spark.createDataFrame(s, schema) for s in sides)
        got = sorted((r.dt, r.common, r.either) for r in results.carried_overlap(left, right, ["n"]).collect())
        assert got == brute_overlap(*sides) and got
    assert results.carried_overlap(left, right.limit(0), ["n"]).collect() == []


@pytest.mark.parametrize("n", [1, 1.5, 2, 12, 300])
def test_averages_in_two_levels(spark, n):
    rng = np.random.default_rng(5)
    rows = [(c, i, None if c == "B" and i % 7 in (0, 3) else float(x)) for c, k in (("A", 700), ("B", 150), ("C", 1)) for i, x in enumerate(rng.normal(100, 5, k))] + [("D", 0, None)]
    got = affine.ema(spark.createDataFrame(rows, "code string, dt int, x double").withColumn("_keep", affine.F.lit(1)), "x", n, "y").toPandas().sort_values(["code", "dt"])
    for _, some in got.groupby("code"):
        due = pd.Series(some["x"].to_numpy(float)).ewm(span=n, adjust=False, ignore_na=True).mean().to_numpy()
        assert np.allclose(some["y"].to_numpy(float), due, rtol=1e-10, equal_nan=True)
    assert affine.block_rows(2 / 3) < affine.BLOCK or n > 2


def test_a_day_before_all_days_is_no_date(spark):
    rows = spark.createDataFrame([(-5,), (0,), (1,), (5 * 10**12,), (None,)], "time long")
    assert [r.bad for r in rows.select(v.bar_rules()["DateValid"].alias("bad")).collect()] == [True, True, False, True, True]


def test_ratios_that_must_not_be_applied(spark):
    days = [f"2020-01-{d:02d}" for d in range(1, 11)]
    stored = {c: [1.0] * 10 for c in "ABCDEFG"}
    staged = {"A": [1.0] * 10, "B": [1.0] * 4 + [None] + [1.0] * 5, "C": [1.2] * 5 + [1.5] * 5, "D": [1.0, 1.0004, 0.9996] + [1.0] * 7, "E": [1.2] * 10, "F": [float("nan")] + [1.0] * 9, "G": []}
    rows = lambda of: spark.createDataFrame([(c, d, v) for c, vs in of.items() for d, v in zip(days, vs, strict=False)], "code string, dt string, value double").selectExpr("code", "CAST(dt AS date) AS dt", "value")
    new = rows(staged).where("NOT (code = 'A' AND dt = '2020-01-05')")  # a gap within the span; days after it are none
    got = {r.code: r.reason for r in adjust.segment_refusals(rows(stored), new).collect()}
    assert got == {"A": "gap", "B": "bad_value", "C": "several", "D": "dispersion", "F": "bad_value"}
    assert {r.code for r in adjust.segment_refusals(rows(stored), new, several=True).collect()} == {"A", "B", "D", "F"}


def test_no_factor_at_all_is_an_error_in_strict_mode(spark):
    bars = spark.createDataFrame([("A", 1, 2.0), ("B", 1, 2.0), ("A", 2, 2.0)], "code string, dt int, close double")
    factors = spark.createDataFrame([("A", 1, 1, 1.5)], "code string, dt int, time int, adj_factor double")
    assert {(r.code, r.reason) for r in adjust.lacking_anchors(bars, factors).collect()} == {("A", "no_factor"), ("B", "no_anchor")}
    assert adjust.adjust(bars, factors, ["close"]).where("close_front IS NULL").count() == 2
    with pytest.raises(Exception, match="no factor at all for B"):
        adjust.adjust(bars, factors, ["close"], strict=True).collect()
