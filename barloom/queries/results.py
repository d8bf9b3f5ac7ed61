"""Queries of results, costs and ledgers (M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import results as r
from ..operators.indicators import S
from ..plans.views import TIE, bars, nav, oracle, trades
from .registry import query, rnd, roll, rsql, shown, shown_sql

C = F.col
ORDER = list(TIE)
CURVE = "SELECT dt, nav, bench, nav / coalesce(lag(nav) OVER (ORDER BY dt), 1) - 1 AS r, bench / coalesce(lag(bench) OVER (ORDER BY dt), 1) - 1 AS rb FROM nav"
SUMS = """SELECT *, pow(1 + total, 250.0 / n) - 1 AS annual, pow(1 + total_b, 250.0 / n) - 1 AS annual_b, sqrt(250.0 / bdays * var * n) AS volatility, cov / nullif(var_b, 0) AS beta, sqrt(250.0 / n * down2) AS downside FROM (
    SELECT count(*) AS n, arg_max(nav, dt) - 1 AS total, min(nav / top - 1) AS drawdown, avg(r) AS mean, var_pop(r) AS var, sum(least(r, 0) * least(r, 0)) AS down2, covar_samp(r, rb) AS cov, var_pop(rb) AS var_b, arg_max(bench, dt) - 1 AS total_b,
    avg(r - rb) AS excess, stddev_pop(r - rb) AS excess_sd, avg((r > 0)::INTEGER) AS win_rate, len(list_filter(range(min(dt)::TIMESTAMP, max(dt)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) <= 5)) AS bdays
    FROM (SELECT *, max(nav) OVER (ORDER BY dt) AS top FROM c))"""


def curve(spark, sf):
    return r.curve(nav(spark, sf))


def m(name: str, *columns: str, where: str = "", sql: dict[str, str] | None = None) -> None:
    parts = [f"{rsql((sql or {}).get(c, c))} AS {c}" for c in columns]

    @query(name, oracle(f"SELECT {', '.join(parts)} FROM s", "nav", c=CURVE, s=SUMS))
    def run(spark, sf):
        return r.summary(curve(spark, sf)).select(*[rnd(C(c).cast("double")).alias(c) for c in columns])


@query("M1_curve", oracle(shown_sql("c", "nav", "r", "rb", keys=("dt",)), "nav", c=CURVE))
def m1(spark, sf):
    return shown(curve(spark, sf), "nav", "r", "rb", keys=("dt",))


m("M2_returns", "total", "annual")
m("M3_drawdown", "drawdown")
m("M4_volatility_sharpe", "volatility", "sharpe", sql={"sharpe": "(annual - 0.03) / nullif(volatility, 0)"})
m("M5_sortino", "downside", "sortino", sql={"sortino": "(annual - 0.03) / nullif(downside, 0)"})
m("M6_beta_alpha", "beta", "alpha", sql={"alpha": "annual - (0.03 + beta * (annual_b - 0.03))"})
m("M7_information", "information", "win_rate", sql={"information": "excess / nullif(excess_sd, 0) * sqrt(250.0)"})

TIES = ", ".join(TIE)
SO_FAR = f"OVER (PARTITION BY code ORDER BY dt, {TIES} ROWS UNBOUNDED PRECEDING)"
#: One window gives the running counts; a sell that finds nothing open is left out, and the others take buys in order.
TRIPS = {
    "t": "SELECT DISTINCT * FROM trades",
    "s": f"SELECT *, sum(CASE WHEN action = 'buy' THEN 1 ELSE -1 END) {SO_FAR} AS open, sum((action = 'buy')::INTEGER) {SO_FAR} AS buys, sum((action = 'sell')::INTEGER) {SO_FAR} AS sells FROM t",
    "n": f"SELECT *, greatest(0, -min(open) {SO_FAR}) AS missed, greatest(0, -coalesce(min(open) OVER (PARTITION BY code ORDER BY dt, {TIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM s",
    "p": "SELECT code, k::BIGINT AS k, b.dt AS buy_day, s.dt AS sell_day, (s.price - b.price) * s.volume AS profit FROM (SELECT *, buys AS k FROM n WHERE action = 'buy') b JOIN (SELECT *, sells - missed AS k FROM n WHERE action = 'sell' AND missed <= before) s USING (code, k)",
}
HOLD = ("t", "s", "n", "p")
COST_SQL = {
    "b": f"SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt, {TIES}) AS rn FROM t",
    "r": """SELECT code, rn, CASE WHEN action = 'buy' THEN volume ELSE 0 END::DOUBLE AS held, CASE WHEN action = 'buy' THEN price ELSE 0 END::DOUBLE AS cost, 0 AS sells, 0 AS wins FROM b WHERE rn = 1 UNION ALL
        SELECT b.code, b.rn, CASE WHEN b.action = 'buy' THEN held + b.volume ELSE greatest(0, held - b.volume) END, CASE WHEN b.action = 'buy' THEN (cost * held + b.price * b.volume) / (held + b.volume) ELSE cost END,
        sells + (b.action = 'sell' AND held > 0)::INTEGER, wins + (b.action = 'sell' AND held > 0 AND b.price > cost)::INTEGER FROM r JOIN b ON b.code = r.code AND b.rn = r.rn + 1""",
}


def distinct_trades(spark, sf):
    return trades(spark, sf).distinct()


@query("M8_trade_statistics", oracle(f"SELECT count(*) AS n, count(*) FILTER (profit > 0) AS wins, count(*) FILTER (profit < 0) AS losses, {rsql('sum(CASE WHEN profit > 0 THEN profit ELSE 0 END) / nullif(sum(CASE WHEN profit < 0 THEN -profit ELSE 0 END), 0)')} AS profit_factor FROM p", "trades", hold=HOLD, **TRIPS))
def m8(spark, sf):
    return r.trade_statistics(r.round_trips(distinct_trades(spark, sf), ORDER)).select("n", "wins", "losses", rnd("profit_factor").alias("profit_factor"))


@query("M9_round_trips", oracle(f"SELECT code, k, buy_day::VARCHAR AS buy_day, sell_day::VARCHAR AS sell_day, {rsql('profit', 2)} AS profit FROM p", "trades", hold=HOLD, **TRIPS))
def m9(spark, sf):
    got = r.round_trips(distinct_trades(spark, sf), ORDER)
    return got.select("code", "k", C("buy_day").cast("string").alias("buy_day"), C("sell_day").cast("string").alias("sell_day"), rnd("profit", 2).alias("profit"))


@query("M10_cost_wins", oracle("SELECT code, arg_max(sells, rn)::BIGINT AS sells, arg_max(wins, rn)::BIGINT AS wins FROM r GROUP BY code", "trades", recursive=True, hold=("t", "b"), t=TRIPS["t"], **COST_SQL))
def m10(spark, sf):
    return r.cost_position_wins(distinct_trades(spark, sf), ORDER)


MONTHS = ", ".join(f"{rsql(f'exp(sum(ln(1 + r)) FILTER (month(dt) = {i})) - 1')} AS m{i}" for i in range(1, 13))


@query("M11_monthly", oracle(f"SELECT year(dt) AS year, {MONTHS} FROM c GROUP BY 1", "nav", c=CURVE))
def m11(spark, sf):
    return r.monthly(curve(spark, sf)).select("year", *[rnd(str(i)).alias(f"m{i}") for i in range(1, 13)])


OVER30 = "OVER (ORDER BY dt ROWS 29 PRECEDING)"


@query("M12_rolling_risk", oracle(f"SELECT dt::VARCHAR AS dt, CASE WHEN n = 30 THEN {rsql('a / nullif(s, 0) * sqrt(252)', 4)} END AS sharpe, CASE WHEN n = 30 THEN {rsql('s * sqrt(252)')} END AS vol, CASE WHEN n = 30 THEN {rsql('list_min(list_transform(l, lambda v, i: v / list_max(l[1:i]) - 1))')} END AS dd FROM (SELECT dt, count(r) {OVER30} AS n, avg(r) {OVER30} AS a, stddev_samp(r) {OVER30} AS s, list(nav) {OVER30} AS l FROM c)", "nav", c=CURVE))
def m12(spark, sf):
    got = r.rolling_risk(curve(spark, sf), 30)
    return got.select(C("dt").cast("string").alias("dt"), rnd("sharpe", 4).alias("sharpe"), rnd("vol").alias("vol"), rnd("dd").alias("dd"))


@query("M13_histogram", oracle("SELECT least(floor((r - lo) / (hi - lo) * bins), bins - 1)::INTEGER AS bin, count(*) AS n FROM c, (SELECT min(r) AS lo, max(r) AS hi, least(50, floor(count(r) / 2) + 1) AS bins FROM c) GROUP BY 1", "nav", c=CURVE))
def m13(spark, sf):
    return r.histogram(curve(spark, sf))


@query("M14_chart_means", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql(roll('avg', 'close', 5))} AS m5, {rsql(roll('avg', 'close', 10))} AS m10 FROM bars", "bars"))
def m14(spark, sf):
    return shown(bars(spark, sf).withColumns({"m5": S.ma("close", 5), "m10": S.ma("close", 10)}), "m5", "m10")


COST = """SELECT *, filled * volume AS amount, greatest(filled * volume * 0.00025, 5) + CASE WHEN action = 'buy' THEN 0 ELSE filled * volume * 0.001 END + filled * volume * 0.00001 AS fee FROM (
    SELECT *, round(price * CASE WHEN action = 'buy' THEN 1.001::DOUBLE ELSE 0.999::DOUBLE END + 1e-9, 2) AS filled FROM trades)"""


def costed(spark, sf):
    t = trades(spark, sf)
    t = t.withColumns(r.trade_cost(C("price"), C("volume"), C("action"), C("dt")))
    return t.withColumn("amount", C("filled") * C("volume"))


@query("M15_trade_cost", oracle(f"SELECT code, action, count(*) AS n, {rsql('sum(fee)', 2)} AS fee, {rsql('sum(amount)', 2)} AS amount FROM c GROUP BY 1, 2", "trades", c=COST))
def m15(spark, sf):
    return costed(spark, sf).groupBy("code", "action").agg(F.count("*").alias("n"), rnd(F.sum("fee"), 2).alias("fee"), rnd(F.sum("amount"), 2).alias("amount"))


@query("M15_tick_slip", oracle(f"SELECT code, action, count(*) AS n, {rsql('sum(filled)', 2)} AS filled, {rsql('sum(greatest(filled * volume * 0.00025, 5) + filled * volume * 0.00001)', 2)} AS fee_without_stamp FROM (SELECT *, round(price + CASE WHEN action = 'buy' THEN 0.03 ELSE -0.03 END::DOUBLE + 1e-9, 2) AS filled FROM trades) GROUP BY 1, 2", "trades"))
def m15_ticks(spark, sf):
    t = trades(spark, sf)
    made = r.trade_cost(C("price"), C("volume"), C("action"), C("dt"), ticks=3)
    t = t.withColumns(made).withColumn("free", C("fee") - F.when(C("action") == "buy", 0.0).otherwise(C("filled") * C("volume") * r.stamp_rate(C("dt"))))
    return t.groupBy("code", "action").agg(F.count("*").alias("n"), rnd(F.sum("filled"), 2).alias("filled"), rnd(F.sum("free"), 2).alias("fee_without_stamp"))


@query("M16_stamp_rate", oracle("SELECT dt::VARCHAR AS dt, CASE WHEN dt + 10000 >= DATE '2023-08-28' THEN 0.0005::DOUBLE ELSE 0.001::DOUBLE END AS rate FROM (SELECT DISTINCT dt FROM bars)", "bars"))
def m16(spark, sf):
    return bars(spark, sf).select("dt").distinct().select(C("dt").cast("string").alias("dt"), r.stamp_rate(F.date_add("dt", 10000)).alias("rate"))


@query("M17_nav_from_trades", oracle(f"SELECT dt::VARCHAR AS dt, {rsql('1e9 - coalesce(sum(out) OVER (ORDER BY dt), 0) + coalesce(held, 0)', 0)} AS nav FROM (SELECT dt, sum(CASE WHEN action = 'buy' THEN amount ELSE -amount END + fee) AS out FROM c GROUP BY 1) a FULL JOIN (SELECT dt, sum(amount) AS held FROM bars WHERE k % 2 = 0 GROUP BY 1) b USING (dt)", "bars", "trades", c=COST))
def m17(spark, sf):
    held = bars(spark, sf).where("k % 2 = 0").select("dt", C("amount").alias("value"))
    return shown(r.nav_from_trades(costed(spark, sf), held, 1e9), "nav", digits=0, keys=("dt",))


@query("M18_turnover", oracle(f"SELECT count(*) AS days, {rsql('avg(amount / held)')} AS turnover, {rsql('sum(greatest(amount * 0.00025, 5))', 2)} AS friction, {rsql('avg((held > 1e6)::INTEGER)')} AS occupied FROM (SELECT dt, sum(amount) AS amount FROM c GROUP BY 1) JOIN (SELECT dt, sum(amount) AS held FROM bars GROUP BY 1) USING (dt)", "bars", "trades", c=COST))
def m18(spark, sf):
    got = r.occupancy(costed(spark, sf), bars(spark, sf).select("dt", C("amount").alias("held")), C("held") > 1e6)
    return got.select("days", rnd("turnover").alias("turnover"), rnd("friction", 2).alias("friction"), rnd("occupied").alias("occupied"))


def runs(spark, sf):
    t = costed(spark, sf)
    return t.where("l_partkey % 5 > 0"), t.where("l_partkey % 7 > 0")


LR = {"c": COST, "l": "SELECT * FROM c WHERE l_partkey % 5 > 0", "r": "SELECT * FROM c WHERE l_partkey % 7 > 0"}
KEY = "SELECT DISTINCT dt, code, action"


@query("M19_signal_agreement", oracle(f"SELECT count(*) FILTER (a AND b) AS common, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, {rsql('count(*) FILTER (a AND b) / count(*)')} AS jaccard FROM ({KEY}, true AS a FROM l) FULL JOIN ({KEY}, true AS b FROM r) USING (dt, code, action)", "trades", **LR))
def m19(spark, sf):
    a, b = runs(spark, sf)
    return r.agreement(a, b, ["dt", "code", "action"]).withColumn("jaccard", rnd("jaccard"))


@query("M19_signal_details", oracle("SELECT dt::VARCHAR AS dt, code, action, CASE WHEN a IS NULL THEN 'right_only' ELSE 'left_only' END AS side FROM (SELECT DISTINCT dt, code, action, true AS a FROM l) FULL JOIN (SELECT DISTINCT dt, code, action, true AS b FROM r) USING (dt, code, action) WHERE a IS NULL OR b IS NULL", "trades", **LR))
def m19_details(spark, sf):
    got = r.differences(*runs(spark, sf), ["dt", "code", "action"]).where("side <> 'both'")
    return got.select(C("dt").cast("string").alias("dt"), "code", "action", "side")


GAPS = """SELECT count(*) AS days, abs(arg_max(l, dt) - arg_max(r, dt)) AS end_gap, abs(min(l / tl - 1) - min(r / tr - 1)) AS drawdown_gap, abs(avg(rl) / stddev_samp(rl) - avg(rr) / stddev_samp(rr)) * sqrt(252) AS sharpe_gap FROM (
    SELECT *, max(l) OVER (ORDER BY dt) AS tl, max(r) OVER (ORDER BY dt) AS tr, l / lag(l) OVER (ORDER BY dt) - 1 AS rl, r / lag(r) OVER (ORDER BY dt) - 1 AS rr FROM (SELECT dt, nav / first_value(nav) OVER (ORDER BY dt) AS l, bench / first_value(bench) OVER (ORDER BY dt) AS r FROM nav))"""


@query("M20_performance_gap", oracle(f"SELECT days, {rsql('end_gap')} AS end_gap, {rsql('drawdown_gap')} AS drawdown_gap, {rsql('sharpe_gap')} AS sharpe_gap, ok, NOT ok AND (end_gap < 0.04 OR drawdown_gap < 0.04 OR sharpe_gap < 0.4) AS near_miss FROM (SELECT *, end_gap < 0.02 AND drawdown_gap < 0.02 AND sharpe_gap < 0.2 AS ok FROM g)", "nav", g=GAPS))
def m20(spark, sf):
    got = r.performance_gap(nav(spark, sf), "nav", "bench")
    return got.select("days", *[rnd(c).alias(c) for c in ("end_gap", "drawdown_gap", "sharpe_gap")], "ok", "near_miss")


@query("M21_holding_overlap", oracle(f"SELECT count(*) AS days, {rsql('avg(j)')} AS overlap FROM (SELECT dt, count(*) FILTER (a AND b) / count(*) AS j FROM (SELECT DISTINCT dt, code, true AS a FROM l) FULL JOIN (SELECT DISTINCT dt, code, true AS b FROM r) USING (dt, code) GROUP BY dt)", "trades", **LR))
def m21(spark, sf):
    return r.holding_overlap(*runs(spark, sf)).withColumn("overlap", rnd("overlap"))


#: Sets held at the end of each day with trades on the left, once the right has traded: the last action of a code up to the day decides.
CARRIED = {
    "dy": "SELECT DISTINCT dt FROM l WHERE dt >= (SELECT min(dt) FROM r)",
    "la": f"SELECT dt, code, arg_max(action, row(dt, {TIES})) = 'buy' AS held, 'l' AS side FROM l GROUP BY dt, code UNION ALL SELECT dt, code, arg_max(action, row(dt, {TIES})) = 'buy', 'r' FROM r GROUP BY dt, code",
    "ho": "SELECT d.dt, x.side, x.code, arg_max(x.held, x.dt) AS held FROM dy d JOIN la x ON x.dt <= d.dt GROUP BY 1, 2, 3",
    "jd": "SELECT dt, count(*) FILTER (n = 2) AS common, count(*) AS either FROM (SELECT dt, code, count(*) AS n FROM ho WHERE held GROUP BY 1, 2) GROUP BY dt",
}


@query("M21_carried_holdings", oracle(f"SELECT dt::VARCHAR AS dt, common, either, {rsql('common / either')} AS overlap FROM jd", "trades", **LR, **CARRIED))
def m21_carried(spark, sf):
    got = r.carried_overlap(*runs(spark, sf), ORDER)
    return got.select(C("dt").cast("string").alias("dt"), "common", "either", rnd("overlap").alias("overlap"))


@query("M22_cost_gap", oracle(f"SELECT code, {rsql('a.r', 8)} AS rate_l, {rsql('b.r', 8)} AS rate_r, {rsql('(b.r - a.r) / a.r')} AS gap FROM (SELECT code, sum(fee) / sum(amount) AS r FROM l GROUP BY 1) a JOIN (SELECT code, sum(fee) / sum(amount) AS r FROM r GROUP BY 1) b USING (code)", "trades", **LR))
def m22(spark, sf):
    got = r.cost_gap(*runs(spark, sf), ["code"])
    return got.select("code", rnd("rate_l", 8).alias("rate_l"), rnd("rate_r", 8).alias("rate_r"), rnd("gap").alias("gap"))


@query("M23_attribution", oracle("SELECT side, count(*) AS n, array_to_string(list(dt::VARCHAR || '|' || code || '|' || action ORDER BY dt, code, action)[1:3], ' ') AS examples FROM (SELECT CASE WHEN a IS NULL THEN 'right_only' WHEN b IS NULL THEN 'left_only' ELSE 'both' END AS side, dt, code, action FROM (SELECT DISTINCT dt, code, action, true AS a FROM l) FULL JOIN (SELECT DISTINCT dt, code, action, true AS b FROM r) USING (dt, code, action)) GROUP BY side", "trades", **LR))
def m23(spark, sf):
    return r.attribution(*runs(spark, sf), ["dt", "code", "action"]).withColumn("examples", F.array_join("examples", " "))


MATCH = "SELECT sum(least(a.n, b.n)) / greatest((SELECT count(*) FROM l), (SELECT count(*) FROM r)) AS rate FROM (SELECT dt, code, action, volume, count(*) AS n FROM l GROUP BY ALL) a JOIN (SELECT dt, code, action, volume, count(*) AS n FROM r GROUP BY ALL) b USING (dt, code, action, volume)"


@query("M24_match_rate", oracle(f"SELECT {rsql('rate')} AS rate FROM m", "trades", **LR, m=MATCH))
def m24(spark, sf):
    return r.match_rate(*runs(spark, sf), ["dt", "code", "action", "volume"]).select(rnd("rate").alias("rate"))


PARTS = {
    **LR, "m": MATCH, "o": "SELECT avg(j) AS overlap FROM (SELECT dt, count(*) FILTER (a AND b) / count(*) AS j FROM (SELECT DISTINCT dt, code, true AS a FROM l) FULL JOIN (SELECT DISTINCT dt, code, true AS b FROM r) USING (dt, code) GROUP BY dt)",
    "g": "SELECT (arg_max(nav, dt) / arg_min(nav, dt) - arg_max(bench, dt) / arg_min(bench, dt)) * 10000 AS total FROM nav",
}


@query("M25_gap_parts", oracle(f"SELECT {rsql('total', 3)} AS total_bps, {rsql('total * (1 - rate)', 3)} AS engine_bps, {rsql('total * rate * (1 - overlap)', 3)} AS data_bps, {rsql('total * rate * overlap', 3)} AS source_bps FROM g, m, o", "nav", "trades", **PARTS))
def m25(spark, sf):
    first_last = lambda c: (F.max_by(c, "dt") / F.min_by(c, "dt") - 1)
    returns = nav(spark, sf).agg(first_last("nav").alias("left_return"), first_last("bench").alias("right_return"))
    a, b = runs(spark, sf)
    got = r.gap_parts(returns, r.match_rate(a, b, ["dt", "code", "action", "volume"]), r.holding_overlap(a, b))
    return got.select(*[rnd(c, 3).alias(c) for c in ("total_bps", "engine_bps", "data_bps", "source_bps")])


@query("M26_correlation", oracle(f"SELECT count(*) AS n, {rsql('corr(nav, bench)')} AS corr FROM nav", "nav"))
def m26(spark, sf):
    return r.correlation(nav(spark, sf), "nav", "bench").withColumn("corr", rnd("corr"))


EDGES = "SELECT dt, code, action, volume FROM {} EXCEPT ALL SELECT dt, code, action, volume FROM {}"


@query("M27_equality", oracle(f"SELECT *, left_only = 0 AND right_only = 0 AS equal, x AS hash_l, y AS hash_r, x = y AS same_curve FROM (SELECT (SELECT count(*) FROM ({EDGES.format('l', 'r')})) AS left_only, (SELECT count(*) FROM ({EDGES.format('r', 'l')})) AS right_only), (SELECT sha256(string_agg(round(nav * 1000000)::BIGINT::VARCHAR, ',' ORDER BY dt)) AS x, sha256(string_agg(round(bench * 1000000)::BIGINT::VARCHAR, ',' ORDER BY dt)) AS y FROM nav)".replace("SELECT *, left_only", "SELECT left_only, right_only, left_only"), "nav", "trades", **LR))
def m27(spark, sf):
    rows = r.same(*[x.select("dt", "code", "action", "volume") for x in runs(spark, sf)])
    n = nav(spark, sf)
    hashes = r.curve_hash(n, "nav").withColumnRenamed("hash", "hash_l").crossJoin(F.broadcast(r.curve_hash(n, "bench").withColumnRenamed("hash", "hash_r")))
    return rows.crossJoin(F.broadcast(hashes)).withColumn("same_curve", C("hash_l") == C("hash_r"))


DAILY = "SELECT dt, count(*) FILTER (code::INTEGER % 2 = 0) AS positions, coalesce(sum(amount) FILTER (code::INTEGER % 2 = 0), 0) AS market_value, sum(amount) AS total FROM bars GROUP BY dt"


def daily(spark, sf):
    even = C("code").cast("int") % 2 == 0
    rows = bars(spark, sf).groupBy("dt").agg(F.count_if(even).alias("positions"), F.coalesce(F.sum(F.when(even, C("amount"))), F.lit(0.0)).alias("market_value"), F.sum("amount").alias("total"))
    return rows.withColumn("cash", C("total") - C("market_value"))


@query("M28_run_profile", oracle(f"""SELECT a.*, count(*) AS days, max(positions) AS most_positions, max(positions) FILTER (dt >= first) AS positions_after, {rsql('avg(market_value / total) FILTER (dt >= first)')} AS exposure, {rsql('avg((total - market_value) / total) FILTER (dt >= first)')} AS cash_ratio,
    {rsql('arg_max(total, dt)', 2)} AS final FROM d, (SELECT count(*) FILTER (action = 'buy') AS buys, count(*) FILTER (action = 'sell') AS sells, count(DISTINCT code) FILTER (action = 'buy') AS symbols, count(DISTINCT dt) AS trade_days, {rsql('sum(amount)', 2)} AS value,
    {rsql("count(*) FILTER (action = 'buy') / count(DISTINCT dt) FILTER (action = 'buy')")} AS buys_per_day FROM e) a, (SELECT min(dt) AS first FROM e) GROUP BY ALL""", "bars", "trades", c=COST, d=DAILY, e="SELECT * FROM c WHERE dt >= DATE '1996-01-01'"))  # fmt: skip
def m28(spark, sf):
    got = r.run_profile(costed(spark, sf).where(C("dt") >= F.lit("1996-01-01").cast("date")), daily(spark, sf))
    rounded = {"value": 2, "final": 2, "buys_per_day": 6, "exposure": 6, "cash_ratio": 6}
    return got.select(*[rnd(c, rounded[c]).alias(c) if c in rounded else C(c) for c in got.columns])


def gate_case(spark, sf, every: int):
    """A run, and its expected sequence, of which one of every so many trades is turned round."""
    t = costed(spark, sf).distinct()
    place = F.row_number().over(Window.partitionBy("dt").orderBy(*ORDER))
    turned = C("l_orderkey") % every == every - 1
    due = t.withColumn("place", place).withColumn("action", F.when(turned, F.lit("held")).otherwise(C("action")))
    return t, due.select("dt", "place", "code", "action")


@query("M29_result_gate", oracle(f"""WITH x AS (SELECT DISTINCT * FROM c), f AS (SELECT arg_max(total, dt) AS final FROM d), n AS (SELECT count(*) AS trades, count(*) FILTER (l_orderkey % 97 = 96) AS turned FROM x),
    b AS (SELECT code AS last_bought FROM x WHERE action = 'buy' ORDER BY dt DESC, {', '.join(f'{c} DESC' for c in TIE)} LIMIT 1)
    SELECT name, {rsql('final', 2)} AS final, trades, last_bought, off AS sequence_off, abs(final - 100000) <= 1e9 AS final_ok, trades = due AS count_ok, last_bought = '000001' AS last_ok, abs(final - 100000) <= 1e9 AND trades = due AND last_bought = '000001' AND off = 0 AS pass
    FROM f, n, b, (SELECT 'turned' AS name, turned AS off, 1 AS due FROM n UNION ALL SELECT 'same', 0, trades FROM n)""".replace("WITH x AS (", "SELECT * FROM (WITH x AS (") + ")", "bars", "trades", c=COST, d=DAILY))  # fmt: skip
def m29(spark, sf):
    def tried(name: str, every: int, count):
        t, due = gate_case(spark, sf, every)
        got = r.result_gate(daily(spark, sf), t, ORDER, 100_000.0, 1e9, count if count else t.count(), due, "000001")
        return got.select(F.lit(name).alias("name"), rnd("final", 2).alias("final"), "trades", "last_bought", "sequence_off", "final_ok", "count_ok", "last_ok", "pass")

    return tried("turned", 97, 1).unionByName(tried("same", 1 << 40, None))
