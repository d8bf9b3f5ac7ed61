"""Queries of the indicator library: I (levels 0 and 1) and K (composites)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import recursive as rec
from ..operators.indicators import S
from ..plans.views import bars, oracle
from .registry import ORACLES, W, lag, query, recursion, rnd, roll, rsql, shown, shown_sql, steps

C = F.col


def simple(name: str, spark_columns, sql_columns: dict[str, str], numbered: bool = False, before: dict[str, str] | None = None, first=None, keep: tuple[str, ...] = ()) -> None:
    """A query that adds columns to the bars; ``first`` adds columns they build on, ``before`` the same in SQL."""
    stages = ([{"rn": f"row_number() OVER ({W})"}] if numbered else []) + ([before] if before else []) + [sql_columns]
    ctes = steps("bars", *stages)
    body = shown_sql(f"s{len(stages)}", *[("=" + c if c in keep else c) for c in sql_columns])

    def run(spark, sf) -> DataFrame:
        df = bars(spark, sf)
        if numbered:
            df = ind.numbered(df)
        if first:
            df = df.withColumns(first())
        return shown(df.withColumns(spark_columns()), *sql_columns)

    query(name, oracle(body, "bars", **ctes))(run)


UP, UP_SQL = lambda: {"up": C("close") > S.ref("close")}, {"up": f"close > {lag('close')}"}
MA2 = lambda: {"fast": S.ma("close", 5), "slow": S.ma("close", 20)}
MA2_SQL = {"fast": roll("avg", "close", 5), "slow": roll("avg", "close", 20)}

simple("I1_rd", lambda: {"rd": F.round(C("close") / 7, 3)}, {"rd": "round(close / 7, 3)"})
simple("I3_scalar_maths", lambda: {"a": F.abs(C("close") - C("open")), "l": F.ln("close"), "p": F.pow(C("close") / 1000, F.lit(1.5)), "q": F.sqrt("close"), "s": F.sin("close"), "c": F.cos("close"), "t": F.atan(F.tan(C("close") / 10000))}, {"a": "abs(close - open)", "l": "ln(close)", "p": "pow(close / 1000, 1.5)", "q": "sqrt(close)", "s": "sin(close)", "c": "cos(close)", "t": "atan(tan(close / 10000))"})
simple("I4_max_min", lambda: {"hi": ind.highest(C("close"), S.ref("close")), "lo": ind.lowest(C("close"), S.ref("close"))}, {"hi": f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(close, {lag('close')}) END", "lo": f"CASE WHEN {lag('close')} IS NOT NULL THEN least(close, {lag('close')}) END"})
simple("I5_if", lambda: {"v": ind.choose(C("close") > S.ref("close"), C("volume"), -C("volume"))}, {"v": f"CASE WHEN close > {lag('close')} THEN volume ELSE -volume END"})
simple("I6_ref", lambda: {"r3": S.ref("close", 3)}, {"r3": lag("close", 3)})
simple("I7_diff", lambda: {"d2": S.diff("close", 2)}, {"d2": f"close - {lag('close', 2)}"})
simple("I8_std", lambda: {"sd": S.std("close", 10)}, {"sd": roll("stddev_pop", "close", 10)})
simple("I9_sum", lambda: {"s5": S.total("volume", 5), "run": S.total("volume")}, {"s5": roll("sum", "volume", 5), "run": f"sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING)"})
simple("I10_const", lambda: {"v": S.const("close")}, {"v": f"last_value(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"})
simple("I11_hhv_llv", lambda: {"hh": S.hhv("high", 9), "ll": S.llv("low", 9)}, {"hh": roll("max", "high", 9), "ll": roll("min", "low", 9)})
simple("I12_hhv_by_row", lambda: {"hh": S.hhv_by("high", 1 + F.pmod("k", F.lit(5)), 5), "ll": S.llv_by("low", 1 + F.pmod("k", F.lit(5)), 5)}, {"hh": "CASE WHEN n <= rn THEN list_max(list_slice(h, -n, -1)) END", "ll": "CASE WHEN n <= rn THEN list_min(list_slice(l, -n, -1)) END"}, True, {"n": "1 + ((k % 5) + 5) % 5", "h": f"list(high) OVER ({W} ROWS 4 PRECEDING)", "l": f"list(low) OVER ({W} ROWS 4 PRECEDING)"})
simple("I13_hhvbars", lambda: {"hb": S.hhv_bars("high", 7), "lb": S.llv_bars("low", 7)}, {"hb": "CASE WHEN len(h) = 7 THEN list_position(list_reverse(h), list_max(h)) - 1 END", "lb": "CASE WHEN len(l) = 7 THEN list_position(list_reverse(l), list_min(l)) - 1 END"}, False, {"h": f"list(high) OVER ({W} ROWS 6 PRECEDING)", "l": f"list(low) OVER ({W} ROWS 6 PRECEDING)"}, keep=("hb", "lb"))
simple("I14_ma", lambda: {"ma5": S.ma("close", 5), "ma20": S.ma("close", 20)}, {"ma5": roll("avg", "close", 5), "ma20": roll("avg", "close", 20)})
simple("I17_wma", lambda: {"wma": S.wma("close", 5)}, {"wma": f"(close * 5 + {lag('close')} * 4 + {lag('close', 2)} * 3 + {lag('close', 3)} * 2 + {lag('close', 4)}) / 15"})
simple("I19_avedev", lambda: {"ad": S.avedev("close", 10)}, {"ad": "CASE WHEN len(l) = 10 THEN list_avg(list_transform(l, lambda v: abs(v - m))) END"}, False, {"l": f"list(close) OVER ({W} ROWS 9 PRECEDING)", "m": f"avg(close) OVER ({W} ROWS 9 PRECEDING)"})
SLOPE_SQL = f"CASE WHEN rn >= 10 THEN regr_slope(close, rn) OVER ({W} ROWS 9 PRECEDING) END"
simple("I20_slope", lambda: {"slope": S.slope("close", 10)}, {"slope": SLOPE_SQL}, True)
simple("I21_forecast", lambda: {"fc": S.forecast("close", 10)}, {"fc": f"CASE WHEN rn >= 10 THEN regr_slope(close, rn) OVER ({W} ROWS 9 PRECEDING) * rn + regr_intercept(close, rn) OVER ({W} ROWS 9 PRECEDING) END"}, True)
simple("I22_last", lambda: {"held": S.held("up", 5, 2)}, {"held": f"rn < 6 OR coalesce(min(coalesce(up, false)::INTEGER) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) = 1, false)"}, True, UP_SQL, UP, ("held",))
CNT = f"sum(coalesce(up, false)::INTEGER) OVER ({W} ROWS 4 PRECEDING)"
simple("I23_count_every_exist", lambda: {"cnt": S.count("up", 5), "ev": S.every("up", 5), "ex": S.exist("up", 5)}, {"cnt": f"CASE WHEN rn >= 5 THEN {CNT} END", "ev": f"rn >= 5 AND {CNT} = 5", "ex": f"rn >= 5 AND {CNT} > 0"}, True, UP_SQL, UP, ("ev", "ex"))
LAST_UP = f"coalesce(max(CASE WHEN up THEN rn END) OVER ({W} ROWS UNBOUNDED PRECEDING), 0)"
simple("I25_barslast", lambda: {"bl": S.bars_last("up")}, {"bl": f"rn - {LAST_UP}"}, True, UP_SQL, UP, ("bl",))
simple("I26_barslastcount", lambda: {"blc": S.bars_last_count("up")}, {"blc": f"rn - coalesce(max(CASE WHEN NOT coalesce(up, false) THEN rn END) OVER ({W} ROWS UNBOUNDED PRECEDING), 0)"}, True, UP_SQL, UP, ("blc",))
simple("I27_barssincen", lambda: {"bs": S.bars_since_n("up", 8)}, {"bs": f"CASE WHEN rn >= 8 THEN coalesce(rn - min(CASE WHEN up THEN rn END) OVER ({W} ROWS 7 PRECEDING), 0) ELSE 0 END"}, True, UP_SQL, UP, ("bs",))
ABOVE = "coalesce(fast > slow, false)"
simple("I28_cross", lambda: {"golden": S.cross(C("fast") > C("slow"))}, {"golden": f"{ABOVE} AND NOT coalesce(lag({ABOVE}) OVER ({W}), true)"}, False, MA2_SQL, MA2, ("golden",))
simple("I29_longcross", lambda: {"lc": S.long_cross(C("fast") < C("slow"), C("fast") > C("slow"), 3)}, {"lc": f"coalesce((rn < 4 OR coalesce(min(coalesce(fast < slow, false)::INTEGER) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 1, false)) AND fast > slow, false)"}, True, MA2_SQL, MA2, ("lc",))
simple("I30_valuewhen", lambda: {"vw": S.value_when("up", "close")}, {"vw": f"last_value(CASE WHEN up THEN close END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)"}, False, UP_SQL, UP)
simple("I31_between", lambda: {"btw": ind.between(C("close"), S.ref("close"), S.ref("close", 2))}, {"btw": f"coalesce((close > {lag('close')} AND close < {lag('close', 2)}) OR (close < {lag('close')} AND close > {lag('close', 2)}), false)"}, keep=("btw",))


@query("I2_ret", oracle(f"SELECT code, {rsql('close')} AS ret3 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS n FROM bars) WHERE n = 3", "bars"))
def i2(spark, sf):
    third = F.try_element_at(F.reverse(F.array_sort(F.collect_list(F.struct("dt", "close")))), F.lit(3))
    return bars(spark, sf).groupBy("code").agg(third.alias("v")).where("v IS NOT NULL").select("code", rnd("v.close").alias("ret3"))


def series(name: str, make, outputs: tuple[str, ...], init: dict[str, str] | None = None, step: dict[str, str] | None = None, lags: str = "", body: str | None = None, kind: str = "double", extra: dict[str, str] | None = None) -> None:
    """A recursive query: ``make`` gives the output columns of one code; the oracle is a recursion in SQL."""
    sql = None
    if init:
        sql = oracle(body or shown_sql("r", *outputs), "bars", recursive=True, **recursion(init, step, lags=lags), **(extra or {}))

    @query(name, sql)
    def run(spark, sf):
        def columns(pdf: pd.DataFrame) -> dict:
            made = make(pdf)
            return dict(zip(outputs, made if isinstance(made, tuple) else (made,), strict=True))

        return shown(rec.per_code(bars(spark, sf), columns, {o: kind for o in outputs}), *outputs)


def mix(x: str, old: str, a: float) -> str:
    return f"({x}) * {a!r}::DOUBLE + ({old}) * {1 - a!r}::DOUBLE"


E12, E26, E9 = mix("b.close", "r.e12", 2 / 13), mix("b.close", "r.e26", 2 / 27), 2 / 10
series("I15_ema", lambda p: rec.ema(p["close"], 10), ("ema",), {"ema": "close"}, {"ema": mix("b.close", "r.ema", 2 / 11)})
series("I16_sma", lambda p: rec.sma(p["close"], 10, 2), ("sma",), {"sma": "close"}, {"sma": mix("b.close", "r.sma", 0.2)})
series("I18_dma", lambda p: (rec.dma(p["close"].to_numpy(), 0.3), rec.dma(p["close"].to_numpy(), (p["volume"] % 7 / 10).to_numpy())), ("one", "own"), {"one": "close", "own": "close"}, {"one": mix("b.close", "r.one", 0.3), "own": "(b.volume % 7 / 10) * b.close + (1 - b.volume % 7 / 10) * r.own"})
series("I24_filter", lambda p: rec.thin((p["close"] > p["close"].shift()).to_numpy(), 3), ("sig",), {"sig": "false", "left_": "0"}, {"sig": "coalesce(b.close > b.pc, false) AND r.left_ = 0", "left_": "CASE WHEN coalesce(b.close > b.pc, false) AND r.left_ = 0 THEN 3 ELSE greatest(r.left_ - 1, 0) END"}, f", {lag('close')} AS pc", shown_sql("r", "=sig"), "boolean")
series("I32_toprange", lambda p: (rec.run_of(p["high"].to_numpy(), True), rec.run_of(p["low"].to_numpy(), False)), ("top", "low_"), kind="long")
series("I33_dsma", lambda p: rec.dsma(p["close"].to_numpy(), 20), ("dsma",))
series("I34_sumbarsfast", lambda p: rec.bars_to_sum(p["volume"].to_numpy(), 500.0), ("n",), kind="long")
series("K29_sar", lambda p: rec.parabolic(p["high"].to_numpy(), p["low"].to_numpy()), ("sar",))
series("K30_tdx_sar", lambda p: rec.parabolic_bounded(p["high"].to_numpy(), p["low"].to_numpy()), ("sar",))
SAR_SQL = {
    "b": f"""SELECT *, row_number() OVER ({W}) AS rn, max(high) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS top, min(low) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS bottom,
        lag(high) OVER ({W}) AS h1, lag(high, 2) OVER ({W}) AS h2 FROM bars""",
    "r": """SELECT code, dt, rn, NULL::BOOLEAN AS up, true AS fresh, 0.0::DOUBLE AS speed, NULL::DOUBLE AS sar FROM b WHERE rn = 1 UNION ALL
        SELECT code, dt, rn, u <> turned, coalesce(turned, true), s, y FROM (SELECT *, CASE WHEN u THEN low < y ELSE high > y END AS turned FROM (
        SELECT *, CASE WHEN rn < 11 THEN NULL WHEN f THEN CASE WHEN u THEN bottom ELSE top END ELSE sar + s * (CASE WHEN u THEN top ELSE bottom END - sar) END AS y FROM (
        SELECT *, CASE WHEN f THEN 0.02::DOUBLE WHEN (u AND high > top) OR (NOT u AND low < bottom) THEN least(speed + 0.02::DOUBLE, 0.2::DOUBLE) ELSE speed END AS s FROM (
        SELECT b.*, r.speed, r.sar, CASE WHEN b.rn = 11 THEN b.h1 > b.h2 ELSE r.up END AS u, b.rn <= 11 OR r.fresh AS f FROM r JOIN b ON b.code = r.code AND b.rn = r.rn + 1))))""",
}
ORACLES["K29_sar"] = oracle(shown_sql("r", "sar"), "bars", recursive=True, **SAR_SQL)
TDX_SQL = {
    "b": f"SELECT *, row_number() OVER ({W}) AS rn, lag(high) OVER ({W}) AS h1, lag(low) OVER ({W}) AS l1 FROM bars",
    "r": """SELECT code, dt, rn, true AS up, 0.02::DOUBLE AS speed, high AS ext, low AS sar FROM b WHERE rn = 1 UNION ALL
        SELECT code, dt, rn, up <> turned, CASE WHEN turned THEN 0.02::DOUBLE ELSE s END, CASE WHEN NOT turned THEN e WHEN up THEN low ELSE high END,
        CASE WHEN NOT turned THEN y WHEN NOT up THEN least(low, l1) WHEN h1 = e THEN e ELSE e + 0.02::DOUBLE * (low - e) END FROM (
        SELECT *, CASE WHEN up THEN low < y ELSE high > y END AS turned FROM (SELECT *, CASE WHEN up THEN greatest(sar, least(sar + s * (e - sar), low, l1)) ELSE least(sar, greatest(sar + s * (e - sar), high, h1)) END AS y FROM (
        SELECT b.*, r.up, r.sar, CASE WHEN r.up THEN greatest(r.ext, b.high) ELSE least(r.ext, b.low) END AS e,
        CASE WHEN (r.up AND b.high > r.ext) OR (NOT r.up AND b.low < r.ext) THEN least(r.speed + 0.02::DOUBLE, 0.2::DOUBLE) ELSE r.speed END AS s FROM r JOIN b ON b.code = r.code AND b.rn = r.rn + 1)))""",
}
ORACLES["K30_tdx_sar"] = oracle(shown_sql("r", "sar"), "bars", recursive=True, **TDX_SQL)
TURN = "(1.414::DOUBLE * 2 * pi() / 20)"
C2, C3 = f"(2 * exp(-{TURN}) * cos({TURN}))", f"(-exp(-2 * {TURN}))"
DSMA_SQL = {
    "z": f"SELECT *, row_number() OVER ({W}) AS rn, coalesce(close - lag(close, 2) OVER ({W}), 0) AS z FROM bars",
    "b": f"SELECT *, (z + coalesce(lag(z) OVER ({W}), 0)) / 2 AS p FROM z",
    "r": f"SELECT code, dt, rn, (1 - {C2} - {C3}) * p AS f, 0.0::DOUBLE AS g FROM b WHERE rn = 1 UNION ALL SELECT b.code, b.dt, b.rn, (1 - {C2} - {C3}) * b.p + {C2} * r.f + {C3} * r.g, r.f FROM r JOIN b ON b.code = r.code AND b.rn = r.rn + 1",
    "w": f"SELECT b.code, b.dt, b.rn, b.close, coalesce(CASE WHEN b.rn >= 20 THEN abs(f / nullif(sqrt(avg(f * f) OVER (PARTITION BY b.code ORDER BY b.rn ROWS 19 PRECEDING)), 0)) * 5 / 20 END, 1) AS a FROM b JOIN r ON r.code = b.code AND r.rn = b.rn",
    "q": "SELECT code, dt, rn, close AS dsma FROM w WHERE rn = 1 UNION ALL SELECT w.code, w.dt, w.rn, w.a * w.close + (1 - w.a) * q.dsma FROM q JOIN w ON w.code = q.code AND w.rn = q.rn + 1",
}
ORACLES["I33_dsma"] = oracle(shown_sql("q", "dsma"), "bars", recursive=True, hold=("b", "w"), **DSMA_SQL)
RANGE_SQL = f"""SELECT code, dt::VARCHAR AS dt, CASE WHEN ph IS NULL THEN 0 ELSE rn - 1 - ph END AS top, CASE WHEN pl IS NULL THEN 0 ELSE rn - 1 - pl END AS low_ FROM (
    SELECT b.code, b.dt, b.rn, (SELECT max(p.rn) FROM b p WHERE p.code = b.code AND p.rn < b.rn AND p.high >= b.high) AS ph, (SELECT max(p.rn) FROM b p WHERE p.code = b.code AND p.rn < b.rn AND p.low <= b.low) AS pl FROM b)"""
SUMBARS_SQL = """SELECT b.code, b.dt::VARCHAR AS dt, coalesce(b.rn - max(p.rn) + 1, 0) AS n FROM b LEFT JOIN b p ON p.code = b.code AND p.rn <= b.rn AND b.run - p.run + p.volume >= 500 GROUP BY ALL, b.rn"""
ORACLES["I32_toprange"] = oracle(RANGE_SQL, "bars", b=f"SELECT *, row_number() OVER ({W}) AS rn FROM bars")
ORACLES["I34_sumbarsfast"] = oracle("SELECT code, dt, n FROM (" + SUMBARS_SQL.replace("GROUP BY ALL, b.rn", "GROUP BY b.code, b.dt, b.rn") + ")", "bars", b=f"SELECT *, row_number() OVER ({W}) AS rn, sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM bars")

series("K1_macd", lambda p: rec.macd(p["close"]), ("dif", "dea", "hist"), {"e12": "close", "e26": "close", "dea": "0.0::DOUBLE"}, {"e12": E12, "e26": E26, "dea": mix(f"({E12}) - ({E26})", "r.dea", E9)}, body=f"SELECT code, dt::VARCHAR AS dt, {rsql('e12 - e26')} AS dif, {rsql('dea')} AS dea, {rsql('(e12 - e26 - dea) * 2')} AS hist FROM r")
series("K24_expma", lambda p: (rec.ema(p["close"], 12), rec.ema(p["close"], 50)), ("fast", "slow"), {"fast": "close", "slow": "close"}, {"fast": mix("b.close", "r.fast", 2 / 13), "slow": mix("b.close", "r.slow", 2 / 51)})
GAIN = f", greatest(close - {lag('close')}, 0) AS gain, abs(close - {lag('close')}) AS size"
series("K3_rsi", lambda p: rec.rsi(p["close"], 24), ("rsi",), {"g": "NULL::DOUBLE", "s": "NULL::DOUBLE"}, {"g": f"CASE WHEN b.rn = 2 THEN b.gain ELSE {mix('b.gain', 'r.g', 1 / 24)} END", "s": f"CASE WHEN b.rn = 2 THEN b.size ELSE {mix('b.size', 'r.s', 1 / 24)} END"}, GAIN, f"SELECT code, dt::VARCHAR AS dt, {rsql('g / nullif(s, 0) * 100')} AS rsi FROM r")
T1 = mix("b.close", "r.t1", 2 / 13)
T2 = mix(T1, "r.t2", 2 / 13)
series("K14_trix", lambda p: rec.trix(p["close"]), ("trix", "trma"), {"t1": "close", "t2": "close", "t3": "close"}, {"t1": T1, "t2": T2, "t3": mix(T2, "r.t3", 2 / 13)}, body=shown_sql("s2", "trix", "trma"), extra=steps("r", {"trix": f"(t3 - {lag('t3')}) / {lag('t3')} * 100"}, {"trma": roll("avg", "trix", 20)}))
RSV = f"(close - {roll('min', 'low', 9)}) / nullif({roll('max', 'high', 9)} - {roll('min', 'low', 9)}, 0) * 100"
KK = "CASE WHEN r.kk IS NULL THEN b.rsv ELSE b.rsv * (1.0::DOUBLE / 3) + r.kk * (2.0::DOUBLE / 3) END"
series("K2_kdj", rec.kdj, ("kk", "dd", "jj"), {"kk": "rsv", "dd": "rsv"}, {"kk": KK, "dd": f"CASE WHEN r.dd IS NULL THEN {KK} ELSE ({KK}) * (1.0::DOUBLE / 3) + r.dd * (2.0::DOUBLE / 3) END"}, f", {RSV} AS rsv", f"SELECT code, dt::VARCHAR AS dt, {rsql('kk')} AS kk, {rsql('dd')} AS dd, {rsql('kk * 3 - dd * 2')} AS jj FROM r")
TR_SQL = f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs({lag('close')} - high), abs({lag('close')} - low)) END"
series("K13_keltner", rec.keltner, ("upper", "mid", "lower"), {"mid": "(high + low + close) / 3"}, {"mid": mix("(b.high + b.low + b.close) / 3", "r.mid", 2 / 21)}, f", {TR_SQL} AS tr", f"SELECT r.code, r.dt::VARCHAR AS dt, {rsql('mid + 2 * atr')} AS upper, {rsql('mid')} AS mid, {rsql('mid - 2 * atr')} AS lower FROM r JOIN w USING (code, rn)", extra={"w": f"SELECT code, rn, {roll('avg', 'tr', 10)} AS atr FROM b"})
MID4 = "((2 * close + high + low) / 4)"
series("K28_xsii", rec.xsii, ("td1", "td2", "td3", "td4"), {"dd": "close"}, {"dd": "coalesce(b.cc, 1) * b.close + (1 - coalesce(b.cc, 1)) * r.dd"}, f", {roll('avg', MID4, 5)} AS aa, abs({MID4} - {roll('avg', 'close', 20)}) / ({roll('avg', 'close', 20)}) AS cc", f"SELECT r.code, r.dt::VARCHAR AS dt, {rsql('aa * 102 / 100')} AS td1, {rsql('aa * 98 / 100')} AS td2, {rsql('1.07::DOUBLE * dd')} AS td3, {rsql('0.93::DOUBLE * dd')} AS td4 FROM r JOIN b USING (code, rn)")


CCI_SQL = """SELECT code, dt, CASE WHEN len(l) = 14 THEN (tp - m) / nullif(0.015::DOUBLE * list_avg(list_transform(l, lambda v: abs(v - m))), 0) END AS cci FROM (
    SELECT *, list(tp) OVER w AS l, avg(tp) OVER w AS m FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars) WINDOW w AS (PARTITION BY code ORDER BY dt ROWS 13 PRECEDING))"""


@query("K31_wrappers", oracle(f"SELECT code, max(dt)::VARCHAR AS dt, count(*) AS n, {rsql('arg_max(cci, dt)')} AS cci FROM s GROUP BY code", "bars", s=CCI_SQL))
def k31(spark, sf):
    made = ind.cci(bars(spark, sf), 14)
    return made.groupBy("code").agg(F.max("dt").cast("string").alias("dt"), F.count("*").alias("n"), rnd(F.max_by("cci", "dt")).alias("cci"))


def composite(name: str, make, stages: list[dict[str, str]], outputs: tuple[str, ...], digits: int = 6) -> None:
    @query(name, oracle(shown_sql(f"s{len(stages)}", *outputs, digits=digits), "bars", **steps("bars", *stages)))
    def run(spark, sf):
        return shown(make(bars(spark, sf)), *outputs, digits=digits)


def rng(n: int) -> str:
    return f"nullif({roll('max', 'high', n)} - {roll('min', 'low', n)}, 0)"


composite("K4_wr", ind.wr, [{"wr": f"({roll('max', 'high', 10)} - close) / {rng(10)} * 100", "wr1": f"({roll('max', 'high', 6)} - close) / {rng(6)} * 100"}], ("wr", "wr1"))
composite("K5_bias", ind.bias, [{f"bias{i}": f"(close - {roll('avg', 'close', n)}) / ({roll('avg', 'close', n)}) * 100" for i, n in ((1, 6), (2, 12), (3, 24))}], ("bias1", "bias2", "bias3"))
composite("K6_boll", ind.boll, [{"mid": roll("avg", "close", 20), "sd": roll("stddev_pop", "close", 20)}, {"upper": "mid + 2 * sd", "lower": "mid - 2 * sd"}], ("upper", "mid", "lower"))
composite("K7_psy", ind.psy, [{"up": f"coalesce(close > {lag('close')}, false)::INTEGER"}, {"psy": f"{roll('sum', 'up', 12)} / 12 * 100"}, {"psyma": roll("avg", "psy", 6)}], ("psy", "psyma"))
composite("K8_cci", ind.cci, [{"tp": "(high + low + close) / 3"}, {"l": f"list(tp) OVER ({W} ROWS 13 PRECEDING)", "m": f"avg(tp) OVER ({W} ROWS 13 PRECEDING)"}, {"cci": "CASE WHEN len(l) = 14 THEN (tp - m) / nullif(0.015::DOUBLE * list_avg(list_transform(l, lambda v: abs(v - m))), 0) END"}], ("cci",))
composite("K9_atr", ind.atr, [{"tr": TR_SQL}, {"atr": roll("avg", "tr", 20)}], ("atr",))
composite("K10_bbi", ind.bbi, [{"bbi": f"({' + '.join('(' + roll('avg', 'close', n) + ')' for n in (3, 6, 12, 20))}) / 4"}], ("bbi",))
composite("K11_dmi", ind.dmi, [{"tr": TR_SQL, "hd": f"high - {lag('high')}", "ld": f"{lag('low')} - low"}, {"hp": "CASE WHEN hd > 0 AND hd > ld THEN hd ELSE 0 END", "lp": "CASE WHEN ld > 0 AND ld > hd THEN ld ELSE 0 END"}, {"t": roll("sum", "tr", 14), "p": roll("sum", "hp", 14), "m": roll("sum", "lp", 14)}, {"pdi": "p * 100 / nullif(t, 0)", "mdi": "m * 100 / nullif(t, 0)"}, {"dx": "abs(mdi - pdi) / nullif(pdi + mdi, 0) * 100"}, {"adx": roll("avg", "dx", 6)}, {"adxr": f"(adx + {lag('adx', 6)}) / 2"}], ("pdi", "mdi", "adx", "adxr"))
composite("K12_taq", ind.taq, [{"up": roll("max", "high", 20), "down": roll("min", "low", 20)}, {"mid": "(up + down) / 2"}], ("up", "mid", "down"))
composite("K15_vr", ind.vr, [{"u": f"CASE WHEN close > {lag('close')} THEN volume ELSE 0 END", "d": f"CASE WHEN close <= {lag('close')} THEN volume ELSE 0 END"}, {"vr": f"{roll('sum', 'u', 26)} / nullif({roll('sum', 'd', 26)}, 0) * 100"}], ("vr",))
composite("K16_cr", ind.cr, [{"mid": f"lag(high + low + close) OVER ({W}) / 3"}, {"a": "CASE WHEN mid IS NOT NULL THEN greatest(0, high - mid) END", "d": "CASE WHEN mid IS NOT NULL THEN greatest(0, mid - low) END"}, {"cr": f"{roll('sum', 'a', 20)} / nullif({roll('sum', 'd', 20)}, 0) * 100"}], ("cr",))
composite("K17_emv", ind.emv, [{"rel": f"({roll('avg', 'volume', 14)}) / nullif(volume, 0)", "move": f"(high + low - lag(high + low) OVER ({W})) * 100 / nullif(high + low, 0)", "span": "high - low"}, {"raw": f"move * rel * span / nullif({roll('avg', 'span', 14)}, 0)"}, {"emv": roll("avg", "raw", 14)}, {"maemv": roll("avg", "emv", 9)}], ("emv", "maemv"))
composite("K18_dpo", ind.dpo, [{"mean": roll("avg", "close", 20)}, {"dpo": f"close - {lag('mean', 10)}"}, {"madpo": roll("avg", "dpo", 6)}], ("dpo", "madpo"))
composite("K19_brar", ind.brar, [{"ho": "high - open", "ol": "open - low", "hc": f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(0, high - {lag('close')}) END", "cl": f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(0, {lag('close')} - low) END"}, {"ar": f"{roll('sum', 'ho', 26)} / nullif({roll('sum', 'ol', 26)}, 0) * 100", "br": f"{roll('sum', 'hc', 26)} / nullif({roll('sum', 'cl', 26)}, 0) * 100"}], ("ar", "br"))
composite("K20_dfma", ind.dfma, [{"dif": f"({roll('avg', 'close', 10)}) - ({roll('avg', 'close', 50)})"}, {"difma": roll("avg", "dif", 10)}], ("dif", "difma"))
composite("K21_mtm", ind.mtm, [{"mtm": f"close - {lag('close', 12)}"}, {"mtmma": roll("avg", "mtm", 6)}], ("mtm", "mtmma"))
composite("K22_mass", ind.mass, [{"hl": "high - low"}, {"ma1": roll("avg", "hl", 9)}, {"ma2": roll("avg", "ma1", 9)}, {"part": "ma1 / nullif(ma2, 0)"}, {"mass": roll("sum", "part", 25)}, {"ma_mass": roll("avg", "mass", 6)}], ("mass", "ma_mass"))
composite("K23_roc", ind.roc, [{"roc": f"(close - {lag('close', 12)}) * 100 / {lag('close', 12)}"}, {"maroc": roll("avg", "roc", 6)}], ("roc", "maroc"))
composite("K25_obv", ind.obv, [{"s": f"CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END"}, {"obv": f"sum(s) OVER ({W} ROWS UNBOUNDED PRECEDING) / 10000"}], ("obv",))
composite("K26_mfi", ind.mfi, [{"typ": "(high + low + close) / 3"}, {"u": f"CASE WHEN typ > {lag('typ')} THEN typ * volume ELSE 0 END", "d": f"CASE WHEN typ < {lag('typ')} THEN typ * volume ELSE 0 END"}, {"mfi": f"100 - 100 / (1 + ({roll('sum', 'u', 14)}) / nullif({roll('sum', 'd', 14)}, 0))"}], ("mfi",))
_R = "CASE WHEN aa > bb AND aa > cc THEN aa + bb / 2 + dd / 4 WHEN bb > cc AND bb > aa THEN bb + aa / 2 + dd / 4 ELSE cc + dd / 4 END"
composite("K27_asi", ind.asi, [{"lc": lag("close"), "lo": lag("open"), "ll": lag("low")}, {"aa": "abs(high - lc)", "bb": "abs(low - lc)", "cc": "abs(high - ll)", "dd": "abs(lc - lo)"}, {"si": f"16 * ((close - lc) + (close - open) / 2 + (lc - lo)) / nullif({_R}, 0) * CASE WHEN lc IS NOT NULL THEN greatest(aa, bb) END"}, {"asi": roll("sum", "si", 26)}, {"asit": roll("avg", "asi", 10)}], ("asi", "asit"), 3)
