"""Queries of cross-section factors and selections (F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import factors as f
from ..operators import recursive as rec
from ..operators.indicators import S, bbi, lowest, numbered
from ..plans.views import bars, oracle
from .registry import W, lag, query, recursion, rnd, roll, rsql, shown, shown_sql, steps
from .indicators import mix

C = F.col
RET5 = {"r": f"close / {lag('close', 5)} - 1"}


def q(name: str, outputs: tuple[str, ...], make, *stages: dict[str, str], digits: int = 6, where: str = "") -> None:
    """A query over the bars: ``make`` adds the output columns, ``stages`` do in SQL."""
    last = f"s{len(stages)}" + (f" WHERE {where}" if where else "")

    @query(name, oracle(shown_sql(last, *outputs, digits=digits), "bars", **steps("bars", *stages)))
    def run(spark, sf):
        df = make(bars(spark, sf))
        return shown(df.where(where) if where else df, *[o.lstrip("=") for o in outputs], digits=digits)


def ret(n: int = 5):
    return lambda df: df.withColumn("r", f.lookback("close", n))


D = "PARTITION BY dt"
q("F1_rank_average", ("rank_",), lambda b: ret()(b).withColumn("rank_", f.rank_average("r")), RET5, {"rank_": f"CASE WHEN r IS NULL THEN 0 ELSE (rank() OVER ({D} ORDER BY r NULLS LAST) + (count(*) OVER (PARTITION BY dt, r) - 1) / 2) / count(r) OVER ({D}) END"})
q("F2_rank_last", ("rank_",), lambda b: ret()(b).withColumn("rank_", f.rank_last("r")), RET5, {"rank_": f"CASE WHEN r IS NULL OR count(r) OVER ({D}) <= 1 THEN 50 ELSE (rank() OVER ({D} ORDER BY r NULLS LAST) + count(*) OVER (PARTITION BY dt, r) - 2) / (count(r) OVER ({D}) - 1) * 100 END"})
q("F3_rank_below", ("rank_",), lambda b: ret()(b).withColumn("rank_", f.rank_below("r")), RET5, {"rank_": f"CASE WHEN r IS NULL THEN NULL WHEN count(r) OVER ({D}) <= 1 THEN 1 ELSE (rank() OVER ({D} ORDER BY r NULLS LAST) - 1) / (count(r) OVER ({D}) - 1) END"})
q("F4_lookback_return", ("r",), ret(20), {"r": f"close / {lag('close', 20)} - 1"})
q("F5_return_over_dispersion", ("score",), lambda b: b.withColumn("d", S.diff("close")).withColumn("score", f.lookback("close", 60) / S.std_samp("d", 60)), {"d": f"close - {lag('close')}"}, {"score": f"(close / {lag('close', 60)} - 1) / nullif({roll('stddev_samp', 'd', 60)}, 0)"})
q("F6_volume_ratio", ("vr",), lambda b: b.withColumn("vr", S.ma("volume", 5) / S.ma("volume", 20)), {"vr": f"({roll('avg', 'volume', 5)}) / ({roll('avg', 'volume', 20)})"})
q("F7_new_high", ("=nh",), lambda b: b.withColumn("nh", C("close") >= F.max("close").over(S.w.rowsBetween(-60, -1))), {"nh": f"close >= max(close) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"})
q("F9_ma_stack", ("=stack",), lambda b: b.withColumn("stack", (S.ma("close", 5) > S.ma("close", 10)) & (S.ma("close", 10) > S.ma("close", 20)) & (S.ma("close", 20) > S.ma("close", 60))), {f"m{n}": roll("avg", "close", n) for n in (5, 10, 20, 60)}, {"stack": "m5 > m10 AND m10 > m20 AND m20 > m60"})
q("F10_turnover_share", ("share",), lambda b: b.withColumn("share", C("amount") / F.sum("amount").over(f.within())), {"share": f"amount / sum(amount) OVER ({D})"})
q("F11_composite", ("score",), lambda b: ret()(b).withColumns({"a": f.rank_last("r"), "n": C("close") >= S.hhv("close", 20)}).withColumn("score", C("a") * 0.6 + F.when(C("n"), 100.0).otherwise(0.0) * 0.4), RET5, {"a": f"CASE WHEN r IS NULL OR count(r) OVER ({D}) <= 1 THEN 50 ELSE (rank() OVER ({D} ORDER BY r NULLS LAST) + count(*) OVER (PARTITION BY dt, r) - 2) / (count(r) OVER ({D}) - 1) * 100 END", "n": f"close >= {roll('max', 'close', 20)}"}, {"score": "a * 0.6::DOUBLE + CASE WHEN n THEN 100 ELSE 0 END * 0.4::DOUBLE"})
PLACE = {"place": f"row_number() OVER ({D} ORDER BY r DESC NULLS LAST, code)"}


def placed(b):
    return ret()(b).withColumn("place", F.row_number().over(f.within().orderBy(C("r").desc_nulls_last(), "code")))


@query("F12_rank_buffer", oracle("SELECT code, dt::VARCHAR AS dt, place, kept FROM (SELECT *, code::INTEGER % 4 = 0 AND place <= 8 AS kept FROM s2) QUALIFY row_number() OVER (PARTITION BY dt ORDER BY kept DESC, place) <= 5", "bars", **steps("bars", RET5, PLACE)))
def f12(spark, sf):
    ranked = placed(bars(spark, sf))
    return shown(f.buffered(ranked, ranked.where("cast(code AS int) % 4 = 0").select("dt", "code"), 8, 5), "place", "kept")


DAYV = "SELECT 'all' AS code, dt, sum(volume) AS v FROM bars GROUP BY dt"


def day_volume(spark, sf):
    return bars(spark, sf).groupBy(F.lit("all").alias("code"), "dt").agg(F.sum("volume").alias("v"))


@query("F13_breadth", oracle(f"SELECT dt::VARCHAR AS dt, rn >= 5 AND sum(low::INTEGER) OVER ({W} ROWS 4 PRECEDING) = 5 AS dull FROM (SELECT *, coalesce(v < 0.8 * ({roll('avg', 'v', 20)}), false) AS low, row_number() OVER ({W}) AS rn FROM d)", "bars", d=DAYV))
def f13(spark, sf):
    # one row per day: as many rows as there are trading days
    d = day_volume(spark, sf).withColumn("low", F.coalesce(C("v") < S.ma("v", 20) * 0.8, F.lit(False)))
    return d.withColumn("dull", S.every("low", 5)).select(C("dt").cast("string").alias("dt"), "dull")


@query("F14_regime", oracle(f"SELECT dt::VARCHAR AS dt, coalesce(c < 0.97 * ({roll('avg', 'c', 200)}), false) AS below, highs < 0.1 AS few FROM (SELECT 'all' AS code, dt, avg(close) AS c, avg((close >= m)::INTEGER) AS highs FROM (SELECT *, max(close) OVER ({W} ROWS 59 PRECEDING) AS m FROM bars) GROUP BY dt)", "bars"))
def f14(spark, sf):
    b = bars(spark, sf).withColumn("m", F.max("close").over(S.last(60)))
    d = b.groupBy(F.lit("all").alias("code"), "dt").agg(F.avg("close").alias("c"), F.avg((C("close") >= C("m")).cast("int")).alias("highs"))
    return d.withColumn("below", F.coalesce(C("c") < S.ma("c", 200) * 0.97, F.lit(False))).select(C("dt").cast("string").alias("dt"), "below", (C("highs") < 0.1).alias("few"))


@query("F15_profile", oracle(f"SELECT code, {rsql('pow(1 + total, 252.0 / n) - 1', 4)} AS annual, {rsql('mean / nullif(sd, 0) * sqrt(252)')} AS sharpe, {rsql('win')} AS win, {rsql('dd')} AS drawdown FROM (SELECT code, arg_max(close, dt) / arg_min(close, dt) - 1 AS total, count(r) AS n, avg(r) AS mean, stddev_pop(r) AS sd, avg((r > 0)::INTEGER) AS win, min(close / m - 1) AS dd FROM (SELECT *, close / {lag('close')} - 1 AS r, max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS m FROM bars) GROUP BY code)", "bars"))
def f15(spark, sf):
    b = bars(spark, sf).withColumns({"r": C("close") / S.ref("close") - 1, "m": F.max("close").over(S.so_far)})
    g = b.groupBy("code").agg((F.max_by("close", "dt") / F.min_by("close", "dt") - 1).alias("total"), F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.avg((C("r") > 0).cast("int")).alias("win"), F.min(C("close") / C("m") - 1).alias("dd"))
    return g.select("code", rnd(F.pow(1 + C("total"), F.try_divide(F.lit(252.0), C("n"))) - 1, 4).alias("annual"), rnd(F.try_divide("mean", "sd") * F.sqrt(F.lit(252.0))).alias("sharpe"), rnd("win").alias("win"), rnd("dd").alias("drawdown"))


VOL = steps("bars", {"r": f"ln(close / {lag('close')})"}, {"vol": roll("stddev_samp", "r", 21)})


@query("F16_vol_percentile", oracle(f"SELECT code, {rsql('last')} AS vol, {rsql('avg((vol < last)::INTEGER)')} AS percentile FROM (SELECT *, last_value(vol) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM s2) WHERE vol IS NOT NULL GROUP BY code, last", "bars", **VOL))
def f16(spark, sf):
    b = bars(spark, sf).withColumn("r", F.ln(C("close") / S.ref("close"))).withColumn("vol", S.std_samp("r", 21)).withColumn("last", S.const("vol"))
    return b.where("vol IS NOT NULL").groupBy("code", "last").agg(F.avg((C("vol") < C("last")).cast("int")).alias("p")).select("code", rnd("last").alias("vol"), rnd("p").alias("percentile"))


F17 = {
    **steps("bars", {"r": f"ln(close / {lag('close')})"}),
    "x": "SELECT code, r, i FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY dt DESC) AS i, count(*) OVER (PARTITION BY code) AS own FROM s1 WHERE r IS NOT NULL) WHERE i <= (SELECT min(n) FROM (SELECT count(*) AS n FROM s1 WHERE r IS NOT NULL GROUP BY code))",
}


@query("F17_covariance", oracle(f"SELECT a.code AS code_a, b.code AS code_b, {rsql('avg(a.r)')} AS mean_a, {rsql('avg(b.r)')} AS mean_b, {rsql('covar_samp(a.r, b.r)')} AS cov, count(*) AS n FROM x a JOIN x b ON a.i = b.i AND a.code <= b.code GROUP BY 1, 2", "bars", hold=("x",), **F17))
def f17(spark, sf):
    r = bars(spark, sf).withColumn("r", F.ln(C("close") / S.ref("close"))).where("r IS NOT NULL")
    return shown(f.covariance(r.select("code", "dt", "r")), "mean_a", "mean_b", "cov", "n", keys=("code_a", "code_b"))


@query("F18_vol_regime", oracle(f"SELECT code, month::VARCHAR AS month, {rsql('vol', 4)} AS vol, CASE WHEN (SELECT avg((h.vol <= m.vol)::INTEGER) FROM mv h WHERE h.code = m.code AND h.month <= m.month AND h.month > m.month - INTERVAL 12 MONTH) > 0.8 THEN 'reversal' ELSE 'momentum' END AS regime FROM mv m", "bars", **steps("bars", {"r": f"close / {lag('close')} - 1"}), mv="SELECT code, date_trunc('month', dt)::DATE AS month, stddev_samp(r) * sqrt(252) AS vol FROM s1 GROUP BY 1, 2 HAVING count(r) > 1"))
def f18(spark, sf):
    b = bars(spark, sf).withColumn("r", C("close") / S.ref("close") - 1)
    m = b.groupBy("code", F.to_date(F.date_trunc("month", "dt")).alias("month")).agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"), F.count("r").alias("n")).where("n > 1")
    number = F.year("month") * 12 + F.month("month")
    past = F.collect_list("vol").over(Window.partitionBy("code").orderBy("number").rangeBetween(-11, 0))
    share = F.size(F.filter("past", lambda v: v <= C("vol"))) / F.size("past")
    out = m.withColumn("number", number).withColumn("past", past).withColumn("regime", F.when(share > 0.8, "reversal").otherwise("momentum"))
    return shown(out, "vol", "regime", digits=4, keys=("code", "month"))


MONTH = "SELECT code, date_trunc('month', dt)::DATE AS month, max(dt) AS dt, arg_max(close, dt) AS close FROM bars GROUP BY 1, 2"


@query("F19_month_anchors", oracle(f"SELECT code, month::VARCHAR AS month, dt::VARCHAR AS dt, {rsql('a / b - 1')} AS skip_return FROM (SELECT *, lag(close, 1) OVER (PARTITION BY code ORDER BY month) AS a, lag(close, 12) OVER (PARTITION BY code ORDER BY month) AS b FROM m)", "bars", m=MONTH))
def f19(spark, sf):
    w = Window.partitionBy("code").orderBy("month")
    m = f.month_ends(bars(spark, sf)).withColumn("skip_return", F.lag("close", 1).over(w) / F.lag("close", 12).over(w) - 1)
    return shown(m, "skip_return", keys=("code", "month", "dt"))


q("F20_top_n", ("r", "=place"), placed, RET5, PLACE, where="place <= 5 AND r IS NOT NULL")


@query("F21_worst_fallers", oracle(f"SELECT code, {rsql('r')} AS r, place FROM (SELECT code, arg_max(close, dt) / arg_min(close, dt) - 1 AS r, row_number() OVER (ORDER BY arg_max(close, dt) / arg_min(close, dt) - 1, code) AS place FROM bars WHERE dt >= DATE '1995-01-01' GROUP BY code HAVING count(*) >= 100 AND arg_min(close, dt) > 0) WHERE place <= 10", "bars"))
def f21(spark, sf):
    g = bars(spark, sf).where("dt >= '1995-01-01'").groupBy("code").agg(F.min_by("close", "dt").alias("a"), F.max_by("close", "dt").alias("z"), F.count("*").alias("n")).where("n >= 100 AND a > 0")
    worst = g.withColumn("r", C("z") / C("a") - 1).orderBy("r", "code").limit(10)
    return worst.select("code", rnd("r").alias("r"), F.row_number().over(Window.orderBy("r", "code")).alias("place"))


q("F22_rebound", ("up",), lambda b: b.withColumn("up", C("close") / S.llv("low", 20) - 1), {"up": f"close / {roll('min', 'low', 20)} - 1"}, where="up >= 0.5")
LIM = {"lim": f"close >= round({lag('close')} * 1.1::DOUBLE, 2)"}
q("F23_limit_pool", ("close",), lambda b: b.withColumn("lim", f.limit_up(0.1)), LIM, where="lim AND (high <> low OR k % 2 = 0)")
q("F24_first_board", ("=first_",), lambda b: b.withColumn("lim", f.limit_up(0.1)).withColumn("first_", F.coalesce(C("lim") & ~S.ref("lim"), F.lit(False))), LIM, {"first_": f"coalesce(lim AND NOT {lag('lim')}, false)"})


@query("F25_sentiment", oracle(f"SELECT dt::VARCHAR AS dt, n, CASE WHEN m >= 12 THEN 'hot' WHEN m >= 8 THEN 'warm' WHEN m IS NULL THEN 'unknown' ELSE 'cold' END AS phase FROM (SELECT *, {roll('avg', 'n', 5)} AS m FROM (SELECT 'all' AS code, dt, count(*) FILTER (lim) AS n FROM s1 GROUP BY dt))", "bars", **steps("bars", LIM)))
def f25(spark, sf):
    d = bars(spark, sf).withColumn("lim", f.limit_up(0.1)).groupBy(F.lit("all").alias("code"), "dt").agg(F.count_if("lim").alias("n")).withColumn("m", S.ma("n", 5))
    phase = F.when(C("m").isNull(), "unknown").when(C("m") >= 12, "hot").when(C("m") >= 8, "warm").otherwise("cold")
    return d.select(C("dt").cast("string").alias("dt"), "n", phase.alias("phase"))


PULL = steps("bars", {"drop_": f"close / {lag('close')} - 1", "pos": "(close - low) / nullif(high - low, 0)", "vr": f"volume / ({roll('avg', 'volume', 5)})", "ma20": roll("avg", "close", 20), "top20": roll("max", "high", 20)})


@query("F26_pull_back", oracle(f"SELECT code, max(dt)::VARCHAR AS dt, count(*) AS n, {rsql('arg_max(close, dt)')} AS close FROM s1 WHERE drop_ < -0.1 AND vr < 1 AND close / top20 < 0.9 AND close < ma20 AND coalesce(pos < 0.8, true) GROUP BY code", "bars", **PULL))
def f26(spark, sf):
    b = bars(spark, sf).withColumns({"drop_": C("close") / S.ref("close") - 1, "pos": F.try_divide(C("close") - C("low"), C("high") - C("low")), "vr": C("volume") / S.ma("volume", 5), "ma20": S.ma("close", 20), "top20": S.hhv("high", 20)})
    found = b.where("drop_ < -0.1 AND vr < 1 AND close / top20 < 0.9 AND close < ma20 AND coalesce(pos < 0.8, true)")
    return found.groupBy("code").agg(F.max("dt").cast("string").alias("dt"), F.count("*").alias("n"), rnd(F.max_by("close", "dt")).alias("close"))


q("F27_candidate_score", ("score",), lambda b: ret()(b).withColumn("heat", (F.count("r").over(f.within()) - F.rank().over(f.within().orderBy(C("r").desc_nulls_last()))) / F.nullif(F.count("r").over(f.within()), F.lit(0))).withColumn("score", f.steps(C("r"), [(0.5, 30.0), (0.2, 20.0), (0.0, 10.0)]) + F.coalesce(C("heat"), F.lit(0.0)) * 20), RET5, {"heat": f"(count(r) OVER ({D}) - rank() OVER ({D} ORDER BY r DESC NULLS LAST)) / nullif(count(r) OVER ({D}), 0)"}, {"score": "CASE WHEN r >= 0.5 THEN 30 WHEN r >= 0.2 THEN 20 WHEN r >= 0 THEN 10 ELSE 0 END + coalesce(heat, 0) * 20"})


@query("F28_completed_bar", oracle(f"SELECT r.code, r.dt::VARCHAR AS dt, {rsql('r.ema')} AS ema, {rsql('amp')} AS amplitude FROM r JOIN (SELECT code, rn, dt, {roll('max', 'high', 10)} / {roll('min', 'low', 10)} - 1 AS amp FROM b) x USING (code, rn) QUALIFY row_number() OVER (PARTITION BY r.code ORDER BY r.dt DESC) = 1", "bars", recursive=True, **recursion({"ema": "close"}, {"ema": mix("b.close", "r.ema", 2 / 11)})))
def f28(spark, sf):
    made = rec.per_code(bars(spark, sf), lambda p: {"ema": rec.ema(p["close"], 10), "amplitude": p["high"].rolling(10).max() / p["low"].rolling(10).min() - 1}, {"ema": "double", "amplitude": "double"})
    from ..operators.joins import latest

    return shown(latest(made, "code", F.desc("dt")), "ema", "amplitude")


q("F29_liquid", ("mean",), lambda b: b.withColumn("mean", S.ma("amount", 20)), {"mean": roll("avg", "amount", 20)}, digits=3, where="mean >= 30000")
q("F30_bbi_direction", ("bbi", "change", "=above"), lambda b: bbi(b).withColumns({"above": F.coalesce(C("close") > C("bbi"), F.lit(False)), "change": C("close") / S.ref("close") - 1}), {"bbi": f"({' + '.join('(' + roll('avg', 'close', n) + ')' for n in (3, 6, 12, 20))}) / 4", "change": f"close / {lag('close')} - 1"}, {"above": "coalesce(close > bbi, false)"})
OVER20 = f"OVER ({W} ROWS 19 PRECEDING)"
q("F31_trend_quality", ("score",), lambda b: numbered(b).withColumn("score", lowest(f.trend_quality(), F.lit(1e6))), {"rn": f"row_number() OVER ({W})"}, {"score": f"CASE WHEN rn >= 20 THEN least((exp(least(regr_slope(ln(close), rn) {OVER20} * 250, 600)) - 1) * CASE WHEN var_pop(ln(close)) {OVER20} <= 1e-18 THEN 0 ELSE regr_r2(ln(close), rn) {OVER20} END, 1e6) END"}, digits=3)
GEN = steps("bars", {"fast": roll("avg", "close", 5), "slow": roll("avg", "close", 20), "chg": f"close / {lag('close', 5)} - 1"}, {"now": "coalesce(fast > slow, false)"}, {"sig": f"now AND NOT coalesce({lag('now')}, true)", "low_open": f"coalesce(open < {lag('low')}, false)"}, {"joint": "sig AND low_open"})


@query("F32_generic_steps", oracle(shown_sql("s5 WHERE place <= 3", "chg", "=joint", "=place"), "bars", **GEN, s5="SELECT *, row_number() OVER (PARTITION BY dt ORDER BY chg DESC NULLS LAST, code) AS place FROM s4"))
def f32(spark, sf):
    plan = [("ma", "close", 5, "fast"), ("ma", "close", 20, "slow"), ("pct_change", "close", 5, "chg"), ("cross", "fast", "slow", "sig"), ("open_below_previous_low", None, None, "low_open"), ("and", "sig", "low_open", "joint"), ("top_n", "chg", 3, "place")]
    return shown(f.generic(bars(spark, sf), plan), "chg", "joint", "place")


EMAS = recursion({"fast": "close", "slow": "close"}, {"fast": mix("b.close", "r.fast", 2 / 13), "slow": mix("b.close", "r.slow", 2 / 27)})


@query("F32_ema", oracle(shown_sql("r", "fast", "slow"), "bars", recursive=True, **EMAS))
def f32_ema(spark, sf):
    return shown(f.generic(bars(spark, sf), [("ema", "close", 12, "fast"), ("ema", "close", 26, "slow")]), "fast", "slow")


E1, E2 = mix("b.close", "r.e12", 2 / 13), mix("b.close", "r.e26", 2 / 27)
BULL = recursion({"e12": "close", "e26": "close", "dea": "0.0::DOUBLE"}, {"e12": E1, "e26": E2, "dea": mix(f"({E1}) - ({E2})", "r.dea", 0.2)})


@query("F8_macd_flags", oracle(f"SELECT code, dt::VARCHAR AS dt, dif > dea + 1e-9 AS bull, coalesce({lag('dif - dea')} >= 1e-9 AND dif - dea < -1e-9, false) AS dead FROM (SELECT *, e12 - e26 AS dif FROM r)", "bars", recursive=True, **BULL))
def f8(spark, sf):
    def flags(p):
        dif, dea, _ = rec.macd(p["close"])
        gap = dif - dea
        return {"bull": gap > 1e-9, "dead": (gap.shift() >= 1e-9) & (gap < -1e-9)}

    return shown(rec.per_code(bars(spark, sf), flags, {"bull": "boolean", "dead": "boolean"}), "bull", "dead")
