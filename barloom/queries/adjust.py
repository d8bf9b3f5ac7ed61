"""Queries of adjusted prices and corporate actions (A)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import adjust as a
from ..operators import pit
from ..operators.indicators import S
from ..plans.views import bars, dividends, factors, minutes, oracle
from .registry import lag, query, recursion, rnd, roll, rsql, shown, shown_sql

C = F.col


def at_day():
    return F.lit("1996-06-28").cast("date")


def number():
    return C("code").cast("int")


CTES = {
    "anch": "SELECT code, arg_max(adj_factor, dt) AS latest, arg_min(adj_factor, dt) AS earliest FROM factors GROUP BY code",
    "adj": "SELECT b.*, f.adj_factor, a.latest, a.earliest, " + ", ".join(f"b.{c} * f.adj_factor / a.{s} AS {c}_{n}" for c in a.PRICES for s, n in (("latest", "front"), ("earliest", "back"))) + " FROM bars b LEFT JOIN factors f ON f.code = b.code AND f.dt = b.dt LEFT JOIN anch a ON a.code = b.code",
}
CTES["fresh"] = "SELECT code, dt, k, close, adj_factor, latest, CASE WHEN k % 59 = 0 THEN NULL WHEN k % 53 = 0 THEN close_front + 0.001 ELSE close_front END AS close_front FROM adj"
CTES["noisy"] = "SELECT code, dt, adj_factor * (1 + (((k % 3) + 3) % 3) * 1e-5) AS ratio FROM (SELECT f.*, b.k FROM factors f JOIN bars b ON b.code = f.code AND b.dt = f.dt)"


def adj(spark, sf):
    return a.adjust(bars(spark, sf), factors(spark, sf))


def fresh(spark, sf):
    """Adjusted bars with a small error on some days and no adjusted close on others."""
    front = F.when(C("k") % 59 == 0, None).when(C("k") % 53 == 0, C("close_front") + 0.001).otherwise(C("close_front"))
    return adj(spark, sf).withColumn("close_front", front)


def noisy(spark, sf):
    b = bars(spark, sf).select("code", "dt", "k")
    return factors(spark, sf).join(b, ["code", "dt"]).select("code", "dt", (C("adj_factor") * (1 + F.pmod("k", F.lit(3)) * F.lit(1e-5))).alias("ratio"))


def o(body: str, *ctes: str, views: tuple[str, ...] = ("bars", "factors"), recursive: bool = False, **more: str) -> str:
    wanted = [c for c in CTES if c in ctes or (c in ("anch", "adj") and ("fresh" in ctes or "adj" in ctes))]
    return oracle(body, *views, recursive=recursive, **{c: CTES[c] for c in wanted}, **more)


@query("A1_anchors", o(shown_sql("anch", "latest", "earliest", keys=("code",)), "anch"))
def a1(spark, sf):
    return shown(a.anchors(factors(spark, sf)), "latest", "earliest", keys=("code",))


@query("A2_adjust", o(shown_sql("adj", "close_front", "close_back", "open_front", "high_back"), "adj"))
def a2(spark, sf):
    return shown(adj(spark, sf), "close_front", "close_back", "open_front", "high_back")


@query("A3_restore", o(f"SELECT code, dt::VARCHAR AS dt, {rsql('close')} AS raw FROM adj WHERE adj_factor IS NOT NULL", "adj"))
def a3(spark, sf):
    rows = adj(spark, sf).where("adj_factor IS NOT NULL").select("code", "dt", "close_front")
    return shown(a.restore(rows, factors(spark, sf), "close_front", "raw"), "raw")


@query("A4_native_sides", o(f"SELECT code, dt::VARCHAR AS dt, {rsql('CASE WHEN k % 3 = 0 THEN close * 0.9 ELSE close_front END')} AS close_front FROM adj", "adj"))
def a4(spark, sf):
    native = C("k") % 3 == 0
    return shown(adj(spark, sf).withColumn("close_front", F.when(native, C("close") * 0.9).otherwise(C("close_front"))), "close_front")


@query("A5_price_view", o(f"SELECT code, dt::VARCHAR AS dt, {rsql('CASE WHEN max((close_back IS NOT NULL)::INTEGER) OVER (PARTITION BY code) = 1 THEN close_back ELSE close END')} AS close FROM adj WHERE dt >= DATE '1996-01-01'", "adj"))
def a5(spark, sf):
    return shown(pit.price_view(adj(spark, sf).where("dt >= '1996-01-01'"), "post"), "close")


@query("A6_daily_factor", oracle(f"SELECT code, day, {rsql('open')} AS factor FROM (SELECT code, time_ms // 86400000 AS day, open, time_ms FROM minutes) QUALIFY row_number() OVER (PARTITION BY code, day ORDER BY time_ms) = 1", "minutes"))
def a6(spark, sf):
    day = F.expr("time_ms div 86400000")
    return minutes(spark, sf).groupBy("code", day.alias("day")).agg(rnd(F.min_by("open", "time_ms")).alias("factor"))


INVARIANT = "count(*) FILTER (off IS NOT NULL) AS checked, count(*) FILTER (off > 1e-6) AS bad, count(*) FILTER (close_front IS NULL) AS no_side, count(*) FILTER (adj_factor IS NULL) AS no_factor"
OFF_SQL = "SELECT *, abs(close_front - close * adj_factor / latest) / greatest(abs(close * adj_factor / latest), 1e-12) AS off FROM fresh"


@query("A7_invariant", o(f"SELECT {INVARIANT} FROM ({OFF_SQL})", "fresh"))
def a7(spark, sf):
    return a.invariant(fresh(spark, sf))


MOVES = f"SELECT code, dt, adj_factor, adj_factor / {lag('adj_factor')} AS ratio, date_diff('day', {lag('dt')}, dt) AS days FROM factors"


@query("A8_factor_integrity", oracle(f"""SELECT code, dt::VARCHAR AS dt, 'jump' AS kind, {rsql('ratio')} AS value FROM m WHERE ratio > 1.05 OR ratio < 0.95 UNION ALL SELECT code, dt::VARCHAR, 'gap', {rsql('days::DOUBLE')} FROM m WHERE days > 5
    UNION ALL SELECT NULL, dt::VARCHAR, 'spike', {rsql('n::DOUBLE')} FROM (SELECT dt, count(DISTINCT code) AS n FROM m WHERE ratio <> 1 GROUP BY dt) WHERE n > (SELECT greatest(1, floor(count(DISTINCT code) * 0.05)) FROM m)
    UNION ALL SELECT code, dt::VARCHAR, 'official', {rsql('-0.01::DOUBLE')} FROM m WHERE day(dt) = 13""", "factors", m=MOVES))  # fmt: skip
def a8(spark, sf):
    f = factors(spark, sf)
    official = f.where(F.day("dt") % 2 == 1).select("code", "dt", (C("adj_factor") + F.when(F.day("dt") == 13, 0.01).otherwise(0.0)).alias("value"))
    return shown(a.factor_integrity(f, official, 1.05, 0.95, 5), "kind", "value")


@query("A9_golden_rows", o("SELECT count(*) AS golden, count(*) FILTER (abs(close_front - due) > 1e-6) AS off FROM (SELECT fresh.*, close * adj_factor / latest AS due FROM fresh WHERE k % 53 = 0 OR k % 50 = 0)", "fresh"))
def a9(spark, sf):
    golden = adj(spark, sf).where("k % 53 = 0 OR k % 50 = 0").select("code", "dt", C("close_front").alias("due"))
    joined = fresh(spark, sf).join(golden, ["code", "dt"])
    return joined.agg(F.count("*").alias("golden"), F.count_if(F.abs(C("close_front") - C("due")) > 1e-6).alias("off"))


@query("A10_self_check", o(f"SELECT {INVARIANT} FROM ({OFF_SQL}) WHERE code = '000003' AND dt < DATE '1996-01-01'", "fresh"))
def a10(spark, sf):
    return a.invariant(fresh(spark, sf).where("code = '000003' AND dt < '1996-01-01'"))


@query("A11_jumps", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('pct', 4)} AS pct FROM (SELECT code, dt, (close / {lag('close')} - 1) * 100 AS pct FROM bars) WHERE abs(pct) > 20", "bars"))
def a11(spark, sf):
    return shown(bars(spark, sf).withColumn("pct", (C("close") / S.ref("close") - 1) * 100).where("abs(pct) > 20"), "pct", digits=4)


REV_SQL = "SELECT o.code, o.dt::VARCHAR AS dt, CASE WHEN b.f IS NULL THEN 'new' WHEN abs(o.f - b.f) <= 1e-9 THEN 'unchanged' ELSE 'revision' END AS status, {0} AS relative FROM (SELECT code, dt, adj_factor + CASE WHEN day(dt) = 7 THEN 0.001 ELSE 0 END AS f FROM factors WHERE dt <= DATE '1996-06-28') o LEFT JOIN (SELECT code, dt, adj_factor AS f FROM factors WHERE day(dt) <> 9) b ON b.code = o.code AND b.dt = o.dt"


@query("A12_revisions", oracle(REV_SQL.format(rsql("(o.f - b.f) / nullif(b.f, 0)")), "factors"))
def a12(spark, sf):
    f = factors(spark, sf)
    seen = f.withColumn("adj_factor", C("adj_factor") + F.when(F.day("dt") == 7, 0.001).otherwise(0.0))
    return shown(a.revisions(seen, f.where(F.day("dt") != 9), at_day()), "status", "relative")


@query("A13_versions", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('v')} AS adj_factor, n AS revision_no FROM (SELECT code, dt, adj_factor + CASE WHEN day(dt) % 3 = 0 THEN 0.01 ELSE 0 END + CASE WHEN day(dt) % 5 = 0 THEN 0.02 ELSE 0 END AS v, (day(dt) % 3 = 0)::INTEGER + (day(dt) % 5 = 0)::INTEGER AS n FROM factors)", "factors"))
def a13(spark, sf):
    f = factors(spark, sf).select("code", "dt", "adj_factor")
    two = f.withColumn("adj_factor", C("adj_factor") + F.when(F.day("dt") % 3 == 0, 0.01).otherwise(0.0))
    three = two.withColumn("adj_factor", C("adj_factor") + F.when(F.day("dt") % 5 == 0, 0.02).otherwise(0.0))
    seen = f.withColumn("batch", F.lit(1)).unionByName(two.withColumn("batch", F.lit(2))).unionByName(three.withColumn("batch", F.lit(3)))
    return shown(a.versions(seen, ["code", "dt"], "batch", "adj_factor"), "adj_factor", "revision_no")


ID = "sha256(concat_ws('|', code, ex_day::VARCHAR, format('{:.4f}', cash), format('{:.4f}', stock)))"


@query("A14_dividend_events", oracle(f"SELECT code, ex_day::VARCHAR AS ex_day, {ID} AS event_id, CASE WHEN ex_day > DATE '1994-06-28' THEN 'scheduled' ELSE 'pending' END AS status FROM dividends WHERE proc = 'implemented' AND day(ex_day) <> 3", "dividends"))
def a14(spark, sf):
    d, at = dividends(spark, sf), F.lit("1994-06-28").cast("date")
    known = a.dividend_events(d.where(F.day("ex_day") == 3), at)
    return shown(a.dividend_events(d, at, known), "event_id", "status", keys=("code", "ex_day"))


@query("A15_factor_triggers", oracle(f"SELECT code, dt::VARCHAR AS dt, sha256(concat_ws('|', code, dt::VARCHAR, format('{{:.6f}}', p), format('{{:.6f}}', adj_factor))) AS trigger_id FROM (SELECT *, {lag('adj_factor')} AS p FROM factors) WHERE abs(adj_factor - p) > 1e-9", "factors"))
def a15(spark, sf):
    moved = a.changed_codes(factors(spark, sf), F.lit("1900-01-01").cast("date"), F.lit("2100-01-01").cast("date"))
    ids = F.sha2(F.concat_ws("|", "code", C("dt").cast("string"), F.format_string("%.6f", "before"), F.format_string("%.6f", "adj_factor")), 256)
    return shown(moved.withColumn("trigger_id", ids), "trigger_id")


SEG = recursion({"ref": "ratio", "segment": "0::BIGINT"}, {"ref": "CASE WHEN abs(b.ratio / r.ref - 1) > 5e-4 THEN b.ratio ELSE r.ref END", "segment": "r.segment + (abs(b.ratio / r.ref - 1) > 5e-4)::BIGINT"}, "noisy")
SEG["ranges"] = "SELECT *, lead(start_day) OVER (PARTITION BY code ORDER BY segment) AS end_day FROM (SELECT r.code, r.segment, min(r.dt) AS start_day, median(b.ratio) AS ratio, max(b.ratio) / min(b.ratio) - 1 AS dispersion, count(*) AS n FROM r JOIN b USING (code, rn) GROUP BY 1, 2)"


@query("A16_segments", o(f"SELECT code, segment, start_day::VARCHAR AS start_day, {rsql('ratio')} AS ratio, {rsql('dispersion', 8)} AS dispersion, n FROM ranges", "noisy", recursive=True, **SEG))
def a16(spark, sf):
    made = a.segment_ranges(a.segments(noisy(spark, sf)))
    return made.select("code", "segment", C("start_day").cast("string").alias("start_day"), rnd("ratio").alias("ratio"), rnd("dispersion", 8).alias("dispersion"), "n")


#: Staged values by kind of code: a missing day, a bad value, ratios too far apart, two changes, one change, none.
STAGED = """SELECT code, dt, CASE n6 WHEN 1 THEN CASE WHEN day(dt) = 5 THEN 'NaN'::DOUBLE WHEN day(dt) = 6 THEN -f WHEN day(dt) = 7 THEN NULL ELSE f END WHEN 2 THEN f * CASE WHEN rn = 1 THEN 1 WHEN rn % 2 = 0 THEN 1.0004 ELSE 0.9996 END
    WHEN 3 THEN f * CASE WHEN rn * 2 <= n THEN 1.2 ELSE 1.5 END WHEN 4 THEN f * 1.3 ELSE f END AS v FROM (SELECT code, dt, adj_factor AS f, code::INTEGER % 6 AS n6, row_number() OVER (PARTITION BY code ORDER BY dt) AS rn, count(*) OVER (PARTITION BY code) AS n FROM factors) WHERE n6 > 0 OR day(dt) <> 9"""
SEGMENT_REFUSALS = """SELECT code, CASE WHEN gaps > 0 THEN 'gap' WHEN bad > 0 THEN 'bad_value' WHEN wide > 0.05 THEN 'several' ELSE 'dispersion' END AS reason FROM (
    SELECT f.code, count(*) FILTER (g.code IS NULL AND f.dt BETWEEN s.a AND s.z) AS gaps, count(*) FILTER (g.code IS NOT NULL AND NOT coalesce(g.v > 0 AND NOT isnan(g.v), false)) AS bad,
    max(g.v / f.adj_factor) FILTER (g.v > 0 AND NOT isnan(g.v)) / min(g.v / f.adj_factor) FILTER (g.v > 0 AND NOT isnan(g.v)) - 1 AS wide
    FROM factors f LEFT JOIN st g ON g.code = f.code AND g.dt = f.dt JOIN (SELECT code, min(dt) AS a, max(dt) AS z FROM st GROUP BY code) s ON s.code = f.code GROUP BY f.code) WHERE gaps > 0 OR bad > 0 OR wide > 5e-4"""


@query("A16_refusals", oracle(SEGMENT_REFUSALS, "factors", st=STAGED))
def a16_refusals(spark, sf):
    f = factors(spark, sf).select("code", "dt", C("adj_factor").alias("value"))
    kind, w = number() % 6, Window.partitionBy("code")
    rn, n, day = F.row_number().over(w.orderBy("dt")), F.count("*").over(w), F.day("dt")
    bad = F.when(day == 5, float("nan")).when(day == 6, -C("value")).when(day == 7, None).otherwise(C("value"))
    wide = C("value") * F.when(rn == 1, 1.0).when(rn % 2 == 0, 1.0004).otherwise(0.9996)
    two = C("value") * F.when(rn * 2 <= n, 1.2).otherwise(1.5)
    staged = f.withColumn("value", F.when(kind == 1, bad).when(kind == 2, wide).when(kind == 3, two).when(kind == 4, C("value") * 1.3).otherwise(C("value")))
    return a.segment_refusals(f, staged.where((kind > 0) | (day != 9)))


@query("A2_refusals", oracle("SELECT code, CASE WHEN n = 0 THEN 'no_anchor' ELSE 'no_factor' END AS reason FROM (SELECT b.code, count(f.dt) AS n, count(*) AS m FROM bars b LEFT JOIN (SELECT * FROM factors WHERE code::INTEGER % 4 > 0) f ON f.code = b.code AND f.dt = b.dt GROUP BY 1) f WHERE n < m", "bars", "factors"))
def a2_refusals(spark, sf):
    return a.lacking_anchors(bars(spark, sf), factors(spark, sf).where(number() % 4 > 0))


@query("A17_unexplained", o("SELECT code, start_day::VARCHAR AS start_day FROM ranges WHERE segment > 0 AND NOT EXISTS (SELECT 1 FROM dividends d WHERE d.code = ranges.code AND d.ex_day = start_day)", "noisy", views=("bars", "factors", "dividends"), recursive=True, **SEG))
def a17(spark, sf):
    made = a.segment_ranges(a.segments(noisy(spark, sf))).where("segment > 0").select("code", "start_day")
    return shown(made.join(dividends(spark, sf).select("code", C("ex_day").alias("start_day")), ["code", "start_day"], "left_anti"), keys=("code", "start_day"))


@query("A18_apply_segments", o(f"SELECT b2.code, b2.dt::VARCHAR AS dt, {rsql('b2.close * coalesce(g.ratio, 1)')} AS close FROM bars b2 LEFT JOIN ranges g ON g.code = b2.code AND b2.dt >= g.start_day AND (g.end_day IS NULL OR b2.dt < g.end_day)", "noisy", recursive=True, **SEG))
def a18(spark, sf):
    made = a.segment_ranges(a.segments(noisy(spark, sf)))
    return shown(a.apply_segments(bars(spark, sf).select("code", "dt", "close"), made, ["close"]), "close")


@query("A19_front_rewrite", o("SELECT count(*) AS stored, count(s.code) AS staged, count(*) FILTER (s.code IS NOT NULL AND coalesce(s.close_front, f.close_front) IS NOT NULL) AS matched, count(*) FILTER (coalesce(s.close_front, f.close_front) IS NULL) AS still_null FROM fresh f LEFT JOIN (SELECT code, dt, close_front FROM adj WHERE k % 59 = 0 OR k % 53 = 0) s ON s.code = f.code AND s.dt = f.dt", "fresh"))
def a19(spark, sf):
    staged = adj(spark, sf).where("k % 59 = 0 OR k % 53 = 0")
    return a.front_rewrite(fresh(spark, sf), staged)[1]


STAGED = "SELECT code, CASE WHEN k % 97 = 0 THEN dt - 1 ELSE dt END AS dt, k, open, high, low, close, open_front, CASE WHEN k % 17 = 0 THEN high_front + 0.005 WHEN k % 19 = 0 THEN high_front + 50 ELSE high_front END AS high_front, CASE WHEN k % 23 = 0 THEN -1 ELSE low_front END AS low_front, CASE WHEN k % 29 = 0 THEN 'inf'::DOUBLE ELSE close_front END AS close_front FROM adj WHERE close_front IS NOT NULL"


def contract_sql(name: str, wide: str) -> str:
    off = " OR ".join(f"coalesce({x} > 0 AND abs(({x}_front / {x}) / nullif(close_front / close, 0) - 1) > 1e-3{wide.format(x)}, false)" for x in ("open", "high", "low"))
    return f"""SELECT '{name}' AS name, count(*) AS n, '' AS missing, count(*) - count(DISTINCT (code, dt)) AS repeated, count(*) FILTER (NOT (close_front > 0 AND NOT isinf(close_front))) AS bad_close, count(*) FILTER (low_front <= 0) AS bad_value,
        count(*) FILTER ({off}) AS scale, false AS ok FROM x"""


@query("A20_staged_contract", o(contract_sql("ratio", "") + " UNION ALL " + contract_sql("tick", " AND abs(({0} - {0}_front) - (close - close_front)) > 0.01") + " UNION ALL SELECT 'short', count(*), 'low_front', NULL, NULL, NULL, NULL, false FROM x", "adj", x=STAGED))
def a20(spark, sf):
    k = lambda n: C("k") % n == 0
    rows = adj(spark, sf).where("close_front IS NOT NULL").withColumns({
        "dt": F.when(k(97), F.date_sub("dt", 1)).otherwise(C("dt")), "high_front": F.when(k(17), C("high_front") + 0.005).when(k(19), C("high_front") + 50).otherwise(C("high_front")),
        "low_front": F.when(k(23), -1.0).otherwise(C("low_front")), "close_front": F.when(k(29), float("inf")).otherwise(C("close_front")),
    })
    made = {"ratio": a.staged_contract(rows), "tick": a.staged_contract(rows, tick=0.01), "short": a.staged_contract(rows.drop("low_front"))}
    return reduce(lambda x, y: x.unionByName(y), [df.withColumn("name", F.lit(n)) for n, df in made.items()])


@query("A21_raw_coverage", oracle("SELECT code, count(*) AS stored, count(f) AS covered, CASE WHEN count(f) = count(*) THEN 'full' ELSE 'partial' END AS coverage, count(*) FILTER (abs(f - close) > 1e-6) AS disagree FROM (SELECT *, CASE WHEN k % 59 <> 0 OR code::INTEGER % 2 = 0 THEN close + CASE WHEN k % 53 = 0 THEN 0.001 ELSE 0 END END AS f FROM bars) GROUP BY code", "bars"))
def a21(spark, sf):
    b = bars(spark, sf)
    new = b.where((C("k") % 59 != 0) | (number() % 2 == 0)).withColumn("close", C("close") + F.when(C("k") % 53 == 0, 0.001).otherwise(0.0))
    return a.raw_coverage(b, new)


AFTER = f"SELECT * REPLACE (CASE WHEN k % 31 = 0 THEN close_front + 0.5 ELSE close_front END AS close_front, CASE WHEN k % 37 = 0 THEN low_front + 60 ELSE low_front END AS low_front) FROM adj WHERE k % 61 <> 0"
POST = f"""SELECT count(*) AS n, count(*) FILTER (k % 3 = 0 AND close_front IS NOT NULL AND k % 31 = 0) AS staged_off, count(*) FILTER (coalesce(abs(chain - raw) > 1e-3, false)) AS chain_off, count(*) FILTER (last IS NOT NULL AND last <> before) AS day_before_missing,
    count(*) FILTER ({' OR '.join(f"coalesce({x} > 0 AND abs(({x}_front / {x}) / (close_front / close) - 1) > 1e-3 AND abs(({x} - {x}_front) - (close - close_front)) > 0.01, false)" for x in ('open', 'high', 'low'))}) AS scale_off,
    count(*) FILTER (NOT coalesce(low_front <= least(open_front, close_front) + 1e-9 AND greatest(open_front, close_front) <= high_front + 1e-9, true)) AS relation_off, count(*) FILTER (coalesce(k % 10 = 0 AND abs(m / close_front - 1) > 1e-3, false)) AS minute_off,
    (SELECT count(*) FROM bars) - count(*) AS lost, false AS ok
    FROM (SELECT x.*, before, m, {lag('dt')} AS last, close_front / {lag('close_front')} - 1 AS chain, close / {lag('close')} - 1 AS raw
    FROM x JOIN (SELECT dt AS day, lag(dt) OVER (ORDER BY dt) AS before FROM (SELECT DISTINCT dt FROM bars)) ON day = x.dt LEFT JOIN (SELECT code AS c, dt AS t, close_front * 1.002::DOUBLE AS m FROM adj) ON c = code AND t = x.dt)"""


@query("A22_post_checks", o(POST, "adj", x=AFTER))
def a22(spark, sf):
    k = lambda n: C("k") % n == 0
    b, rows = bars(spark, sf), adj(spark, sf)
    after = rows.where(~k(61)).withColumns({"close_front": F.when(k(31), C("close_front") + 0.5).otherwise(C("close_front")), "low_front": F.when(k(37), C("low_front") + 60).otherwise(C("low_front"))})
    last = rows.where(k(10)).withColumn("close_front", C("close_front") * 1.002)
    return a.post_checks(b, after, rows.where(k(3)), b.select(C("dt").alias("day")).distinct(), last)


@query("A23_samples", o("""SELECT code, segment, dt::VARCHAR AS dt, CASE WHEN i = 1 THEN 'head' WHEN i = n THEN 'tail' WHEN i = n // 2 + 1 THEN 'middle' ELSE 'before_ex' END AS kind, n >= 3 AS enough FROM (
    SELECT code, segment, dt, row_number() OVER (PARTITION BY code, segment ORDER BY dt) AS i, count(*) OVER (PARTITION BY code, segment) AS n FROM r) s WHERE i IN (1, n, n // 2 + 1) OR EXISTS (SELECT 1 FROM pre WHERE pre.code = s.code AND pre.dt = s.dt)""", "noisy", views=("bars", "factors", "dividends"), recursive=True,
    **{k: v for k, v in SEG.items() if k != "ranges"}, cal="SELECT dt AS day, lead(dt) OVER (ORDER BY dt) AS following FROM (SELECT DISTINCT dt FROM bars)", pre="SELECT DISTINCT d.code, c.day AS dt FROM dividends d JOIN cal c ON d.ex_day > c.day AND d.ex_day <= c.following"))
def a23(spark, sf):
    calendar = bars(spark, sf).select(C("dt").alias("day")).distinct()
    return shown(a.sample_days(a.segments(noisy(spark, sf)), dividends(spark, sf), calendar), "segment", "kind", "enough")


@query("A23_sample_bars", oracle("""SELECT code, day, time_ms, 'even' AS kind, n >= 5 AS enough FROM (SELECT *, row_number() OVER (PARTITION BY code, day ORDER BY time_ms) - 1 AS i, count(*) OVER (PARTITION BY code, day) AS n FROM d WHERE minute > 570 AND minute <= 900)
    WHERE i IN (0, round_even((n - 1) / 4, 0), round_even((n - 1) / 2, 0), round_even(3 * (n - 1) / 4, 0), n - 1) UNION ALL SELECT code, day, min(time_ms), 'opening', NULL FROM d WHERE minute = 570 GROUP BY 1, 2""", "minutes", d="SELECT *, time_ms // 86400000 AS day FROM minutes"))  # fmt: skip
def a23_bars(spark, sf):
    rows = minutes(spark, sf).withColumn("day", F.expr("time_ms div 86400000"))
    return a.sample_bars(rows, "day", "minute", "time_ms", (C("minute") > 570) & (C("minute") <= 900))


HELD_SQL = "SELECT d.*, 1000.0::DOUBLE + code::INTEGER AS shares, 10.0::DOUBLE AS cost FROM dividends d"


@query("A24_dividend_on_holdings", oracle(f"SELECT code, ex_day::VARCHAR AS ex_day, {rsql('shares * cash * 0.8')} AS credit, shares + round(shares * stock) AS shares, {rsql('greatest(cost - cash * 0.8, 0) * shares / (shares + round(shares * stock))')} AS cost FROM h", "dividends", h=HELD_SQL))
def a24(spark, sf):
    d = dividends(spark, sf)
    held = d.select("code", "ex_day", (F.lit(1000.0) + number()).alias("shares"), F.lit(10.0).alias("cost"))
    return a.holdings_after(held, d.select("code", "ex_day", "cash", "stock")).select("code", C("ex_day").cast("string").alias("ex_day"), rnd("credit").alias("credit"), "shares", rnd("cost").alias("cost"))


@query("A25_fund_dividend", oracle(f"SELECT code, {rsql('sum((1000 + code::INTEGER) * cash * 0.8)')} AS credit, count(*) AS n FROM dividends WHERE proc = 'implemented' GROUP BY code", "dividends"))
def a25(spark, sf):
    return dividends(spark, sf).where("proc = 'implemented'").groupBy("code").agg(rnd(F.sum((1000 + number()) * C("cash") * 0.8)).alias("credit"), F.count("*").alias("n"))


SPLIT_SQL = f"SELECT *, round(ratio * 2) / 2 AS snap FROM (SELECT code, dt, {lag('close')} / nullif(pre, 0) AS ratio FROM (SELECT *, CASE WHEN k % 11 = 0 THEN {lag('close')} / 2 WHEN k % 13 = 0 THEN {lag('close')} / 1.05 WHEN k % 17 = 0 THEN {lag('close')} * 2 ELSE {lag('close')} END AS pre FROM bars)) WHERE ratio IS NOT NULL"
KIND_SQL = "CASE WHEN ratio < 0.99 AND coalesce(abs((ratio - snap) / nullif(snap, 0)) <= 0.005, false) THEN 'merge' WHEN ratio < 0.99 THEN 'unknown' WHEN ratio <= 1.01 THEN 'none' WHEN ratio < 1.10 THEN 'cash' ELSE 'split' END"


@query("A26_split_ratio", oracle(f"SELECT code, dt::VARCHAR AS dt, kind, {rsql(chr(67) + 'ASE WHEN kind IN (' + repr('none') + ', ' + repr('cash') + ', ' + repr('unknown') + ') THEN 1 WHEN abs((ratio - snap) / nullif(snap, 0)) <= 0.005 THEN snap ELSE ratio END')} AS applied FROM (SELECT *, {KIND_SQL} AS kind FROM s)", "bars", s=SPLIT_SQL))
def a26(spark, sf):
    p, k = S.ref("close"), C("k")
    rows = bars(spark, sf).withColumn("pre_close", F.when(k % 11 == 0, p / 2).when(k % 13 == 0, p / 1.05).when(k % 17 == 0, p * 2).otherwise(p))
    return shown(a.split_ratio(rows), "kind", "applied")


@query("A27_ex_rights", oracle(f"SELECT code, ex_day::VARCHAR AS ex_day, {rsql('cash')} AS cash, {rsql('stock')} AS bonus, NULL::DOUBLE AS allotment FROM dividends WHERE ex_day BETWEEN DATE '1995-06-01' AND DATE '1995-06-30'", "dividends"))
def a27(spark, sf):
    rows = dividends(spark, sf).where("ex_day BETWEEN '1995-06-01' AND '1995-06-30'")
    return rows.select("code", C("ex_day").cast("string").alias("ex_day"), rnd("cash").alias("cash"), rnd("stock").alias("bonus"), F.lit(None).cast("double").alias("allotment"))


CMP = "SELECT f.code, f.dt, a.close_front AS l, f.close_front AS r, (a.close_front IS NULL) <> (f.close_front IS NULL) AS n, coalesce(abs(a.close_front - f.close_front), 0) AS d FROM fresh f JOIN adj a ON a.code = f.code AND a.dt = f.dt"


@query("A28_compare_sides", o(f"SELECT count(*) AS compared, count(*) FILTER (n OR d > 1e-6) AS rows_off, count(DISTINCT code) FILTER (n OR d > 1e-6) AS codes_off, count(*) FILTER (n OR d > 1e-6) AS cells_off, count(*) FILTER (n) AS null_off, {rsql('max(d)')} AS max_abs, {rsql('max(coalesce(d / nullif(abs(l), 0), 0))')} AS max_rel, min(dt) FILTER (n OR d > 1e-6)::VARCHAR AS earliest FROM c", "fresh", c=CMP))
def a28(spark, sf):
    return shown(a.compare_sides(adj(spark, sf), fresh(spark, sf), ["close_front"]), "compared", "rows_off", "codes_off", "cells_off", "null_off", "max_abs", "max_rel", "earliest", keys=())


@query("A29_signal_impact", o(f"SELECT code, count(*) FILTER ((ma > close) <> (ma_f > close_front)) AS flips, {rsql('max(abs(close / m - close_front / m_f))', 4)} AS momentum_gap FROM (SELECT *, {roll('avg', 'close', 20)} AS ma, {roll('avg', 'close_front', 20)} AS ma_f, {lag('close', 20)} AS m, {lag('close_front', 20)} AS m_f FROM adj WHERE adj_factor IS NOT NULL) GROUP BY code", "adj"))
def a29(spark, sf):
    rows = adj(spark, sf).where("adj_factor IS NOT NULL").withColumns({"ma": S.ma("close", 20), "ma_f": S.ma("close_front", 20), "m": S.ref("close", 20), "m_f": S.ref("close_front", 20)})
    return rows.groupBy("code").agg(F.count_if((C("ma") > C("close")) != (C("ma_f") > C("close_front"))).alias("flips"), rnd(F.max(F.abs(C("close") / C("m") - C("close_front") / C("m_f"))), 4).alias("momentum_gap"))


@query("A30_changed_codes", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('adj_factor')} AS adj_factor, {rsql('p')} AS before FROM (SELECT *, {lag('adj_factor')} AS p FROM factors) WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND abs(adj_factor - p) > 1e-9", "factors"))
def a30(spark, sf):
    return shown(a.changed_codes(factors(spark, sf), F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date")), "adj_factor", "before")


@query("A31_split_tables", oracle("SELECT code, count(*) AS n, code IN (SELECT lpad(p_partkey::VARCHAR, 6, '0') FROM part WHERE p_size > 25) AS is_fund FROM factors GROUP BY code", "factors"))
def a31(spark, sf):
    from ..plans.views import table

    f = factors(spark, sf)
    funds = table(spark, sf, "part").where("p_size > 25").select(F.lpad(C("p_partkey").cast("string"), 6, "0").alias("code"))
    moved = f.join(funds, "code", "left_semi").withColumn("is_fund", F.lit(True))
    rest = f.join(funds, "code", "left_anti").withColumn("is_fund", F.lit(False))
    return moved.unionByName(rest).groupBy("code", "is_fund").agg(F.count("*").alias("n")).select("code", "n", "is_fund")


