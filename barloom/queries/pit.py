"""Queries of the point-in-time layer (P) and of sorts, limits and set operations (R)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pit
from ..operators.indicators import S
from ..operators.joins import asof, latest, member_at
from ..plans.views import bars, factors, index_members, index_meta, membership, minutes, oracle, status_events, table, valuation
from ..sources.storage import shared_path
from .registry import query, rnd, rsql, shown, shown_sql

C = F.col
AT = "1996-06-28"


def at_day():
    return F.lit(AT).cast("date")


def number():
    return C("code").cast("int")


def front(spark, sf, of=None):
    """Bars (all, or those given) with prices times the day's factor as front-adjusted prices; no factors for every seventh code."""
    f = factors(spark, sf).where("cast(code AS int) % 7 > 0").select("code", "dt", "adj_factor")
    b = (bars(spark, sf) if of is None else of).join(f, ["code", "dt"], "left")
    return b.withColumns({f"{c}_front": C(c) * C("adj_factor") for c in ("open", "high", "low", "close")})


FRONT_SQL = "SELECT b.*, f.adj_factor, b.close * f.adj_factor AS close_front FROM bars b LEFT JOIN factors f ON f.code = b.code AND f.dt = b.dt AND f.code::INTEGER % 7 > 0"
VIEWED = "CASE WHEN max((close_front IS NOT NULL)::INTEGER) OVER (PARTITION BY code) = 1 THEN close_front ELSE close END"


@query("P1_last_n_bars", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql(VIEWED)} AS close FROM (SELECT * FROM f WHERE dt <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) <= 70)", "bars", "factors", f=FRONT_SQL))
def p1(spark, sf):
    last = pit.last_bars(bars(spark, sf), 70, at_day())  # the factors of these days only are joined
    return shown(pit.price_view(front(spark, sf, last), "pre"), "close")


#: Which codes the tables have, what they add to a close, and which code stands in for which.
HELD = {"stock": ("code::INTEGER % 3 = 0", 0), "fund": ("code::INTEGER % 3 < 2", 1), "index": ("code::INTEGER % 5 < 3", 2)}
PROXIES = {f"{c:06d}": f"{c % 10 + 1:06d}" for c in range(101) if c % 3 == 2 and c % 5 >= 3}
BY_TABLE = " UNION ALL ".join(f"SELECT code, dt, close + {add} AS close, CASE WHEN code::INTEGER % 7 > 0 AND k % 13 > 0 THEN (close + {add}) * 2 END AS close_front, '{name}' AS \"table\", {i} AS r FROM bars WHERE {where}" for i, (name, (where, add)) in enumerate(HELD.items()))
STAND_IN = " UNION ALL ".join(f"SELECT '{own}' AS own, '{proxy}' AS proxy" for own, proxy in PROXIES.items())
PRECEDENCE = {
    "pt": BY_TABLE,
    "px": STAND_IN,
    "pa": "SELECT * FROM pt UNION ALL SELECT own, dt, close, close_front, 'fund as proxy', 3 FROM pt JOIN px ON code = proxy WHERE r = 1 AND own IN (SELECT code FROM bars)",
    "pw": f"SELECT *, min(r) OVER (PARTITION BY code) AS best FROM pa WHERE dt <= DATE '{AT}'",
    "pn": "SELECT * FROM pw WHERE r = best QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) <= 30",
}


@query("P1_precedence", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql(VIEWED)} AS close, \"table\" FROM pn", "bars", **PRECEDENCE))
def p1_precedence(spark, sf):
    """The first of three tables that has a code by the day, a stand-in for codes that none has, and front-adjusted prices."""
    tables = {}
    for name, (where, add) in HELD.items():
        front_ = F.when((number() % 7 > 0) & (C("k") % 13 > 0), (C("close") + add) * 2)
        tables[name] = bars(spark, sf).where(where.replace("code::INTEGER", "cast(code AS int)")).select("code", "dt", (C("close") + add).alias("close"), front_.alias("close_front"))
    codes = bars(spark, sf).select("code").distinct()
    last = pit.last_bars_by_table(tables, codes, 30, at_day(), ["code", "dt", "close", "close_front"], PROXIES, "fund")
    return shown(pit.price_view(last, "pre", ["close"]), "close", "table")


@query("P2_last_n_one_code", oracle(shown_sql("(SELECT * FROM bars WHERE code = '000007' ORDER BY dt DESC LIMIT 20)", "close"), "bars"))
def p2(spark, sf):
    return shown(pit.last_bars(bars(spark, sf).where("code = '000007'"), 20), "close")


@query("P3_bars_in_range", oracle(shown_sql("bars WHERE code < '000005' AND dt BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'", "open", "close"), "bars"))
def p3(spark, sf):
    return shown(bars(spark, sf).where("code < '000005' AND dt BETWEEN '1995-03-01' AND '1995-06-30'"), "open", "close")


SNAP_SQL = f"SELECT code, dt, close, volume, NULL::DOUBLE AS circ_mv, 'bars' AS \"table\" FROM bars WHERE dt = DATE '{AT}' UNION ALL SELECT code, dt, NULL, NULL, circ_mv, 'valuation' FROM valuation WHERE dt = DATE '{AT}'"


@query("P4_snapshot", oracle(shown_sql("s", "close", "volume", "circ_mv", '="table"', digits=4), "bars", "valuation", s=SNAP_SQL))
def p4(spark, sf):
    return shown(pit.snapshot({"bars": bars(spark, sf), "valuation": valuation(spark, sf)}, at_day(), ["code", "dt", "close", "volume", "circ_mv"]), "close", "volume", "circ_mv", "table", digits=4)


@query("P5_multi_day_snapshot", oracle(f"SELECT dt::VARCHAR AS dt, count(*) AS n, {rsql('sum(amount)', 2)} AS amount FROM bars WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY dt", "bars"))
def p5(spark, sf):
    return bars(spark, sf).where("dt BETWEEN '1996-01-01' AND '1996-12-31'").groupBy(C("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"), rnd(F.sum("amount"), 2).alias("amount"))


SESSION = "(minute BETWEEN 571 AND 690 OR minute BETWEEN 781 AND 900)"


@query("P6_minute_range", oracle(f"SELECT code, time_ms, {rsql('close')} AS close FROM minutes WHERE {SESSION} AND minute <= 840", "minutes"))
def p6(spark, sf):
    return pit.session_minutes(minutes(spark, sf), 840).select("code", "time_ms", rnd("close").alias("close"))


#: Stored frequencies, and the tables of the requested codes.
FREQ_SQL = "SELECT *, make_timestamp(time_ms * 1000)::DATE AS dt, CASE WHEN code::INTEGER % 4 = 0 THEN '5min' ELSE '1min' END AS freq, CASE WHEN code::INTEGER % 6 > 0 THEN close * 2 END AS close_front FROM minutes WHERE code::INTEGER % 9 <> 4"
ASKED_SQL = "SELECT DISTINCT code, CASE WHEN code::INTEGER % 10 = 7 THEN NULL WHEN code::INTEGER % 2 = 0 THEN 'stock' ELSE 'fund' END AS \"table\" FROM minutes"


def framed(spark, sf):
    m = minutes(spark, sf)
    own = C("code").cast("int")
    asked = m.select("code", F.when(own % 10 == 7, None).when(own % 2 == 0, "stock").otherwise("fund").alias("table")).distinct()
    rows = m.where(own % 9 != 4).withColumns({"dt": F.timestamp_millis("time_ms").cast("date"), "freq": F.when(own % 4 == 0, "5min").otherwise("1min"), "close_front": F.when(own % 6 > 0, C("close") * 2)})
    return rows, asked


@query("P6_frequency_gaps", oracle("SELECT a.code, a.\"table\", CASE WHEN a.\"table\" IS NULL THEN 'TABLE_MISSING' WHEN h.f IS NULL THEN 'TABLE_EMPTY' ELSE 'FREQ_NOT_IN_TABLE' END AS error, CASE WHEN a.\"table\" IS NOT NULL AND h.f IS NOT NULL THEN h.f END AS available"
    " FROM a LEFT JOIN (SELECT code, min(freq) AS f FROM fm GROUP BY code) h USING (code) WHERE a.\"table\" IS NULL OR h.f IS NULL OR h.f <> '1min'", "minutes", fm=FREQ_SQL, a=ASKED_SQL))  # fmt: skip
def p6_gaps(spark, sf):
    return pit.frequency_gaps(*framed(spark, sf), "1m")


MINUTE_DAYS = "SELECT DISTINCT dt FROM fm WHERE day(dt) % 5 <> 0"


@query("P6_minute_view", oracle(f"SELECT code, time_ms, {rsql(VIEWED)} AS close FROM (SELECT fm.* FROM fm JOIN a USING (code) JOIN (SELECT min(dt) + 2 AS s, max(dt) - 3 AS e FROM fm) ON dt BETWEEN s AND e WHERE {SESSION} AND freq = '1min' AND a.\"table\" IS NOT NULL AND dt IN (SELECT dt FROM dd) AND (dt < e OR minute <= 800))", "minutes", fm=FREQ_SQL, a=ASKED_SQL, dd=MINUTE_DAYS))
def p6_view(spark, sf):
    rows, asked = framed(spark, sf)
    days = rows.where(F.day("dt") % 5 != 0).select("dt").distinct()
    first, last = rows.agg(F.date_add(F.min("dt"), 2), F.date_sub(F.max("dt"), 3)).first()
    got = pit.minute_range(rows, asked, "1m", days, F.lit(first), F.lit(last), 800, "pre", ["close"])
    return got.select("code", "time_ms", rnd("close").alias("close"))


@query("P7_last_n_minutes", oracle(f"SELECT code, time_ms, {rsql('close')} AS close FROM minutes WHERE {SESSION} QUALIFY row_number() OVER (PARTITION BY code ORDER BY time_ms DESC) <= 5", "minutes"))
def p7(spark, sf):
    return pit.last_bars(pit.session_minutes(minutes(spark, sf)), 5, time="time_ms").select("code", "time_ms", rnd("close").alias("close"))


@query("P8_exclusive_cutoff", oracle(f"SELECT code, count(*) AS n, max(minute) AS last_minute FROM minutes WHERE {SESSION} AND minute <= 840 - 5 GROUP BY code", "minutes"))
def p8(spark, sf):
    return pit.session_minutes(minutes(spark, sf), 840, 5).groupBy("code").agg(F.count("*").alias("n"), F.max("minute").alias("last_minute"))


@query("P9_benchmark", oracle(shown_sql("bars WHERE code = '000001' AND dt >= DATE '1997-01-01'", "close"), "bars"))
def p9(spark, sf):
    return shown(bars(spark, sf).where("code = '000001' AND dt >= '1997-01-01'"), "close")


@query("P10_latest_valuation", oracle(shown_sql(f"(SELECT * FROM valuation WHERE dt <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) = 1)", "pe_ttm", "pb"), "valuation"))
def p10(spark, sf):
    return shown(pit.last_bars(valuation(spark, sf), 1, at_day()), "pe_ttm", "pb")


SHARES_SQL = "SELECT code, dt AS ann_day, date_trunc('month', dt)::DATE AS end_day, pb AS shares FROM valuation"


def shares(spark, sf):
    return valuation(spark, sf).select("code", C("dt").alias("ann_day"), F.to_date(F.date_trunc("month", "dt")).alias("end_day"), C("pb").alias("shares"))


@query("P11_monthly_share", oracle(f"SELECT code, end_day::VARCHAR AS end_day, ann_day::VARCHAR AS ann_day, shares FROM s WHERE end_day <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY end_day DESC, ann_day DESC) = 1", "valuation", s=SHARES_SQL))
def p11(spark, sf):
    return shown(latest(shares(spark, sf).where(C("end_day") <= at_day()), "code", F.desc("end_day"), F.desc("ann_day")), "shares", keys=("code", "end_day", "ann_day"))


@query("P12_share_as_announced", oracle(f"SELECT code, end_day::VARCHAR AS end_day, ann_day::VARCHAR AS ann_day, shares FROM s WHERE ann_day <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY ann_day DESC, end_day DESC) = 1", "valuation", s=SHARES_SQL))
def p12(spark, sf):
    return shown(latest(shares(spark, sf).where(C("ann_day") <= at_day()), "code", F.desc("ann_day"), F.desc("end_day")), "shares", keys=("code", "end_day", "ann_day"))


VALUED_SQL = f"""SELECT v.code, v.circ_mv / 1e8 AS cap, coalesce(s.shares, v.circ_mv / nullif(b.close, 0)) AS floats, v.pb FROM (SELECT * FROM valuation WHERE dt <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) = 1) v
    LEFT JOIN (SELECT code, close FROM bars WHERE dt <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) = 1) b USING (code)
    LEFT JOIN (SELECT code, pb AS shares FROM valuation WHERE dt <= DATE '{AT}' AND code::INTEGER % 2 = 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) = 1) s USING (code)"""


def valued(spark, sf):
    v = pit.last_bars(valuation(spark, sf), 1, at_day())
    b = pit.last_bars(bars(spark, sf), 1, at_day()).select("code", "close")
    s = v.where(number() % 2 == 0).select("code", C("pb").alias("shares"))
    return v.join(b, "code", "left").join(s, "code", "left").select("code", (C("circ_mv") / 1e8).alias("cap"), F.coalesce("shares", F.try_divide("circ_mv", "close")).alias("floats"), "pb")


@query("P13_valuation_builder", oracle(shown_sql("v", "cap", "floats", "pb", digits=4, keys=("code",)), "bars", "valuation", v=VALUED_SQL))
def p13(spark, sf):
    return shown(valued(spark, sf), "cap", "floats", "pb", digits=4, keys=("code",))


@query("P14_query_builder", oracle(f"SELECT code, {rsql('cap', 4)} AS cap FROM v WHERE cap >= 5 ORDER BY cap DESC, code LIMIT 20", "bars", "valuation", v=VALUED_SQL))
def p14(spark, sf):
    got = pit.ordered_query(valued(spark, sf), [("cap", ">=", 5.0), ("nothing", ">", 1)], [("code", True), ("cap", False)], 20, ["code", "cap"])
    return got.select("code", rnd("cap", 4).alias("cap"))


@query("P15_preload_valuation", oracle(f"SELECT code, {rsql('coalesce(d.pe_ttm, m.pe)')} AS pe, d.pe_ttm IS NOT NULL AS daily FROM (SELECT code, pe_ttm FROM valuation WHERE dt = DATE '{AT}') d FULL JOIN (SELECT code, arg_max(pe_ttm, dt) AS pe FROM valuation WHERE dt <= DATE '{AT}' - 30 GROUP BY 1) m USING (code)", "valuation"))
def p15(spark, sf):
    v = valuation(spark, sf)
    daily = v.where(C("dt") == at_day()).select("code", "pe_ttm")
    monthly = v.where(C("dt") <= F.date_sub(at_day(), 30)).groupBy("code").agg(F.max_by("pe_ttm", "dt").alias("pe"))
    return daily.join(monthly, "code", "full").select("code", rnd(F.coalesce("pe_ttm", "pe")).alias("pe"), C("pe_ttm").isNotNull().alias("daily"))


@query("P16_fin_indicator", oracle(f"SELECT code, end_day::VARCHAR AS end_day, ann_day::VARCHAR AS ann_day, shares FROM s WHERE ann_day <= DATE '{AT}' AND year(ann_day) BETWEEN 1995 AND 1996 AND month(end_day) IN (3, 6, 9, 12)", "valuation", s=SHARES_SQL))
def p16(spark, sf):
    got = shares(spark, sf).where((C("ann_day") <= at_day()) & F.year("ann_day").between(1995, 1996) & F.month("end_day").isin(3, 6, 9, 12))
    return shown(got, "shares", keys=("code", "end_day", "ann_day"))


@query("P17_strategy_events", oracle("SELECT code, dt::VARCHAR AS dt, status FROM status_events WHERE status = 'ST' AND dt BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' ORDER BY dt, code", "status_events"))
def p17(spark, sf):
    got = status_events(spark, sf).where("status = 'ST' AND dt BETWEEN '1996-01-01' AND '1997-12-31'")
    return shown(got.orderBy(C("dt"), C("code").asc_nulls_last()), "status")


@query("P18_corporate_actions", oracle(f"SELECT code, ex_day::VARCHAR AS ex_day, {rsql('coalesce(CASE WHEN cash > 0.05 THEN cash END, stock)')} AS amount FROM dividends WHERE ex_day = DATE '1995-06-12'", "dividends"))
def p18(spark, sf):
    from ..plans.views import dividends

    got = dividends(spark, sf).where("ex_day = '1995-06-12'").withColumn("amount", F.coalesce(F.when(C("cash") > 0.05, C("cash")), C("stock")))
    return shown(got, "amount", keys=("code", "ex_day"))


LISTED_SQL = """SELECT code, list_day::VARCHAR AS list_day, source FROM (SELECT code, min(dt) AS list_day, 'valuation' AS source FROM valuation WHERE code::INTEGER % 3 = 0 GROUP BY 1 UNION ALL SELECT code, min(dt), 'bars' FROM bars WHERE NOT (code IN (SELECT code FROM valuation WHERE code::INTEGER % 3 = 0)) GROUP BY 1)"""


@query("P19_listing_dates", oracle(LISTED_SQL, "bars", "valuation"))
def p19(spark, sf):
    got = pit.listing_dates([("valuation", valuation(spark, sf).where(number() % 3 == 0)), ("bars", bars(spark, sf))])
    return got.select("code", C("list_day").cast("string").alias("list_day"), "source")


@query("P20_security_metadata", oracle("SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS code, s_name AS name, 'stock' AS kind FROM supplier UNION ALL SELECT lpad(c_custkey::VARCHAR, 6, '0'), c_name, 'fund' FROM customer"))
def p20(spark, sf):
    one = lambda t, k, n, kind: table(spark, sf, t).select(F.lpad(C(k).cast("string"), 6, "0").alias("code"), C(n).alias("name"), F.lit(kind).alias("kind"))
    return one("supplier", "s_suppkey", "s_name", "stock").unionByName(one("customer", "c_custkey", "c_name", "fund"))


@query("P21_index_members", oracle(f"SELECT m.index_code, m.code, {rsql('m.weight')} AS weight FROM index_members m JOIN (SELECT index_code, max(month) AS month FROM index_meta WHERE status = 'complete' AND month <= DATE '{AT}' GROUP BY 1) l USING (index_code, month)", "index_members", "index_meta"))
def p21(spark, sf):
    return pit.index_members_at(index_members(spark, sf), index_meta(spark, sf), at_day()).select("index_code", "code", rnd("weight").alias("weight"))


@query("P22_traded_last_day", oracle(f"SELECT DISTINCT code FROM bars WHERE dt = (SELECT max(dt) FROM bars WHERE dt <= DATE '{AT}')", "bars"))
def p22(spark, sf):
    b = bars(spark, sf).where(C("dt") <= at_day()).select("code", "dt")
    return b.join(F.broadcast(b.agg(F.max("dt").alias("dt"))), "dt").select("code").distinct()


@query("P23_fund_universe", oracle(f"SELECT lpad(p_partkey::VARCHAR, 6, '0') AS code, p_type AS kind FROM part WHERE p_type NOT LIKE '%COPPER%' AND lpad(p_partkey::VARCHAR, 6, '0') IN (SELECT code FROM bars WHERE dt <= DATE '{AT}')", "bars"))
def p23(spark, sf):
    part = table(spark, sf, "part").select(F.lpad(C("p_partkey").cast("string"), 6, "0").alias("code"), C("p_type").alias("kind")).where(~C("kind").contains("COPPER"))
    return part.join(bars(spark, sf).where(C("dt") <= at_day()), "code", "left_semi")


@query("P24_active_list", oracle("SELECT code, dt::VARCHAR AS dt, volume FROM bars WHERE dt = (SELECT max(dt) FROM bars WHERE k % 3 = 0) AND regexp_matches(code, '^0000[0-5]') AND volume > 0", "bars"))
def p24(spark, sf):
    b = bars(spark, sf)
    last = b.where("k % 3 = 0").agg(F.max("dt").alias("dt"))
    return shown(b.join(F.broadcast(last), "dt").where(C("code").rlike("^0000[0-5]") & (C("volume") > 0)), "volume")


@query("P25_fund_types", oracle("SELECT p_partkey AS id, lower(trim(p_brand)) AS fund_type FROM part WHERE p_size > 10"))
def p25(spark, sf):
    return table(spark, sf, "part").where("p_size > 10").select(C("p_partkey").alias("id"), F.lower(F.trim("p_brand")).alias("fund_type"))


STATUS_SQL = f"""SELECT c.code, coalesce(s.st, false) AS st, coalesce(b.volume = 0, false) AS halt, coalesce(b.close < 1, false) AS risk, b.code IS NULL AS delisted FROM (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS code FROM supplier) c
    LEFT JOIN (SELECT * FROM bars WHERE dt = DATE '{AT}') b USING (code) LEFT JOIN (SELECT code, status = 'ST' AS st FROM status_events WHERE dt <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) = 1) s USING (code)"""


def statuses(spark, sf):
    codes = table(spark, sf, "supplier").select(F.lpad(C("s_suppkey").cast("string"), 6, "0").alias("code"))
    return pit.status_at(codes, bars(spark, sf), status_events(spark, sf), at_day())


@query("P26_status_at", oracle(STATUS_SQL, "bars", "status_events"))
def p26(spark, sf):
    return statuses(spark, sf)


@query("P27_status_filter", oracle(f"SELECT code FROM ({STATUS_SQL}) WHERE NOT (st OR risk OR halt OR delisted)", "bars", "status_events"))
def p27(spark, sf):
    return pit.filter_by_status(statuses(spark, sf)).select("code")


@query("P28_industry_at", oracle(f"SELECT code, max(industry) AS industry, count(*) AS n, count(*) > 1 AS ambiguous FROM membership WHERE from_day <= DATE '{AT}' AND (to_day IS NULL OR to_day >= DATE '{AT}') GROUP BY code", "membership"))
def p28(spark, sf):
    return member_at(membership(spark, sf), at_day()).groupBy("code").agg(F.max("industry").alias("industry"), F.count("*").alias("n"), (F.count("*") > 1).alias("ambiguous"))


@query("P29_trade_days", oracle(f"SELECT dt::VARCHAR AS day, row_number() OVER (ORDER BY dt DESC) AS back FROM (SELECT DISTINCT dt FROM bars WHERE dt <= DATE '{AT}') QUALIFY back <= 30", "bars"))
def p29(spark, sf):
    days = pit.trade_days(bars(spark, sf)).where(C("day") <= at_day()).orderBy(F.desc("day")).limit(30)
    return days.select(C("day").cast("string").alias("day"), F.row_number().over(Window.orderBy(F.desc("day"))).alias("back"))


@query("P30_calendar", oracle(f"SELECT bool_or(dt = DATE '{AT}') AS is_open, min(CASE WHEN dt > DATE '{AT}' THEN dt END)::VARCHAR AS next_day, max(CASE WHEN dt < DATE '{AT}' THEN dt END)::VARCHAR AS previous_day, count(DISTINCT dt) = max(dt) - min(dt) + 1 AS complete FROM bars", "bars"))
def p30(spark, sf):
    d = C("dt")
    return bars(spark, sf).agg(F.bool_or(d == at_day()).alias("is_open"), F.min(F.when(d > at_day(), d)).cast("string").alias("next_day"), F.max(F.when(d < at_day(), d)).cast("string").alias("previous_day"), (F.count_distinct(d) == F.datediff(F.max(d), F.min(d)) + 1).alias("complete"))


EXPECT_SQL = "SELECT dt, unnest(list_concat([570], range(571, 691), range(781, 901))) AS minute FROM (SELECT DISTINCT make_timestamp(time_ms * 1000)::DATE AS dt FROM minutes)"


def minute_days(spark, sf):
    return minutes(spark, sf).withColumn("dt", F.to_date(F.timestamp_millis("time_ms")))


@query("P31_expected_minutes", oracle("SELECT dt::VARCHAR AS dt, count(*) AS n, min(minute) AS first, max(minute) AS last FROM e GROUP BY dt", "minutes", e=EXPECT_SQL))
def p31(spark, sf):
    days = minute_days(spark, sf).select("dt").distinct()
    return pit.expected_minutes(days).groupBy(C("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"), F.min("minute").alias("first"), F.max("minute").alias("last"))


@query("P32_missing_bars", oracle("SELECT e.dt::VARCHAR AS dt, e.minute FROM e WHERE NOT EXISTS (SELECT 1 FROM minutes m WHERE make_timestamp(m.time_ms * 1000)::DATE = e.dt AND m.minute = e.minute)", "minutes", e=EXPECT_SQL))
def p32(spark, sf):
    m = minute_days(spark, sf)
    return pit.expected_minutes(m.select("dt").distinct()).join(m, ["dt", "minute"], "left_anti").select(C("dt").cast("string").alias("dt"), "minute")


@query("P33_no_halt_days", oracle(f"SELECT code, count(*) AS n FROM (SELECT code, volume FROM bars WHERE dt <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) <= 10) GROUP BY code HAVING count(*) = 10 AND min(volume) >= 10", "bars"))
def p33(spark, sf):
    got = pit.last_bars(bars(spark, sf), 10, at_day()).groupBy("code").agg(F.count("*").alias("n"), F.min("volume").alias("least"))
    return got.where("n = 10 AND least >= 10").select("code", "n")


@query("P34_listing_age", oracle(f"SELECT code, min(dt)::VARCHAR AS list_day, count(*) AS bars_since FROM bars WHERE dt <= DATE '{AT}' GROUP BY code HAVING min(dt) < DATE '{AT}' - 365 AND count(*) > 60", "bars"))
def p34(spark, sf):
    got = bars(spark, sf).where(C("dt") <= at_day()).groupBy("code").agg(F.min("dt").alias("d"), F.count("*").alias("bars_since"))
    return got.where((C("d") < F.date_sub(at_day(), 365)) & (C("bars_since") > 60)).select("code", C("d").cast("string").alias("list_day"), "bars_since")


@query("P35_smallest_caps", oracle(f"SELECT dt::VARCHAR AS dt, code, {rsql('circ_mv', 2)} AS circ_mv FROM valuation WHERE dt >= DATE '1998-01-01' QUALIFY row_number() OVER (PARTITION BY dt ORDER BY circ_mv, code) <= 3", "valuation"))
def p35(spark, sf):
    w = Window.partitionBy("dt").orderBy("circ_mv", "code")
    return shown(valuation(spark, sf).where("dt >= '1998-01-01'").withColumn("n", F.row_number().over(w)).where("n <= 3"), "circ_mv", digits=2)


@query("P36_market_value", oracle(f"""SELECT code, dt::VARCHAR AS dt, {rsql('CASE WHEN own IS NULL OR own <= 0 THEN pb * close ELSE own END', 2)} AS mv, coalesce(abs(own / nullif(pb * close, 0) - 1) > 0.05, false) AS off
    FROM (SELECT v.code, v.dt, v.pb, b.close, CASE WHEN v.pb::INTEGER % 2 = 0 THEN v.circ_mv / 1e6 END AS own FROM valuation v ASOF LEFT JOIN bars b ON v.code = b.code AND v.dt >= b.dt)""", "bars", "valuation"))  # fmt: skip
def p36(spark, sf):
    joined = asof(valuation(spark, sf), bars(spark, sf), "code", "dt", "dt", ["close"]).withColumn("own", F.when(C("pb").cast("int") % 2 == 0, C("circ_mv") / 1e6))
    derived = C("pb") * C("close")
    out = joined.withColumn("mv", F.when(C("own").isNull() | (C("own") <= 0), derived).otherwise(C("own"))).withColumn("off", F.coalesce(F.abs(F.try_divide("own", derived) - 1) > 0.05, F.lit(False)))
    return shown(out, "mv", "off", digits=2)


RISK_SQL = "CASE WHEN price_risk AND cap_risk THEN 'both' WHEN price_risk THEN 'price' WHEN cap_risk THEN 'market_cap' ELSE 'none' END"


@query("P37_risk_source", oracle(f"""SELECT code, dt::VARCHAR AS dt, st, {RISK_SQL} AS source FROM (SELECT b.code, b.dt, coalesce(s.status = 'ST', false) AS st, b.close < 100 AS price_risk,
    coalesce((SELECT min(v.circ_mv) < 5e8 FROM valuation v WHERE v.code = b.code AND v.dt BETWEEN b.dt - 20 AND b.dt), false) AS cap_risk FROM bars b ASOF LEFT JOIN status_events s ON b.code = s.code AND b.dt >= s.dt)""", "bars", "valuation", "status_events"))  # fmt: skip
def p37(spark, sf):
    from ..operators.joins import range_minimum
    from ..plans.views import DAY_MS

    b = asof(bars(spark, sf).select("code", "dt", "time", "close"), status_events(spark, sf), "code", "dt", "dt", ["status"])
    b = range_minimum(b, valuation(spark, sf), "code", "time", "circ_mv", 20 * DAY_MS, "low")
    price, cap = C("close") < 100, F.coalesce(C("low") < 5e8, F.lit(False))
    source = F.when(price & cap, "both").when(price, "price").when(cap, "market_cap").otherwise("none")
    return b.select("code", C("dt").cast("string").alias("dt"), F.coalesce(C("status") == "ST", F.lit(False)).alias("st"), source.alias("source"))


@query("P38_bar_bounds", oracle("SELECT code, min(dt)::VARCHAR AS first_day, max(dt)::VARCHAR AS last_day FROM bars GROUP BY code", "bars"))
def p38(spark, sf):
    return bars(spark, sf).groupBy("code").agg(F.min("dt").cast("string").alias("first_day"), F.max("dt").cast("string").alias("last_day"))


@query("P40_get_price", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('amount')} AS money FROM bars WHERE code IN ('000001', '000004') AND dt <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC) <= 15", "bars"))
def p40(spark, sf):
    return shown(pit.get_price(bars(spark, sf), ["000001", "000004"], count=15, end=AT, fields=["money"]), "money")


@query("R1_nulls_last", oracle("SELECT code, dt::VARCHAR AS dt, prev, row_number() OVER (ORDER BY prev NULLS LAST, code, dt) AS place FROM (SELECT code, dt, lag(volume) OVER (PARTITION BY code ORDER BY dt) AS prev FROM bars)", "bars"))
def r1(spark, sf):
    rows = bars(spark, sf).withColumn("prev", S.ref("volume")).select("code", "dt", "prev")
    return shown(pit.placed(rows, [C("prev").asc_nulls_last(), C("code").asc(), C("dt").asc()], shared_path(spark, "ordered")), "prev", "place")


@query("R2_top_per_group", oracle(shown_sql("(SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY volume DESC, dt) <= 3)", "volume"), "bars"))
def r2(spark, sf):
    w = Window.partitionBy("code").orderBy(F.desc("volume"), "dt")
    return shown(bars(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 3"), "volume")


@query("R3_union_literals", oracle("SELECT code, dt::VARCHAR AS dt, 'low' AS band FROM bars WHERE volume < 5 UNION ALL SELECT code, dt::VARCHAR, 'high' FROM bars WHERE volume > 45", "bars"))
def r3(spark, sf):
    b = bars(spark, sf)
    return shown(b.where("volume < 5").withColumn("band", F.lit("low")).unionByName(b.where("volume > 45").withColumn("band", F.lit("high"))), "band")


@query("R4_dedup", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('close')} AS close FROM dirty_bars QUALIFY row_number() OVER (PARTITION BY code, dt ORDER BY copy DESC) = 1", "dirty_bars"))
def r4(spark, sf):
    from ..plans.views import dirty_bars

    return shown(latest(dirty_bars(spark, sf), ["code", "dt"], F.desc("copy")), "close")


@query("R5_set_operations", oracle("WITH a AS (SELECT code, dt FROM bars WHERE k % 2 = 0), b AS (SELECT code, dt FROM bars WHERE k % 3 = 0) SELECT code, dt::VARCHAR AS dt, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT code, dt::VARCHAR, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)".replace("WITH a", "SELECT * FROM (WITH a") + ")", "bars"))
def r5(spark, sf):
    b = bars(spark, sf)
    one, two = b.where("k % 2 = 0").select("code", "dt"), b.where("k % 3 = 0").select("code", "dt")
    return shown(one.intersect(two).withColumn("part", F.lit("both")).unionByName(one.subtract(two).withColumn("part", F.lit("first"))), "part")


@query("R6_quantiles", oracle(f"SELECT code, {rsql('median(close)')} AS med, {rsql('quantile_cont(close, 0.95)')} AS p95, {rsql('quantile_cont(close, 0.99)')} AS p99 FROM bars GROUP BY code", "bars"))
def r6(spark, sf):
    p = lambda q: rnd(F.percentile("close", F.lit(q)))
    return bars(spark, sf).groupBy("code").agg(rnd(F.median("close")).alias("med"), p(0.95).alias("p95"), p(0.99).alias("p99"))
