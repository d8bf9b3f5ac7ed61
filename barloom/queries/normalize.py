"""Queries of normalisation (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as n
from ..operators.indicators import S
from ..operators.joins import latest
from ..operators.pit import in_session
from ..plans.views import bars, membership, minutes, oracle, table, trades
from .registry import W, lag, query, rnd, rsql, shown, shown_sql, steps

C = F.col
FORMS = "CASE k % 3 WHEN 0 THEN code || '.SH' WHEN 1 THEN 'sh.' || code ELSE 'x' || code END"


def forms():
    k = C("k") % 3
    return F.when(k == 0, F.concat("code", F.lit(".SH"))).when(k == 1, F.concat(F.lit("sh."), "code")).otherwise(F.concat(F.lit("x"), "code"))


@query("N1_column_map", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('close')} AS last_price, amount AS money, volume FROM bars", "bars"))
def n1(spark, sf):
    got = n.map_columns(bars(spark, sf), {"close": "last_price"}, {"money": "amount"})
    return got.select("code", C("dt").cast("string").alias("dt"), rnd("last_price").alias("last_price"), "money", "volume")


@query("N2_normalize_code", oracle(f"SELECT f AS form, coalesce(nullif(regexp_extract(f, '^(\\d{{6}})\\.(?:SH|SZ|BJ|SI)$', 1), ''), nullif(regexp_extract(f, '(\\d{{6}})', 1), '')) AS raw, count(*) AS n FROM (SELECT {FORMS} AS f FROM bars) GROUP BY 1, 2", "bars"))
def n2(spark, sf):
    return bars(spark, sf).select(forms().alias("form")).groupBy("form", n.normalize_code(C("form")).alias("raw")).agg(F.count("*").alias("n"))


SIX = "lpad(((p_partkey * 7919) % 900000 + 1)::VARCHAR, 6, '0')"


def six():
    return F.lpad(((C("p_partkey") * 7919) % 900000 + 1).cast("string"), 6, "0")


@query("N3_suffixed", oracle(f"SELECT p_partkey AS id, c || '.' || CASE WHEN c LIKE '6%' THEN 'SH' WHEN c LIKE '0%' OR c LIKE '3%' THEN 'SZ' ELSE 'BJ' END AS code, c || '.SH' AS ss FROM (SELECT p_partkey, {SIX} AS c FROM part)"))
def n3(spark, sf):
    p = table(spark, sf, "part").select(C("p_partkey").alias("id"), six().alias("c"))
    return p.select("id", n.to_suffixed(C("c")).alias("code"), n.to_suffixed(F.concat("c", F.lit(".SS"))).alias("ss"))


@query("N4_to_ms", oracle("SELECT code, dt::VARCHAR AS dt, epoch_ms(dt::TIMESTAMP) - 28800000 AS a, time AS b, (time // 1000) * 1000 AS c, epoch_ms(dt::TIMESTAMP) - 28800000 AS d FROM bars", "bars"))
def n4(spark, sf):
    number = F.date_format("dt", "yyyyMMdd").cast("bigint")
    seconds = F.when(C("time") >= 0, F.expr("time div 1000"))
    return bars(spark, sf).select("code", C("dt").cast("string").alias("dt"), n.to_ms(number).alias("a"), F.when(C("time") > 10**12, n.to_ms(C("time"))).otherwise(C("time")).alias("b"), F.when(seconds > 10**9, n.to_ms(seconds)).otherwise(seconds * 1000).alias("c"), n.to_ms(C("dt").cast("string")).alias("d"))


@query("N5_cloud_time", oracle("SELECT code, time_ms - 28800000 AS utc_ms FROM minutes", "minutes"))
def n5(spark, sf):
    return minutes(spark, sf).select("code", n.cloud_to_ms(C("time_ms"), True).alias("utc_ms"))


@query("N6_ms_to_day", oracle("SELECT code, dt::VARCHAR AS day FROM bars", "bars"))
def n6(spark, sf):
    return bars(spark, sf).select("code", n.ms_to_day(C("time")).alias("day"))


@query("N7_unit", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('TRY_CAST(t AS DOUBLE) * 100', 4)} AS v FROM (SELECT code, dt, CASE WHEN k % 10 = 0 THEN 'bad' ELSE volume::VARCHAR END AS t FROM bars)", "bars"))
def n7(spark, sf):
    return shown(bars(spark, sf).withColumn("v", n.convert_unit(F.when(C("k") % 10 == 0, "bad").otherwise(C("volume").cast("string")), 100)), "v", digits=4)


@query("N8_tick_rounding", oracle("SELECT code, dt::VARCHAR AS dt, round(close + 0.0003, 2) AS close, round(volume, 0) AS volume FROM bars", "bars"))
def n8(spark, sf):
    got = n.tick_rounded(bars(spark, sf).withColumn("close", C("close") + 0.0003))
    return got.select("code", C("dt").cast("string").alias("dt"), "close", "volume")


@query("N9_suspended", oracle("SELECT code, dt::VARCHAR AS dt, CASE WHEN v = 0 THEN 1 ELSE 0 END AS flag FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 THEN NULL ELSE volume END AS v FROM bars)", "bars"))
def n9(spark, sf):
    v = F.when(C("k") % 5 == 0, 0.0).when(C("k") % 7 == 0, None).otherwise(C("volume"))
    return shown(bars(spark, sf).withColumn("flag", n.suspended(v)), "flag")


@query("N10_pct_change", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('CASE WHEN o IS NULL THEN d WHEN abs(o) <= 200 THEN o WHEN abs(d) < 30 THEN d ELSE p END', 4)} AS pct FROM (SELECT *, lag(d) OVER ({W}) AS p, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 9 = 0 THEN 500 ELSE d END AS o FROM (SELECT *, (close / {lag('close')} - 1) * 100 AS d FROM bars))", "bars"))
def n10(spark, sf):
    b = bars(spark, sf).withColumn("d", (C("close") / S.ref("close") - 1) * 100).withColumn("p", S.ref("d"))
    official = F.when(C("k") % 4 == 0, None).when(C("k") % 9 == 0, 500.0).otherwise(C("d"))
    return shown(b.withColumn("o", official).withColumn("pct", n.pct_change(C("o"), C("d"), C("p"))), "pct", digits=4)


@query("N11_fixed_columns", oracle("SELECT code, count(*) AS n, 'daily' AS freq, 'none' AS dividend_type FROM bars GROUP BY code", "bars"))
def n11(spark, sf):
    return n.with_fixed(bars(spark, sf), {"freq": "daily", "dividend_type": "none", "code": "x"}).groupBy("code").agg(F.count("*").alias("n"), F.max("freq").alias("freq"), F.max("dividend_type").alias("dividend_type"))


TXT = "CASE k % 5 WHEN 0 THEN ' TRUE' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' WHEN 3 THEN 'Yes' ELSE '1.0' END"


@query("N12_boolean", oracle(f"SELECT t, CASE WHEN lower(trim(t)) IN ('1', 'true', 't', 'yes', 'y', '1.0') THEN true WHEN lower(trim(t)) IN ('0', 'false', 'f', 'no', 'n', '0.0') THEN false END AS flag, count(*) AS n FROM (SELECT {TXT} AS t FROM bars) GROUP BY 1, 2", "bars"))
def n12(spark, sf):
    t = F.expr(TXT)
    return bars(spark, sf).select(t.alias("t")).groupBy("t", n.to_boolean(C("t")).alias("flag")).agg(F.count("*").alias("n"))


CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{k}'" for k, p in n.KINDS) + " ELSE 'unknown' END"


@query("N13_classify", oracle(f"SELECT c AS code, {CLASS_SQL} AS kind FROM (SELECT {SIX} AS c FROM part)"))
def n13(spark, sf):
    return table(spark, sf, "part").select(six().alias("code")).select("code", n.classify(C("code")).alias("kind"))


@query("N14_exchange", oracle(f"SELECT c AS code, CASE WHEN c LIKE '5%' THEN 'SH' WHEN c LIKE '1%' THEN 'SZ' ELSE 'BJ' END AS fund, CASE WHEN c LIKE '6%' THEN 'SH' WHEN c LIKE '0%' OR c LIKE '3%' THEN 'SZ' ELSE 'BJ' END AS stock FROM (SELECT {SIX} AS c FROM part)"))
def n14(spark, sf):
    return table(spark, sf, "part").select(six().alias("code")).select("code", n.exchange_suffix(C("code"), "fund").alias("fund"), n.exchange_suffix(C("code")).alias("stock"))


@query("N15_legacy_map", oracle("SELECT b.code, count(*) AS n, max(coalesce(m.new_code, b.code)) AS now FROM bars b LEFT JOIN (SELECT DISTINCT code, '920' || substr(code, 4) AS new_code FROM bars WHERE code::INTEGER % 3 = 0) m USING (code) GROUP BY 1", "bars"))
def n15(spark, sf):
    b = bars(spark, sf)
    legacy = b.where("cast(code AS int) % 3 = 0").select("code", F.concat(F.lit("920"), F.substring("code", 4, 3)).alias("new_code")).distinct()
    return b.join(legacy, "code", "left").groupBy("code").agg(F.count("*").alias("n"), F.max(F.coalesce("new_code", "code")).alias("now"))


NAME = "CASE c_custkey % 6 WHEN 0 THEN 'ST ' WHEN 1 THEN '*ST' WHEN 2 THEN ' s*st' WHEN 3 THEN 'DELIST ' ELSE '' END || c_name"


@query("N16_st_name", oracle(f"SELECT id, regexp_matches(upper(trim(t)), '^(ST|\\*ST|S\\*ST|SST)') AS st FROM (SELECT c_custkey AS id, {NAME} AS t FROM customer)"))
def n16(spark, sf):
    return table(spark, sf, "customer").select(C("c_custkey").alias("id"), n.is_st_name(F.expr(NAME)).alias("st"))


@query("N17_limit_share", oracle(f"SELECT code, CASE WHEN p % 7 = 0 THEN 0.05::DOUBLE WHEN kind IN ('star', 'chinext') THEN 0.2::DOUBLE WHEN kind = 'bse' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS share FROM (SELECT c AS code, p, {CLASS_SQL} AS kind FROM (SELECT p_partkey AS p, {SIX} AS c FROM part))"))
def n17(spark, sf):
    p = table(spark, sf, "part").select(six().alias("code"), "p_partkey")
    return p.select("code", n.limit_share(n.classify(C("code")), C("p_partkey") % 7 == 0).alias("share"))


MOVE = f"(close - {lag('close')}) / {lag('close')}"
STATE = steps("bars", {"mv": MOVE}, {"state": "CASE WHEN mv >= 0.098 THEN 1 WHEN mv <= -0.098 THEN -1 ELSE 0 END"})


def stated(spark, sf):
    return bars(spark, sf).withColumn("state", n.limit_state(C("close"), S.ref("close"), F.lit(0.1)))


@query("N18_limit_state", oracle(shown_sql("s2", "=state"), "bars", **STATE))
def n18(spark, sf):
    return shown(stated(spark, sf), "state")


@query("N19_blocked", oracle("SELECT t.action, count(*) AS n, count(*) FILTER ((t.action = 'buy' AND s2.state = 1) OR (t.action = 'sell' AND s2.state = -1)) AS blocked FROM trades t JOIN s2 ON s2.code = t.code AND s2.dt = t.dt GROUP BY 1", "bars", "trades", **STATE))
def n19(spark, sf):
    joined = trades(spark, sf).select("code", "dt", "action").join(stated(spark, sf).select("code", "dt", "state"), ["code", "dt"])
    return joined.groupBy("action").agg(F.count("*").alias("n"), F.count_if(n.blocked(C("state"), C("action"))).alias("blocked"))


@query("N20_halted", oracle("SELECT code, count(*) FILTER (k % 11 = 0 OR volume < 2) AS halts FROM bars GROUP BY code", "bars"))
def n20(spark, sf):
    flag = F.when(C("k") % 11 == 0, 1).otherwise(0)
    volume = F.when(C("volume") < 2, 0.0).otherwise(C("volume"))
    return bars(spark, sf).groupBy("code").agg(F.count_if(n.halted(flag, volume)).alias("halts"))


@query("N21_lots", oracle("SELECT code, dt::VARCHAR AS dt, greatest(floor(amount / 100)::BIGINT * 100, 0) AS lots FROM bars", "bars"))
def n21(spark, sf):
    return shown(bars(spark, sf).withColumn("lots", n.lots(C("amount"))), "lots")


@query("N22_session", oracle("SELECT code, count(*) AS n, count(*) FILTER (minute BETWEEN 571 AND 690 OR minute BETWEEN 781 AND 900) AS stored, count(*) FILTER (minute BETWEEN 570 AND 690 OR minute BETWEEN 780 AND 900) AS clock FROM minutes GROUP BY code", "minutes"))
def n22(spark, sf):
    m = C("minute")
    return minutes(spark, sf).groupBy("code").agg(F.count("*").alias("n"), F.count_if(in_session(m)).alias("stored"), F.count_if(in_session(m, (570, 690), (780, 900))).alias("clock"))


@query("N23_frequency", oracle("SELECT code, CASE k % 4 WHEN 0 THEN 'daily' WHEN 1 THEN '1min' WHEN 2 THEN '5min' ELSE '60min' END AS freq, count(*) AS n FROM bars WHERE k >= 0 GROUP BY 1, 2", "bars"))
def n23(spark, sf):
    label = F.expr("CASE k % 4 WHEN 0 THEN '1d' WHEN 1 THEN '1M' WHEN 2 THEN '5min' ELSE '60m' END")
    return bars(spark, sf).where("k >= 0").groupBy("code", n.frequency(label).alias("freq")).agg(F.count("*").alias("n"))


RULES = (("money", "MONEY|TIN"), ("bond", "BOND|NICKEL"), ("gold", "BRASS"), ("qdii", "COPPER"), ("equity", "STEEL"))
RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(p_type, '{p}') THEN '{k}'" for k, p in RULES) + " ELSE 'other' END"


@query("N24_fund_class", oracle(f"SELECT p_partkey AS id, {RULES_SQL} AS kind, {RULES_SQL} = 'qdii' AS cross_border FROM part"))
def n24(spark, sf):
    kind = n.first_match(C("p_type"), RULES, "other")
    return table(spark, sf, "part").select(C("p_partkey").alias("id"), kind.alias("kind"), (kind == "qdii").alias("cross_border"))


@query("N25_fund_reference", oracle("SELECT b.code, coalesce(CASE WHEN s.s_suppkey % 3 > 0 THEN DATE '1990-01-01' END, b.d0)::VARCHAR AS list_day, CASE WHEN s.s_suppkey % 4 = 0 THEN b.d1 + 1 END::VARCHAR AS delist_day FROM supplier s JOIN (SELECT code, min(dt) AS d0, max(dt) AS d1 FROM bars GROUP BY 1) b ON b.code = lpad(s.s_suppkey::VARCHAR, 6, '0')", "bars"))
def n25(spark, sf):
    bounds = bars(spark, sf).groupBy("code").agg(F.min("dt").alias("d0"), F.max("dt").alias("d1"))
    s = table(spark, sf, "supplier").select(F.lpad(C("s_suppkey").cast("string"), 6, "0").alias("code"), C("s_suppkey").alias("i"))
    listed = F.coalesce(F.when(C("i") % 3 > 0, F.lit("1990-01-01").cast("date")), C("d0"))
    joined = latest(s, "code", "i").join(bounds, "code")
    return joined.select("code", listed.cast("string").alias("list_day"), F.when(C("i") % 4 == 0, F.date_add("d1", 1)).cast("string").alias("delist_day"))


@query("N26_aliases", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('amount')} AS amount, {rsql('amount')} AS money, {rsql('close')} AS price FROM bars", "bars"))
def n26(spark, sf):
    return shown(n.with_aliases(bars(spark, sf), {"money": "amount", "price": "close"}), "amount", "money", "price")


@query("N27_trend", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('open')} AS price, {rsql('amount / nullif(volume, 0)')} AS average FROM bars", "bars"))
def n27(spark, sf):
    return shown(n.trend(bars(spark, sf)), "price", "average")


@query("N28_source_lock", oracle("SELECT data_source, count(*) AS n FROM dirty_bars WHERE data_source IN ('alpha') GROUP BY 1", "dirty_bars"))
def n28(spark, sf):
    from ..plans.views import dirty_bars

    rules = spark.createDataFrame([("alpha",)], "data_source string")
    return dirty_bars(spark, sf).join(F.broadcast(rules), "data_source", "left_semi").groupBy("data_source").agg(F.count("*").alias("n"))


@query("N29_name_status", oracle(f"SELECT id, CASE WHEN t IS NULL THEN 'UNKNOWN' WHEN contains(upper(t), 'DELIST') THEN 'DELISTING' WHEN contains(upper(t), '*ST') THEN '*ST' WHEN contains(upper(t), 'ST') THEN 'ST' ELSE 'NORMAL' END AS status FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 > 0 THEN {NAME.replace('c_name', 'substr(c_name, 5, 3)')} END AS t FROM customer)"))
def n29(spark, sf):
    t = F.expr(f"CASE WHEN c_custkey % 11 > 0 THEN {NAME.replace('c_name', 'substr(c_name, 5, 3)')} END")
    return table(spark, sf, "customer").select(C("c_custkey").alias("id"), n.name_status(t).alias("status"))


@query("N30_membership_rows", oracle("SELECT code, industry, epoch_ms(from_day::TIMESTAMP) - 28800000 AS from_ms, epoch_ms(to_day::TIMESTAMP) - 28800000 AS to_ms, 'L1' AS level FROM membership WHERE from_day IS NOT NULL", "membership"))
def n30(spark, sf):
    m = membership(spark, sf).where("from_day IS NOT NULL")
    return n.with_fixed(m.select("code", "industry", n.to_ms(C("from_day").cast("string")).alias("from_ms"), n.to_ms(C("to_day").cast("string")).alias("to_ms")), {"level": "L1"})
