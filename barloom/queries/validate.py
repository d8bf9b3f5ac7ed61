"""Queries of validation (V) and of quality audits (Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit
from ..operators import validate as v
from ..operators.indicators import S
from ..plans.views import bars, dirty_bars, factors, index_members, index_meta, membership, minutes, oracle, status_events, trades, valuation
from .adjust import adj, fresh, o
from .registry import lag, query, rnd, rsql, shown

C = F.col
SHOWN = "code, dt::VARCHAR AS dt, copy"
RULES_SQL = {
    "RequiredValueNull": "close IS NULL", "CodeFormat": "NOT regexp_matches(code, '^\\d{6}')", "DateValid": "coalesce(time <= 0 OR time > 4000000000000, true)",
    "OHLCLogic": "close IS NOT NULL AND (high < greatest(close, open, low) - 1e-9 OR low > least(close, open, high) + 1e-9)",
    "UnitCheck": "coalesce(amount > 0 AND close > 0 AND volume > 0 AND NOT isinf(volume) AND NOT (amount / (close * volume) BETWEEN 0.5 AND 2.0), false)",
    "PositiveNumeric": "coalesce(close <= 0, false)", "InfCheck": "isinf(volume)", "EnumCheck": "data_source NOT IN ('alpha', 'beta')",
}
FAILED = "list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in RULES_SQL.items()) + "], lambda x: x IS NOT NULL)"
JUDGED = f"SELECT *, {FAILED} AS failed FROM dirty_bars"


def rule(name: str, spark_rule, sql: str) -> None:
    """Rows that break one rule."""

    @query(name, oracle(f"SELECT {SHOWN} FROM dirty_bars WHERE {sql}", "dirty_bars"))
    def run(spark, sf):
        return shown(dirty_bars(spark, sf).where(spark_rule()), "copy")


def counted(name: str, view: str, frame, rules, sql: dict[str, str]) -> None:
    """One row per rule with its count."""
    body = " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({e}) AS n FROM {view}" for n, e in sql.items())

    @query(name, oracle(body, view))
    def run(spark, sf):
        return v.tall(v.audit(frame(spark, sf), rules()))


@query("V1_required_columns", oracle("SELECT count(*) AS rows, false AS missing_close, true AS missing_turnover FROM dirty_bars", "dirty_bars"))
def v1(spark, sf):
    d = dirty_bars(spark, sf)
    return d.agg(F.count("*").alias("rows")).select("rows", *[F.lit(c not in d.columns).alias(f"missing_{c}") for c in ("close", "turnover")])


rule("V2_required_null", lambda: v.required("close"), RULES_SQL["RequiredValueNull"])
rule("V3_code_format", v.bad_code, RULES_SQL["CodeFormat"])
rule("V4_date_valid", v.bad_time, RULES_SQL["DateValid"])
rule("V5_st_null", lambda: F.when(C("kind") % 10 == 0, None).otherwise(C("copy")).isNull(), "kind % 10 = 0")
rule("V6_ohlc", v.bad_relation, RULES_SQL["OHLCLogic"])
rule("V7_unit", v.bad_unit, RULES_SQL["UnitCheck"])
rule("V8_type", lambda: v.bad_type("code", "int"), "TRY_CAST(code AS INTEGER) IS NULL")
rule("V9_enum_range", lambda: v.not_in("data_source", ["beta"]) & v.below("volume", 10), "data_source <> 'beta' AND volume < 10")
counted("V10_frequency", "minutes", minutes, lambda: {"grid1": v.off_grid("time_ms", 1), "grid5": v.off_grid("time_ms", 5), "grid30": v.off_grid("time_ms", 30)}, {"grid1": "time_ms % 60000 <> 0", "grid5": "time_ms % 300000 <> 0", "grid30": "time_ms % 1800000 <> 0"})


#: Labels by code: one that is none, another than expected, and expected ones, of which some times are off the grid.
LABELLED = "SELECT *, CASE code::INTEGER % 5 WHEN 0 THEN '7min' WHEN 1 THEN NULL WHEN 2 THEN '1min' ELSE '5min' END AS freq FROM minutes"


@query("V10_frequency_labels", oracle("SELECT count(*) AS missing, count(*) FILTER (freq IS NULL OR freq = '7min') AS invalid, count(*) FILTER (freq = '1min') AS mismatch, count(*) FILTER (time_ms % CASE freq WHEN '1min' THEN 60000 WHEN '5min' THEN 300000 END <> 0) AS grid FROM lb", "minutes", lb=LABELLED))
def v10_labels(spark, sf):
    own = C("code").cast("int") % 5
    rows = minutes(spark, sf).withColumn("freq", F.when(own == 0, "7min").when(own == 1, None).when(own == 2, "1min").otherwise("5min"))
    rules = v.frequency_rules(rows.columns, "freq", "time_ms", "5min")
    without = v.frequency_rules(["code", "time_ms"])["FrequencyMissing"]
    return rows.agg(F.count_if(without).alias("missing"), *[F.count_if(rules[f"Frequency{k.capitalize()}"]).alias(k) for k in ("invalid", "mismatch", "grid")])


#: Adjusted sides with each kind of fault by day.
SIDED = """SELECT CASE WHEN d = 5 THEN NULL ELSE open END AS open_front, CASE WHEN d = 6 THEN low - 1 ELSE high END AS high_front, CASE WHEN d = 7 THEN -low ELSE low END AS low_front, CASE WHEN d = 8 THEN NULL ELSE close END AS close_front,
    CASE WHEN d IN (8, 9) THEN NULL ELSE open END AS open_back, CASE WHEN d IN (8, 9) THEN NULL ELSE high END AS high_back, CASE WHEN d = 9 THEN NULL WHEN d = 8 THEN NULL WHEN d = 10 THEN high + 1 ELSE low END AS low_back, CASE WHEN d = 8 THEN NULL ELSE close END AS close_back
    FROM (SELECT *, day(dt) AS d FROM bars)"""
SIDE_SQL = " UNION ALL ".join(f"SELECT '{s}' AS side, count(*) FILTER (n BETWEEN 1 AND 3) AS incomplete, count(*) FILTER (n = 4 AND least(o, h, l, c) <= 0) AS not_positive, count(*) FILTER (n = 4 AND least(o, h, l, c) > 0 AND (h < greatest(o, l, c) - 1e-9 OR l > least(o, h, c) + 1e-9)) AS relation FROM (SELECT open_{s} AS o, high_{s} AS h, low_{s} AS l, close_{s} AS c, (open_{s} IS NOT NULL)::INTEGER + (high_{s} IS NOT NULL)::INTEGER + (low_{s} IS NOT NULL)::INTEGER + (close_{s} IS NOT NULL)::INTEGER AS n FROM sd)" for s in ("front", "back"))


@query("V11_side_rules", oracle(SIDE_SQL, "bars", sd=SIDED))
def v11_sides(spark, sf):
    d = F.day("dt")
    none = lambda days, x: F.when(d.isin(*days), None).otherwise(x)
    rows = bars(spark, sf).select(
        none([5], C("open")).alias("open_front"), F.when(d == 6, C("low") - 1).otherwise(C("high")).alias("high_front"), F.when(d == 7, -C("low")).otherwise(C("low")).alias("low_front"), none([8], C("close")).alias("close_front"),
        none([8, 9], C("open")).alias("open_back"), none([8, 9], C("high")).alias("high_back"), none([8, 9], F.when(d == 10, C("high") + 1).otherwise(C("low"))).alias("low_back"), none([8], C("close")).alias("close_back"),
    )
    parts = []
    for side in ("front", "back"):
        rules = v.side_rules(side, rows.columns)
        parts.append(rows.agg(F.lit(side).alias("side"), *[F.count_if(F.coalesce(rules[f"Adjustment{k}"], F.lit(False))).alias(n) for k, n in (("Completeness", "incomplete"), ("Positive", "not_positive"), ("OHLC", "relation"))]))
    return parts[0].unionByName(parts[1])


@query("V11_adjusted_side", o("SELECT count(*) FILTER ((close_front IS NOT NULL)::INTEGER + (o IS NOT NULL)::INTEGER BETWEEN 1 AND 1) AS incomplete, count(*) FILTER (least(close_front, o) <= 0) AS not_positive FROM (SELECT f.close_front, a.open_front AS o FROM fresh f JOIN adj a ON a.code = f.code AND a.dt = f.dt)", "fresh"))
def v11(spark, sf):
    rules = v.bad_side(["close_front", "open_front"])
    return fresh(spark, sf).agg(F.count_if(rules["AdjustmentCompleteness"]).alias("incomplete"), F.count_if(rules["AdjustmentPositive"]).alias("not_positive"))


@query("V12_factor_consistency", o("SELECT code, count(*) FILTER (greatest(abs(a / m - 1), abs(b / m - 1)) > 0.02) AS bad FROM (SELECT code, a, b, (a + b) / 2 AS m FROM (SELECT code, close_front / close AS a, open_front / open * CASE WHEN k % 13 = 0 THEN 1.2::DOUBLE ELSE 1 END AS b FROM adj)) GROUP BY code", "adj"))
def v12(spark, sf):
    rows = adj(spark, sf).withColumn("open_front", C("open_front") * F.when(C("k") % 13 == 0, 1.2).otherwise(1.0))
    return rows.groupBy("code").agg(F.count_if(v.inconsistent_ratios(["close_front", "open_front"], ["close", "open"])).alias("bad"))


@query("V13_duplicate_key", oracle(f"SELECT {SHOWN} FROM dirty_bars QUALIFY row_number() OVER (PARTITION BY code, dt ORDER BY copy DESC) = 1", "dirty_bars"))
def v13(spark, sf):
    return shown(v.fix_duplicates(dirty_bars(spark, sf), ["code", "dt"], "copy"), "copy")


@query("V14_pct_range", oracle(f"SELECT count(*) FILTER (abs(pct) > 22) AS warned FROM (SELECT (close / {lag('close')} - 1) * 100 AS pct FROM bars)", "bars"))
def v14(spark, sf):
    return bars(spark, sf).withColumn("pct", (C("close") / S.ref("close") - 1) * 100).agg(F.count_if(F.abs("pct") > 22).alias("warned"))


@query("V15_announce_date", oracle("SELECT count(*) FILTER (ann > DATE '1998-06-01' + 7) AS future, count(*) FILTER (ann < end_day) AS before_end FROM (SELECT dt AS ann, (date_trunc('month', dt) + INTERVAL 10 DAY)::DATE AS end_day FROM valuation)", "valuation"))
def v15(spark, sf):
    rows = valuation(spark, sf).select(C("dt").alias("ann"), F.date_add(F.to_date(F.date_trunc("month", "dt")), 10).alias("end_day"))
    return rows.agg(F.count_if(C("ann") > F.date_add(F.lit("1998-06-01").cast("date"), 7)).alias("future"), F.count_if(C("ann") < C("end_day")).alias("before_end"))


rule("V16_positive", lambda: v.below("close", 0, True), RULES_SQL["PositiveNumeric"])
rule("V17_infinite", lambda: v.infinite("volume"), RULES_SQL["InfCheck"])
counted("V18_extreme_valuation", "valuation", valuation, lambda: {"pe": F.abs("pe_ttm") > 20, "pb": F.abs("pb") > 1}, {"pe": "abs(pe_ttm) > 20", "pb": "abs(pb) > 1"})


@query("V19_gate", oracle("SELECT count(*) AS raw, count(*) FILTER (len(failed) > 0) AS rejected, count(*) FILTER (len(failed) = 0) AS passed, count(*) FILTER (len(failed) > 0) / count(*) <= 0.1 AS ok FROM j", "dirty_bars", j=JUDGED))
def v19(spark, sf):
    return v.gate(v.judge(dirty_bars(spark, sf), v.bar_rules()), 0.1).select("raw", "rejected", "passed", "ok")


@query("V0_rejected_rows", oracle(f"SELECT {SHOWN}, array_to_string(failed, ',') AS failed_rules FROM j WHERE len(failed) > 0", "dirty_bars", j=JUDGED))
def v0(spark, sf):
    _, rejected = v.split(v.judge(dirty_bars(spark, sf), v.bar_rules(), {"CodeFormat": "code", "PositiveNumeric": "close"}))
    return shown(rejected.withColumn("failed_rules", F.array_join("failed_rules", ",")), "copy", "failed_rules")


@query("Q1_columns", oracle("SELECT 'bars' AS name, true AS present, (SELECT count(*) FROM bars) AS n, 'turnover' AS missing, 'warning' AS severity UNION ALL SELECT 'dirty_bars', true, (SELECT count(*) FROM dirty_bars), 'cash,turnover', 'error' UNION ALL SELECT 'nowhere', false, 0, 'code', 'error'", "bars", "dirty_bars"))
def q1(spark, sf):
    required = {"bars": {"code": "error", "dt": "error", "turnover": "warning"}, "dirty_bars": {"cash": "error", "turnover": "warning"}, "nowhere": {"code": "warning"}}
    return audit.required_columns(spark, {"bars": bars(spark, sf), "dirty_bars": dirty_bars(spark, sf)}, required)


counted("Q2_stored_rules", "dirty_bars", dirty_bars, lambda: {"null": v.required("close"), "regex": v.bad_code(), "enum": v.not_in("data_source", ["alpha"]), "gt": v.below("close", 0, True), "ge": v.below("volume", 1)}, {"null": RULES_SQL["RequiredValueNull"], "regex": RULES_SQL["CodeFormat"], "enum": "data_source <> 'alpha'", "gt": "close <= 0", "ge": "volume < 1"})


@query("Q3_duplicate_keys", oracle("SELECT code, dt::VARCHAR AS dt, count(*) AS n FROM dirty_bars GROUP BY code, dirty_bars.dt HAVING count(*) > 1", "dirty_bars"))
def q3(spark, sf):
    return shown(v.duplicate_keys(dirty_bars(spark, sf), ["code", "dt"]), "n")


counted("Q4_price_relation", "dirty_bars", dirty_bars, lambda: {"relation": v.bad_relation(), "negative_volume": v.below("volume", 0), "unit": v.bad_unit()}, {"relation": RULES_SQL["OHLCLogic"], "negative_volume": "volume < 0", "unit": RULES_SQL["UnitCheck"]})


Q5 = """SELECT data_source, count(*) AS n, count(*) FILTER (greatest(abs(a / m - 1), abs(b / m - 1)) > CASE WHEN data_source = 'beta' THEN 0.05 ELSE 0.02 END) AS off FROM (SELECT *, (a + b) / 2 AS m FROM (
    SELECT CASE WHEN k % 3 = 0 THEN 'alpha' ELSE 'beta' END AS data_source, close_front / close AS a, open_front / open * CASE WHEN k % 13 = 0 THEN 1.2::DOUBLE WHEN k % 11 = 0 THEN 1.06::DOUBLE ELSE 1 END AS b FROM adj)) GROUP BY 1"""


@query("Q5_factor_by_source", o("SELECT *, CASE WHEN off = 0 THEN 'ok' WHEN data_source = 'beta' THEN 'warning' ELSE 'error' END AS severity FROM (" + Q5 + ")", "adj"))
def q5(spark, sf):
    wrong = F.when(C("k") % 13 == 0, 1.2).when(C("k") % 11 == 0, 1.06).otherwise(1.0)
    rows = adj(spark, sf).withColumns({"open_front": C("open_front") * wrong, "data_source": F.when(C("k") % 3 == 0, "alpha").otherwise("beta")})
    return audit.factor_by_source(rows, ["close_front", "open_front"], ["close", "open"], "data_source", {"beta": (0.05, "warning")})


@query("Q6_adjust_coverage", o("SELECT code, count(*) FILTER (close_front IS NULL) AS no_side FROM fresh GROUP BY code", "fresh"))
def q6(spark, sf):
    return audit.adjust_coverage(fresh(spark, sf))


@query("Q7_adjust_anchor", o(f"SELECT code, {rsql('a')} AS at_first, {rsql('b')} AS at_last, abs(a - 1) > 0.02 AS first_off, abs(b - 1) > 0.02 AS last_off FROM (SELECT code, arg_min(close_back / close, dt) AS a, arg_max(close_front / close, dt) * CASE WHEN code::INTEGER % 4 = 0 THEN 1.1::DOUBLE ELSE 1 END AS b FROM adj WHERE close_front IS NOT NULL AND close > 0 GROUP BY code)", "adj"))
def q7(spark, sf):
    rows = adj(spark, sf).withColumn("close_front", C("close_front") * F.when(C("code").cast("int") % 4 == 0, 1.1).otherwise(1.0))
    return audit.anchors_off(rows).select("code", rnd("at_first").alias("at_first"), rnd("at_last").alias("at_last"), "first_off", "last_off")


@query("Q8_return_consistency", o(f"SELECT code, count(*) FILTER (abs(a - b) > 1) AS off FROM (SELECT code, (close_front / {lag('close_front')} - 1) * 100 AS a, (close / {lag('close')} - 1) * 100 AS b FROM adj) GROUP BY code", "adj"))
def q8(spark, sf):
    return audit.return_consistency(adj(spark, sf))


counted("Q9_minute_grid", "minutes", minutes, lambda: {"grid15": v.off_grid("time_ms", 15), "grid60": v.off_grid("time_ms", 60)}, {"grid15": "time_ms % 900000 <> 0", "grid60": "time_ms % 3600000 <> 0"})
counted("Q10_future", "valuation", valuation, lambda: {"future": C("dt") > F.lit("1998-01-08").cast("date"), "past": C("dt") <= F.lit("1998-01-01").cast("date")}, {"future": "dt > DATE '1998-01-08'", "past": "dt <= DATE '1998-01-01'"})


@query("Q11_watermark", oracle("SELECT code, CASE WHEN mark > last THEN 'ahead' WHEN mark < last THEN 'behind' ELSE 'equal' END AS state FROM (SELECT code, max(k) AS last, max(k) + (code::INTEGER % 3) - 1 AS mark FROM bars GROUP BY code)", "bars"))
def q11(spark, sf):
    last = bars(spark, sf).groupBy("code").agg(F.max("k").alias("last"))
    marks = last.select("code", (C("last") + C("code").cast("int") % 3 - 1).alias("mark"))
    return audit.watermark_state(marks, last)


counted("Q12_traceability", "dirty_bars", dirty_bars, lambda: {"no_source": C("data_source").isNull(), "not_authority": v.not_in("data_source", ["alpha"])}, {"no_source": "data_source IS NULL", "not_authority": "data_source <> 'alpha'"})


@query("Q13_dividend_checks", oracle("SELECT count(*) FILTER (cash < 0) AS negative, count(*) FILTER (proc <> 'implemented') AS planned, count(*) FILTER (stock > cash) AS inverted, count(cash) = 0 AS all_null FROM dividends", "dividends"))
def q13(spark, sf):
    from ..plans.views import dividends

    return audit.dividend_checks(dividends(spark, sf))


LEDGER = "SELECT code AS batch_id, count(*) AS aligned, count(*) FILTER (k % 3 > 0) AS passed, count(*) FILTER (k % 3 = 0) AS rejected, (code::INTEGER % 4 = 0)::INTEGER AS fixed, count(*) FILTER (k % 3 > 0) AS written FROM bars GROUP BY code"


def ledger(spark, sf):
    k = C("k") % 3
    rows = bars(spark, sf).groupBy(C("code").alias("batch_id")).agg(F.count("*").alias("aligned"), F.count_if(~(k > 0) & ~(k < 0)).alias("rejected"), F.count_if(k > 0).alias("passed"), F.count_if(k > 0).alias("written"))
    return rows.withColumn("fixed", (C("batch_id").cast("int") % 4 == 0).cast("int"))


def quarantined(spark, sf):
    """Rejected rows as they lie in quarantine; every seventh day's row has lost its rules, and every fifth day's is marked fixed."""
    b = bars(spark, sf).where("k % 3 = 0 AND k % 35 <> 0")
    return b.select(C("code").alias("batch_id"), F.lit("bars").alias("table"), C("dt").cast("string").alias("payload"), F.when(C("k") % 7 != 0, "UnitCheck").alias("failed_rules"), F.when(C("k") % 5 == 0, "fixed").otherwise("pending_repair").alias("status"))


@query("Q14_conservation", oracle("""SELECT count(*) AS batches, count(*) FILTER (aligned <> passed + rejected + fixed) AS unbalanced, count(*) FILTER (written > passed) AS overwritten, count(*) FILTER (batch_id::INTEGER % 3 = 0 AND day >= DATE '1998-06-01') AS failed_recent,
    count(*) FILTER (coalesce(n, 0) < rejected) AS not_in_quarantine FROM l LEFT JOIN (SELECT code AS batch_id, max(dt) AS day FROM bars GROUP BY 1) USING (batch_id) LEFT JOIN (SELECT code AS batch_id, count(*) AS n FROM bars WHERE k % 3 = 0 AND k % 35 <> 0 GROUP BY 1) USING (batch_id)""", "bars", l=LEDGER))  # fmt: skip
def q14(spark, sf):
    days = bars(spark, sf).groupBy(C("code").alias("batch_id")).agg(F.max("dt").alias("day"))
    rows = ledger(spark, sf).join(days, "batch_id", "left").withColumn("status", F.when(C("batch_id").cast("int") % 3 == 0, "failed").otherwise("done"))
    return audit.stage_audit(rows, quarantined(spark, sf), F.lit("1998-06-01").cast("date"))


@query("Q15_quarantine", oracle("SELECT count(*) AS rows, count(*) FILTER (k % 5 <> 0) AS pending, 0 AS null_batch_id, 0 AS null_payload, count(*) FILTER (k % 7 = 0) AS null_failed_rules FROM bars WHERE k % 3 = 0 AND k % 35 <> 0", "bars"))
def q15(spark, sf):
    return audit.quarantine_audit(quarantined(spark, sf), ["batch_id", "payload", "failed_rules"])


@query("Q16_queue_age", oracle("SELECT CASE WHEN age > 365 THEN 'dead' WHEN age > 90 THEN 'overdue' WHEN age > 30 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM (SELECT DATE '2001-06-01' - dt AS age FROM status_events) GROUP BY 1", "status_events"))
def q16(spark, sf):
    return audit.queue_age(status_events(spark, sf), F.lit("2001-06-01").cast("date"))


CHECKS = {
    "ohlc": RULES_SQL["OHLCLogic"], "positive": "coalesce(close <= 0, false)", "unit": RULES_SQL["UnitCheck"], "negative": "coalesce(least(open, high, low, close, volume, amount) < 0, false)",
    "duplicate": "same > 1", "pct": "coalesce(abs(pct) > 22, false)", "future": "dt > DATE '1998-06-01'", "st_null": "kind % 10 = 0", "code": "NOT regexp_matches(code, '^\\d{6}')",
}
CHECKED = f"""SELECT *, unnest(list_filter([{', '.join(f"CASE WHEN {e} THEN '{n}' END" for n, e in CHECKS.items())}], lambda x: x IS NOT NULL)) AS rule FROM (
    SELECT *, count(*) OVER (PARTITION BY code, dt) AS same, (close / lag(close) OVER (PARTITION BY code ORDER BY dt, copy) - 1) * 100 AS pct FROM dirty_bars)"""


@query("Q17_interactive", oracle("SELECT rule, code, dt::VARCHAR AS dt, copy, place, total, (SELECT count(*) FROM dirty_bars) AS rows FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY code, dt, copy) AS place, count(*) OVER (PARTITION BY rule) AS total FROM c) WHERE place <= 20", "dirty_bars", c=CHECKED))
def q17(spark, sf):
    w = Window.partitionBy("code").orderBy("dt", "copy")
    rows = dirty_bars(spark, sf).withColumns({"same": F.count("*").over(Window.partitionBy("code", "dt")), "pct": (F.try_divide("close", F.lag("close").over(w)) - 1) * 100, "st": F.when(C("kind") % 10 != 0, False)})
    rules = {
        "ohlc": v.bad_relation(), "positive": v.below("close", 0, True), "unit": v.bad_unit(), "negative": F.coalesce(F.least("open", "high", "low", "close", "volume", "amount") < 0, F.lit(False)),
        "duplicate": C("same") > 1, "pct": F.coalesce(F.abs("pct") > 22, F.lit(False)), "future": C("dt") > F.lit("1998-06-01").cast("date"), "st_null": C("st").isNull(), "code": v.bad_code(),
    }
    return audit.interactive(rows, rules, ["code", "dt", "copy"], 20).select("rule", "code", C("dt").cast("string").alias("dt"), "copy", "place", "total", "rows")


@query("Q18_snapshot_status", oracle("SELECT index_code, month::VARCHAR AS month, count(DISTINCT code) AS n, CASE WHEN index_code::INTEGER % 5 = 4 THEN 'unknown' WHEN index_code::INTEGER % 5 = 3 THEN 'complete' WHEN count(DISTINCT code) >= 4 THEN 'complete' ELSE 'partial' END AS status FROM index_members GROUP BY 1, index_members.month", "index_members"))
def q18(spark, sf):
    m = index_members(spark, sf)
    i = C("index_code").cast("int") % 5
    expected = m.select("index_code").distinct().where(i != 4).withColumn("expected", F.when(i != 3, 4))
    return shown(v.snapshot_status(m, expected), "n", "status", keys=("index_code", "month"))


@query("Q19_snapshot_quality", oracle(f"SELECT index_code, m.month::VARCHAR AS month, status, n_constituents, expected_count, coalesce(n, 0) AS n, {rsql('weight')} AS weight FROM index_meta m LEFT JOIN (SELECT index_code, month, count(*) AS n, sum(weight) AS weight FROM index_members WHERE code::INTEGER % 7 > 0 GROUP BY 1, 2) USING (index_code, month)", "index_meta", "index_members"))
def q19(spark, sf):
    got = audit.snapshot_quality(index_members(spark, sf).where(C("code").cast("int") % 7 > 0), index_meta(spark, sf))
    return got.select("index_code", C("month").cast("string").alias("month"), "status", "n_constituents", "expected_count", "n", rnd("weight").alias("weight"))


MEET = "SELECT CASE WHEN greatest(a.from_day, b.from_day) < least(coalesce(a.to_day, DATE '9999-12-31'), coalesce(b.to_day, DATE '9999-12-31')) THEN 'positive' ELSE 'touch' END AS kind FROM {0} a JOIN {0} b ON a.code = b.code AND a.row_id < b.row_id AND greatest(a.from_day, b.from_day) <= least(coalesce(a.to_day, DATE '9999-12-31'), coalesce(b.to_day, DATE '9999-12-31'))"
QUALITY = """SELECT count(*) AS rows, count(DISTINCT code) AS codes, count(*) FILTER (from_day > to_day) AS bad_ranges, (SELECT count(*) FROM p WHERE kind = 'positive') AS overlaps, (SELECT count(*) FROM p WHERE kind = 'touch') AS touches,
    (SELECT count(*) FROM (SELECT code FROM {0} WHERE to_day IS NULL GROUP BY 1 HAVING count(*) > 1)) AS multi_current, count(*) FILTER (industry = '5-LOW') AS orphans FROM {0}"""


def known(spark, sf, but: str = "5-LOW"):
    return membership(spark, sf).select("industry").distinct().where(C("industry") != but)


@query("Q20_interval_quality", oracle("SELECT *, true AS complete, rows > 0 AND multi_current = 0 AND orphans = 0 AND bad_ranges = 0 AS ok FROM q UNION ALL SELECT * REPLACE (NULL AS orphans), false, false FROM q", "membership", p=MEET.format("membership"), q=QUALITY.format("membership")))
def q20(spark, sf):
    m = membership(spark, sf)
    report = lambda k: audit.interval_quality(m, "code", "row_id", "industry", k)
    return report(known(spark, sf)).unionByName(report(None))


@query("Q21_interval_clean", oracle("SELECT count(*) AS raw, count(*) FILTER (to_day IS NULL OR from_day <= to_day) AS kept FROM membership", "membership"))
def q21(spark, sf):
    return audit.resolved_intervals(membership(spark, sf))[1]


THREE = {
    "a": "SELECT code, dt, close AS v FROM bars", "b": "SELECT code, dt, circ_mv / 1e6 AS v FROM valuation", "c": "SELECT code, dt, pe_ttm AS v FROM valuation",
    "d": "SELECT 'close-value' AS pair, a.v - b.v AS d FROM a JOIN b USING (code, dt) UNION ALL SELECT 'close-earnings', a.v - c.v FROM a JOIN c USING (code, dt) UNION ALL SELECT 'value-earnings', b.v - c.v FROM b JOIN c USING (code, dt)",
    "t": " UNION ALL ".join(f"(SELECT '{n}' AS source, code FROM {x} GROUP BY code ORDER BY max(v) DESC, code LIMIT 20)" for n, x in (("close", "a"), ("value", "b"), ("earnings", "c"))),
}


def three(spark, sf):
    val = valuation(spark, sf)
    return {"close": bars(spark, sf).select("code", "dt", C("close").alias("v")), "value": val.select("code", "dt", (C("circ_mv") / 1e6).alias("v")), "earnings": val.select("code", "dt", C("pe_ttm").alias("v"))}


@query("Q22_source_comparison", oracle(f"SELECT pair, count(d) AS n, {rsql('avg(d)', 4)} AS mean, {rsql('median(d)', 4)} AS med, {rsql('median(abs(d))', 4)} AS abs_med, {rsql('quantile_cont(abs(d), 0.95)', 4)} AS p95 FROM (SELECT unnest(['close-value', 'close-earnings', 'value-earnings']) AS pair) LEFT JOIN d USING (pair) GROUP BY pair", "bars", "valuation", **THREE))
def q22(spark, sf):
    got = audit.source_differences(three(spark, sf), ["code", "dt"], "v")
    return got.select("pair", "n", *[rnd(c, 4).alias(c) for c in ("mean", "med", "abs_med", "p95")])


@query("Q22_rank_overlap", oracle(f"SELECT source, count(*) FILTER (code::INTEGER % 2 = 0) AS common, {rsql('count(*) FILTER (code::INTEGER % 2 = 0) / count(*)')} AS share FROM t GROUP BY source", "bars", "valuation", **THREE))
def q22_rank(spark, sf):
    picked = bars(spark, sf).select("code").unionByName(valuation(spark, sf).select("code")).where(C("code").cast("int") % 2 == 0)
    return audit.rank_overlap(three(spark, sf), "code", "v", picked, 20).withColumn("share", rnd("share"))


@query("Q23_coverage", oracle("SELECT code, min(dt)::VARCHAR AS first_day, max(dt)::VARCHAR AS last_day, count(DISTINCT dt) AS days FROM dirty_bars GROUP BY code", "dirty_bars"))
def q23(spark, sf):
    return dirty_bars(spark, sf).groupBy("code").agg(F.min("dt").cast("string").alias("first_day"), F.max("dt").cast("string").alias("last_day"), F.count_distinct("dt").alias("days"))


@query("Q24_purge", oracle("""SELECT 'same' AS due, count(*) AS before, count(*) FILTER (data_source = 'alpha') AS authority_rows, 0 AS lacking, 0 AS extra, true AS done, count(*) FILTER (data_source = 'alpha') AS rows_after, count(DISTINCT data_source) FILTER (data_source = 'alpha') AS sources_after FROM dirty_bars UNION ALL
    SELECT 'fewer', count(*), count(*) FILTER (data_source = 'alpha'), 0, (SELECT count(*) FROM (SELECT DISTINCT code, dt FROM dirty_bars WHERE data_source = 'alpha' AND k % 2 = 1)), false, count(*), count(DISTINCT data_source) FROM dirty_bars""", "dirty_bars"))  # fmt: skip
def q24(spark, sf):
    d = dirty_bars(spark, sf)

    def tried(name: str, due):
        table, report = audit.purge(d, "data_source", "alpha", due, ["code", "dt"])
        after = table.agg(F.count("*").alias("rows_after"), F.count_distinct("data_source").alias("sources_after"))
        return report.crossJoin(F.broadcast(after)).withColumn("due", F.lit(name))

    return tried("same", d.where("data_source = 'alpha'")).unionByName(tried("fewer", d.where("data_source = 'alpha' AND k % 2 <> 1")))


@query("Q25_inventory", oracle("SELECT 'bars' AS name, count(*) AS n, min(dt)::VARCHAR AS first, max(dt)::VARCHAR AS last, (SELECT max(time) FROM bars) AS mark FROM bars UNION ALL SELECT 'valuation', count(*), min(dt)::VARCHAR, max(dt)::VARCHAR, (SELECT max(time) FROM valuation) FROM valuation UNION ALL SELECT 'factors', count(*), min(dt)::VARCHAR, max(dt)::VARCHAR, NULL FROM factors", "bars", "valuation", "factors"))
def q25(spark, sf):
    tables = {"bars": bars(spark, sf), "valuation": valuation(spark, sf), "factors": factors(spark, sf)}
    marks = tables["bars"].agg(F.lit("bars").alias("name"), F.max("time").alias("mark")).unionByName(tables["valuation"].agg(F.lit("valuation").alias("name"), F.max("time").alias("mark")))
    return v.profile(tables, dict.fromkeys(tables, "dt"), marks)


DEVIATION = "SELECT code, unnest([abs((open - open_front) - (close - close_front)), abs((high - high_front) - (close - close_front)), abs((low - low_front) - (close - close_front))]) AS d, abs(close - close_front) AS gap, high - low AS range FROM adj"


@query("Q26_additive_deviation", o(f"SELECT code, count(*) AS n, {rsql('avg((d > 0.01)::INTEGER)')} AS share, {rsql('quantile_cont(d, 0.99)', 4)} AS p99, {rsql('max(d)', 4)} AS most, {rsql('avg(CASE WHEN gap > 1e-9 THEN d / gap END)', 4)} AS to_gap, {rsql('corr(d, gap)', 4)} AS with_gap, {rsql('corr(d, range)', 4)} AS with_range FROM x WHERE d IS NOT NULL GROUP BY ROLLUP (code)", "adj", x=DEVIATION))
def q26(spark, sf):
    got = audit.additive_deviation(adj(spark, sf), ["open", "high", "low"])
    return got.select("code", "n", rnd("share").alias("share"), *[rnd(c, 4).alias(c) for c in ("p99", "most", "to_gap", "with_gap", "with_range")])


@query("Q27_tolerance", o(f"SELECT code, year, {rsql('most')} AS most, {rsql('off')} AS off, most <= 0.01 AND off <= 0.02 AS within FROM (SELECT f.code, year(f.dt) AS year, count(*) FILTER ((f.close_front IS NULL) <> (a.close_front IS NULL)) AS gone, max(abs(f.close_front - a.close_front)) AS most, avg(coalesce(abs(f.close_front - a.close_front) > 1e-6, false)::INTEGER) AS off FROM fresh f JOIN adj a ON a.code = f.code AND a.dt = f.dt GROUP BY 1, 2) WHERE gone = 0 AND most > 1e-6", "fresh"))
def q27(spark, sf):
    rows = fresh(spark, sf).join(adj(spark, sf).select("code", "dt", C("close_front").alias("due")), ["code", "dt"]).withColumn("year", F.year("dt"))
    got = audit.tolerance_review(rows, ["code", "year"], "due", "close_front", 0.01, 0.02)
    return got.select("code", "year", rnd("most").alias("most"), rnd("off").alias("off"), "within")


ORDER = ["download_failed", "price_mismatch", "missing_source_bars", "library_gap", "admissible"]


@query("Q28_worst_status", oracle("SELECT code, list_extract(['download_failed', 'price_mismatch', 'missing_source_bars', 'library_gap', 'admissible'], min(CASE WHEN kind = 5 THEN 1 WHEN kind = 1 THEN 2 WHEN kind = 3 THEN 3 WHEN kind = 6 THEN 4 ELSE 5 END)) AS status FROM dirty_bars GROUP BY code", "dirty_bars"))
def q28(spark, sf):
    status = F.when(C("kind") == 5, ORDER[0]).when(C("kind") == 1, ORDER[1]).when(C("kind") == 3, ORDER[2]).when(C("kind") == 6, ORDER[3]).otherwise(ORDER[4])
    return v.worst(dirty_bars(spark, sf).withColumn("s", status), "code", "s", ORDER, "status")


@query("Q28_no_data", oracle("SELECT code, coalesce(status, 'no_data') AS status FROM (SELECT DISTINCT code FROM bars) LEFT JOIN (SELECT code, CASE WHEN bool_or(kind = 5) THEN 'download_failed' WHEN bool_or(kind = 1) THEN 'price_mismatch' ELSE 'admissible' END AS status FROM dirty_bars WHERE code < '000050' GROUP BY code) USING (code)", "bars", "dirty_bars"))
def q28_none(spark, sf):
    status = F.when(C("kind") == 5, ORDER[0]).when(C("kind") == 1, ORDER[1]).otherwise(ORDER[4])
    return v.worst(dirty_bars(spark, sf).where("code < '000050'").withColumn("s", status), "code", "s", ORDER, "status", bars(spark, sf))


CLEAN = "SELECT code, industry, from_day, to_day - 2 AS to_day, row_id FROM membership WHERE to_day - 2 >= from_day"


@query("Q29_staged_gate", oracle("SELECT 'staged' AS name, *, (SELECT count(*) FROM membership) AS rows_after FROM r UNION ALL SELECT 'clean', *, (SELECT count(*) FROM c) FROM k", "membership", c=CLEAN,
    p=MEET.format("membership"), q=QUALITY.format("membership"), r="SELECT *, true AS complete, rows > 0 AND multi_current = 0 AND orphans = 0 AND bad_ranges = 0 AS ok, (SELECT count(DISTINCT industry) FROM membership) AS labels, false AS pass FROM q",
    k="SELECT count(*) AS rows, count(DISTINCT code) AS codes, 0 AS bad_ranges, 0 AS overlaps, 0 AS touches, 0 AS multi_current, 0 AS orphans, true AS complete, true AS ok, count(DISTINCT industry) AS labels, true AS pass FROM c"))
def q29(spark, sf):
    m = membership(spark, sf)
    clean = m.withColumn("to_day", F.date_sub("to_day", 2)).where("to_day >= from_day")

    def tried(name: str, staged, labels):
        n, kinds = staged.agg(F.count("*"), F.count_distinct("industry")).first()
        report, table = audit.staged_gate(staged, m, labels, "code", "row_id", "industry", n, kinds)
        return report.crossJoin(F.broadcast(table.agg(F.count("*").alias("rows_after")))).withColumn("name", F.lit(name))

    return tried("staged", m, known(spark, sf)).unionByName(tried("clean", clean, known(spark, sf, "")))


Q30_DAYS = ("1995-06-15", "1996-12-31", "1998-02-01")


@query("Q30_backfill_audit", oracle(f"""SELECT index_code, d.day::VARCHAR AS day, as_of::VARCHAR AS as_of, members, sources, complete, partial, 0 AS invalid, 0 AS unknown FROM (SELECT index_code, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM x GROUP BY 1) JOIN s USING (index_code),
    (SELECT unnest({list(Q30_DAYS)!r})::DATE AS day) d LEFT JOIN LATERAL (SELECT month AS as_of, count(DISTINCT code) AS members FROM x WHERE x.index_code = s.index_code AND x.month <= d.day GROUP BY month ORDER BY month DESC LIMIT 1) ON true""", "index_members",
    x="SELECT *, CASE WHEN code::INTEGER % 3 = 0 THEN 'api' ELSE 'file' END AS s FROM index_members", s="SELECT index_code, count(*) FILTER (n >= 4) AS complete, count(*) FILTER (n < 4) AS partial FROM (SELECT index_code, month, count(DISTINCT code) AS n FROM index_members GROUP BY 1, 2) GROUP BY 1"))
def q30(spark, sf):
    members = index_members(spark, sf).withColumn("source", F.when(C("code").cast("int") % 3 == 0, "api").otherwise("file"))
    status = v.snapshot_status(members, members.select("index_code").distinct().withColumn("expected", F.lit(4)))
    got = audit.backfill_audit(members, status, "source", Q30_DAYS)
    return got.select("index_code", C("day").cast("string").alias("day"), C("as_of").cast("string").alias("as_of"), "members", "sources", "complete", "partial", "invalid", "unknown")


@query("Q31_pending_slots", oracle("""SELECT count(*) AS pending, count(*) FILTER (t = 0) AS without_trigger, count(*) FILTER (t <> 0 AND h % 7 = 0) AS other_origin, count(*) FILTER (t <> 0 AND h % 5 = 0) AS other_payload,
    count(*) FILTER (t = 0 OR h % 7 = 0 OR h % 5 = 0) = 0 AS ok FROM (SELECT *, h % 11 AS t FROM (SELECT (code::INTEGER + day(dt)) AS h FROM status_events))""", "status_events"))  # fmt: skip
def q31(spark, sf):
    e = status_events(spark, sf).select(F.concat_ws("|", "code", "dt").alias("slot"), (C("code").cast("int") + F.day("dt")).alias("h"))
    pending = e.select("slot", F.lit("alpha").alias("price_source"), F.lit(3).alias("generation"), F.lit("c1").alias("cutover"), F.sha2("slot", 256).alias("payload_hash"), "h")
    other = F.when(C("h") % 7 == 0, 4).otherwise(C("generation"))
    triggers = pending.where("h % 11 <> 0").withColumns({"generation": other, "payload_hash": F.when(C("h") % 5 == 0, F.sha2("payload_hash", 256)).otherwise(C("payload_hash"))})
    return audit.pending_audit(pending, triggers, "slot", ["price_source", "generation", "cutover"], "payload_hash")


MONITOR = """SELECT *, (coalesce(n > most, false) OR overdue > 0) AS alarm FROM (SELECT 'trades' AS name, action AS status, count(*) AS n, count(*) FILTER (action = 'sell' AND DATE '1995-07-01' - dt > 90) AS overdue, CASE WHEN action = 'buy' THEN 10 END AS most FROM trades GROUP BY 2
    UNION ALL SELECT 'events', status, count(*), count(*) FILTER (status = 'sell' AND DATE '1995-07-01' - dt > 90), CASE WHEN status = 'normal' THEN 1000000 END FROM status_events GROUP BY 2)"""


@query("Q32_monitor", oracle("SELECT name, status, n, overdue, alarm FROM m", "trades", "status_events", m=MONITOR))
def q32(spark, sf):
    tables = {"trades": trades(spark, sf).select(C("action").alias("status"), C("dt").alias("day")), "events": status_events(spark, sf).select("status", C("dt").alias("day"))}
    return audit.workflow_monitor(tables, F.lit("1995-07-01").cast("date"), 90, ["sell"], {("trades", "buy"): 10, ("events", "normal"): 1_000_000})
