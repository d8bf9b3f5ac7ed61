"""Queries of sources and sinks (S) and of incremental ingest (T)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import results
from ..operators import validate as v
from ..operators.indicators import S
from ..operators.joins import next_in_calendar
from ..plans.views import bars, dirty_bars, factors, nav, oracle, status_events, trades, valuation
from ..sources import manifest as m
from ..sources import quarantine
from ..sources import storage as s
from ..streaming import ingest as t
from ..streaming import revisions as r
from ..streaming import runs
from .registry import W, lag, query, rnd, rsql, shown, shown_sql
from .validate import JUDGED, LEDGER, ledger

C = F.col


def shards(spark, sf, frame=bars, name="shards"):
    """The table written as parquet files to shared storage."""
    path = s.shared_path(spark, name)
    frame(spark, sf).write.parquet(path)
    return path


@query("S1_read_shards", oracle(shown_sql("bars WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND code IN ('000001', '000002', '000003')", "close"), "bars"))
def s1(spark, sf):
    return shown(s.read_shards(spark, shards(spark, sf), "1996-01-01", "1996-12-31", ["000001", "000002", "000003"]), "close")


@query("S2_pruned_scan", oracle(f"SELECT code, count(*) AS n, {rsql('max(adj_factor)')} AS most FROM factors GROUP BY code", "factors"))
def s2(spark, sf):
    return s.read_shards(spark, shards(spark, sf, factors), columns=["code", "adj_factor"]).groupBy("code").agg(F.count("*").alias("n"), rnd(F.max("adj_factor")).alias("most"))


@query("S3_export_reader", oracle("SELECT dt::VARCHAR AS dt, code, action, volume, count(*) AS n FROM trades GROUP BY 1, 2, 3, 4", "trades"))
def s3(spark, sf):
    path = s.shared_path(spark, "export")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    word = F.when(C("action") == "buy", "买入").otherwise("卖出")
    rows = trades(spark, sf).select(C("dt").cast("string").alias("日期"), C("code").alias("代码"), word.alias("方向"), C("volume").alias("数量"))
    rows.write.option("header", "true").option("encoding", "GBK").csv(path)
    got = s.read_export(spark, path, ["日期", "代码", "方向", "数量"], "dt string, code string, word string, volume long")
    return got.groupBy("dt", "code", s.direction(C("word")).alias("action"), "volume").agg(F.count("*").alias("n"))


@query("S4_event_import", oracle("SELECT s.code, s.dt::VARCHAR AS event_date, s.status, min(c.dt)::VARCHAR AS effective FROM status_events s JOIN (SELECT DISTINCT dt FROM bars WHERE k % 5 < 3) c ON c.dt > s.dt AND c.dt <= s.dt + 14 WHERE s.status = 'ST' AND day(s.dt) <> 13 GROUP BY s.code, s.dt, s.status", "bars", "status_events"))
def s4(spark, sf):
    path = s.shared_path(spark, "events")
    raw = status_events(spark, sf).where("status = 'ST'").select(F.when(F.day("dt") == 13, "soon").otherwise(C("dt").cast("string")).alias("Date"), C("code").alias("Security"), C("status").alias("Signal"))
    raw.write.option("header", "true").csv(path)
    got = s.import_events(spark, path, {"event_date": "Date", "code": "Security", "status": "Signal"}, "st")
    days = bars(spark, sf).where("k % 5 < 3").select(C("dt").alias("day")).distinct()
    out = next_in_calendar(got.select("code", "event_date", "status"), "event_date", days, 14, "effective")
    return out.select("code", C("event_date").cast("string").alias("event_date"), "status", C("effective").cast("string").alias("effective"))


@query("S4_replaced_events", oracle("SELECT 'kept' AS event_type, code, dt::VARCHAR AS event_date, rank() OVER (ORDER BY code, dt, status, event_id) - 1 AS source_row_id, status AS signal FROM (SELECT *, 0 AS event_id FROM status_events WHERE status = 'ST')"
    " UNION ALL SELECT 'renewed', code, dt::VARCHAR, n, status FROM (SELECT *, row_number() OVER (ORDER BY code, dt, status) - 1 AS n FROM status_events WHERE status <> 'ST') WHERE day(dt) <> 13", "status_events"))  # fmt: skip
def s4_replaced(spark, sf):
    """Two types are imported; one of them is then imported again from another file, in whose order its rows are numbered."""
    target = s.shared_path(spark, "event-table")
    ev = status_events(spark, sf).select("code", "dt", "status")

    def put(rows, kind):
        path = s.shared_path(spark, "event-files")
        day = F.when(F.day("dt") == 13, "soon").otherwise(C("dt").cast("string")) if kind == "renewed" else C("dt").cast("string")
        rows.coalesce(1).sortWithinPartitions("code", "dt", "status").select(day.alias("Date"), C("code").alias("Security"), C("status").alias("Signal")).write.option("header", "true").csv(path)
        s.replace_events(spark, path, {"event_date": "Date", "code": "Security", "signal": "Signal"}, kind, target)

    put(ev.where("status = 'ST'"), "kept")
    put(ev.where("status = 'ST'"), "renewed")
    put(ev.where("status <> 'ST'"), "renewed")
    return spark.read.parquet(target).select("event_type", "code", C("event_date").cast("string").alias("event_date"), "source_row_id", "signal")


@query("S5_log_lines", oracle("SELECT dt::VARCHAR AS day, code FROM bars", "bars"))
def s5(spark, sf):
    path = s.shared_path(spark, "log")
    per_day = bars(spark, sf).groupBy("dt").agg(F.array_join(F.transform(F.collect_list("code"), lambda c: F.concat(F.lit("'"), c, F.lit(".XSHG'"))), ", ").alias("l"))
    per_day.select(F.concat(C("dt").cast("string"), F.lit(" 09:31 INFO buy_stocks:["), "l", F.lit("]")).alias("value")).write.text(path)
    return s.extract_log(spark.read.text(path))


def halves(spark, sf):
    b = bars(spark, sf).select("code", "dt", "k", "close")
    return b.where("k % 3 < 2"), b.where("k % 3 > 0").withColumn("close", C("close") + 1)


NEW = "CASE WHEN k % 3 > 0 THEN close + 1 ELSE close END"


@query("S6_upsert", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('CASE WHEN k % 3 > 0 AND year(dt) > 1995 THEN close + 1 ELSE close END')} AS close FROM bars WHERE k % 3 < 2 OR year(dt) > 1995", "bars"))
def s6(spark, sf):
    path = s.shared_path(spark, "by-year")
    existing, incoming = (x.withColumn("year", F.year("dt")) for x in halves(spark, sf))
    existing.write.partitionBy("year").parquet(path)
    s.upsert_partitions(spark, path, incoming.where("year > 1995"), ["code", "dt"], "k", "year")
    return shown(spark.read.parquet(path), "close")


@query("S6_upsert_counts", oracle("SELECT count(*) FILTER (k % 3 = 2) AS new, count(*) FILTER (k % 3 = 1) AS updated FROM bars", "bars"))
def s6c(spark, sf):
    return s.upsert_counts(*halves(spark, sf), ["code", "dt"])


@query("S6_tables_together", oracle(f"SELECT 0 AS version, 'bars' AS name, count(*) AS n, {rsql('sum(close)', 2)} AS total FROM bars WHERE k % 3 < 2 UNION ALL SELECT 0, 'caps', count(*), {rsql('sum(circ_mv) / 1e6', 2)} FROM valuation WHERE day(dt) < 15"
    f" UNION ALL SELECT 1, 'bars', count(*), {rsql(f'sum({NEW})', 2)} FROM bars UNION ALL SELECT 1, 'caps', count(*), {rsql('sum(circ_mv) / 1e6', 2)} FROM valuation", "bars", "valuation"))  # fmt: skip
def s6_together(spark, sf):
    """Two tables changed by one commit, read at the version before and after it."""
    root = s.shared_path(spark, "tables")
    existing, incoming = (x.select("code", "dt", "k", "close") for x in halves(spark, sf))
    caps = valuation(spark, sf).select("code", "dt", C("circ_mv").alias("cap")).withColumn("k", F.lit(0))
    change = lambda rows: m.Change(rows, ["code", "dt"], "k", "dt")
    m.upsert(spark, root, {"bars": change(existing), "caps": change(caps.where(F.day("dt") < 15))})
    m.upsert(spark, root, {"bars": change(incoming), "caps": change(caps.where(F.day("dt") >= 15))})
    parts = []
    for version in (0, 1):
        for name, rows, x in (("bars", existing, C("close")), ("caps", caps, C("cap") / 1e6)):
            got = m.read(spark, root, name, rows.schema, version=version)
            parts.append(got.agg(F.lit(version).alias("version"), F.lit(name).alias("name"), F.count("*").alias("n"), rnd(F.sum(x), 2).alias("total")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("S7_replace", oracle("SELECT code, count(*) AS n FROM bars WHERE k % 2 = 0 GROUP BY code", "bars"))
def s7(spark, sf):
    path = shards(spark, sf)
    bars(spark, sf).where("k % 2 = 0").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("code").agg(F.count("*").alias("n"))


@query("S8_changed_rows", oracle(shown_sql("(SELECT code, dt, CASE WHEN k % 7 = 0 THEN close + 1 ELSE close END AS close FROM bars WHERE k % 7 = 0 OR k % 11 = 0)", "close"), "bars"))
def s8(spark, sf):
    b = bars(spark, sf).select("code", "dt", "k", "close")
    incoming = b.withColumn("close", F.when(C("k") % 7 == 0, C("close") + 1).otherwise(C("close")))
    return shown(s.changed_rows(b.where("k % 11 <> 0"), incoming, ["code", "dt"], ["k"]), "close")


@query("S9_provenance", oracle("SELECT code, 'desk' AS data_source, count(*) AS n FROM bars GROUP BY code", "bars"))
def s9(spark, sf):
    return s.stamped(bars(spark, sf), "alpha", "desk").groupBy("code", "data_source").agg(F.count("*").alias("n"))


@query("S10_export_by_code", oracle("SELECT 'SZ' AS market, code::INTEGER AS code, count(*) AS n FROM bars GROUP BY 2", "bars"))
def s10(spark, sf):
    path = s.shared_path(spark, "by-code")
    s.export_by_code(bars(spark, sf), path)
    return spark.read.parquet(path).groupBy("market", C("code").cast("int").alias("code")).agg(F.count("*").alias("n"))


@query("S11_result_tables", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql(f'coalesce(close / {lag(chr(99) + chr(108) + chr(111) + chr(115) + chr(101))} - 1, 0)')} AS daily_return FROM bars", "bars"))
def s11(spark, sf):
    path = s.shared_path(spark, "results")
    made = bars(spark, sf).select("code", "dt", F.coalesce(C("close") / S.ref("close") - 1, F.lit(0.0)).alias("daily_return"))
    made.write.option("header", "true").csv(path)
    return shown(spark.read.schema("code string, dt date, daily_return double").option("header", "true").csv(path), "daily_return")


@query("S11_trades_out", oracle(f"SELECT code, dt::VARCHAR AS dt, action, count(*) AS n, {rsql('sum(price * volume)', 2)} AS amount FROM trades GROUP BY 1, 2, 3", "trades"))
def s11_trades(spark, sf):
    path = s.shared_path(spark, "results")
    made = results.trade_table(trades(spark, sf).select("code", "dt", "action", "price", "volume"))
    made.write.option("header", "true").csv(path)
    got = spark.read.schema("code string, dt string, action string, price double, volume double, amount double").option("header", "true").csv(path)
    return got.groupBy("code", "dt", "action").agg(F.count("*").alias("n"), rnd(F.sum("amount"), 2).alias("amount"))


@query("S11_benchmark_out", oracle(f"SELECT dt::VARCHAR AS dt, {rsql('bench')} AS bench, {rsql('coalesce(bench / lag(bench) OVER (ORDER BY dt) - 1, 0)')} AS daily_return FROM nav", "nav"))
def s11_benchmark(spark, sf):
    path = s.shared_path(spark, "results")
    results.daily_table(nav(spark, sf), "bench").write.option("header", "true").csv(path)
    got = spark.read.schema("dt string, bench double, daily_return double").option("header", "true").csv(path)
    return got.select("dt", rnd("bench").alias("bench"), rnd("daily_return").alias("daily_return"))


def rejected(spark, sf):
    return v.split(v.judge(dirty_bars(spark, sf), v.bar_rules()))[1]


@query("S12_quarantine", oracle("SELECT array_to_string(failed, ',') AS failed_rules, 'pending_repair' AS status, count(*) AS n FROM j WHERE len(failed) > 0 GROUP BY 1", "dirty_bars", j=JUDGED))
def s12(spark, sf):
    path = s.shared_path(spark, "quarantine")
    s.quarantine(rejected(spark, sf), "bars", "b1").write.parquet(path)
    return spark.read.parquet(path).groupBy("failed_rules", "status").agg(F.count("*").alias("n"))


SINKS = "SELECT 'b{0}' AS batch_id, count(*) AS offered, CASE WHEN {1} THEN count(*) ELSE 0 END AS written, (SELECT coalesce(sum(1), 0) FROM j WHERE len(failed) > 0 AND kind % 3 IN ({2})) AS archived, (SELECT count(*) FROM j WHERE len(failed) > 0 AND kind % 3 IN ({3})) AS pending FROM j WHERE len(failed) > 0 AND kind % 3 = {0}"


@query("S12_capacity", oracle(" UNION ALL ".join([SINKS.format(0, "true", "-1", "0"), SINKS.format(1, "false", "-1", "0"), SINKS.format(2, "true", "0", "2")]), "dirty_bars", j=JUDGED))
def s12_capacity(spark, sf):
    """The second batch of a day finds the sink full; nine days later the first one is archived, and the third batch is taken."""
    root, out = s.shared_path(spark, "sink"), []
    bad = rejected(spark, sf)
    for k, day in ((0, "2020-01-01"), (1, "2020-01-01"), (2, "2020-01-10")):
        rows = quarantine.sink_rows(bad.where(C("kind") % 3 == k), f"b{k}", "bars", "alpha", day)
        out.append(quarantine.admit(spark, root, rows, f"b{k}", day, capacity=1))
    return spark.createDataFrame([tuple(r.values()) for r in out], "batch_id string, offered long, written long, archived long, pending long")


@query("S12_alerts", oracle("SELECT '2020-01-01' AS day, array_to_string(list_sort(failed), ',') AS failed_rules, count(*) AS n FROM j WHERE len(failed) > 0 GROUP BY 2 HAVING count(*) >= 60", "dirty_bars", j=JUDGED))
def s12_alerts(spark, sf):
    root = s.shared_path(spark, "sink")
    quarantine.admit(spark, root, quarantine.sink_rows(rejected(spark, sf), "b0", "bars", "alpha", "2020-01-01"), "b0", "2020-01-01")
    return quarantine.alerts(quarantine.waiting(spark, root), 60)


@query("S13_quarantine_lifecycle", oracle("SELECT CASE WHEN list_contains(failed, 'UnitCheck') THEN 'fixed' ELSE 'pending_repair' END AS status, count(*) AS n FROM j WHERE len(failed) > 0 GROUP BY 1", "dirty_bars", j=JUDGED))
def s13(spark, sf):
    path = s.shared_path(spark, "quarantine")
    s.quarantine(rejected(spark, sf), "bars", "b1").write.parquet(path)  # computed once: sums of doubles in a payload depend on the order of the rows
    sink = spark.read.parquet(path)
    fixed = sink.where(C("failed_rules").contains("UnitCheck"))
    return s.marked(sink, fixed, ["payload", "failed_rules"], "fixed").groupBy("status").agg(F.count("*").alias("n"))


@query("S14_ledger_recent", oracle("SELECT batch_id, aligned, passed, rejected FROM l ORDER BY batch_id DESC LIMIT 5", "bars", l=LEDGER))
def s14(spark, sf):
    return ledger(spark, sf).orderBy(F.desc("batch_id")).limit(5).select("batch_id", "aligned", "passed", "rejected")


@query("S15_browser", oracle("SELECT code, count(*) AS n, min(time) AS first, max(time) AS last, 10 AS columns FROM bars GROUP BY code", "bars"))
def s15(spark, sf):
    return s.browse(bars(spark, sf), "code", "time")


@query("S15_preview", oracle("SELECT code, dt::VARCHAR AS dt, volume FROM bars ORDER BY dt, code LIMIT 20", "bars"))
def s15_preview(spark, sf):
    return shown(s.preview(bars(spark, sf), ["dt", "code"], 20), "volume")


@query("S16_windows", oracle("SELECT w.first::VARCHAR AS first, w.last::VARCHAR AS last, count(b.code) AS n FROM (SELECT greatest(g, DATE '1995-01-10') AS first, least((g + INTERVAL 29 DAY)::DATE, DATE '1996-03-05') AS last FROM (SELECT unnest(range(DATE '1970-01-01' + (9140 // 30 * 30), DATE '1996-03-06', INTERVAL 30 DAY))::DATE AS g)) w LEFT JOIN bars b ON b.dt BETWEEN w.first AND w.last GROUP BY 1, 2", "bars"))
def s16(spark, sf):
    w = s.windows("1995-01-10", "1996-03-05", 30, spark, grid=True)
    days = bars(spark, sf).groupBy("dt").agg(F.count("*").alias("n"))
    # one row per window; the days of a window join by equality
    spread = w.withColumn("dt", F.explode(F.sequence("first", "last")))
    got = spread.join(days, "dt", "left").groupBy("first", "last").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return got.select(C("first").cast("string").alias("first"), C("last").cast("string").alias("last"), "n")


@query("S17_fresh_frame", oracle(f"SELECT b.code, b.dt::VARCHAR AS dt, {rsql('f.adj_factor')} AS adj_factor FROM bars b LEFT JOIN factors f ON f.code = b.code AND f.dt = b.dt WHERE b.k % 10 > 0", "bars", "factors"))
def s17(spark, sf):
    b = bars(spark, sf).withColumn("close", F.when(C("k") % 10 > 0, C("close")).when(C("k") % 10 < 0, None))
    got = b.join(factors(spark, sf).select("code", "dt", "adj_factor"), ["code", "dt"], "left").dropna(subset=["open", "high", "low", "close"])
    return shown(got.orderBy("code", "dt"), "adj_factor")


@query("S18_research_signals", oracle("SELECT lpad(code::INTEGER::VARCHAR, 6, '0') AS code, dt::VARCHAR AS day, CASE WHEN k % 4 = 0 THEN 'buy' ELSE 'add' END AS rating FROM bars WHERE k % 4 IN (0, 1)", "bars"))
def s18(spark, sf):
    path = s.shared_path(spark, "signals")
    rating = F.when(C("k") % 4 == 0, "buy").when(C("k") % 4 == 1, "add").otherwise("hold")
    bars(spark, sf).select(C("code").cast("int").alias("code"), F.concat(C("dt").cast("string"), F.lit(" 08:00:00")).alias("time"), rating.alias("rating")).write.option("header", "true").csv(path)
    got = spark.read.option("header", "true").csv(path).where(C("rating").isin("buy", "add"))
    return got.select(F.lpad("code", 6, "0").alias("code"), F.split("time", " ")[0].alias("day"), "rating")


@query("S19_positions", oracle("SELECT code, volume::BIGINT AS amount, coalesce(CASE WHEN k % 2 = 0 THEN 1 END, volume::BIGINT) AS enable FROM bars WHERE dt = DATE '1996-06-28'", "bars"))
def s19(spark, sf):
    path = s.shared_path(spark, "positions")
    bars(spark, sf).where("dt = '1996-06-28'").select("code", C("volume").cast("long").alias("amount"), F.when(C("k") % 2 == 0, 1).alias("enable")).write.option("header", "true").csv(path)
    got = spark.read.schema("code string, amount long, enable long").option("header", "true").csv(path)
    return got.select("code", "amount", F.coalesce("enable", "amount").alias("enable"))


SCHEMA = "code string, dt date, k int, time long, open double, high double, low double, close double, volume double, amount double, data_source string, kind int, copy int"


def streamed(spark, sf, runs=1):
    """The dirty bars as files, streamed into a table."""
    path, target = shards(spark, sf, lambda sp, d: dirty_bars(sp, d).selectExpr(*[f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in SCHEMA.split(", ")]).repartition(6, "code"), "stream-in"), s.shared_path(spark, "stream-table")
    for _ in range(runs):
        t.ingest(spark, path, SCHEMA, target, s.shared_path(spark, "stream-state"), v.bar_rules)
    return target


PASSED = f"SELECT code, dt::VARCHAR AS dt, {rsql('close')} AS close FROM j WHERE len(failed) = 0 QUALIFY row_number() OVER (PARTITION BY code, j.dt ORDER BY copy DESC) = 1"


@query("T1_stream_ingest", oracle(PASSED, "dirty_bars", j=JUDGED))
def t1(spark, sf):
    return shown(t.read_table(spark, streamed(spark, sf), ["code", "dt"], "copy"), "close")


RUN = "SELECT {0} AS limit, count(*) AS raw, count(*) FILTER (len(failed) > 0) AS rejected, CASE WHEN {1} THEN count(*) FILTER (len(failed) = 0) ELSE 0 END AS written, '{2}' AS status, CASE WHEN {1} THEN count(DISTINCT code) FILTER (len(failed) = 0) ELSE 0 END AS marks, CASE WHEN {1} THEN (SELECT count(*) FROM (SELECT DISTINCT code, dt FROM j WHERE len(failed) = 0)) ELSE 0 END AS shown FROM j"


@query("T1_run_gate", oracle(" UNION ALL ".join([RUN.format("'strict'", "false", "failed"), RUN.format("'loose'", "true", "success"), RUN.format("'released'", "true", "failed").replace("THEN count(*) FILTER (len(failed) = 0) ELSE 0 END AS written", "THEN 0 END AS written")]), "dirty_bars", j=JUDGED))
def t1_gate(spark, sf):
    """A run beyond its limit shows no row and moves no mark until it is released; a run within it shows all at once."""
    path = shards(spark, sf, lambda sp, d: dirty_bars(sp, d).selectExpr(*[f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in SCHEMA.split(", ")]), "run-in")

    def told(root, limit, row):
        shown_rows = runs.rows(spark, root, "bars", SCHEMA, ["code", "dt"], "copy", "dt").count()
        marked = runs.marks(spark, root, "bars", "code string, mark date").count()
        return (limit, row.raw, row.rejected, row.written, row.status, marked, shown_rows)

    out = []
    for limit, most in (("strict", 0.0001), ("loose", 1.0)):
        root = s.shared_path(spark, "run-tables")
        row = runs.run(spark, path, SCHEMA, root, "bars", s.shared_path(spark, "run-state"), v.bar_rules, ["code", "dt"], "copy", "dt", ["code"], most_rejected=most).first()
        out.append(told(root, limit, row))
        if limit == "strict":
            runs.release(spark, root, "bars", ["code"], "dt")
            out.append(told(root, "released", row))
    return spark.createDataFrame(out, "limit string, raw long, rejected long, written long, status string, marks long, shown long")


@query("T1_run_rows", oracle(PASSED, "dirty_bars", j=JUDGED))
def t1_rows(spark, sf):
    path, root, state = shards(spark, sf, lambda sp, d: dirty_bars(sp, d).selectExpr(*[f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in SCHEMA.split(", ")]), "run-in"), s.shared_path(spark, "run-tables"), s.shared_path(spark, "run-state")
    runs.run(spark, path, SCHEMA, root, "bars", state, v.bar_rules, ["code", "dt"], "copy", "dt", ["code"], most_rejected=1.0)
    return shown(runs.rows(spark, root, "bars", SCHEMA, ["code", "dt"], "copy", "dt"), "close")


@query("T2_two_pass", oracle(f"SELECT b.code, b.dt::VARCHAR AS dt, {rsql('b.close * a.f')} AS close FROM bars b JOIN (SELECT code, arg_max(adj_factor, dt) AS f FROM factors GROUP BY 1) a USING (code)", "bars", "factors"))
def t2(spark, sf):
    out = s.shared_path(spark, "adjusted")
    t.two_pass(spark, shards(spark, sf, factors), shards(spark, sf), out, s.shared_path(spark, "adjusted-state"))
    return shown(spark.read.parquet(f"{out}/rows"), "close")


MARKS = "SELECT code, max(time) AS real, max(time) + (code::INTEGER % 3 - 1) * 86400000 AS mark FROM bars GROUP BY code"


def marks(spark, sf):
    real = bars(spark, sf).groupBy("code").agg(F.max("time").alias("real"))
    return real.select("code", (C("real") + (C("code").cast("int") % 3 - 1) * 86400000).alias("mark")), real


@query("T3_guarded_mark", oracle("SELECT code, least(mark, real) AS mark FROM m", "bars", m=MARKS))
def t3(spark, sf):
    return t.guarded_mark(*marks(spark, sf), ["code"])


@query("T4_advance_mark", oracle("SELECT code, max(time) AS mark FROM bars GROUP BY code", "bars"))
def t4(spark, sf):
    stored, real = marks(spark, sf)
    return s.upsert(stored, real.select("code", C("real").alias("mark")), ["code"], "mark").select("code", "mark")


@query("T5_deferred_mark", oracle("SELECT code, CASE WHEN code::INTEGER % 4 IN (0, 1) THEN real ELSE mark END AS mark FROM m", "bars", m=MARKS))
def t5(spark, sf):
    stored, real = marks(spark, sf)
    group = C("code").cast("int") % 4
    candidates = real.select("code", C("real").alias("candidate"), group.alias("grp"))
    gates = real.select(group.alias("grp"), (group < 2).alias("ok"))
    marks_path, next_path = s.shared_path(spark, "marks"), s.shared_path(spark, "marks")
    stored.write.parquet(marks_path)
    t.commit(spark, marks_path, next_path, candidates, gates, ["code"])
    return spark.read.parquet(next_path)


@query("T6_start", oracle("SELECT code, (max(dt) + 1)::VARCHAR AS start FROM bars GROUP BY code", "bars"))
def t6(spark, sf):
    return bars(spark, sf).groupBy("code").agg(F.date_add(F.max("dt"), 1).cast("string").alias("start"))


@query("T7_late_data", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('CASE WHEN dt IN (SELECT dt FROM valuation WHERE dt >= DATE {0}) THEN close + 1 ELSE close END'.format(chr(39) + '1998-01-01' + chr(39)))} AS close FROM bars", "bars", "valuation"))
def t7(spark, sf):
    b = bars(spark, sf).select("code", "dt", "k", "close")
    days = t.late_days(valuation(spark, sf).select("dt", C("dt").alias("updated")), F.lit("1997-12-31").cast("date"))
    again = b.join(days, "dt", "left_semi").withColumn("close", C("close") + 1).select("code", "dt", "k", "close")
    return shown(s.upsert(b, again, ["code", "dt"], "k"), "close")


@query("T8_replay", oracle(PASSED, "dirty_bars", j=JUDGED))
def t8(spark, sf):
    return shown(t.read_table(spark, streamed(spark, sf, runs=2), ["code", "dt"], "copy"), "close")


@query("T9_revisions", oracle(f"SELECT code, dt::VARCHAR AS dt, {rsql('v')} AS value, n AS revision_no FROM (SELECT code, dt, adj_factor + CASE WHEN day(dt) % 3 = 0 THEN 0.01 ELSE 0 END AS v, (day(dt) % 3 = 0)::INTEGER AS n FROM factors)", "factors"))
def t9(spark, sf):
    f = factors(spark, sf).select("code", C("dt").cast("string").alias("dt"), F.lit(1).cast("long").alias("batch"), C("adj_factor").alias("value"))
    later = f.withColumns({"value": C("value") + F.when(F.day(C("dt").cast("date")) % 3 == 0, 0.01).otherwise(0.0), "batch": F.lit(2).cast("long")})
    path, out = s.shared_path(spark, "revisions-in"), s.shared_path(spark, "revisions-out")
    f.unionByName(later).write.parquet(path)
    r.use_keyed_state(spark)
    # both batches of a code come in one micro-batch, whatever files they lie in
    stream = spark.readStream.schema("code string, dt string, batch long, value double").parquet(path)
    r.track_revisions(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", s.shared_path(spark, "revisions-state")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(r.EVENT).parquet(out).groupBy("code", "dt").agg(F.max_by(F.struct("value", "revision_no"), "batch").alias("x"))
    return last.select("code", "dt", rnd("x.value").alias("value"), (C("x.revision_no") - 1).alias("revision_no"))


@query("T10_block", oracle(f"SELECT code, dt::VARCHAR AS dt, bad_run, (bad_run >= 3 OR coalesce(max(CASE WHEN severe THEN i END) OVER ({W}), 0) > coalesce(max(CASE WHEN NOT bad THEN i END) OVER ({W}), 0)) AS blocked FROM (SELECT *, i - coalesce(max(CASE WHEN NOT bad THEN i END) OVER ({W}), 0) AS bad_run FROM (SELECT code, dt, volume % 4 > 0 AS bad, (volume % 4) / 100 > 0.02 AS severe, row_number() OVER ({W}) AS i FROM bars))", "bars"))
def t10(spark, sf):
    batches = bars(spark, sf).select("code", "dt", (C("volume") % 4).alias("rejected"), F.lit(100.0).alias("raw"))
    return shown(t.blocked_batches(batches, "code", "dt", 0.02), "bad_run", "blocked")
