"""Point-in-time queries: what was known at a time, without looking ahead."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import latest

#: Minutes of the day of the two sessions' end-labelled bars.  Fixed values.
MORNING, AFTERNOON = (571, 690), (781, 900)
#: Stored labels of bar frequencies.  Fixed values.
FREQUENCIES = {"1d": "daily", "d": "daily", "day": "daily", "daily": "daily", "1m": "1min", "1min": "1min", "5m": "5min", "5min": "5min", "15m": "15min", "15min": "15min", "30m": "30min", "30min": "30min", "60m": "60min", "60min": "60min", "1h": "60min", "tick": "tick"}


def last_bars(bars: DataFrame, n: int, before: Column | None = None, time: str = "dt", by: str = "code") -> DataFrame:
    """The last n bars of each code at or before a time; Spark limits each group before the shuffle."""
    known = bars if before is None else bars.where(F.col(time) <= before)
    w = Window.partitionBy(by).orderBy(F.desc(time))
    return known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def last_bars_by_table(tables: Mapping[str, DataFrame], codes: DataFrame, n: int, at: Column, columns: Sequence[str], proxies: Mapping[str, str] | None = None, proxy_table: str = "", time: str = "dt") -> DataFrame:
    """The last n bars of each code (code) at or before a time, from the first table that has any.

    Tables take precedence in their order.  A code that none of them has gets
    the bars of its proxy in ``proxy_table`` under its own name.  ``table`` tells
    where the bars are from.  Order within a code is table, then latest time, so
    one exchange serves both choices and each group is limited before it.
    """
    wanted = codes.select("code").distinct()
    parts = [df.select(*columns).withColumns({"table": F.lit(name), "_rank": F.lit(i)}) for i, (name, df) in enumerate(tables.items())]
    if proxies:
        names = F.explode(F.filter(F.array(*[F.struct(F.lit(own).alias("own"), F.lit(proxy).alias("proxy")) for own, proxy in sorted(proxies.items())]), lambda p: p["proxy"] == F.col("code")))
        under = tables[proxy_table].where(F.col("code").isin(*sorted(set(proxies.values())))).select(*columns, names.alias("_p")).withColumn("code", F.col("_p.own")).drop("_p")
        parts.append(under.withColumns({"table": F.lit(f"{proxy_table} as proxy"), "_rank": F.lit(len(tables))}))
    known = reduce(DataFrame.unionByName, parts).where(F.col(time) <= at).join(wanted, "code", "left_semi")
    w = Window.partitionBy("code").orderBy("_rank", F.desc(time))
    top = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    first = F.min("_rank").over(Window.partitionBy("code"))
    return top.withColumn("_first", first).where("_rank = _first").select(*columns, "table")


def price_view(bars: DataFrame, fq: str, columns: Sequence[str] = ("open", "high", "low", "close"), by: str = "code") -> DataFrame:
    """Raw, front- or back-adjusted prices under the plain names.

    A code is replaced only if it has any adjusted value among these rows;
    then its missing values stay missing.
    """
    kinds = {"pre": "front", "dypre": "front", "front": "front", "post": "back", "dyback": "back", "dy_post": "back", "back": "back"}
    side = kinds.get(fq)
    if side is None:
        return bars
    has = F.max(reduce(lambda a, b: a | b, [F.col(f"{c}_{side}").isNotNull() for c in columns])).over(Window.partitionBy(by))
    out = bars.withColumn("_has", has)
    return out.withColumns({c: F.when(F.col("_has"), F.col(f"{c}_{side}")).otherwise(F.col(c)) for c in columns}).drop("_has")


def in_session(minute: Column, morning: tuple[int, int] = MORNING, afternoon: tuple[int, int] = AFTERNOON) -> Column:
    return minute.between(*morning) | minute.between(*afternoon)


def session_minutes(minutes: DataFrame, cutoff: int | None = None, exclusive: int = 0) -> DataFrame:
    """Minute bars inside the sessions, up to a minute of the day, less the length of the current bar if exclusive."""
    out = minutes.where(in_session(F.col("minute")))
    return out if cutoff is None else out.where(F.col("minute") <= cutoff - exclusive)


#: What a request for minute bars may lack.  Fixed values.
NO_TABLE, NO_ROWS, NO_FREQUENCY = "TABLE_MISSING", "TABLE_EMPTY", "FREQ_NOT_IN_TABLE"


def frequency_gaps(minutes: DataFrame, requests: DataFrame, freq: str) -> DataFrame:
    """(code, table, error, available) of requests (code, table) that have no bars of a frequency.

    A request without a table has the error that there is none; one without
    any bars, that it is empty; one with bars of other frequencies lists these.
    """
    label = FREQUENCIES[freq]
    held = minutes.groupBy("code").agg(F.array_sort(F.collect_set("freq")).alias("available"))
    got = requests.join(held, "code", "left")
    error = F.when(F.col("table").isNull(), NO_TABLE).when(F.col("available").isNull(), NO_ROWS).when(~F.array_contains("available", label), NO_FREQUENCY)
    listed = F.when(error == NO_FREQUENCY, F.array_join("available", ","))
    return got.select("code", "table", error.alias("error"), listed.alias("available")).where("error IS NOT NULL")


def minute_range(minutes: DataFrame, requests: DataFrame, freq: str, days: DataFrame, start: Column, end: Column, cutoff: int | None = None, fq: str = "none", columns: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Bars of one stored frequency, inside the sessions of the calendar's days (dt) from start to end, up to a minute of the last day.

    Requests (code, table) without a table have no bars; see ``frequency_gaps``
    for these.  Prices are those of the view ``fq``.
    """
    inside = in_session(F.col("minute")) & F.col("dt").between(start, end) & (F.col("freq") == FREQUENCIES[freq])
    if cutoff is not None:
        inside = inside & ((F.col("dt") < end) | (F.col("minute") <= cutoff))
    wanted = requests.where("table IS NOT NULL").select("code").distinct()
    open_ = days.where(F.col("dt").between(start, end)).select("dt").distinct()
    found = minutes.where(inside).join(F.broadcast(open_), "dt", "left_semi").join(wanted, "code", "left_semi")  # a row per trading day of the range
    return price_view(found, fq, columns)


def expected_minutes(days: DataFrame, day: str = "dt") -> DataFrame:
    """241 expected times of each day: 09:30 and the two sessions."""
    times = F.concat(F.array(F.lit(570)), F.sequence(F.lit(MORNING[0]), F.lit(MORNING[1])), F.sequence(F.lit(AFTERNOON[0]), F.lit(AFTERNOON[1])))
    return days.select(day, F.explode(times).alias("minute"))


def snapshot(tables: Mapping[str, DataFrame], at: Column, columns: Sequence[str], time: str = "dt") -> DataFrame:
    """Rows of a day of several tables put together; columns that a table lacks are null."""
    parts = []
    for name, df in tables.items():
        day = df.where(F.col(time) == at)
        parts.append(day.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns], F.lit(name).alias("table")))
    return reduce(DataFrame.unionByName, parts)


def ordered_query(df: DataFrame, filters: Sequence[tuple[str, str, object]] = (), order: Sequence[tuple[str, bool]] = (), limit: int | None = None, select: Sequence[str] = ()) -> DataFrame:
    """Filter, order and limit by field names; unknown fields are ignored, and a later order wins over an earlier one."""
    ops = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}
    for field, op, value in filters:
        if field in df.columns:
            df = df.where(ops[op](F.col(field), F.lit(value)))
    keys = [F.col(f).asc() if ascending else F.col(f).desc() for f, ascending in reversed(list(order)) if f in df.columns]
    if keys:
        df = df.orderBy(*keys)
    if limit is not None:
        df = df.limit(limit)
    fields = [f for f in select if f in df.columns]
    return df.select(*fields) if fields else df


def index_members_at(members: DataFrame, meta: DataFrame, at: Column) -> DataFrame:
    """Members of each index's latest complete snapshot at or before a month, one row per code."""
    last = meta.where((F.col("status") == "complete") & (F.col("month") <= at)).groupBy("index_code").agg(F.max("month").alias("month"))
    return latest(members.join(last, ["index_code", "month"]), ["index_code", "code"], F.desc("weight"))


def listing_dates(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """First day of each code by the first source that knows it: code, list_day, source."""
    done, out = None, []
    for name, df in sources:
        first = df.groupBy("code").agg(F.min("dt").alias("list_day")).withColumn("source", F.lit(name))
        out.append(first if done is None else first.join(done, "code", "left_anti"))
        done = first.select("code") if done is None else done.unionByName(first.select("code"))
    return reduce(DataFrame.unionByName, out)


def trade_days(bars: DataFrame, day: str = "dt") -> DataFrame:
    return bars.select(F.col(day).alias("day")).distinct()


def status_at(codes: DataFrame, bars: DataFrame, status: DataFrame, at: Column) -> DataFrame:
    """code, st, halt, risk, delisted at a day for a list of codes; a code without a bar that day is delisted."""
    day = bars.where(F.col("dt") == at).select("code", ((F.col("volume") == 0) | F.col("volume").isNull()).alias("halt"), (F.col("close") < 1).alias("risk"), F.lit(True).alias("known"))
    named = latest(status.where(F.col("dt") <= at), "code", F.desc("dt")).select("code", (F.col("status") == "ST").alias("st"))
    false = F.lit(False)
    joined = codes.join(day, "code", "left").join(named, "code", "left")
    return joined.select("code", F.coalesce("st", false).alias("st"), F.coalesce("halt", false).alias("halt"), F.coalesce("risk", false).alias("risk"), F.col("known").isNull().alias("delisted"))


def filter_by_status(codes: DataFrame, drop: Sequence[str] = ("ST", "HALT", "DELISTING")) -> DataFrame:
    """Codes (with status_at's flags) that have none of the named states."""
    tests = {"ST": F.col("st") | F.col("risk"), "HALT": F.col("halt"), "DELISTING": F.col("delisted"), "DELISTING_SORTING": F.col("risk")}
    return codes.where(~reduce(lambda a, b: a | b, [tests[d] for d in drop]))


def get_price(bars: DataFrame, codes: Sequence[str], count: int | None = None, start: str | None = None, end: str | None = None, fields: Sequence[str] = (), fq: str = "none") -> DataFrame:
    """Bars by count, else by range, with the trade day, an alias of the amount, and chosen fields."""
    wanted = bars.where(F.col("code").isin(list(codes)))
    until = F.lit(end).cast("date") if end else None
    if count is not None:
        got = last_bars(wanted, count, until)
    else:
        got = wanted if start is None else wanted.where(F.col("dt") >= F.lit(start).cast("date"))
        got = got if until is None else got.where(F.col("dt") <= until)
    got = price_view(got, fq).withColumn("money", F.col("amount"))
    return got.select("code", "dt", *fields) if fields else got


def placed(df: DataFrame, order: Sequence[Column], path: str, out: str = "place") -> DataFrame:
    """All rows with their place (from 1) in a total order by many keys.

    Rows are dealt by ranges of the keys and sorted in their partitions; the
    sorted rows are stored under ``path`` with their place in the partition, to
    which the rows of the partitions before are added (one number each).
    """
    part, own = "_part", "_own"
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id())
    ordered.write.parquet(path)
    stored = df.sparkSession.read.parquet(path).withColumn(part, F.shiftrightunsigned(own, 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy(part).agg(F.count("*").alias("_n")).select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per partition
    return stored.join(F.broadcast(sizes), part).withColumn(out, F.col("_before") + F.col(own).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(part, own, "_before")
