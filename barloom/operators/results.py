"""Run results: value curves, trade statistics, costs and the comparison of two runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a trading year, yearly risk-free rate, and cost constants.  Fixed values.
YEAR, RISK_FREE = 250, 0.03
COMMISSION, LEAST_COMMISSION, TRANSFER = 0.00025, 5.0, 0.00001
STAMP_BEFORE, STAMP_AFTER, STAMP_CHANGE = 0.001, 0.0005, "2023-08-28"


def curve(nav: DataFrame) -> DataFrame:
    """(dt, nav, bench, r, rb): daily returns; the first day's is counted from 1."""
    w = Window.partitionBy(F.lit(1)).orderBy("dt")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(1.0))
    return nav.withColumns({"r": F.col("nav") / before("nav") - 1, "rb": F.col("bench") / before("bench") - 1})


def business_days(start: Column, end: Column) -> Column:
    """Weekdays from start to end, both counted."""
    days = F.sequence(start, end)
    return F.size(F.filter(days, lambda d: F.dayofweek(d).between(2, 6)))


def summary(curved: DataFrame) -> DataFrame:
    """One row of metrics of a curve.  A curve has one row per trading day."""
    w = Window.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = curved.withColumns({"top": F.max("nav").over(w), "down": F.least("r", F.lit(0.0)), "excess": F.col("r") - F.col("rb")})
    base = rows.agg(
        F.count("*").alias("n"), (F.max_by("nav", "dt") - 1).alias("total"), F.min(F.col("nav") / F.col("top") - 1).alias("drawdown"), F.avg("r").alias("mean"), F.var_pop("r").alias("var"),
        F.sum(F.col("down") * F.col("down")).alias("down2"), F.covar_samp("r", "rb").alias("cov"), F.var_pop("rb").alias("var_b"), (F.max_by("bench", "dt") - 1).alias("total_b"),
        F.avg("excess").alias("excess"), F.stddev_pop("excess").alias("excess_sd"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"), F.min("dt").alias("d0"), F.max("dt").alias("d1"),
    )
    annual = F.pow(1 + F.col("total"), F.lit(float(YEAR)) / F.col("n")) - 1
    annual_b = F.pow(1 + F.col("total_b"), F.lit(float(YEAR)) / F.col("n")) - 1
    out = base.withColumns({"annual": annual, "annual_b": annual_b, "bdays": business_days(F.col("d0"), F.col("d1"))})
    vol = F.sqrt(F.lit(float(YEAR)) / F.col("bdays") * F.col("var") * F.col("n"))
    out = out.withColumns({"volatility": vol, "beta": F.try_divide("cov", "var_b"), "downside": F.sqrt(F.lit(float(YEAR)) / F.col("n") * F.col("down2"))})
    return out.withColumns({
        "sharpe": F.try_divide(F.col("annual") - RISK_FREE, F.col("volatility")), "sortino": F.try_divide(F.col("annual") - RISK_FREE, F.col("downside")),
        "alpha": F.col("annual") - (RISK_FREE + F.col("beta") * (F.col("annual_b") - RISK_FREE)), "information": F.try_divide(F.col("excess"), F.col("excess_sd")) * F.sqrt(F.lit(float(YEAR))),
    })


def stamp_rate(day: Column) -> Column:
    return F.when(day >= F.lit(STAMP_CHANGE).cast("date"), STAMP_AFTER).otherwise(STAMP_BEFORE)


def trade_cost(price: Column, volume: Column, action: Column, day: Column, slip: float = 0.002, ticks: int | None = None, tick: float = 0.01, decimals: int = 2) -> dict[str, Column]:
    """Filled price and the fees on it.

    The price moves against the trade by half the slip, or by a number of ticks
    where one is given, and is rounded.
    """
    buy = action == "buy"
    moved = price * F.when(buy, 1 + slip / 2).otherwise(1 - slip / 2) if ticks is None else price + F.when(buy, ticks * tick).otherwise(-ticks * tick)
    filled = F.round(moved + 1e-9, decimals)
    notional = filled * volume
    commission = F.greatest(notional * COMMISSION, F.lit(LEAST_COMMISSION))
    stamp = F.when(buy, 0.0).otherwise(notional * stamp_rate(day))
    return {"filled": filled, "fee": commission + stamp + notional * TRANSFER}


def trade_table(trades: DataFrame) -> DataFrame:
    """Trades as they are handed out: amount is price times volume."""
    return trades.withColumn("amount", F.col("price") * F.col("volume"))


def daily_table(curve: DataFrame, value: str, day: str = "dt", by: Sequence[str] = ()) -> DataFrame:
    """Values with their daily return, 0 on the first day (of each key): a row per day."""
    w = Window.partitionBy(*by).orderBy(day)
    return curve.select(*by, day, value).withColumn("daily_return", F.coalesce(F.col(value) / F.lag(value).over(w) - 1, F.lit(0.0)))


def round_trips(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each sell with its code's earliest buy that is open then; order tells the sequence within a day.

    A sell that no open buy precedes is left out.  The sells left out so far
    are as many as the running balance of buys and sells has ever been below
    zero, so a sell's place among the others is the number of its buy.
    """
    w = Window.partitionBy("code").orderBy("dt", *order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    buy = F.col("action") == "buy"
    rows = trades.where(F.col("action").isin("buy", "sell")).withColumns({"open": F.sum(F.when(buy, 1).otherwise(-1)).over(so_far), "k": F.sum(buy.cast("long")).over(so_far), "nth": F.sum((~buy).cast("long")).over(so_far)})
    rows = rows.withColumn("missed", F.greatest(F.lit(0), -F.min("open").over(so_far)))
    rows = rows.withColumn("met", F.col("missed") == F.coalesce(F.lag("missed").over(w), F.lit(0)))
    buys = rows.where(buy).select("code", "k", F.col("dt").alias("buy_day"), F.col("price").alias("buy_price"))
    sells = rows.where(~buy & F.col("met")).select("code", (F.col("nth") - F.col("missed")).alias("k"), F.col("dt").alias("sell_day"), F.col("price").alias("sell_price"), "volume")
    return buys.join(sells, ["code", "k"]).withColumn("profit", (F.col("sell_price") - F.col("buy_price")) * F.col("volume"))


def trade_statistics(profits: DataFrame, profit: str = "profit") -> DataFrame:
    p = F.col(profit)
    sums = profits.agg(F.count("*").alias("n"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gain"), F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("loss"))
    return sums.withColumns({"win_rate": F.try_divide("wins", "n"), "profit_factor": F.try_divide("gain", "loss")})


def cost_position_wins(trades: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per code: sells, and sells above the moving average cost.

    The cost is stateful along a code's trades, which come in order, batch by
    batch; only the position and the counts are carried on, so a code may have
    any number of trades.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, held, cost, sells, wins, any_ = None, 0.0, 0.0, 0, 0, False
        for pdf in batches:
            done = []
            for c, action, price, volume in zip(pdf["code"], pdf["action"], pdf["price"], pdf["volume"], strict=True):
                if c != code or not any_:
                    if any_:
                        done.append((code, sells, wins))
                    code, held, cost, sells, wins, any_ = c, 0.0, 0.0, 0, 0, True
                if action == "buy":
                    cost = (cost * held + price * volume) / (held + volume) if held + volume else 0.0
                    held += volume
                elif held > 0:
                    sells, wins = sells + 1, wins + (price > cost)
                    held = max(0.0, held - volume)
            yield pd.DataFrame(done, columns=["code", "sells", "wins"])
        if any_:
            yield pd.DataFrame([(code, sells, wins)], columns=["code", "sells", "wins"])

    rows = trades.select("code", "dt", "action", "price", "volume", *order).repartition("code").sortWithinPartitions("code", "dt", *order)
    return rows.select("code", "action", "price", "volume").mapInPandas(run, "code string, sells long, wins long")


def monthly(curved: DataFrame) -> DataFrame:
    """Compounded return of each month, years as rows and months as columns."""
    per = curved.groupBy(F.year("dt").alias("year"), F.month("dt").alias("month")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("ret"))
    return per.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("ret"))


def rolling_risk(curved: DataFrame, n: int = 30) -> DataFrame:
    """Rolling Sharpe ratio, volatility and the drawdown inside the window."""
    w = Window.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(1 - n, 0)
    full = F.count("r").over(w) == n
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("worst"))

    def step(acc: Column, v: Column) -> Column:
        top = F.greatest(acc["top"], v)
        return F.struct(top.alias("top"), F.least(acc["worst"], v / top - 1).alias("worst"))

    worst = F.aggregate(F.collect_list("nav").over(w), start, step, lambda acc: acc["worst"])
    sd, root = F.stddev_samp("r").over(w), F.sqrt(F.lit(252.0))
    return curved.withColumns({"sharpe": F.when(full, F.try_divide(F.avg("r").over(w), sd) * root), "vol": F.when(full, sd * root), "dd": F.when(full, worst)})


def histogram(curved: DataFrame, x: str = "r") -> DataFrame:
    """Counts in min(50, n / 2 + 1) bins of equal width."""
    edge = curved.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.least(F.lit(50), F.floor(F.count(x) / 2) + 1).cast("int").alias("bins"))
    at = F.least(F.floor((F.col(x) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * F.col("bins")), F.col("bins") - 1)
    return curved.where(F.col(x).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def nav_from_trades(trades: DataFrame, holdings: DataFrame, initial: float) -> DataFrame:
    """Value of each day of either side: initial less running cash out plus holdings' value, the cash carried forward."""
    out = F.when(F.col("action") == "buy", F.col("amount")).otherwise(-F.col("amount")) + F.col("fee")
    cash = trades.groupBy("dt").agg(F.sum(out).alias("out"))
    held = holdings.groupBy("dt").agg(F.sum("value").alias("held"))
    w = Window.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    both = cash.join(held, "dt", "full")
    return both.withColumn("nav", F.lit(initial) - F.coalesce(F.sum("out").over(w), F.lit(0.0)) + F.coalesce("held", F.lit(0.0)))


def agreement(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys in both, in one only, and the Jaccard index."""
    a = left.select(*keys).distinct().withColumn("a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("b", F.lit(1))
    both = a.join(b, list(keys), "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))
    return both.withColumn("jaccard", F.try_divide("common", F.col("common") + F.col("left_only") + F.col("right_only")))


def cost_gap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fees over turnover of both sides by key, and the relative gap."""
    rate = lambda df, n: df.groupBy(*keys).agg(F.try_divide(F.sum("fee"), F.sum("amount")).alias(n))
    return rate(left, "rate_l").join(rate(right, "rate_r"), list(keys)).withColumn("gap", F.try_divide(F.col("rate_r") - F.col("rate_l"), F.col("rate_l")))


def same(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of one side that the other lacks, repeats counted."""
    a = left.exceptAll(right).agg(F.count("*").alias("left_only"))
    return a.crossJoin(F.broadcast(right.exceptAll(left).agg(F.count("*").alias("right_only")))).withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either side with the side that has them: left_only, right_only or both."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    return a.join(b, list(keys), "full").select(*keys, side.alias("side"))


def attribution(left: DataFrame, right: DataFrame, keys: Sequence[str], examples: int = 3) -> DataFrame:
    """Counts of keys by side with the first few of them as examples."""
    rows = differences(left, right, keys)
    place = F.row_number().over(Window.partitionBy("side").orderBy(*keys))
    shown = rows.withColumn("_n", place).where(F.col("_n") <= examples).groupBy("side").agg(F.array_sort(F.collect_list(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))).alias("examples"))
    return rows.groupBy("side").agg(F.count("*").alias("n")).join(F.broadcast(shown), "side")  # three rows at most


def match_rate(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows with equal keys on both sides, repeats counted, over the rows of the larger side."""
    a, b = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((left, "a"), (right, "b")))
    met = a.join(b, list(keys), "full")
    return met.agg(F.try_divide(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))), F.greatest(F.sum("a"), F.sum("b"))).alias("rate"))


def holding_overlap(left: DataFrame, right: DataFrame, day: str = "dt", code: str = "code") -> DataFrame:
    """One row: days, and the mean over days of the Jaccard index of the two sides' codes."""
    daily = differences(left, right, [day, code]).groupBy(day).agg((F.count_if(F.col("side") == "both") / F.count("*")).alias("j"))
    return daily.agg(F.count("*").alias("days"), F.avg("j").alias("overlap"))


def holding_changes(trades: DataFrame, order: Sequence[str], side: str, day: str = "dt", code: str = "code") -> DataFrame:
    """(code, day, held, side): whether a code is held after each of its days with trades, by the last of them."""
    last = F.max_by("action", F.struct(*[F.col(o) for o in order]))
    return trades.groupBy(code, day).agg((last == "buy").alias("held")).withColumn("side", F.lit(side))


def carried_overlap(left: DataFrame, right: DataFrame, order: Sequence[str], day: str = "dt", code: str = "code") -> DataFrame:
    """Per day on which the left side trades: codes that both sides hold (common), that any holds (either), and their share.

    Holdings are carried from the trades: a code is held from a buy to its next
    sell.  Per code, the days on which either side changes give intervals in
    which both, or any, hold it; their starts and ends are summed by day, so no
    code has a row for every day.  Days before the right side's first trade,
    and days on which nobody holds anything, are left out.
    """
    changes = holding_changes(left, order, "l", day, code).unionByName(holding_changes(right, order, "r", day, code))
    state = lambda s: F.coalesce(F.last(F.when(F.col("side") == s, F.col("held")), True).over(Window.partitionBy(code).orderBy(day).rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))
    now = changes.select(code, day, (state("l") & state("r")).cast("int").alias("both"), (state("l") | state("r")).cast("int").alias("any")).distinct()
    by = Window.partitionBy(code).orderBy(day)
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(by), F.lit(0))
    deltas = now.select(day, step("both").alias("both"), step("any").alias("any")).groupBy(day).agg(F.sum("both").alias("both"), F.sum("any").alias("any"))
    upto = Window.orderBy(day)  # a row per trading day
    sums = deltas.select(day, F.sum("both").over(upto).alias("common"), F.sum("any").over(upto).alias("either"))
    days = left.select(day).distinct().crossJoin(F.broadcast(right.agg(F.min(day).alias("_since")))).where(F.col(day) >= F.col("_since")).select(day)
    return sums.join(days, day).where("either > 0").withColumn("overlap", F.col("common") / F.col("either"))


def gap_parts(returns: DataFrame, match: DataFrame, overlap: DataFrame) -> DataFrame:
    """The gap of two total returns (left_return, right_return) in basis points, split by what trades and holdings do not share.

    What unmatched trades explain comes first, of the rest what different
    holdings explain, and what is left last.  Each frame has one row.
    """
    row = returns.crossJoin(F.broadcast(match.select("rate"))).crossJoin(F.broadcast(overlap.select("overlap")))
    row = row.withColumn("total_bps", (F.col("left_return") - F.col("right_return")) * 10000)
    row = row.withColumn("engine_bps", F.col("total_bps") * (1 - F.col("rate")))
    row = row.withColumn("data_bps", (F.col("total_bps") - F.col("engine_bps")) * (1 - F.col("overlap")))
    return row.withColumn("source_bps", F.col("total_bps") - F.col("engine_bps") - F.col("data_bps"))


def performance_gap(both: DataFrame, left: str, right: str, limits: Sequence[float] = (0.02, 0.02, 0.2)) -> DataFrame:
    """One row on the days of both curves, each counted from its first value: gaps of the end, the drawdown and the Sharpe ratio.

    A gap below its limit is good; where not all are, one below twice its limit is a near miss.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("dt")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = both.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    sides = {"l": left, "r": right}
    rows = rows.withColumns({f"_{s}": F.col(c) / F.first(c).over(whole) for s, c in sides.items()})
    rows = rows.withColumns({f"_{s}_{n}": e for s in sides for n, e in (("top", F.max(f"_{s}").over(whole)), ("ret", F.col(f"_{s}") / F.lag(f"_{s}").over(w) - 1))})
    sharpe = lambda s: F.try_divide(F.avg(f"_{s}_ret"), F.stddev_samp(f"_{s}_ret")) * F.sqrt(F.lit(252.0))
    down = lambda s: F.min(F.col(f"_{s}") / F.col(f"_{s}_top") - 1)
    end = lambda s: F.max_by(f"_{s}", "dt")
    names = ("end_gap", "drawdown_gap", "sharpe_gap")
    out = rows.agg(F.count("*").alias("days"), *[F.abs(f("l") - f("r")).alias(n) for n, f in zip(names, (end, down, sharpe), strict=True)])
    good = [F.coalesce(F.col(n) < limit, F.lit(False)) for n, limit in zip(names, limits, strict=True)]
    near = [F.coalesce(F.col(n) < 2 * limit, F.lit(False)) for n, limit in zip(names, limits, strict=True)]
    out = out.withColumn("ok", good[0] & good[1] & good[2])
    return out.withColumn("near_miss", ~F.col("ok") & (near[0] | near[1] | near[2]))


def curve_hash(curved: DataFrame, value: str = "nav", digits: int = 6) -> DataFrame:
    """One row: a digest of the values of all days in order, in whole steps of the last digit.  A curve has one row per trading day."""
    step = F.round(F.col(value) * 10**digits).cast("bigint").cast("string")
    rows = F.array_sort(F.collect_list(F.struct(F.col("dt"), step.alias("v"))))
    return curved.agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["v"]), ","), 256).alias("hash"))


def run_profile(trades: DataFrame, daily: DataFrame) -> DataFrame:
    """One row on a run: trades by side, bought symbols, value, buys per trading day; and from daily (dt, positions, market_value, cash, total) the most positions, and mean exposure and cash ratio from the first trade on."""
    buy = F.col("action") == "buy"
    made = trades.agg(
        F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells"), F.count_distinct(F.when(buy, F.col("code"))).alias("symbols"), F.count_distinct("dt").alias("trade_days"),
        F.sum("amount").alias("value"), F.try_divide(F.count_if(buy), F.count_distinct(F.when(buy, F.col("dt")))).alias("buys_per_day"), F.min("dt").alias("_first"),
    )
    days = daily.crossJoin(F.broadcast(made))
    after = F.coalesce(F.col("dt") >= F.col("_first"), F.lit(True))
    ratio = lambda c: F.avg(F.when(after, F.coalesce(F.try_divide(c, "total"), F.lit(0.0))))
    own = [F.first(c).alias(c) for c in made.columns if c != "_first"]
    return days.agg(*own, F.count("*").alias("days"), F.max("positions").alias("most_positions"), F.max(F.when(after, F.col("positions"))).alias("positions_after"), ratio("market_value").alias("exposure"), ratio("cash").alias("cash_ratio"), F.max_by("total", "dt").alias("final"))


def result_gate(daily: DataFrame, trades: DataFrame, order: Sequence[str], final: float, tolerance: float, count: int, sequence: DataFrame, last_bought: str) -> DataFrame:
    """One row: the last day's total within its tolerance, the number of trades, the sequence of (dt, code, action) place by place, and the code bought last.

    Trades are in order by day, so places are compared within days and no task
    holds all of them; ``sequence`` has its place within the day as ``place``.
    """
    own = trades.select("dt", "code", "action", F.row_number().over(Window.partitionBy("dt").orderBy(*order)).alias("place"))
    met = own.join(sequence.select("dt", "place", F.col("code").alias("_code"), F.col("action").alias("_action")), ["dt", "place"], "full")
    off = ~(F.col("code").eqNullSafe(F.col("_code")) & F.col("action").eqNullSafe(F.col("_action")))
    end = daily.agg(F.max_by("total", "dt").alias("final"))
    made = trades.agg(F.count("*").alias("trades"), F.max_by("code", F.when(F.col("action") == "buy", F.struct("dt", *order))).alias("last_bought"))
    row = end.crossJoin(F.broadcast(made)).crossJoin(F.broadcast(met.agg(F.count_if(off).alias("sequence_off"))))
    row = row.withColumns({"final_ok": F.abs(F.col("final") - final) <= tolerance, "count_ok": F.col("trades") == count, "last_ok": F.coalesce(F.col("last_bought") == last_bought, F.lit(False))})
    return row.withColumn("pass", F.col("final_ok") & F.col("count_ok") & F.col("last_ok") & (F.col("sequence_off") == 0))


def occupancy(traded: DataFrame, held: DataFrame, flag: Column, rate: float = COMMISSION, least: float = LEAST_COMMISSION) -> DataFrame:
    """One row on days with trades (dt, amount) and holdings (dt, held): days, mean turnover, friction, and the share of days that a flag marks."""
    day = traded.groupBy("dt").agg(F.sum("amount").alias("amount")).join(held.groupBy("dt").agg(F.sum("held").alias("held")), "dt")
    return day.agg(F.count("*").alias("days"), F.avg(F.col("amount") / F.col("held")).alias("turnover"), F.sum(F.greatest(F.col("amount") * rate, F.lit(least))).alias("friction"), F.avg(flag.cast("int")).alias("occupied"))


def correlation(both: DataFrame, left: str, right: str) -> DataFrame:
    """One row: days that both curves have, and their Pearson correlation."""
    common = both.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return common.agg(F.count("*").alias("n"), F.corr(left, right).alias("corr"))
