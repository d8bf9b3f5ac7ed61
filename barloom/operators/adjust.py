"""Adjusted prices, factor checks and corporate actions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import S

PRICES = ("open", "high", "low", "close")


def anchors(factors: DataFrame) -> DataFrame:
    """The factor at each code's latest and at its earliest time, never the largest one."""
    return factors.groupBy("code").agg(F.max_by("adj_factor", "dt").alias("latest"), F.min_by("adj_factor", "dt").alias("earliest"))


def adjust(bars: DataFrame, factors: DataFrame, columns: Sequence[str] = PRICES, strict: bool = False) -> DataFrame:
    """Front- and back-adjusted prices; a row without a factor has none.

    With ``strict``, a row of a code without any factor is an error when it is
    read; ``lacking_anchors`` lists such codes beforehand.
    """
    day = factors.groupBy("code", "dt").agg(F.max_by("adj_factor", "time").alias("adj_factor"))
    joined = bars.join(day, ["code", "dt"], "left").join(anchors(factors), "code", "left")
    if strict:
        told = F.raise_error(F.concat(F.lit("no factor at all for "), F.col("code"))).cast("double")
        joined = joined.withColumn("latest", F.when(F.col("latest").isNull(), told).otherwise(F.col("latest")))
    sides = {f"{c}_front": F.col(c) * F.col("adj_factor") / F.col("latest") for c in columns} | {f"{c}_back": F.col(c) * F.col("adj_factor") / F.col("earliest") for c in columns}
    return joined.withColumns(sides)


def restore(adjusted: DataFrame, factors: DataFrame, column: str, out: str) -> DataFrame:
    """Raw prices from front-adjusted ones; a missing factor is an error when the row is read."""
    day = factors.select("code", "dt", "adj_factor")
    joined = adjusted.join(day, ["code", "dt"], "left").join(anchors(factors), "code", "left")
    missing = F.col("adj_factor").isNull() | F.col("latest").isNull()
    return joined.withColumn(out, F.when(missing, F.raise_error(F.lit("a row has no factor"))).otherwise(F.col(column) * F.col("latest") / F.col("adj_factor"))).drop("adj_factor", "latest", "earliest")


def invariant(adjusted: DataFrame, column: str = "close_front", tolerance: float = 1e-6) -> DataFrame:
    """One row: checked rows, bad rows, and rows skipped for no side or no factor."""
    due = F.col("close") * F.col("adj_factor") / F.col("latest")
    off = F.abs(F.col(column) - due) / F.greatest(F.abs(due), F.lit(1e-12))
    return adjusted.agg(
        F.count_if(off.isNotNull()).alias("checked"), F.count_if(off > tolerance).alias("bad"), F.count_if(F.col(column).isNull()).alias("no_side"), F.count_if(F.col("adj_factor").isNull()).alias("no_factor")
    )


def factor_jumps(factors: DataFrame, high: float = 2.0, low: float = 0.5, gap: int = 1) -> DataFrame:
    """Rows whose factor jumps against the one before, or that follow a gap in days."""
    before = S.ref("adj_factor")
    out = factors.withColumns({"ratio": F.col("adj_factor") / before, "days": F.datediff("dt", S.ref("dt"))})
    return out.where((F.col("ratio") > high) | (F.col("ratio") < low) | (F.col("days") > gap))


def factor_integrity(factors: DataFrame, official: DataFrame, high: float = 2.0, low: float = 0.5, gap: int = 1, share: float = 0.05, tolerance: float = 1e-6) -> DataFrame:
    """(code, dt, kind, value): jumps and gaps of a code, days on which more than one code and more than a share of all codes change (code null), and values other than the official ones.

    ``official`` has code, dt and value.  Gaps are in calendar days.
    """
    rows = factor_jumps(factors, high, low, gap)
    jump = (F.col("ratio") > high) | (F.col("ratio") < low)
    jumps = rows.where(jump).select("code", "dt", F.lit("jump").alias("kind"), F.col("ratio").alias("value"))
    gaps = rows.where(F.col("days") > gap).select("code", "dt", F.lit("gap").alias("kind"), F.col("days").cast("double").alias("value"))
    changed = factors.withColumn("_moved", F.col("adj_factor") != S.ref("adj_factor")).where("_moved").groupBy("dt").agg(F.count_distinct("code").alias("n"))
    codes = factors.agg(F.greatest(F.lit(1), F.floor(F.count_distinct("code") * share)).alias("most"))
    spikes = changed.crossJoin(F.broadcast(codes)).where(F.col("n") > F.col("most")).select(F.lit(None).cast("string").alias("code"), "dt", F.lit("spike").alias("kind"), F.col("n").cast("double").alias("value"))
    met = factors.join(official.select("code", "dt", "value"), ["code", "dt"])
    off = met.where(F.abs(F.col("adj_factor") - F.col("value")) > tolerance).select("code", "dt", F.lit("official").alias("kind"), (F.col("adj_factor") - F.col("value")).alias("value"))
    return reduce(DataFrame.unionByName, [jumps, gaps, spikes, off])


def revisions(observed: DataFrame, baseline: DataFrame, as_of: Column, eps: float = 1e-9) -> DataFrame:
    """Every observed key up to as_of with status new, unchanged or revision, and the relative change."""
    o = observed.where(F.col("dt") <= as_of).select("code", "dt", F.col("adj_factor").alias("now"))
    b = baseline.select("code", "dt", F.col("adj_factor").alias("base"))
    delta = F.abs(F.col("now") - F.col("base"))
    status = F.when(F.col("base").isNull(), "new").when(delta <= eps, "unchanged").otherwise("revision")
    return o.join(b, ["code", "dt"], "left").select("code", "dt", status.alias("status"), F.try_divide(F.col("now") - F.col("base"), F.col("base")).alias("relative"))


def versions(observations: DataFrame, keys: Sequence[str], order: str, value: str, absolute: float = 1e-6, relative: float = 1e-6) -> DataFrame:
    """Latest accepted value and revision number of each key.

    Observations are taken in order; one that lies within the tolerance of the
    accepted value is seen again, any other is a new revision.  A key's
    observations are as many as it was reported.
    """
    rows = observations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("all"))
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(-1).alias("n"), F.lit(0).alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        tolerance = F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(acc["v"]), F.abs(x["v"])))
        same = acc["v"].isNotNull() & (F.abs(acc["v"] - x["v"]) <= tolerance)
        return F.when(same, F.struct(acc["v"].alias("v"), acc["n"].alias("n"), (acc["seen"] + 1).alias("seen"))).otherwise(F.struct(x["v"].alias("v"), (acc["n"] + 1).alias("n"), F.lit(1).alias("seen")))

    return rows.withColumn("state", F.aggregate("all", start, step)).select(*keys, F.col("state.v").alias(value), F.col("state.n").alias("revision_no"), F.col("state.seen").alias("seen"))


def dividend_events(dividends: DataFrame, as_of: Column, known: DataFrame | None = None) -> DataFrame:
    """Implemented dividends as events with an id made of their content: scheduled if in the future, else pending."""
    ids = F.sha2(F.concat_ws("|", "code", F.col("ex_day").cast("string"), F.format_string("%.4f", "cash"), F.format_string("%.4f", "stock")), 256)
    out = dividends.where("proc = 'implemented' AND ex_day IS NOT NULL").select("code", "ex_day", ids.alias("event_id"), F.when(F.col("ex_day") > as_of, "scheduled").otherwise("pending").alias("status"))
    return out if known is None else out.join(known.select("event_id"), "event_id", "left_anti").select(*out.columns)


def segment_series(ratio: np.ndarray, tolerance: float = 5e-4) -> np.ndarray:
    """Segment numbers; a new one starts when the ratio leaves the first value of the current one."""
    out, ref, number = np.zeros(len(ratio), np.int64), None, -1
    for i, r in enumerate(ratio):
        if ref is None or abs(r / ref - 1) > tolerance:
            ref, number = r, number + 1
        out[i] = number
    return out


def segments(rows: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """(code, dt, ratio, segment): grouped pandas over one code's history, as the reference point is stateful."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt").reset_index(drop=True)
        return pdf.assign(segment=segment_series(pdf["ratio"].to_numpy(float), tolerance))[["code", "dt", "ratio", "segment"]]

    return rows.select("code", "dt", "ratio").groupBy("code").applyInPandas(run, "code string, dt date, ratio double, segment long")


def segment_ranges(segmented: DataFrame) -> DataFrame:
    """Half-open day ranges of segments with their median ratio and its dispersion."""
    per = segmented.groupBy("code", "segment").agg(F.min("dt").alias("start_day"), F.median("ratio").alias("ratio"), (F.max("ratio") / F.min("ratio") - 1).alias("dispersion"), F.count("*").alias("n"))
    return per.withColumn("end_day", F.lead("start_day").over(Window.partitionBy("code").orderBy("segment")))


def segment_refusals(stored: DataFrame, staged: DataFrame, value: str = "value", tolerance: float = 5e-4, several: bool = False) -> DataFrame:
    """(code, reason): codes whose ratios of staged to stored values must not be applied, with the first reason that holds.

    ``gap``: a stored day between the first and last common day is not staged.
    ``bad_value``: a value of a common day is missing, not finite or not
    positive.  ``dispersion``: the ratios of a segment lie further apart than
    the tolerance.  ``several``: more than one segment changes anything, unless
    that is allowed.  Codes without a common day have no ratios and no refusal.
    """
    a, b = (df.select("code", "dt", F.col(value).cast("double").alias(n), F.lit(True).alias(f"_{n}")) for df, n in ((stored, "old"), (staged, "new")))
    both = a.join(b, ["code", "dt"], "full")
    common = F.col("_old") & F.col("_new")
    span = both.groupBy("code").agg(F.min(F.when(common, F.col("dt"))).alias("_from"), F.max(F.when(common, F.col("dt"))).alias("_to"))
    good = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c), F.lit(False))
    inside = both.join(span.where("_from IS NOT NULL"), "code").where(F.col("dt").between(F.col("_from"), F.col("_to")))
    marks = inside.groupBy("code").agg(F.count_if(F.col("_old") & F.col("_new").isNull()).alias("gaps"), F.count_if(F.coalesce(common, F.lit(False)) & ~(good("old") & good("new"))).alias("bad"))
    ratios = inside.where(common & good("old") & good("new")).select("code", "dt", (F.col("new") / F.col("old")).alias("ratio"))
    per = segment_ranges(segments(ratios, tolerance)).groupBy("code").agg(F.max("dispersion").alias("wide"), F.count_if(F.abs(F.col("ratio") - 1) > tolerance).alias("changing"))
    reason = F.when(F.col("gaps") > 0, "gap").when(F.col("bad") > 0, "bad_value").when(F.col("wide") > tolerance, "dispersion")
    if not several:
        reason = reason.when(F.col("changing") > 1, "several")
    return marks.join(per, "code", "left").select("code", reason.alias("reason")).where("reason IS NOT NULL")


def lacking_anchors(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """(code, reason): codes with bars that have no factor, or none on some of their days, so that their adjusted sides cannot be made."""
    f = factors.where("adj_factor IS NOT NULL").select("code", "dt", F.lit(True).alias("_f"))
    per = bars.select("code", "dt").join(f, ["code", "dt"], "left").groupBy("code").agg(F.count("_f").alias("_with"), F.count("*").alias("_all"))
    known = f.select("code").distinct().withColumn("_any", F.lit(True))
    reason = F.when(F.col("_any").isNull(), "no_anchor").when(F.col("_with") < F.col("_all"), "no_factor")
    return per.join(known, "code", "left").select("code", reason.alias("reason")).where("reason IS NOT NULL")


def apply_segments(rows: DataFrame, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Multiplies columns by the ratio of the segment a row falls in; a missing value stays missing."""
    r = ranges.select("code", F.col("start_day"), F.struct("ratio", "end_day").alias("s"))
    from .joins import asof

    joined = asof(rows, r.select("code", "start_day", F.col("s.ratio").alias("ratio"), F.col("s.end_day").alias("end_day")), "code", "dt", "start_day", ["ratio", "end_day"], "seg_")
    inside = F.col("seg_ratio").isNotNull() & (F.col("seg_end_day").isNull() | (F.col("dt") < F.col("seg_end_day")))
    return joined.withColumns({c: F.when(inside, F.col(c) * F.col("seg_ratio")).otherwise(F.col(c)) for c in columns}).drop("seg_ratio", "seg_end_day")


def bar_relation(prefix: str = "", suffix: str = "") -> Column:
    """Whether low and high enclose open and close."""
    o, h, low, c = (F.col(f"{prefix}{x}{suffix}") for x in PRICES)
    return (low <= F.least(o, c) + 1e-9) & (F.greatest(o, c) <= h + 1e-9)


def compare_sides(left: DataFrame, right: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("code", "dt"), tolerance: float = 1e-6) -> DataFrame:
    """One row: rows and codes that differ, cells, null mismatches, largest differences and the earliest one."""
    joined = left.select(*keys, *[F.col(c).alias(f"{c}_l") for c in columns]).join(right.select(*keys, *[F.col(c).alias(f"{c}_r") for c in columns]), list(keys))
    nulls = [F.col(f"{c}_l").isNull() != F.col(f"{c}_r").isNull() for c in columns]
    off = [F.coalesce(F.abs(F.col(f"{c}_l") - F.col(f"{c}_r")), F.lit(0.0)) for c in columns]
    rel = [F.coalesce(F.try_divide(F.abs(F.col(f"{c}_l") - F.col(f"{c}_r")), F.abs(F.col(f"{c}_l"))), F.lit(0.0)) for c in columns]
    bad = reduce(lambda a, b: a | b, [n | (d > tolerance) for n, d in zip(nulls, off, strict=True)])
    cells = reduce(lambda a, b: a + b, [(n | (d > tolerance)).cast("long") for n, d in zip(nulls, off, strict=True)])
    most = lambda parts: F.max(parts[0] if len(parts) == 1 else F.greatest(*parts))
    return joined.agg(
        F.count("*").alias("compared"), F.count_if(bad).alias("rows_off"), F.count_distinct(F.when(bad, F.col("code"))).alias("codes_off"), F.sum(cells).alias("cells_off"),
        F.sum(reduce(lambda a, b: a + b, [n.cast("long") for n in nulls])).alias("null_off"), most(off).alias("max_abs"), most(rel).alias("max_rel"), F.min(F.when(bad, F.col("dt"))).cast("string").alias("earliest"),
    )


def changed_codes(factors: DataFrame, start: Column, end: Column, eps: float = 1e-9) -> DataFrame:
    """Rows in a window whose factor differs from the one before, looking back over all history."""
    moved = factors.withColumn("before", S.ref("adj_factor"))
    return moved.where(F.col("dt").between(start, end) & (F.abs(F.col("adj_factor") - F.col("before")) > eps))


def holdings_after(holdings: DataFrame, actions: DataFrame, tax_kept: float = 0.8) -> DataFrame:
    """Cash credit, new shares and cost of holdings on an ex-day: cost less the dividend, never below 0, spread over old and new shares."""
    joined = holdings.join(actions, ["code", "ex_day"])
    added = F.round(F.col("shares") * F.col("stock"))
    cost = F.greatest(F.col("cost") - F.col("cash") * tax_kept, F.lit(0.0))
    return joined.select("code", "ex_day", (F.col("shares") * F.col("cash") * tax_kept).alias("credit"), (F.col("shares") + added).alias("shares"), F.try_divide(cost * F.col("shares"), F.col("shares") + added).alias("cost"))


def split_ratio(bars: DataFrame, pre_close: str = "pre_close") -> DataFrame:
    """Bands of the ratio of the close before to the stated previous close: merge, none, cash or split.

    A ratio within half a per cent of a multiple of one half snaps to it.
    """
    ratio = F.try_divide(S.ref("close"), F.col(pre_close))
    out = bars.withColumn("ratio", ratio).where("ratio IS NOT NULL")
    snap = F.round(F.col("ratio") * 2) / 2
    near = F.abs(F.try_divide(F.col("ratio") - snap, snap)) <= 0.005
    r = F.col("ratio")
    kind = F.when((r < 0.99) & F.coalesce(near, F.lit(False)), "merge").when(r < 0.99, "unknown").when(r <= 1.01, "none").when(r < 1.10, "cash").otherwise("split")
    return out.withColumn("kind", kind).withColumn("applied", F.when(F.col("kind").isin("none", "cash", "unknown"), F.lit(1.0)).when(near, snap).otherwise(r))


def scale_off(columns: Sequence[str] = ("open", "high", "low"), share: float = 1e-3, tick: float | None = None) -> Column:
    """Whether a price is scaled otherwise than the close: by more than a share, and, where a tick is given, also moved by more than a tick otherwise."""
    def off(c: str) -> Column:
        raw, front = F.col(c), F.col(f"{c}_front")
        wide = F.abs(F.try_divide(F.try_divide(front, raw), F.try_divide("close_front", "close")) - 1) > share
        if tick is not None:
            wide = wide & (F.abs((raw - front) - (F.col("close") - F.col("close_front"))) > tick)
        return F.coalesce((raw > 0) & wide, F.lit(False))

    return reduce(lambda a, b: a | b, [off(c) for c in columns])


def staged_contract(rows: DataFrame, keys: Sequence[str] = ("code", "dt"), share: float = 1e-3, tick: float | None = None) -> DataFrame:
    """One row on staged bars: missing columns, repeated keys, closes and other prices that are not finite and positive, scales that differ, and the verdict.

    Both closes must be there; other prices may be missing.  Cash dividends
    are taken off prices, so a tick may stand for a scale.
    """
    wanted = [*keys, *[f"{c}{side}" for c in PRICES for side in ("", "_front")]]
    lacking = [c for c in wanted if c not in rows.columns]
    if lacking:
        return rows.agg(F.count("*").alias("n")).select("n", F.lit(",".join(lacking)).alias("missing"), *[F.lit(None).cast("long").alias(c) for c in ("repeated", "bad_close", "bad_value", "scale")], F.lit(False).alias("ok"))
    good = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c)
    bad_close = ~F.coalesce(good("close") & good("close_front"), F.lit(False))
    bad_value = reduce(lambda a, b: a | b, [F.coalesce(~good(f"{c}{side}"), F.lit(False)) for c in PRICES[:3] for side in ("", "_front")])
    per = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(bad_close).alias("_c"), F.count_if(bad_value).alias("_v"), F.count_if(scale_off(share=share, tick=tick)).alias("_s"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = per.agg(total("_n").alias("n"), F.lit("").alias("missing"), total(F.col("_n") - 1).alias("repeated"), total("_c").alias("bad_close"), total("_v").alias("bad_value"), total("_s").alias("scale"))
    return out.withColumn("ok", (F.col("n") > 0) & (F.col("repeated") == 0) & (F.col("bad_close") == 0) & (F.col("bad_value") == 0) & (F.col("scale") == 0))


def post_checks(before: DataFrame, after: DataFrame, staged: DataFrame, calendar: DataFrame, last_minutes: DataFrame, share: float = 1e-3, tick: float = 0.01) -> DataFrame:
    """One row on rewritten bars: counts of what is off after the rewrite, and the verdict.

    Rows lost or gained; staged values not found again; adjusted returns that
    differ from raw ones; rows without the bar of the trade day before (but for
    a code's first day); scales; price relation; closes other than the day's
    last minute's.  ``calendar`` has one row per trade day in ``day``.
    """
    keys = ["code", "dt"]
    days = calendar.select(F.col("day").alias("dt"), F.lag("day").over(Window.partitionBy(F.lit(1)).orderBy("day")).alias("_before"))  # one row per trade day
    rows = after.join(F.broadcast(days), "dt", "left").withColumns({"_last": F.lag("dt").over(Window.partitionBy("code").orderBy("dt")), "chain": F.col("close_front") / S.ref("close_front") - 1, "raw": F.col("close") / S.ref("close") - 1})
    rows = rows.join(staged.select(*keys, F.col("close_front").alias("_staged")), keys, "left").join(last_minutes.select(*keys, F.col("close_front").alias("_minute")), keys, "left")
    far = lambda a, b: F.coalesce(F.abs(F.try_divide(a, b) - 1) > share, F.lit(False))
    out = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("_staged").isNotNull() & ~F.col("_staged").eqNullSafe(F.col("close_front"))).alias("staged_off"),
        F.count_if(F.coalesce(F.abs(F.col("chain") - F.col("raw")) > share, F.lit(False))).alias("chain_off"), F.count_if(F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("_before"))).alias("day_before_missing"),
        F.count_if(scale_off(share=share, tick=tick)).alias("scale_off"), F.count_if(~F.coalesce(bar_relation(suffix="_front"), F.lit(True))).alias("relation_off"), F.count_if(far(F.col("_minute"), F.col("close_front"))).alias("minute_off"),
    )
    due = before.agg(F.count("*").alias("_due"))
    out = out.crossJoin(F.broadcast(due)).withColumn("lost", F.col("_due") - F.col("n")).drop("_due")
    checks = [c for c in out.columns if c not in ("n", "day_before_missing")]
    return out.withColumn("ok", reduce(lambda a, b: a & b, [F.col(c) == 0 for c in checks]))


def sample_days(segmented: DataFrame, ex_days: DataFrame, calendar: DataFrame, least: int = 3) -> DataFrame:
    """(code, segment, dt, kind, enough): days by which a segment is checked: its first, middle and last, and each trade day before an ex-day in it.

    A segment of fewer than ``least`` days is not enough to be checked.
    """
    by = Window.partitionBy("code", "segment")
    placed = segmented.select("code", "segment", "dt").withColumns({"_i": F.row_number().over(by.orderBy("dt")), "_n": F.count("*").over(by)})
    w = Window.partitionBy(F.lit(1)).orderBy("day")
    gaps = calendar.select(F.col("day").alias("_prev"), F.lead("day").over(w).alias("_next")).where("_next IS NOT NULL")  # one row per trade day
    before = gaps.select("_prev", F.explode(F.sequence(F.date_add("_prev", 1), F.col("_next"))).alias("ex_day"))
    marks = ex_days.select("code", "ex_day").distinct().join(F.broadcast(before), "ex_day").select("code", F.col("_prev").alias("dt"), F.lit(True).alias("_ex")).distinct()
    rows = placed.join(marks, ["code", "dt"], "left")
    kind = F.when(F.col("_i") == 1, "head").when(F.col("_i") == F.col("_n"), "tail").when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, "middle").when(F.col("_ex"), "before_ex")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("code", "segment", "dt", "kind", (F.col("_n") >= least).alias("enough"))


def sample_bars(minutes: DataFrame, day: str, clock: str, time: str, continuous: Column, opening: int = 570, least: int = 5) -> DataFrame:
    """(code, day, time, kind, enough): ``least`` bars of a day's continuous sessions at even places, and the opening auction's as an extra that never counts."""
    by = Window.partitionBy("code", day)
    inside = minutes.where(continuous).withColumns({"_i": F.row_number().over(by.orderBy(time)) - 1, "_n": F.count("*").over(by)})
    places = F.transform(F.sequence(F.lit(0), F.lit(least - 1)), lambda q: F.bround(q * (F.col("_n") - 1) / (least - 1)).cast("int"))
    picked = inside.where(F.array_contains(places, F.col("_i").cast("int"))).select("code", day, time, F.lit("even").alias("kind"), (F.col("_n") >= least).alias("enough"))
    extra = minutes.where(F.col(clock) == opening).groupBy("code", day).agg(F.min(time).alias(time))
    return picked.unionByName(extra.select("code", day, time, F.lit("opening").alias("kind"), F.lit(None).cast("boolean").alias("enough")))


def front_rewrite(stored: DataFrame, staged: DataFrame, column: str = "close_front", keys: Sequence[str] = ("code", "dt")) -> tuple[DataFrame, DataFrame]:
    """Stored rows with staged values where there are any, and one row: stored, staged, staged that now have a value, and those still without one."""
    met = staged.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_met"))
    out = stored.join(met, list(keys), "left").withColumn(column, F.coalesce("_new", column))
    report = out.agg(F.count("*").alias("stored"), F.count("_met").alias("staged"), F.count_if(F.col("_met") & F.col(column).isNotNull()).alias("matched"), F.count_if(F.col(column).isNull()).alias("still_null"))
    return out.drop("_new", "_met"), report


def raw_coverage(stored: DataFrame, fresh: DataFrame, column: str = "close", tolerance: float = 1e-6, keys: Sequence[str] = ("code", "dt")) -> DataFrame:
    """Per code: stored rows, those that fresh ones cover, whether all are, and those that disagree."""
    joined = stored.join(fresh.select(*keys, F.col(column).alias("_fresh")), list(keys), "left")
    full = F.when(F.count("_fresh") == F.count("*"), "full").otherwise("partial")
    return joined.groupBy("code").agg(F.count("*").alias("stored"), F.count("_fresh").alias("covered"), full.alias("coverage"), F.count_if(F.abs(F.col("_fresh") - F.col(column)) > tolerance).alias("disagree"))
