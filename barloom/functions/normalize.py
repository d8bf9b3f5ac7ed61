"""Scalar functions that bring codes, times, units and labels of many sources to one form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pit import FREQUENCIES

ZONE = "Asia/Shanghai"


def map_columns(df: DataFrame, renames: Mapping[str, str], copies: Mapping[str, str] | None = None) -> DataFrame:
    """Copies (target: source) first where the target is absent, then renames those present; a repeated name is an error."""
    for target, source in (copies or {}).items():
        if target not in df.columns and source in df.columns:
            df = df.withColumn(target, F.col(source))
    names = [renames.get(c, c) for c in df.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"a column name occurs twice: {names}")
    return df.toDF(*names)


def normalize_code(code: Column, kind: str = "tushare_to_raw") -> Column:
    """Six digits of a code in a source's form; otherwise the first six digits, or null."""
    if kind == "identity":
        return code
    forms = {"tushare_to_raw": r"^(\d{6})\.(?:SH|SZ|BJ|SI)$", "baostock_to_raw": r"^(?:sh|sz|bj)\.(\d{6})$"}
    exact, any_ = F.regexp_extract(code, forms[kind], 1), F.regexp_extract(code, r"(\d{6})", 1)
    return F.when(exact != "", exact).when(any_ != "", any_)


def exchange_suffix(code: Column, asset: str = "stock") -> Column:
    """The exchange of a six-digit code by its first digit."""
    first = F.substring(code, 1, 1)
    if asset == "fund":
        return F.when(first == "5", "SH").when(first == "1", "SZ").otherwise("BJ")
    return F.when(first == "6", "SH").when(first.isin("0", "3"), "SZ").otherwise("BJ")


def to_suffixed(code: Column, asset: str = "stock") -> Column:
    """Code with exchange; ``.SS`` becomes ``.SH`` and an unknown suffix is an error when the row is read."""
    suffix = F.upper(F.regexp_extract(code, r"\.(\w+)$", 1))
    raw = F.regexp_extract(code, r"^(\d{6})", 1)
    known = F.when(suffix == "SS", "SH").when(suffix.isin("SH", "SZ", "BJ"), suffix)
    error = F.raise_error(F.concat(F.lit("unknown exchange: "), suffix)).cast("string")
    return F.concat(raw, F.lit("."), F.when(suffix == "", exchange_suffix(raw, asset)).when(known.isNotNull(), known).otherwise(error))


def to_ms(value: Column) -> Column:
    """Epoch milliseconds of milliseconds, seconds, YYYYMMDD numbers at Shanghai midnight, or day texts; else null."""
    n = F.expr("try_cast({} AS BIGINT)".format("v")) if isinstance(value, str) else value.try_cast("bigint")
    day = F.try_to_date(n.cast("string"), "yyyyMMdd")
    midnight = lambda d: F.unix_millis(F.to_utc_timestamp(d.cast("timestamp_ntz").cast("timestamp"), ZONE))
    text = F.try_to_date(value.cast("string"), "yyyy-MM-dd")
    number = F.when(n > 10**12, n).when(n > 10**9, n * 1000).when(n.between(19000101, 99991231), midnight(day)).otherwise(n)
    return F.when(n.isNotNull(), number).otherwise(midnight(text))


def ms_to_day(ms: Column) -> Column:
    """The Shanghai calendar day of epoch milliseconds, as text."""
    return F.date_format(F.timestamp_millis(ms + 8 * 3600 * 1000), "yyyy-MM-dd")


def cloud_to_ms(value: Column, minute: bool) -> Column:
    """UTC milliseconds of Shanghai wall-clock milliseconds (minute bars) or of YYYYMMDD numbers."""
    return value - 8 * 3600 * 1000 if minute else to_ms(value)


def convert_unit(value: Column, factor: float) -> Column:
    return value.try_cast("double") * F.lit(float(factor))


def tick_rounded(bars: DataFrame, digits: int = 2) -> DataFrame:
    """Prices to the tick's digits, volume to none and amount to two, half away from zero."""
    places = {c: digits for c in ("open", "high", "low", "close", "pre_close")} | {"volume": 0, "amount": 2, "pct_chg": 4}
    return bars.withColumns({c: F.round(c, d) for c, d in places.items() if c in bars.columns})


def suspended(volume: Column) -> Column:
    return F.when(volume == 0, 1).otherwise(0)


def pct_change(official: Column, derived: Column, previous: Column) -> Column:
    """The official change; one above 200 gives way to a derived one below 30, else to the previous, else null."""
    extreme = F.abs(official) > 200
    return F.when(official.isNull(), derived).when(~extreme, official).when(F.abs(derived) < 30, derived).otherwise(previous)


def with_fixed(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in values.items() if c not in df.columns})


def to_boolean(value: Column) -> Column:
    t = F.lower(F.trim(value.cast("string")))
    return F.when(t.isin("1", "true", "t", "yes", "y", "1.0"), True).when(t.isin("0", "false", "f", "no", "n", "0.0"), False)


#: Kinds of securities by the first digits of a six-digit code, in order.  Fixed values.
KINDS = (("index", r"^(399|899)"), ("bse", r"^(4|8|920)"), ("star", r"^(688|689)"), ("chinext", r"^(300|301)"), ("bond", r"^(110|111|113|118|123|127|128)"), ("etf", r"^(15|51|56|58)"), ("main", r"^(60|000|001|002|003)"))


def classify(code: Column, suffix: Column | None = None) -> Column:
    out = F.lit("unknown")
    for kind, pattern in reversed(KINDS):
        out = F.when(code.rlike(pattern), kind).otherwise(out)
    return out if suffix is None else F.when(code.startswith("000") & (suffix == "SH"), "index").otherwise(out)


def is_st_name(name: Column) -> Column:
    n = F.upper(F.trim(name))
    return n.startswith("ST") | n.startswith("*ST") | n.startswith("S*ST") | n.startswith("SST")


def limit_share(kind: Column, st: Column) -> Column:
    return F.when(st, 0.05).when(kind.isin("star", "chinext"), 0.20).when(kind == "bse", 0.30).otherwise(0.10)


def limit_state(close: Column, pre_close: Column, share: Column, tolerance: float = 0.002) -> Column:
    """1 at the upper, -1 at the lower limit, else 0; missing prices give 0."""
    move = F.try_divide(close - pre_close, pre_close)
    return F.when(move >= share - tolerance, 1).when(move <= -(share - tolerance), -1).otherwise(0)


def blocked(state: Column, action: Column) -> Column:
    """A buy at the upper limit, or a sell at the lower one."""
    return ((action == "buy") & (state == 1)) | ((action == "sell") & (state == -1))


def halted(flag: Column, volume: Column) -> Column:
    return F.coalesce((flag == 1) | (volume == 0), F.lit(False))


def lots(shares: Column, lot: int = 100) -> Column:
    return F.greatest(F.floor(shares / lot) * lot, F.lit(0))


def frequency(label: Column) -> Column:
    """The stored label; an unknown one is an error when the row is read."""
    known = F.create_map(*[F.lit(x) for kv in FREQUENCIES.items() for x in kv])
    found = F.try_element_at(known, F.lower(label))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown frequency: "), label)).cast("string"))


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule whose pattern occurs."""
    out = F.lit(otherwise)
    for name, pattern in reversed(list(rules)):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def name_status(name: Column) -> Column:
    n = F.upper(F.regexp_replace(name, "\x00", ""))
    return F.when(n.isNull(), "UNKNOWN").when(n.contains("DELIST"), "DELISTING").when(n.contains("*ST"), "*ST").when(n.contains("ST"), "ST").otherwise("NORMAL")


def with_aliases(bars: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """The same value under a second name (alias: column)."""
    return bars.withColumns({a: F.col(c) for a, c in aliases.items()})


def trend(bars: DataFrame) -> DataFrame:
    return bars.select("code", "dt", F.col("open").alias("price"), F.try_divide("amount", "volume").alias("average"))
