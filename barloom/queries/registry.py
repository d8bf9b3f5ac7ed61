"""Registered queries and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The order along which series run, in oracle SQL.
W = "PARTITION BY code ORDER BY dt"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name, with its oracle."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def off_tie(digits: int) -> float:
    """A shift that moves exact binary ties (as in 1/32) off the rounding boundary, where engines differ."""
    return 0.0317263547 * 10.0**-digits


def rnd(value: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(off_tie(digits)), digits)


def rsql(value: str, digits: int = 6) -> str:
    return f"round(({value}) + {off_tie(digits)!r}::DOUBLE, {digits})"


def shown(df: DataFrame, *columns: str, digits: int = 6, keys: tuple[str, ...] = ("code", "dt")) -> DataFrame:
    """Keys as text, and columns with doubles rounded."""
    kinds = dict(df.dtypes)
    own = [F.col(k).cast("string").alias(k) for k in keys]
    return df.select(*own, *[rnd(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


def shown_sql(source: str, *columns: str, digits: int = 6, keys: tuple[str, ...] = ("code", "dt")) -> str:
    """The same in SQL; a column is rounded unless it is named with a leading ``=``."""
    own = [f"{k}::VARCHAR AS {k}" for k in keys]
    return f"SELECT {', '.join([*own, *[c[1:] if c[0] == '=' else f'{rsql(c, digits)} AS {c}' for c in columns]])} FROM {source}"


def roll(agg: str, x: str, n: int) -> str:
    over = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg}({x}) {over} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def steps(source: str, *stages: dict[str, str]) -> dict[str, str]:
    """CTEs s1, s2, ...: columns added step by step."""
    out, last = {}, source
    for i, stage in enumerate(stages, 1):
        out[f"s{i}"] = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {last}"
        last = f"s{i}"
    return out


def recursion(init: dict[str, str], step: dict[str, str], source: str = "bars", lags: str = "") -> dict[str, str]:
    """CTEs b (rows numbered as rn) and r (the recursion along rn)."""
    return {
        "b": f"SELECT *, row_number() OVER ({W}) AS rn{lags} FROM {source}",
        "r": f"SELECT code, dt, rn, {', '.join(f'{e} AS {n}' for n, e in init.items())} FROM b WHERE rn = 1 UNION ALL SELECT b.code, b.dt, b.rn, {', '.join(step.values())} FROM r JOIN b ON b.code = r.code AND b.rn = r.rn + 1",
    }
