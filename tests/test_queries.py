"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom.queries import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and np.isnan(x):
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return f"b{bool(x)}"
        if isinstance(x, (int, float, np.integer, np.floating)):
            return f"n{round(float(x), 6) + 0.0}"
        return f"s{x}"

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        due = duck.execute(ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(due.columns)
        assert normal(got) == normal(due)
    else:
        assert len(got)


def test_entry_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['barloom.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert len(q) > 300 and not [k for k in q if k.startswith('op')]"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=300).returncode == 0
