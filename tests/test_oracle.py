"""Registered queries against their DuckDB twins (the driver's gate), on sf0.001.

A representative set runs by default; ORACLE_ALL=1 runs every query with a twin.
"""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from comparo.sources.tables import TABLES
from tests.conftest import SF001

DEFAULT = ["baseline_error_by_month", "baseline_shrunk", "baseline_levels_coalesce", "baseline_lag_row_365d",
           "split_70_10_20", "te_ordered", "te_time_series", "metrics_by_split", "leakage_audit",
           "subsets_1_to_4", "score_new_listings", "simpson_table", "money_parse",
           "winsorized", "baseline_vs_naive", "baseline_rows_30"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("ORACLE_ALL") else DEFAULT


def _canon(df):
    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "isoformat"):  # DuckDB hands DATE back as a pandas Timestamp
            return str(pd.Timestamp(v).date())
        return v
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.to_dict("records")), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    sp = E.queries()[name](spark, SF001).toPandas()
    du = con.execute(E.oracle_sql()[name]).df()
    assert _canon(sp) == _canon(du)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "mae" in df.columns


def test_catalogue_imports_without_spark():
    """queries()/oracle_sql() must be callable before any SparkContext exists."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; q = E.queries(); o = E.oracle_sql(); print(len(q), len(o))"
    r = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]
