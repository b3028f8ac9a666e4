"""A quick subset of the driver's correctness gate at sf0.001: Spark result
vs the DuckDB statement from ``oracle_sql()``."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
KEYS = ["ohlcv_bars", "rolling_vol", "macd", "psar", "swing_labels", "structure_signals",
        "prediction_outcomes", "ffill", "roc_auc", "stream_bars"]


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")
@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF).toPandas()
    exp = con.execute(E.oracle_sql()[key]).df()
    assert rows(got) == rows(exp)


def test_every_query_has_a_callable_and_sql_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
