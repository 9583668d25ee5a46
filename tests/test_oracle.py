"""Registered queries against their DuckDB oracle (subset at sf0.001; set
BARFLOW_ALL_ORACLES=1 to run every key)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.oracle_check import TABLES, digest, norm

SUBSET = ["src_bars_from_ticks", "src_bars_hourly", "dq_report", "clean_ffill_bfill",
          "clean_outlier_cap", "ta_ema", "ta_macd", "ta_adx", "ta_atr", "ta_mfi", "ta_aroon",
          "rg_vol_percentile", "rg_trend_persistence", "ds_sequences", "ds_walk_forward",
          "ens_weights", "eval_all", "fc_summary", "bt_backtest", "st_bars", "st_latest_quote"]
KEYS = sorted(E.oracle_sql()) if os.environ.get("BARFLOW_ALL_ORACLES") else SUBSET


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF001).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert digest(norm(s)) == digest(norm(d))


def test_every_query_has_a_callable_and_sql_keys_are_queries():
    qs, sq = E.queries(), E.oracle_sql()
    assert set(sq) <= set(qs)
    assert len(qs) >= 90


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "rsi" in df.columns
