"""Series layout: row numbering, block invariance, running carries."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.operators.layout import Layout, finish, layout_series, number_rows, with_running
from barflow.operators.regime import regime_features
from barflow.operators.technical import technical_features
from barflow.plans.queries import daily_bars
from tests.conftest import SF001, SF01

SMALL = Layout(block_rows=2048, halo_rows=1536, sub_rows=512)


def test_number_rows_matches_row_number(spark):
    bars = daily_bars(spark, SF001)
    a = number_rows(bars).select("symbol", "date", "rn")
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars.select("symbol", "date", (F.row_number().over(w) - 1).alias("rn"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_running_sum_and_last_across_tiny_blocks(spark):
    bars = daily_bars(spark, SF001)
    tiny = Layout(block_rows=64, halo_rows=32, sub_rows=16)
    d = layout_series(bars, layout=tiny)
    odd = F.when(F.col("rn") % 3 == 0, F.col("close"))
    d = with_running(d, {"cum": ("sum", F.col("volume")), "mx": ("max", F.col("rn")),
                         "ff": ("last", odd)}, tiny)
    d = with_running(d, {"ff_exact": ("last", odd)}, tiny, halo_exact=True)
    got = finish(d, keep_rn=True).toPandas().sort_values(["symbol", "rn"])
    for _, g in got.groupby("symbol"):
        assert np.allclose(g["cum"].values, g["volume"].cumsum().values)
        assert (g["mx"].values == g["rn"].values).all()
        ref = g["close"].where(g["rn"] % 3 == 0).ffill().values
        assert np.allclose(g["ff"].values, ref, equal_nan=True)
        assert np.allclose(g["ff_exact"].values, ref, equal_nan=True)


def test_features_do_not_depend_on_block_size(spark):
    bars = daily_bars(spark, SF01)

    def run(layout):
        d = layout_series(bars, layout=layout)
        d = regime_features(technical_features(d, layout=layout), layout=layout)
        return finish(d).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)

    a, b = run(Layout()), run(SMALL)
    for c in a.columns:
        if c in ("symbol", "date"):
            continue
        x, y = a[c].astype(float).values, b[c].astype(float).values
        assert (np.isnan(x) == np.isnan(y)).all(), c
        m = ~np.isnan(x)
        assert np.allclose(x[m], y[m], rtol=1e-12, atol=1e-9), c


def plan_of(df):
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_feature_plans_stay_flat(spark):
    d = layout_series(daily_bars(spark, SF001))
    plan = plan_of(finish(regime_features(technical_features(d))))
    # Every second pass reads written rows, so the ticks are gone from the plan
    # and exchanges do not multiply.
    assert "l_shipdate" not in plan
    assert plan.count("Exchange hashpartitioning") <= 6


def test_query_plans_stay_flat(spark):
    import __spark_entry__ as E
    for name, most in (("ds_sequences", 10), ("clean_outlier_cap", 10), ("fc_recommendation", 20), ("eval_all", 10)):
        plan = plan_of(E.queries()[name](spark, SF001))
        assert plan.count("Exchange hashpartitioning") <= most, name
        assert "l_shipdate" not in plan and "o_orderdate" not in plan, name


def naive_rsi(close, n=14):
    up = dn = None
    out = []
    for i, c in enumerate(close):
        step = c - close[i - 1] if i else 0.0
        u, v = max(step, 0.0), max(-step, 0.0)
        up, dn = (u, v) if up is None else (up + (u - up) / n, dn + (v - dn) / n)
        out.append(None if i < n - 1 else 100.0 if dn == 0 else 100 - 100 / (1 + up / dn))
    return out


def series(spark, close, start="2000-01-01"):
    rows = [("A", i, float(c)) for i, c in enumerate(close)]
    d = spark.createDataFrame(rows, "symbol string, i int, close double")
    return d.select("symbol", F.date_add(F.lit(start).cast("date"), F.col("i")).alias("date"), F.col("close").alias("open"),
                    (F.col("close") + 1).alias("high"), (F.col("close") - 1).alias("low"), "close",
                    F.lit(10.0).alias("volume"))


def test_halted_symbol_keeps_its_rsi_across_sub_blocks_and_blocks(spark):
    r = np.random.default_rng(0)
    close = np.concatenate([100 + r.normal(size=100).cumsum(), np.zeros(4000)])
    close[100:] = close[99]
    exp = naive_rsi(close)
    for layout in (Layout(), SMALL):
        d = technical_features(layout_series(series(spark, close), layout=layout), layout=layout)
        got = [x.rsi for x in finish(d).orderBy("date").select("rsi").collect()]
        assert np.allclose(np.array(got[13:], float), np.array(exp[13:], float), rtol=1e-9)
        adx = [x.adx for x in finish(d).orderBy("date").select("adx").collect()]
        assert adx[-1] > 1 and len(set(np.round(adx[3000:], 9))) > 0


def test_long_periods_need_a_large_halo(spark):
    from barflow.operators.technical import TechnicalConfig, technical_history
    import pandas as pd
    import pytest
    cfg = TechnicalConfig(sma_periods=(10, 20, 50, 200, 2000), ema_periods=(12, 26, 200), groups=("moving_averages",))
    r = np.random.default_rng(1)
    close = 100 + r.normal(size=9000).cumsum()
    bars = series(spark, close)
    with pytest.raises(ValueError, match="halo"):
        technical_features(layout_series(bars), cfg)
    layout = SMALL.covers(technical_history(cfg))
    d = finish(technical_features(layout_series(bars, layout=layout), cfg, layout)).orderBy("date").toPandas()
    c = pd.Series(close)
    assert np.allclose(d["sma_2000"].values, c.rolling(2000).mean().values, equal_nan=True)
    assert np.allclose(d["ema_200"].values, c.ewm(span=200, adjust=False, min_periods=200).mean().values, equal_nan=True, rtol=1e-12)


def test_written_tables_are_released(spark):
    import os
    from barflow.operators.store import generate_features
    from barflow.session import ensure_checkpoint_dir
    from barflow.sources.store import release
    release(spark)
    folder = ensure_checkpoint_dir(spark).replace("file:", "") + "/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    n = generate_features(daily_bars(spark, SF001)).count()
    assert set(os.listdir(folder)) - before
    assert n > 0 and release(spark) > 0
    assert set(os.listdir(folder)) <= before


def test_a_cluster_needs_a_shared_folder():
    import pytest
    from barflow.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
