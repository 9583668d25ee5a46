"""Constant-cost windows, two-level carries, the bracketed median and missing values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions.scan import apply_smoothers, ema
from barflow.functions.sliding import Trailing, with_trailing
from barflow.operators import clean as cl
from barflow.operators.layout import Layout, finish, layout_series, with_running
from barflow.operators.technical import TechnicalConfig, technical_columns, technical_features
from barflow.sources.bars import bars_from_ticks, no_nan, select_bars
from tests.helpers import bars_frame, ema_loop

AGGS = {"sum": np.sum, "avg": np.mean, "min": np.min, "max": np.max, "stddev_pop": np.std, "stddev_samp": lambda v: np.std(v, ddof=1)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def series(spark, n, seed=0, nulls=True):
    r = np.random.default_rng(seed)
    v = [float(x) for x in r.lognormal(3, 1, n)]
    if nulls:
        for i in r.integers(0, n, n // 40):
            v[i] = None
    rows = [(i, "S", v[i]) for i in range(n)] + [(i, "flat", 0.1) for i in range(80)]
    d = spark.createDataFrame(rows, "t int, symbol string, x double").withColumn("date", F.date_add(F.lit("2000-01-01"), F.col("t")))
    return d.drop("t"), v


@pytest.mark.parametrize("layout", [Layout(), Layout(256, 128, 64)])
def test_windows_equal_loops_in_any_layout(spark, layout):
    d, v = series(spark, 700)
    lengths = (1, 2, 3, 4, 14, 16, 20, 50, 63, 64, 100)
    windows = [Trailing(f"{a}_{n}", a, "x", n) for a in AGGS for n in lengths]
    out = finish(with_trailing(layout_series(d, layout=layout), windows)).toPandas().sort_values(["symbol", "date"])
    assert set(out.columns) == {"symbol", "date", "x", *[w.name for w in windows]}
    got = out[out.symbol == "S"]
    for w in windows:
        exp = []
        for i in range(len(v)):
            own = v[max(0, i - w.n + 1):i + 1]
            whole = len(own) == w.n and None not in own and not (w.agg == "stddev_samp" and w.n == 1)
            exp.append(AGGS[w.agg](own) if whole else np.nan)
        np.testing.assert_allclose(got[w.name].to_numpy(dtype=float), np.array(exp, dtype=float), rtol=1e-12, atol=1e-12)
    flat = out[out.symbol == "flat"]
    for n in (2, 4, 16, 64):
        assert (flat[f"stddev_pop_{n}"].dropna() == 0).all() and (flat[f"avg_{n}"].dropna() == 0.1).all()


def test_no_frame_grows_with_the_window(spark):
    d, _ = series(spark, 50)
    d = layout_series(d, layout=Layout(4096, 2048, 512, materialize=False))
    plan = plan_of(with_trailing(d, [Trailing("m", "avg", "x", 2000), Trailing("s", "stddev_pop", "x", 1999)]))
    assert "specifiedwindowframe(RowFrame, -1999" not in plan and "specifiedwindowframe(RowFrame, -1024" in plan  # a lag
    assert plan.count("Window [") <= 14


def test_windows_share_few_steps(spark):
    d, _ = series(spark, 50)
    d = layout_series(d, layout=Layout(4096, 2048, 512, materialize=False))
    plain = plan_of(d).count("Window [")
    assert plan_of(with_trailing(d, [Trailing("m", "avg", "x", 2000)])).count("Window [") - plain <= 5


def test_wide_rows_are_not_written_between_passes(spark, monkeypatch):
    from barflow.operators import layout as lay
    cut, tables = lay.cut_lineage, {}
    monkeypatch.setattr(lay, "cut_lineage", lambda df, name: tables.setdefault(name, cut(df, name)))
    d, v = series(spark, 3000, nulls=False)
    layout = Layout(1024, 128, 64)
    d = layout_series(d, layout=layout).withColumn("wide", F.col("x") * 2)
    d = with_running(apply_smoothers(d, [ema("e", "x", 12)], layout=layout), {"total": ("sum", F.col("x"))}, layout)
    got = finish(d).where("symbol = 'S'").orderBy("date").toPandas()
    np.testing.assert_allclose(got["e"], ema_loop(np.array(v), 2 / 13, warm=11), rtol=1e-10)
    np.testing.assert_allclose(got["total"], np.cumsum(v), rtol=1e-12)
    assert set(tables) == {"series", "numbered", "scan", "running"}
    assert not any("wide" in t.columns for t in tables.values())
    assert max(tables[n].count() for n in ("scan", "running")) <= 4  # a row a block


def test_no_window_holds_a_whole_symbol(spark, monkeypatch):
    from barflow.functions import scan
    monkeypatch.setattr(scan, "GROUP_ENDS", 8)
    d, v = series(spark, 6000, nulls=False)
    layout = Layout(1024, 128, 64)
    out = finish(apply_smoothers(layout_series(d, layout=layout), [ema("e", "x", 12), ema("slow", "x", 300)], layout=layout))
    got = out.where("symbol = 'S'").orderBy("date").toPandas()
    np.testing.assert_allclose(got["e"], ema_loop(np.array(v), 2 / 13, warm=11), rtol=1e-10)
    np.testing.assert_allclose(got["slow"], ema_loop(np.array(v), 2 / 301, warm=299), rtol=1e-10)
    flat = Layout(1024, 128, 64, materialize=False)
    laid = d.select("symbol", "date", "x", F.lit(0).cast("long").alias("rn"), F.lit(1).cast("long").alias("n_rows"))
    plan = plan_of(apply_smoothers(layout_series(laid, layout=flat), [ema("e", "x", 12)], layout=flat))
    for line in plan.splitlines():
        if "windowspecdefinition(" in line:
            spec = line.split("windowspecdefinition(")[1]
            assert spec.split(",")[1].strip().startswith(("_g#", "blk#", "cast(")), line


def test_other_periods_resolve(spark):
    cfg = TechnicalConfig(sma_periods=(5, 8), ema_periods=(3,), roc_periods=(2,), volatility_windows=(4,), volume_window=6, momentum_periods=(1,),
                          price_to_sma=(8, 50), sma_crosses=((5, 8), (8, 20)))
    d = layout_series(bars_frame(spark, [("S", i, 10 + i % 3, 12 + i % 3, 9, 10 + i % 4, 5 + i) for i in range(40)]))
    out = finish(technical_features(d, cfg))
    names = technical_columns(cfg)
    assert set(names) <= set(out.columns) and {"price_to_sma8", "sma_5_8_cross", "volume_sma_6", "ema_3"} <= set(names)
    assert "price_to_sma50" not in names and len(names) == len(set(names))
    assert technical_columns()[:3] == ["sma_10", "sma_20", "sma_50"] and len(technical_columns()) == 58


def median_of(v):
    v = sorted(x for x in v if x is not None and not math.isnan(x))
    a, b = v[(len(v) - 1) // 2], v[len(v) // 2]
    return a if a == b else (a + b) / 2


@pytest.mark.parametrize(("accuracy", "grid"), [(10_000, 200), (50, 10)])
def test_median_ends_on_any_values(spark, accuracy, grid):
    r = np.random.default_rng(3)
    inf, nan = float("inf"), float("nan")
    groups = {"A": [float(v) for v in r.integers(0, 40, 201)], "B": [float(v) for v in r.lognormal(0, 4, 5000)],
              "C": [5.0] * 30, "D": [None] * 3 + [7.5], "F": [-1.0, 2.0], "G": [nan, 1.0, inf, -inf, 3.0, nan], "H": [inf, inf, 1.0],
              "I": [-inf, 1.0], "J": [float(v) for v in r.normal(0, 1, 4000)] + [inf] * 10 + [nan] * 300 + [0.0] * 4000}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("E", None), ("K", nan), (None, 1.0)]
    d = spark.createDataFrame(rows, "symbol string, volume double").repartition(7)
    got = {x.symbol: x["median"] for x in cl.exact_median(d, "volume", accuracy=accuracy, grid=grid).collect()}
    assert got == pytest.approx({k: median_of(v) for k, v in groups.items()})


def test_median_of_many_rows_takes_three_passes(spark):
    n = 200_001
    d = spark.range(n).select(F.lit("S").alias("symbol"), F.when(F.col("id") % 1000 == 5, float("nan")).when(F.col("id") % 1000 == 6, float("inf"))
                              .when(F.col("id") % 1000 == 7, float("-inf")).otherwise((F.col("id") * 7919 % n).cast("double")).alias("volume"))
    exp = median_of([r[0] for r in d.select("volume").collect()])
    out = cl.exact_median(d, "volume")
    assert out.first()["median"] == exp
    with pytest.raises(ValueError):
        cl.exact_median(d, "volume", accuracy=100, grid=99)


def test_nan_is_missing_at_the_sources(spark):
    nan = float("nan")
    bars = spark.createDataFrame([("S", "2020-01-01", 1.0, nan, 1.0, nan, nan)], "symbol string, date string, open double, high double, low double, close double, volume double")
    r = select_bars(bars.withColumn("date", F.to_date("date"))).first()
    assert (r.open, r.high, r.close, r.volume) == (1.0, None, None, None)
    ticks = spark.createDataFrame([("S", 1, nan, 2.0), ("S", 2, 5.0, nan), ("S", 3, 4.0, 1.0)], "symbol string, seq long, price double, size double")
    b = bars_from_ticks(ticks.withColumn("ts", F.lit("2020-01-01 10:00:00").cast("timestamp_ntz"))).first()
    assert (b.high, b.low, b.volume) == (5.0, 4.0, 3.0)
    odd = spark.createDataFrame([(nan, float("inf"), 1)], "`a.b` double, c float, d int")
    assert tuple(no_nan(odd).first()) == (None, float("inf"), 1)
