"""Cleaning, quality, ensemble and dataset operators on hand-made data."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barflow.operators import clean as cl
from barflow.operators import dataset as ds
from barflow.operators import ensemble as en
from barflow.operators import quality as dq
from barflow.operators.layout import finish
from tests.helpers import bars_frame


def test_dedupe_keeps_latest_arrival_and_fills(spark):
    base = dt.date(2020, 1, 1)
    rows = [("S", base, None, 5.0, 1), ("S", base + dt.timedelta(1), 10.0, None, 2),
            ("S", base + dt.timedelta(1), 11.0, 7.0, 3), ("S", base + dt.timedelta(2), None, 9.0, 4),
            ("S", base + dt.timedelta(3), 13.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, volume double, arrival long")
    df = df.select("symbol", "date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")],
                   "volume", "arrival")
    out = finish(cl.clean_bars(df)).toPandas().sort_values("date")
    assert list(out["close"]) == [11.0, 11.0, 11.0, 13.0]   # leading bfill, middle ffill
    assert list(out["volume"]) == [5.0, 7.0, 9.0, 1.0]
    assert list(out["day_of_week"]) == [2, 3, 4, 5]         # 2020-01-01 is a Wednesday


def test_quality_rules(spark):
    rows = [("Q", 0, 1, 1, 1, 10, 1), ("Q", 1, 1, 1, 1, 20, -1), ("Q", 12, 1, 1, 1, -1, 1)]
    rep = dq.quality_report(bars_frame(spark, rows)).toPandas().iloc[0]
    assert rep["negative_volume"] == 1 and rep["nonpositive_close"] == 1
    assert rep["big_moves"] == 2 and rep["date_gaps"] == 1 and not rep["passed"]


def test_repeated_dates_are_compared_in_arrival_order(spark):
    day = dt.date(2020, 1, 1)
    rows = [("Q", day, 10.0, 1), ("Q", day, 30.0, 3), ("Q", day, 12.0, 2), ("Q", day + dt.timedelta(1), 29.0, 4), ("Q", day + dt.timedelta(12), float("nan"), 5)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, arrival long")
    df = df.select("symbol", "date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"), "arrival")
    for d in (df, df.orderBy(F.desc("arrival")), df.repartition(3)):
        r = dq.quality_report(d).first()
        assert (r.rows, r.big_moves, r.date_gaps, r.max_null_share, r.too_many_nulls) == (5, 1, 1, 0.2, True)  # 10, 12, 30, 29


def test_missing_columns_no_job(spark):
    df = spark.createDataFrame([(1.0,)], "close double")
    assert dq.missing_columns(df) == ["open", "high", "low", "volume"]


def test_weights_sum_to_one_and_inverse_mse(spark):
    p = spark.createDataFrame(
        [("S", dt.date(2020, 1, d), "val", m, 10.0, 10.0 + e) for d in range(1, 5)
         for m, e in (("a", 1.0), ("b", 2.0))],
        "symbol string, date date, split string, model string, y double, yhat double")
    w = en.learn_weights(p).toPandas().set_index("model")
    assert abs(w["weight"].sum() - 1) < 1e-12
    assert abs(w.loc["a", "weight"] / w.loc["b", "weight"] - (4 + 1e-6) / (1 + 1e-6)) < 1e-9


def test_sequences_reference_count(spark):
    rows = [("S", i, 1, 1, 1, float(i), 1) for i in range(100)]
    d = ds.renumber(bars_frame(spark, rows))
    s = ds.sequences(d, ["close"], "close", lookback=10, horizon=3, drop_last=True).toPandas()
    assert len(s) == 100 - 3 - 10                       # n - h - lookback (reference)
    first = s.sort_values("idx").iloc[0]
    assert [v[0] for v in first["window"]] == list(np.arange(10.0)) and first["label"] == 12.0
    s2 = ds.sequences(d, ["close"], "close", lookback=10, horizon=3).count()
    assert s2 == 100 - 3 - 10 + 1
