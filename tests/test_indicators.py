"""Indicators against brute-force loops and hand-made series."""

import numpy as np
import pandas as pd

from barflow.operators.layout import finish, layout_series
from barflow.operators.regime import regime_features
from barflow.operators.technical import technical_features
from barflow.plans.queries import daily_bars
from tests.conftest import SF01
from tests.helpers import atr_loop, bars_frame, ema_loop, pct_rank_last, rsi_loop


def feats(df):
    d = layout_series(df)
    d = regime_features(technical_features(d))
    return finish(d).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)


def test_smoothers_and_ranks_match_loops(spark):
    f = feats(daily_bars(spark, SF01))
    for _, g in f.groupby("symbol"):
        c, h, lo = g["close"].values, g["high"].values, g["low"].values
        np.testing.assert_allclose(g["ema_12"], ema_loop(c, 2 / 13, warm=11), rtol=1e-10)
        np.testing.assert_allclose(g["ema_26"], ema_loop(c, 2 / 27, warm=25), rtol=1e-10)
        np.testing.assert_allclose(g["rsi"], rsi_loop(c), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(g["atr"], atr_loop(h, lo, c), rtol=1e-10)
        macd = ema_loop(c, 2 / 13, warm=11) - ema_loop(c, 2 / 27, warm=25)
        sig = ema_loop(np.nan_to_num(macd), 0.2, start=25, warm=8)
        np.testing.assert_allclose(g["macd_signal"], sig, rtol=1e-9, atol=1e-9)
        vp = pct_rank_last(g["volume"].values, 60, 20)
        np.testing.assert_allclose(g["volume_percentile"], vp, rtol=1e-12)
        run = (g["trend_regime"] != g["trend_regime"].shift()).cumsum()
        pers = g.groupby(run).cumcount() + 1
        assert (g["trend_persistence"].values == pers.values).all()


def test_flat_series(spark):
    rows = [("F", i, 10, 10, 10, 10, 5) for i in range(300)]
    f = feats(bars_frame(spark, rows))
    assert (f["rsi"].dropna() == 100).all()
    assert f["close_position"].isna().all()          # 0/0 -> NULL
    assert (f["high_low_range"] == 0).all()
    assert (f["is_doji"] == 0).all()                  # 0 < 0 is false
    assert (f["obv"].values == np.arange(1, 301) * 5).all()  # ties add +V


def test_ramps(spark):
    up = [("U", i, 10 + i, 11 + i, 9 + i, 10 + i, 1) for i in range(60)]
    dn = [("D", i, 100 - i, 101 - i, 99 - i, 100 - i, 1) for i in range(60)]
    f = feats(bars_frame(spark, up + dn))
    u, d = f[f.symbol == "U"], f[f.symbol == "D"]
    assert (u["rsi"].dropna() == 100).all() and (d["rsi"].dropna() == 0).all()
    assert (u["aroon_up"].iloc[25:] == 100).all() and (d["aroon_down"].iloc[25:] == 100).all()
    assert (u["gap_up"].sum() == 0)


def test_one_row_and_zero_volume(spark):
    f = feats(bars_frame(spark, [("O", 0, 1, 2, 0.5, 1.5, 0)]))
    assert len(f) == 1
    r = f.iloc[0]
    assert r["gap_up"] == 0 and r["sma_10_20_cross"] == 0 and r["volume_spike"] == 0
    assert pd.isna(r["vwap"]) and pd.isna(r["volume_ratio"]) and pd.isna(r["sma_10"])


def test_symbols_are_isolated(spark):
    a = [("A", i, 10 + (i % 7), 12 + (i % 5), 8, 10 + (i % 3), 1 + i) for i in range(120)]
    b = [("B", i, 50 - (i % 4), 55, 45 - (i % 6), 50 + (i % 9), 3) for i in range(90)]
    alone = feats(bars_frame(spark, a))
    both = feats(bars_frame(spark, b + a))
    pd.testing.assert_frame_equal(alone.reset_index(drop=True),
                                  both[both.symbol == "A"].reset_index(drop=True))


def test_no_look_ahead(spark):
    bars = daily_bars(spark, SF01)
    cut = bars.agg({"date": "max"}).first()[0]
    import datetime as dt
    full = feats(bars)
    part = feats(bars.where(bars.date <= cut - dt.timedelta(days=200)))
    m = full.merge(part, on=["symbol", "date"], suffixes=("", "_p"))
    for c in ["ema_26", "rsi", "adx", "obv", "volatility_percentile", "trend_persistence"]:
        np.testing.assert_allclose(m[c].astype(float), m[c + "_p"].astype(float), rtol=1e-12)
