"""Brute-force references (plain loops) and small frame builders for tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd


def bars_frame(spark, rows):
    """rows: (symbol, day_offset, open, high, low, close, volume)."""
    base = dt.date(2020, 1, 1)
    data = [(s, base + dt.timedelta(days=int(d)), float(o), float(h), float(lo), float(c), float(v))
            for s, d, o, h, lo, c, v in rows]
    return spark.createDataFrame(data, "symbol string, date date, open double, high double, low double, "
                                       "close double, volume double")


def ema_loop(x, alpha, start=0, seed=None, warm=0):
    y = np.full(len(x), np.nan)
    if len(x) <= start:
        return y
    y[start] = x[start] if seed is None else seed
    for i in range(start + 1, len(x)):
        y[i] = (1 - alpha) * y[i - 1] + alpha * x[i]
    y[:start + warm] = np.nan
    return y


def rsi_loop(c, n=14):
    d = np.diff(c, prepend=np.nan)
    up = np.where(d > 0, d, 0.0)
    dn = np.where(d < 0, -d, 0.0)
    eu, ed = ema_loop(up, 1 / n, warm=n - 1), ema_loop(dn, 1 / n, warm=n - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(ed == 0, 100.0, 100 - 100 / (1 + eu / ed))
    r[np.isnan(ed)] = np.nan
    return r


def atr_loop(h, lo, c, n=14):
    tr = np.empty(len(c))
    tr[0] = h[0] - lo[0]
    for i in range(1, len(c)):
        tr[i] = max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1]))
    atr = np.zeros(len(c))
    if len(c) >= n:
        atr[n - 1] = tr[:n].mean()
        for i in range(n, len(c)):
            atr[i] = (atr[i - 1] * (n - 1) + tr[i]) / n
    return atr


def pct_rank_last(x, n, minp):
    out = np.full(len(x), np.nan)
    for i in range(len(x)):
        w = pd.Series(x[max(0, i - n + 1):i + 1])
        if w.notna().sum() >= minp and not np.isnan(x[i]):
            out[i] = w.rank(pct=True).iloc[-1]
    return out
