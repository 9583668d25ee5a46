"""Technical indicators over laid-out bars: 58 columns in six groups.

Input: the block layout of :mod:`barflow.operators.layout` with
``symbol, date, open, high, low, close, volume`` (plus ``returns`` if the
cleaner ran). Output: the same rows with the indicator columns. Window
expressions that read another window column run in a later ``select``;
everything shares one partitioning and ordering, so the whole group plans
as stacked ``Window`` nodes over one sort.

Semantics follow the pandas reference: rolling windows need all ``n`` values,
flags are 0 (never NULL) during warm-up, and ``x / 0`` is NULL (the reference
gives +-inf; documented deviation). ADX is Wilder's textbook definition with
a NULL warm-up (documented deviation).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.frames import KEY, div, flag, lag, trailing
from barflow.functions.scan import Smoother, apply_smoothers, ema, wilder_mean
from barflow.functions.sliding import Trailing, with_trailing
from barflow.operators.layout import DEFAULT_LAYOUT, Layout, with_running

# --- fixed values (indicator parameters and thresholds of the reference) -----
# Moving averages: SMA 10, 20, 50, 200; EMA 12, 26.
# RSI period 14; oversold below 30, overbought above 70.
# MACD fast 12, slow 26, signal 9.
# Stochastic oscillator window 14, signal 3.
# Rate of change 10 and 20; momentum 5, 10 and 20.
# Bollinger bands 20 periods, 2 standard deviations (population).
# ATR period 14; historical volatility windows 10, 20, 30.
# Volume average 20; volume spike when volume ratio > 2.0.
# Money flow index 14.
# Doji when body < 0.1 * high-low range.
# ADX period 14; strong trend above 25, weak trend below 20.
# Aroon window 25.


@dataclass(frozen=True)
class TechnicalConfig:
    sma_periods: tuple[int, ...] = (10, 20, 50, 200)
    #: Periods compared with the price, and pairs compared with each other, where the averages are made.
    price_to_sma: tuple[int, ...] = (20, 50)
    sma_crosses: tuple[tuple[int, int], ...] = ((10, 20), (20, 50))
    ema_periods: tuple[int, ...] = (12, 26)
    rsi_period: int = 14
    rsi_oversold: float = 30.0
    rsi_overbought: float = 70.0
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    stoch_window: int = 14
    stoch_smooth: int = 3
    roc_periods: tuple[int, ...] = (10, 20)
    bb_period: int = 20
    bb_std: float = 2.0
    atr_period: int = 14
    volatility_windows: tuple[int, ...] = (10, 20, 30)
    volume_window: int = 20
    volume_spike: float = 2.0
    mfi_window: int = 14
    doji_ratio: float = 0.1
    adx_period: int = 14
    adx_strong: float = 25.0
    adx_weak: float = 20.0
    aroon_window: int = 25
    momentum_periods: tuple[int, ...] = (5, 10, 20)
    groups: tuple[str, ...] = field(default=(
        "moving_averages", "momentum", "volatility", "volume", "patterns", "trend"))

    def compared(self) -> tuple[list[int], list[tuple[int, int]]]:
        """Averages next to the price and pairs of averages, of the periods there are."""
        have = set(self.sma_periods)
        return [n for n in self.price_to_sma if n in have], [p for p in self.sma_crosses if have.issuperset(p)]


DEFAULT_TECHNICAL = TechnicalConfig()

# Output columns by group, with the reference's column names.
TECHNICAL_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "moving_averages": [
        ("sma_10", "SMA_10"), ("sma_20", "SMA_20"), ("sma_50", "SMA_50"), ("sma_200", "SMA_200"),
        ("ema_12", "EMA_12"), ("ema_26", "EMA_26"),
        ("price_to_sma20", "Price_to_SMA20"), ("price_to_sma50", "Price_to_SMA50"),
        ("sma_10_20_cross", "SMA_10_20_cross"), ("sma_20_50_cross", "SMA_20_50_cross")],
    "momentum": [
        ("rsi", "RSI"), ("rsi_oversold", "RSI_oversold"), ("rsi_overbought", "RSI_overbought"),
        ("macd", "MACD"), ("macd_signal", "MACD_signal"), ("macd_diff", "MACD_diff"),
        ("macd_bullish", "MACD_bullish"), ("stoch_k", "Stoch_K"), ("stoch_d", "Stoch_D"),
        ("roc_10", "ROC_10"), ("roc_20", "ROC_20")],
    "volatility": [
        ("bb_upper", "BB_upper"), ("bb_middle", "BB_middle"), ("bb_lower", "BB_lower"),
        ("bb_width", "BB_width"), ("bb_pct", "BB_pct"),
        ("price_above_bb_upper", "Price_above_BB_upper"),
        ("price_below_bb_lower", "Price_below_BB_lower"),
        ("atr", "ATR"), ("atr_pct", "ATR_pct"),
        ("volatility_10", "Volatility_10"), ("volatility_20", "Volatility_20"),
        ("volatility_30", "Volatility_30")],
    "volume": [
        ("volume_sma_20", "Volume_SMA_20"), ("volume_ratio", "Volume_ratio"),
        ("volume_spike", "Volume_spike"), ("obv", "OBV"), ("vwap", "VWAP"),
        ("price_to_vwap", "Price_to_VWAP"), ("mfi", "MFI")],
    "patterns": [
        ("high_low_range", "High_Low_Range"), ("high_low_pct", "High_Low_Pct"),
        ("close_position", "Close_position"), ("gap_up", "Gap_up"), ("gap_down", "Gap_down"),
        ("body", "Body"), ("upper_shadow", "Upper_shadow"), ("lower_shadow", "Lower_shadow"),
        ("is_doji", "Is_doji")],
    "trend": [
        ("adx", "ADX"), ("strong_trend", "Strong_trend"), ("weak_trend", "Weak_trend"),
        ("aroon_up", "Aroon_up"), ("aroon_down", "Aroon_down"),
        ("aroon_indicator", "Aroon_indicator"),
        ("momentum_5", "Momentum_5"), ("momentum_10", "Momentum_10"),
        ("momentum_20", "Momentum_20")],
}


def technical_columns(cfg: TechnicalConfig = DEFAULT_TECHNICAL) -> list[str]:
    """Columns of the configured groups and periods."""
    to, crosses = cfg.compared()
    by_period = {
        "sma": [f"sma_{n}" for n in cfg.sma_periods], "ema": [f"ema_{n}" for n in cfg.ema_periods],
        "price_to_sma": [f"price_to_sma{n}" for n in to], "sma_cross": [f"sma_{m}_{n}_cross" for m, n in crosses],
        "roc": [f"roc_{n}" for n in cfg.roc_periods], "volatility": [f"volatility_{n}" for n in cfg.volatility_windows],
        "volume_sma": [f"volume_sma_{cfg.volume_window}"], "momentum": [f"momentum_{n}" for n in cfg.momentum_periods]}
    out: list[str] = []
    for g in cfg.groups:
        for c, _ in TECHNICAL_COLUMNS[g]:
            kind = re.sub(r"(_?\d+)+", "", c)
            out += [n for n in by_period.get(kind, [c]) if n not in out]
    return out


def technical_history(cfg: TechnicalConfig = DEFAULT_TECHNICAL) -> int:
    """Rows before a row that its trailing windows read (nested windows add up)."""
    return max(*cfg.sma_periods, *cfg.roc_periods, *cfg.momentum_periods, cfg.stoch_window + cfg.stoch_smooth, cfg.bb_period,
               cfg.atr_period + 1, max(cfg.volatility_windows) + 1, cfg.volume_window, cfg.mfi_window + 1,
               cfg.aroon_window + 1, 2 * cfg.adx_period + 1)


def _c(name: str) -> Column:
    return F.col(name)


def technical_features(df: DataFrame, cfg: TechnicalConfig = DEFAULT_TECHNICAL,
                       layout: Layout = DEFAULT_LAYOUT, key: str = KEY) -> DataFrame:
    """Add the indicator columns of ``cfg.groups`` to laid-out bars."""
    layout.need(technical_history(cfg), "technical_features")
    g = set(cfg.groups)
    close, high, low, open_, vol = _c("close"), _c("high"), _c("low"), _c("open"), _c("volume")
    tmp: list[str] = []

    # Stage A: windows over the input columns.
    t: list[Trailing] = []
    a: list[Column] = [lag("close", 1, key).alias("_c1")]
    tmp.append("_c1")
    if "returns" not in df.columns:
        a.append((div(close, lag("close", 1, key)) - 1).alias("returns"))
        tmp.append("returns")
    if "moving_averages" in g:
        for n in cfg.sma_periods:
            t.append(Trailing(f"sma_{n}", "avg", "close", n))
    if "momentum" in g:
        t += [Trailing("_lo_k", "min", "low", cfg.stoch_window), Trailing("_hi_k", "max", "high", cfg.stoch_window)]
        tmp += ["_lo_k", "_hi_k"]
        for n in cfg.roc_periods:
            a.append(lag("close", n, key).alias(f"_cl{n}"))
            tmp.append(f"_cl{n}")
    if "volatility" in g:
        t += [Trailing("bb_middle", "avg", "close", cfg.bb_period), Trailing("_bb_sd", "stddev_pop", "close", cfg.bb_period)]
        tmp.append("_bb_sd")
    if "volume" in g:
        tp = (high + low + close) / 3.0
        t.append(Trailing(f"volume_sma_{cfg.volume_window}", "avg", "volume", cfg.volume_window))
        a.append(lag(tp, 1, key).alias("_tp1"))
        tmp.append("_tp1")
    if "patterns" in g or "trend" in g:
        a += [lag("high", 1, key).alias("_h1"), lag("low", 1, key).alias("_l1")]
        tmp += ["_h1", "_l1"]
    if "trend" in g:
        n = cfg.aroon_window
        hs = F.collect_list("high").over(trailing(n + 1, key))
        ls = F.collect_list("low").over(trailing(n + 1, key))
        a += [F.when(F.size(hs) >= n, (F.array_position(hs, F.array_max(hs)) - 1) * 100.0 / n)
               .alias("aroon_up"),
              F.when(F.size(ls) >= n, (F.array_position(ls, F.array_min(ls)) - 1) * 100.0 / n)
               .alias("aroon_down")]
        for n in cfg.momentum_periods:
            if f"_cl{n}" not in tmp:
                a.append(lag("close", n, key).alias(f"_cl{n}"))
                tmp.append(f"_cl{n}")
    df = with_trailing(df.select("*", *a), t, key)

    # Stage B: row-wise expressions.
    c1 = _c("_c1")
    b: list[Column] = []
    if "moving_averages" in g:
        to, crosses = cfg.compared()
        b += [div(close, _c(f"sma_{n}")).alias(f"price_to_sma{n}") for n in to]
        b += [flag(_c(f"sma_{m}") > _c(f"sma_{n}")).alias(f"sma_{m}_{n}_cross") for m, n in crosses]
    if "momentum" in g:
        diff = close - c1
        b += [F.when(diff > 0, diff).otherwise(F.lit(0.0)).alias("_up"),
              F.when(diff < 0, -diff).otherwise(F.lit(0.0)).alias("_dn"),
              (F.lit(100.0) * div(close - _c("_lo_k"), _c("_hi_k") - _c("_lo_k"))).alias("stoch_k")]
        tmp += ["_up", "_dn"]
        for n in cfg.roc_periods:
            b.append((div(close - _c(f"_cl{n}"), _c(f"_cl{n}")) * 100.0).alias(f"roc_{n}"))
    if "volatility" in g:
        up = _c("bb_middle") + cfg.bb_std * _c("_bb_sd")
        lo = _c("bb_middle") - cfg.bb_std * _c("_bb_sd")
        b += [up.alias("bb_upper"), lo.alias("bb_lower"),
              (div(up - lo, _c("bb_middle")) * 100.0).alias("bb_width"),
              div(close - lo, up - lo).alias("bb_pct"),
              flag(close > up).alias("price_above_bb_upper"),
              flag(close < lo).alias("price_below_bb_lower"),
              F.greatest(high - low, F.abs(high - c1), F.abs(low - c1)).alias("_tr")]
        tmp.append("_tr")
    if "volume" in g:
        tp, tp1 = (high + low + close) / 3.0, _c("_tp1")
        sign = F.when(tp > tp1, 1.0).when(tp < tp1, -1.0).otherwise(0.0)
        mf = tp * vol * sign
        ratio = div(vol, _c(f"volume_sma_{cfg.volume_window}"))
        b += [ratio.alias("volume_ratio"), flag(ratio > cfg.volume_spike).alias("volume_spike"),
              F.when(mf >= 0, mf).otherwise(0.0).alias("_mf_pos"),
              F.when(mf < 0, -mf).otherwise(0.0).alias("_mf_neg"),
              F.when(close < c1, -vol).otherwise(vol).alias("_obv_x"),
              (close * vol).alias("_cv")]
        tmp += ["_mf_pos", "_mf_neg", "_obv_x", "_cv"]
    if "patterns" in g:
        rng = high - low
        body = F.abs(close - open_)
        if "high_low_range" not in df.columns:  # the cleaner already adds it
            b.append(rng.alias("high_low_range"))
        b += [(div(rng, close) * 100.0).alias("high_low_pct"),
              div(close - low, rng).alias("close_position"),
              flag(open_ > _c("_h1")).alias("gap_up"), flag(open_ < _c("_l1")).alias("gap_down"),
              body.alias("body"), (high - F.greatest(open_, close)).alias("upper_shadow"),
              (F.least(open_, close) - low).alias("lower_shadow"),
              flag(body < rng * cfg.doji_ratio).alias("is_doji")]
    if "trend" in g:
        du, dd = high - _c("_h1"), _c("_l1") - low
        b += [F.when(du.isNull(), None).when((du > dd) & (du > 0), du).otherwise(0.0).alias("_pdm"),
              F.when(dd.isNull(), None).when((dd > du) & (dd > 0), dd).otherwise(0.0).alias("_mdm"),
              (_c("aroon_up") - _c("aroon_down")).alias("aroon_indicator")]
        tmp += ["_pdm", "_mdm"]
        for n in cfg.momentum_periods:
            b.append((div(close, _c(f"_cl{n}")) - 1).alias(f"momentum_{n}"))
    df = df.select("*", *b)

    # Stage C: windows over stage-B columns (seeds, rolling sums, volatility).
    t = []
    if "momentum" in g:
        t.append(Trailing("stoch_d", "avg", "stoch_k", cfg.stoch_smooth))
    if "volatility" in g:
        t += [Trailing(f"volatility_{n}", "stddev_samp", "returns", n) for n in cfg.volatility_windows]
        t.append(Trailing("_atr_seed", "avg", "_tr", cfg.atr_period))
        tmp.append("_atr_seed")
    if "volume" in g:
        t += [Trailing("_mfp", "sum", "_mf_pos", cfg.mfi_window), Trailing("_mfn", "sum", "_mf_neg", cfg.mfi_window)]
        tmp += ["_mfp", "_mfn"]
    if "trend" in g:
        t += [Trailing("_pdm_seed", "sum", "_pdm", cfg.adx_period), Trailing("_mdm_seed", "sum", "_mdm", cfg.adx_period)]
        tmp += ["_pdm_seed", "_mdm_seed"]
    df = with_trailing(df, t, key)

    # Stage D: first-level recursive smoothers.
    sm: list[Smoother] = []
    if "moving_averages" in g or "momentum" in g:
        spans = sorted(set(cfg.ema_periods) | ({cfg.macd_fast, cfg.macd_slow} if "momentum" in g else set()))
        sm += [ema(f"ema_{n}", "close", n) for n in spans]
    if "momentum" in g:
        sm += [wilder_mean("_rsi_up", "_up", cfg.rsi_period),
               wilder_mean("_rsi_dn", "_dn", cfg.rsi_period)]
        tmp += ["_rsi_up", "_rsi_dn"]
    if "volatility" in g:
        n = cfg.atr_period
        sm.append(Smoother("atr", "_tr", 1 - 1.0 / n, 1.0 / n, n - 1, "_atr_seed", 0, 0.0))
    if "trend" in g:
        n = cfg.adx_period
        sm += [Smoother("_pdm_s", "_pdm", 1 - 1.0 / n, 1.0, n, "_pdm_seed"),
               Smoother("_mdm_s", "_mdm", 1 - 1.0 / n, 1.0, n, "_mdm_seed")]
        tmp += ["_pdm_s", "_mdm_s"]
    df = apply_smoothers(df, sm, key, layout)

    # Stage E: expressions over smoothed values.
    e: list[Column] = []
    if "momentum" in g:
        rs_dn = _c("_rsi_dn")
        e += [F.when(rs_dn == 0, 100.0)
               .otherwise(100.0 - 100.0 / (1.0 + div(_c("_rsi_up"), rs_dn))).alias("rsi"),
              (_c(f"ema_{cfg.macd_fast}") - _c(f"ema_{cfg.macd_slow}")).alias("macd")]
    if "volatility" in g:
        e.append((div(_c("atr"), close) * 100.0).alias("atr_pct"))
    if "volume" in g:
        e.append(F.when(_c("_mfn") == 0, F.when(_c("_mfp") > 0, 100.0))
                  .otherwise(100.0 - 100.0 / (1.0 + div(_c("_mfp"), _c("_mfn")))).alias("mfi"))
    if "trend" in g:
        p, m = _c("_pdm_s"), _c("_mdm_s")
        e.append(F.when(p.isNotNull() & m.isNotNull(),
                        F.coalesce(div(F.abs(p - m), p + m) * 100.0, F.lit(0.0))).alias("_dx"))
        tmp.append("_dx")
    df = df.select("*", *e)

    # Stage F: second-level smoothers (MACD signal, ADX).
    sm2: list[Smoother] = []
    if "momentum" in g:
        sm2.append(ema("macd_signal", "macd", cfg.macd_signal, start=cfg.macd_slow - 1))
    if "trend" in g:
        n = cfg.adx_period
        df = with_trailing(df, [Trailing("_dx_seed", "avg", "_dx", n)], key)
        tmp.append("_dx_seed")
        sm2.append(Smoother("adx", "_dx", 1 - 1.0 / n, 1.0 / n, 2 * n - 1, "_dx_seed"))
    df = apply_smoothers(df, sm2, key, layout)

    # Stage G: flags over second-level values and unbounded running sums.
    fin: list[Column] = []
    if "momentum" in g:
        fin += [flag(_c("rsi") < cfg.rsi_oversold).alias("rsi_oversold"),
                flag(_c("rsi") > cfg.rsi_overbought).alias("rsi_overbought"),
                (_c("macd") - _c("macd_signal")).alias("macd_diff"),
                flag(_c("macd") > _c("macd_signal")).alias("macd_bullish")]
    if "trend" in g:
        fin += [flag(_c("adx") > cfg.adx_strong).alias("strong_trend"),
                flag(_c("adx") < cfg.adx_weak).alias("weak_trend")]
    if fin:
        df = df.select("*", *fin)
    if "volume" in g:
        df = with_running(df, {"obv": ("sum", _c("_obv_x")), "_scv": ("sum", _c("_cv")),
                               "_sv": ("sum", vol)}, layout, key)
        df = df.select("*", div(_c("_scv"), _c("_sv")).alias("vwap"))
        df = df.select("*", div(close, _c("vwap")).alias("price_to_vwap"))
        tmp += ["_scv", "_sv"]
    drop = []
    if "moving_averages" not in g:
        drop += [f"ema_{n}" for n in {*cfg.ema_periods, cfg.macd_fast, cfg.macd_slow}]
    else:
        drop += [f"ema_{n}" for n in (cfg.macd_fast, cfg.macd_slow) if n not in cfg.ema_periods]
    return df.drop(*tmp, *drop)
