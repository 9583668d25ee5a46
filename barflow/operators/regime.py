"""Market-regime features: 15 columns (volatility, trend and volume regimes).

Runs on the block layout after (or without) the technical indicators. The
percentile ranks are places in a trailing value list, sorted once a row;
trend persistence is a gaps-and-islands run length whose run start is an
exact running maximum across blocks (:func:`barflow.operators.layout.with_running`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.frames import KEY, div, flag, lag, with_pct_rank
from barflow.functions.sliding import Trailing, with_trailing
from barflow.operators.layout import DEFAULT_LAYOUT, Layout, with_running

# --- fixed values (regime parameters of the reference) ----------------------
# Rolling volatility: sample std of 30 daily returns.
# Volatility percentile: trailing 252 rows, at least 50 values.
# Volume percentile: trailing 60 rows, at least 20 values.
# Regime bins on the percentile: [0, 0.33] -> 0, (0.33, 0.67] -> 1, (0.67, 1] -> 2.
# Trend strength: 100 * (SMA 20 - SMA 50) / SMA 50; above 2 -> 1, below -2 -> -1, else 0.


@dataclass(frozen=True)
class RegimeConfig:
    volatility_window: int = 30
    volatility_rank_window: int = 252
    volatility_rank_min: int = 50
    volume_rank_window: int = 60
    volume_rank_min: int = 20
    low_cut: float = 0.33
    high_cut: float = 0.67
    trend_short: int = 20
    trend_long: int = 50
    trend_threshold: float = 2.0


DEFAULT_REGIME = RegimeConfig()

REGIME_COLUMNS: list[tuple[str, str]] = [
    ("rolling_volatility", "Rolling_volatility"),
    ("volatility_percentile", "Volatility_percentile"),
    ("volatility_regime", "Volatility_regime"),
    ("low_volatility", "Low_volatility"), ("high_volatility", "High_volatility"),
    ("trend_strength", "Trend_strength"), ("trend_regime", "Trend_regime"),
    ("uptrend", "Uptrend"), ("downtrend", "Downtrend"), ("ranging", "Ranging"),
    ("trend_persistence", "Trend_persistence"),
    ("volume_percentile", "Volume_percentile"), ("volume_regime", "Volume_regime"),
    ("low_volume", "Low_volume"), ("high_volume", "High_volume"),
]


def regime_history(cfg: RegimeConfig = DEFAULT_REGIME) -> int:
    """Rows before a row that its trailing windows read (nested windows add up)."""
    return max(cfg.volatility_window + 1 + cfg.volatility_rank_window, cfg.volume_rank_window, cfg.trend_long + 1)


def regime_bin(p: Column, cfg: RegimeConfig = DEFAULT_REGIME) -> Column:
    """Right-closed bins of a percentile in (0, 1] -> 0.0 / 1.0 / 2.0 (NULL stays NULL)."""
    return (F.when(p.isNull(), F.lit(None).cast("double"))
             .when(p <= cfg.low_cut, 0.0)
             .when(p <= cfg.high_cut, 1.0)
             .when(p <= 1.0, 2.0))


def regime_features(df: DataFrame, cfg: RegimeConfig = DEFAULT_REGIME,
                    layout: Layout = DEFAULT_LAYOUT, key: str = KEY) -> DataFrame:
    """Add the 15 regime columns to laid-out bars."""
    layout.need(regime_history(cfg), "regime_features")
    tmp: list[str] = []
    a: list[Column] = []
    if "returns" not in df.columns:
        a.append((div(F.col("close"), lag("close", 1, key)) - 1).alias("returns"))
        tmp.append("returns")
    if a:
        df = df.select("*", *a)

    # Windows that the technical features have already made are read, not made again.
    vol, short, long = f"volatility_{cfg.volatility_window}", f"sma_{cfg.trend_short}", f"sma_{cfg.trend_long}"
    windows = [Trailing(f"_{vol}", "stddev_samp", "returns", cfg.volatility_window),
               Trailing(f"_{short}", "avg", "close", cfg.trend_short), Trailing(f"_{long}", "avg", "close", cfg.trend_long)]
    windows = [t for t in windows if t.name[1:] not in df.columns]
    own = {t.name for t in windows}
    df = with_trailing(df, windows, key)
    tmp += sorted(own)
    made = lambda name: F.col(f"_{name}" if f"_{name}" in own else name)
    strength = div(made(short) - made(long), made(long)) * 100.0
    df = df.select("*", made(vol).alias("rolling_volatility"), strength.alias("trend_strength"))
    df = with_pct_rank(df, {"volume_percentile": ("volume", cfg.volume_rank_window, cfg.volume_rank_min),
                            "volatility_percentile": ("rolling_volatility", cfg.volatility_rank_window, cfg.volatility_rank_min)}, key)

    t = cfg.trend_threshold
    s = F.col("trend_strength")
    reg = F.when(s > t, 1).when(s < -t, -1).otherwise(0)
    df = df.select("*", reg.alias("trend_regime"))

    prev = lag("trend_regime", 1, key)
    changed = prev.isNull() | (F.col("trend_regime") != prev)
    df = df.select("*", F.when(changed, F.col("rn")).alias("_chg"))
    tmp.append("_chg")
    df = with_running(df, {"_run_start": ("max", F.col("_chg"))}, layout, key)
    tmp.append("_run_start")

    vreg = regime_bin(F.col("volatility_percentile"), cfg)
    ureg = regime_bin(F.col("volume_percentile"), cfg)
    r = F.col("trend_regime")
    df = df.select("*",
                   vreg.alias("volatility_regime"),
                   flag(vreg == 0.0).alias("low_volatility"),
                   flag(vreg == 2.0).alias("high_volatility"),
                   flag(r == 1).alias("uptrend"), flag(r == -1).alias("downtrend"),
                   flag(r == 0).alias("ranging"),
                   (F.col("rn") - F.col("_run_start") + 1).cast("int").alias("trend_persistence"),
                   ureg.alias("volume_regime"),
                   flag(ureg == 0.0).alias("low_volume"),
                   flag(ureg == 2.0).alias("high_volume"))
    return df.drop(*tmp)


def regime_columns() -> list[str]:
    return [c for c, _ in REGIME_COLUMNS]
