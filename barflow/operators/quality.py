"""Data-quality report for bars: one row per symbol, plus detail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.frames import KEY, div, series_window
from barflow.operators.layout import DEFAULT_LAYOUT, Layout, finish, layout_series, unkeyed, with_running
from barflow.sources.bars import no_nan

REQUIRED = ["open", "high", "low", "close", "volume"]

# --- fixed values (validation rules of the reference) -------------------------
# Fail: no rows; a required column missing; share of nulls in a required
# column above 10 %; any close <= 0; any volume < 0.
# Warn: absolute daily close change above 50 %; gaps above 7 days between bars.
MAX_NULL_SHARE = 0.10
BIG_MOVE = 0.5
MAX_GAP_DAYS = 7


def missing_columns(df: DataFrame, required: list[str] = REQUIRED) -> list[str]:
    """Required columns absent from the schema (no job runs)."""
    have = {c.lower() for c in df.columns}
    return [c for c in required if c.lower() not in have]


def _moves_and_gaps(bars: DataFrame, layout: Layout, key: str, order: str) -> DataFrame:
    """Per row: change against the last non-null close before it (pandas
    ``pct_change`` pads missing values) and the day gap to the previous bar. The
    report looks at bars before copies are dropped: several bars of one date follow
    each other by arrival (if there is such a column), then by their values."""
    ties = tuple(c for c in ("arrival", *REQUIRED) if c in bars.columns)
    d = layout_series(no_nan(bars), key, order, layout, ties=ties).drop("n_rows")
    d = with_running(d, {"_pad": ("last", F.col("close"))}, layout, key, halo_exact=True)
    w = series_window(key)
    prev = F.lag("_pad", 1).over(w)
    cur = F.coalesce(F.col("close"), F.col("_pad"))
    d = d.select("*", (div(cur, prev) - 1).alias("change"),
                 F.datediff(F.col(order), F.lag(order, 1).over(w)).alias("gap_days"))
    return finish(d).drop("_pad")


def big_moves(bars: DataFrame, layout: Layout = DEFAULT_LAYOUT, key: str = KEY,
              order: str = "date") -> DataFrame:
    """Rows whose absolute close change exceeds 50 % (warning detail)."""
    d = _moves_and_gaps(bars, layout, key, order)
    return d.where(F.abs("change") > BIG_MOVE).select(key, order, F.abs("change").alias("abs_change"))


def date_gaps(bars: DataFrame, layout: Layout = DEFAULT_LAYOUT, key: str = KEY,
              order: str = "date") -> DataFrame:
    """Consecutive bars more than 7 days apart (warning detail)."""
    d = _moves_and_gaps(bars, layout, key, order)
    return d.where(F.col("gap_days") > MAX_GAP_DAYS).select(key, order, "gap_days")


def quality_report(bars: DataFrame, symbols: DataFrame | None = None,
                   layout: Layout = DEFAULT_LAYOUT, key: str = KEY,
                   order: str = "date") -> DataFrame:
    """One row per symbol: counts per rule and the verdict ``passed``.

    ``symbols`` (one column ``symbol``) lists the requested symbols; those
    without rows appear with ``rows = 0`` and fail ``dq_empty``. NaN counts as NULL. Rows without
    symbol or date have no place in a series, but every other rule counts
    them; ``missing_keys`` counts them and any fails the symbol (rows without
    symbol form the NULL symbol).
    """
    d = _moves_and_gaps(bars, layout, key, order)
    d = d.unionByName(unkeyed(no_nan(bars), key, order), allowMissingColumns=True)
    n = F.count(F.lit(1))
    null_share = F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in REQUIRED])
    rep = d.groupBy(key).agg(
        n.alias("rows"),
        null_share.alias("max_null_share"),
        F.count_if(F.col("close") <= 0).alias("nonpositive_close"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if(F.abs("change") > BIG_MOVE).alias("big_moves"),
        F.count_if(F.col("gap_days") > MAX_GAP_DAYS).alias("date_gaps"),
        F.count_if(F.col(key).isNull() | F.col(order).isNull()).alias("missing_keys"))
    if symbols is not None:
        rep = symbols.select(key).distinct().join(rep, key, "left")
        rep = rep.fillna(0, ["rows", "nonpositive_close", "negative_volume", "big_moves", "date_gaps", "missing_keys"])
    empty = F.col("rows") == 0
    passed = (~empty & (F.coalesce(F.col("max_null_share"), F.lit(0.0)) <= MAX_NULL_SHARE)
              & (F.col("nonpositive_close") == 0) & (F.col("negative_volume") == 0)
              & (F.col("missing_keys") == 0))
    return rep.select("*", empty.alias("empty"),
                      (F.col("max_null_share") > MAX_NULL_SHARE).alias("too_many_nulls"),
                      passed.alias("passed"))
