"""Cleaning of raw bars: dedupe, fill, outlier flag, derived columns, report.

Order: dedupe -> forward fill -> backward fill -> volume median -> drop rows
still missing prices -> outlier flag/cap -> returns, log returns, ranges,
weekday. The reference fills in arrival order before sorting; here filling
always follows the date order (documented deviation). The reference also
computes a capped return and then discards it, so prices never change; the
cap is exposed as ``capped_return`` and prices stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.frames import KEY, div, lag
from barflow.operators.layout import (DEFAULT_LAYOUT, Layout, attach_per_key, layout_series,
                                      with_running, written)
from barflow.sources.bars import no_nan
from barflow.sources.store import cut_lineage

PRICE_COLS = ["open", "high", "low", "close"]

# --- fixed values (cleaning rules of the reference) --------------------------
# Outlier: absolute daily return above 10 standard deviations of the returns.
# Cap for an outlier return: sign(return) * 3 standard deviations.
OUTLIER_SIGMAS = 10.0
CAP_SIGMAS = 3.0


def dedupe_last(raw: DataFrame, key: str = KEY, order: str = "date",
                arrival: str = "arrival") -> DataFrame:
    """One row per ``(key, order)``: the one with the largest ``arrival``.

    Groups are single dates, so the window never holds more than the copies
    of one bar."""
    w = Window.partitionBy(key, order).orderBy(F.col(arrival).desc())
    return raw.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


#: Accuracy of the quantile sketches (ranks are off by at most ``n / MEDIAN_ACCURACY``), and
#: steps of the grid in which the second one cuts what the first one leaves.
MEDIAN_ACCURACY, MEDIAN_GRID = 10_000, 200


def exact_median(df: DataFrame, col: str, key: str = KEY, accuracy: int = MEDIAN_ACCURACY, grid: int = MEDIAN_GRID) -> DataFrame:
    """``(key, median)``: exact median of the values of each key. NULL and NaN are
    missing; infinities are values like others (the mean of both is NaN).

    Three passes, whatever the values, and no task holds a key's values: a quantile
    sketch brackets the two middle ranks to a few in ``accuracy`` of the rows; a
    second sketch, of the rows inside, cuts that bracket about fiftyfold; then the
    distinct values inside are ranked by their numbers. A sketch only chooses what
    to rank: ranks are counted on all rows, and one outside its bracket is an error."""
    if grid * 2 > accuracy:
        raise ValueError("the grid is finer than the sketch")
    v = F.col("v")
    d = df.select(key, F.col(col).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v) & F.col(key).isNotNull())
    off = 4.0 / accuracy
    first = d.groupBy(key).agg(F.count("v").alias("n"), F.percentile_approx("v", [max(0.0, 0.5 - off), min(1.0, 0.5 + off)], accuracy).alias("at"))
    first = cut_lineage(first.select(key, F.floor((F.col("n") - 1) / 2).alias("low"), F.floor(F.col("n") / 2).alias("high"),
                                     F.col("at")[0].alias("lo"), F.col("at")[1].alias("hi")), "median")
    inside = F.when((v >= F.col("lo")) & (v <= F.col("hi")), v)
    second = d.join(first, key).groupBy(key, "low", "high").agg(
        F.count_if(v < F.col("lo")).alias("below"), F.count(inside).alias("n"),
        F.percentile_approx(inside, [i / grid for i in range(grid + 1)], accuracy).alias("at"))
    # Grid points around the two ranks, with one more on each side for the sketch's error.
    place = lambda rank: F.floor((F.col(rank) - F.col("below")) / F.col("n") * grid)
    second = cut_lineage(second.select(
        key, "low", "high", F.col("at")[F.greatest(place("low") - 2, F.lit(0)).cast("int")].alias("from"),
        F.col("at")[F.least(place("high") + 3, F.lit(grid)).cast("int")].alias("to")), "median")
    # All rows below the bracket are one group, whose value is NULL and comes first.
    counts = d.join(second, key).where(v <= F.col("to")).groupBy(key, "low", "high", F.when(v >= F.col("from"), v).alias("v")) \
              .agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).where(v.isNotNull())
    held = lambda rank: F.max(F.when((F.col(rank) >= F.col("upto") - F.col("c")) & (F.col(rank) < F.col("upto")), v))
    both = ranked.groupBy(key).agg(held("low").alias("a"), held("high").alias("b"))
    missed = F.raise_error(F.lit("a middle rank lies outside its bracket")).cast("double")
    return both.select(key, F.when(F.col("a").isNull() | F.col("b").isNull(), missed)
                       .when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("a") + F.col("b")) / 2).alias("median"))


def fill_missing(df: DataFrame, layout: Layout = DEFAULT_LAYOUT, key: str = KEY) -> DataFrame:
    """Prices: forward fill, then backward fill of leading gaps; volume: the
    symbol's exact median. Input is laid out; output keeps the layout."""
    specs = {f"_ff_{c}": ("last", F.col(c)) for c in PRICE_COLS}
    # Per-symbol values come from the input rows (not the filled frame), so
    # this branch does not re-run the fill join.
    df = written(df, layout, "fill")
    own = df.where(~F.col("halo"))
    d = with_running(df, specs, layout, key, halo_exact=True)
    stats = own.groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rn"))).alias(f"_bf_{c}") for c in PRICE_COLS])
    median = exact_median(own, "volume", key).withColumnRenamed("median", "_vol_med")
    stats = stats.join(median, key, "left")
    d = attach_per_key(d, stats, key)
    out = [F.coalesce(F.col(f"_ff_{c}"), F.col(f"_bf_{c}")).alias(c) for c in PRICE_COLS]
    out.append(F.coalesce(F.col("volume"), F.col("_vol_med")).alias("volume"))
    keep = [c for c in d.columns if c not in PRICE_COLS + ["volume"] and not c.startswith(("_ff_", "_bf_", "_vol_med"))]
    return d.select(*keep, *out)


def drop_missing_prices(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=PRICE_COLS)


def flag_outliers(df: DataFrame, key: str = KEY, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """``is_outlier``: |return| > 10 sigma of the symbol's returns (sample
    std); ``capped_return``: the return capped at sign * 3 sigma."""
    d = written(df.withColumn("_ret", div(F.col("close"), lag("close", 1, key)) - 1), layout, "returns")
    sd = d.where(~F.col("halo")).groupBy(key).agg(F.stddev_samp("_ret").alias("_ret_sd"))
    d = attach_per_key(d, sd, key)
    flag = F.coalesce(F.abs(F.col("_ret")) > OUTLIER_SIGMAS * F.col("_ret_sd"), F.lit(False))
    return (d.withColumn("is_outlier", flag.cast("int"))
             .withColumn("capped_return", F.when(flag, F.signum("_ret") * CAP_SIGMAS * F.col("_ret_sd"))
                         .otherwise(F.col("_ret")))
             .drop("_ret", "_ret_sd"))


def derive_basic(df: DataFrame, key: str = KEY, order: str = "date") -> DataFrame:
    """returns, log_returns, high_low_range, high_low_ratio, day_of_week (Mon=0)."""
    c1 = lag("close", 1, key)
    ratio = div(F.col("close"), c1)
    return df.select(
        "*", (ratio - 1).alias("returns"),
        F.when(ratio > 0, F.log(ratio)).alias("log_returns"),
        (F.col("high") - F.col("low")).alias("high_low_range"),
        div(F.col("high") - F.col("low"), F.col("close")).alias("high_low_ratio"),
        F.weekday(F.col(order)).alias("day_of_week"))


def clean_bars(raw: DataFrame, layout: Layout = DEFAULT_LAYOUT, key: str = KEY,
               order: str = "date", arrival: str | None = "arrival") -> DataFrame:
    """Full cleaning, NaN as NULL; returns laid-out rows (call ``finish`` for a table)."""
    raw = no_nan(raw)
    d = dedupe_last(raw, key, order, arrival) if arrival and arrival in raw.columns else raw
    if arrival and arrival in d.columns:
        d = d.drop(arrival)
    d = layout_series(d, key, order, layout)
    d = fill_missing(d, layout, key)
    d = drop_missing_prices(d)
    d = flag_outliers(d, key, layout)
    return derive_basic(d, key, order)


def cleaning_report(raw: DataFrame, cleaned: DataFrame, key: str = KEY) -> DataFrame:
    """Initial rows, final rows, rows removed and removal rate per symbol."""
    a = raw.groupBy(key).agg(F.count(F.lit(1)).alias("initial_rows"))
    b = cleaned.groupBy(key).agg(F.count(F.lit(1)).alias("final_rows"))
    r = a.join(b, key, "left").fillna(0, ["final_rows"])
    removed = F.col("initial_rows") - F.col("final_rows")
    return r.select(key, "initial_rows", "final_rows", removed.alias("rows_removed"),
                    F.coalesce(div(removed.cast("double"), F.col("initial_rows").cast("double")),
                               F.lit(0.0)).alias("removal_rate"))
