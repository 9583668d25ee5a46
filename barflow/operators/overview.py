"""Per-symbol summaries: overview statistics, latest bar, last-k rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.frames import KEY, div


def overview(bars: DataFrame, key: str = KEY) -> DataFrame:
    """Mean/min/max/sample-std of close, mean volume and row count (one partial
    aggregate, so a hot symbol is combined map-side)."""
    return bars.groupBy(key).agg(
        F.avg("close").alias("mean_close"), F.min("close").alias("min_close"),
        F.max("close").alias("max_close"), F.stddev_samp("close").alias("std_close"),
        F.avg("volume").alias("mean_volume"), F.count(F.lit(1)).alias("rows"))


def latest(bars: DataFrame, key: str = KEY, order: str = "date") -> DataFrame:
    """Last close, its change against the bar before (%), last volume, rows.

    The last two bars per symbol come from a ``row_number() <= 2`` filter,
    which Catalyst plans as a map-side group limit (``WindowGroupLimit``)
    before the exchange; the row count is a partial aggregate."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    top = bars.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 2)
    last2 = top.groupBy(key).agg(
        F.first(F.when(F.col("_k") == 1, F.struct("close", "volume", order)), ignorenulls=True).alias("_l"),
        F.first(F.when(F.col("_k") == 2, F.col("close")), ignorenulls=True).alias("_prev"))
    counts = bars.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    out = last2.join(counts, key)
    return out.select(key, F.col("_l.close").alias("last_close"),
                      (100 * (div(F.col("_l.close"), F.col("_prev")) - 1)).alias("last_change_pct"),
                      F.col("_l.volume").alias("last_volume"), "rows",
                      F.col(f"_l.{order}").alias(f"last_{order}"))


def tail(bars: DataFrame, k: int, key: str = KEY, order: str = "date") -> DataFrame:
    """The last ``k`` bars of each symbol. Catalyst plans this as a per-partition
    top-k (``WindowGroupLimit``) before the exchange, so at most ``k`` rows per
    symbol and map task are shuffled."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return bars.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
