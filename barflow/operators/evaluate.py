"""Regression metrics per group, model comparison, run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.frames import div

METRICS = ["mse", "rmse", "mae", "r2", "mape"]
# Higher is better for r2; lower for the rest.
HIGHER_IS_BETTER = {"r2"}


def metrics(preds: DataFrame, by: tuple[str, ...] = ("symbol", "model"),
            split: str | None = "test") -> DataFrame:
    """mse, rmse, mae, r2 (``1 - SSE / (n * var_pop(y))``) and mape (x100).
    A zero target gives a NULL term in mape (the reference gives inf)."""
    d = preds if split is None else preds.where(F.col("split") == split)
    err = F.col("y") - F.col("yhat")
    agg = d.groupBy(*by).agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"), (F.count(F.lit(1)) * F.var_pop("y")).alias("_sst"),
        (F.avg(F.abs(div(err, F.col("y")))) * 100.0).alias("mape"),
        F.count(F.lit(1)).alias("n"))
    return agg.select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae",
                      (1 - div(F.col("_sse"), F.col("_sst"))).alias("r2"), "mape", "n")


def comparison(metric_table: DataFrame) -> DataFrame:
    """Upper-cased model names, as shown to users."""
    return metric_table.withColumn("model", F.upper("model"))


def best_models(metric_table: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Best model per group and metric (max r2, min of the others)."""
    long = metric_table.select(*by, "model", F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in METRICS]), F.array(*[F.col(m) for m in METRICS]))
    ).alias("metric", "value"))
    score = F.when(F.col("metric").isin(*HIGHER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy(*by, "metric").orderBy(score.asc_nulls_last(), F.col("model"))
    return (long.withColumn("_r", F.row_number().over(w)).where("_r = 1")
                .select(*by, "metric", F.col("model").alias("best_model"), "value"))
