"""Ensemble over a long prediction table ``(symbol, date, split, model, y, yhat)``.

Weights are inverse validation MSE, normalised to sum to one per group
(``by``, default per symbol); combination and spread are per-bar aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values (ensemble rules of the reference) ---------------------------
# Weight of a model: (1 / (mse + 1e-6)) normalised to sum 1, on validation rows.
# Default weights when none are learned: lstm 0.4, rf 0.3, xgb 0.3.
EPS = 1e-6
DEFAULT_WEIGHTS = {"lstm": 0.4, "rf": 0.3, "xgb": 0.3}
# The linear sequence model takes the slot of the neural one.
MODEL_SLOTS = {"linear": "lstm"}

BAR = ["symbol", "date", "split"]


def learn_weights(preds: DataFrame, split: str = "val", by: tuple[str, ...] = ("symbol",),
                  eps: float = EPS) -> DataFrame:
    """``(by..., model, mse, weight)``."""
    mse = (preds.where(F.col("split") == split)
                .groupBy(*by, "model").agg(F.avg((F.col("y") - F.col("yhat")) ** 2).alias("mse")))
    inv = 1.0 / (F.col("mse") + eps)
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return mse.select("*", (inv / F.sum(inv).over(w)).alias("weight"))


def fixed_weights(preds: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS,
                  by: tuple[str, ...] = ("symbol",), slots: dict[str, str] = MODEL_SLOTS) -> DataFrame:
    """Weights for the models present, when none are learned: a model takes the
    weight of its slot (its own name unless ``slots`` names another), models
    outside all slots take the mean weight, and each group sums to one."""
    rest = sum(weights.values()) / len(weights)
    groups = preds.select(*by, "model").distinct()
    own = F.lit(rest)
    for slot, w in weights.items():
        names = [slot, *[m for m, s in slots.items() if s == slot]]
        own = F.when(F.col("model").isin(names), F.lit(w)).otherwise(own)
    d = groups.withColumn("weight", own)
    return d.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(*by)))


def combine(preds: DataFrame, weights: DataFrame, by: tuple[str, ...] = ("symbol",),
            name: str = "ensemble", missing: str = "error") -> DataFrame:
    """Weighted sum of the models' predictions per bar (weights table is one
    row per group and model, small next to the predictions).

    A model without weight would shrink the sum. ``missing="error"`` (default)
    stops with its name; ``"equal"`` gives every bar that has such a model the
    plain mean of its models (a symbol without validation rows, say)."""
    if missing not in ("error", "equal"):
        raise ValueError("missing must be 'error' or 'equal'")
    keys = [*by, "model"]
    d = preds.join(weights.select(*keys, "weight"), keys, "left")
    if missing == "error":
        d = d.withColumn("weight", F.coalesce("weight", F.raise_error(F.concat(
            F.lit("no weight for model "), F.coalesce("model", F.lit("NULL")))).cast("double")))
    total = F.sum(F.col("weight") * F.col("yhat"))
    lacking = F.count_if(F.col("weight").isNull()) > 0
    return (d.groupBy(*BAR).agg(F.first("y").alias("y"),
                                F.when(lacking, F.avg("yhat")).otherwise(total).alias("yhat"))
             .withColumn("model", F.lit(name)))


def uncertainty(preds: DataFrame) -> DataFrame:
    """Unweighted mean and population std of the models per bar."""
    return preds.groupBy(*BAR).agg(F.first("y").alias("y"), F.avg("yhat").alias("mean"),
                                   F.stddev_pop("yhat").alias("std"),
                                   F.count(F.lit(1)).alias("n_models"))


def individual(preds: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Every model's rows plus the ensemble's, one long table."""
    cols = [*BAR, "model", "y", "yhat"]
    return preds.select(*cols).unionByName(ensemble.select(*cols))
