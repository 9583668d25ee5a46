"""Forecast tables, intervals, summary, recommendation, backtest.

A forecast path is ``(symbol, step, date, prediction, std)``; ``last`` is
``(symbol, last_known_price)``. Formulas here are this library's own (the
reference only fixes the output contract).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.frames import div, lag
from barflow.operators.evaluate import metrics
from barflow.operators.layout import finish, layout_series
from barflow.sources.store import cut_lineage

# --- fixed values ------------------------------------------------------------
# 95 % interval: mean +- 1.96 standard deviations across models.
# Recommendation: BUY above +2 % predicted change, SELL below -2 %, else HOLD.
Z95 = 1.96
BUY_PCT = 2.0
SELL_PCT = -2.0

#: Steps of a path that one numbering task holds.
STEPS_A_TASK = 10_000


def intervals(path: DataFrame, z: float = Z95) -> DataFrame:
    return path.select("*", (F.col("prediction") - z * F.col("std")).alias("lower"),
                       (F.col("prediction") + z * F.col("std")).alias("upper"))


def change_from_last(path: DataFrame, last: DataFrame) -> DataFrame:
    d = path.join(last, "symbol")
    return d.select("*", (100.0 * div(F.col("prediction") - F.col("last_known_price"),
                                      F.col("last_known_price"))).alias("change_pct"))


def summary(path: DataFrame, last: DataFrame) -> DataFrame:
    """Per symbol: last known price, final prediction and its change, range,
    volatility (100 x sample std of step-to-step returns of the path). The
    step before comes through the block layout, so no task holds a whole path."""
    d = layout_series(path.select("symbol", "step", "prediction"), order="step", bucket=F.floor(F.col("step") / STEPS_A_TASK))
    d = finish(d.select("*", (div(F.col("prediction"), lag("prediction")) - 1).alias("_r")))
    agg = d.groupBy("symbol").agg(
        F.max_by("prediction", "step").alias("final_prediction"),
        F.min("prediction").alias("min_price"), F.max("prediction").alias("max_price"),
        (100.0 * F.stddev_samp("_r")).alias("volatility"), F.count(F.lit(1)).alias("n_steps"))
    out = agg.join(last, "symbol")
    chg = 100.0 * div(F.col("final_prediction") - F.col("last_known_price"), F.col("last_known_price"))
    return out.select("symbol", "last_known_price", "final_prediction", chg.alias("predicted_change"),
                      "min_price", "max_price", "volatility", "n_steps")


def recommend(summ: DataFrame, agreement: DataFrame | None = None,
              buy: float = BUY_PCT, sell: float = SELL_PCT) -> DataFrame:
    """Action from the predicted change; confidence = share of models whose
    own final change has the ensemble's sign (``agreement``: symbol, share)."""
    ch = F.col("predicted_change")
    action = F.when(ch > buy, "BUY").when(ch < sell, "SELL").otherwise("HOLD")
    d = summ if agreement is None else summ.join(agreement, "symbol", "left")
    conf = F.col("agreement") if agreement is not None else F.lit(None).cast("double")
    level = F.when(conf >= 0.99, "High").when(conf >= 0.5, "Medium").otherwise("Low")
    reason = F.format_string("Predicted change %.2f%% over %d steps", ch, F.col("n_steps"))
    return d.select("symbol", action.alias("action"), conf.alias("confidence"),
                    level.alias("confidence_level"), reason.alias("reason"),
                    ch.alias("trend_strength"))


def model_agreement(final_by_model: DataFrame, last: DataFrame, ensemble: str = "ensemble") -> DataFrame:
    """``final_by_model``: (symbol, model, final_prediction)."""
    d = final_by_model.join(last, "symbol")
    sign = F.signum(F.col("final_prediction") - F.col("last_known_price"))
    ens = d.where(F.col("model") == ensemble).select("symbol", sign.alias("_es"))
    base = d.where(F.col("model") != ensemble).select("symbol", sign.alias("_s"))
    return (base.join(ens, "symbol")
                .groupBy("symbol").agg(F.avg((F.col("_s") == F.col("_es")).cast("double")).alias("agreement")))


def backtest(preds: DataFrame, test_days: int = 30, order: str = "date") -> DataFrame:
    """Hold out the last ``test_days`` bars of each symbol and model; r2,
    rmse, mape and directional accuracy (%). The tail filter is planned as a
    map-side group limit before the exchange."""
    w = Window.partitionBy("symbol", "model").orderBy(F.col(order).desc())
    tail = preds.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= test_days + 1)
    last = tail.where(F.col("_k") <= test_days)
    m = metrics(last, split=None).select("symbol", "model", "r2", "rmse", "mape")
    # The extra oldest tail row only serves as the previous actual.
    da = directional_accuracy_on_tail(tail, test_days)
    return m.join(da, ["symbol", "model"])


def directional_accuracy_on_tail(tail: DataFrame, test_days: int) -> DataFrame:
    w = Window.partitionBy("symbol", "model").orderBy("date")
    prev = F.lag("y").over(w)
    hit = (F.signum(F.col("y") - prev) == F.signum(F.col("yhat") - prev)).cast("double")
    d = tail.select("*", hit.alias("_hit")).where(F.col("_k") <= test_days)
    return d.groupBy("symbol", "model").agg((F.avg("_hit") * 100.0).alias("directional_accuracy"))


def error_histogram(preds: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of ``yhat - y`` per symbol and model."""
    err = F.col("yhat") - F.col("y")
    d = preds.select("symbol", "model", err.alias("err"))
    rng = cut_lineage(d.groupBy("symbol", "model").agg(F.min("err").alias("lo"), F.max("err").alias("hi")), "error-range")
    d = d.join(rng, ["symbol", "model"])
    b = F.least(F.floor(div(F.col("err") - F.col("lo"), F.col("hi") - F.col("lo")) * bins),
                F.lit(bins - 1))
    b = F.coalesce(b, F.lit(0)).cast("int")
    return (d.groupBy("symbol", "model", b.alias("bin"))
             .agg(F.count(F.lit(1)).alias("count"),
                  F.first("lo").alias("lo"), F.first("hi").alias("hi"))
             .select("symbol", "model", "bin", "count",
                     (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("bin_start")))
