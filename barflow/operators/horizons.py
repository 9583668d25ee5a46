"""Direct multi-horizon training: one fit predicts every step, with the step as an input.

A sample is an input row ``i`` of a symbol and a step ``h``; its label is the
change of the scaled target from row ``i`` to row ``i + h``. The labels are a
narrow table, exploded over the steps; the inputs (one array of scaled columns
a row) are stored once and meet the labels by ``(symbol, row)`` when a model is
fitted or scored, so nothing wide is written more than once.

Trees read the scaled columns and the step. The linear model also reads the
step's square and every column times the step, as a step alone would only shift a
path's slope. The path of a forecast is therefore not a straight line: each
step is the models' own prediction for it.

The parts are separate in time: a sample is of the train part if its label lies
in the first ``train`` share of the symbol's rows, of the validation or test part
if input and label both lie there, and of none otherwise.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import dataset as ds
from barflow.operators import ensemble as en
from barflow.operators import evaluate as ev
from barflow.operators import forecast as fc
from barflow.operators import models as ml
from barflow.sources.store import cut_lineage, load_metadata, save_metadata

#: Steps that a forecast covers at most (the longest choice of the studied system's page).
STEPS = 90


def horizon_inputs(rows: DataFrame, stats: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``symbol, date, rn, n_rows, last, y, x``: the target as it is and scaled, and the scaled columns as one array."""
    laid = ds.apply_minmax(ds.renumber(rows.select("symbol", "date", *columns)), stats, columns).where("not halo")
    return laid.select("symbol", "date", "rn", "n_rows", F.col(target).alias("last"), F.col(target + "_s").alias("y"),
                       F.array(*[F.col(c + "_s").cast("double") for c in columns]).alias("x"))


def horizon_labels(inputs: DataFrame, steps: int = STEPS, train: float = ds.TRAIN_SPLIT, val: float = ds.VAL_SPLIT) -> DataFrame:
    """``symbol, rn, step, split, label`` of all samples: ``rn`` is the input row, ``label``
    the change of the scaled target up to ``rn + step``."""
    ends = inputs.select("symbol", "n_rows", F.col("rn").alias("j"), F.col("y").alias("later"),
                         F.explode(F.sequence(F.lit(1), F.least(F.lit(steps), F.col("rn")).cast("int"))).alias("step")).where("step >= 1 and step <= j")
    ends = ends.withColumn("rn", F.col("j") - F.col("step"))
    first_val, first_test = F.floor(F.col("n_rows") * train), F.floor(F.col("n_rows") * (train + val))
    split = F.when(F.col("j") < first_val, "train") \
             .when((F.col("rn") >= first_val) & (F.col("j") < first_test), "val").when(F.col("rn") >= first_test, "test")
    ends = ends.withColumn("split", split).where("split is not null")
    now = inputs.select("symbol", "rn", "y")
    return ends.join(now, ["symbol", "rn"]).select("symbol", "rn", "step", "split", (F.col("later") - F.col("y")).alias("label"))


def horizon_features(kind: str, steps: int) -> Column:
    """The vector that a model of ``kind`` reads, from ``x`` and ``step``."""
    s = F.col("step").cast("double") / float(steps)
    if kind == "linear":
        return array_to_vector(F.concat("x", F.array(s, s * s), F.transform("x", lambda v: v * s)))
    return array_to_vector(F.concat("x", F.array(s)))


def _samples(inputs: DataFrame, labels: DataFrame, kind: str, steps: int) -> DataFrame:
    d = labels.join(inputs.select("symbol", "rn", "date", "last", "y", "x"), ["symbol", "rn"])
    return d.select("symbol", "rn", "date", "step", "split", "last", "y", "label", horizon_features(kind, steps).alias("features"))


@dataclass
class HorizonSet:
    """Fitted models for the steps 1 to ``steps``, with what scores new rows."""

    columns: list[str]
    target: str
    steps: int
    models: dict
    kinds: dict[str, str]
    stats: DataFrame
    weights: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)

    def score(self, inputs: DataFrame, labels: DataFrame) -> DataFrame:
        """``symbol, date, rn, step, split, model, last, y, yhat`` as prices; ``labels`` names the
        samples (``label`` may be NULL)."""
        out = None
        s = self.stats.select("symbol", (F.col(f"{self.target}__max") - F.col(f"{self.target}__min")).alias("_span"))
        for name, model in self.models.items():
            p = model.transform(_samples(inputs, labels, self.kinds[name], self.steps)).drop("features").join(s, "symbol")
            p = p.select("symbol", "date", "rn", "step", "split", F.lit(name).alias("model"), "last",
                         (F.col("last") + F.col("label") * F.col("_span")).alias("y"),
                         (F.col("last") + F.col("yhat") * F.col("_span")).alias("yhat"))
            out = p if out is None else out.unionByName(p)
        return out


def train_horizons(rows: DataFrame, columns: list[str], specs: list[ml.ModelSpec], target: str = "close",
                   steps: int = STEPS) -> tuple[HorizonSet, DataFrame, DataFrame]:
    """Fit every spec once for all steps; also the written inputs and labels. Weights are
    learned per symbol from the validation samples of all steps."""
    stats = cut_lineage(ds.fit_minmax(ds.renumber(rows.select("symbol", "date", *columns)), columns), "scaler")
    inputs = cut_lineage(horizon_inputs(rows, stats, columns, target), "horizon-inputs")
    labels = cut_lineage(horizon_labels(inputs, steps), "horizon-labels")
    models, seconds = {}, {}
    for spec in specs:
        t = time.time()
        models[spec.name] = ml.fit(_samples(inputs, labels, spec.kind, steps), spec)
        seconds[spec.name] = round(time.time() - t, 3)
    fitted = HorizonSet(columns, target, steps, models, {s.name: s.kind for s in specs}, stats, stats, seconds)
    val = fitted.score(inputs, labels.where("split = 'val'"))
    fitted.weights = cut_lineage(en.learn_weights(val, "val"), "weights")
    return fitted, inputs, labels


def horizon_path(fitted: HorizonSet, rows: DataFrame, steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(path, parts)`` from the last row of every symbol. ``parts`` has every model's price
    for each step and the ensemble's; ``path`` the ensemble's with the spread of the models.
    Steps are dated by the following weekdays."""
    steps = steps or fitted.steps
    if steps > fitted.steps:
        raise ValueError(f"the models were trained for {fitted.steps} steps")
    inputs = cut_lineage(horizon_inputs(rows, fitted.stats, fitted.columns, fitted.target).where(F.col("rn") == F.col("n_rows") - 1), "latest")
    asked = inputs.select("symbol", "rn", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), F.lit("future").alias("split"),
                          F.lit(None).cast("double").alias("label"))
    days = F.filter(F.sequence(F.date_add("date", 1), F.date_add("date", 2 * steps + 3)), lambda d: F.weekday(d) < 5)
    own = fitted.score(inputs, asked).withColumn("date", F.element_at(days, F.col("step")))
    both = cut_lineage(own.select("symbol", "date", "split", "model", "step", "y", "yhat"), "horizon-parts")
    ens = en.combine(both, fitted.weights, missing="equal")
    of_step = both.select("symbol", "date", "step").distinct()
    parts = cut_lineage(en.individual(both, ens).join(of_step, ["symbol", "date"])
                        .select("symbol", "step", "date", "model", F.col("yhat").alias("prediction")), "horizon-parts")
    path = parts.groupBy("symbol", "step", "date").agg(
        F.max(F.when(F.col("model") == "ensemble", F.col("prediction"))).alias("prediction"),
        F.stddev_pop(F.when(F.col("model") != "ensemble", F.col("prediction"))).alias("std"))
    return path, parts


def horizon_tables(fitted: HorizonSet, rows: DataFrame, steps: int | None = None) -> dict[str, DataFrame]:
    """The path with bounds and change, its parts by model, its summary, and the
    recommendation with the share of models that agree on its direction."""
    path, parts = horizon_path(fitted, rows, steps)
    path = cut_lineage(path, "forecast")
    last = cut_lineage(rows.groupBy("symbol").agg(F.max_by(fitted.target, "date").alias("last_known_price")), "last-price")
    summ = cut_lineage(fc.summary(path, last), "summary")
    final = parts.groupBy("symbol", "model").agg(F.max_by("prediction", "step").alias("final_prediction"))
    return {"path": fc.change_from_last(fc.intervals(path), last), "parts": parts, "last": last, "summary": summ,
            "recommendation": fc.recommend(summ, fc.model_agreement(final, last))}


def horizon_evaluation(fitted: HorizonSet, inputs: DataFrame, labels: DataFrame, split: str = "test", z: float = fc.Z95) -> DataFrame:
    """Per step: errors of the ensemble on held-out samples of all symbols, and ``coverage``, the
    share of closes inside the interval of the models' spread."""
    scored = cut_lineage(fitted.score(inputs, labels.where(F.col("split") == split)), "horizon-scored")
    w = fitted.weights.select("symbol", "model", "weight")
    d = scored.join(w, ["symbol", "model"], "left").groupBy("symbol", "rn", "step", "split").agg(
        F.first("y").alias("y"), F.coalesce(F.sum(F.col("weight") * F.col("yhat")), F.avg("yhat")).alias("yhat"),
        F.stddev_pop("yhat").alias("std")).withColumn("model", F.lit("ensemble"))
    inside = F.abs(F.col("y") - F.col("yhat")) <= z * F.col("std")
    return ev.metrics(d, by=("step",), split=split).join(d.groupBy("step").agg(F.avg(inside.cast("double")).alias("coverage")), "step")


def save_horizons(fitted: HorizonSet, path: str) -> None:
    """Store models, scaler statistics, weights and metadata below ``path``."""
    for name, model in fitted.models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    fitted.stats.write.mode("overwrite").parquet(f"{path}/scaler")
    fitted.weights.write.mode("overwrite").parquet(f"{path}/weights")
    save_metadata(fitted.stats.sparkSession, {"columns": fitted.columns, "target": fitted.target, "steps": fitted.steps,
                                              "models": fitted.kinds, "seconds": fitted.seconds}, f"{path}/metadata")


def load_horizons(spark: SparkSession, path: str) -> HorizonSet:
    meta = load_metadata(spark, f"{path}/metadata")
    models = {n: ml.LOADERS[k].load(f"{path}/models/{n}") for n, k in meta["models"].items()}
    return HorizonSet(meta["columns"], meta["target"], meta["steps"], models, meta["models"],
                      spark.read.parquet(f"{path}/scaler"), spark.read.parquet(f"{path}/weights"), meta["seconds"])
