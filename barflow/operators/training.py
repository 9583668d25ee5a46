"""Training run: features, guards, scaling, sequences, split, fits, ensemble, metrics.

One call chains the operators of this package and returns everything a run
yields; :func:`save_run` stores the scaler, the lag step and the regressors as one
``PipelineModel`` beside weights and metadata, :func:`load_run` reads them, and the
loaded set scores raw feature rows in one call.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import dataset as ds
from barflow.operators import ensemble as en
from barflow.operators import evaluate as ev
from barflow.operators import models as ml
from barflow.operators import stages as st
from barflow.operators.regime import regime_columns
from barflow.operators.store import (GUARD_EXTRA_ROWS, MIN_SAMPLES, generate_features, guard_min_rows, keep_eligible,
                                     numeric_columns)
from barflow.operators.technical import technical_columns
from barflow.sources.store import cut_lineage, load_metadata, save_metadata

#: Columns that the cleaner adds for inspection; no model reads them.
NOT_INPUTS = ("rn", "is_outlier", "capped_return")


@dataclass
class TrainingRun:
    columns: list[str]
    lookback: int
    horizon: int
    target: str
    rows: DataFrame
    guards: DataFrame
    stats: DataFrame
    samples: DataFrame | None
    models: dict
    kinds: dict[str, str]
    predictions: DataFrame
    weights: DataFrame
    metrics: DataFrame
    history: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)
    #: Error after every boosting round, by split; None without a boosted model.
    rounds: DataFrame | None = None
    #: The fitted scaler and the lag step.
    steps: list = field(default_factory=list)


def model_columns(features: DataFrame) -> list[str]:
    """Every numeric column of the feature table, in schema order."""
    return numeric_columns(features, exclude=NOT_INPUTS)


def feature_inputs() -> list[str]:
    """Names of the model inputs that :func:`generate_features` yields: bars, the
    cleaner's columns and all features, each once."""
    base = ["open", "high", "low", "close", "volume", "returns", "log_returns", "high_low_range", "high_low_ratio", "day_of_week"]
    return base + [c for c in technical_columns() + regime_columns() if c not in base]


def guarded(bars: DataFrame, features_of, lookback: int, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Feature rows of the symbols that pass the row guards before and after the
    features, and one status row per symbol and stage."""
    need = lookback + horizon + GUARD_EXTRA_ROWS
    bars = cut_lineage(bars, "bars")
    before = cut_lineage(guard_min_rows(bars, need, "bars").withColumn("stage", F.lit("bars")), "guard")
    rows = cut_lineage(features_of(keep_eligible(bars, before)), "features")
    after = cut_lineage(guard_min_rows(rows, need, "features").withColumn("stage", F.lit("features")), "guard")
    return keep_eligible(rows, after), before.unionByName(after)


def build_samples(rows: DataFrame, columns: list[str], target: str, lookback: int, horizon: int,
                  fit_on: str = "train") -> tuple[DataFrame, st.SymbolScalerModel, st.LagWindow, DataFrame]:
    """Scaled, split lag samples (``features`` vectors), the fitted scaler and the lag step,
    and the guard on the number of samples (rejected symbols give none). Only the scaled rows
    are written; whoever reads the samples builds the windows."""
    scaler = st.SymbolScaler(columns, fit_on).fit(rows)
    lag = st.LagWindow(columns, target, lookback, horizon)
    s = lag.transform(scaler.transform(rows))
    guard = s.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    ok = F.col("rows") >= MIN_SAMPLES
    guard = guard.select("symbol", "rows", ok.alias("eligible"), F.when(~ok, F.format_string(
        "samples: need %d, got %d", F.lit(MIN_SAMPLES), F.col("rows"))).alias("reason"), F.lit("samples").alias("stage"))
    return s.where(F.col("n_samples") >= MIN_SAMPLES), scaler, lag, guard


def predict_all(models: dict, samples: DataFrame) -> DataFrame:
    """Long prediction rows of every model, with the samples built once: each model adds a column."""
    d = samples
    for name, model in models.items():
        d = model.copy().setPredictionCol(f"yhat_{name}").transform(d)
    return long_predictions(d, list(models))


def long_predictions(wide: DataFrame, names: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"yhat_{n}").alias("yhat")) for n in names])).alias("m")
    return wide.select("symbol", "date", "split", F.col("label").alias("y"), each).select("symbol", "date", "split", "m.model", "y", "m.yhat")


def train(bars: DataFrame, specs: list[ml.ModelSpec] | None = None, target: str = "close",
          lookback: int = ds.LOOKBACK, horizon: int = ds.HORIZON, fit_on: str = "train", stop_early: bool = False) -> TrainingRun:
    """Train all models on all numeric columns and evaluate them and their ensemble.

    Predictions and labels are scaled back to prices before weights and
    metrics. A symbol without validation rows gets equal weights. ``stop_early`` ends
    boosting where the validation part no longer gains; ``rounds`` of the run holds the
    error after every boosting round either way."""
    specs = specs or ml.default_specs()
    t0 = time.time()
    rows, guards = guarded(bars, generate_features, lookback, horizon)
    columns = model_columns(rows)
    samples, scaler, lag, guard = build_samples(rows, columns, target, lookback, horizon, fit_on)
    guards = guards.unionByName(guard)
    seconds = {"samples": time.time() - t0}
    models, rounds = {}, None
    for spec in specs:
        t = time.time()
        models[spec.name] = ml.fit(samples, spec, validation=stop_early)
        if spec.kind == "gbt":
            r = ml.gbt_rounds(models[spec.name], samples, ("train", "val")).withColumn("model", F.lit(spec.name))
            rounds = r if rounds is None else rounds.unionByName(r)
        seconds[spec.name] = time.time() - t
    preds = predict_all(models, samples)
    preds = ds.inverse_minmax(preds, scaler.stats, "yhat", target, "yhat")
    preds = cut_lineage(ds.inverse_minmax(preds, scaler.stats, "y", target, "y"), "predictions")
    weights = cut_lineage(en.learn_weights(preds, "val"), "weights")
    ens = en.combine(preds, weights, missing="equal")
    everything = cut_lineage(en.individual(preds, ens), "predictions")
    return TrainingRun(columns, lookback, horizon, target, rows, guards, scaler.stats, samples, models, {s.name: s.kind for s in specs},
                       everything, weights, ev.metrics(everything), ml.history(everything), seconds, rounds, [scaler, lag])


def train_one(bars: DataFrame, name: str, **options) -> TrainingRun:
    """Train a single model type by its name (``rf``, ``xgb`` or ``linear``) with the default settings."""
    chosen = [s for s in options.pop("specs", None) or ml.default_specs() if s.name == name]
    if not chosen:
        raise ValueError(f"no model type {name!r}")
    return train(bars, chosen, **options)


def out_of_fold(samples: DataFrame, specs: list[ml.ModelSpec], n_splits: int = ds.N_SPLITS, gap: int = ds.GAP) -> tuple[DataFrame, DataFrame]:
    """Walk-forward run: each model is fitted anew for every fold, on the samples that end
    ``gap`` rows before the fold's test slice, and predicts that slice alone.

    Returns the out-of-fold predictions ``symbol, date, idx, split (test), fold, model, y, yhat``
    and one row per symbol and fold with what the fit read: ``n_train, first_train, last_train``
    (sample numbers). ``samples`` is one table, filtered for each fold; a fold in which
    nothing comes before the gap is left out."""
    preds = seen = None
    for fold in range(n_splits):
        own = ds.fold_samples(samples, fold, n_splits, gap)
        # The role of the fold takes the place of the chronological split.
        own = own.select("symbol", "date", "idx", F.col("role").alias("split"), "features", "label")
        read = cut_lineage(own.where("split = 'train'").groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n_train"), F.min("idx").alias("first_train"), F.max("idx").alias("last_train")), "fold")
        if not read.limit(1).count():
            continue
        seen_here = read.withColumn("fold", F.lit(fold))
        seen = seen_here if seen is None else seen.unionByName(seen_here)
        wide = own.where("split = 'test'")
        for spec in specs:
            wide = ml.fit(own, spec).setPredictionCol(f"yhat_{spec.name}").transform(wide)
        each = F.explode(F.array(*[F.struct(F.lit(s.name).alias("model"), F.col(f"yhat_{s.name}").alias("yhat")) for s in specs])).alias("m")
        p = wide.select("symbol", "date", "idx", "split", F.lit(fold).alias("fold"), F.col("label").alias("y"), each) \
                .select("symbol", "date", "idx", "split", "fold", "m.model", "y", "m.yhat")
        preds = p if preds is None else preds.unionByName(p)
    if preds is None:
        raise ValueError("no fold has samples before its gap")
    return cut_lineage(preds, "out-of-fold"), seen


def split_counts(samples: DataFrame) -> DataFrame:
    """Samples of each symbol by part: ``n_train, n_val, n_test``."""
    return samples.groupBy("symbol").agg(*[F.count_if(F.col("split") == c).alias(f"n_{c}") for c in ("train", "val", "test")])


def run_summary(run: TrainingRun) -> DataFrame:
    """One row per symbol and model: type, sample counts, history, test results, time."""
    spark = run.metrics.sparkSession
    kinds = spark.createDataFrame([(m, k, float(run.seconds.get(m, 0.0))) for m, k in {**run.kinds, "ensemble": "ensemble"}.items()],
                                  "model string, model_type string, fit_seconds double")
    counts = split_counts(run.samples)
    hist = run.history.groupBy("model").pivot("split", ["train", "val", "test"]).agg(F.first("r2"))
    hist = hist.select("model", *[F.col(c).alias(f"r2_{c}") for c in ("train", "val", "test")])
    return (run.metrics.join(counts, "symbol").join(hist, "model", "left").join(kinds, "model", "left")
               .select("symbol", "model", "model_type", "n_train", "n_val", "n_test", F.lit(len(run.columns)).alias("n_columns"),
                       F.lit(run.lookback).alias("lookback"), F.lit(run.horizon).alias("horizon"),
                       "mse", "rmse", "mae", "r2", "mape", "r2_train", "r2_val", "r2_test", "fit_seconds"))


def save_run(run: TrainingRun, path: str) -> None:
    """Store the run's steps as one pipeline, its weights and metadata below ``path``."""
    spark = run.metrics.sparkSession
    fitted = [model.copy().setPredictionCol(f"yhat_{name}") for name, model in run.models.items()]
    PipelineModel([*run.steps, *fitted]).write().overwrite().save(f"{path}/pipeline")
    run.weights.write.mode("overwrite").parquet(f"{path}/weights")
    save_metadata(spark, {"columns": run.columns, "lookback": run.lookback, "horizon": run.horizon, "target": run.target,
                          "models": run.kinds, "seconds": run.seconds}, f"{path}/metadata")


@dataclass
class FittedSet:
    columns: list[str]
    lookback: int
    horizon: int
    target: str
    names: list[str]
    pipeline: PipelineModel
    weights: DataFrame

    def predict(self, rows: DataFrame, labelled: bool = True) -> DataFrame:
        """Predictions of every model and the ensemble, as prices, from raw feature rows
        (``symbol, date`` and the fitted columns). With ``labelled`` false: of the window
        that ends at each row, also where the price to predict is not known yet."""
        scaler, lag, *_ = self.pipeline.stages
        stages = [scaler, lag.copy({lag.labelled: labelled}), *self.pipeline.stages[2:]]
        preds = long_predictions(PipelineModel(stages).transform(rows), self.names)
        for c in ("yhat", "y"):
            preds = ds.inverse_minmax(preds, scaler.stats, c, self.target, c)
        preds = cut_lineage(preds, "predictions")
        return en.individual(preds, en.combine(preds, self.weights, missing="equal"))


def load_run(spark: SparkSession, path: str) -> FittedSet:
    meta = load_metadata(spark, f"{path}/metadata")
    return FittedSet(meta["columns"], meta["lookback"], meta["horizon"], meta["target"], list(meta["models"]),
                     PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/weights"))
