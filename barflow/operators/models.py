"""Regressors on lag-vector samples with ``pyspark.ml`` (distributed fits).

One pooled model is fitted over all symbols (features are scaled per
symbol); metrics stay per symbol. A single-symbol fit is the same call on a
filtered sample table. Estimators follow the reference's settings where
``pyspark.ml`` has an equivalent; the third ensemble slot (a neural
sequence model in the reference) is an elastic-net linear model on the same
lag vector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.frames import div

# --- fixed values (model settings of the reference) ---------------------------
# Random forest: 200 trees, depth 15, min samples per leaf 2, sqrt features, seed 42.
# Boosted trees: 200 rounds, depth 7, learning rate 0.01, 0.8 row and column sampling.
RF_DEFAULTS = dict(numTrees=200, maxDepth=15, minInstancesPerNode=2,
                   featureSubsetStrategy="sqrt", seed=42)
GBT_DEFAULTS = dict(maxIter=200, maxDepth=7, stepSize=0.01, subsamplingRate=0.8,
                    featureSubsetStrategy="0.8", seed=42)
LINEAR_DEFAULTS = dict(maxIter=100, regParam=0.001, elasticNetParam=0.5)

#: What reads a stored model of each kind.
LOADERS = {"rf": RandomForestRegressionModel, "gbt": GBTRegressionModel, "linear": LinearRegressionModel}


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str  # "rf" | "gbt" | "linear"
    params: dict

    def estimator(self, features: str = "features", label: str = "label"):
        cls = {"rf": RandomForestRegressor, "gbt": GBTRegressor, "linear": LinearRegression}[self.kind]
        return cls(featuresCol=features, labelCol=label, predictionCol="yhat", **self.params)


def default_specs() -> list[ModelSpec]:
    return [ModelSpec("rf", "rf", RF_DEFAULTS), ModelSpec("xgb", "gbt", GBT_DEFAULTS),
            ModelSpec("linear", "linear", LINEAR_DEFAULTS)]


def fit(samples: DataFrame, spec: ModelSpec, train_split: str = "train",
        validation: bool = False, val_split: str = "val"):
    """Fit on the train split. With ``validation`` a boosted model also reads the
    validation split and stops where that no longer gains (Spark's ``validationTol``)."""
    if spec.kind == "gbt" and validation:
        data = samples.where(F.col("split").isin(train_split, val_split)) \
                      .withColumn("_is_val", F.col("split") == val_split)
        est = spec.estimator().setValidationIndicatorCol("_is_val")
        return est.fit(data)
    return spec.estimator().fit(samples.where(F.col("split") == train_split))


def predict(model, samples: DataFrame, name: str) -> DataFrame:
    """Long prediction rows ``(symbol, date, split, model, y, yhat)``."""
    out = model.transform(samples)
    return out.select("symbol", "date", "split", F.lit(name).alias("model"),
                      F.col("label").alias("y"), "yhat")


def history(preds: DataFrame) -> DataFrame:
    """R2 per model and split (train / val / test) as one grouped aggregate;
    NULL where the labels of a split are constant."""
    err = F.col("y") - F.col("yhat")
    agg = preds.groupBy("model", "split").agg(
        F.sum(err * err).alias("_sse"), (F.count(F.lit(1)) * F.var_pop("y")).alias("_sst"))
    return agg.select("model", "split", (1 - div(F.col("_sse"), F.col("_sst"))).alias("r2"))


def gbt_rounds(model, samples: DataFrame, splits: tuple[str, ...] = ("val",)) -> DataFrame:
    """``split, round, n, rmse``: error after each boosting round on the named splits
    (``evaluateEachIteration``), with the number of samples; a split without samples has no rows."""
    spark = samples.sparkSession
    sizes = {r["split"]: r["count"] for r in samples.groupBy("split").count().collect()}  # at most a few splits
    rows = []
    for split in splits:
        if sizes.get(split):
            errs = model.evaluateEachIteration(samples.where(F.col("split") == split), "squared")
            rows += [(split, i + 1, sizes[split], float(e) ** 0.5) for i, e in enumerate(errs)]
    return spark.createDataFrame(rows, "split string, round int, n long, rmse double")


def importances(spark: SparkSession, model, cols: list[str], lookback: int) -> DataFrame:
    """Tree importances by input column (summed over lags), descending.

    The flattened vector is lag-major: position ``p`` is lag ``p // F`` of
    column ``p % F``."""
    vec = model.featureImportances.toArray().tolist()
    nf = len(cols)
    rows = [(cols[p % nf], lookback - p // nf, float(v)) for p, v in enumerate(vec)]
    df = spark.createDataFrame(rows, "feature string, lag int, importance double")
    return (df.groupBy("feature").agg(F.sum("importance").alias("importance"))
              .orderBy(F.col("importance").desc()))
