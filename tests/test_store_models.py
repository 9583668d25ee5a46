"""Feature catalog, generator extension point, model and metadata persistence."""

import tempfile

import pytest
from pyspark.sql import functions as F

from barflow.operators.store import (FeatureGroup, catalog, default_groups, generate_features,
                                     guard_min_rows, numeric_columns)
from barflow.sources.store import load_metadata, save_metadata
from tests.helpers import bars_frame


def test_catalog_lists_73_features(spark):
    c = catalog(spark).toPandas()
    assert len(c) == 73 and c["feature"].is_unique
    assert set(c["generator"]) == {"TechnicalFeatures", "RegimeFeatures"}


def test_custom_feature_group(spark):
    rows = [("S", i, 1 + i, 2 + i, i, 1.5 + i, 10) for i in range(30)]
    mid = FeatureGroup("Mid", ("high", "low"), (("mid", "Mid"),),
                       lambda d: d.withColumn("mid", (F.col("high") + F.col("low")) / 2), "custom")
    out = generate_features(bars_frame(spark, rows), groups=[mid], materialize=False).toPandas()
    assert (out["mid"] == out["low"] + 1).all()
    bad = spark.createDataFrame([(1.0,)], "close double")
    assert mid.check(bad) == ["high", "low"]
    assert len(default_groups()) == 2


def test_numeric_columns_and_guard(spark):
    df = bars_frame(spark, [("S", i, 1, 1, 1, 1, 1) for i in range(5)] + [("T", 0, 1, 1, 1, 1, 1)])
    assert numeric_columns(df) == ["open", "high", "low", "close", "volume"]
    g = {r.symbol: r for r in guard_min_rows(df, 3).collect()}
    assert g["S"].eligible and not g["T"].eligible and "need 3" in g["T"].reason


def test_model_and_metadata_round_trip(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegressionModel
    from barflow.operators.models import ModelSpec
    df = spark.createDataFrame([([float(i), 1.0], 2.0 * i, "train") for i in range(20)],
                               "a array<double>, label double, split string")
    df = df.withColumn("features", array_to_vector("a"))
    m = ModelSpec("lin", "linear", dict(maxIter=10)).estimator().fit(df)
    d = tempfile.mkdtemp(prefix="barflow-test-")
    m.write().overwrite().save(f"{d}/model")
    again = LinearRegressionModel.load(f"{d}/model")
    assert abs(again.coefficients[0] - m.coefficients[0]) < 1e-12
    save_metadata(spark, {"symbol": "S", "lookback": 60, "when": __import__("datetime").date(2020, 1, 1)},
                  f"{d}/meta")
    assert load_metadata(spark, f"{d}/meta") == {"symbol": "S", "lookback": 60, "when": "2020-01-01"}


@pytest.mark.parametrize("name", ["train_ensemble", "sink_model", "fc_future_90", "fc_future_recommendation"])
def test_training_queries_fit_all_three_models(monkeypatch, name):
    from barflow.plans import catalog
    from barflow.plans import queries_wide as qw

    class Stop(Exception):
        pass

    def train(bars, specs, *args, **kwargs):
        assert [s.kind for s in specs] == ["rf", "gbt", "linear"]
        raise Stop

    monkeypatch.setattr(qw, "daily_bars", lambda spark, sf: None)
    monkeypatch.setattr(qw.tr, "guarded", lambda *args: (None, None))
    monkeypatch.setattr(qw.tr, "model_columns", lambda rows: [])
    monkeypatch.setattr(qw.tr, "train", train)
    monkeypatch.setattr(qw.hz, "train_horizons", lambda rows, columns, specs, **kwargs: train(rows, specs))
    with pytest.raises(Stop):
        catalog.registry()[name][0](None, "")
