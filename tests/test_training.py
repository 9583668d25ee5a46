"""Whole runs: stored pipelines, single model types, boosting rounds, walk-forward fits."""

import datetime as dt
import math
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barflow.operators import dataset as ds
from barflow.operators import evaluate as ev
from barflow.operators import models as ml
from barflow.operators import stages as st
from barflow.operators import training as tr

SPECS = [ml.ModelSpec("rf", "rf", dict(numTrees=4, maxDepth=4, seed=1)), ml.ModelSpec("xgb", "gbt", dict(maxIter=5, maxDepth=3, seed=1)),
         ml.ModelSpec("linear", "linear", dict(maxIter=10, regParam=0.01))]
LOOKBACK, HORIZON = 4, 2


@pytest.fixture(scope="module")
def run(spark):
    r = np.random.default_rng(2)
    rows = []
    for s in ("A", "B"):
        price = 100 + np.cumsum(r.normal(0, 1, 560))
        rows += [(s, dt.date(2020, 1, 1) + dt.timedelta(i), p, p + 1, p - 1, p + 0.3, float(r.integers(1, 99))) for i, p in enumerate(map(float, price))]
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    return tr.train(bars, SPECS, lookback=LOOKBACK, horizon=HORIZON)


def long(d):
    return {(r.symbol, r.date, r.model): r.yhat for r in d.collect()}


def test_a_stored_run_scores_raw_rows(spark, run):
    path = tempfile.mkdtemp(prefix="barflow-run-")
    tr.save_run(run, path)
    again = tr.load_run(spark, path)
    assert [type(s).__name__ for s in again.pipeline.stages[:2]] == ["SymbolScalerModel", "LagWindow"] and len(again.pipeline.stages) == 5
    got, own = long(again.predict(run.rows)), long(run.predictions)
    assert got.keys() == own.keys() and {k[2] for k in own} == {"rf", "xgb", "linear", "ensemble"}
    assert all(got[k] == pytest.approx(own[k], rel=1e-12) for k in own)
    # New bars: the windows that end at the last rows have no label yet.
    fresh = again.predict(run.rows, labelled=False)
    last = run.rows.groupBy("symbol").agg(F.max("date").alias("date"))
    assert fresh.join(last, ["symbol", "date"]).count() == 8
    # A sample dated i has the window before i; unlabelled windows are dated by their last row.
    dates = sorted(r.date for r in run.rows.where("symbol = 'A'").select("date").collect())
    new = long(fresh)
    for i in (LOOKBACK, LOOKBACK + 50, len(dates) - HORIZON):
        assert new["A", dates[i - 1], "linear"] == pytest.approx(own["A", dates[i], "linear"], rel=1e-12)


def test_scaler_stage_learns_from_the_first_rows_alone(spark, run):
    d = spark.createDataFrame([("S", dt.date(2020, 1, 1) + dt.timedelta(i), float(i), 5.0) for i in range(10)], "symbol string, date date, x double, y double")
    model = st.SymbolScaler(["x", "y"]).fit(d)
    r = model.stats.first()
    assert (r.x__min, r.x__max) == (0.0, math.floor(10 * ds.TRAIN_SPLIT) - 1)
    out = {r.date.day: (r.x_s, r.y_s) for r in model.transform(d).collect()}
    assert out[1] == (0.0, 0.0) and out[10][0] > 1
    assert st.SymbolScaler(["x"], "all").fit(d).stats.first().x__max == 9
    path = tempfile.mkdtemp(prefix="barflow-scaler-")
    model.write().overwrite().save(path)
    back = st.SymbolScalerModel.load(path)
    assert back.getColumns() == ["x", "y"] and back.uid == model.uid and back.stats.collect() == model.stats.collect()


def test_rounds_end_at_the_metric_table(run):
    rounds = run.rounds.where("split = 'val'").orderBy("round").collect()
    assert [r["round"] for r in rounds] == [1, 2, 3, 4, 5] and {r.model for r in rounds} == {"xgb"}
    scaled = run.models["xgb"].transform(run.samples).select("split", F.lit("xgb").alias("model"), F.col("label").alias("y"), "yhat")
    end = {r["split"]: r.rmse for r in ev.metrics(scaled, by=("split",), split=None).collect()}
    last = {r["split"]: r.rmse for r in run.rounds.where("round = 5").collect()}
    assert last == pytest.approx({k: end[k] for k in ("train", "val")})


def test_stopping_cuts_rounds(spark):
    r = np.random.default_rng(0)
    rows = [([float(x) for x in r.normal(0, 1, 3)], float(r.normal()), "train" if i % 3 else "val") for i in range(300)]  # noise alone
    d = spark.createDataFrame(rows, "v array<double>, label double, split string").withColumn("features", array_to_vector("v"))
    spec = ml.ModelSpec("xgb", "gbt", dict(maxIter=30, maxDepth=4, stepSize=0.3, seed=1))
    whole, cut = ml.fit(d, spec), ml.fit(d, spec, validation=True)
    assert whole.getNumTrees == 30 > cut.getNumTrees
    assert ml.gbt_rounds(cut, d, ("val", "none")).count() == cut.getNumTrees


def test_no_fold_is_predicted_by_a_model_that_saw_it(spark, monkeypatch):
    n = {"A": 130, "B": 61, "tiny": 3}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(i), i, k, [float(i), float(i % 7)], float(i)) for s, k in n.items() for i in range(k)]
    d = spark.createDataFrame(rows, "symbol string, date date, idx long, n_samples long, v array<double>, label double").withColumn("features", array_to_vector("v"))
    read = []
    fit = ml.fit

    def watched(samples, spec, *args, **kwargs):
        read.append({(r.symbol, r.idx) for r in samples.where("split = 'train'").collect()})
        return fit(samples, spec, *args, **kwargs)

    monkeypatch.setattr(tr.ml, "fit", watched)
    preds, seen = tr.out_of_fold(d, [SPECS[2]], 5, 4)
    got = {}
    for p in preds.collect():
        got.setdefault((p.symbol, p.fold), []).append(p.idx)
    for s, k in n.items():
        size = k // 6
        for fold in range(5):
            start = k - (5 - fold) * size
            assert sorted(got.get((s, fold), [])) == list(range(start, start + size))
            own = {i for x, i in read[fold] if x == s}
            assert own == set(range(max(0, start - 4)))
    assert {(r.symbol, r.fold): (r.n_train, r.last_train) for r in seen.collect()} == {
        (s, f): (k - (5 - f) * (k // 6) - 4, k - (5 - f) * (k // 6) - 5) for s, k in n.items() for f in range(5) if k - (5 - f) * (k // 6) > 4}


def test_a_single_model_type_by_name(monkeypatch):
    asked = []
    monkeypatch.setattr(tr, "train", lambda bars, specs, **options: asked.append((specs, options)))
    tr.train_one(None, "xgb", lookback=30)
    assert [s.kind for s in asked[0][0]] == ["gbt"] and asked[0][0][0].params["maxIter"] == 200 and asked[0][1] == {"lookback": 30}
    with pytest.raises(ValueError):
        tr.train_one(None, "lstm")
