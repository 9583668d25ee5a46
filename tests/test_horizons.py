"""Direct multi-horizon training: samples, paths that are the models' own predictions, recommendation."""

import datetime as dt
import math
import tempfile

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from barflow.operators import dataset as ds
from barflow.operators import forecast as fc
from barflow.operators import horizons as hz
from barflow.operators import models as ml

COLUMNS = ["close", "volume", "wave"]
STEPS = 6
SPECS = [ml.ModelSpec("rf", "rf", dict(numTrees=5, maxDepth=5, seed=1)), ml.ModelSpec("xgb", "gbt", dict(maxIter=4, maxDepth=3, seed=1)),
         ml.ModelSpec("linear", "linear", dict(maxIter=20))]
SIZES = {"A": 150, "B": 90, "short": 1}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    data = [(s, dt.date(2020, 1, 1) + dt.timedelta(i), 100 + 10 * math.sin(i / 5) + float(r.normal()), float(r.integers(1, 50)), math.cos(i / 5))
            for s, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(data, "symbol string, date date, close double, volume double, wave double")


@pytest.fixture(scope="module")
def fitted(rows):
    return hz.train_horizons(rows, COLUMNS, SPECS, steps=STEPS)


def test_every_sample_lies_in_one_part(rows, fitted):
    _, inputs, labels = fitted
    by = {s: [r.y for r in inputs.where(F.col("symbol") == s).orderBy("rn").collect()] for s in SIZES}
    got = {(r.symbol, r.rn, r.step): (r.split, r.label) for r in labels.collect()}
    exp = {}
    for s, n in SIZES.items():
        a, b = math.floor(n * ds.TRAIN_SPLIT), math.floor(n * (ds.TRAIN_SPLIT + ds.VAL_SPLIT))
        for i in range(n):
            for h in range(1, STEPS + 1):
                j = i + h
                split = "train" if j < a else "val" if i >= a and j < b else "test" if i >= b else None
                if j < n and split:
                    exp[s, i, h] = (split, by[s][j] - by[s][i])
    assert got.keys() == exp.keys()
    assert all(got[k][0] == exp[k][0] and got[k][1] == pytest.approx(exp[k][1]) for k in exp)


def test_every_step_is_the_models_own_prediction(rows, fitted):
    run = fitted[0]
    path, parts = hz.horizon_path(run, rows.where("symbol <> 'short'"))
    own = {(r.symbol, r.step, r.model): r.prediction for r in parts.collect()}
    last = {r.symbol: r for r in fitted[1].where("rn = n_rows - 1").collect()}
    span = {r.symbol: r.close__max - r.close__min for r in run.stats.collect()}
    for s in ("A", "B"):
        x = np.array(last[s].x)
        for h in range(1, STEPS + 1):
            t = h / STEPS
            for name, kind in run.kinds.items():
                v = np.concatenate([x, [t, t * t], x * t]) if kind == "linear" else np.concatenate([x, [t]])
                exp = last[s].last + run.models[name].predict(Vectors.dense(v)) * span[s]
                assert own[s, h, name] == pytest.approx(exp, rel=1e-9)
    rel = {(r.symbol, r.model): r.weight for r in run.weights.collect()}
    for r in path.collect():
        mine = [own[r.symbol, r.step, m] for m in run.kinds]
        assert r.prediction == pytest.approx(sum(rel[r.symbol, m] * p for m, p in zip(run.kinds, mine, strict=True)))
        assert r["std"] == pytest.approx(np.std(mine)) and r.date.weekday() < 5
    line = [r.prediction - last["A"].last for r in sorted(path.where("symbol = 'A'").collect(), key=lambda r: r.step)]
    assert np.ptp([p / (h + 1) for h, p in enumerate(line)]) > 1e-3  # not drawn at one pace


def test_recommendation_has_its_confidence(rows, fitted):
    t = hz.horizon_tables(fitted[0], rows.where("symbol <> 'short'"), 4)
    last = {r.symbol: r.last_known_price for r in t["last"].collect()}
    end = {}
    for r in t["parts"].where("step = 4").collect():
        end.setdefault(r.symbol, {})[r.model] = r.prediction - last[r.symbol]
    for r in t["recommendation"].collect():
        main = end[r.symbol].pop("ensemble")
        share = np.mean([np.sign(v) == np.sign(main) for v in end[r.symbol].values()])
        pct = 100 * main / last[r.symbol]
        assert r.action == ("BUY" if pct > 2 else "SELL" if pct < -2 else "HOLD") and r.confidence == pytest.approx(share)
        assert r.confidence_level == ("High" if share == 1 else "Medium" if share >= 0.5 else "Low")
    with pytest.raises(ValueError):
        hz.horizon_path(fitted[0], rows, STEPS + 1)


@pytest.mark.parametrize(("ends", "change", "action", "confidence", "level"), [
    ({"a": 110, "b": 104, "c": 101}, 5, "BUY", 1, "High"), ({"a": 110, "b": 104, "c": 99}, 4, "BUY", 2 / 3, "Medium"),
    ({"a": 80, "b": 104, "c": 103}, -5, "SELL", 1 / 3, "Low"), ({"a": 101, "b": 99, "c": 102}, 1, "HOLD", 2 / 3, "Medium")])
def test_action_and_confidence(spark, ends, change, action, confidence, level):
    last = spark.createDataFrame([("S", 100.0)], "symbol string, last_known_price double")
    final = spark.createDataFrame([("S", m, float(v)) for m, v in {**ends, "ensemble": 100 + change}.items()], "symbol string, model string, final_prediction double")
    summ = spark.createDataFrame([("S", float(change), 9)], "symbol string, predicted_change double, n_steps long")
    r = fc.recommend(summ, fc.model_agreement(final, last)).first()
    assert (r.action, r.confidence_level, r.confidence) == (action, level, pytest.approx(confidence))


def test_a_stored_set_scores_alike(spark, rows, fitted):
    run, inputs, labels = fitted
    path = tempfile.mkdtemp(prefix="barflow-horizons-")
    hz.save_horizons(run, path)
    again = hz.load_horizons(spark, path)
    key = lambda d: sorted((r.symbol, r.rn, r.step, r.model, r.yhat) for r in d.collect())
    assert key(again.score(inputs, labels)) == key(run.score(inputs, labels))
    e = hz.horizon_evaluation(again, inputs, labels).toPandas()
    assert sorted(e["step"]) == list(range(1, STEPS + 1)) and e["coverage"].between(0, 1).all()
    mine = run.score(inputs, labels.where("split = 'test' and step = 3")).toPandas()
    w = run.weights.toPandas()
    mine = mine.merge(w[["symbol", "model", "weight"]], on=["symbol", "model"])
    ens = mine.assign(p=mine.weight * mine.yhat).groupby(["symbol", "rn"]).agg(p=("p", "sum"), y=("y", "first"), sd=("yhat", lambda v: np.std(v)))
    assert e[e.step == 3]["coverage"].iloc[0] == pytest.approx(np.mean(np.abs(ens.y - ens.p) <= 1.96 * ens.sd))
    assert e[e.step == 3]["rmse"].iloc[0] == pytest.approx(np.sqrt(np.mean((ens.y - ens.p) ** 2)))
