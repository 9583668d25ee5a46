"""Rows without keys, models without weights, lost tables, plans of the sources."""

import contextlib
import datetime as dt
import io
import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators import clean as cl
from barflow.operators import ensemble as en
from barflow.operators import models as ml
from barflow.operators.quality import quality_report
from barflow.plans.queries import daily_bars, q_src_bars
from tests.conftest import SF001

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
PREDS = "symbol string, date date, split string, model string, y double, yhat double"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_rows_without_date_or_symbol_are_reported(spark):
    rows = [("A", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0), ("A", None, 1.0, 1.0, 1.0, -5.0, 1.0),
            (None, dt.date(2020, 1, 2), 1.0, 1.0, 1.0, 1.0, -1.0), ("B", dt.date(2020, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = {r.symbol: r for r in quality_report(spark.createDataFrame(rows, BARS)).collect()}
    assert (got["A"].rows, got["A"].nonpositive_close, got["A"].missing_keys, got["A"].passed) == (2, 1, 1, False)
    assert (got[None].rows, got[None].negative_volume, got[None].missing_keys) == (1, 1, 1)
    assert got["B"].passed and got["B"].missing_keys == 0


def predictions(spark, models, split="val"):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([("A", day, split, m, 100.0, 100.0 + i) for i, m in enumerate(models)], PREDS)


def test_a_model_without_weight_is_not_dropped(spark):
    p = predictions(spark, ["rf", "xgb", "linear"])
    w = spark.createDataFrame([("A", "rf", 0.5), ("A", "xgb", 0.5)], "symbol string, model string, weight double")
    with pytest.raises(Exception, match="no weight for model linear"):
        en.combine(p, w).collect()
    assert en.combine(p, w, missing="equal").first().yhat == pytest.approx(101.0)
    fixed = {r.model: r.weight for r in en.fixed_weights(p).collect()}
    assert fixed == pytest.approx({"linear": 0.4, "rf": 0.3, "xgb": 0.3})
    assert en.combine(p, en.fixed_weights(p)).first().yhat == pytest.approx(0.3 * 100 + 0.3 * 101 + 0.4 * 102)
    two = predictions(spark, ["rf", "other"])
    assert sum(r.weight for r in en.fixed_weights(two).collect()) == pytest.approx(1.0)


def test_symbols_without_validation_rows_keep_their_bars(spark):
    p = predictions(spark, ["rf", "xgb"]).unionByName(predictions(spark, ["rf", "xgb"], "test").withColumn("symbol", F.lit("B")))
    out = en.combine(p, en.learn_weights(p), missing="equal").collect()
    assert {r.symbol for r in out} == {"A", "B"}


def test_constant_labels_give_no_score(spark):
    p = predictions(spark, ["rf"]).unionByName(predictions(spark, ["rf"]))
    assert ml.history(p).first().r2 is None


@pytest.mark.parametrize(("accuracy", "grid"), [(10_000, 200), (40, 20), (8, 4)])
def test_median_is_exact_in_any_split(spark, accuracy, grid):
    r = np.random.default_rng(3)
    rows = [("A", float(v)) for v in r.integers(0, 40, 201)] + [("B", float(v)) for v in r.lognormal(0, 4, 100)]
    rows += [("C", 5.0)] * 30 + [("D", None)] * 3 + [("D", 7.5)] + [("E", None)] + [(None, 1.0)] + [("F", -1.0), ("F", 2.0)]
    d = spark.createDataFrame(rows, "symbol string, volume double")
    got = {r.symbol: r["median"] for r in cl.exact_median(d, "volume", accuracy=accuracy, grid=grid).collect()}
    exp = {s: float(np.median([v for k, v in rows if k == s and v is not None])) for s in "ABCDF"}
    assert got == pytest.approx(exp)


def test_ticks_become_bars_by_hash_aggregation(spark):
    plan = plan_of(daily_bars(spark, SF001))
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    plan = plan_of(q_src_bars(spark, SF001))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_quotes_survive_a_lost_table(spark):
    from barflow.streaming.bars import read_quotes, run_latest_quotes, stored_batches
    ticks = tempfile.mkdtemp(prefix="barflow-ticks-")
    base = tempfile.mkdtemp(prefix="barflow-quotes-")
    out, ck = f"{base}/out", f"{base}/ck"

    def put(name, rows):
        d = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
        d = d.withColumn("ts", F.col("t").cast("timestamp_ntz")).select("event_id", "ts", "user_id", "event_type", "value", "props")
        d.coalesce(1).write.parquet(f"{ticks}/stage-{name}")
        import glob
        shutil.copy(glob.glob(f"{ticks}/stage-{name}/part-*.parquet")[0], f"{ticks}/events-{name}.parquet")

    put("1", [(1, "2024-01-01 00:00:00", 1, "A", 1.0, ""), (2, "2024-01-01 00:00:00", 1, "B", 2.0, "")])
    assert run_latest_quotes(spark, ticks, out, ck).count() == 2
    shutil.move(out, f"{base}/lost")
    assert read_quotes(spark, out).count() == 0
    put("2", [(3, "2024-01-02 00:00:00", 1, "A", 3.0, ""), (4, "2024-01-02 00:00:00", 1, "A", 4.0, "")])
    got = {r.symbol: (r.current_price, r.n_ticks) for r in run_latest_quotes(spark, ticks, out, ck).collect()}
    assert got == {"A": (4.0, 3), "B": (2.0, 1)}
    # Only what changed is written from now on, also after a restart, and merged in time.
    put("3", [(5, "2024-01-03 00:00:00", 1, "C", 7.0, "")])
    assert run_latest_quotes(spark, ticks, out, ck).count() == 3
    kind, last = stored_batches(spark, out)[-1]
    assert kind == "delta" and {r.symbol for r in spark.read.parquet(f"{out}/{kind}={last}").collect()} == {"C"}
    put("4", [(6, "2024-01-04 00:00:00", 1, "A", 9.0, "")])
    table = run_latest_quotes(spark, ticks, out, ck, compact_every=2)
    assert {r.symbol: (r.current_price, r.n_ticks) for r in table.collect()} == {"A": (9.0, 4), "B": (2.0, 1), "C": (7.0, 1)}
    assert [k for k, _ in stored_batches(spark, out)] == ["base"]
