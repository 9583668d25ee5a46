"""Benchmark the headline stages; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each stage is forced with the ``noop`` sink (full computation, nothing
collected to the driver) after one untimed warm-up on sf0.001. ``fit_*`` fit
on all model inputs (82 columns x 60 lags) with the parameters named;
``fit_forest_200x15`` and ``fit_boosted_200x7`` are the library's full settings
and run only if BENCH_FULL is set, because they take many minutes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from barflow.session import local_session
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)

    from barflow.operators import ensemble as en
    from barflow.operators import evaluate as ev
    from barflow.operators import models as ml
    from barflow.operators import training as tr
    from barflow.operators.layout import finish, layout_series
    from barflow.operators.regime import regime_features
    from barflow.operators.store import generate_features
    from barflow.operators.technical import technical_features
    from barflow.plans import queries as Q
    from barflow.plans import queries_ml as M
    from barflow.plans.queries_ticks import CONFIG, LAYOUTS, tick_series
    from barflow.sources.store import release

    def force(df):
        df.write.format("noop").mode("overwrite").save()

    def q_bars(d):
        force(Q.daily_bars(spark, d))

    def q_features(d):
        force(generate_features(Q.daily_bars(spark, d)))

    def q_tick_features(d):
        from pyspark.sql import functions as F
        layout = LAYOUTS["default"]
        laid = layout_series(tick_series(spark, d), order="at", layout=layout, bucket=F.col("year"))
        force(finish(regime_features(technical_features(laid, CONFIG, layout), layout=layout)))

    def q_regime(d):
        force(finish(regime_features(layout_series(Q.daily_bars(spark, d)))))

    def q_clean(d):
        force(Q.q_clean_outlier_cap(spark, d))

    def q_sequences(d):
        force(M.ml_samples(spark, d))

    def q_ensemble(d):
        p = M.pseudo_predictions(spark, d)
        e = en.combine(p, en.learn_weights(p, "val"))
        force(ev.metrics(en.individual(p, e)))

    def q_hourly(d):
        force(Q.hourly_bars(spark, d))

    stages = {
        "ticks_to_daily_bars": q_bars,
        "ticks_to_hourly_bars": q_hourly,
        "cleaning": q_clean,
        "features_73": q_features,
        "tick_series_features": q_tick_features,
        "regime_percentiles": q_regime,
        "sequences": q_sequences,
        "ensemble_metrics": q_ensemble,
    }
    for fn in stages.values():  # warm-up (JIT, class loading)
        fn("/root/testdata/sf0.001")
        release(spark)
    times = {}
    for name, fn in stages.items():
        t = time.time()
        fn(sf)
        times[name] = round(time.time() - t, 3)
        release(spark)

    # Fits on all model inputs; the scaled rows are written once, each reader builds the windows.
    t = time.time()
    rows, _ = tr.guarded(Q.daily_bars(spark, sf), generate_features, 60, 5)
    samples = tr.build_samples(rows, tr.model_columns(rows), "close", 60, 5)[0]
    force(samples)
    n = samples.count()
    times["samples_all_columns"] = round(time.time() - t, 3)
    specs = {
        "fit_forest_20x6": ml.ModelSpec("rf", "rf", dict(ml.RF_DEFAULTS, numTrees=20, maxDepth=6)),
        "fit_boosted_8x4": ml.ModelSpec("xgb", "gbt", dict(ml.GBT_DEFAULTS, maxIter=8, maxDepth=4, stepSize=0.1)),
        "fit_linear": ml.ModelSpec("linear", "linear", ml.LINEAR_DEFAULTS),
    }
    if os.environ.get("BENCH_FULL"):
        full = {s.name: s for s in ml.default_specs()}
        specs |= {"fit_forest_200x15": full["rf"], "fit_boosted_200x7": full["xgb"]}
    for name, spec in specs.items():
        t = time.time()
        ml.fit(samples, spec)
        times[name] = round(time.time() - t, 3)

    ticks = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    bars = Q.daily_bars(spark, sf).count()
    out = {
        "metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
        "cpus": cpus, "ticks": ticks, "daily_bars": bars, "samples": n,
        "ticks_per_sec": round(ticks / times["ticks_to_daily_bars"], 1),
        "feature_rows_per_sec": round(bars / times["features_73"], 1),
        "tick_feature_rows_per_sec": round(ticks / times["tick_series_features"], 1),
    }
    print(json.dumps(out))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
