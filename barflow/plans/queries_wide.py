"""Queries over all model inputs, dirty series, and whole training runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import clean as cl
from barflow.operators import dataset as ds
from barflow.operators import horizons as hz
from barflow.operators import models as ml
from barflow.operators import quality as dq
from barflow.operators import training as tr
from barflow.operators.layout import finish
from barflow.operators.store import generate_features, guard_min_rows
from barflow.plans import sql as S
from barflow.plans.queries import _COMPLETE, daily_bars, flagship_features, r6, register, rounded
from barflow.session import ensure_checkpoint_dir
from barflow.sources.store import cut_lineage
from barflow.sources.ticks import dirty_bars, table

# --- dirty series: every rule has rows that break it ---------------------------------

_DIRTY = """raw AS (SELECT o_orderpriority || '-' || CAST(o_custkey % 40 AS VARCHAR) AS symbol,
    CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN -o_totalprice ELSE o_totalprice END AS close,
    CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 3 = 0 THEN NULL
         WHEN o_orderkey % 103 = 0 THEN -CAST(o_custkey AS DOUBLE) ELSE CAST(o_custkey AS DOUBLE) END AS volume,
    o_orderkey AS arrival FROM orders),
dd AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY arrival DESC) = 1),
p AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad FROM dd WHERE date IS NOT NULL),
m AS (SELECT symbol, date, close, volume,
        CASE WHEN lag(pad) OVER (PARTITION BY symbol ORDER BY date) <> 0
             THEN pad / lag(pad) OVER (PARTITION BY symbol ORDER BY date) END - 1 AS change,
        date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap_days FROM p
      UNION ALL SELECT symbol, date, close, volume, NULL, NULL FROM dd WHERE date IS NULL),
rep AS (SELECT symbol, count(*) AS rows,
    greatest(avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END), avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END)) AS share,
    count(*) FILTER (WHERE close <= 0) AS nonpositive_close, count(*) FILTER (WHERE volume < 0) AS negative_volume,
    count(*) FILTER (WHERE abs(change) > 0.5) AS big_moves, count(*) FILTER (WHERE gap_days > 7) AS date_gaps,
    count(*) FILTER (WHERE date IS NULL) AS missing_keys FROM m GROUP BY symbol)"""


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    return cl.dedupe_last(dirty_bars(table(spark, sf, "orders"))).drop("arrival")


@register("dq_dirty_report", f"""WITH {_DIRTY}
SELECT symbol, rows, round(share, 6) AS max_null_share, nonpositive_close, negative_volume, big_moves, date_gaps, missing_keys,
  rows = 0 AS empty, share > 0.1 AS too_many_nulls,
  share <= 0.1 AND nonpositive_close = 0 AND negative_volume = 0 AND missing_keys = 0 AS passed FROM rep""")
def q_dq_dirty_report(spark, sf):
    return rounded(dq.quality_report(dirty(spark, sf)))


@register("dq_dirty_gaps", f"WITH {_DIRTY} SELECT symbol, date, CAST(gap_days AS INTEGER) AS gap_days FROM m WHERE gap_days > 7")
def q_dq_dirty_gaps(spark, sf):
    return dq.date_gaps(dirty(spark, sf))


@register("guard_short_symbols", f"""WITH {_DIRTY}
SELECT symbol, count(*) AS rows, count(*) >= 70 AS eligible,
  CASE WHEN count(*) < 70 THEN format('rows: need 70, got {{}}', count(*)) END AS reason FROM dd GROUP BY symbol""")
def q_guard_short_symbols(spark, sf):
    return guard_min_rows(dirty(spark, sf), 70)


# --- all model inputs -----------------------------------------------------------------

COLS = tr.feature_inputs()
_EXTRA = {"log_returns": "CASE WHEN returns + 1 > 0 THEN ln(returns + 1) END",
          "high_low_ratio": S.dv("high - low", "close"), "day_of_week": "isodow(date) - 1"}
_ROWS_SQL = f"""WITH RECURSIVE {S.CHAIN}{S.REGIME_FLAGS},
f AS (SELECT symbol, date, {', '.join(f'CAST({_EXTRA.get(c, c)} AS DOUBLE) AS {c}' for c in COLS)}
      FROM features2 WHERE {_COMPLETE}),
d AS (SELECT *, row_number() OVER ({S.W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM f)"""
_T, _TV = repr(ds.TRAIN_SPLIT), repr(ds.TRAIN_SPLIT + ds.VAL_SPLIT)
_WIDE_SQL = _ROWS_SQL + f""",
st AS (SELECT symbol, {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in COLS)}
       FROM d WHERE rn < floor(n * {_T}) GROUP BY symbol),
sc AS (SELECT d.symbol, d.date, d.rn, d.n, {', '.join(
    f"CASE WHEN hi_{c} = lo_{c} THEN 0.0 ELSE {S.dv(f'{c} - lo_{c}', f'hi_{c} - lo_{c}')} END AS {c}_s" for c in COLS)}
  FROM d JOIN st USING (symbol)),
w AS (SELECT symbol, date, rn, n, close_s, {' + '.join(f'{i + 1} * {c}_s' for i, c in enumerate(COLS))} AS placed,
        {' + '.join(f'{c}_s' for c in COLS)} AS plain FROM sc),
seq AS (SELECT symbol, date, rn - {ds.LOOKBACK} AS idx, n - {ds.LOOKBACK} - {ds.HORIZON} + 1 AS n_samples,
  list(placed) OVER ({S.W} ROWS BETWEEN {ds.LOOKBACK} PRECEDING AND 1 PRECEDING) AS placed,
  list(plain) OVER ({S.W} ROWS BETWEEN {ds.LOOKBACK} PRECEDING AND 1 PRECEDING) AS plain,
  lead(close_s, {ds.HORIZON - 1}) OVER ({S.W}) AS label FROM w)"""
_STEPS = f"list_transform(range(1, {ds.LOOKBACK + 1}), lambda x: CAST(x AS DOUBLE))"


def wide_scaled(spark: SparkSession, sf: str) -> DataFrame:
    rows = ds.renumber(flagship_features(spark, sf).select("symbol", "date", *COLS))
    return ds.apply_minmax(rows, ds.fit_minmax(rows, COLS), COLS)


def wide_samples(spark: SparkSession, sf: str) -> DataFrame:
    return ds.sequences(wide_scaled(spark, sf), [c + "_s" for c in COLS], "close_s")


def _weighted(values, weight) -> F.Column:
    """Sum of ``weight(position) * value`` over an array, positions from 0."""
    return F.aggregate(F.transform(values, lambda x, i: x * weight(i)), F.lit(0.0), lambda a, x: a + x)


@register("ds_minmax_all", _WIDE_SQL + f"\nSELECT symbol, date, {', '.join(f'{S.r6(c + "_s")} AS {c}_s' for c in COLS)} FROM sc")
def q_ds_minmax_all(spark, sf):
    return rounded(finish(wide_scaled(spark, sf)).select("symbol", "date", *[c + "_s" for c in COLS]))


@register("ds_sequences_all", _WIDE_SQL + f"""
SELECT symbol, date, idx, n_samples, len(placed) AS n_lags, {len(COLS)} AS n_columns,
  floor(list_dot_product(placed, {_STEPS}) / 10000.0 * 1000.0 + 0.5) / 1000.0 AS placed_sum, {S.r6('label')} AS label
FROM seq WHERE idx >= 0 AND idx < n_samples""")
def q_ds_sequences_all(spark, sf):
    """Every window as the sum of value x column position x lag position, so
    that a permuted window or column shows."""
    per_row = F.transform("window", lambda row: _weighted(row, lambda i: i + 1.0))
    total = _weighted(per_row, lambda i: i + 1.0) / 10000.0
    return wide_samples(spark, sf).select(
        "symbol", "date", "idx", "n_samples", F.size("window").cast("long").alias("n_lags"),
        F.size(F.element_at("window", 1)).alias("n_columns"), r6(total, 3).alias("placed_sum"), r6(F.col("label")).alias("label"))


@register("ds_flatten_all", _WIDE_SQL + f"""
SELECT symbol, date, len(plain) * {len(COLS)} AS n_values,
  floor((list_dot_product(plain, list_transform({_STEPS}, lambda x: (x - 1) * {len(COLS)})) + list_sum(placed)) / 10000.0 * 1000.0 + 0.5)
    / 1000.0 AS placed_sum
FROM seq WHERE idx >= 0 AND idx < n_samples""")
def q_ds_flatten_all(spark, sf):
    flat = ds.flatten_window(wide_samples(spark, sf), vector=False)
    return flat.select("symbol", "date", F.size("flat").cast("long").alias("n_values"),
                       r6(_weighted(F.col("flat"), lambda i: i + 1.0) / 10000.0, 3).alias("placed_sum"))


@register("fs_generate_all", S.feature_sql([c for c in COLS if c not in _EXTRA and c not in ("open", "high", "low", "close", "volume")], _COMPLETE))
def q_fs_generate_all(spark, sf):
    cols = [c for c in COLS if c not in _EXTRA and c not in ("open", "high", "low", "close", "volume")]
    return rounded(flagship_features(spark, sf).select("symbol", "date", *cols))


# --- whole training runs ----------------------------------------------------------------
# The chain with all inputs and fewer, shallower trees than the library's defaults
# (barflow.operators.models.default_specs), so that a run ends in about a minute.
RUN_SPECS = [ml.ModelSpec("rf", "rf", dict(ml.RF_DEFAULTS, numTrees=20, maxDepth=6)),
             ml.ModelSpec("xgb", "gbt", dict(ml.GBT_DEFAULTS, maxIter=8, maxDepth=4, stepSize=0.1)),
             ml.ModelSpec("linear", "linear", dict(ml.LINEAR_DEFAULTS, maxIter=30))]

_COUNTS_SQL = _ROWS_SQL + f""",
c AS (SELECT symbol, max(date) AS last_date, max(n) - {ds.LOOKBACK} - {ds.HORIZON} + 1 AS k FROM d GROUP BY symbol
      HAVING max(n) >= {ds.LOOKBACK + ds.HORIZON + 100} AND max(n) - {ds.LOOKBACK} - {ds.HORIZON} + 1 >= 150),
t AS (SELECT symbol, last_date, CAST(floor(k * {_T}) AS BIGINT) AS n_train, CAST(floor(k * {_TV}) - floor(k * {_T}) AS BIGINT) AS n_val,
        CAST(k - floor(k * {_TV}) AS BIGINT) AS n_test FROM c)"""


@register("train_ensemble", _COUNTS_SQL + f"""
SELECT symbol, model, n_train, n_val, n_test, {len(COLS)} AS n_columns, n_test AS n, true AS finite, true AS weights_sum_to_one,
  true AS ensemble_from_parts
FROM t, (VALUES ('rf'), ('xgb'), ('linear'), ('ensemble')) v(model)""")
def q_train_ensemble(spark, sf):
    """Train three models and the ensemble on all inputs; the metrics' rows and what can be said exactly of them."""
    run = tr.train(daily_bars(spark, sf), RUN_SPECS)
    finite = F.lit(True)
    for m in ("mse", "rmse", "mae", "r2", "mape"):
        finite = finite & F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf"))
    total = run.weights.groupBy("symbol").agg((F.abs(F.sum("weight") - 1) < 1e-9).alias("weights_sum_to_one"))
    p = run.predictions.where("split = 'test'")
    parts = p.where("model <> 'ensemble'").join(run.weights.select("symbol", "model", "weight"), ["symbol", "model"]) \
             .groupBy("symbol", "date").agg(F.sum(F.col("weight") * F.col("yhat")).alias("sum"))
    same = p.where("model = 'ensemble'").join(parts, ["symbol", "date"]).groupBy("symbol").agg(
        F.min((F.abs(F.col("yhat") - F.col("sum")) <= 1e-6 * F.greatest(F.abs("sum"), F.lit(1.0))).cast("int")).alias("ok"))
    return tr.run_summary(run).join(run.metrics.select("symbol", "model", "n"), ["symbol", "model"]).join(total, "symbol").join(same, "symbol").select(
        "symbol", "model", "n_train", "n_val", "n_test", "n_columns", "n", finite.alias("finite"), "weights_sum_to_one",
        (F.col("ok") == 1).alias("ensemble_from_parts"))


def _near(a, b):
    return F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.abs(b), F.lit(1.0)), F.lit(False))


@register("sink_model", _COUNTS_SQL + """
SELECT symbol, model, n_train + n_val + n_test AS n, true AS same FROM t, (VALUES ('rf'), ('xgb'), ('linear'), ('ensemble')) v(model)""")
def q_sink_model(spark, sf):
    """A whole run (scaler, lag step, three models) stored as one pipeline, loaded, and applied to the raw
    feature rows: predictions equal those of the run."""
    run = tr.train(daily_bars(spark, sf), RUN_SPECS)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    tr.save_run(run, path)
    again = tr.load_run(spark, path).predict(run.rows).select("symbol", "date", "model", F.col("yhat").alias("again"))
    both = run.predictions.join(again, ["symbol", "date", "model"])
    return both.groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("n"), (F.min(_near(F.col("again"), F.col("yhat")).cast("int")) == 1).alias("same"))


# --- direct forecasts ------------------------------------------------------------------------
# Every step of a path is predicted by models fitted on samples of all steps (barflow.operators.horizons).

@register("fc_horizon_samples", _WIDE_SQL + f""",
j AS (SELECT a.symbol, a.date, a.rn, b.rn - a.rn AS step, a.n, b.close_s - a.close_s AS label
      FROM sc a JOIN sc b ON b.symbol = a.symbol AND b.rn > a.rn AND b.rn <= a.rn + 30),
p AS (SELECT *, CASE WHEN rn + step < floor(n * {_T}) THEN 'train' WHEN rn >= floor(n * {_T}) AND rn + step < floor(n * {_TV}) THEN 'val'
        WHEN rn >= floor(n * {_TV}) THEN 'test' END AS split FROM j)
SELECT symbol, date, CAST(step AS INTEGER) AS step, split, {S.r6('label')} AS label FROM p WHERE split IS NOT NULL""")
def q_fc_horizon_samples(spark, sf):
    """The samples of a 30-step direct forecast: every input row with every step, its part and its label."""
    rows = flagship_features(spark, sf).select("symbol", "date", *COLS)
    stats = cut_lineage(ds.fit_minmax(ds.renumber(rows), COLS), "scaler")
    inputs = cut_lineage(hz.horizon_inputs(rows, stats, COLS, "close"), "horizon-inputs")
    labels = hz.horizon_labels(inputs, 30).join(inputs.select("symbol", "rn", "date"), ["symbol", "rn"])
    return rounded(labels.select("symbol", "date", "step", "split", "label"))


def _forecast(spark, sf, steps):
    """Train for all steps, store, load again and forecast."""
    rows, _ = tr.guarded(daily_bars(spark, sf), generate_features, ds.LOOKBACK, ds.HORIZON)
    run, _, _ = hz.train_horizons(rows, tr.model_columns(rows), RUN_SPECS, steps=steps)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    hz.save_horizons(run, path)
    again = hz.load_horizons(spark, path)
    return again, hz.horizon_tables(again, rows)


def _forecast_sql(steps: int) -> str:
    return _COUNTS_SQL + f""",
days AS (SELECT symbol, CAST(unnest(generate_series(last_date + INTERVAL 1 DAY, last_date + INTERVAL {2 * steps + 3} DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM t),
s AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS step FROM days WHERE isodow(date) < 6)
SELECT symbol, CAST(step AS INTEGER) AS step, date, true AS bounded, true AS finite, 3 AS n_models, true AS weighted, true AS spread,
  true AS bent FROM s WHERE step <= {steps}"""


@register("fc_future_90", _forecast_sql(90))
def q_fc_future_90(spark, sf):
    """Trained models -> 90-step path with bounds and change, as one chain. ``weighted`` and
    ``spread``: the path's price and deviation follow from the models' own prices for that step;
    ``bent``: the symbol's path is no straight line."""
    fitted, t = _forecast(spark, sf, 90)
    p = t["path"]
    own = t["parts"].where("model <> 'ensemble'").join(fitted.weights.select("symbol", "model", "weight"), ["symbol", "model"]) \
        .groupBy("symbol", "step").agg(
            F.count(F.lit(1)).cast("int").alias("n_models"), F.sum(F.col("weight") * F.col("prediction")).alias("sum"),
            F.sqrt(F.avg(F.col("prediction") * F.col("prediction")) - F.avg("prediction") * F.avg("prediction")).alias("sd"))
    pace = p.join(t["last"].withColumnRenamed("last_known_price", "last"), "symbol") \
            .select("symbol", ((F.col("prediction") - F.col("last")) / F.col("step")).alias("pace"), "last") \
            .groupBy("symbol").agg((F.stddev_pop("pace") > 1e-6 * F.max("last")).alias("bent"))
    bounded = (F.col("lower") <= F.col("prediction")) & (F.col("prediction") <= F.col("upper"))
    return p.join(own, ["symbol", "step"]).join(pace, "symbol").select(
        "symbol", "step", "date", bounded.alias("bounded"), (F.col("change_pct").isNotNull() & F.col("std").isNotNull()).alias("finite"),
        "n_models", _near(F.col("prediction"), F.col("sum")).alias("weighted"),
        (F.abs(F.col("std") - F.coalesce(F.col("sd"), F.lit(0.0))) <= 1e-6 * F.col("prediction")).alias("spread"), "bent")


@register("fc_horizon_evaluation", _WIDE_SQL + """,
h AS (SELECT a.symbol, a.rn, CAST(k.step AS INTEGER) AS step, a.n FROM sc a, (SELECT unnest(range(1, 11)) AS step) k WHERE a.rn + k.step < a.n)
SELECT step, count(*) AS n, true AS in_range, true AS covered FROM h WHERE rn >= floor(n * """ + _TV + """) GROUP BY step""")
def q_fc_horizon_evaluation(spark, sf):
    """Errors of ten direct steps on held-out samples, and the share of closes inside the interval of
    the models' spread. ``in_range``: the errors agree with each other; ``covered``: a share."""
    rows = flagship_features(spark, sf).select("symbol", "date", *COLS)
    run, inputs, labels = hz.train_horizons(rows, COLS, RUN_SPECS, steps=10)
    e = hz.horizon_evaluation(run, inputs, labels)
    ok = (F.col("mae") <= F.col("rmse")) & (F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) <= 1e-6 * F.col("mse")) & (F.col("r2") <= 1)
    return e.select("step", "n", F.coalesce(ok, F.lit(False)).alias("in_range"), F.col("coverage").between(0.0, 1.0).alias("covered"))


@register("fc_future_recommendation", _COUNTS_SQL + """
SELECT symbol, 30 AS n_steps, true AS action_follows, true AS confidence_follows, true AS level_follows, true AS has_reason FROM t""")
def q_fc_future_recommendation(spark, sf):
    """Trained models -> 30-step path -> summary -> recommendation. Action, confidence and level are
    worked out once more from the rows of the path and its parts, and must be equal."""
    _, t = _forecast(spark, sf, 30)
    end = t["parts"].where("step = 30").join(t["last"], "symbol").withColumn("move", F.col("prediction") - F.col("last_known_price"))
    whole = end.where("model = 'ensemble'").select("symbol", F.col("move").alias("main"), (100 * F.col("move") / F.col("last_known_price")).alias("pct"))
    share = end.where("model <> 'ensemble'").join(whole.select("symbol", "main"), "symbol").groupBy("symbol") \
               .agg((F.count_if(F.signum("move") == F.signum("main")) / F.count(F.lit(1))).alias("share"))
    rec = t["recommendation"].join(t["summary"].select("symbol", "n_steps"), "symbol").join(whole, "symbol").join(share, "symbol")
    action = F.when(F.col("pct") > 2, "BUY").when(F.col("pct") < -2, "SELL").otherwise("HOLD")
    level = F.when(F.col("share") == 1, "High").when(F.col("share") >= 0.5, "Medium").otherwise("Low")
    return rec.select("symbol", F.col("n_steps").cast("int").alias("n_steps"), (F.col("action") == action).alias("action_follows"),
                      _near(F.col("confidence"), F.col("share")).alias("confidence_follows"),
                      (F.col("confidence_level") == level).alias("level_follows"), F.col("reason").contains("over 30 steps").alias("has_reason"))
