"""Registered queries for the modelling stages: dataset, ensemble, evaluation,
forecast, backtest (all SQL-checked on a deterministic prediction table), the
``pyspark.ml`` fits (rows-checked), company/quote sources and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.functions.frames import full, lag, series_window
from barflow.operators import dataset as ds
from barflow.operators import ensemble as en
from barflow.operators import evaluate as ev
from barflow.operators import forecast as fc
from barflow.operators.layout import finish, layout_series
from barflow.plans import sql as S
from barflow.plans.queries import daily_bars, register, rounded
from barflow.sources.store import cut_lineage
from barflow.sources.ticks import table

DS_COLS = ["close", "volume", "returns", "sma_10"]
SCALED = [c + "_s" for c in DS_COLS]
LOOKBACK, HORIZON = ds.LOOKBACK, ds.HORIZON
_TV = repr(ds.TRAIN_SPLIT + ds.VAL_SPLIT)
_T = repr(ds.TRAIN_SPLIT)


# --- dataset inputs -------------------------------------------------------------

def ds_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Complete rows of a compact feature set, renumbered and laid out."""
    d = layout_series(daily_bars(spark, sf))
    d = d.select("*", (F.try_divide(F.col("close"), lag("close")) - 1).alias("returns"),
                 full(10, F.avg, "close").alias("sma_10"))
    d = finish(d).select("symbol", "date", *DS_COLS).na.drop()
    return ds.renumber(d)


def ds_scaled(spark: SparkSession, sf: str):
    rows = ds_rows(spark, sf)
    stats = ds.fit_minmax(rows, DS_COLS, fit_on="train")
    return ds.apply_minmax(rows, stats, DS_COLS), stats


def ds_samples(spark: SparkSession, sf: str, horizon: int = HORIZON) -> DataFrame:
    scaled, _ = ds_scaled(spark, sf)
    return ds.sequences(scaled, SCALED, "close_s", LOOKBACK, horizon)


_DS_SQL = S.BARS + f""",
d0 AS (SELECT symbol, date, close, volume, {S.dv('close', f'lag(close) OVER ({S.W})')} - 1 AS returns,
         {S.full(10, 'avg', 'close')} AS sma_10 FROM bars),
d AS (SELECT *, row_number() OVER ({S.W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n
      FROM d0 WHERE returns IS NOT NULL AND sma_10 IS NOT NULL),
st AS (SELECT symbol, min(close) AS c_lo, max(close) AS c_hi, min(volume) AS v_lo, max(volume) AS v_hi,
         min(returns) AS r_lo, max(returns) AS r_hi, min(sma_10) AS m_lo, max(sma_10) AS m_hi
       FROM d WHERE rn < floor(n * {_T}) GROUP BY symbol),
sc AS (SELECT d.symbol, d.date, d.rn, d.n, d.close, st.c_lo, st.c_hi,
  CASE WHEN c_hi = c_lo THEN 0.0 ELSE {S.dv('close - c_lo', 'c_hi - c_lo')} END AS close_s,
  CASE WHEN v_hi = v_lo THEN 0.0 ELSE {S.dv('volume - v_lo', 'v_hi - v_lo')} END AS volume_s,
  CASE WHEN r_hi = r_lo THEN 0.0 ELSE {S.dv('returns - r_lo', 'r_hi - r_lo')} END AS returns_s,
  CASE WHEN m_hi = m_lo THEN 0.0 ELSE {S.dv('sma_10 - m_lo', 'm_hi - m_lo')} END AS sma_10_s
  FROM d JOIN st USING (symbol))"""


def _seq_sql(h: int) -> str:
    fr = f"OVER ({S.W} ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)"
    return _DS_SQL + f""",
seq AS (SELECT symbol, date, rn - {LOOKBACK} AS idx, n - {LOOKBACK} - {h} + 1 AS n_samples,
  count(*) {fr} AS n_lags, sum(close_s + volume_s + returns_s + sma_10_s) {fr} AS window_sum,
  lag(close_s, {LOOKBACK}) OVER ({S.W}) AS first_value, lag(sma_10_s, 1) OVER ({S.W}) AS last_value,
  lead(close_s, {h - 1}) OVER ({S.W}) AS label FROM sc)"""


def _samples_out(s: DataFrame) -> DataFrame:
    total = F.aggregate(F.flatten("window"), F.lit(0.0), lambda a, x: a + x)
    return rounded(s.select("symbol", "date", "idx", "n_samples", F.size("window").alias("n_lags"),
                            total.alias("window_sum"), "label"))


_SEQ_SELECT = """SELECT symbol, date, idx, n_samples, n_lags, round(window_sum, 6) AS window_sum,
  round(label, 6) AS label FROM seq WHERE idx >= 0 AND idx < n_samples"""


@register("ds_minmax", "WITH " + _DS_SQL + """
SELECT symbol, date, round(close_s, 6) AS close_s, round(volume_s, 6) AS volume_s,
  round(returns_s, 6) AS returns_s, round(sma_10_s, 6) AS sma_10_s FROM sc""")
def q_ds_minmax(spark, sf):
    scaled, _ = ds_scaled(spark, sf)
    return rounded(finish(scaled).select("symbol", "date", *SCALED))


@register("ds_inverse_scale", "WITH " + _DS_SQL + """
SELECT symbol, date, round(close_s * (c_hi - c_lo) + c_lo, 6) AS close_restored FROM sc""")
def q_ds_inverse_scale(spark, sf):
    scaled, stats = ds_scaled(spark, sf)
    d = ds.inverse_minmax(scaled, stats, "close_s", "close", "close_restored")
    return rounded(finish(d).select("symbol", "date", "close_restored"))


@register("ds_sequences", "WITH " + _seq_sql(HORIZON) + "\n" + _SEQ_SELECT)
def q_ds_sequences(spark, sf):
    return _samples_out(ds_samples(spark, sf))


@register("ds_sequences_h1", "WITH " + _seq_sql(1) + "\n" + _SEQ_SELECT)
def q_ds_sequences_h1(spark, sf):
    return _samples_out(ds_samples(spark, sf, 1))


@register("ds_flatten", "WITH " + _seq_sql(HORIZON) + """
SELECT symbol, date, n_lags * 4 AS n_values, round(first_value, 6) AS first_value,
  round(last_value, 6) AS last_value FROM seq WHERE idx >= 0 AND idx < n_samples""")
def q_ds_flatten(spark, sf):
    s = ds.flatten_window(ds_samples(spark, sf), vector=False)
    return rounded(s.select("symbol", "date", F.size("flat").alias("n_values"),
                            F.element_at("flat", 1).alias("first_value"),
                            F.element_at("flat", -1).alias("last_value")))


@register("ds_split", "WITH " + _seq_sql(HORIZON) + f""",
s AS (SELECT * FROM seq WHERE idx >= 0 AND idx < n_samples)
SELECT symbol, CASE WHEN idx < floor(n_samples * {_T}) THEN 'train'
  WHEN idx < floor(n_samples * {_TV}) THEN 'val' ELSE 'test' END AS split,
  count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM s GROUP BY ALL""")
def q_ds_split(spark, sf):
    s = ds.split_samples(ds_samples(spark, sf))
    return s.groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"),
                                            F.max("date").alias("last_date"))


@register("ds_walk_forward", "WITH " + _seq_sql(HORIZON) + f""",
s AS (SELECT * FROM seq WHERE idx >= 0 AND idx < n_samples),
f0 AS (SELECT s.*, unnest(range(0, {ds.N_SPLITS})) AS fold FROM s),
f AS (SELECT *, floor(n_samples / {ds.N_SPLITS + 1}) AS sz,
        n_samples - ({ds.N_SPLITS} - fold) * floor(n_samples / {ds.N_SPLITS + 1}) AS ts0 FROM f0),
g AS (SELECT *, CASE WHEN idx >= ts0 AND idx < ts0 + sz THEN 'test'
                     WHEN idx < ts0 - {ds.GAP} THEN 'train' END AS role FROM f)
SELECT symbol, CAST(fold AS INTEGER) AS fold, role, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx
FROM g WHERE role IS NOT NULL GROUP BY ALL""")
def q_ds_walk_forward(spark, sf):
    w = ds.walk_forward(ds_samples(spark, sf))
    return w.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"),
                                                   F.min("idx").alias("first_idx"),
                                                   F.max("idx").alias("last_idx"))


# --- deterministic prediction table (three "models") ------------------------------------

def pseudo_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``y = close``; models: previous close, mean of the previous 10 and of
    the previous 20 closes; incomplete rows removed; 70/15/15 split by
    position. Stand-in input for the ensemble/evaluation operators."""
    d = layout_series(daily_bars(spark, sf))
    w = series_window()
    prev = {n: w.rowsBetween(-n, -1) for n in (10, 20)}
    d = d.select("*", lag("close").alias("lag1"),
                 *[F.when(F.count("close").over(prev[n]) == n, F.avg("close").over(prev[n])).alias(f"sma{n}")
                   for n in (10, 20)])
    d = finish(d).select("symbol", "date", F.col("close").alias("y"), "lag1", "sma10", "sma20").na.drop()
    d = ds.renumber(d)
    d = finish(d.withColumn("split", ds._row_split(F.col("n_rows"), F.col("rn"), ds.TRAIN_SPLIT, ds.VAL_SPLIT)))
    # Ensembles, metrics and paths each read the predictions more than once.
    d = cut_lineage(d, "predictions")
    return d.select("symbol", "date", "split", "y",
                    F.expr("stack(3, 'lag1', lag1, 'sma10', sma10, 'sma20', sma20) AS (model, yhat)"))


_PRED_SQL = S.BARS + f""",
p0 AS (SELECT symbol, date, close AS y, lag(close) OVER ({S.W}) AS lag1,
  CASE WHEN count(close) OVER ({S.W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 10
       THEN avg(close) OVER ({S.W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS sma10,
  CASE WHEN count(close) OVER ({S.W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20
       THEN avg(close) OVER ({S.W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS sma20 FROM bars),
p1 AS (SELECT *, row_number() OVER ({S.W}) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n
       FROM p0 WHERE lag1 IS NOT NULL AND sma10 IS NOT NULL AND sma20 IS NOT NULL),
p2 AS (SELECT *, CASE WHEN idx < floor(n * {_T}) THEN 'train' WHEN idx < floor(n * {_TV}) THEN 'val'
                      ELSE 'test' END AS split FROM p1),
preds AS (SELECT symbol, date, split, y, 'lag1' AS model, lag1 AS yhat FROM p2
          UNION ALL SELECT symbol, date, split, y, 'sma10', sma10 FROM p2
          UNION ALL SELECT symbol, date, split, y, 'sma20', sma20 FROM p2),
mse AS (SELECT symbol, model, avg((y - yhat) * (y - yhat)) AS mse FROM preds WHERE split = 'val' GROUP BY ALL),
wts AS (SELECT symbol, model, mse, (1.0 / (mse + {en.EPS!r})) / sum(1.0 / (mse + {en.EPS!r})) OVER (PARTITION BY symbol) AS weight FROM mse),
ens AS (SELECT p.symbol, p.date, p.split, max(p.y) AS y, 'ensemble' AS model, sum(w.weight * p.yhat) AS yhat
        FROM preds p JOIN wts w USING (symbol, model) GROUP BY p.symbol, p.date, p.split),
unc AS (SELECT symbol, date, split, max(y) AS y, avg(yhat) AS mean, stddev_pop(yhat) AS std, count(*) AS n_models
        FROM preds GROUP BY ALL),
allp AS (SELECT symbol, date, split, model, y, yhat FROM preds UNION ALL SELECT symbol, date, split, model, y, yhat FROM ens),
met AS (SELECT symbol, model, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
          avg(abs(y - yhat)) AS mae,
          1 - {S.dv('sum((y - yhat) * (y - yhat))', 'count(*) * var_pop(y)')} AS r2,
          avg(abs({S.dv('y - yhat', 'y')})) * 100.0 AS mape, count(*) AS n
        FROM allp WHERE split = 'test' GROUP BY ALL)"""


def _preds_and_ensemble(spark, sf):
    p = pseudo_predictions(spark, sf)
    w = cut_lineage(en.learn_weights(p, "val"), "weights")
    e = cut_lineage(en.combine(p, w), "ensemble")
    return p, w, e


@register("ens_weights", f"WITH {_PRED_SQL} SELECT symbol, model, round(mse, 2) AS mse, round(weight, 6) AS weight FROM wts")
def q_ens_weights(spark, sf):
    return rounded(en.learn_weights(pseudo_predictions(spark, sf), "val"))


@register("ens_predict", f"WITH {_PRED_SQL} SELECT symbol, date, split, model, round(y, 6) AS y, round(yhat, 6) AS yhat FROM ens")
def q_ens_predict(spark, sf):
    _, _, e = _preds_and_ensemble(spark, sf)
    return rounded(e.select("symbol", "date", "split", "model", "y", "yhat"))


@register("ens_uncertainty", f"""WITH {_PRED_SQL} SELECT symbol, date, split, round(y, 6) AS y,
  round(mean, 6) AS mean, round(std, 6) AS std, n_models FROM unc""")
def q_ens_uncertainty(spark, sf):
    return rounded(en.uncertainty(pseudo_predictions(spark, sf)))


@register("ens_individual", f"""WITH {_PRED_SQL} SELECT symbol, date, split, model, round(y, 6) AS y,
  round(yhat, 6) AS yhat FROM allp""")
def q_ens_individual(spark, sf):
    p, _, e = _preds_and_ensemble(spark, sf)
    return rounded(en.individual(p, e))


_MET_COLS = "round(mse, 2) AS mse, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, round(mape, 6) AS mape, n"


@register("eval_metrics", f"WITH {_PRED_SQL} SELECT symbol, model, {_MET_COLS} FROM met WHERE model <> 'ensemble'")
def q_eval_metrics(spark, sf):
    return rounded(ev.metrics(pseudo_predictions(spark, sf)))


@register("eval_all", f"WITH {_PRED_SQL} SELECT symbol, upper(model) AS model, {_MET_COLS} FROM met")
def q_eval_all(spark, sf):
    p, _, e = _preds_and_ensemble(spark, sf)
    return rounded(ev.comparison(ev.metrics(en.individual(p, e))))


@register("eval_best_model", f"""WITH {_PRED_SQL},
lng AS (SELECT symbol, model, 'mse' AS metric, mse AS value, mse AS score FROM met
  UNION ALL SELECT symbol, model, 'rmse', rmse, rmse FROM met
  UNION ALL SELECT symbol, model, 'mae', mae, mae FROM met
  UNION ALL SELECT symbol, model, 'r2', r2, -r2 FROM met
  UNION ALL SELECT symbol, model, 'mape', mape, mape FROM met)
SELECT symbol, metric, model AS best_model, round(value, 6) AS value FROM lng
QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY score ASC NULLS LAST, model) = 1""")
def q_eval_best_model(spark, sf):
    p, _, e = _preds_and_ensemble(spark, sf)
    return rounded(ev.best_models(ev.metrics(en.individual(p, e))))


# --- forecast tables on the test-split path ------------------------------------------------

def _path(spark, sf):
    """Test-split path of the ensemble with the spread of its models; steps are positions of the block layout."""
    p, _, e = _preds_and_ensemble(spark, sf)
    test = F.col("split") == "test"
    spread = en.uncertainty(p.where(test)).select("symbol", "date", "std")
    bars = e.where(test).select("symbol", "date", F.col("yhat").alias("prediction")).join(spread, ["symbol", "date"])
    path = finish(layout_series(bars), keep_rn=True)
    path = cut_lineage(path.select("symbol", (F.col("rn") + 1).cast("int").alias("step"), "date", "prediction", "std"), "path")
    last = (p.where(~test).where(F.col("model") == "lag1")
              .groupBy("symbol").agg(F.max_by("y", "date").alias("last_known_price")))
    return p, e, path, cut_lineage(last, "last-price")


_PATH_SQL = _PRED_SQL + """,
path AS (SELECT e.symbol, row_number() OVER (PARTITION BY e.symbol ORDER BY e.date) AS step, e.date,
           e.yhat AS prediction, u.std FROM ens e JOIN unc u USING (symbol, date) WHERE e.split = 'test'),
lastp AS (SELECT symbol, arg_max(y, date) AS last_known_price FROM p2 WHERE split <> 'test' GROUP BY symbol),
summ AS (SELECT symbol, arg_max(prediction, step) AS final_prediction, min(prediction) AS min_price,
           max(prediction) AS max_price, 100.0 * stddev_samp(r) AS volatility, count(*) AS n_steps
         FROM (SELECT *, prediction / lag(prediction) OVER (PARTITION BY symbol ORDER BY step) - 1 AS r FROM path)
         GROUP BY symbol),
fin AS (SELECT symbol, model, arg_max(yhat, date) AS final_prediction FROM allp WHERE split = 'test' GROUP BY ALL),
agree AS (SELECT b.symbol, avg(CASE WHEN sign(b.final_prediction - l.last_known_price)
                                        = sign(e.final_prediction - l.last_known_price) THEN 1.0 ELSE 0.0 END) AS agreement
          FROM fin b JOIN fin e ON e.symbol = b.symbol AND e.model = 'ensemble' AND b.model <> 'ensemble'
          JOIN lastp l ON l.symbol = b.symbol GROUP BY b.symbol),
fsum AS (SELECT s.*, l.last_known_price,
           100.0 * (s.final_prediction - l.last_known_price) / l.last_known_price AS predicted_change
         FROM summ s JOIN lastp l USING (symbol))"""


@register("fc_interval", f"""WITH {_PATH_SQL} SELECT symbol, step, date, round(prediction, 6) AS prediction,
  round(std, 6) AS std, round(prediction - 1.96 * std, 6) AS lower, round(prediction + 1.96 * std, 6) AS upper FROM path""")
def q_fc_interval(spark, sf):
    _, _, path, _ = _path(spark, sf)
    return rounded(fc.intervals(path))


@register("fc_change", f"""WITH {_PATH_SQL} SELECT p.symbol, p.step, round(100.0 * (p.prediction - l.last_known_price)
  / l.last_known_price, 6) AS change_pct FROM path p JOIN lastp l USING (symbol)""")
def q_fc_change(spark, sf):
    _, _, path, last = _path(spark, sf)
    return rounded(fc.change_from_last(path, last).select("symbol", "step", "change_pct"))


@register("fc_summary", f"""WITH {_PATH_SQL} SELECT symbol, round(last_known_price, 6) AS last_known_price,
  round(final_prediction, 6) AS final_prediction, round(predicted_change, 6) AS predicted_change,
  round(min_price, 6) AS min_price, round(max_price, 6) AS max_price, round(volatility, 6) AS volatility, n_steps FROM fsum""")
def q_fc_summary(spark, sf):
    _, _, path, last = _path(spark, sf)
    return rounded(fc.summary(path, last))


@register("fc_recommendation", f"""WITH {_PATH_SQL}
SELECT f.symbol, CASE WHEN predicted_change > 2.0 THEN 'BUY' WHEN predicted_change < -2.0 THEN 'SELL' ELSE 'HOLD' END AS action,
  round(a.agreement, 6) AS confidence,
  CASE WHEN a.agreement >= 0.99 THEN 'High' WHEN a.agreement >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_level,
  round(predicted_change, 6) AS trend_strength,
  printf('Predicted change %.2f%% over %d steps', predicted_change, n_steps) AS reason
FROM fsum f LEFT JOIN agree a USING (symbol)""")
def q_fc_recommendation(spark, sf):
    p, e, path, last = _path(spark, sf)
    allp = en.individual(p, e).where(F.col("split") == "test")
    final = allp.groupBy("symbol", "model").agg(F.max_by("yhat", "date").alias("final_prediction"))
    rec = fc.recommend(fc.summary(path, last), fc.model_agreement(final, last))
    return rounded(rec)


@register("bt_backtest", f"""WITH {_PRED_SQL},
t AS (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY date DESC) AS k FROM allp),
t1 AS (SELECT *, lag(y) OVER (PARTITION BY symbol, model ORDER BY date) AS py FROM t WHERE k <= 31)
SELECT symbol, model, round(1 - {S.dv('sum((y - yhat) * (y - yhat))', 'count(*) * var_pop(y)')}, 6) AS r2,
  round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse,
  round(avg(abs({S.dv('y - yhat', 'y')})) * 100.0, 6) AS mape,
  round(avg(CASE WHEN py IS NULL THEN NULL WHEN sign(y - py) = sign(yhat - py) THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS directional_accuracy
FROM t1 WHERE k <= 30 GROUP BY ALL""")
def q_bt_backtest(spark, sf):
    p, _, e = _preds_and_ensemble(spark, sf)
    return rounded(fc.backtest(en.individual(p, e), 30))


@register("bt_error_dist", f"""WITH {_PRED_SQL},
er AS (SELECT symbol, model, yhat - y AS err FROM allp WHERE split = 'test'),
rg AS (SELECT symbol, model, min(err) AS lo, max(err) AS hi FROM er GROUP BY ALL),
bk AS (SELECT er.symbol, er.model, CAST(coalesce(least(floor({S.dv('err - lo', 'hi - lo')} * 20), 19), 0) AS INTEGER) AS bin, lo, hi
       FROM er JOIN rg USING (symbol, model))
SELECT symbol, model, bin, count(*) AS count, round(min(lo) + (min(hi) - min(lo)) * bin / 20, 6) AS bin_start
FROM bk GROUP BY symbol, model, bin""")
def q_bt_error_dist(spark, sf):
    p, _, e = _preds_and_ensemble(spark, sf)
    return rounded(fc.error_histogram(en.individual(p, e).where(F.col("split") == "test")))


# --- company dimension and quotes ------------------------------------------------------------

@register("dim_company", """SELECT r.symbol, coalesce(s.s_name, r.symbol) AS name, coalesce(n.n_name, 'Unknown') AS sector,
  'Unknown' AS industry, '' AS description, CAST(0 AS BIGINT) AS employees, '' AS website,
  round(coalesce(s.s_acctbal, 0.0), 6) AS market_cap
FROM (SELECT s_name AS symbol FROM supplier UNION SELECT DISTINCT l_returnflag || l_linestatus FROM lineitem) r
LEFT JOIN supplier s ON s.s_name = r.symbol LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def q_dim_company(spark, sf):
    from barflow.sources.company import company_dimension, with_company
    sup, nat = table(spark, sf, "supplier"), table(spark, sf, "nation")
    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"))
    symbols = sup.select(F.col("s_name").alias("symbol")).union(li).distinct()
    return rounded(with_company(symbols, company_dimension(sup, nat)))


@register("src_latest_quote", S.with_bars(f"""SELECT symbol, date AS quote_date, round(close, 6) AS current_price,
  round(c1, 6) AS previous_close, round(open, 6) AS open, round(high, 6) AS day_high, round(low, 6) AS day_low,
  round(volume, 6) AS volume FROM (SELECT *, lag(close) OVER ({S.W}) AS c1,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k = 1"""))
def q_src_latest_quote(spark, sf):
    from barflow.sources.company import latest_quote
    return rounded(latest_quote(daily_bars(spark, sf)))


# --- pyspark.ml fits (rows-checked) --------------------------------------------------------
# Query-sized settings (stated here; the library defaults are the reference's
# 200-tree settings in barflow.operators.models).
RF_QUERY = dict(numTrees=20, maxDepth=6, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=42)
GBT_QUERY = dict(maxIter=20, maxDepth=4, stepSize=0.1, subsamplingRate=0.8,
                 featureSubsetStrategy="0.8", seed=42)


def ml_samples(spark: SparkSession, sf: str, horizon: int = HORIZON) -> DataFrame:
    s = ds.flatten_window(ds.split_samples(ds_samples(spark, sf, horizon)))
    return s.select("symbol", "date", "idx", "split", "features", "label")


def _fit_predict(spark, sf, spec):
    from barflow.operators import models as ml
    s = cut_lineage(ml_samples(spark, sf), "samples")
    model = ml.fit(s, spec)
    return model, ml.predict(model, s, spec.name)


def _specs():
    from barflow.operators.models import LINEAR_DEFAULTS, ModelSpec
    return [ModelSpec("rf", "rf", RF_QUERY), ModelSpec("xgb", "gbt", GBT_QUERY),
            ModelSpec("linear", "linear", LINEAR_DEFAULTS)]


@register("ml_rf", None)
def q_ml_rf(spark, sf):
    _, p = _fit_predict(spark, sf, _specs()[0])
    return p.where(F.col("split") == "test")


@register("ml_gbt", None)
def q_ml_gbt(spark, sf):
    _, p = _fit_predict(spark, sf, _specs()[1])
    return p.where(F.col("split") == "test")


@register("ml_seq_linear", None)
def q_ml_seq_linear(spark, sf):
    _, p = _fit_predict(spark, sf, _specs()[2])
    return p.where(F.col("split") == "test")


@register("ml_history", None)
def q_ml_history(spark, sf):
    from barflow.operators import models as ml
    s = cut_lineage(ml_samples(spark, sf), "samples")
    preds = None
    for spec in _specs():
        p = ml.predict(ml.fit(s, spec), s, spec.name)
        preds = p if preds is None else preds.unionByName(p)
    return ml.history(preds)


@register("ml_importance", None)
def q_ml_importance(spark, sf):
    from barflow.operators import models as ml
    model, _ = _fit_predict(spark, sf, _specs()[0])
    return ml.importances(spark, model, SCALED, LOOKBACK)


@register("eval_run_summary", "WITH " + _seq_sql(HORIZON) + f""",
s AS (SELECT *, CASE WHEN idx < floor(n_samples * {_T}) THEN 'train'
  WHEN idx < floor(n_samples * {_TV}) THEN 'val' ELSE 'test' END AS split FROM seq WHERE idx >= 0 AND idx < n_samples)
SELECT symbol, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
  count(*) FILTER (WHERE split = 'test') AS n_test, {4 * LOOKBACK} AS n_features, {LOOKBACK} AS lookback,
  {HORIZON} AS horizon FROM s GROUP BY symbol""")
def q_eval_run_summary(spark, sf):
    from barflow.operators.training import split_counts
    s = ds.split_samples(ds_samples(spark, sf))
    return split_counts(s).select("symbol", "n_train", "n_val", "n_test", F.lit(len(SCALED) * LOOKBACK).alias("n_features"),
                                  F.lit(LOOKBACK).alias("lookback"), F.lit(HORIZON).alias("horizon"))


FORECAST_STEPS = 5


@register("fc_future", None)
def q_fc_future(spark, sf):
    """Direct multi-horizon forecast: one linear model per step ``h``
    (trained on samples with horizon ``h``), each scoring the latest
    ``lookback`` rows of every symbol; dates are the following weekdays."""
    from pyspark.ml.regression import LinearRegression
    from barflow.operators.models import LINEAR_DEFAULTS
    scaled, stats = ds_scaled(spark, sf)
    scaled, stats = cut_lineage(scaled, "scaled"), cut_lineage(stats, "scaler")
    w = series_window().rowsBetween(-(LOOKBACK - 1), 0)
    win = F.collect_list(F.array(*[F.col(c) for c in SCALED])).over(w)
    last = scaled.select("*", win.alias("window"))
    last = finish(last.where(F.col("rn") == F.col("n_rows") - 1).where(F.size("window") == LOOKBACK))
    last = cut_lineage(ds.flatten_window(last).select("symbol", F.col("date").alias("last_date"), "features"), "latest")
    out = None
    for h in range(1, FORECAST_STEPS + 1):
        samples = ds.flatten_window(ds.split_samples(ds.sequences(scaled, SCALED, "close_s", LOOKBACK, h)))
        model = LinearRegression(featuresCol="features", labelCol="label", predictionCol="p",
                                 **LINEAR_DEFAULTS).fit(samples.where("split = 'train'"))
        p = model.transform(last).select("symbol", "last_date", F.lit(h).alias("step"), "p")
        out = p if out is None else out.unionByName(p)
    days = F.filter(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", 3 * FORECAST_STEPS)),
                    lambda d: F.weekday(d) < 5)
    out = out.withColumn("date", F.element_at(days, F.col("step")))
    out = ds.inverse_minmax(out, stats, "p", "close", "prediction")
    return out.select("symbol", "step", "date", "prediction")


# --- silver sink ----------------------------------------------------------------------------

@register("sink_silver", None)
def q_sink_silver(spark, sf):
    """Cleaned daily bars written partitioned by symbol, then read back."""
    import uuid
    from barflow.operators import clean as cl
    from barflow.session import ensure_checkpoint_dir
    from barflow.sources.store import read_silver, write_silver
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/silver-{uuid.uuid4().hex}"
    write_silver(finish(cl.clean_bars(daily_bars(spark, sf), arrival=None)), path)
    return read_silver(spark, path)


@register("src_plugin_bars", S.with_bars("SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, "
                                         "round(close, 6) AS close, round(volume, 6) AS volume FROM bars "
                                         "WHERE symbol IN ('AF', 'RF') AND date >= DATE '1993-03-01' AND date < DATE '1995-10-01'"))
def q_src_plugin_bars(spark, sf):
    """Published bars of two symbols and a range of days, through a plug-in fetcher: one partition per symbol and year."""
    import uuid
    from barflow.session import ensure_checkpoint_dir
    from barflow.sources.plugin import SilverFetcher, fetch_bars, register_fetcher
    from barflow.sources.store import write_silver
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/silver-{uuid.uuid4().hex}"
    version = write_silver(daily_bars(spark, sf), path)
    register_fetcher(spark, "barflow_silver", SilverFetcher)
    return rounded(fetch_bars(spark, "barflow_silver", ["AF", "RF"], "1993-03-01", "1995-10-01", path=f"{path}/{version}"))


# --- streaming ------------------------------------------------------------------------------

def _scratch(spark, name):
    import uuid
    from barflow.session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/ckpt"


@register("st_bars", """SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
  round(arg_min(value, ts), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
  round(arg_max(value, ts), 6) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_st_bars(spark, sf):
    from barflow.streaming.bars import run_live_bars
    out, ck = _scratch(spark, "bars")
    return rounded(run_live_bars(spark, sf, out, ck))


@register("st_latest_quote", """SELECT event_type AS symbol, CAST(max(ts) AS TIMESTAMP) AS last_ts,
  round(arg_max(value, ts), 6) AS current_price, count(*) AS n_ticks FROM events GROUP BY 1""")
def q_st_latest_quote(spark, sf):
    from barflow.streaming.bars import run_latest_quotes
    out, ck = _scratch(spark, "quotes")
    return rounded(run_latest_quotes(spark, sf, out, ck))


# --- fitted models: what SQL can say of them ---------------------------------------------------

@register("ml_rows", "WITH " + _seq_sql(HORIZON) + f""",
s AS (SELECT * FROM seq WHERE idx >= 0 AND idx < n_samples)
SELECT symbol, date, CASE WHEN idx < floor(n_samples * {_T}) THEN 'train' WHEN idx < floor(n_samples * {_TV}) THEN 'val' ELSE 'test' END AS split,
  model, round(label, 6) AS y, true AS finite FROM s, (VALUES ('rf'), ('xgb'), ('linear')) v(model)""")
def q_ml_rows(spark, sf):
    """Predictions of the three models: a row for every sample and model, its split and label, and a finite value."""
    from barflow.operators import models as ml
    s = cut_lineage(ml_samples(spark, sf), "samples")
    preds = None
    for spec in _specs():
        p = ml.predict(ml.fit(s, spec), s, spec.name)
        preds = p if preds is None else preds.unionByName(p)
    finite = F.col("yhat").isNotNull() & ~F.isnan("yhat") & (F.abs("yhat") < float("inf"))
    return rounded(preds.select("symbol", "date", "split", "model", "y", finite.alias("finite")))


@register("ml_importance_sum", f"SELECT {len(SCALED)} AS features, true AS nonnegative, true AS sum_to_one")
def q_ml_importance_sum(spark, sf):
    d = q_ml_importance(spark, sf)
    return d.agg(F.countDistinct("feature").cast("int").alias("features"), (F.min("importance") >= 0).alias("nonnegative"),
                 (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_to_one"))


@register("sink_silver_bars", S.with_bars("SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, "
                                          "round(close, 6) AS close, round(volume, 6) AS volume FROM bars"))
def q_sink_silver_bars(spark, sf):
    return rounded(q_sink_silver(spark, sf).select("symbol", "date", "open", "high", "low", "close", "volume"))


# --- walk-forward fits and boosting rounds -------------------------------------------------------

_OOF_SQL = "WITH " + _seq_sql(HORIZON) + f""",
s AS (SELECT symbol, idx, n_samples, label FROM seq WHERE idx >= 0 AND idx < n_samples),
f AS (SELECT s.*, k.fold, n_samples - ({ds.N_SPLITS} - k.fold) * (n_samples // {ds.N_SPLITS + 1}) AS start, n_samples // {ds.N_SPLITS + 1} AS size
      FROM s, (SELECT unnest(range(0, {ds.N_SPLITS})) AS fold) k),
m AS (SELECT symbol, CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE idx < start - {ds.GAP}) AS n_train,
        max(idx) FILTER (WHERE idx < start - {ds.GAP}) AS last_train, count(*) FILTER (WHERE idx >= start AND idx < start + size) AS n_test,
        min(idx) FILTER (WHERE idx >= start AND idx < start + size) AS first_test,
        round(sum(label) FILTER (WHERE idx >= start AND idx < start + size), 4) AS sum_y FROM f GROUP BY ALL)"""


@register("ml_walk_forward", _OOF_SQL + """
SELECT symbol, fold, model, n_train, last_train, n_test, first_test, first_test - last_train - 1 AS gap, sum_y, true AS finite
FROM m, (VALUES ('rf'), ('linear')) v(model)""")
def q_ml_walk_forward(spark, sf):
    """Models fitted per fold from one sample table: what each fit read, the out-of-fold rows it
    predicted, and the rows between them that neither saw."""
    from barflow.operators.training import out_of_fold
    samples = cut_lineage(ds.flatten_window(ds.split_samples(ds_samples(spark, sf))).select(
        "symbol", "date", "idx", "n_samples", "features", "label"), "samples")
    preds, seen = out_of_fold(samples, [_specs()[0], _specs()[2]])
    finite = F.col("yhat").isNotNull() & ~F.isnan("yhat") & (F.abs("yhat") < float("inf"))
    got = preds.groupBy("symbol", "fold", "model").agg(
        F.count(F.lit(1)).alias("n_test"), F.min("idx").alias("first_test"), F.round(F.sum("y"), 4).alias("sum_y"),
        (F.min(finite.cast("int")) == 1).alias("finite"))
    return got.join(seen, ["symbol", "fold"]).select("symbol", "fold", "model", "n_train", "last_train", "n_test", "first_test",
                                                     (F.col("first_test") - F.col("last_train") - 1).alias("gap"), "sum_y", "finite")


@register("ml_walk_forward_metrics", _OOF_SQL + """
SELECT symbol, fold, model, n_test AS n, true AS in_range FROM m, (VALUES ('rf'), ('linear')) v(model)""")
def q_ml_walk_forward_metrics(spark, sf):
    """Metrics of every fold from its out-of-fold predictions."""
    from barflow.operators.training import out_of_fold
    samples = cut_lineage(ds.flatten_window(ds.split_samples(ds_samples(spark, sf))).select(
        "symbol", "date", "idx", "n_samples", "features", "label"), "samples")
    preds, _ = out_of_fold(samples, [_specs()[0], _specs()[2]])
    m = ev.metrics(preds, by=("symbol", "fold", "model"))
    ok = (F.col("mae") <= F.col("rmse")) & (F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) <= 1e-9) & (F.col("r2") <= 1)
    return m.select("symbol", "fold", "model", "n", F.coalesce(ok, F.lit(False)).alias("in_range"))


@register("ml_gbt_rounds", "WITH " + _seq_sql(HORIZON) + f""",
s AS (SELECT CASE WHEN idx < floor(n_samples * {_T}) THEN 'train' WHEN idx < floor(n_samples * {_TV}) THEN 'val' END AS split
      FROM seq WHERE idx >= 0 AND idx < n_samples)
SELECT split, CAST(round AS INTEGER) AS round, count(*) AS n, round = {GBT_QUERY['maxIter']} AS last, true AS agrees
FROM s, (SELECT unnest(range(1, {GBT_QUERY['maxIter'] + 1})) AS round) WHERE split IS NOT NULL GROUP BY split, round""")
def q_ml_gbt_rounds(spark, sf):
    """The error after every boosting round on training and validation samples. ``agrees``: the last
    round's error is that of the model's own predictions, training errors never rise by a tenth, and all are finite."""
    from barflow.operators import models as ml
    s = cut_lineage(ml_samples(spark, sf), "samples")
    spec = _specs()[1]
    model = ml.fit(s, spec)
    rounds = cut_lineage(ml.gbt_rounds(model, s, ("train", "val")), "rounds")
    own = ev.metrics(ml.predict(model, s, spec.name), by=("split",), split=None).select("split", F.col("rmse").alias("end"))
    before = F.lag("rmse").over(Window.partitionBy("split").orderBy("round"))  # a split has as many rows as rounds
    last = F.col("round") == F.max("round").over(Window.partitionBy("split"))
    d = rounds.join(own, "split").withColumn("last", last).withColumn("before", before)
    agrees = F.when(F.col("last"), F.abs(F.col("rmse") - F.col("end")) <= 1e-9).otherwise(True)
    falls = (F.col("split") != "train") | F.col("before").isNull() | (F.col("rmse") <= 1.1 * F.col("before"))
    return d.select("split", "round", "n", "last", (agrees & falls & (F.abs("rmse") < float("inf"))).alias("agrees"))
