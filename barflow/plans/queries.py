"""Registered queries: one per operator of the inventory, each run over the
whole driver tables of a scale-factor folder, with a matching DuckDB oracle.

``REGISTRY[name] = (spark_fn, sql_or_None)``; ``spark_fn(spark, sf_dir)``
returns a DataFrame. Double outputs are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.operators import clean as cl
from barflow.operators import quality as dq
from barflow.operators.layout import DEFAULT_LAYOUT, finish, layout_series
from barflow.operators.regime import regime_features
from barflow.operators.technical import TechnicalConfig, technical_features
from barflow.plans import sql as S
from barflow.sources.bars import BAR_COLUMNS, bars_from_ticks, lookback, read_bars, select_bars
from barflow.sources.ticks import event_ticks, lineitem_ticks, orders_raw_bars, table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, S.fix_rounding(sql) if sql else None)
        return fn
    return deco


def r6(c, digits: int = 6):
    """Half-up rounding in plain IEEE arithmetic (same expression as the
    oracle side, so equal doubles round equally)."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5).cast("double") / scale


# Squared errors of prices reach 1e8+; 2 decimals keep 10+ significant digits.
COARSE = {"mse": 2}


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column (comparison form)."""
    return df.select(*[r6(F.col(f.name), COARSE.get(f.name, 6)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# --- inputs -------------------------------------------------------------------

def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_ticks(lineitem_ticks(table(spark, sf, "lineitem")), "1d")


def hourly_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_ticks(event_ticks(table(spark, sf, "events")), "1h", order="ts")


def dirty_raw(spark: SparkSession, sf: str) -> DataFrame:
    return orders_raw_bars(table(spark, sf, "orders"))


def features(spark: SparkSession, sf: str, groups: tuple[str, ...] | None = None,
             regime: bool = False, keep_rn: bool = False) -> DataFrame:
    cfg = TechnicalConfig() if groups is None else TechnicalConfig(groups=groups)
    d = layout_series(daily_bars(spark, sf))
    if groups != ():
        d = technical_features(d, cfg)
    if regime:
        d = regime_features(d)
    return finish(d, keep_rn=keep_rn)


# --- 2.1 sources ----------------------------------------------------------------

_BAR_COLS = "symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, " \
            "round(close, 6) AS close, round(volume, 6) AS volume"


@register("src_bars_from_ticks", S.with_bars(f"SELECT {_BAR_COLS} FROM bars"))
def q_src_bars_from_ticks(spark, sf):
    return rounded(daily_bars(spark, sf))


@register("src_bars", S.with_bars(
    f"SELECT {_BAR_COLS} FROM bars WHERE symbol IN ('AF', 'NO', 'RF') "
    "AND date >= DATE '1996-01-01' AND date < DATE '2000-01-01'"))
def q_src_bars(spark, sf):
    ticks = lineitem_ticks(table(spark, sf, "lineitem"))
    bars = bars_from_ticks(ticks, "1d", symbols=["AF", "NO", "RF"], start="1996-01-01", end="2000-01-01")
    return rounded(select_bars(bars))


@register("src_bars_files", S.with_bars(
    f"SELECT {_BAR_COLS} FROM bars WHERE symbol IN ('AF', 'NO', 'RF') "
    "AND date >= DATE '1996-01-01' AND date < DATE '2000-01-01'"))
def q_src_bars_files(spark, sf):
    """Bars stored as files and read back for some symbols and a range."""
    from barflow.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    daily_bars(spark, sf).select(*BAR_COLUMNS).write.parquet(path)
    return rounded(read_bars(spark, path, ["AF", "NO", "RF"], "1996-01-01", "2000-01-01"))


_HOURLY_SQL = """SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
  round(arg_min(value, ts), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
  round(arg_max(value, ts), 6) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2"""


@register("src_bars_hourly", _HOURLY_SQL)
def q_src_bars_hourly(spark, sf):
    return rounded(hourly_bars(spark, sf))


@register("src_tz_strip", """SELECT event_id,
  CAST(timezone('America/New_York', CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC') AS TIMESTAMP) AS ts
FROM events""")
def q_src_tz_strip(spark, sf):
    from barflow.sources.bars import strip_zone
    ev = table(spark, sf, "events").select("event_id", "ts")
    return strip_zone(ev, "ts", "America/New_York")


@register("src_lookback_range", S.with_bars(
    f"SELECT {_BAR_COLS} FROM bars b WHERE date >= "
    "(SELECT max(date) FROM bars x WHERE x.symbol = b.symbol) - INTERVAL 378 DAY"))
def q_src_lookback_range(spark, sf):
    # Default range of the reference: 1.5 x 252 days before the latest bar.
    return rounded(lookback(daily_bars(spark, sf), 378))


@register("src_pipeline_status", S.with_bars(
    "SELECT symbol, count(*) AS rows, min(date) AS start_date, max(date) AS end_date "
    "FROM bars GROUP BY symbol"))
def q_src_pipeline_status(spark, sf):
    from barflow.sources.store import pipeline_status
    return pipeline_status(daily_bars(spark, sf))


# --- 2.2 quality ----------------------------------------------------------------

_MOVES = S.BARS + f""",
m AS (SELECT symbol, date, close, volume, open, high, low,
  {S.dv('close', 'lag(close) OVER (' + S.W + ')')} - 1 AS change,
  date - lag(date) OVER ({S.W}) AS gap_days FROM bars)"""

_QUALITY_SQL = f"""WITH {_MOVES}
SELECT symbol, count(*) AS rows,
  round(greatest(avg(CASE WHEN open IS NULL THEN 1.0 ELSE 0.0 END), avg(CASE WHEN high IS NULL THEN 1.0 ELSE 0.0 END),
    avg(CASE WHEN low IS NULL THEN 1.0 ELSE 0.0 END), avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END),
    avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0.0 END)), 6) AS max_null_share,
  count(*) FILTER (WHERE close <= 0) AS nonpositive_close,
  count(*) FILTER (WHERE volume < 0) AS negative_volume,
  count(*) FILTER (WHERE abs(change) > 0.5) AS big_moves,
  count(*) FILTER (WHERE gap_days > 7) AS date_gaps
FROM m GROUP BY symbol"""


def _quality(spark, sf):
    return rounded(dq.quality_report(daily_bars(spark, sf)))


@register("dq_report", _QUALITY_SQL)
def q_dq_report(spark, sf):
    return _quality(spark, sf).drop("empty", "too_many_nulls", "missing_keys", "passed")


@register("dq_null_ratio", f"SELECT symbol, max_null_share, max_null_share > 0.1 AS too_many_nulls FROM ({_QUALITY_SQL})")
def q_dq_null_ratio(spark, sf):
    return _quality(spark, sf).select("symbol", "max_null_share", "too_many_nulls")


@register("dq_nonpositive_close", f"SELECT symbol, nonpositive_close FROM ({_QUALITY_SQL})")
def q_dq_nonpositive_close(spark, sf):
    return _quality(spark, sf).select("symbol", "nonpositive_close")


@register("dq_negative_volume", f"SELECT symbol, negative_volume FROM ({_QUALITY_SQL})")
def q_dq_negative_volume(spark, sf):
    return _quality(spark, sf).select("symbol", "negative_volume")


@register("dq_big_moves", f"WITH {_MOVES} SELECT symbol, date, round(abs(change), 6) AS abs_change "
                          "FROM m WHERE abs(change) > 0.5")
def q_dq_big_moves(spark, sf):
    return rounded(dq.big_moves(daily_bars(spark, sf)))


@register("dq_date_gaps", f"WITH {_MOVES} SELECT symbol, date, CAST(gap_days AS INTEGER) AS gap_days "
                          "FROM m WHERE gap_days > 7")
def q_dq_date_gaps(spark, sf):
    return dq.date_gaps(daily_bars(spark, sf))


_EMPTY_SQL = S.with_bars("""SELECT r.symbol, coalesce(b.rows, 0) AS rows, coalesce(b.rows, 0) = 0 AS empty
FROM (SELECT DISTINCT s_name AS symbol FROM supplier
      UNION SELECT DISTINCT l_returnflag || l_linestatus FROM lineitem) r
LEFT JOIN (SELECT symbol, count(*) AS rows FROM bars GROUP BY symbol) b ON b.symbol = r.symbol""")


@register("dq_empty", _EMPTY_SQL)
def q_dq_empty(spark, sf):
    # Requested symbols: the traded ones plus every supplier name (no bars).
    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"))
    sup = table(spark, sf, "supplier").select(F.col("s_name").alias("symbol"))
    rep = dq.quality_report(daily_bars(spark, sf), symbols=li.union(sup).distinct())
    return rep.select("symbol", "rows", "empty")


@register("dq_passed", f"""SELECT symbol, rows > 0 AND coalesce(max_null_share, 0) <= 0.1
  AND nonpositive_close = 0 AND negative_volume = 0 AS passed FROM ({_QUALITY_SQL})""")
def q_dq_passed(spark, sf):
    return _quality(spark, sf).select("symbol", "passed")


# --- 2.3 cleaning -----------------------------------------------------------------

_RAW = """raw AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS close,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS volume,
    o_orderkey AS arrival FROM orders),
dd AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY arrival DESC) = 1)"""

_FILLED = _RAW + f""",
f AS (SELECT symbol, date,
    coalesce(last_value(close IGNORE NULLS) OVER ({S.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(close IGNORE NULLS) OVER ({S.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close,
    coalesce(volume, median(volume) OVER (PARTITION BY symbol)) AS volume
  FROM dd),
fr AS (SELECT *, {S.dv('close', f'lag(close) OVER ({S.W})')} - 1 AS ret FROM f WHERE close IS NOT NULL),
o AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY symbol) AS sd FROM fr)"""


def _cleaned(spark, sf):
    return cl.clean_bars(dirty_raw(spark, sf))


@register("clean_dedup", f"WITH {_RAW} SELECT symbol, date, round(close, 6) AS close, arrival FROM dd")
def q_clean_dedup(spark, sf):
    return rounded(cl.dedupe_last(dirty_raw(spark, sf)).select("symbol", "date", "close", "arrival"))


@register("clean_ffill_bfill", f"WITH {_FILLED} SELECT symbol, date, round(close, 6) AS close FROM f")
def q_clean_ffill_bfill(spark, sf):
    d = layout_series(cl.dedupe_last(dirty_raw(spark, sf)).drop("arrival"))
    return rounded(finish(cl.fill_missing(d)).select("symbol", "date", "close"))


@register("clean_volume_median", f"WITH {_FILLED} SELECT symbol, date, round(volume, 6) AS volume FROM f")
def q_clean_volume_median(spark, sf):
    d = layout_series(cl.dedupe_last(dirty_raw(spark, sf)).drop("arrival"))
    return rounded(finish(cl.fill_missing(d)).select("symbol", "date", "volume"))


@register("clean_drop_null", f"WITH {_FILLED} SELECT symbol, count(*) AS rows FROM f "
                             "WHERE close IS NOT NULL GROUP BY symbol")
def q_clean_drop_null(spark, sf):
    return finish(_cleaned(spark, sf)).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@register("clean_outlier_flag", f"""WITH {_FILLED}
SELECT symbol, date, CASE WHEN abs(ret) > 10 * sd THEN 1 ELSE 0 END AS is_outlier FROM o""")
def q_clean_outlier_flag(spark, sf):
    return finish(_cleaned(spark, sf)).select("symbol", "date", "is_outlier")


@register("clean_outlier_cap", f"""WITH {_FILLED}
SELECT symbol, date, round(CASE WHEN abs(ret) > 10 * sd THEN sign(ret) * 3 * sd ELSE ret END, 6) AS capped_return,
  round(close, 6) AS close FROM o""")
def q_clean_outlier_cap(spark, sf):
    return rounded(finish(_cleaned(spark, sf)).select("symbol", "date", "capped_return", "close"))


@register("clean_returns", f"WITH {_FILLED} SELECT symbol, date, round(ret, 6) AS returns FROM o")
def q_clean_returns(spark, sf):
    return rounded(finish(_cleaned(spark, sf)).select("symbol", "date", "returns"))


@register("clean_log_returns", f"""WITH {_FILLED} SELECT symbol, date,
  round(CASE WHEN ret + 1 > 0 THEN ln(ret + 1) END, 6) AS log_returns FROM o""")
def q_clean_log_returns(spark, sf):
    return rounded(finish(_cleaned(spark, sf)).select("symbol", "date", "log_returns"))


@register("clean_range", S.with_bars(f"""SELECT symbol, date, round(high - low, 6) AS high_low_range,
  round({S.dv('high - low', 'close')}, 6) AS high_low_ratio FROM bars"""))
def q_clean_range(spark, sf):
    raw = daily_bars(spark, sf)
    d = cl.clean_bars(raw, arrival=None)
    return rounded(finish(d).select("symbol", "date", "high_low_range", "high_low_ratio"))


@register("clean_dow", S.with_bars("SELECT symbol, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week FROM bars"))
def q_clean_dow(spark, sf):
    d = cl.clean_bars(daily_bars(spark, sf), arrival=None)
    return finish(d).select("symbol", "date", "day_of_week")


@register("clean_report", f"""WITH {_FILLED}
SELECT r.symbol, r.initial_rows, coalesce(c.final_rows, 0) AS final_rows,
  r.initial_rows - coalesce(c.final_rows, 0) AS rows_removed,
  round((r.initial_rows - coalesce(c.final_rows, 0)) / r.initial_rows, 6) AS removal_rate
FROM (SELECT symbol, count(*) AS initial_rows FROM raw GROUP BY symbol) r
LEFT JOIN (SELECT symbol, count(*) AS final_rows FROM f WHERE close IS NOT NULL GROUP BY symbol) c
  ON c.symbol = r.symbol""")
def q_clean_report(spark, sf):
    raw = dirty_raw(spark, sf)
    return rounded(cl.cleaning_report(raw, finish(cl.clean_bars(raw))))


# --- 2.4 / 2.6 projections, filters, aggregates ---------------------------------------

@register("agg_overview", S.with_bars("""SELECT symbol, round(avg(close), 6) AS mean_close,
  round(min(close), 6) AS min_close, round(max(close), 6) AS max_close,
  round(stddev_samp(close), 6) AS std_close, round(avg(volume), 6) AS mean_volume, count(*) AS rows
FROM bars GROUP BY symbol"""))
def q_agg_overview(spark, sf):
    from barflow.operators.overview import overview
    return rounded(overview(daily_bars(spark, sf)))


@register("agg_latest", S.with_bars(f"""SELECT symbol, round(close, 6) AS last_close,
  round(100 * ({S.dv('close', 'c1')} - 1), 6) AS last_change_pct, round(volume, 6) AS last_volume, n AS rows, date AS last_date
FROM (SELECT *, lag(close) OVER ({S.W}) AS c1, count(*) OVER (PARTITION BY symbol) AS n,
        row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k = 1"""))
def q_agg_latest(spark, sf):
    from barflow.operators.overview import latest
    return rounded(latest(daily_bars(spark, sf)))


@register("topk_tail", S.with_bars(f"""SELECT {_BAR_COLS} FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 10"""))
def q_topk_tail(spark, sf):
    from barflow.operators.overview import tail
    return rounded(tail(daily_bars(spark, sf), 10))


# --- 2.7 / 2.8 features ------------------------------------------------------------

def _feature_query(name: str, cols: list[str], groups: tuple[str, ...], regime: bool = False):
    def fn(spark, sf):
        return rounded(features(spark, sf, groups, regime).select("symbol", "date", *cols))
    fn.__name__ = f"q_{name}"
    register(name, S.feature_sql(cols))(fn)


_MA, _MOM, _VOL, _VLM, _PAT, _TR = ("moving_averages",), ("momentum",), ("volatility",), \
    ("volume",), ("patterns",), ("trend",)

for _name, _cols, _groups, _reg in [
    ("ta_sma", ["sma_10", "sma_20", "sma_50", "sma_200"], _MA, False),
    ("ta_ema", ["ema_12", "ema_26"], _MA, False),
    ("ta_price_to_sma", ["price_to_sma20", "price_to_sma50"], _MA, False),
    ("ta_sma_cross", ["sma_10_20_cross", "sma_20_50_cross"], _MA, False),
    ("ta_rsi", ["rsi"], _MOM, False),
    ("ta_rsi_flags", ["rsi_oversold", "rsi_overbought"], _MOM, False),
    ("ta_macd", ["macd", "macd_signal", "macd_diff"], _MOM, False),
    ("ta_macd_bullish", ["macd_bullish"], _MOM, False),
    ("ta_stoch", ["stoch_k", "stoch_d"], _MOM, False),
    ("ta_roc", ["roc_10", "roc_20"], _MOM, False),
    ("ta_bollinger", ["bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_pct"], _VOL, False),
    ("ta_bb_flags", ["price_above_bb_upper", "price_below_bb_lower"], _VOL, False),
    ("ta_atr", ["atr"], _VOL, False),
    ("ta_atr_pct", ["atr_pct"], _VOL, False),
    ("ta_volatility", ["volatility_10", "volatility_20", "volatility_30"], _VOL, False),
    ("ta_volume_sma", ["volume_sma_20", "volume_ratio"], _VLM, False),
    ("ta_volume_spike", ["volume_spike"], _VLM, False),
    ("ta_obv", ["obv"], _VLM, False),
    ("ta_vwap", ["vwap", "price_to_vwap"], _VLM, False),
    ("ta_mfi", ["mfi"], _VLM, False),
    ("ta_range", ["high_low_range", "high_low_pct"], _PAT, False),
    ("ta_close_position", ["close_position"], _PAT, False),
    ("ta_gap", ["gap_up", "gap_down"], _PAT, False),
    ("ta_candle", ["body", "upper_shadow", "lower_shadow"], _PAT, False),
    ("ta_doji", ["is_doji"], _PAT, False),
    ("ta_adx", ["adx"], _TR, False),
    ("ta_adx_flags", ["strong_trend", "weak_trend"], _TR, False),
    ("ta_aroon", ["aroon_up", "aroon_down", "aroon_indicator"], _TR, False),
    ("ta_momentum", ["momentum_5", "momentum_10", "momentum_20"], _TR, False),
    ("rg_rolling_vol", ["rolling_volatility"], (), True),
    ("rg_vol_percentile", ["volatility_percentile"], (), True),
    ("rg_vol_regime", ["volatility_regime", "low_volatility", "high_volatility"], (), True),
    ("rg_trend_strength", ["trend_strength"], (), True),
    ("rg_trend_regime", ["trend_regime", "uptrend", "downtrend", "ranging"], (), True),
    ("rg_trend_persistence", ["trend_persistence"], (), True),
    ("rg_volume_percentile", ["volume_percentile"], (), True),
    ("rg_volume_regime", ["volume_regime", "low_volume", "high_volume"], (), True),
]:
    _feature_query(_name, _cols, _groups, _reg)


# --- 2.9 feature store ----------------------------------------------------------------

def flagship_features(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars -> cleaning -> technical + regime features -> complete rows."""
    from barflow.operators.store import generate_features
    return generate_features(daily_bars(spark, sf))


_ALL_FEATURES = [c for c in S.INT_COLS] + [
    "sma_10", "sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "price_to_sma20", "price_to_sma50",
    "rsi", "macd", "macd_signal", "macd_diff", "stoch_k", "stoch_d", "roc_10", "roc_20",
    "bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_pct", "atr", "atr_pct",
    "volatility_10", "volatility_20", "volatility_30", "volume_sma_20", "volume_ratio", "obv",
    "vwap", "price_to_vwap", "mfi", "high_low_range", "high_low_pct", "close_position", "body",
    "upper_shadow", "lower_shadow", "adx", "aroon_up", "aroon_down", "aroon_indicator",
    "momentum_5", "momentum_10", "momentum_20", "rolling_volatility", "volatility_percentile",
    "volatility_regime", "trend_strength", "volume_percentile", "volume_regime", "returns"]
_FS_COLS = ["close", "sma_200", "rsi", "adx", "volatility_percentile", "trend_persistence"]


@register("fs_generate", S.feature_sql(
    _FS_COLS, " AND ".join(f"{c} IS NOT NULL" for c in sorted(set(_ALL_FEATURES)))))
def q_fs_generate(spark, sf):
    return rounded(flagship_features(spark, sf).select("symbol", "date", *_FS_COLS))


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in sorted(set(_ALL_FEATURES)))


@register("filter_complete", f"""WITH RECURSIVE {S.CHAIN}{S.REGIME_FLAGS}
SELECT symbol, count(*) AS rows_before, count(*) FILTER (WHERE {_COMPLETE}) AS rows_after,
  count(*) - count(*) FILTER (WHERE {_COMPLETE}) AS rows_dropped
FROM features2 GROUP BY symbol""")
def q_filter_complete(spark, sf):
    from barflow.operators.store import completeness, generate_features
    bars = daily_bars(spark, sf)
    full_rows = generate_features(bars, drop_incomplete=False)
    return completeness(full_rows)


# Reference defaults: lookback 60 + horizon 5 + 100 rows.
@register("guard_min_rows", S.with_bars(
    "SELECT symbol, count(*) AS rows, count(*) >= 165 AS eligible, "
    "CASE WHEN count(*) < 165 THEN format('rows: need 165, got {}', count(*)) END AS reason "
    "FROM bars GROUP BY symbol"))
def q_guard_min_rows(spark, sf):
    from barflow.operators.store import GUARD_EXTRA_ROWS, guard_min_rows
    return guard_min_rows(daily_bars(spark, sf), 60 + 5 + GUARD_EXTRA_ROWS)
