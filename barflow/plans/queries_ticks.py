"""A tick-level series, long enough to span several blocks, in two layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators.layout import Layout, finish, layout_series, with_running
from barflow.operators.regime import regime_features
from barflow.operators.technical import TechnicalConfig, technical_features, technical_history
from barflow.plans.queries import r6, register
from barflow.sources.bars import order_key
from barflow.sources.ticks import lineitem_ticks, table

#: EMA 200 and SMA 2000 besides the usual periods.
CONFIG = TechnicalConfig(sma_periods=(10, 20, 50, 2000), ema_periods=(12, 26, 200), groups=("moving_averages", "momentum", "volume", "trend"))
LAYOUTS = {"small": Layout(4096, 2048, 512), "default": Layout().covers(technical_history(CONFIG))}

_W = "PARTITION BY symbol ORDER BY rn"


def _full(n: int, agg: str, x: str) -> str:
    fr = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {fr} = {n} THEN {agg}({x}) {fr} END)"


def _r3(x: str) -> str:
    return f"(floor(({x}) * 1000.0 + 0.5) / 1000.0)"


TICKS_SQL = f"""WITH RECURSIVE t AS (
  SELECT l_returnflag || l_linestatus AS symbol, CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS px, l_quantity AS qty,
    row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS rn
  FROM lineitem),
a AS (SELECT *, lag(px) OVER ({_W}) AS c1 FROM t),
b AS (SELECT *, CASE WHEN px > c1 THEN px - c1 ELSE 0.0 END AS up, CASE WHEN px < c1 THEN c1 - px ELSE 0.0 END AS dn,
    CASE WHEN c1 IS NULL THEN NULL WHEN px > c1 THEN px - c1 ELSE 0.0 END AS pdm,
    CASE WHEN c1 IS NULL THEN NULL WHEN px < c1 THEN c1 - px ELSE 0.0 END AS mdm FROM a),
s AS (SELECT *, {_full(14, 'sum', 'pdm')} AS ps, {_full(14, 'sum', 'mdm')} AS ms FROM b),
rec AS (
  SELECT symbol, rn, px AS e, up AS ru, dn AS rd, CAST(NULL AS DOUBLE) AS sp, CAST(NULL AS DOUBLE) AS sm FROM s WHERE rn = 0
  UNION ALL
  SELECT s.symbol, s.rn, (199.0 / 201) * r.e + (2.0 / 201) * s.px, (13.0 / 14) * r.ru + (1.0 / 14) * s.up, (13.0 / 14) * r.rd + (1.0 / 14) * s.dn,
    CASE WHEN s.rn = 14 THEN s.ps WHEN s.rn > 14 THEN (13.0 / 14) * r.sp + s.pdm END,
    CASE WHEN s.rn = 14 THEN s.ms WHEN s.rn > 14 THEN (13.0 / 14) * r.sm + s.mdm END
  FROM rec r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1),
x AS (SELECT s.*, CASE WHEN s.rn >= 199 THEN rec.e END AS ema_200,
    CASE WHEN s.rn < 13 THEN NULL WHEN rec.rd = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + rec.ru / rec.rd) END AS rsi,
    CASE WHEN rec.sp IS NULL THEN NULL WHEN rec.sp + rec.sm = 0 THEN 0.0 ELSE 100.0 * abs(rec.sp - rec.sm) / (rec.sp + rec.sm) END AS dx
  FROM s JOIN rec ON rec.symbol = s.symbol AND rec.rn = s.rn),
y AS (SELECT *, {_full(14, 'avg', 'dx')} AS dx_seed FROM x),
rec2 AS (
  SELECT symbol, rn, dx_seed AS adx FROM y WHERE rn = 27
  UNION ALL
  SELECT y.symbol, y.rn, (13.0 / 14) * r.adx + (1.0 / 14) * y.dx FROM rec2 r JOIN y ON y.symbol = r.symbol AND y.rn = r.rn + 1),
z0 AS (SELECT y.symbol, y.rn, y.px, y.qty, y.c1, y.rsi, y.ema_200, rec2.adx
  FROM y LEFT JOIN rec2 ON rec2.symbol = y.symbol AND rec2.rn = y.rn),
z AS (SELECT *, {_full(2000, 'avg', 'px')} AS sma_2000,
    sum(CASE WHEN px < c1 THEN -qty ELSE qty END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv,
    last_value(CASE WHEN rn % 3000 = 7 THEN px END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled,
    100.0 * ({_full(20, 'avg', 'px')} - {_full(50, 'avg', 'px')}) / {_full(50, 'avg', 'px')} AS strength
  FROM z0),
g AS (SELECT *, CASE WHEN strength > 2 THEN 1 WHEN strength < -2 THEN -1 ELSE 0 END AS regime FROM z),
h AS (SELECT *, CASE WHEN lag(regime) OVER ({_W}) = regime THEN 0 ELSE 1 END AS changed FROM g),
k AS (SELECT *, sum(changed) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM h)
SELECT layout, symbol, rn, {_r3('rsi')} AS rsi, {_r3('ema_200')} AS ema_200, {_r3('sma_2000')} AS sma_2000, {_r3('adx')} AS adx,
  {_r3('obv')} AS obv, {_r3('filled')} AS filled, CAST(row_number() OVER (PARTITION BY layout, symbol, run ORDER BY rn) AS INTEGER) AS run_length
FROM k, (VALUES ('small'), ('default')) v(layout)"""


def tick_series(spark: SparkSession, sf: str) -> DataFrame:
    """Every trade as a bar of its own, ordered by (ts, seq)."""
    t = lineitem_ticks(table(spark, sf, "lineitem"))
    p = F.col("price")
    return t.select("symbol", order_key(F.col("ts"), F.col("seq")).alias("at"), F.year("ts").alias("year"), p.alias("open"), p.alias("high"),
                    p.alias("low"), p.alias("close"), F.col("size").alias("volume"))


@register("tick_series_features", TICKS_SQL)
def q_tick_series_features(spark, sf):
    """Smoothers, long windows, running sums, fills and run lengths over series of
    many blocks; both layouts must give the values of one whole series."""
    out = None
    for name, layout in LAYOUTS.items():
        d = layout_series(tick_series(spark, sf), order="at", layout=layout, bucket=F.col("year"))
        d = technical_features(d, CONFIG, layout)
        d = regime_features(d, layout=layout)
        d = with_running(d, {"filled": ("last", F.when(F.col("rn") % 3000 == 7, F.col("close")))}, layout)
        d = finish(d, keep_rn=True).select(F.lit(name).alias("layout"), "symbol", "rn", *[
            r6(F.col(c), 3).alias(c) for c in ("rsi", "ema_200", "sma_2000", "adx", "obv", "filled")],
            F.col("trend_persistence").alias("run_length"))
        out = d if out is None else out.unionByName(d)
    return out
