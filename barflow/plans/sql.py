"""DuckDB oracle SQL for the registered queries (plain textbook definitions).

These strings are an independent statement of each operator: ordered
windows over the whole series and recursive CTEs for the smoothers, with no
blocks, halos or scans. The driver runs them on the parquet views
``lineitem``, ``orders``, ``events``, ``supplier`` and ``nation``.
"""

from __future__ import annotations

ORDER_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
W = "PARTITION BY symbol ORDER BY date"


def dv(a: str, b: str) -> str:
    """a / b, NULL when b is 0 or NULL."""
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def full(n: int, agg: str, x: str) -> str:
    fr = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {fr} = {n} THEN {agg}({x}) {fr} END)"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def r6(x: str, digits: int = 6) -> str:
    """Round half up with plain IEEE arithmetic (the Spark side uses the same
    expression, so equal inputs give equal outputs)."""
    scale = f"{10 ** digits}.0"
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def fix_rounding(sql: str) -> str:
    """Rewrite every ``round(<expr>, d)`` into :func:`r6` form."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = sql[j + len(key):comma], sql[comma + 1:k - 1].strip()
        if not digits.isdigit():
            out.append(sql[i:k])
        else:
            out.append(sql[i:j] + r6(fix_rounding(inner), int(digits)))
        i = k


BARS = f"""bars AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date,
         first({dv('l_extendedprice', 'l_quantity')} ORDER BY {ORDER_KEY}) AS open,
         max({dv('l_extendedprice', 'l_quantity')}) AS high,
         min({dv('l_extendedprice', 'l_quantity')}) AS low,
         last({dv('l_extendedprice', 'l_quantity')} ORDER BY {ORDER_KEY}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

# Whole technical + regime chain over the daily bars.
CHAIN = BARS + f""",
s1 AS (
  SELECT *, row_number() OVER ({W}) - 1 AS rn,
    lag(close) OVER ({W}) AS c1, lag(high) OVER ({W}) AS h1, lag(low) OVER ({W}) AS l1,
    lag(close, 5) OVER ({W}) AS c5, lag(close, 10) OVER ({W}) AS c10,
    lag(close, 20) OVER ({W}) AS c20,
    lag((high + low + close) / 3.0) OVER ({W}) AS tp1,
    {full(10, 'avg', 'close')} AS sma_10, {full(20, 'avg', 'close')} AS sma_20,
    {full(50, 'avg', 'close')} AS sma_50, {full(200, 'avg', 'close')} AS sma_200,
    {full(20, 'stddev_pop', 'close')} AS bb_sd,
    {full(14, 'min', 'low')} AS lo_k, {full(14, 'max', 'high')} AS hi_k,
    {full(20, 'avg', 'volume')} AS volume_sma_20,
    list(high) OVER ({W} ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS hs,
    list(low) OVER ({W} ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS ls,
    list(volume) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS vols
  FROM bars),
s2 AS (
  SELECT *, {dv('close', 'c1')} - 1 AS returns,
    CASE WHEN c1 IS NULL THEN high - low ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr,
    CASE WHEN close - c1 > 0 THEN close - c1 ELSE 0.0 END AS up,
    CASE WHEN close - c1 < 0 THEN c1 - close ELSE 0.0 END AS dn,
    CASE WHEN h1 IS NULL THEN NULL WHEN high - h1 > l1 - low AND high - h1 > 0 THEN high - h1 ELSE 0.0 END AS pdm,
    CASE WHEN h1 IS NULL THEN NULL WHEN l1 - low > high - h1 AND l1 - low > 0 THEN l1 - low ELSE 0.0 END AS mdm,
    (high + low + close) / 3.0 * volume *
      (CASE WHEN (high + low + close) / 3.0 > tp1 THEN 1.0
            WHEN (high + low + close) / 3.0 < tp1 THEN -1.0 ELSE 0.0 END) AS mf,
    100.0 * {dv('close - lo_k', 'hi_k - lo_k')} AS stoch_k,
    avg(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS bb_mid_raw,
    CASE WHEN len(hs) >= 25 THEN (list_position(hs, list_max(hs)) - 1) * 100.0 / 25 END AS aroon_up,
    CASE WHEN len(ls) >= 25 THEN (list_position(ls, list_min(ls)) - 1) * 100.0 / 25 END AS aroon_down,
    CASE WHEN len(vols) >= 20 THEN
      (len(list_filter(vols, lambda z: z < volume)) + (len(list_filter(vols, lambda z: z = volume)) + 1) / 2.0)
      / len(vols) END AS volume_percentile
  FROM s1),
s3 AS (
  SELECT *,
    {full(10, 'stddev_samp', 'returns')} AS volatility_10,
    {full(20, 'stddev_samp', 'returns')} AS volatility_20,
    {full(30, 'stddev_samp', 'returns')} AS volatility_30,
    {full(3, 'avg', 'stoch_k')} AS stoch_d,
    {full(14, 'avg', 'tr')} AS atr_seed,
    {full(14, 'sum', 'CASE WHEN mf >= 0 THEN mf ELSE 0.0 END')} AS mfp,
    {full(14, 'sum', 'CASE WHEN mf < 0 THEN -mf ELSE 0.0 END')} AS mfn,
    {full(14, 'sum', 'pdm')} AS pdm_seed, {full(14, 'sum', 'mdm')} AS mdm_seed,
    sum(CASE WHEN close < c1 THEN -volume ELSE volume END)
      OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv,
    {dv(f'sum(close * volume) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)',
        f'sum(volume) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS vwap
  FROM s2),
rec AS (
  SELECT symbol, rn, close AS e12, close AS e26, up AS ru, dn AS rd,
         CAST(NULL AS DOUBLE) AS atr, CAST(NULL AS DOUBLE) AS sp, CAST(NULL AS DOUBLE) AS sm
  FROM s3 WHERE rn = 0
  UNION ALL
  SELECT s.symbol, s.rn,
    (11.0 / 13) * r.e12 + (2.0 / 13) * s.close,
    (25.0 / 27) * r.e26 + (2.0 / 27) * s.close,
    (13.0 / 14) * r.ru + (1.0 / 14) * s.up,
    (13.0 / 14) * r.rd + (1.0 / 14) * s.dn,
    CASE WHEN s.rn = 13 THEN s.atr_seed WHEN s.rn > 13 THEN (13.0 / 14) * r.atr + (1.0 / 14) * s.tr END,
    CASE WHEN s.rn = 14 THEN s.pdm_seed WHEN s.rn > 14 THEN (13.0 / 14) * r.sp + s.pdm END,
    CASE WHEN s.rn = 14 THEN s.mdm_seed WHEN s.rn > 14 THEN (13.0 / 14) * r.sm + s.mdm END
  FROM rec r JOIN s3 s ON s.symbol = r.symbol AND s.rn = r.rn + 1),
s4 AS (
  SELECT s3.*,
    CASE WHEN s3.rn >= 11 THEN rec.e12 END AS ema_12,
    CASE WHEN s3.rn >= 25 THEN rec.e26 END AS ema_26,
    CASE WHEN s3.rn < 13 THEN NULL WHEN rec.rd = 0 THEN 100.0
         ELSE 100.0 - 100.0 / (1.0 + rec.ru / rec.rd) END AS rsi,
    CASE WHEN s3.rn >= 25 THEN rec.e12 - rec.e26 END AS macd,
    CASE WHEN s3.rn < 13 THEN 0.0 ELSE rec.atr END AS atr,
    CASE WHEN rec.sp IS NULL OR rec.sm IS NULL THEN NULL
         ELSE coalesce(100.0 * {dv('abs(rec.sp - rec.sm)', 'rec.sp + rec.sm')}, 0.0) END AS dx
  FROM s3 JOIN rec ON rec.symbol = s3.symbol AND rec.rn = s3.rn),
s5 AS (SELECT *, {full(14, 'avg', 'dx')} AS dx_seed FROM s4),
rec2 AS (
  SELECT symbol, rn, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS adx FROM s5 WHERE rn = 0
  UNION ALL
  SELECT s.symbol, s.rn,
    CASE WHEN s.rn = 25 THEN s.macd WHEN s.rn > 25 THEN 0.8 * r.sig + 0.2 * s.macd END,
    CASE WHEN s.rn = 27 THEN s.dx_seed WHEN s.rn > 27 THEN (13.0 / 14) * r.adx + (1.0 / 14) * s.dx END
  FROM rec2 r JOIN s5 s ON s.symbol = r.symbol AND s.rn = r.rn + 1),
tech AS (
  SELECT s5.*, CASE WHEN s5.rn >= 33 THEN rec2.sig END AS macd_signal, rec2.adx AS adx
  FROM s5 JOIN rec2 ON rec2.symbol = s5.symbol AND rec2.rn = s5.rn),
feat AS (
  SELECT *,
    {dv('close', 'sma_20')} AS price_to_sma20, {dv('close', 'sma_50')} AS price_to_sma50,
    {flag('sma_10 > sma_20')} AS sma_10_20_cross, {flag('sma_20 > sma_50')} AS sma_20_50_cross,
    {flag('rsi < 30')} AS rsi_oversold, {flag('rsi > 70')} AS rsi_overbought,
    macd - macd_signal AS macd_diff, {flag('macd > macd_signal')} AS macd_bullish,
    100.0 * {dv('close - c10', 'c10')} AS roc_10, 100.0 * {dv('close - c20', 'c20')} AS roc_20,
    sma_20_bb + 2.0 * bb_sd AS bb_upper, sma_20_bb AS bb_middle, sma_20_bb - 2.0 * bb_sd AS bb_lower,
    100.0 * {dv('4.0 * bb_sd', 'sma_20_bb')} AS bb_width,
    {dv('close - (sma_20_bb - 2.0 * bb_sd)', '4.0 * bb_sd')} AS bb_pct,
    {flag('close > sma_20_bb + 2.0 * bb_sd')} AS price_above_bb_upper,
    {flag('close < sma_20_bb - 2.0 * bb_sd')} AS price_below_bb_lower,
    100.0 * {dv('atr', 'close')} AS atr_pct,
    {dv('volume', 'volume_sma_20')} AS volume_ratio,
    {flag(f"{dv('volume', 'volume_sma_20')} > 2.0")} AS volume_spike,
    {dv('close', 'vwap')} AS price_to_vwap,
    CASE WHEN mfn = 0 THEN (CASE WHEN mfp > 0 THEN 100.0 END)
         ELSE 100.0 - 100.0 / (1.0 + mfp / mfn) END AS mfi,
    high - low AS high_low_range, 100.0 * {dv('high - low', 'close')} AS high_low_pct,
    {dv('close - low', 'high - low')} AS close_position,
    {flag('open > h1')} AS gap_up, {flag('open < l1')} AS gap_down,
    abs(close - open) AS body, high - greatest(open, close) AS upper_shadow,
    least(open, close) - low AS lower_shadow,
    {flag('abs(close - open) < (high - low) * 0.1')} AS is_doji,
    {flag('adx > 25')} AS strong_trend, {flag('adx < 20')} AS weak_trend,
    aroon_up - aroon_down AS aroon_indicator,
    {dv('close', 'c5')} - 1 AS momentum_5, {dv('close', 'c10')} - 1 AS momentum_10,
    {dv('close', 'c20')} - 1 AS momentum_20,
    volatility_30 AS rolling_volatility,
    100.0 * {dv('sma_20 - sma_50', 'sma_50')} AS trend_strength
  FROM (SELECT *, {full(20, 'avg', 'close')} AS sma_20_bb FROM tech)),
reg1 AS (
  SELECT *,
    CASE WHEN trend_strength > 2 THEN 1 WHEN trend_strength < -2 THEN -1 ELSE 0 END AS trend_regime,
    list_filter(list(rolling_volatility) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), lambda z: z IS NOT NULL) AS rvs
  FROM feat),
reg2 AS (
  SELECT *,
    CASE WHEN rolling_volatility IS NOT NULL AND len(rvs) >= 50 THEN
      (len(list_filter(rvs, lambda z: z < rolling_volatility))
       + (len(list_filter(rvs, lambda z: z = rolling_volatility)) + 1) / 2.0) / len(rvs) END
      AS volatility_percentile,
    CASE WHEN lag(trend_regime) OVER ({W}) IS NULL
           OR lag(trend_regime) OVER ({W}) <> trend_regime THEN 1 ELSE 0 END AS chg
  FROM reg1),
reg3 AS (SELECT *, sum(chg) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM reg2),
features AS (
  SELECT *,
    CASE WHEN volatility_percentile IS NULL THEN NULL WHEN volatility_percentile <= 0.33 THEN 0.0
         WHEN volatility_percentile <= 0.67 THEN 1.0 WHEN volatility_percentile <= 1.0 THEN 2.0 END
      AS volatility_regime,
    CASE WHEN volume_percentile IS NULL THEN NULL WHEN volume_percentile <= 0.33 THEN 0.0
         WHEN volume_percentile <= 0.67 THEN 1.0 WHEN volume_percentile <= 1.0 THEN 2.0 END
      AS volume_regime,
    {flag('trend_regime = 1')} AS uptrend, {flag('trend_regime = -1')} AS downtrend,
    {flag('trend_regime = 0')} AS ranging,
    CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY date) AS INTEGER) AS trend_persistence
  FROM reg3)"""

REGIME_FLAGS = """,
features2 AS (
  SELECT *, CASE WHEN volatility_regime = 0 THEN 1 ELSE 0 END AS low_volatility,
    CASE WHEN volatility_regime = 2 THEN 1 ELSE 0 END AS high_volatility,
    CASE WHEN volume_regime = 0 THEN 1 ELSE 0 END AS low_volume,
    CASE WHEN volume_regime = 2 THEN 1 ELSE 0 END AS high_volume
  FROM features)"""

INT_COLS = {
    "sma_10_20_cross", "sma_20_50_cross", "rsi_oversold", "rsi_overbought", "macd_bullish",
    "price_above_bb_upper", "price_below_bb_lower", "volume_spike", "gap_up", "gap_down",
    "is_doji", "strong_trend", "weak_trend", "trend_regime", "uptrend", "downtrend", "ranging",
    "trend_persistence", "low_volatility", "high_volatility", "low_volume", "high_volume",
}


def feature_sql(cols: list[str], where: str | None = None) -> str:
    """``symbol, date`` and ``cols`` (doubles rounded to 6 places) for every bar."""
    sel = ", ".join(c if c in INT_COLS else f"{r6(c)} AS {c}" for c in cols)
    cond = f" WHERE {where}" if where else ""
    return f"WITH RECURSIVE {CHAIN}{REGIME_FLAGS}\nSELECT symbol, date, {sel} FROM features2{cond}"


def with_bars(body: str) -> str:
    return f"WITH {BARS}\n{body}"
