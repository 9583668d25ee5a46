"""Bars: build OHLCV bars from ticks, read bar files, range and zone helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.sources.store import cut_lineage

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume"]

BARS_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

_UNITS = {"1d": "day", "day": "day", "1h": "hour", "hour": "hour",
          "1m": "minute", "minute": "minute", "1wk": "week", "week": "week",
          "1mo": "month", "month": "month"}


def no_nan(df: DataFrame) -> DataFrame:
    """Missing values are NULL, never NaN: every floating-point NaN becomes NULL."""
    kinds = (T.DoubleType, T.FloatType)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, kinds)}
    own = lambda c: F.col(f"`{c}`")
    return df.select(*[F.when(~F.isnan(own(c)), own(c)).alias(c) if c in floats else own(c) for c in df.columns])


def bar_time(ts: Column, interval: str) -> Column:
    """Bar start for an interval; daily and longer bars are DATEs."""
    unit = _UNITS[interval]
    if unit in ("day", "week", "month"):
        return F.to_date(F.date_trunc(unit, ts))
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


#: Decimal digits of ``seq`` inside the order key; ``ts`` in microseconds takes the others.
SEQ_DIGITS = 20


def order_key(ts: Column, seq: Column | None = None) -> Column:
    """``(ts, seq)`` as one fixed-width value, which a hash aggregate can keep
    in its buffer (a struct would force a sort of all ticks). ``seq`` is an
    integer of at most ``SEQ_DIGITS`` digits, not negative; without it ``ts``
    alone is the key."""
    micros = F.unix_micros(ts.cast("timestamp"))
    if seq is None:
        return micros
    scale = F.lit("1" + "0" * SEQ_DIGITS).cast(f"decimal({SEQ_DIGITS + 1},0)")
    return (micros.cast("decimal(17,0)") * scale + seq.cast(f"decimal({SEQ_DIGITS},0)")).cast("decimal(38,0)")


def bars_from_ticks(ticks: DataFrame, interval: str = "1d", order: str = "date", symbols: list[str] | None = None,
                    start: dt.date | str | None = None, end: dt.date | str | None = None) -> DataFrame:
    """OHLCV bars per ``(symbol, bar)``: open/close are the prices of the
    first/last trade by ``(ts, seq)``, high/low the extremes, volume the
    summed size. One hash exchange on ``(symbol, bar)`` after a map-side
    partial hash aggregate, so a hot symbol is pre-aggregated before it moves.

    ``symbols`` and the days ``start <= day < end`` are applied to the raw
    columns, so that the scan can skip files and row groups."""
    t = ticks
    if symbols is not None:
        t = t.where(F.col("symbol").isin(list(symbols)))
    ts_type = t.schema["ts"].dataType.simpleString()
    if start is not None:
        t = t.where(F.col("ts") >= F.lit(str(start)).cast(ts_type))
    if end is not None:
        t = t.where(F.col("ts") < F.lit(str(end)).cast(ts_type))
    seq = F.col("seq") if "seq" in t.columns else None
    t = no_nan(t)
    t = t.select("symbol", bar_time(F.col("ts"), interval).alias(order), "price", "size", order_key(F.col("ts"), seq).alias("_o"))
    return (t.groupBy("symbol", order)
             .agg(F.min_by("price", "_o").alias("open"), F.max("price").alias("high"),
                  F.min("price").alias("low"), F.max_by("price", "_o").alias("close"),
                  F.sum("size").alias("volume")))


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None,
              start: dt.date | str | None = None, end: dt.date | str | None = None,
              fmt: str = "parquet") -> DataFrame:
    """Read bar files with a fixed schema; symbol and date filters reach the scan."""
    df = spark.read.schema(BARS_SCHEMA).format(fmt).load(path)
    return select_bars(df, symbols, start, end)


def select_bars(bars: DataFrame, symbols: list[str] | None = None,
                start: dt.date | str | None = None, end: dt.date | str | None = None) -> DataFrame:
    """Keep ``symbols`` and ``start <= date < end``; fixed column order."""
    cond = F.lit(True)
    if symbols is not None:
        cond = cond & F.col("symbol").isin(list(symbols))
    if start is not None:
        cond = cond & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (F.col("date") < F.lit(end).cast("date"))
    return no_nan(bars.where(cond).select(*BAR_COLUMNS))


def lookback(bars: DataFrame, days: int, order: str = "date") -> DataFrame:
    """Keep the last ``days`` calendar days of each symbol, relative to the
    symbol's own latest bar (never the wall clock). The per-symbol maximum is
    a partial aggregate, written once: its size is then known, so a small
    table is broadcast and the bars stay where they are; with a large one both
    sides are plain exchanges, in which a hot symbol is split."""
    last = cut_lineage(bars.groupBy("symbol").agg(F.max(order).alias("_last")), "last-bar")
    return (bars.join(last, "symbol")
                .where(F.col(order) >= F.date_sub(F.col("_last"), days))
                .drop("_last"))


def strip_zone(df: DataFrame, col: str, zone: str) -> DataFrame:
    """UTC wall-clock ``TIMESTAMP_NTZ`` -> wall clock in ``zone``, still without
    a zone; independent of the session time zone."""
    return df.withColumn(col, F.convert_timezone(F.lit("UTC"), F.lit(zone),
                                                 F.col(col).cast("timestamp_ntz")))
