"""Adapters from the driver's tables to the tick / raw-bar schemas.

They only rename and project columns; no job work happens here.

* ``TICKS``: ``symbol string, ts timestamp_ntz, price double, size double,
  seq <integer>`` -- ``seq`` (at most 20 digits, optional) orders trades inside a timestamp.
* ``RAW_BARS``: ``symbol, date, open, high, low, close, volume`` plus an
  ``arrival`` column (later arrival wins on duplicate dates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_ticks(lineitem: DataFrame) -> DataFrame:
    """One trade per line item: symbol = return flag || line status,
    price = extended price / quantity, size = quantity. ``(l_orderkey,
    l_linenumber)`` repeats in the data, so ``seq`` is order, line and part
    key in one number (10, 1 and 9 digits)."""
    return lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_orderkey").cast("decimal(10,0)") * F.lit(10_000_000_000)
         + (F.col("l_linenumber").cast("long") * F.lit(1_000_000_000) + F.col("l_partkey"))).cast("decimal(20,0)").alias("seq"))


def event_ticks(events: DataFrame) -> DataFrame:
    """One trade per event: symbol = event type, price = value, size = 1.
    ``event_id`` orders events of the same time."""
    return events.select(F.col("event_type").alias("symbol"), "ts",
                         F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))


def orders_raw_bars(orders: DataFrame, null_every: int | None = 17) -> DataFrame:
    """A dirty daily close series: symbol = order priority, date = order date,
    close = total price, arrival = order key. Natural duplicate dates occur;
    every ``null_every``-th order key gets a NULL close (a deterministic rule
    the SQL oracle can repeat) so the fill steps have work to do."""
    close = F.col("o_totalprice")
    if null_every:
        close = F.when(F.col("o_orderkey") % null_every == 0, F.lit(None).cast("double")).otherwise(close)
    return orders.select(
        F.col("o_orderpriority").alias("symbol"),
        F.to_date("o_orderdate").alias("date"),
        close.alias("open"), close.alias("high"), close.alias("low"), close.alias("close"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_custkey").cast("double")).alias("volume"),
        F.col("o_orderkey").alias("arrival"))


def dirty_bars(orders: DataFrame) -> DataFrame:
    """A series that breaks every quality rule: symbol = order priority and
    customer key mod 40, with NULL dates (every 211th order), NULL and negative
    closes (17th, 101st), negative volumes (103rd) and, for the lowest priority,
    many NULL volumes; long gaps and repeated dates occur by themselves."""
    k = F.col("o_orderkey")
    close = F.when(k % 17 == 0, None).when(k % 101 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    cust = F.col("o_custkey").cast("double")
    volume = (F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_custkey") % 3 == 0), None)
               .when(k % 103 == 0, -cust).otherwise(cust))
    return orders.select(
        F.concat(F.col("o_orderpriority"), F.lit("-"), F.col("o_custkey") % 40).alias("symbol"),
        F.when(k % 211 != 0, F.to_date("o_orderdate")).alias("date"),
        close.alias("open"), close.alias("high"), close.alias("low"), close.alias("close"), volume.alias("volume"), k.alias("arrival"))
