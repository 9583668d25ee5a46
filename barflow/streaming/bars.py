"""Live OHLCV bars and latest quotes with Structured Streaming.

Both read a folder of tick files incrementally (``readStream``), survive
restarts through their checkpoint folder, and run with ``availableNow`` in
tests (all available data, then stop) or a processing-time trigger live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barflow.sources.store import remove
from barflow.sources.ticks import event_ticks

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def tick_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet") -> DataFrame:
    """Event files as a tick stream; ``ts`` becomes a zoned timestamp
    (session zone) because a watermark on ``TIMESTAMP_NTZ`` is rejected.
    ``seq`` orders ticks of the same time."""
    raw = (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
                .option("maxFilesPerTrigger", 64).parquet(folder))
    return event_ticks(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def live_bars(ticks: DataFrame, interval: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Windowed bars; a bar is emitted once the watermark passes its end and
    ticks later than the watermark are dropped. Open and close follow
    ``(ts, seq)``, as in the batch bars."""
    order = F.struct("ts", "seq")
    return (ticks.withWatermark("ts", watermark)
                 .groupBy(F.window("ts", interval).alias("w"), "symbol")
                 .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
                      F.min("price").alias("low"), F.max_by("price", order).alias("close"),
                      F.sum("size").alias("volume"))
                 .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"),
                         "open", "high", "low", "close", "volume"))


BARS_OUT = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
QUOTES_OUT = "symbol string, last_ts timestamp_ntz, current_price double, n_ticks bigint"


def run_live_bars(spark: SparkSession, folder: str, out: str, checkpoint: str,
                  interval: str = "1 hour", watermark: str = "1 hour",
                  available_now: bool = True) -> DataFrame | StreamingQuery:
    """Append closed bars to Parquet at ``out``. With ``available_now`` all
    data at hand are processed and the table is returned; otherwise the
    handle of the running query is, to watch or stop it."""
    q = (live_bars(tick_stream(spark, folder), interval, watermark)
         .writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", checkpoint))
    if not available_now:
        return q.trigger(processingTime="10 seconds").start(out)
    q.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(BARS_OUT).parquet(out)


#: Batches of changes after which they are merged into one table.
COMPACT_EVERY = 10


def latest_quotes(ticks: DataFrame) -> DataFrame:
    order = F.struct("ts", "seq")
    return ticks.groupBy("symbol").agg(
        F.max("ts").alias("last_ts"), F.max_by("price", order).alias("current_price"),
        F.count(F.lit(1)).alias("n_ticks")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


def run_latest_quotes(spark: SparkSession, folder: str, out: str, checkpoint: str,
                      available_now: bool = True, compact_every: int = COMPACT_EVERY) -> DataFrame | StreamingQuery:
    """Latest quote per symbol, kept up to date.

    The streaming aggregate's state holds one row per symbol, and a batch writes only the
    symbols that it changed (update mode), whole rows, to a folder of its own named by the
    batch's number; a batch that is run again writes the same folder. The table is
    each symbol's row of the latest batch. Every ``compact_every`` batches the changes are
    merged into one folder, and the older ones are removed once that is complete. If the
    folders are lost, the next batch writes all symbols anew from the tick files.
    Returns the table, or the query's handle if it runs on."""

    def store(batch: DataFrame, batch_id: int) -> None:
        lost = batch_id > 0 and not stored_batches(spark, out)
        batch.select("symbol", "last_ts", "current_price", "n_ticks").write.mode("overwrite").parquet(f"{out}/delta={batch_id}")
        if lost:  # whole rows of all symbols; later batches overwrite what they change
            ticks = spark.read.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events*.parquet").parquet(folder)
            latest_quotes(event_ticks(ticks).withColumn("ts", F.col("ts").cast("timestamp"))) \
                .write.mode("overwrite").parquet(f"{out}/base={batch_id}")
        have = stored_batches(spark, out)
        base = max((i for k, i in have if k == "base"), default=-1)
        if sum(k == "delta" and i > base for k, i in have) >= compact_every:
            read_quotes(spark, out).write.mode("overwrite").parquet(f"{out}/base={batch_id}")
            for k, i in have:  # a batch folder of the same number is part of the new base
                remove(spark, f"{out}/{k}={i}")

    q = latest_quotes(tick_stream(spark, folder)).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    if not available_now:
        return q.trigger(processingTime="10 seconds").start()
    q.trigger(availableNow=True).start().awaitTermination()
    return read_quotes(spark, out)


def stored_batches(spark: SparkSession, out: str) -> list[tuple[str, int]]:
    """``(kind, batch)`` of the folders that were written to the end, by batch."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = make(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName().split("=") for s in fs.listStatus(path)]
    found = [(n[0], int(n[1])) for n in names if len(n) == 2 and n[0] in ("base", "delta")]
    return sorted((x for x in found if fs.exists(make(f"{out}/{x[0]}={x[1]}/_SUCCESS"))), key=lambda x: (x[1], x[0]))


def read_quotes(spark: SparkSession, out: str) -> DataFrame:
    """The quote table: of every symbol the row of the latest batch; empty before the first."""
    have = stored_batches(spark, out)
    base = max((i for k, i in have if k == "base"), default=-1)
    rows = spark.createDataFrame([], QUOTES_OUT).withColumn("batch", F.lit(0).cast("long"))
    for kind, i in have:
        if i > base or (kind, i) == ("base", base):
            rows = rows.unionByName(spark.read.schema(QUOTES_OUT).parquet(f"{out}/{kind}={i}").withColumn("batch", F.lit(i).cast("long")))
    own = F.struct("last_ts", "current_price", "n_ticks")
    return rows.groupBy("symbol").agg(F.max_by(own, "batch").alias("q")).select("symbol", "q.*")
