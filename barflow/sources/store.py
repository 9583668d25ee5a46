"""Sinks: silver bar table, pipeline status, model and metadata persistence."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.session import ensure_checkpoint_dir


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Name ``version`` as the current one, by renaming a finished file over the old one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged, fs = _fs(spark, f"{path}/_next-{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fs.makeQualified(staged), fs.makeQualified(_fs(spark, f"{path}/_current")[0]), options)


def silver_versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the versions at hand, oldest first (names begin with a running number)."""
    p, fs = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith("v"))


def current_version(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, f"{path}/_current")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_silver(df: DataFrame, path: str, key: str = "symbol", order: str = "date") -> str:
    """Write cleaned bars partitioned by symbol, sorted by date inside files.

    The write is repartitioned by ``(key, year)`` so a hot symbol is spread
    over several writers. It goes to a folder of its own; only when that is
    complete is it named the current version, by one rename. A reader sees the old
    table until then, also if the write fails, and may go on reading it
    until the version after the next is published. Returns the version's name."""
    spark = df.sparkSession
    known = silver_versions(spark, path)
    number = int(known[-1][1:13]) + 1 if known else 1
    version = f"v{number:012d}-{uuid.uuid4().hex[:8]}"
    (df.repartition(key, F.year(order)).sortWithinPartitions(key, order)
       .write.partitionBy(key).parquet(f"{path}/{version}"))
    before = current_version(spark, path)
    _publish(spark, path, version)
    # What failed writes have left, and versions that no reader began with any more.
    for old in known:
        if old != before:
            remove(spark, f"{path}/{old}")
    return version


def read_silver(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """The current version; an error if nothing has been published."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table has been published at {path}")
    df = spark.read.parquet(f"{path}/{version}")
    return df if symbols is None else df.where(F.col("symbol").isin(symbols))


_TABLES: dict[str, list[str]] = {}


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as Parquet under the shared checkpoint folder and
    read it back: a lineage cut that survives executor loss. Every call writes
    a folder of its own; :func:`release` removes them."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer (local or shared)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete the tables that :func:`cut_lineage` has written for this
    application; call it when the frames read from them are done with."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def pipeline_status(df: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    """Rows and date range per symbol."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"),
                               F.min(order).alias("start_date"), F.max(order).alias("end_date"))


def save_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """Store run metadata as one JSON row (values made JSON-safe)."""
    safe = json.loads(json.dumps(meta, default=str))
    spark.createDataFrame([(json.dumps(safe),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path).first()
    return json.loads(row[0]) if row else {}
