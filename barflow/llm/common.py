"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import io
import math
import os
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import barflow
from barflow.sources.store import cut_lineage

#: Java pattern of the white space that separates words: [\x20\x09-\x0D].
SPACE = r"[ \t-\r]"
#: Java pattern of one word.
WORD = r"[^ \t-\r]+"

_SHIPPED: set[str] = set()
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, made on first use. It keeps one thing, the last:
    workers outlive an operator, and what the one before has left counts in the executor's memory."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Give back what this Python worker has kept for an earlier operator."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    tasks import it whatever the cluster's PYTHONPATH is."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(barflow.__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("barflow", os.path.relpath(p, root)))
    # A driver-side staging file; Spark's own file server hands it to executors.
    path = os.path.join(tempfile.mkdtemp(prefix="barflow-src-"), "barflow_src.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read it
    back: a lineage cut that survives the loss of any executor. The tables are
    removed by :func:`barflow.sources.store.release`."""
    return cut_lineage(df, f"llm-{name}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_digits_for(rows: int, per_bucket: int = 50_000) -> int:
    """Leading hex digits of a hash that split ``rows`` rows into buckets of
    about ``per_bucket`` rows or fewer."""
    return max(1, math.ceil(math.log(max(rows, 1) / per_bucket, 16))) if rows > per_bucket else 1


def global_running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Add inclusive running sums over the whole frame in the given total order.

    The rows are range-partitioned and written once with their partition
    number. Each partition sums its own rows; the offsets come from a table
    with one row per partition. No task sees more than one range."""
    d = (df.select("*", *[c.alias(f"_v_{k}") for k, c in sums.items()])
           .repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    d = cut(d, name)
    parts = d.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}")
                                      for k in sums])
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(offsets), "_part")  # one row per shuffle partition
    return (d.select("*", *[(F.col(f"_o_{k}") + F.sum(f"_v_{k}").over(w)).alias(k) for k in sums])
             .drop("_part", *[f"{p}_{k}" for k in sums for p in ("_v", "_o")]))


def _hashable(value: Column, kind: T.DataType) -> Column:
    """The value with every map, at any depth, as an array of its entries by key: maps have no hash
    of their own, and equal maps may hold their entries in any order."""
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_sort(_hashable(F.map_entries(value), T.ArrayType(entry)))
    if isinstance(kind, T.ArrayType) and _has_map(kind.elementType):
        return F.transform(value, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        own = F.struct(*[_hashable(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), own)
    return value


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def row_key(docs: DataFrame) -> Column:
    """64-bit hash of a whole row; rows that are equal in every column share it."""
    return F.xxhash64(*[_hashable(F.col(f"`{c}`"), docs.schema[c].dataType) for c in sorted(docs.columns)])


def apply_copies(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as ``decided(doc_id, carry, copies)`` says.

    ``carry`` is :func:`row_key`. Equal rows share a key: one of them is emitted
    as often as all of them together were granted."""
    cols = [F.col(f"_docs.`{c}`") for c in docs.columns]
    granted = decided.where("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("carry").alias("_key")) \
                     .agg(F.sum("copies").alias("_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs"),
                       F.col(id_col).cast("long").alias("_row_id"), row_key(docs).alias("_row_key"))
    joined = rows.join(granted.hint("merge"), F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key")))
    first = Window.partitionBy("_row_id", "_row_key").orderBy(F.lit(0))
    once = joined.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long")))).select(*cols)
