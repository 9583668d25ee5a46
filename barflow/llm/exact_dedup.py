"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups.

Rows with NULL text count as empty text; a NULL id sorts after all other ids.
Rows repeated with the same id are separate rows of one group, and exactly one
of them stays. Empty input gives an empty result. Only the id and the text
column are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import SPACE, apply_copies, cut, row_key, text_or_empty


def without_space(text: Column) -> Column:
    """Text with every character of [\\x20\\x09-\\x0D] deleted."""
    return F.regexp_replace(text, SPACE + "+", "")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _best() -> Column:
    """Order of preference: most code points, then smallest id (NULL last), then row."""
    return F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("x"),
                    F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] = without_space,
                digest: Callable[[Column], Column] = md5_128, carry: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and,
    if given, the 64-bit column ``carry``.

    1. Every row gets the 128-bit digest of its normalised text. The small key
       rows are written once; groups are counted from them with map-side
       partial aggregation, so a group of any size is one row per task.
    2. The texts are grouped by (digest, bytes) to find digests shared by
       different texts. Copies collapse before the exchange, so each text
       moves once per task that holds it, at every input size.
    3. Rows of a digest without collision take the group's best row. Rows of
       a colliding digest are grouped by the bytes themselves.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"),
                       (F.lit(None) if carry is None else carry).cast("long").alias("carry"))
    normed = base.select("doc_id", "carry", F.length("text").alias("n_points"), normalise(F.col("text")).alias("norm"))
    keyed = normed.select("doc_id", "carry", "n_points", digest(F.col("norm")).alias("h"), "norm")
    keys = cut(keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "carry", "n_points", "h",
                            F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-keys")

    groups = cut(keys.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), F.min(_best()).alias("best"))
                     .where("group_size > 1"), "dedup-groups")
    texts = keyed.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("copies"))
    collided = cut(texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"),
                   "dedup-collided")

    plain = keys.join(collided, "h", "left_anti").join(groups, "h", "left")
    plain = plain.select(
        "doc_id", "carry", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))

    rest = cut(keyed.join(collided, "h", "left_semi")
                    .withColumn("row", F.monotonically_increasing_id()), "dedup-rest")
    exact = cut(rest.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.min(_best()).alias("best")),
                "dedup-exact")
    rest = rest.join(exact, ["h", "norm"]).select(
        "doc_id", "carry", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long"),
        (F.col("best.row") == F.col("row")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
    out = plain.unionByName(rest)
    return out.drop("carry") if carry is None else out


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    found = exact_dedup(docs, id_col, text_col, carry=row_key(docs))
    return apply_copies(docs, found.where("kept").select("doc_id", "carry", F.lit(1).alias("copies")), id_col)
