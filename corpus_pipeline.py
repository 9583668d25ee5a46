"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import cut, read_table
from barflow.llm.exact_dedup import drop_copies
from barflow.llm.lang_id import UNDETERMINED, UNLABELLED, identify, labelled_samples
from barflow.llm.mixing import mixed
from barflow.llm.ngram_join import keep_one_of_each
from barflow.llm.packing import pack_documents
from barflow.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters go. Where ``lang`` is NULL it
    becomes the predicted language; a named one stays. If no row is labelled, nothing can be
    learned: all documents with letters stay, and ``lang`` stays NULL.

    NULL text has no letters. Repeated rows stay repeated, NULL ids and further columns stay as they
    are, whatever their names; an empty table gives an empty one."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = identify(docs, labelled_samples(docs) or UNLABELLED, [whole], inside="_row")
    own = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    own["lang"] = F.coalesce(own["lang"], F.nullif(F.col("lang_pred"), F.lit(""))).alias("lang")
    return found.where(F.col("lang_pred") != UNDETERMINED).select(*[own[c] for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space: the longest, then the
    one with the smallest id (a NULL id last), of repeated rows any one.

    NULL text counts as empty, and all empty texts are one group. Further columns, maps
    included, stay as they are, whatever their names; an empty table gives an empty one."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more):
    the one with the smallest id (a NULL id last).

    A document without words is linked with nothing and stays. Further columns, maps included,
    stay as they are, whatever their names; an empty table gives an empty one."""
    return keep_one_of_each(docs, words=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of sources takes them (:func:`barflow.llm.mixing.mixed`).

    Documents without words stay once; a NULL source is a source of its own, rows without id or
    repeated ones are documents like others. Further columns, maps included, stay as they
    are, whatever their names; an empty table gives an empty one."""
    return mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed training sequences with their token ids. NULL text counts as empty; repeated
    rows and NULL ids are documents like others; an empty table gives an empty one."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", dedup_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Language ID, shingle joins and token packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
