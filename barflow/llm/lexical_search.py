"""Ranked lexical search over norm buckets (LEMP).

A document's impact vector has, for each term, ``x = (1000000000 * tf) div
(1000 * tf + 12 * m)`` with ``m = 75 + (25 * n * N) div L``; a query's vector counts its
terms. A document's score is the inner product with the terms' weights ``w`` between;
for the bounds each side takes the square root of ``w``. Only the terms of the
queries matter, so vectors and lengths are those of the subspace they span.

1. Queries are taken in blocks of bounded size. One pass over the texts counts the
   block's terms in every document and writes these vectors.
2. ``N``, ``L`` and the terms' document counts are summed over all documents.
3. The vectors are dealt by row number, ordered by length in each partition (longest
   first) and written, so that every task has long and short ones.
4. The longest vectors are searched first. Their k-th best scores are the thresholds with
   which all others are searched. Within a task vectors come in buckets: one whose
   greatest length times the query's length stays below the threshold is passed over
   (Cauchy-Schwarz). Inside a bucket the query's largest coordinates are added up for every
   vector, and the rest is bounded by the lengths of both remainders. Survivors
   are scored exactly in 64-bit integers, and raise the task's own threshold.

Bounds are computed in doubles with a margin, so nothing that reaches the k-th score is
passed over. NULL text has no terms: such documents are not found and do not count, such
queries find nothing. Repeated rows are separate documents and queries; among equal scores
a NULL id comes last. Empty tables give an empty result. Only ids and texts are read, so
other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import cut, global_running, ship, text_or_empty
from barflow.llm.packing import steps

#: Bytes of query texts in a block, each query counted as ``QUERY_BYTES`` more.
BLOCK_BYTES, QUERY_BYTES = 4_000_000, 256
#: Bytes of text counted at a time; vectors a bucket holds at first and at most.
STEP_BYTES, FIRST_BUCKET, BUCKET = 4_000_000, 256, 8192
#: Coordinates of a query that are added up before the rest is bounded.
FOCUS = 8
#: Share of the vectors (the longest) that give the first thresholds.
FIRST_SHARE = 1 / 32
#: Relative margin of bounds in doubles.
MARGIN = 1e-9

#: Bytes that are no part of a term become spaces, A-Z become a-z; all bytes of other characters stay.
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
COUNTS = "uid bigint, doc_id bigint, n bigint, terms array<int>, tfs array<int>"
VECTORS = "uid bigint, doc_id bigint, norm double, terms array<int>, impacts array<int>"
FOUND = "query int, score bigint, doc_id bigint, uid bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and each list's size."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy().astype(np.int64), np.diff(ends).astype(np.int64)


def _count_terms(vocabulary: dict[bytes, int], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of every text; its distinct known terms, their counts and how many they are."""
    get, n, terms, tfs, sizes = vocabulary.get, [], [], [], []
    for t in raw:
        words = terms_of(t)
        own = np.fromiter((i for i in map(get, words) if i is not None), dtype=np.int64)
        distinct, count = np.unique(own, return_counts=True)
        n.append(len(words))
        terms.append(distinct)
        tfs.append(count)
        sizes.append(len(distinct))
    return np.array(n, dtype=np.int64), np.concatenate(terms), np.concatenate(tfs), np.array(sizes, dtype=np.int64)


class Query:
    """A query's term numbers by falling coordinate, with integer and real factors."""

    def __init__(self, counts: dict[int, int], weights: np.ndarray):
        terms = np.array(sorted(counts), dtype=np.int64)
        tf = np.array([counts[t] for t in terms.tolist()], dtype=np.int64)
        keep = weights[terms] > 0
        terms, tf = terms[keep], tf[keep]
        coordinate = tf * np.sqrt(weights[terms])
        order = np.argsort(-coordinate, kind="stable")
        self.terms, self.coordinates = terms[order], coordinate[order]
        self.factors = (tf * weights[terms])[order]
        self.length = float(np.sqrt(np.sum(self.coordinates ** 2)))
        self.rest = float(np.sqrt(np.sum(self.coordinates[FOCUS:] ** 2)))


class Bucket:
    """Some impact vectors: by term for the bounds, by (vector, term) for exact scores."""

    def __init__(self, terms: np.ndarray, impacts: np.ndarray, sizes: np.ndarray, norms: np.ndarray, roots: np.ndarray):
        self.n, self.width, self.norms = len(sizes), len(roots), norms
        row = np.repeat(np.arange(self.n), sizes)
        self.keys, self.impacts = row * self.width + terms, impacts
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = row[order], (impacts * roots[terms])[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=self.width))])

    def survivors(self, query: Query, threshold: float) -> np.ndarray:
        """Vectors whose bound reaches the threshold."""
        near = self.norms * query.length * (1 + MARGIN) >= threshold
        if not near.any():
            return np.zeros(0, dtype=np.int64)
        score, square = np.zeros(self.n), np.zeros(self.n)
        for t, c in zip(query.terms[:FOCUS].tolist(), query.coordinates[:FOCUS].tolist(), strict=True):
            rows, values = self.rows[self.at[t]:self.at[t + 1]], self.values[self.at[t]:self.at[t + 1]]
            score[rows] += c * values
            square[rows] += values * values
        # The margin is one of the whole length: differences of squares lose digits.
        left = np.sqrt(np.maximum(self.norms ** 2 * (1 + MARGIN) - square, 0))
        return np.flatnonzero(near & ((score + query.rest * left) * (1 + MARGIN) >= threshold))

    def scores(self, query: Query, rows: np.ndarray) -> np.ndarray:
        wanted = rows[:, None] * self.width + query.terms[None, :]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.impacts[place], 0) @ query.factors


class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, max(threshold, 1)  # only scores above 0 count
        self.rows: list[tuple] = []

    def add(self, scores: list[int], ids: list, uids: list[int]) -> None:
        self.rows += [(-s, i is None, i or 0, u) for s, i, u in zip(scores, ids, uids, strict=True) if s >= self.threshold]
        self.rows.sort()
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.threshold = max(self.threshold, -self.rows[-1][0])


def _search(vectors: DataFrame, queries, weights, thresholds, k: int) -> DataFrame:
    """Each task's k best documents of every query, of those that reach the thresholds."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        roots = np.sqrt(w)
        asked = [Query(counts, w) for counts in queries.value]
        best = [Best(k, int(t)) for t in thresholds.value]
        lengths = np.array([q.length for q in asked])
        size = FIRST_BUCKET
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size)
                at, size = at + size, min(2 * size, BUCKET)
                terms, sizes = _flat(part.column(3))
                norms = part.column(2).to_numpy()
                bucket, ids, uids = None, part.column(1).to_pylist(), part.column(0).to_pylist()
                bound = lengths * norms.max() * (1 + MARGIN)
                for i in np.flatnonzero(bound >= [b.threshold for b in best]).tolist():
                    if bucket is None:
                        bucket = Bucket(terms, _flat(part.column(4))[0], sizes, norms, roots)
                    rows = bucket.survivors(asked[i], best[i].threshold)
                    if len(rows):
                        got = bucket.scores(asked[i], rows)
                        best[i].add(got.tolist(), [ids[r] for r in rows.tolist()], [uids[r] for r in rows.tolist()])
        out = [(i, -s, None if none else d, u) for i, b in enumerate(best) for s, none, d, u in b.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True),
                (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["query", "score", "doc_id", "uid"])

    return vectors.mapInArrow(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[bytes], k: int) -> DataFrame:
    """``query, rank, doc_id, score`` for a block of queries; ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    numbers: dict[bytes, int] = {}
    counts = [dict(Counter(numbers.setdefault(t, len(numbers)) for t in terms_of(text))) for text in texts]
    width = max(len(numbers), 1)
    vocabulary, queries = sc.broadcast(numbers), sc.broadcast(counts)  # at most a block's bytes of terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for own, raw in steps(batch.column(0), batch.column(1), STEP_BYTES):
                n, terms, tfs, sizes = _count_terms(vocabulary.value, raw)
                some = n > 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(uid, uid + len(own))[some]), pa.array(own, pa.int64()).filter(pa.array(some)),
                    pa.array(n[some]), _lists(terms, sizes[some]), _lists(tfs, sizes[some])],
                    names=["uid", "doc_id", "n", "terms", "tfs"])
                uid += len(own)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "df"])

    counted = cut(docs.mapInArrow(count, COUNTS), "term-counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select("terms").mapInArrow(holders, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    w = np.zeros(width, dtype=np.int64)
    for term, df in held.collect():  # one row for each term of the block
        w[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    weights = sc.broadcast(w)

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, sizes = _flat(batch.column(3))
            tf = _flat(batch.column(4))[0]
            m = 75 + 25 * batch.column(2).to_numpy() * n_docs // n_terms
            x = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))
            row = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(row, weights=weights.value[terms] * x.astype(np.float64) ** 2, minlength=len(sizes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norm), batch.column(3),
                                              _lists(x, sizes)], names=["uid", "doc_id", "norm", "terms", "impacts"])

    longest = [F.desc("norm"), F.asc("uid")]
    vectors = cut(counted.mapInArrow(impacts, VECTORS).where("norm > 0").repartition("uid")
                  .sortWithinPartitions(*longest), "impact-vectors")
    bound = (vectors.approxQuantile("norm", [1 - FIRST_SHARE], 0.005) or [0.0])[0]
    none = sc.broadcast([0] * len(texts))
    first = cut(_ranked(_search(vectors.where(F.col("norm") >= bound), queries, weights, none, k), k), "first-found")
    known = [0] * len(texts)
    for query, score in first.where(F.col("rank") == k).select("query", "score").collect():  # one row a query
        known[query] = score
    rest = _search(vectors.where(F.col("norm") < bound), queries, weights, sc.broadcast(known), k)
    return _ranked(first.drop("rank").unionByName(rest), k).select("query", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  query_id: str = "item_id", query_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every query."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    asked = queries.select(F.col(query_id).cast("long").alias("item_id"), text_or_empty(query_text).alias("text")) \
        .where("text <> ''")
    size = F.octet_length("text") + F.lit(QUERY_BYTES)
    sized = cut(global_running(asked, [F.asc("item_id"), F.asc("text")], {"upto": size.cast("long")}, "queries")
                .withColumn("block", F.floor((F.col("upto") - QUERY_BYTES - F.octet_length("text")) / block_bytes)), "query-blocks")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in sorted(r[0] for r in sized.select("block").distinct().collect()):
        own = sized.where(F.col("block") == block).select("item_id", "text").collect()  # a block's bytes and one more text
        named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], "query int, item_id long")
        found = _search_block(d, [r["text"].encode() for r in own], k)
        out = out.unionByName(found.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))
    return out
