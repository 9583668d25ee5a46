"""Approximate nearest neighbours by an inverted multi-index.

Vectors are split into two halves, each quantised by its own codebook; a cell
is a pair of centroids. A query visits cells by rising sum of its two centroid
distances, with a heap, until the cells hold as many vectors as the probe asks
for, and ranks those by their exact inner product in double precision.

Largest inner product is turned into smallest distance by one more component,
``sqrt(M^2 - |x|^2)`` for vectors of norm at most ``M`` and 0 for queries; it
belongs to the second half.

Vectors that are NULL, zero or hold NULL or non-finite components take no
part, nor do rows with a NULL id or with another dimension than most vectors.
Equal vectors are one entry with its smallest ids: all have the same score, so
no others can be among the first ``k``. A query is never its own result; with
fewer candidates all are returned; ties go to the smaller id. Empty input
gives an empty result. Only id and vector are read, so other columns may have
any name.

Fitted on bounded samples: the codebooks on the ``FIT`` distinct vectors with
the smallest hash, the probe on the ``TUNE`` distinct query vectors with the
smallest hash, searched by brute force, so that the wanted recall is reached
on them. Every vector is indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import cut, ship

FIT, TUNE = 8192, 64
#: Share of the tuned queries' true neighbours that the probe must reach.
RECALL = 0.96
MOST_CENTROIDS, ROUNDS = 256, 8
#: Entries of a shard, and queries that one task holds against it.
SHARD, QUERY_BLOCK = 8192, 2048


def valid(vec: Column) -> Column:
    """Not NULL, no NULL or non-finite component, not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def entries(vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """``vec, ids, h``: distinct vectors, each with its ``k + 1`` smallest ids, written once.

    The smallest ids are picked by each task before the exchange, so a vector
    that a third of all rows share is a few rows per task."""
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")) \
        .where(F.col("id").isNotNull() & valid(F.col("vec"))).withColumn("h", F.xxhash64("vec"))
    size = d.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    d = d.where(F.size("vec") == (size[0] if size else 0))
    rank = F.dense_rank().over(Window.partitionBy("h", "vec").orderBy("id"))
    ids = d.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("h", "vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return cut(ids.select("vec", "ids", "h"), "entries")


class Codebooks:
    """Centroids of the two halves."""

    def __init__(self, sample: np.ndarray, norm: float, centroids: int):
        self.norm = norm
        self.half = (sample.shape[1] + 1) // 2
        self.books = [_lloyd(x, centroids) for x in self.halves(sample)]
        self.width = centroids

    def halves(self, x: np.ndarray, query: bool = False) -> list[np.ndarray]:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return [x[:, :self.half], np.column_stack([x[:, self.half:], rest])]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (np.argmin(_distances(h, c), axis=1) for h, c in zip(self.halves(x), self.books, strict=True))
        return a * self.width + b

    def distances(self, q: np.ndarray) -> list[np.ndarray]:
        return [_distances(h, c) for h, c in zip(self.halves(q, True), self.books, strict=True)]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def _lloyd(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centroids from evenly spaced first ones; an empty one stays where it is."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.argmin(_distances(x, c), axis=1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def visit(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, probe: int) -> list[int]:
    """Non-empty cells by rising ``d1 + d2`` until they hold ``probe`` entries."""
    o1, o2, width = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist(), len(d2)
    s1, s2 = np.sort(d1).tolist(), np.sort(d2).tolist()
    heap, out, got = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and got < probe:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * width + o2[j]
        n = count[cell]
        if n:
            out.append(cell)
            got += n
        if j + 1 < width:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if not j and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def _matrix(vecs) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vecs])


def _array(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _first(scores: np.ndarray, ids: list, k: int) -> list[tuple[float, int]]:
    """The first ``k`` (score, id) by falling score and rising id; ``ids``: each vector's sorted ids."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    top = sorted((-scores[i], ids[i][0], i) for i in at)[:k]
    return [(-s, v) for s, v in sorted((s, v) for s, _, i in top for v in ids[i])[:k]]


class MultiIndex:
    """The index: codebooks, entries per cell (a table), and the probe."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20):
        self.spark, self.k = vectors.sparkSession, k
        ship(self.spark)
        found = entries(vectors, id_col, vec_col, k)
        n, norm = found.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
        self.n, self.books, self.count = n, None, np.zeros(0, dtype=np.int64)
        if not n:
            self.table = None
            return
        sample = _matrix(r[0] for r in found.orderBy("h").limit(FIT).select("vec").collect())
        width = int(min(MOST_CENTROIDS, max(4, math.sqrt(n / 8)), len(sample)))
        self.books = books = Codebooks(sample, math.sqrt(norm), width)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _array(b.column(0))
                cell = books.cells(x) if len(x) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], names=["vec", "ids", "h", "cell"])

        self.table = cut(found.mapInArrow(assign, "vec array<double>, ids array<bigint>, h bigint, cell bigint"), "index")
        self.count = np.zeros(width * width, dtype=np.int64)
        for cell, c in self.table.groupBy("cell").count().collect():  # MOST_CENTROIDS ** 2 rows at most
            self.count[cell] = c

    def tune(self, queries: DataFrame, recall: float = RECALL) -> int:
        """Entries a query must reach: the ``recall`` quantile, over a bounded sample of query
        vectors and their true neighbours, of the entries visited until the neighbour's cell."""
        sample = _matrix(r[0] for r in queries.select("vec", "h").distinct().orderBy("h").limit(TUNE).select("vec").collect())
        if not len(sample):
            return 1
        k = self.k

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                score = sample @ _array(b.column(0)).T
                at = np.argsort(-score, axis=1, kind="stable")[:, :k + 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(len(sample)), at.shape[1]), pa.int64()),
                    pa.array(np.take_along_axis(score, at, 1).ravel()),
                    pa.array(b.column(1).to_numpy()[at.ravel()], pa.int64())], names=["q", "score", "cell"])

        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        truth = self.table.select("vec", "cell").mapInArrow(nearest, "q bigint, score double, cell bigint") \
            .withColumn("r", best).where(F.col("r") <= k + 1).select("q", "cell").collect()
        d1, d2 = self.books.distances(sample)
        reached = []
        for q in range(len(sample)):
            order = np.argsort((d1[q][:, None] + d2[q]).ravel(), kind="stable")
            upto = np.empty(len(order), dtype=np.int64)
            upto[order] = np.cumsum(self.count[order])
            reached += [int(upto[cell]) for i, cell in truth if i == q]
        return max(k + 1, int(np.quantile(reached, recall, method="higher")))

    def search(self, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
               probe: int | None = None) -> DataFrame:
        """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row."""
        schema = "query_id bigint, rank int, vec_id bigint, score double"
        if not self.n:
            return self.spark.createDataFrame([], schema)
        dim, k = self.books.half + self.books.books[1].shape[1] - 1, self.k
        rows = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("vec")) \
            .where(F.col("query_id").isNotNull() & valid(F.col("vec")) & (F.size("vec") == dim)) \
            .withColumn("h", F.xxhash64("vec")).distinct()
        rows = cut(rows, "queries")
        probe = probe or self.tune(rows)
        distinct = cut(rows.select("vec", "h").distinct().withColumn("q", F.monotonically_increasing_id()), "query-vectors")

        # Shards: entries in order of cell and hash, SHARD in each; a large cell lies in several.
        ends = np.cumsum(self.count)
        first_shard = ((ends - self.count) // SHARD).tolist()
        last_shard = (np.maximum(ends - 1, 0) // SHARD).tolist()
        books, count, start = self.books, self.count, (ends - self.count)
        starts = self.spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(start)), "before": start}))
        place = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("h", "vec")) - 1
        sharded = self.table.join(F.broadcast(starts), "cell").withColumn("shard", F.floor(place / SHARD))

        def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, x = b.column(0), _array(b.column(1))
                if not len(x):
                    continue
                out: list[tuple] = []
                for i, (a, c) in enumerate(zip(*books.distances(x), strict=True)):
                    by: dict[int, list[int]] = {}
                    for cell in visit(a, c, count, probe):
                        for s in range(first_shard[cell], last_shard[cell] + 1):
                            by.setdefault(s, []).append(cell)
                    out += [(q[i].as_py(), x[i], s, cells) for s, cells in by.items()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.float64())),
                    pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                    names=["q", "vec", "shard", "cells"])

        # The vectors lie in one small file or a few; a number of partitions of its own spreads the traversal.
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        asked = cut(distinct.select("q", "vec").repartition(spread, "q").mapInArrow(traverse, "q bigint, vec array<double>, shard bigint, cells array<bigint>"),
                    "visits")
        blocks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
        asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")))
        held = sharded.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

        def rank(key, e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            e = e.sort_values("cell", kind="stable")
            x, cell, ids = _matrix(e["vec"]), e["cell"].to_numpy(), [sorted(i) for i in e["ids"]]
            out = []
            for num, vec, cells in zip(q["q"], q["vec"], q["cells"], strict=True):
                at = np.flatnonzero(np.isin(cell, np.asarray(cells)))
                found = _first(x[at] @ np.asarray(vec, dtype=np.float64), [ids[i] for i in at], k + 1)
                out += [(num, s, v) for s, v in found]
            return pd.DataFrame(out, columns=["q", "score", "id"])

        found = held.select("shard", "block", "cell", "vec", "ids").groupBy("shard", "block").cogroup(
            asked.select("shard", "block", "q", "vec", "cells").groupBy("shard", "block")) \
            .applyInPandas(rank, "q bigint, score double, id bigint")
        order = [F.desc("score"), F.col("id")]
        top = cut(found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
                  .where(F.col("r") <= k + 1).select("q", "score", "id"), "nearest")
        results = top.groupBy("q").agg(F.collect_list(F.struct("score", "id")).alias("found"))  # k + 1 of each
        own = rows.join(distinct, ["h", "vec"]).select("query_id", "q").join(results, "q")
        own = own.withColumn("found", F.filter("found", lambda f: f["id"] != F.col("query_id")))
        best = F.slice(F.array_sort(F.transform("found", lambda f: F.struct((-f["score"]).alias("n"), f["id"].alias("id")))), 1, k)
        flat = own.select("query_id", F.posexplode(best).alias("pos", "f"))
        return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"),
                           (-F.col("f.n")).alias("score"))
