"""N-gram Jaccard join: a grouped prefix join on word shingles.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets
of distinct word shingles. The result gives every document its set size, its
component, the smallest id reachable by links, and the number of its links,
copies included.

Texts are lower-cased (A-Z) and split into words at [\\x20\\x09-\\x0D]. With
fewer words than a shingle holds, the whole sequence is the one shingle. NULL
or wordless text has an empty set and links with nothing. Repeated rows are
documents of their own. A NULL id counts in its component only if no other id
is in it. Empty input gives an empty result. Only id and text are read, so
other columns may have any name.

Shingles stand for themselves as 64-bit hashes, sets as 128-bit digests.

1. Documents with equal sets form one class; copies need no pairs.
2. Screen: a class that links with another shares all but ``n - ceil(percent
   n / 100)`` of its shingles with other classes, so of those below a fixed
   hash bound at most that many may be its own alone. Counting them needs one
   exchange of a fraction of all shingles. The same test on all shingles of
   the classes that are left removes most of the rest.
3. The remaining classes order their shingles by document frequency; the
   first ``n - ceil(percent n / 100) + 1`` are the prefix. Classes with the
   same size and prefix collapse into one group.
4. Star round: each group is compared with one other group that shares most
   of its prefix, preferring those with the fewest shingles of their own, and
   members with their group's first. Verified links give first components.
5. Group pairs that share a prefix shingle, pass the size and position
   filters and lie in different components are expanded to members and
   verified. For components alone, pairs inside one need no test, so a family
   of near copies does not cost all its pairs.
6. Links are counted inside the final components, where all of them lie: the
   classes of a component are dealt into blocks by hash, every pair of blocks
   is one group, and in it every pair of classes is compared on the whole
   sets. A class counts as often as it has documents. This grows with the
   square of a component's classes, in time, but rows only with their blocks.

Every candidate pair across components is verified on the whole sets, so no
link between different components is lost; no posting, group or number of
partners is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import apply_copies, cut, forget, row_key, ship, text_or_empty
from barflow.llm.components import components

#: A side of at most so many (id, digest) rows is broadcast (32 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Rows of an Arrow batch that a task holds as shingle sets at a time.
STEP_ROWS = 1000
#: Shingles in a block of classes whose links are counted together.
BLOCK_SHINGLES = 1 << 17

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_29, _32 = np.uint64(29), np.uint64(32)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), len(parts))], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    last = len(w) - words + 1
    h = w[:last].copy()
    for k in range(1, words):
        h ^= h >> _29
        h *= _MULTIPLIER
        h += w[k:last + k]
    h ^= h >> _32
    h *= _MULTIPLIER
    h ^= h >> _29
    return np.unique(h)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(i, STEP_ROWS)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _key(s: np.ndarray) -> int:
    """Half of the digest, as a signed number."""
    return int.from_bytes(_digest(s)[:8], "little", signed=True)


def _most_missing(n: Column, percent: int) -> Column:
    """Shingles of a set of size ``n`` that a linked set may lack."""
    return n - F.floor((n * percent + 99) / 100)


def _screen_bound(percent: int) -> float:
    """Share of all hashes that the screen counts: one and a half times what a linked set may lack."""
    return min(1.0, 1.5 * (100 - percent) / 100)


def document_sets(docs: DataFrame, words: int, id_col: str, text_col: str, carry: Column | None = None) -> DataFrame:
    """``row, doc_id, carry, n, digest, key`` of every document, written once."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in _slices(batches):
            got = [shingle_hashes(t.as_py(), words) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in got], pa.int64()),
                                              pa.array([_digest(s) for s in got], pa.binary()),
                                              pa.array([_key(s) for s in got], pa.int64())],
                                             names=["doc_id", "carry", "n", "digest", "key"])

    ship(docs.sparkSession)
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                           (F.lit(None) if carry is None else carry).cast("long").alias("carry"),
                           text_or_empty(text_col).alias("text"))
               .mapInArrow(sets, "doc_id bigint, carry bigint, n bigint, digest binary, key bigint")
               .withColumn("row", F.monotonically_increasing_id()), "shingle-sets")


def _screened(docs: DataFrame, classes: DataFrame, words: int, percent: int, text_col: str) -> DataFrame:
    """Classes of which enough shingles below the hash bound are shared with other classes."""
    bound = np.uint64(min(int(_screen_bound(percent) * 2.0**64), 2**64 - 1))

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            tokens, keys = [], []
            for t in batch.column(0).cast(pa.binary()):
                s = shingle_hashes(t.as_py(), words)
                own = s[s <= bound]
                if len(own):
                    tokens.append(own)
                    keys.append(_key(s))
            sizes = [len(x) for x in tokens]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens).view(np.int64) if tokens else [], pa.int64()),
                pa.array(np.repeat(np.array(keys, dtype=np.int64), sizes), pa.int64())], names=["t", "key"])

    rows = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(low, "t bigint, key bigint")
    own = rows.groupBy("t").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other") \
              .groupBy("key").agg(F.count(F.lit(1)).alias("own"))
    return classes.join(own, "key", "left") \
        .where(F.coalesce("own", F.lit(0)) <= _most_missing(F.col("n"), percent)).drop("key", "own")


def _token_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``cls, n, tokens`` of the wanted classes, read again from the texts of their first documents."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cls, got = [], []
            for t, c, d in zip(batch.column(0).cast(pa.binary()), batch.column(1), batch.column(2), strict=True):
                s = shingle_hashes(t.as_py(), words)
                if _digest(s) == d.as_py():  # another row may have the same id
                    cls.append(c.as_py())
                    got.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([len(s) for s in got], pa.int64()),
                                              _lists(got)], names=["cls", "n", "tokens"])

    ids = wanted.select(F.col("rep").alias("_id"), "cls", "digest")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), text_or_empty(text_col).alias("text"))
    return cut(texts.join(ids, F.col("_doc").eqNullSafe(F.col("_id"))).select("text", "cls", "digest")
               .mapInArrow(sets, "cls bigint, n bigint, tokens array<bigint>"), "token-sets")


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """``cls, n, own, tokens, prefix`` of classes that may link: shared tokens only,
    and the prefix as (token, position) in frequency order, written once."""
    tok = sets.select("cls", F.explode("tokens").alias("t"))
    freq = cut(tok.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.min("cls").alias("cls")), "token-df")
    own = freq.where("df = 1").groupBy("cls").agg(F.count(F.lit(1)).alias("own"))
    alive = cut(sets.select("cls", "n").distinct().join(own, "cls", "left")
                .select("cls", "n", F.coalesce("own", F.lit(0)).alias("own"))
                .where(F.col("own") <= _most_missing(F.col("n"), percent)), "alive")
    small = alive.select("cls")
    small = F.broadcast(small) if alive.count() <= BROADCAST_ROWS else small.hint("merge")
    kept = sets.join(small, "cls", "left_semi").select("cls", F.explode("tokens").alias("t"))
    shared = kept.join(freq.where("df > 1").select("t", "df"), "t")
    lists = shared.groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("df", "t"))).alias("ordered"))
    length = _most_missing(F.col("n"), percent) + 1 - F.col("own")
    prefix = F.transform(F.slice("ordered", F.lit(1), length.cast("int")),
                         lambda x, i: F.struct(x["t"].alias("t"), (i + 1).alias("i")))
    return cut(lists.join(alive, "cls").select(
        "cls", "n", "own", F.array_sort(F.col("ordered.t")).alias("tokens"), prefix.alias("prefix")), "candidates")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link, by intersecting the whole sets."""
    x = sets.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("tokens").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).alias("both"))
    return cut(both.where(100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b"), "links")


def _fits(percent: int) -> Column:
    """Size and position filters for a shared prefix token at positions ``i`` and ``j``
    (shingles of their own come first) of sets of sizes ``n`` and ``m``."""
    need = F.floor((percent * (F.col("n") + F.col("m")) + 99 + percent) / (100 + percent))
    return (F.col("i") - 1 <= F.col("n") - need) & (F.col("j") - 1 <= F.col("m") - need)


def class_links(docs: DataFrame, classes: DataFrame, words: int, percent: int, id_col: str,
                text_col: str) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` between classes whose components are those of all links, and the
    classes that may link, with their shared tokens (:func:`_candidates`)."""
    wanted = cut(_screened(docs, classes, words, percent, text_col), "screened")
    sets = _token_sets(docs, wanted, words, id_col, text_col)
    cand = _candidates(sets, percent)

    # Groups: the same size and the same prefix, own shingles included, so a class with
    # shingles of its own in the prefix is a group by itself.
    alone = cand.where("own > 0").select(F.col("cls").alias("g"), "n", "own", "prefix")
    keyed = cand.where("own = 0").select("cls", "n", F.col("prefix.t").alias("key"), "prefix")
    shared = cut(keyed.groupBy("n", "key").agg(F.min("cls").alias("g"), F.first("prefix").alias("prefix")), "groups")
    groups = alone.unionByName(shared.select("g", "n", F.lit(0).cast("long").alias("own"), "prefix"))
    members = cut(alone.select(F.col("g").alias("cls"), "g").unionByName(
        keyed.join(shared.select("n", "key", "g"), ["n", "key"]).select("cls", "g")), "members")
    posts = cut(groups.select("g", "n", "own", F.explode("prefix").alias("p"))
                .select("g", "n", "own", F.col("p.t").alias("t"), (F.col("p.i") + F.col("own")).alias("i")), "postings")

    # Star round.
    size_class = F.floor(F.log("n") / float(np.log(100 / percent))) if percent < 100 else F.col("n")
    posts = posts.withColumn("size_class", size_class)
    hubs = posts.groupBy("t", "size_class").agg(F.min(F.struct("own", "g")).alias("hub"))
    near = posts.join(hubs, ["t", "size_class"]).where("hub.g <> g") \
                .groupBy("g", "hub.g").agg(F.count(F.lit(1)).alias("shared")).toDF("g", "h", "shared")
    best = near.groupBy("g").agg(F.max(F.struct("shared", (-F.col("h")).alias("h"))).alias("best"))
    stars = best.select(F.col("g").alias("b"), (-F.col("best.h")).alias("a")).unionByName(
        members.where("cls <> g").select(F.col("cls").alias("b"), F.col("g").alias("a")))
    tested = cut(stars, "stars")
    first = _verify(tested, cand, percent)

    # All group pairs across components.
    comp = cut(components(first), "first-components")
    units = cut(members.join(comp, members["cls"] == comp["node"], "left")
                .select("cls", "g", F.coalesce("component", "cls").alias("comp")), "units")
    rows = posts.select("g", "n", "t", "i").join(units.select("g", "comp").distinct(), "g")
    per = rows.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("c"))
    tops = per.groupBy("t").agg(F.max(F.struct("c", "comp"))["comp"].alias("top"), F.count(F.lit(1)).alias("comps")) \
              .where("comps > 1").select("t", "top")
    rows = cut(rows.join(tops, "t"), "mixed-postings")
    # The largest component of a token is never paired with itself.
    left = rows.where("comp <> top").select("t", "i", "n", "g", "comp")
    right = rows.select("t", F.col("i").alias("j"), F.col("n").alias("m"), F.col("g").alias("g2"),
                        F.col("comp").alias("comp2"), "top")
    once = (F.col("comp2") == F.col("top")) | (F.col("comp") < F.col("comp2"))
    group_pairs = left.join(right, "t").where((F.col("comp") != F.col("comp2")) & once & _fits(percent)) \
                      .select("g", "comp", "g2", "comp2").distinct()
    at = units.select(F.col("cls").alias("a"), "g", "comp")
    at2 = units.select(F.col("cls").alias("b"), F.col("g").alias("g2"), F.col("comp").alias("comp2"))
    pairs = group_pairs.join(at, ["g", "comp"]).join(at2, ["g2", "comp2"]) \
                       .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _verify(cut(pairs.join(done, ["a", "b"], "left_anti"), "pairs"), cand, percent)
    return first.unionByName(second), cand


def _count_links(percent: int):
    """Of two blocks ``ci`` and ``cj`` of a component (or one, if equal): ``cls, linked``,
    the documents of the other block that each class links with."""
    def count(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        cls, k, n, copies, ci, cj = (rows.column(c).to_numpy() for c in ("cls", "k", "n", "copies", "ci", "cj"))
        tokens = rows.column("tokens").combine_chunks()
        size = tokens.value_lengths().to_numpy(zero_copy_only=False)
        at = np.cumsum(size) - size
        local = np.unique(tokens.flatten().to_numpy(), return_inverse=True)[1]
        sets = [local[a:a + m] for a, m in zip(at, size, strict=True)]
        left, right = np.flatnonzero(k == ci), np.flatnonzero(k == cj)
        linked = np.zeros(len(cls), dtype=np.int64)
        if len(left) and len(right):
            flat = np.concatenate([sets[i] for i in right])
            first = np.cumsum(size[right]) - size[right]
            mark = np.zeros(len(local), dtype=np.uint8)
            for i in left:
                mark[sets[i]] = 1
                both = np.add.reduceat(mark[flat], first, dtype=np.int64)
                mark[sets[i]] = 0
                hit = right[100 * both >= percent * (n[i] + n[right] - both)]
                linked[i] += copies[hit[hit != i]].sum()
                if ci[0] != cj[0]:
                    linked[hit] += copies[i]
        return pa.table({"cls": pa.array(cls, pa.int64()), "linked": pa.array(linked, pa.int64())})

    return count


def link_counts(classes: DataFrame, cand: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """``cls, linked``: the documents of other classes that a class of ``comp(node, component)`` links with."""
    sets = cut(cand.join(comp, cand["cls"] == comp["node"]).join(classes.select("cls", "copies"), "cls")
               .select("cls", "n", "copies", "tokens", "component"), "linked-sets")
    blocks = sets.groupBy("component").agg(F.ceil(F.sum(F.size("tokens")) / BLOCK_SHINGLES).alias("blocks"))
    dealt = sets.join(blocks, "component").withColumn("k", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("component", "cls", "n", "copies", "tokens", "k", other).select(
        "component", "cls", "n", "copies", "tokens", "k", F.least("k", "other").alias("ci"), F.greatest("k", "other").alias("cj"))
    return dealt.groupBy("component", "ci", "cj").applyInArrow(_count_links(percent), "cls bigint, linked bigint") \
                .groupBy("cls").agg(F.sum("linked").alias("linked"))


def ngram_jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``, the last the
    number of other documents that it links with."""
    return _joined(docs, words, percent, id_col, text_col, counted=True).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns."""
    found = _joined(docs, words, percent, id_col, text_col, row_key(docs))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "carry")).alias("first")
    kept = found.groupBy("n0", "comp").agg(first).select("first.doc_id", "first.carry", F.lit(1).alias("copies"))
    return apply_copies(docs, kept, id_col)


def _joined(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, carry: Column | None = None,
            counted: bool = False) -> DataFrame:
    rows = document_sets(docs, words, id_col, text_col, carry)
    classes = cut(rows.where("n > 0").groupBy("digest").agg(
        F.min("row").alias("cls"), F.min("doc_id").alias("least_id"), F.min_by("doc_id", "row").alias("rep"),
        F.first("n").alias("n"), F.first("key").alias("key"), F.count(F.lit(1)).alias("copies")), "classes")
    links, cand = class_links(docs, classes, words, percent, id_col, text_col)
    comp = cut(components(links), "components")
    found = link_counts(classes, cand, comp, percent) if counted else None
    named = classes.join(comp, classes["cls"] == comp["node"], "left")
    n_links = F.lit(None).cast("long")
    if counted:
        named = named.join(found, "cls", "left")
        n_links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    named = named.select("digest", "least_id", F.coalesce("component", classes["cls"]).alias("comp"), n_links.alias("n_links"))
    named = cut(named, "class-components")
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = cut(named.join(least, "comp").select("digest", "comp", "component_id", "n_links"), "class-ids")
    # Documents without words are each a component of their own.
    empty = rows.where("n = 0").select("row", "doc_id", "carry", "n", F.col("doc_id").alias("component_id"),
                                       F.lit(True).alias("n0"), F.col("row").alias("comp"), F.lit(0).cast("long").alias("n_links"))
    full = rows.where("n > 0").join(named, "digest").select("row", "doc_id", "carry", "n", "component_id",
                                                            F.lit(False).alias("n0"), "comp", "n_links")
    return empty.unionByName(full)
