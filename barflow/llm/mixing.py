"""Mixing sources to target weights with a low-discrepancy slot schedule.

Slots 0, 1, 2, ... are points of a golden-ratio sequence, mapped through the
cumulative target weights to a source. The slots of a source are ranked, and
rank ``k`` takes the source's block ``k mod n_blocks`` in epoch
``k div n_blocks``. Blocks hold equal numbers of tokens (words here) and are
cut from the source's documents in hash order.

NULL text has size 0; a NULL source is a source of its own, last in order.
Repeated rows are separate documents. Empty input gives an empty result, and
a total size of 0 gives targets and takes of 0. Only id, source and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import apply_copies, cut, global_running, hex_digits_for, row_key, word_count

#: Golden-ratio lattice: frac(i * LATTICE_STEP / LATTICE), two neighbouring Fibonacci numbers.
LATTICE, LATTICE_STEP = 1_134_903_170, 701_408_733
#: Ranges into which the lattice is cut to join slots to sources by equality.
BUCKETS = 4096
#: Slots that one task ranks.
SLOT_RUN = 65_536


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          carry: Column | None = None) -> DataFrame:
    """``row, doc_id, carry, source, size`` with the number of words as size, written once."""
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                           (F.lit(None) if carry is None else carry).cast("long").alias("carry"), F.col(source_col).cast("string").alias("source"),
                           word_count(F.col(text_col)).alias("size")), "mix-sizes")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: ``source, source_size, weight, target, cum``.

    Sources in code-point order (NULL last) take the weights in turn and share
    the sum of all sizes. A target stops at ``max_epochs`` times its source's
    size; the excess goes to the others by weight until none is above. With
    sources by rising cap/weight, the capped ones are a prefix, so the common
    level is found from running sums without a loop. ``cum`` is the running
    sum of targets in source order."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    s = global_running(s, by_name, {"rank": F.lit(1)}, "mix-rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = global_running(s, [F.col("ratio"), F.col("rank")], {"caps": F.col("cap"), "ws": F.col("weight")}, "mix-level")
    s = cut(s, "mix-sources")
    total, ws = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))) / (F.lit(ws) - (F.col("ws") - F.col("weight")))
    found = s.withColumn("level", level.cast("double")).where("ratio > level") \
             .agg(F.min_by("level", F.struct("ratio", "rank"))).first()[0]
    cap = F.col("cap").cast("double")
    target = F.lit(0.0) if found is None else F.least(cap, F.lit(found) * F.col("weight"))
    out = s.withColumn("target", target)
    return global_running(out.select("source", "source_size", "weight", "target", "rank"), [F.col("rank")],
                          {"cum": F.col("target")}, "mix-cum")


def block_size(total: int) -> int:
    """Words in a block: ``ceil(sqrt(total) / 8)``, so blocks and slots both grow
    as the square root of the corpus."""
    return max(1, math.ceil(math.sqrt(max(total, 1)) / 8))


def slot_schedule(sources: DataFrame, total: int, block: int) -> DataFrame:
    """``position, source, rank, epoch, block, words``: which block each slot takes.

    A slot takes a whole block; the source's last slot is shortened to end at
    its target (rounded to words). The point sequence gives each source its
    share of slots up to a few; slots beyond the target are dropped, and a
    source left short gets its last slots behind all others."""
    spark = sources.sparkSession
    n = math.ceil(total / block)
    per = (sources.where("source_size > 0 and target > 0")
                  .withColumn("n_blocks", F.ceil(F.col("source_size") / block))
                  .withColumn("quota", F.floor(F.col("target") + 0.5)))
    full = F.floor(F.col("quota") / F.col("source_size"))
    per = per.withColumn("need", full * F.col("n_blocks")
                         + F.ceil((F.col("quota") - full * F.col("source_size")) / block))
    scale = LATTICE / max(total, 1)
    per = cut(per.withColumn("lo", (F.col("cum") - F.col("target")) * scale).withColumn("hi", F.col("cum") * scale),
              "mix-intervals")

    width = LATTICE / BUCKETS
    last = F.least(F.floor(F.col("hi") / width), F.lit(BUCKETS - 1))
    spans = per.select("rank", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / width).cast("long"), F.greatest(last, F.floor(F.col("lo") / width)).cast("long"))).alias("bucket"))
    u = F.pmod(F.pmod(F.col("id"), F.lit(LATTICE)) * LATTICE_STEP, F.lit(LATTICE)).cast("double")
    slots = spark.range(n).select(F.col("id").alias("slot"), u.alias("u")) \
        .withColumn("bucket", F.least(F.floor(F.col("u") / width), F.lit(BUCKETS - 1)))
    hit = slots.join(spans, "bucket").where("u >= lo and u < hi").select("slot", F.col("rank").alias("src"))
    hit = cut(hit.withColumn("run", F.floor(F.col("slot") / SLOT_RUN)), "mix-slots")

    runs = hit.groupBy("src", "run").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select("src", "run", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("src", "run").orderBy("slot")
    ranked = hit.join(base, ["src", "run"]).select(
        "src", (F.col("base") + F.row_number().over(inner) - 1).alias("k"), F.col("slot").alias("position"))
    got = hit.groupBy(F.col("src").alias("rank")).agg(F.count(F.lit(1)).alias("got"))
    late = per.join(got, "rank", "left").where(F.coalesce("got", F.lit(0)) < F.col("need")).select(
        F.col("rank").alias("src"),
        F.explode(F.sequence(F.coalesce("got", F.lit(0)).cast("long"), (F.col("need") - 1).cast("long"))).alias("k"))
    ranked = ranked.unionByName(late.withColumn("position", F.lit(n) + F.col("k")))
    info = per.select(F.col("rank").alias("src"), "source", "source_size", "n_blocks", "need", "quota")
    epoch = F.floor(F.col("k") / F.col("n_blocks"))
    blk = F.col("k") - epoch * F.col("n_blocks")
    length = F.least(F.lit(block), F.col("source_size") - blk * block)
    return (ranked.join(info, "src").where("k < need")
                  .withColumn("epoch", epoch).withColumn("block", blk)
                  .withColumn("words", F.least(length, F.col("quota") - epoch * F.col("source_size") - blk * block))
                  .select("position", "src", "source", F.col("k").alias("rank"), "epoch", "block",
                          F.col("words").cast("long"), length.cast("long").alias("block_words")))


def shuffled_spans(sizes: DataFrame, rows: int) -> DataFrame:
    """Add ``start``: words of the source's documents before this one, in the
    order of ``md5(doc_id)``. Split by (source, leading hex digits), so a source
    that holds a third of all rows is spread over many tasks."""
    digits = hex_digits_for(rows)
    d = sizes.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) \
             .withColumn("bucket", F.substring("key", 1, digits)) \
             .withColumn("src", F.coalesce("source", F.lit(""))).withColumn("src_null", F.col("source").isNull())
    at = ["src", "src_null", "bucket"]
    sums = d.groupBy(*at).agg(F.sum("size").alias("s"))
    w = Window.partitionBy("src", "src_null").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*at, F.coalesce(F.sum("s").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy(*at).orderBy("key", F.col("doc_id").isNull(), "doc_id", "size", "row")
    before = F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(base, at).select("row", "doc_id", "carry", "source", "size", (F.col("base") + before).alias("start"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                carry: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, first_slot``
    and, if given, the 64-bit column ``carry`` beside the row's number ``row``.

    ``taken`` counts the words that the schedule's slots take from the
    document, repeats included; never more than ``max_epochs`` times its size.
    ``first_slot`` is the place in the mix of the first slot that takes any of its words."""
    sizes = sized(docs, id_col, source_col, text_col, carry)
    rows, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    sources = cut(source_targets(sizes, weights, max_epochs), "mix-targets")
    block = block_size(total)
    slots = slot_schedule(sources, total, block)

    entire = F.col("words") == F.col("block_words")
    takes = slots.groupBy("src", "block").agg(
        F.sum(F.when(entire, 1).otherwise(0)).alias("whole"),
        F.max(F.when(~entire, F.col("words")).otherwise(0)).alias("part"),
        F.min(F.when(entire, F.col("position"))).alias("whole_at"), F.min(F.when(~entire, F.col("position"))).alias("part_at"))
    takes = cut(takes, "mix-takes")
    src = sources.select(F.col("rank").alias("src"), F.col("source").alias("source_"), "source_size", "target")
    spans = cut(shuffled_spans(sizes, rows).join(src, F.col("source").eqNullSafe(F.col("source_")))
                .drop("source_"), "mix-spans")
    # A document lies in one block or a few; each part is joined to its block's takes.
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    parts = spans.where("size > 0").select("row", "src", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    part = F.greatest(F.least(hi, F.col("part")) - lo, F.lit(0))
    first_at = F.least(F.col("whole_at"), F.when(part > 0, F.col("part_at")))
    got = parts.join(takes, ["src", "block"]).groupBy("row").agg(
        F.sum((hi - lo) * F.col("whole") + part).cast("long").alias("taken"), F.min(first_at).cast("long").alias("first_slot"))
    out = spans.join(got, "row", "left").select(
        "row", "doc_id", "carry", "source", F.col("size").cast("long"), F.col("source_size").cast("long"), "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    return out.drop("carry", "row") if carry is None else out


def whole_copies(found: DataFrame) -> DataFrame:
    """``doc_id, carry, copies`` for documents that are only taken whole, from rows of
    :func:`mix_sources` with ``row`` and ``carry``.

    Every document is taken as often as its words were taken entirely. What is left of a
    source's target is part of one document. If one more copy of some document of the source brings
    the source nearer to its target, the one that fits the rest best is taken once more
    (among equals the smaller, then the smaller id). A source is then off by no more
    than that rest, and by no more than the best fitting document leaves. A source with
    words and a target of half a word or more never vanishes: it keeps its best fitting
    document. Documents without words stay once."""
    d = cut(found.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(0).cast("long")), "mix-whole")
    sizes = d.where("size > 0")
    same = F.col("source").eqNullSafe(F.col("_source"))
    rest = cut(sizes.groupBy(F.col("source").alias("_source")).agg(
        F.sum(F.col("taken") - F.col("whole") * F.col("size")).alias("rest"), F.min("whole").alias("least"),
        F.max("whole").alias("most")), "mix-rest")
    # Those that the last epoch has not reached have the smallest number of copies.
    fit = F.min(F.struct(F.abs(F.col("size") - F.col("rest")).alias("off"), F.col("size").alias("size"),
                         F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    best = sizes.join(rest, same).where((F.col("whole") == F.col("least")) & (F.col("rest") > 0)) \
                .groupBy("_source", "rest", "most").agg(fit.alias("f"))
    more = best.where((F.col("f.off") < F.col("rest")) | (F.col("most") == 0)).select(F.col("f.row").alias("row"), F.lit(1).alias("more"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + F.coalesce("more", F.lit(0)))
    return d.join(more, "row", "left").select("doc_id", "carry", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix as whole documents with all their columns, each as often as
    :func:`whole_copies` says; documents without words stay once."""
    found = mix_sources(docs, id_col=id_col, source_col=source_col, text_col=text_col, carry=row_key(docs))
    return apply_copies(docs, whole_copies(found), id_col)
