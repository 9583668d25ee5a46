"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them.

Each query applies its operator to the whole table and derives the contract's
columns from the operator's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import read_table
from barflow.llm.exact_dedup import exact_dedup
from barflow.llm.lang_id import language_id
from barflow.llm.lexical_search import ranked_search
from barflow.llm.mixing import LATTICE, LATTICE_STEP, mix_sources
from barflow.llm.multi_index import MultiIndex
from barflow.llm.ngram_join import ngram_jaccard_join
from barflow.llm.packing import pack_pieces, token_pieces
from barflow.llm.periodic_runs import periodic_runs, repeat_tails
from barflow.llm.piece_coding import piece_coding
from barflow.llm.token_counts import token_counts
from barflow.llm.tool_calls import link_tool_calls
from barflow.llm.url_lists import judge
from barflow.llm.weak_labels import quality_scores


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def tool_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stand-in for a log of tool calls: every assistant turn is a call whose arguments are
    made of its whole text and that names the previous assistant turn, every user turn is the
    result of the turn before it (of no call at turn 0), and rows of any other role, NULL
    included, are results of no call. So every row is a call or a result, with all its text.
    By its text's length a call has good arguments (4 of 7), wrong types, a missing key, or
    JSON without its closing brace."""
    d = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ident = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), turn)
    size, odd = F.length("text"), F.pmod(F.length("text"), F.lit(7))
    good = F.struct(F.col("text").alias("query"), F.pmod(size, F.lit(10)).alias("limit"), (odd > 3).alias("exact"))
    untyped = F.struct(F.pmod(size, F.lit(10)).cast("string").alias("limit"), F.col("text").alias("query"))
    lacking = F.struct(F.pmod(size, F.lit(10)).alias("limit"), F.col("text").alias("note"))
    broken = F.regexp_replace(F.to_json(good), r"\}$", "")
    arguments = F.when(odd == 0, F.to_json(untyped)).when(odd == 1, F.to_json(lacking)) \
                 .when(odd == 2, broken).otherwise(F.to_json(good))
    tool = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("paint")), (F.pmod(size, F.lit(3)) + 1).cast("int"))
    calls = d.where("role = 'assistant'").select(
        "conv_id", "turn", ident(F.col("turn")).alias("call_id"), tool.alias("tool"), arguments.alias("arguments"),
        F.when(F.col("turn") > 1, ident(F.col("turn") - 2)).alias("after"))
    # Turn -1 is nobody's, and no call's id begins with r.
    answered = F.when(F.col("role") == "user", ident(F.col("turn") - 1)).otherwise(F.concat(F.lit("r"), "conv_id", F.lit("_"), "turn"))
    results = d.where("role is null or role <> 'assistant'").select(
        "conv_id", "turn", answered.alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(
        [("search", "query", "string", True), ("search", "limit", "integer", False), ("search", "exact", "boolean", False),
         ("lookup", "query", "string", True), ("lookup", "limit", "number", True), ("lookup", "exact", "boolean", False)],
        "tool string, name string, type string, required boolean")
    return calls, results, schemas


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*tool_tables(spark, sf_dir))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
           FROM documents),
g AS (SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size,
             first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id
      FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(t) AS text_sha256
FROM g
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"))


def _digits(text, n: int):
    """The first ``n`` hex digits of the text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("int")


def url_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in for dated captures and list changes: a page's day follows from its id, and
    some of the pages' own URLs, hosts and parent domains are listed and unlisted on days
    that follow from their md5."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.withColumn("fetched", F.date_add(start, F.pmod(F.col("page_id") * 37, F.lit(700)).cast("int")))
    place = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    seeds = [("host", place, 3), ("domain", F.regexp_replace(place, r"^[^.]+\.", ""), 5),
             ("prefix", F.regexp_extract("url", "^[a-z]+://([^/]+/[^/?#]+)", 1), 2)]
    entries = None
    for kind, value, share in seeds:
        e = pages.select(F.lit(kind).alias("kind"), value.alias("value")).where("value <> ''").distinct() \
            .where(F.pmod(_digits(F.col("value"), 4), F.lit(share)) == 0)
        entries = e if entries is None else entries.unionByName(e)
    n = _digits(F.concat("kind", "value"), 6)
    effect = F.when(F.pmod(n, F.lit(4)) == 0, "allow").otherwise("block")
    change = lambda action, day: F.struct(F.lit(action).alias("action"), F.date_add(start, day.cast("int")).alias("day"))
    first, gap = F.pmod(n, F.lit(400)), F.pmod(n, F.lit(150)) + 1
    changes = entries.select(
        F.concat(F.lit("list"), F.pmod(n, F.lit(3))).alias("list"), effect.alias("effect"), "kind",
        F.when(F.col("kind") == "prefix", F.col("value")).otherwise(F.upper("value")).alias("value"),
        F.explode(F.array(change("add", first), change("remove", first + gap), change("add", first + 2 * gap))).alias("c")) \
        .select("list", "effect", "kind", "value", "c.action", "c.day")
    return captures, changes


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(*url_tables(spark, sf_dir))


OP6_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 700 AS INTEGER) AS fetched,
                  regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS place FROM pages),
v AS (SELECT DISTINCT 'host' AS kind, place AS value, 3 AS share FROM p
      UNION ALL SELECT DISTINCT 'domain', regexp_replace(place, '^[^.]+\.', ''), 5 FROM p
      UNION ALL SELECT DISTINCT 'prefix', regexp_extract(url, '^[a-z]+://([^/]+/[^/?#]+)', 1), 2 FROM p),
e AS (SELECT kind, value, CAST('0x' || substr(md5(kind || value), 1, 6) AS INTEGER) AS n FROM v
      WHERE value <> '' AND CAST('0x' || substr(md5(value), 1, 4) AS INTEGER) % share = 0),
i AS (SELECT 'list' || (n % 3) AS list, CASE WHEN n % 4 = 0 THEN 'allow' ELSE 'block' END AS effect, kind, value AS key,
             n % 400 AS a, n % 150 + 1 AS gap FROM e),
spans AS (SELECT list, effect, kind, key, DATE '2024-01-01' + CAST(a AS INTEGER) AS f, DATE '2024-01-01' + CAST(a + gap AS INTEGER) AS t FROM i
          UNION ALL SELECT list, effect, kind, key, DATE '2024-01-01' + CAST(a + 2 * gap AS INTEGER), NULL FROM i),
c AS (SELECT page_id, fetched, lower(place) AS host,
             rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1), '/') AS path FROM p),
k AS (SELECT page_id, fetched, 'host' AS kind, host AS key, 2 AS place, 1 AS depth FROM c
      UNION ALL
      SELECT page_id, fetched, 'domain', array_to_string(list_slice(l, len(l) - n + 1, len(l)), '.'), 3, n
      FROM (SELECT *, string_split(host, '.') AS l FROM c) d, range(1, 20) r(n) WHERE n <= len(l)
      UNION ALL
      SELECT page_id, fetched, 'prefix', host || array_to_string(list_slice(l, 1, n), '/'), 1, n
      FROM (SELECT *, string_split(path, '/') AS l FROM c) d, range(1, 60) r(n) WHERE n <= len(l)),
h AS (SELECT k.*, s.list, s.effect FROM k JOIN spans s ON s.kind = k.kind AND s.key = k.key
      AND s.f <= k.fetched AND (s.t IS NULL OR s.t > k.fetched)),
m AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n_active,
             row_number() OVER (PARTITION BY page_id ORDER BY place, depth DESC, effect, list, kind, key) AS r FROM h)
SELECT c.page_id, c.host, c.fetched, CAST(coalesce(m.n_active, 0) AS BIGINT) AS n_active, m.list, m.kind, m.key,
       coalesce(m.effect = 'allow', true) AS kept
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.r = 1
"""


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return MultiIndex(vectors, k=20).search(vectors.where(F.col("vec_id") % 20 == 0))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio,
             row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS i FROM w),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w,
             coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             coalesce(sum(weight) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_w
      FROM o),
l AS (SELECT CAST(total - capped AS DOUBLE) / CAST(all_w - capped_w AS DOUBLE) AS lam
      FROM r WHERE ratio > CAST(total - capped AS DOUBLE) / CAST(all_w - capped_w AS DOUBLE) ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), (SELECT lam FROM l) * weight), 0.0) AS target FROM r),
p AS (SELECT row_number() OVER () AS row, d.source, d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source
                 ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT total, greatest(1, CAST(ceil(sqrt(greatest(total, 1)) / 8) AS BIGINT)) AS block
      FROM (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM d)),
per AS (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST) AS cum FROM t),
iv AS (SELECT source, source_size, CAST(floor(target + 0.5) AS BIGINT) AS quota, block, CAST(ceil(total / block) AS BIGINT) AS n,
              CAST(ceil(source_size / block) AS BIGINT) AS n_blocks, (cum - target) * ({LATTICE} / greatest(total, 1)) AS lo,
              cum * ({LATTICE} / greatest(total, 1)) AS hi FROM per, g WHERE source_size > 0 AND target > 0),
nd AS (SELECT *, (quota // source_size) * n_blocks + CAST(ceil((quota % source_size) / block) AS BIGINT) AS need FROM iv),
points AS (SELECT slot, CAST(((slot % {LATTICE}) * {LATTICE_STEP}) % {LATTICE} AS DOUBLE) AS u
           FROM (SELECT unnest(range(0, (SELECT coalesce(max(n), 0) FROM nd))) AS slot)),
hit AS (SELECT nd.source, points.slot, row_number() OVER (PARTITION BY nd.source ORDER BY points.slot) - 1 AS k
        FROM points JOIN nd ON u >= lo AND u < hi),
got AS (SELECT source, count(*) AS c FROM hit GROUP BY source),
ranked AS (SELECT source, k, slot AS position FROM hit
           UNION ALL SELECT source, k, n + k FROM (SELECT nd.source, n, unnest(range(coalesce(c, 0), need)) AS k
                                                   FROM nd LEFT JOIN got ON got.source IS NOT DISTINCT FROM nd.source)),
slots AS (SELECT nd.source, position, k % n_blocks AS b, least(block, source_size - (k % n_blocks) * block) AS whole,
                 quota - (k // n_blocks) * source_size - (k % n_blocks) * block AS rest
          FROM ranked r JOIN nd ON r.source IS NOT DISTINCT FROM nd.source WHERE k < need),
parts AS (SELECT p.*, unnest(range(pos // block, (pos + size - 1) // block + 1)) AS b FROM p, g WHERE size > 0),
f AS (SELECT parts.row, min(position) AS first_slot FROM parts, g, slots s
      WHERE s.source IS NOT DISTINCT FROM parts.source AND s.b = parts.b AND least(whole, rest) > greatest(pos - parts.b * block, 0) GROUP BY parts.row)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (quota // source_size) * size
                 + greatest(least(pos + size, quota % source_size) - pos, 0) END AS taken, first_slot
FROM p LEFT JOIN f USING (row)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeat_tails(read_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period",
        F.floor(F.col("b.length") * 1000 / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_coding(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


OP13_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id,
                      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
               FROM documents),
d AS (SELECT * FROM words WHERE len(t) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY row, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
       FROM tf, s GROUP BY term),
m AS (SELECT row, doc_id, 100 - 25 + (25 * len(t) * n_docs) // n_terms AS m FROM d, s),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT q.item_id, tf.row, m.doc_id, CAST(sum(df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
           FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m ON m.row = tf.row GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) <= 20
"""


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_tool_calls": (op1_tool_calls, None),
    "op2_best_two_fit": (op2_best_two_fit, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_token_counts": (op4_token_counts, None),
    "op5_weak_labels": (op5_weak_labels, None),
    "op6_url_lists": (op6_url_lists, OP6_SQL),
    "op7_multi_index": (op7_multi_index, None),
    "op8_ngram_join": (op8_ngram_join, None),
    "op9_mix_sources": (op9_mix_sources, OP9_SQL),
    "op10_language_id": (op10_language_id, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_piece_coding": (op12_piece_coding, None),
    "op13_ranked_search": (op13_ranked_search, OP13_SQL),
}
