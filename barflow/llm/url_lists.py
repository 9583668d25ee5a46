"""URL filters with dated lists: a temporal join of captures with list entries.

List changes (an entry is added or removed on a date) become validity
intervals ``[valid_from, valid_to)``. Every capture is judged by the entries
that were active on the day it was fetched.

An entry is a ``host`` (that host alone), a ``domain`` (it and all hosts below
it) or a ``prefix`` (host and path up to a whole path segment). Hosts and URLs
are brought to one form: lower-case host without user, port, or final dot; no
scheme, query or fragment; no slash at the end. What stands before a colon is a
scheme only if ``//`` follows, so ``example.com:8080/x`` has a port. An IPv6 address
keeps its brackets and has no domains above it.

The most specific active entry decides: the longest prefix, then the host,
then the longest domain; among equals ``allow`` before ``block``, then the
smaller list name. Without an active entry a capture is kept.

A capture with NULL or hostless URL, or NULL date, matches nothing and is kept.
Changes with a NULL or hostless value, unknown kind, NULL list or NULL date are
ignored; several changes of one entry on a day count as a removal if any is
one. Repeated captures are rows of their own. Empty tables give an empty
result or no matches. Only the named columns are read, so other columns may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import cut

#: Java pattern: scheme (only before //), user, host (an IPv6 address in brackets), port, path.
_URL = r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)(?::[0-9]*)?(/[^?#]*)?"
KINDS = ("prefix", "host", "domain")


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; NULL if there is none."""
    host = F.lower(F.rtrim(F.regexp_extract(url, _URL, 1), F.lit(".")))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without slashes at its end; empty if there is none."""
    return F.rtrim(F.regexp_extract(url, _URL, 2), F.lit("/"))


def intervals(changes: DataFrame) -> DataFrame:
    """One row per (kind, key): ``entries``, an array of (list, effect, valid_from, valid_to).

    ``changes(list, effect, kind, value, action, day)``. Changes are reduced to
    one per entry and day first, so an entry has at most as many rows as days."""
    host = host_of(F.col("value"))
    key = F.when(F.col("kind") == "prefix", F.concat(host, path_of(F.col("value")))).otherwise(host)
    d = changes.select("list", "effect", "kind", key.alias("key"), "action", F.to_date("day").alias("day")) \
        .where(F.col("key").isNotNull() & F.col("kind").isin(*KINDS) & F.col("day").isNotNull() & F.col("list").isNotNull()
               & F.col("effect").isin("block", "allow") & F.col("action").isin("add", "remove"))
    entry = ["kind", "key", "list", "effect"]
    daily = d.groupBy(*entry, "day").agg((F.max("action") == "add").alias("added"))
    upto = F.lead("day").over(Window.partitionBy(*entry).orderBy("day"))
    spans = daily.withColumn("valid_to", upto).where("added")
    return spans.groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct(
        "list", "effect", F.col("day").alias("valid_from"), "valid_to"))).alias("entries"))


def capture_keys(url: Column) -> Column:
    """Array of (kind, key, depth) that may have an entry for the URL: its path prefixes, host and domains."""
    host, path = host_of(url), path_of(url)
    parts = F.split(path, "/")  # starts with an empty part
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("key"),
        n.alias("depth")))
    labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(
        F.lit("domain").alias("kind"),
        F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("key"), n.alias("depth")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"), F.lit(1).alias("depth")))
    return F.when(host.isNotNull(), F.concat(prefixes, own, domains))


def judge(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url",
          day_col: str = "fetched") -> DataFrame:
    """One row per capture: ``page_id, host, fetched, n_active, list, kind, key, kept``.

    Each (kind, key) has one row of intervals, so the join emits a capture's key
    once at most whatever the number of changes; the interval is picked inside
    the row. A hot host is a skewed key of the capture side alone, which Spark
    splits."""
    c = cut(captures.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("page_id"),
                            F.col(url_col).cast("string").alias("url"), F.to_date(F.col(day_col)).alias("fetched")), "captures")
    spans = cut(intervals(changes), "list-intervals")
    keys = c.where("fetched is not null").select("uid", "fetched", F.explode(capture_keys(F.col("url"))).alias("k")) \
            .select("uid", "fetched", "k.kind", "k.key", "k.depth")
    active = F.filter("entries", lambda e: (e["valid_from"] <= F.col("fetched"))
                      & (e["valid_to"].isNull() | (e["valid_to"] > F.col("fetched"))))
    hits = keys.join(spans, ["kind", "key"]).withColumn("on", active).where(F.size("on") > 0)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = F.array_min(F.transform("on", lambda e: F.struct(
        place.alias("place"), (-F.col("depth")).alias("depth"), e["effect"].alias("effect"), e["list"].alias("list"))))
    found = hits.select("uid", F.size("on").alias("n"), best.alias("b"), "kind", "key").groupBy("uid").agg(
        F.sum("n").alias("n_active"), F.min(F.struct("b", "kind", "key")).alias("m"))
    return c.join(found, "uid", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("m.b.list").alias("list"), F.col("m.kind").alias("kind"), F.col("m.key").alias("key"),
        F.coalesce(F.col("m.b.effect") == "allow", F.lit(True)).alias("kept"))
