"""URL filtering by dated lists: validity intervals and an as-of join, in DataFrame
functions only.

A list is a log of dated entries (list_name, pattern, action, effective): from
``effective`` on, 'block' puts the pattern on the list, 'allow' exempts it, and 'remove'
takes it off. A pattern is a domain ("a.org" also covers "www.a.org") or a domain and a path
prefix of whole segments ("a.org/x"), however many and in the path's own case: captures are
probed as deep as the list's deepest pattern. Entries become disjoint intervals per pattern with
the sums of all lists active in them, so a capture meets one interval per pattern at
most, however many lists name it.

Defined results: a capture with a null or hostless URL, or a null time, matches nothing and
is kept; entries with a null pattern, action or date, or without a domain, are ignored; entries of one list and
pattern at one time: 'remove' loses to 'block', which loses to 'allow'; repeated captures
each get their own row; an empty list keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Captures of one pattern are dealt out to so many parts, so that a host with a third of all captures spreads.
SALTS = 16


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)", 1)
    return F.rtrim(F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@", ""), r":\d*$", ""), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.\-]*:)?//[^/?#\\]*(/[^?#]*)", 1)


def pattern_of(text: Column) -> Column:
    """A list's pattern written as the captures' ones are: without scheme, user, port, final dot, query and empty segments, the
    domain in lower case, the path in its own case; null without a domain.
    """
    url = F.concat(F.lit("//"), F.regexp_replace(F.trim(text), r"^(?i:[a-z][a-z0-9+.\-]*:)?//", ""))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    return F.nullif(F.array_join(F.concat(F.array(host_of(url)), parts), "/"), F.lit(""))


def depth_of(spans: DataFrame) -> DataFrame:
    """One row: ``__depth``, the most path segments that a pattern has."""
    slashes = F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit("")))
    return spans.agg(F.coalesce(F.max(slashes), F.lit(0)).alias("__depth"))


def patterns_of(url: Column, segments: Column) -> Column:
    """The patterns of up to ``segments`` segments that cover a URL: each domain suffix of its host, bare and with its first path segments."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    depth = F.least(F.size(parts), segments)
    paths = F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    every = F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))
    return F.when(F.length(host_of(url)) > 0, every).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to, n_block, n_allow): disjoint half-open intervals; an open end is null.

    Both windows are over the entries of one pattern; the list is small beside the captures.
    """
    action = F.lower("action")
    dated = entries.select("list_name", pattern_of(F.col("pattern")).alias("pattern"), F.when(action == "allow", 2).when(action == "block", 1).when(action == "remove", 0).alias("state"), F.col("effective").cast("timestamp").alias("at"))
    dated = dated.where("pattern IS NOT NULL AND NOT startswith(pattern, '/') AND state IS NOT NULL AND at IS NOT NULL").groupBy("list_name", "pattern", "at").agg(F.max("state").alias("state"))
    log = Window.partitionBy("pattern", "list_name").orderBy("at")
    was = F.coalesce(F.lag("state").over(log), F.lit(0))
    steps = dated.select("pattern", "at", ((F.col("state") == 1).cast("int") - (was == 1).cast("int")).alias("block"), ((F.col("state") == 2).cast("int") - (was == 2).cast("int")).alias("allow"))
    steps = steps.groupBy("pattern", "at").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).where("block != 0 OR allow != 0")
    time = Window.partitionBy("pattern").orderBy("at")
    spans = steps.select("pattern", F.col("at").alias("valid_from"), F.lead("at").over(time).alias("valid_to"), F.sum("block").over(time).alias("n_block"), F.sum("allow").over(time).alias("n_allow"))
    return spans.where("n_block > 0 OR n_allow > 0")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", salts: int = SALTS) -> DataFrame:
    """Per capture: ``id_col``, ``url_col``, n_block, n_allow (active list entries that cover it
    at fetch time), blocked_by (the most specific blocking pattern, else null), kept.

    A capture is kept unless a list blocks it and none exempts it at that time. Patterns
    are equi-joined with ``salts`` copies of the intervals; captures that match nothing
    do not go through the second shuffle alone: each capture keeps one row of its own.
    """
    base = captures.select(F.col(id_col), F.col(url_col), F.col(time_col).cast("timestamp").alias("__t"))
    base = base.withColumns({"__row": F.struct(F.monotonically_increasing_id().alias("n"), F.xxhash64(F.col(id_col), F.col(url_col), "__t").alias("h")), "__salt": F.pmod(F.xxhash64(F.col(id_col), F.col(url_col)), F.lit(salts))})
    base = base.crossJoin(F.broadcast(depth_of(entries.select(pattern_of(F.col("pattern")).alias("pattern")))))
    probes = base.select("__row", id_col, url_col, "__t", "__salt", F.explode_outer(patterns_of(F.col(url_col), F.col("__depth"))).alias("__pattern"))
    spans = validity_intervals(entries).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    active = (F.col("__pattern") == F.col("pattern")) & (probes["__salt"] == spans["__salt"]) & (F.col("__t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__t") < F.col("valid_to")))
    met = probes.join(spans, active, "left")
    specific = F.struct(F.length("__pattern"), F.col("__pattern"))
    out = met.groupBy("__row", id_col, url_col).agg(
        F.coalesce(F.sum("n_block"), F.lit(0)).cast("long").alias("n_block"),
        F.coalesce(F.sum("n_allow"), F.lit(0)).cast("long").alias("n_allow"),
        F.max_by("__pattern", F.when(F.col("n_block") > 0, specific)).alias("blocked_by"),
    )
    return out.select(id_col, url_col, "n_block", "n_allow", "blocked_by", ((F.col("n_block") == 0) | (F.col("n_allow") > 0)).alias("kept"))
