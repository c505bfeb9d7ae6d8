"""Operator 10: URL filters by a temporal join with dated block lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import bind, free_names

#: Tasks that the captures below one domain are dealt to: every host ends in one of a few names.
SALTS = 8
#: The host of a URL: after the scheme and any user name, before the port.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)"


def host_of(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def suffixes_of(host: Column) -> Column:
    """The host and all domains above it. Names have 127 labels at most; the longest 127 suffixes of a longer one, which
    no list can have, aren't looked up."""
    return bind(F.split(host, r"\."), lambda x: F.transform(F.sequence(F.greatest(F.lit(1), F.size(x) - 126), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (list, domain, action, at) as intervals (list, domain, valid_from, valid_to) of what is listed.

    The last entry for a domain up to a time holds at that time; on a tie an "add" comes last. ``valid_to`` is
    exclusive, null if open. Entries with a null anywhere, or another action than add or remove, are left out.
    """
    dated = entries.select("list", F.lower(F.rtrim(F.col("domain"), F.lit("."))).alias("domain"), F.lower("action").alias("action"), "at").where("action IN ('add', 'remove')").dropna()
    last = dated.groupBy("list", "domain", "at").agg(F.min("action").alias("action"))
    following = Window.partitionBy("list", "domain").orderBy("at")
    return last.withColumn("valid_to", F.lead("at").over(following)).where("action = 'add'").select("list", "domain", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """All captures with host, blocked, lists (names, sorted), matched (the longest listed domain), listed_since.

    An entry for a domain holds for it and its subdomains. Each capture is held against what was listed at its own
    time. Distinct (host, time) pairs are judged once and joined back, so a hot host costs one row per distinct
    time. Rows are never multiplied, repeated rows included; a null or hostless URL, or a null time, is not blocked.
    Columns of ``captures`` that have a result's name are replaced. Where two lists have the longest domain, or one had
    it listed twice over, ``listed_since`` is the latest start of those that hold. Empty tables give no rows, or nothing
    blocked.
    """
    results = ("host", "blocked", "lists", "matched", "listed_since")
    clash = {r.lower() for r in results}
    kept = captures.select(*(c for c in captures.columns if c.lower() not in clash or c in (url_col, time_col)))
    h, t = free_names(kept, "capture_host", "capture_time")
    timed = kept.withColumns({h: host_of(F.col(url_col)), t: F.col(time_col)})
    asked = timed.select(F.col(h).alias("h"), F.col(t).alias("t")).dropna().distinct()
    # a domain's captures are dealt by host and time, and its intervals, which are few beside them, go to each part
    part = F.pmod(F.xxhash64("h", "t"), F.lit(SALTS)).alias("part")
    suffixes = asked.select("h", "t", part, F.explode(suffixes_of(F.col("h"))).alias("domain"))
    listed = validity(entries).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    active = suffixes.join(listed, ["domain", "part"]).where("valid_from <= t AND (valid_to IS NULL OR t < valid_to)")
    verdict = active.groupBy("h", "t").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.max(F.struct(F.length("domain").alias("n"), "domain", "valid_from")).alias("m"))
    verdict = verdict.select("h", "t", F.col("lists").alias("_lists"), F.col("m.domain").alias("_matched"), F.col("m.valid_from").alias("_since"))
    out = timed.join(verdict, (timed[h] == verdict["h"]) & (timed[t] == verdict["t"]), "left")
    base = [c for c in kept.columns if c.lower() not in clash]
    return out.select(*(timed[c] for c in base), timed[h].alias("host"), verdict["_lists"].isNotNull().alias("blocked"), F.coalesce(verdict["_lists"], F.array().cast("array<string>")).alias("lists"), verdict["_matched"].alias("matched"), verdict["_since"].alias("listed_since"))
