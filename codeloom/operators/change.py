"""Changes between two snapshots, freshness, caches, and which tests a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import import_segments, is_test_path, stem_of
from codeloom.operators.graph import reverse_hops, stored


def body_hash(lines, start, end):
    """First 16 hex digits of the SHA-256 of a symbol's lines."""
    return F.substring(F.sha2(F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n"), 256), 1, 16)


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change: added, removed or changed, path, qualname) by id and body_hash; an unreadable body ("") is equal to itself."""
    o, n = (s.select("id", "path", "qualname", "body_hash") for s in (old, new))
    both = o.alias("o").join(n.alias("n"), "id", "full_outer")
    change = F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed").when(~F.col("o.body_hash").eqNullSafe(F.col("n.body_hash")), "changed")
    return both.select("id", change.alias("change"), F.coalesce("n.path", "o.path").alias("path"), F.coalesce("n.qualname", "o.qualname").alias("qualname")).where("change IS NOT NULL")


def with_callers(delta: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """``delta`` with callers, sorted: of the new tree, or the old one for what was removed."""
    def callers(edges: DataFrame, removed: bool) -> DataFrame:
        rows = delta.where((F.col("change") == "removed") == F.lit(removed))
        found = edges.groupBy(F.col("callee").alias("id")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
        return rows.join(found, "id", "left")

    return callers(new_edges, False).unionByName(callers(old_edges, True))


def freshness_diff(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change: added, removed or changed). Both: path, content_hash, and stat where known; files with an equal
    stat are taken as equal, without their hashes."""
    both = recorded.alias("o").join(current.alias("n"), "path", "full_outer")
    same = F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    if "stat" in recorded.columns and "stat" in current.columns:
        same = (F.col("o.stat") == F.col("n.stat")) | same
    change = F.when(F.col("o.content_hash").isNull(), "added").when(F.col("n.content_hash").isNull(), "removed").when(~F.coalesce(same, F.lit(False)), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def cache_misses(current: DataFrame, cache: DataFrame) -> DataFrame:
    """Files to extract anew: no cached row has their path and content."""
    return current.join(cache.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def cache_hits(current: DataFrame, cache: DataFrame) -> DataFrame:
    return cache.join(current.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def same_paths(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same set of paths."""
    one, two = (x.select("path").distinct() for x in (a, b))
    return one.join(two, "path", "left_anti").isEmpty() and two.join(one, "path", "left_anti").isEmpty()


def pytest_hint(impacts: DataFrame, most: int = 20) -> DataFrame:
    """(hint): a call of pytest with the first ``most`` files of ``impacted_tests``, and how many more there are. No row
    without any file."""
    tier = F.when(F.col("tier") == "direct", 0).when(F.col("tier") == "transitive", 1).otherwise(2)
    first = impacts.select(tier.alias("t"), "path").orderBy("t", "path").limit(most).agg(F.array_sort(F.collect_list(F.struct("t", "path"))).alias("p"))
    n = impacts.agg(F.count("*").alias("n")).where("n > 0")
    more = F.when(F.col("n") > most, F.concat(F.lit("  # +"), (F.col("n") - most).cast("string"), F.lit(" more impacted test files not shown"))).otherwise("")
    return n.join(first).select(F.concat(F.lit("pytest "), F.array_join(F.transform("p", lambda x: x["path"]), " "), more).alias("hint"))


def diff_lines(delta: DataFrame, k: int = 8) -> DataFrame:
    """(change, rank, line, more) of a diff (with callers): the first ``k`` of each kind of change, with its callers, and how
    many there are beyond."""
    w = Window.partitionBy("change")
    names = F.when(F.size("callers") > 0, F.concat(F.lit("  <- "), F.array_join(F.slice("callers", 1, 3), ", "), F.when(F.size("callers") > 3, F.concat(F.lit(", +"), (F.size("callers") - 3).cast("string"))).otherwise(""))).otherwise("")
    mark = F.when(F.col("change") == "added", "+ ").when(F.col("change") == "removed", "- ").otherwise("~ ")
    rows = delta.withColumn("callers", F.coalesce("callers", F.array().cast("array<string>"))).withColumns({"rank": F.row_number().over(w.orderBy("path", "qualname", "id")), "n": F.count("*").over(w)})
    return rows.where(F.col("rank") <= k).select("change", "rank", F.concat(mark, "id", names).alias("line"), F.greatest(F.col("n") - k, F.lit(0)).alias("more"))


def import_hits(imports: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """(path) of test files that import something a changed file may stand for."""
    stems = changed_paths.select(stem_of(F.col("path")).alias("stem")).distinct()
    tests = imports.where(is_test_path(F.col("path"))).select("path", F.explode(import_segments(F.col("source"))).alias("stem"))
    return tests.join(stems, "stem", "left_semi").select("path").distinct()


def call_impacts(seeds: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, tier, symbols) of test files that reach a seed by calls: "direct" within one call, else "transitive"."""
    hops = reverse_hops(seeds, edges).withColumn("path", F.regexp_extract("id", r"^(.*?)::", 1)).where(is_test_path(F.col("path")))
    named = hops.join(symbols.where("test").select("id", "qualname", "start_line"), "id", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("qualname").isNotNull(), F.struct("start_line", "qualname"))))
    return named.groupBy("path").agg(F.when(F.min("hop") <= 1, "direct").otherwise("transitive").alias("tier"), F.transform(found, lambda s: s["qualname"]).alias("symbols"))


def impacted_tests(delta: DataFrame, edges: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Test files that a diff may affect, strongest evidence first: direct, transitive, import (only without calls)."""
    calls = stored(call_impacts(delta.where("change <> 'removed'").select("id"), edges, symbols))  # it is read twice
    hits = import_hits(imports, delta.select("path").distinct()).join(calls.select("path"), "path", "left_anti")
    both = calls.unionByName(hits.select("path", F.lit("import").alias("tier"), F.array().cast("array<string>").alias("symbols")))
    return both.orderBy(F.when(F.col("tier") == "direct", 0).when(F.col("tier") == "transitive", 1).otherwise(2), "path")
