"""Rollups: language mix, directories, coupling, churn, entry points, dead code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import INDEX_STEMS, base_name, dir_of, matches_globs
from codeloom.operators.graph import degrees
from codeloom.schemas import TYPE_KINDS


def path_of(c: str):
    return F.regexp_extract(c, r"^(.*?)::", 1)


def language_mix(files: DataFrame, symbols: DataFrame) -> DataFrame:
    n = symbols.groupBy("path").agg(F.count("*").alias("n"))
    return files.join(n, "path", "left").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols")).orderBy(F.desc("files"), "language")


def largest_files(symbols: DataFrame, k: int = 10) -> DataFrame:
    return symbols.groupBy("path").agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "path").limit(k)


def kind_counts(symbols: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return symbols.agg(F.count_if(kind.isin("function", "method")).alias("functions"), F.count_if(kind.isin(*TYPE_KINDS)).alias("types"), F.count_if(kind == "variable").alias("variables"), F.count("*").alias("symbols"))


def coupling(edges: DataFrame) -> DataFrame:
    """(dir, internal, cross): edges within a directory, and edges that cross, counted on both sides."""
    e = edges.select(dir_of(path_of("caller")).alias("a"), dir_of(path_of("callee")).alias("b"))
    ends = e.select(F.col("a").alias("dir"), (F.col("a") == F.col("b")).alias("same")).unionByName(e.where("a <> b").select(F.col("b").alias("dir"), F.lit(False).alias("same")))
    return ends.groupBy("dir").agg(F.count_if("same").alias("internal"), F.count_if(~F.col("same")).alias("cross"))


def directory_purpose(files: DataFrame) -> DataFrame:
    """(dir, purpose): the doc of the directory's index file, else the first doc by path."""
    stem = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")
    return files.where("doc <> ''").groupBy(dir_of(F.col("path")).alias("dir")).agg(F.min_by("doc", F.struct(~stem.isin(*INDEX_STEMS), "path")).alias("purpose"))


def directories(files: DataFrame, symbols: DataFrame, edges: DataFrame, k: int = 12) -> DataFrame:
    """(dir, files, symbols, internal, cross, purpose) of the directories with most symbols."""
    f = files.groupBy(dir_of(F.col("path")).alias("dir")).agg(F.count("*").alias("files"))
    s = symbols.groupBy(dir_of(F.col("path")).alias("dir")).agg(F.count("*").alias("symbols"))
    out = f.join(s, "dir", "left").join(coupling(edges), "dir", "left").join(directory_purpose(files), "dir", "left").fillna(0, ["symbols", "internal", "cross"])
    return out.orderBy(F.desc("symbols"), "dir").limit(k)


def file_fan_in(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(symbols, edges).groupBy("path").agg(F.sum("fan_in").alias("fan_in"))


def churn(commits: DataFrame, days: int = 90) -> DataFrame:
    """(path, commits) of the last ``days`` days of the history."""
    last = commits.agg(F.max("ts").alias("last"))
    return commits.join(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr(f"make_dt_interval({days})")).groupBy("path").agg(F.count("*").alias("commits"))


def churn_hotspots(commits: DataFrame, symbols: DataFrame, edges: DataFrame, days: int = 90, k: int = 10) -> DataFrame:
    """(path, commits, fan_in, score): commits times the file's share of the highest fan-in of all files, to one place,
    half to even. Files without commits in the window, or that nothing calls, are left out."""
    fan_in = file_fan_in(symbols, edges)
    top = fan_in.agg(F.max("fan_in").alias("top"))
    found = churn(commits, days).join(fan_in.where("fan_in > 0"), "path")
    return found.join(F.broadcast(top)).withColumn("score", F.bround(F.col("commits") * (F.col("fan_in") / F.col("top")), 1)).drop("top").orderBy(F.desc("score"), "path").limit(k)


def skip_reasons(skipped: DataFrame) -> DataFrame:
    """(reason, files) of what discovery left out, the most frequent first."""
    return skipped.groupBy("reason").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "reason")


def run_summary(edges: DataFrame, ambiguous: DataFrame, external: DataFrame) -> DataFrame:
    """One row: edges, ambiguous and external calls of a build."""
    n = [t.agg(F.count("*").alias(c)) for c, t in (("edges", edges), ("ambiguous", ambiguous), ("external", external))]
    return n[0].join(F.broadcast(n[1])).join(F.broadcast(n[2]))


def external_counts(external: DataFrame) -> DataFrame:
    """(caller, callee, n, line) of raw external calls: how many, and the last line."""
    return external.groupBy("caller", "callee").agg(F.count("*").alias("n"), F.max("line").alias("line"))


def module_edges(projected: DataFrame) -> DataFrame:
    """(src, targets): the directories that each directory calls, as one line."""
    return projected.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ", ").alias("targets"))


def churn_windows(commits: DataFrame, width: str = "7 days") -> DataFrame:
    """(week, path, commits) of tumbling windows."""
    return commits.groupBy(F.window("ts", width).alias("w"), "path").agg(F.count("*").alias("commits")).select(F.col("w.start").alias("week"), "path", "commits")


def churn_sessions(commits: DataFrame, gap: str = "1 day") -> DataFrame:
    """(start, path, commits) of runs of commits to a file without a longer gap."""
    return commits.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.count("*").alias("commits")).select(F.col("w.start").alias("start"), "path", "commits")


def entry_points(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols called main, and uncalled ones that are decorated or exported, by path and line."""
    called = edges.select(F.col("callee").alias("id")).distinct().withColumn("called", F.lit(True))
    return symbols.join(called, "id", "left").where((F.col("name") == "main") | (F.col("called").isNull() & (F.col("decorated") | F.col("exported")))).drop("called").orderBy("path", "start_line")


def used_keys(symbols: DataFrame, *inbound: DataFrame) -> DataFrame:
    """(path, qualname) of what is called or referenced, and of everything that contains it."""
    ids = inbound[0].select(F.col("callee").alias("id"))
    for e in inbound[1:]:
        ids = ids.unionByName(e.select(F.col("callee").alias("id")))
    parts = F.split("qualname", r"\.")
    used = symbols.join(ids.distinct(), "id", "left_semi").select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("qualname"))
    return used.distinct()


def reexports(imports: DataFrame) -> DataFrame:
    """Names imported into a package's __init__.py."""
    return imports.where((F.col("path") == "__init__.py") | F.endswith("path", F.lit("/__init__.py"))).select("name").distinct()


def unused(symbols: DataFrame, imports: DataFrame, edges: DataFrame, referenced: DataFrame | None = None, root_globs: tuple[str, ...] = ()) -> DataFrame:
    """Symbols that nothing uses and that are no roots (main, decorated, exported, tests, dunders, re-exported, exported
    Go names, files that a glob matches), by path and line."""
    root = (F.col("name") == "main") | F.col("decorated") | F.col("exported") | matches_globs(F.col("path"), root_globs) | F.col("test") | ((F.col("language") == "go") & F.col("name").rlike("^[A-Z]")) | F.col("name").rlike("^__.*__$")
    inbound = [edges] + ([referenced] if referenced is not None else [])
    return symbols.where(~root).join(reexports(imports), "name", "left_anti").join(used_keys(symbols, *inbound), ["path", "qualname"], "left_anti").orderBy("path", "start_line")


def stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, symbols by kind, edges."""
    return kind_counts(symbols).crossJoin(files.agg(F.count("*").alias("files"))).crossJoin(edges.agg(F.count("*").alias("edges")))


def without_tests(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Views of all tables without test code: test symbols, edges that touch them, and what test files say."""
    from codeloom.functions.text import is_test_path

    def prod(df: DataFrame, *ids: str) -> DataFrame:
        for c in ids:
            df = df.where(~is_test_path(path_of(c)))
        return df

    out = dict(tables)
    for name, ids in {"edges": ("caller", "callee"), "referenced": ("caller", "callee"), "external": ("caller",), "ambiguous": ("caller",), "notes": ("symbol_id",)}.items():
        if name in out:
            out[name] = prod(out[name], *ids)
    for name in ("files", "symbols", "imports"):
        if name in out:
            out[name] = out[name].where(~is_test_path(F.col("path")))
    return out
