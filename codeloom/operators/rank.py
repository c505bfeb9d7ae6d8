"""Ranking by task and structure, suggestions, worksets and packs."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import centrality, relevance, signature
from codeloom.operators.budget import running
from codeloom.operators.graph import degrees


def scaled(x: Column) -> Column:
    """To [0, 1] by minimum and maximum over all rows; all zero if they are equal. Aggregates, not a window: see ``blended``."""
    return F.when(F.col("hi") > F.col("lo"), (x - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)


def lexical(candidates: DataFrame, task: tuple[str, ...], diff_paths: tuple[str, ...] = (), recent_paths: tuple[str, ...] = ()) -> DataFrame:
    """``candidates`` (id, text, path, ...) with raw relevance and score: raw over the highest raw; zero without any match."""
    return scored_by(candidates, lambda text, path: relevance(text, path, task, diff_paths, recent_paths))


def blended(scored: DataFrame, weight: float = 0.5) -> DataFrame:
    """``scored`` (score, central) with blend: weight times score plus the rest times central, scaled to [0, 1]."""
    span = scored.agg(F.min("central").alias("lo"), F.max("central").alias("hi"))
    return scored.join(F.broadcast(span)).withColumn("blend", weight * F.col("score") + (1 - weight) * scaled(F.col("central"))).drop("lo", "hi")


def atoms(symbols: DataFrame, edges: DataFrame, churn: DataFrame) -> DataFrame:
    """(id, path, name, signature, score, demotable): symbols with centrality, i.e. fan-in weighted by their file's churn."""
    top = churn.agg(F.coalesce(F.max("commits"), F.lit(0)).alias("most"))
    sym = degrees(symbols, edges).join(churn, "path", "left").join(F.broadcast(top)).fillna(0, ["commits"])
    return sym.select("id", "path", "name", "start_line", "qualname", signature(*(F.col(c) for c in ("kind", "qualname", "params", "returns", "path"))).alias("signature"), centrality(F.col("fan_in"), F.col("commits"), F.col("most")).alias("score"), F.col("test").alias("demotable"))


def dense(lean: DataFrame, k: int = 30) -> DataFrame:
    """Dense mode: signatures only on the ``k`` atoms of the highest score."""
    top = lean.orderBy(F.desc("score"), "id").limit(k).select("id").withColumn("top", F.lit(True))
    return lean.join(F.broadcast(top), "id", "left").withColumn("form", F.when(F.col("top"), "sig").otherwise("name")).drop("top")


def lean_cap(n_files: int, floor: int = 0) -> int:
    """Tokens of a lean map: 3000 and 12 a file, 12000 at most, but never under the floor."""
    return max(min(12_000, 3_000 + 12 * n_files), floor)


def close_names(symbols: DataFrame, target: str, k: int = 5) -> DataFrame:
    """(name, path, tier) of up to ``k`` names like the target: equal but for case, a prefix, a part, or similar (ratio 0.6).

    Names whose length alone keeps the ratio under 0.6 aren't compared letter by letter.
    """
    low, name = target.lower(), F.lower("name")

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        return names.map(lambda x: difflib.SequenceMatcher(None, low, x).ratio())

    first = symbols.groupBy(name.alias("low")).agg(F.min_by(F.struct("name", "path", "test"), F.struct("test", "path", "start_line")).alias("s"))
    tier = F.when(F.col("low") == low, 0).when(F.startswith("low", F.lit(low)) | F.startswith(F.lit(low), F.col("low")), 1).when(F.col("low").contains(low) | F.lit(low).contains(F.col("low")), 2).otherwise(3)
    both = F.length("low") + len(low)
    found = first.withColumn("tier", tier).where((F.col("tier") < 3) | (2 * F.least(F.length("low"), F.lit(len(low))) >= 0.6 * both))
    found = found.withColumn("ratio", ratio("low")).where("tier < 3 OR ratio >= 0.6")
    return found.orderBy("tier", "s.test", F.desc("ratio"), "low").limit(k).select("s.name", "s.path", "tier")


def resolve_target(symbols: DataFrame, target: str) -> DataFrame:
    """Symbols that a target means, by the first way that finds any: path:name (the path whole or its end), a qualified
    name, a name; then with "::" read as ":" and as "."."""
    tries = []
    for t in dict.fromkeys((target, target.replace("::", ":"), target.replace("::", "."))):
        if ":" in t:
            path, _, q = t.rpartition(":")
            tries.append(((F.col("path") == path) | F.endswith("path", F.lit(f"/{path}"))) & ((F.col("qualname") == q) | (F.col("name") == q)))
        tries += [F.col("qualname") == t, F.col("name") == t]
    rank = F.coalesce(*(F.when(c, i) for i, c in enumerate(tries)))
    found = symbols.withColumn("way", rank).where("way IS NOT NULL")
    best = found.agg(F.min("way").alias("best"))
    return found.join(F.broadcast(best)).where("way = best").drop("way", "best")


def touched_files(symbols: DataFrame, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """(path, degree) of the files of touched symbols (id), the most connected first."""
    return degrees(symbols, edges).join(touched.select("id"), "id", "left_semi").groupBy("path").agg(F.sum("degree").alias("degree")).orderBy(F.desc("degree"), "path")


def workset(symbols: DataFrame, edges: DataFrame, touched: DataFrame, tests: DataFrame, packs: int = 5) -> DataFrame:
    """(tier, rank, item): touched files, the neighbours of the first ``packs`` touched symbols, all touched symbols, tests."""
    files = running(touched_files(symbols, edges, touched), [F.desc("degree"), F.col("path")], {}).select(F.lit(0).alias("tier"), "rank", F.col("path").alias("item"))
    own = degrees(symbols, edges).join(touched.select("id"), "id", "left_semi")
    ordered = running(own, [F.col("test"), F.desc("degree"), F.col("path"), F.col("start_line")], {})
    seeds = ordered.where(F.col("rank") <= packs).select("id", "rank")
    both = edges.select(F.col("callee").alias("id"), F.col("caller").alias("item")).unionByName(edges.select(F.col("caller").alias("id"), F.col("callee").alias("item")))
    near = both.join(F.broadcast(seeds), "id").groupBy("item").agg(F.min("rank").alias("rank")).select(F.lit(1).alias("tier"), "rank", "item")
    detail = ordered.select(F.lit(2).alias("tier"), "rank", F.col("id").alias("item"))
    hit = running(tests, [F.when(F.col("tier") == "direct", 0).when(F.col("tier") == "transitive", 1).otherwise(2), F.col("path")], {}).select(F.lit(3).alias("tier"), "rank", F.col("path").alias("item"))
    return files.unionByName(near).unionByName(detail).unionByName(hit)


def task_files(files: DataFrame, task: tuple[str, ...], diff_paths: tuple[str, ...] = (), recent_paths: tuple[str, ...] = (), seen: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(path, raw) of the ``k`` files (path, text) that a task is about: none without a match. ``seen`` (path): files that
    are in context already."""
    asked = files if seen is None else files.join(seen.select("path"), "path", "left_anti")
    scored = asked.select("path", relevance(F.col("text"), F.col("path"), task, diff_paths, recent_paths).alias("raw"))
    return scored.where("raw > 0").orderBy(F.desc("raw"), "path").limit(k)


def scored_by(candidates: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """``candidates`` (text, path, ...) with raw and score by any scorer: a function of both columns that returns one, built
    of expressions or a pandas UDF. Score is raw over the highest raw; zero if none is above zero."""
    raw = candidates.withColumn("raw", scorer(F.col("text"), F.col("path")))
    top = raw.agg(F.max("raw").alias("top"))
    return raw.join(F.broadcast(top)).withColumn("score", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0)).drop("top")
