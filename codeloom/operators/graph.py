"""Operators on the call graph: adjacency, degrees, reach, paths and projections.

Edges are (caller, callee, lines); a module-level caller is ``path::<module>``. Iterative operators keep only ids,
one row each, write every level to the shared folder (the lineage stays short and a lost executor costs one level)
and end when a level is empty.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import dir_of
from codeloom.schemas import MODULE


#: Whether executors drop the shuffles of a query as soon as it has ended, not when the driver has collected its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables that the round under way has stored.
_ROUND: ContextVar[list[str] | None] = ContextVar("round", default=None)


def _new_path(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/codeloom-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def _collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """Written to the folder that the session shares (spark.checkpoint.dir), and read from there."""
    spark = df.sparkSession
    path = _new_path(spark)
    if (made := _ROUND.get()) is not None:
        made.append(path)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(df: DataFrame) -> DataFrame:
    """``stored``; then the driver collects its garbage, as executors keep the shuffles that led to a table until it has:
    else the disk holds those of all stored tables together."""
    out = stored(df)
    _collect_garbage(df.sparkSession)
    return out


def rounds(df: DataFrame, rows: int) -> int:
    """How many rounds of about ``rows`` rows hold all of ``df``."""
    return max(1, -(-df.count() // rows))


def in_round(key: Column | str, k: int, n: int) -> Column:
    """Whether a key is dealt to round ``k`` of ``n``. Every key is in exactly one round, null too."""
    return F.pmod(F.xxhash64(key), F.lit(n)) == k


def in_rounds(n: int, make: Callable[[int], DataFrame]) -> DataFrame:
    """``make(k)`` for each k below ``n``, as one stored table. A round is written before the next begins; what it has
    stored on its way is removed then, and its shuffles go, so the disk holds the work of one round at a time."""
    path = None
    for k in range(n):
        made: list[str] = []
        token = _ROUND.set(made)
        try:
            df = make(k)
            spark, schema = df.sparkSession, df.schema
            path = path or _new_path(spark)
            _write(df, path)
        finally:
            _ROUND.reset(token)
        del df
        for old in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _collect_garbage(spark)
    if (outer := _ROUND.get()) is not None:
        outer.append(path)
    return spark.read.schema(schema).parquet(path)


class Levels:
    """What a search has reached. Levels are stored tables; every sixteenth writes them as one, so that a plan has few of
    them, however long the search."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, level: DataFrame) -> None:
        self.parts.append(level)
        if len(self.parts) > 16:
            self.parts = [stored(self.all())]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for x in self.parts[1:]:
            out = out.unionByName(x)
        return out


def adjacency(edges: DataFrame, direction: str = "in") -> DataFrame:
    """(id, neighbours): sorted distinct callers ("in") or callees ("out")."""
    of, other = ("callee", "caller") if direction == "in" else ("caller", "callee")
    return edges.groupBy(F.col(of).alias("id")).agg(F.array_sort(F.collect_set(other)).alias("neighbours"))


def degrees(symbols: DataFrame, edges: DataFrame, calling: DataFrame | None = None) -> DataFrame:
    """``symbols`` with fan_in, fan_out and degree: distinct neighbours, module-level callers included. ``edges`` need be
    no more than those to the symbols if those from them are given as ``calling``."""
    n_in = edges.groupBy(F.col("callee").alias("id")).agg(F.count_distinct("caller").alias("fan_in"))
    n_out = (edges if calling is None else calling).groupBy(F.col("caller").alias("id")).agg(F.count_distinct("callee").alias("fan_out"))
    out = symbols.join(n_in, "id", "left").join(n_out, "id", "left").fillna(0, ["fan_in", "fan_out"])
    return out.withColumn("degree", F.col("fan_in") + F.col("fan_out"))


def ranked(symbols: DataFrame) -> DataFrame:
    """The order of importance: production code, then by degree, path and line."""
    return symbols.orderBy("test", F.desc("degree"), "path", "start_line")


def hotspots(symbols: DataFrame, edges: DataFrame, by: str = "fan_in", k: int = 10) -> DataFrame:
    return degrees(symbols, edges).where(F.col(by) > 0).orderBy(F.desc(by), "path", "start_line").limit(k)


def related(edges: DataFrame, symbols: DataFrame, symbol_id: str, direction: str = "in") -> DataFrame:
    """Callers ("in") or callees of one symbol: id, lines, the symbol's columns, module (a path, if at module level).
    Unknown ids are dropped."""
    of, other = ("callee", "caller") if direction == "in" else ("caller", "callee")
    found = edges.where(F.col(of) == symbol_id).select(F.col(other).alias("id"), "lines")
    module = F.when(F.endswith("id", F.lit(MODULE)), F.regexp_replace("id", f"{MODULE}$", ""))
    return found.join(symbols, "id", "left").withColumn("module", module).where(F.col("name").isNotNull() | F.col("module").isNotNull())


def sites(edges: DataFrame, symbols: DataFrame, symbol_id: str, direction: str = "in") -> DataFrame:
    """One row per call site: id, path, line. An edge without lines gives the definition's line. Sites of callers
    lie in the caller's file, those of callees are listed in the callee's own."""
    found = related(edges, symbols, symbol_id, direction)
    return found.select("id", F.coalesce("path", "module").alias("path"), "start_line", F.explode_outer("lines").alias("line")).select("id", "path", F.coalesce("line", "start_line").alias("line"))


def reverse_hops(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, hop): least number of calls from each id to any seed (id), seeds at 0. It goes on until nothing new is
    reached, however far that is."""
    back = stored(edges.select(F.col("callee").alias("id"), F.col("caller").alias("next")).distinct())
    frontier = stored(seeds.select("id").distinct())
    seen, hop = Levels(frontier.withColumn("hop", F.lit(0))), 0
    while not frontier.isEmpty():
        hop += 1
        new = frontier.join(back, "id").select(F.col("next").alias("id")).distinct().join(seen.all(), "id", "left_anti")
        frontier = stored(new)
        seen.add(frontier.withColumn("hop", F.lit(hop)))
    return seen.all()


def neighbourhood(edges: DataFrame, symbols: DataFrame, symbol_id: str, hops: int = 1) -> DataFrame:
    """(id, hop, direction) of symbols and modules within ``hops`` calls, callers ("caller") and callees. A node found
    in both directions at once counts as a caller. Modules are listed but not gone beyond."""
    edges = stored(edges.select("caller", "callee"))
    steps = edges.select(F.col("callee").alias("id"), F.col("caller").alias("next"), F.lit(0).alias("d")).unionByName(edges.select(F.col("caller").alias("id"), F.col("callee").alias("next"), F.lit(1).alias("d")))
    known = symbols.select(F.col("id").alias("next"))
    frontier = edges.sparkSession.createDataFrame([(symbol_id,)], "id string")
    seen = frontier.select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("direction"))
    for hop in range(1, hops + 1):
        reached = frontier.join(steps, "id")
        nodes = reached.join(known, "next", "left_semi").unionByName(reached.where(F.endswith("next", F.lit(MODULE))).select("next", "id", "d"))
        new = nodes.groupBy(F.col("next").alias("id")).agg(F.min("d").alias("d")).join(seen, "id", "left_anti")
        new = stored(new.select("id", F.lit(hop).alias("hop"), F.when(F.col("d") == 0, "caller").otherwise("callee").alias("direction")))
        seen, frontier = seen.unionByName(new), new.where(~F.endswith("id", F.lit(MODULE))).select("id")
    return seen.where("hop > 0")


def file_neighbourhood(edges: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """(id, module): callers from outside of a file's symbols, each once; module-level callers by their paths."""
    inside = symbols.where(F.col("path") == path).select(F.col("id").alias("callee"))
    callers = edges.join(inside, "callee", "left_semi").select(F.col("caller").alias("id")).distinct()
    own = callers.join(symbols.where(F.col("path") == path).select("id"), "id", "left_anti").where(F.col("id") != path + MODULE)
    return own.withColumn("module", F.when(F.endswith("id", F.lit(MODULE)), F.regexp_replace("id", f"{MODULE}$", "")))


def _steps(edges: DataFrame, symbols: DataFrame, source: str, target: str) -> list[DataFrame]:
    """(id, next) of each level of a search from ``source``, up to the one that reaches ``target``; none if none does.
    Modules are no steps. Every level keeps all least-depth predecessors."""
    ids = symbols.select("id")
    out = stored(edges.select(F.col("caller").alias("id"), F.col("callee").alias("next")).distinct().join(ids.withColumnRenamed("id", "next"), "next", "left_semi"))
    frontier = edges.sparkSession.createDataFrame([(source,)], "id string")
    seen, levels = Levels(frontier), []
    while True:
        step = stored(frontier.join(out, "id").join(seen.all().withColumnRenamed("id", "next"), "next", "left_anti").select("id", "next"))
        if step.isEmpty():
            return []
        levels.append(step)
        if not step.where(F.col("next") == target).isEmpty():
            return levels
        frontier = stored(step.select(F.col("next").alias("id")).distinct())
        seen.add(frontier)


def shortest_paths(edges: DataFrame, symbols: DataFrame, source: str, target: str) -> DataFrame:
    """(length, path) of all shortest call paths between two symbols, of any length; none if there is none. Paths are put
    together from the steps of the levels alone."""
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0, [source])], "length int, path array<string>")
    levels = _steps(edges, symbols, source, target)
    if not levels:
        return spark.createDataFrame([], "length int, path array<string>")
    paths = spark.createDataFrame([(target, [target])], "at string, path array<string>")
    for n, step in enumerate(reversed(levels), 1):
        paths = paths.join(step, paths["at"] == step["next"]).select(F.col("id").alias("at"), F.concat(F.array("id"), "path").alias("path"))
        if n % 16 == 0:  # a plan of a few joins, however long the path
            paths = stored(paths)
    return paths.select(F.lit(len(levels)).alias("length"), "path")


def path_count(edges: DataFrame, symbols: DataFrame, source: str, target: str) -> DataFrame:
    """(length, paths): how many shortest call paths there are, one row; no row if there is none. They are counted level by
    level, a row for each symbol, and never put together."""
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0, 1)], "length int, paths long")
    levels = _steps(edges, symbols, source, target)
    if not levels:
        return spark.createDataFrame([], "length int, paths long")
    counts = spark.createDataFrame([(target, 1)], "at string, paths long")
    for n, step in enumerate(reversed(levels), 1):
        counts = counts.join(step, counts["at"] == step["next"]).groupBy(F.col("id").alias("at")).agg(F.sum("paths").alias("paths"))
        if n % 16 == 0:
            counts = stored(counts)
    return counts.select(F.lit(len(levels)).alias("length"), "paths")


def projection(edges: DataFrame, scope: str = "file") -> DataFrame:
    """(src, dst): distinct edges between files ("file"), directories ("dir") or symbols, without loops."""
    def end(c: str):
        path = F.regexp_extract(c, r"^(.*?)::", 1)
        return F.col(c) if scope == "symbol" else path if scope == "file" else dir_of(path)

    return edges.select(end("caller").alias("src"), end("callee").alias("dst")).where("src <> dst").distinct()


def overview(edges: DataFrame, max_nodes: int) -> tuple[str, DataFrame | None]:
    """The widest projection of at most ``max_nodes`` nodes: ("file" or "dir", edges), ("empty" or "omitted", None)."""
    for scope in ("file", "dir"):
        found = projection(edges, scope)
        n = found.select("src").union(found.select("dst")).distinct().limit(max_nodes + 1).count()
        if n <= max_nodes:
            return (scope, found) if n else ("empty", None)
    return "omitted", None
