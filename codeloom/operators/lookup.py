"""Lookups and renderings: discovery verdicts, outlines, cards, external uses, diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import base_name, callee_base, dir_of, glob_regex, is_test_path, matches_globs, signature, slug, strings, tokens
from codeloom.operators.graph import degrees
from codeloom.schemas import MODULE, TYPE_KINDS

# Folders that are never read, and names of generated files.
EXCLUDED_DIRS = (".git", ".hg", ".svn", ".venv", "venv", ".tox", "node_modules", "target", "dist", "build", "vendor", "third_party", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache")
GENERATED = ("*.min.js", "*.min.css", "*_pb2.py", "*_pb2_grpc.py", "*.pb.go", "*.generated.*", "*.d.ts")


# Fixed value: suffixes of source code that nothing here reads; what they leave out is reported.
UNREAD = {"astro": "astro"}


def ignored_by(path: Column, rules: tuple[tuple[bool, str], ...]) -> Column:
    """Whether the last rule that matches the path ignores it: (ignores?, regular expression) in the file's order."""
    out = F.lit(False)
    for ignores, rule in rules:
        out = F.when(path.rlike(rule), F.lit(ignores)).otherwise(out)
    return out


def verdicts(files: DataFrame, languages: dict[str, str], excludes: tuple[str, ...] = (), ignored: tuple[tuple[bool, str], ...] = (), subpath: str = "", max_file_size: int = 1_000_000, unread: dict[str, str] = UNREAD) -> DataFrame:
    """``files`` (path, size) with verdict, the first that holds: drop (outside, excluded folder), generated, excluded,
    ignored, no parser (of a language that is known but not read), drop (unknown suffix), too large, ok. ``ignored``: the
    rules of the ignore files, as in ``ignored_by``."""
    path, name = F.col("path"), base_name(F.col("path"))
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    inside = F.lit(True) if subpath in ("", ".") else (path == subpath) | F.startswith(path, F.lit(f"{subpath}/"))
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    verdict = (
        F.when(~inside, "drop")
        .when(F.arrays_overlap(folders, strings(*EXCLUDED_DIRS)), "drop")
        .when(name.rlike("|".join(map(glob_regex, GENERATED))), "generated")
        .when(matches_globs(path, excludes), "excluded")
        .when(ignored_by(path, ignored), "ignored")
        .when(~suffix.isin(*languages) & suffix.isin(*unread), F.concat(F.lit("no parser ("), _named(suffix, unread), F.lit(")")))
        .when(~suffix.isin(*languages), "drop")
        .when(F.col("size") > max_file_size, "too large")
        .otherwise("ok")
    )
    return files.withColumn("verdict", verdict)


def _named(suffix: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for s, name in names.items():
        out = F.when(suffix == s, name).otherwise(out)
    return out


def definition_order(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "qualname", "id")))


def outline(symbols: DataFrame) -> DataFrame:
    """(path, row, line, tokens): a line per symbol in definition order, indented by its depth."""
    depth = F.size(F.split("qualname", r"\."))
    sig = signature(F.col("kind"), F.col("name"), F.col("params"), F.col("returns"), F.col("path"))
    rows = definition_order(symbols).withColumn("line", F.concat(F.repeat(F.lit("  "), depth), sig, F.lit("  L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")))
    return rows.select("path", F.col("position").alias("row"), "line", tokens(F.col("line")).alias("tokens"))


def outline_dirs(symbols: DataFrame) -> DataFrame:
    """(path, symbols, position within the directory): production files first, then by path."""
    n = symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    return n.withColumn("position", F.row_number().over(Window.partitionBy(dir_of(F.col("path"))).orderBy(is_test_path(F.col("path")), "path")))


def sparse(outlines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Outlines that say too little of a large file: 500 tokens or more, 8 symbols at most, 15 % at most."""
    n = outlines.groupBy("path").agg(F.sum("tokens").alias("outline"), F.count("*").alias("symbols"))
    return n.join(sizes, "path").where((F.col("full") >= 500) & (F.col("symbols") <= 8) & (F.col("outline") <= 0.15 * F.col("full")))


def cards(symbols: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    n = notes.groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("notes"))
    return degrees(symbols, edges).join(n, "id", "left").fillna(0, ["notes"])


def uses(external: DataFrame, base: str) -> DataFrame:
    """External calls whose last segment is ``base``: production callers first."""
    return external.where(callee_base(F.col("callee")) == base).orderBy(is_test_path(F.regexp_extract("caller", r"^(.*?)::", 1)), "caller", "callee")


def shadows(bases: DataFrame, symbols: DataFrame) -> DataFrame:
    """External names that the repository also defines."""
    own = symbols.select(F.col("name").alias("base")).unionByName(symbols.select(F.col("qualname").alias("base"))).distinct()
    return bases.join(own, "base", "left_semi")


def attached(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Notes with their symbols."""
    return symbols.join(notes, F.col("id") == F.col("symbol_id"))


def file_symbols(symbols: DataFrame, prefix: str) -> DataFrame:
    """The symbols of the files below a prefix, in order."""
    return symbols.where(F.startswith("path", F.lit(prefix))).orderBy("path", "start_line", "qualname")


def zero_fan_types(symbols: DataFrame, edges: DataFrame, referenced: DataFrame) -> DataFrame:
    """(id) of types that nothing calls, that call nothing and that nothing refers to: as annotations leave no edge, a
    count of zero doesn't say that they are unused."""
    found = degrees(symbols, edges).where(F.col("kind").isin(*TYPE_KINDS) & (F.col("degree") == 0))
    return found.join(referenced.select(F.col("callee").alias("id")), "id", "left_anti").select("id")


def referenced_rows(referenced: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, caller, path, line): who refers to each symbol that has no caller. A module-level reference is its path and no
    line, a symbol's stands at its definition."""
    uncalled = referenced.join(edges.select("callee"), "callee", "left_anti").select(F.col("callee").alias("id"), "caller").distinct()
    own = symbols.select(F.col("id").alias("caller"), "path", F.col("start_line").alias("line"))
    module = F.when(F.endswith("caller", F.lit(MODULE)), F.regexp_replace("caller", f"{MODULE}$", ""))
    found = uncalled.join(own, "caller", "left").withColumn("path", F.coalesce("path", module))
    return found.where("path IS NOT NULL").select("id", "caller", "path", "line")


def minor_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with no symbol, no doc and no error: those that a map folds to one line."""
    return files.where("coalesce(doc, '') = '' AND coalesce(error, '') = ''").join(symbols.select("path"), "path", "left_anti")


def anchors(keys: DataFrame, order: list[str]) -> DataFrame:
    """``keys`` (key, ...) with anchor: the key's slug, and from the second of equal slugs on, in the given order, with
    -2, -3, ... where that is free. A name that a number makes may be another key's slug: those that collide take
    the next number that no slug of their own ends in."""
    first = keys.withColumn("slug", F.when(slug(F.col("key")) == "", "x").otherwise(slug(F.col("key"))))
    nth = first.withColumn("nth", F.row_number().over(Window.partitionBy("slug").orderBy(*order)))
    # numbers that slugs of the form base-n already take
    taken = first.select(F.regexp_extract("slug", r"^(.*)-(\d+)$", 1).alias("base"), F.regexp_extract("slug", r"^(.*)-(\d+)$", 2).alias("n")).where("base <> ''")
    taken = taken.select("base", F.col("n").try_cast("bigint").alias("n")).where("n >= 2").distinct().groupBy("base").agg(F.array_sort(F.collect_list("n")).alias("used"))
    used = F.coalesce("used", F.array().cast("array<bigint>"))
    # the nth key takes the (nth - 1)th number from 2 on that isn't used: each used one below moves it on by one
    number = F.aggregate(used, F.col("nth").cast("bigint"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    out = nth.join(taken, nth["slug"] == taken["base"], "left")
    return out.withColumn("anchor", F.when(F.col("nth") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), number.cast("string")))).drop("slug", "nth", "base", "used")


def section_order(files: DataFrame, symbols: DataFrame, edges: DataFrame, order: str = "path") -> DataFrame:
    """``files`` in the order of a map's sections: by directory, then by path, by name, or by fan-in (highest first)."""
    directory, name = dir_of(F.col("path")), base_name(F.col("path"))
    if order == "name":
        return files.orderBy(directory, name)
    if order == "fan-in":
        n = degrees(symbols, edges).groupBy("path").agg(F.sum("fan_in").alias("file_fan_in"))
        return files.join(n, "path", "left").orderBy(directory, F.desc(F.coalesce("file_fan_in", F.lit(0))), "path")
    return files.orderBy(directory, "path")


def size_advice(full: DataFrame, outlines: DataFrame, threshold: int = 1000) -> DataFrame:
    """(path, full, outline, percent) of files of ``threshold`` tokens or more: what an outline costs beside the whole."""
    n = outlines.groupBy("path").agg(F.sum("tokens").alias("outline"))
    found = full.where(F.col("full") >= threshold).join(n, "path", "left").fillna(0, ["outline"])
    return found.withColumn("percent", F.bround(100 * F.col("outline") / F.col("full"), 0).cast("int"))


def orphans(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    return notes.join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti")


def backbone(symbols: DataFrame) -> DataFrame:
    """(dir, files, symbols, demotable): a directory is demotable if all its files are tests."""
    files = symbols.groupBy("path").agg(F.count("*").alias("n"))
    return files.groupBy(dir_of(F.col("path")).alias("dir")).agg(F.count("*").alias("files"), F.sum("n").alias("symbols"), F.bool_and(is_test_path(F.col("path"))).alias("demotable"))


def diagram(edges: DataFrame, style: str) -> DataFrame:
    """(line) of a Mermaid or DOT diagram over (src, dst): nodes n0, n1, ... by name, then edges. For the bounded graphs
    that ``overview`` lets through: numbering is one small sort."""
    nodes = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct().withColumn("n", F.concat(F.lit("n"), (F.row_number().over(Window.orderBy("name")) - 1).cast("string")))
    label = F.replace("name", F.lit('"'), F.lit("'")) if style == "mermaid" else F.replace(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    shown = F.concat("n", F.lit('["'), label, F.lit('"]')) if style == "mermaid" else F.concat("n", F.lit(' [label="'), label, F.lit('"];'))
    a, b = nodes.select(F.col("name").alias("src"), F.col("n").alias("a")), nodes.select(F.col("name").alias("dst"), F.col("n").alias("b"))
    arrow = (" --> ", "") if style == "mermaid" else (" -> ", ";")
    links = edges.join(a, "src").join(b, "dst").select(F.concat("a", F.lit(arrow[0]), "b", F.lit(arrow[1])).alias("line"))
    return nodes.select(shown.alias("line")).union(links)


def class_fixture(symbols: DataFrame) -> DataFrame:
    """Classes with a constructor of their own name, made from a seventh of the symbols."""
    some = symbols.where("p_partkey % 7 = 0 AND kind = 'function'").withColumn("name", F.concat(F.lit("C"), F.col("p_partkey").cast("string")))
    cls = some.withColumns({"qualname": F.col("name"), "kind": F.lit("class"), "id": F.concat("path", F.lit("::"), "name")})
    ctor = some.withColumns({"qualname": F.concat("name", F.lit("."), "name"), "kind": F.lit("method"), "id": F.concat("path", F.lit("::"), "name", F.lit("."), "name")})
    return cls.unionByName(ctor)
