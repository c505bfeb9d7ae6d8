"""Context packs: what an edit of a symbol needs to know, trimmed to a token budget, for any number of targets at once.

A pack is rows (target, section, position, lines); nothing is put together on the driver, and trimming is a running sum
over the rows of each target in the order in which they may go. Imports are a row a target until the text is written: a
file's many imports meet its many targets there, in one partition a file, and are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import relevance, signature
from codeloom.operators.graph import degrees, in_round, in_rounds, rounds
from codeloom.operators.graph import tidied as stored
from codeloom.schemas import MODULE

#: Sections in the order in which they are shown.
SECTIONS = ("head", "source", "imports", "symbols", "callers", "callees", "modules")
TITLES = {"source": "source:", "symbols": "symbols:", "callers": "callers:", "callees": "callees:"}
TRUNCATED, RESIDUAL = "  … (source truncated)", "module-level callers: "
#: The imports of a pack: their file, their names, the characters of all their lines and of the one that goes last, and
#: how many characters have to go (null: none).
BLOCK = "struct<file: string, names: array<string>, chars: bigint, least: bigint, over: bigint>"
#: Edges whose packs are made at a time.
EDGES = 500_000


def _signature() -> Column:
    return signature(*(F.col(c) for c in ("kind", "qualname", "params", "returns", "path")))


def _module_path(c: str) -> Column:
    return F.regexp_replace(c, f"{MODULE}$", "")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("via"), F.col("caller").alias("id"), F.lit(0).alias("d")).unionByName(edges.select(F.col("caller").alias("via"), F.col("callee").alias("id"), F.lit(1).alias("d")))


def direct(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``neighbours`` within one hop, dealt out by target once; ids of neither a symbol nor a module are not left out yet, as
    ``entries`` and ``pack_scores`` do that."""
    steps = _both(edges).where("via <> id").join(targets.select(F.col("id").alias("via")), "via", "left_semi")
    found = steps.groupBy("via", "id").agg(F.min("d").alias("d"))
    return stored(found.select(F.col("via").alias("target"), "id", "via", F.lit(1).alias("hop"), F.when(F.col("d") == 0, "caller").otherwise("callee").alias("direction")))


def neighbours(targets: DataFrame, edges: DataFrame, symbols: DataFrame, hops: int = 1) -> DataFrame:
    """(target, id, via, hop, direction) of all that calls or is called within ``hops`` of each target (id); found from
    several nodes at once, a neighbour belongs to the least, and is a caller before it is a callee. Module-level callers
    are listed but not gone beyond; ids of neither a symbol nor a module are left out."""
    both = _both(edges)
    steps = both.join(symbols.select("id"), "id", "left_semi").unionByName(both.where(F.endswith("id", F.lit(MODULE))))
    steps = stored(steps) if hops > 1 else steps
    frontier = targets.select(F.col("id").alias("target"), "id").distinct()
    seen, found = frontier, []
    for hop in range(1, hops + 1):
        reached = frontier.withColumnRenamed("id", "via").join(steps, "via").groupBy("target", "id").agg(F.min(F.struct("via", "d")).alias("w"))
        new = stored(reached.join(seen, ["target", "id"], "left_anti").select("target", "id", "w.via", F.lit(hop).alias("hop"), F.when(F.col("w.d") == 0, "caller").otherwise("callee").alias("direction")))
        found.append(new)
        frontier = new.where(~F.endswith("id", F.lit(MODULE))).select("target", "id")
        seen = seen.unionByName(new.select("target", "id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def listing(symbols: DataFrame, edges: DataFrame, task: tuple[str, ...] | None = None, calling: DataFrame | None = None) -> DataFrame:
    """(id, kind, path, line, signature, doc, degree): what is shown of each symbol as a neighbour; with a task raw, how much
    of it the symbol means. ``calling``: as for ``degrees``."""
    raw = {} if task is None else {"raw": relevance(F.concat_ws(" ", "qualname", _signature()), F.col("path"), task)}
    return degrees(symbols, edges, calling).withColumns(raw).select("id", "kind", "path", F.col("start_line").alias("line"), _signature().alias("signature"), "doc", "degree", *raw)


def entries(near: DataFrame, edges: DataFrame, symbols: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``near`` with what is shown of each neighbour (``listed``: the listing of symbols, if known). A module-level caller
    becomes one entry for each line that it calls from, so that none is a path without a place."""
    named = near.join(listing(symbols, edges) if listed is None else listed.drop("raw"), "id")
    sites = edges.where(F.endswith("caller", F.lit(MODULE))).select(F.col("caller").alias("id"), F.col("callee").alias("via"), F.explode("lines").alias("line"))
    module_degree = edges.where(F.endswith("caller", F.lit(MODULE))).groupBy(F.col("caller").alias("id")).agg(F.count_distinct("callee").alias("degree"))
    promoted = near.join(sites, ["id", "via"]).join(module_degree, "id").withColumns({"kind": F.lit("module"), "path": _module_path("id"), "doc": F.lit(None).cast("string")})
    promoted = promoted.withColumn("signature", F.concat(F.lit("<anonymous> ("), "path", F.lit(")")))
    return named.unionByName(promoted.select(named.columns))


def call_sites(near: DataFrame, edges: DataFrame, lines: DataFrame, k: int = 3) -> DataFrame:
    """(target, id, line, text) of the first ``k`` calls of each direct caller to its target, from ``lines`` (path, line,
    text); lines that aren't there are left out."""
    direct = near.where("hop = 1 AND direction = 'caller'").select("target", "id")
    called = edges.select(F.col("caller").alias("id"), F.col("callee").alias("target"), F.slice("lines", 1, k).alias("lines"))
    path = F.when(F.endswith("id", F.lit(MODULE)), _module_path("id")).otherwise(F.regexp_extract("id", r"^(.*?)::", 1))
    wanted = direct.join(called, ["target", "id"]).select("target", "id", path.alias("path"), F.explode("lines").alias("line"))
    return wanted.join(lines.hint("merge"), ["path", "line"]).select("target", "id", "line", F.trim("text").alias("text"))


def by_file(imports: DataFrame) -> DataFrame:
    """(file, library, total): the imports of each file, (position, line) by name, and how many they are."""
    if "library" in imports.columns:
        return imports
    line = F.concat(F.lit("  "), "name", F.lit("  (from "), F.coalesce("source", F.lit("")), F.lit(")"))
    named = imports.groupBy("path", "name").agg(F.count("*").alias("n"), F.collect_list(F.struct(F.col("ordinal").alias("position"), line.alias("line"))).alias("entries"))
    pair = F.when(F.col("name").isNotNull(), F.struct("name", "entries"))
    return named.groupBy(F.col("path").alias("file")).agg(F.map_from_entries(F.collect_list(pair)).alias("library"), F.sum("n").alias("total"))


def _leaving(names: Column, library: Column) -> Column:
    """The lines of imports in the order in which they leave: the last first, then by name."""
    return F.array_sort(F.flatten(F.transform(names, lambda n: F.transform(library[n], lambda e: F.struct((-e["position"]).alias("p"), n.alias("name"), e["line"].alias("line"))))))


def relevant_imports(heads: DataFrame, shown: DataFrame, imports: DataFrame) -> DataFrame:
    """(target, file, names, chars, least, more) of targets whose file imports something: the imported names that are whole
    words of what the pack shows anyway, the characters of their lines and of the one that leaves last, and how many
    imports are not among them. heads and shown: (target, path, lines) and (target, lines)."""
    files = by_file(imports)
    known = stored(files.select(F.explode(F.map_keys("library")).alias("name")).distinct())
    words = F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "lines"), F.lit(r"\w+"), F.lit(0)))
    said = heads.select("target", F.filter("lines", lambda x: ~F.startswith(x, F.lit("context: "))).alias("lines")).unionByName(shown.select("target", "lines"))
    found = said.select("target", F.explode(words).alias("name")).join(known, "name", "left_semi")
    asked = found.repartition("target").distinct().groupBy("target").agg(F.collect_list("name").alias("names"))
    # of each name: how many imports, their characters, and the one that leaves last
    brief = F.transform_values("library", lambda _, e: F.struct(F.size(e).alias("n"), F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]) + 1).alias("chars"), F.array_max(F.transform(e, lambda x: F.struct((-x["position"]).alias("p"), x["line"].alias("line")))).alias("last")))
    own = heads.select("target", F.col("path").alias("file")).join(asked, "target", "left").join(files.select("file", "total", brief.alias("brief")), "file")
    hits = F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.col("brief")[n].alias("b"))), lambda x: x["b"].isNotNull())
    last = F.array_max(F.transform("hits", lambda x: F.struct(x["b"]["last"]["p"].alias("p"), x["name"].alias("name"), x["b"]["last"]["line"].alias("line"))))
    zero = F.lit(0).cast("long")
    sums = own.select("target", "file", "total", hits.alias("hits"))
    return sums.select(
        "target", "file", F.transform("hits", lambda x: x["name"]).alias("names"),
        F.aggregate("hits", zero, lambda a, x: a + x["b"]["chars"]).alias("chars"),
        (F.length(last["line"]) + 1).cast("long").alias("least"),
        (F.col("total") - F.aggregate("hits", zero, lambda a, x: a + x["b"]["n"])).alias("more"),
    )


def packs(targets: DataFrame, symbols: DataFrame, edges: DataFrame, imports: DataFrame, notes: DataFrame | None = None, lines: DataFrame | None = None, hops: int = 1, scores: DataFrame | None = None, near: DataFrame | None = None, listed: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Packs of all ``targets`` (id): target, section, position, lines (array), path (of module-level callers), leaves, block
    (of the row that stands for all imports; ``rendered`` writes their lines). ``imports``: as they are, or ``by_file``.
    If known: ``near``, their neighbours, ``listed``, the listing of all symbols, and ``calls``, the edges to targets; with
    near and listed, ``symbols`` need be no more than the targets.

    leaves is the order in which rows may be left out, null for those that always stay: imports from the last, then
    neighbours by their score (``scores``: target, id, score; the lowest first), distance (the farthest first) and degree
    (the lowest first), then source from the bottom. ``lines`` (path, line, text) adds the target's body and call sites.
    """
    own = symbols.join(targets.select("id").distinct(), "id", "left_semi").withColumn("target", F.col("id"))
    at = F.concat(F.lit("  "), "kind", F.lit(" ("), "language", F.lit(") at "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    said = own.select("target", "path", F.array(F.concat(F.lit("context: "), "path", F.lit(":"), "qualname"), _signature(), at).alias("a"), "doc")
    head = said.select("target", "path", F.when(F.coalesce("doc", F.lit("")) == "", F.col("a")).otherwise(F.concat("a", F.array(F.concat(F.lit("  doc: "), "doc")))).alias("lines"))
    if notes is not None:
        n = notes.groupBy(F.col("symbol_id").alias("target")).agg(F.array_sort(F.collect_list(F.concat(F.lit("  note: "), "text"))).alias("n"))
        head = head.join(n, "target", "left").select("target", "path", F.when(F.col("n").isNull(), F.col("lines")).otherwise(F.concat("lines", "n")).alias("lines"))
    head = stored(head)
    near = neighbours(targets, edges, symbols, hops) if near is None else near
    shown = entries(near, edges, symbols, listed)
    first = F.concat(F.lit("  ["), F.col("hop").cast("string"), F.lit("] "), "path", F.lit(":"), F.col("line").cast("string"), F.lit("  "), "signature")
    body = F.when(F.coalesce("doc", F.lit("")) == "", F.array(first)).otherwise(F.array(first, F.concat(F.lit("      doc: "), "doc")))
    shown = shown.withColumn("lines", body)
    if lines is not None:
        sites = call_sites(near, edges if calls is None else calls, lines).groupBy("target", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: F.concat(F.lit("      > "), s["line"].cast("string"), F.lit(": "), s["text"])).alias("sites"))
        shown = shown.join(sites, ["target", "id"], "left").withColumn("lines", F.when(F.col("sites").isNull(), F.col("lines")).otherwise(F.concat("lines", "sites"))).drop("sites")
    if scores is not None:
        shown = shown.join(scores.select("target", "id", "score"), ["target", "id"], "left")
    shown = stored(shown.withColumn("score", F.coalesce("score", F.lit(0.0)) if scores is not None else F.lit(0.0)))

    found = stored(relevant_imports(head, shown, imports))
    title = found.select("target", F.lit("imports").alias("section"), F.lit(0).alias("position"), F.array(F.concat(F.lit("imports ("), "file", F.lit("):"))).alias("lines"), (F.col("more") == 0).alias("title"))
    more = found.where("more > 0").select("target", F.lit("imports").alias("section"), F.lit(1 << 30).alias("position"), F.array(F.concat(F.lit("  +"), F.col("more").cast("string"), F.lit(" more imports (irrelevant to this pack)"))).alias("lines"))
    empty = {"path": "string", "block": BLOCK, "stage": "int", "hop": "int", "at": "string", "line": "int", "id": "string", "degree": "long", "score": "double"}
    none = {"title": F.lit(False)} | {c: F.lit(None).cast(kind) for c, kind in empty.items()}

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.withColumns({c: given.get(c, v) for c, v in none.items() if c in given or c not in df.columns}).select("target", "section", "position", "lines", *none)

    parts = [rows(head.select("target", F.lit("head").alias("section"), F.lit(0).alias("position"), "lines")), rows(title), rows(more)]
    block = F.struct("file", "names", "chars", "least", F.lit(None).cast("long").alias("over")).cast(BLOCK)
    named = found.where("size(names) > 0").select("target", F.lit("imports").alias("section"), F.lit(1).alias("position"), F.array().cast("array<string>").alias("lines"), block.alias("block"))
    parts.append(rows(named, stage=F.lit(0)))
    section = F.when(F.col("direction") == "caller", "callers").otherwise("callees")
    beside = shown.select("target", section.alias("section"), F.lit(0).alias("position"), "lines", F.when(F.col("kind") == "module", F.col("path")).alias("path"), "hop", F.col("path").alias("at"), "line", "id", "degree", "score")
    parts.append(rows(beside, stage=F.lit(1)))
    if lines is not None:
        long = lines.groupBy("path").agg(F.max("line").alias("n"))  # no span goes beyond its file
        spans = own.select("target", "path", "start_line", "end_line").join(long, "path").withColumn("end", F.least("end_line", "n")).where("start_line <= end")
        at = spans.select("target", "path", F.explode(F.sequence(F.col("start_line"), F.col("end"))).alias("line"))
        span = at.join(lines.hint("merge"), ["path", "line"]).select("target", F.lit("source").alias("section"), F.col("line").alias("position"), F.array(F.concat(F.lit("  "), "text")).alias("lines"))
        parts.append(rows(span, stage=F.lit(2)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # rows are dealt out by target once: their keys, places and titles are made where they meet
    direction = F.when(F.col("section") == "callers", "caller").otherwise("callee")
    text = F.when(F.col("stage") == 1, F.concat_ws("|", direction, "id", F.lpad(F.col("line").cast("string"), 9, "0")))
    out = out.repartition("target").withColumns({"first": F.when(F.col("stage") == 2, -F.col("position")).otherwise(F.col("score")), "far": -F.col("hop"), "text": text})
    leaving = Window.partitionBy("target").orderBy(F.col("stage").asc_nulls_last(), "first", "far", "degree", "text")
    order = Window.partitionBy("target", "section").orderBy("hop", "at", "line", "id")
    out = out.withColumn("leaves", F.when(F.col("stage").isNotNull(), F.row_number().over(leaving))).withColumn("nth", F.row_number().over(order))
    titles = F.create_map(*(F.lit(x) for s in ("source", "callers", "callees") for x in (s, TITLES[s])))
    heads = (F.col("nth") == 1) & F.col("section").isin("source", "callers", "callees")
    out = out.withColumn("added", F.explode(F.when(heads, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    position = F.when(F.col("added"), 0).when(F.col("stage") == 1, F.col("nth")).otherwise(F.col("position"))
    lines = F.when(F.col("added"), F.array(titles[F.col("section")])).otherwise(F.col("lines"))
    return out.select("target", "section", position.alias("position"), lines.alias("lines"), F.when(~F.col("added"), F.col("path")).alias("path"), (F.col("title") | F.col("added")).alias("title"), F.when(~F.col("added"), F.col("block")).alias("block"), F.when(~F.col("added"), F.col("leaves")).alias("leaves"))


def by_rounds(targets: DataFrame, symbols: DataFrame, edges: DataFrame, imports: DataFrame, finish: Callable[[DataFrame, DataFrame], DataFrame], notes: DataFrame | None = None, lines: DataFrame | None = None, task: tuple[str, ...] | None = None) -> DataFrame:
    """``finish(rows, imports)`` of the packs of all ``targets`` with direct neighbours, some targets after others. A target's pack depends on no
    other target, so the rounds are the whole; each shuffles only what its own targets need, and what all rounds read is
    derived once. Symbols and edges are read again in each round: stored tables. ``task`` scores the neighbours."""
    n = rounds(edges, EDGES)
    files = stored(by_file(imports))
    listed = in_rounds(n, lambda k: listing(symbols.where(in_round("id", k, n)), edges.where(in_round("callee", k, n)), task, edges.where(in_round("caller", k, n))))

    def some(k: int) -> DataFrame:
        mine = targets.where(in_round("id", k, n))
        calls = edges.where(in_round("callee", k, n))
        near = direct(mine, calls.unionByName(edges.where(in_round("caller", k, n) & ~in_round("callee", k, n))))
        scores = None if task is None else pack_scores(near, symbols, edges, task, listed=listed)
        return finish(packs(mine, symbols.where(in_round("id", k, n)), edges, files, near=near, listed=listed, calls=calls, notes=notes, lines=lines, scores=scores), files)

    return in_rounds(n, some) if n > 1 else some(0)


def trimmed(rows: DataFrame, budget: int | None) -> DataFrame:
    """The rows of ``packs`` that stay within ``budget`` tokens a target, with the lines that trimming itself adds.

    A title goes with the last row of its section; the first line of source that goes leaves a line that says so, which
    goes with the last; the path of a module-level caller is named at the end once all its entries are gone. Imports go
    first, the last of them first: their row says how many characters of them have to go, if some may stay.
    """
    if "block" not in rows.columns:
        rows = rows.withColumn("block", F.lit(None).cast(BLOCK))
    if budget is None:
        return rows.drop("leaves", "title")
    leaves = F.col("leaves").isNotNull()
    chars = F.coalesce("block.chars", F.aggregate(F.transform("lines", lambda x: F.length(x) + 1), F.lit(0), lambda a, n: a + n))
    priced = rows.withColumn("chars", chars)
    group = Window.partitionBy("target", "section")
    last = leaves & (F.col("leaves") == F.max("leaves").over(group))
    titles = F.coalesce(F.sum(F.when(F.col("title"), F.col("chars"))).over(group), F.lit(0))
    first_source = (F.col("section") == "source") & (F.col("leaves") == F.min("leaves").over(group))
    note = len(TRUNCATED) + 1
    saved = F.col("chars") + F.when(last, titles).otherwise(0) - F.when(first_source, note).otherwise(0) + F.when(last & (F.col("section") == "source"), note).otherwise(0)
    closes = leaves & F.col("path").isNotNull() & (F.col("leaves") == F.max("leaves").over(Window.partitionBy("target", "path")))
    priced = priced.withColumns({"saved": saved, "last": F.coalesce(last, F.lit(False)), "closes": F.coalesce(closes, F.lit(False)), "all": F.sum("chars").over(Window.partitionBy("target"))})
    opens = F.col("closes") & (F.col("leaves") == F.min(F.when(F.col("closes"), F.col("leaves"))).over(Window.partitionBy("target")))
    priced = priced.withColumn("saved", F.when(leaves, F.col("saved") - F.when(F.col("closes"), F.length("path") + 2).otherwise(0) - F.when(opens, len(RESIDUAL) - 1).otherwise(0)).otherwise(0))
    before = Window.partitionBy("target").orderBy("leaves").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("target").orderBy("leaves").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.floor((F.col("all") - 1 - F.coalesce(F.sum("saved").over(before), F.lit(0))) / 4) <= budget
    judged = priced.withColumn("fits", F.when(leaves, fits)).withColumn("stays", F.max("fits").over(to_here))
    # an import stays if those that go before it have the characters that are over
    over = F.when(~F.col("stays"), F.col("all") - 4 * (budget + 1))
    judged = judged.withColumn("block", F.when(F.col("block").isNotNull(), F.col("block").withField("over", over)))
    judged = judged.withColumn("stays", F.col("stays") | F.coalesce(F.col("block.chars") - F.col("block.least") >= F.col("block.over"), F.lit(False)))
    titles_go = F.coalesce(F.max(F.when(F.col("last"), ~F.col("stays"))).over(group), F.lit(False))
    keep = F.when(leaves, F.col("stays")).otherwise(~(F.col("title") & titles_go))
    judged = judged.withColumn("keep", keep).where("keep OR closes OR section = 'source'")
    judged = stored(judged.select("target", "section", "position", F.when(F.col("keep"), F.col("lines")).alias("lines"), "path", "block", leaves.alias("leaves"), "keep", "last", "closes"))
    gone = judged.where("leaves AND NOT keep")
    cut = gone.where("section = 'source'").groupBy("target").agg(F.max("last").alias("whole")).where("NOT whole")
    cut = cut.select("target", F.lit("source").alias("section"), F.lit(1 << 30).alias("position"), F.array(F.lit(TRUNCATED)).alias("lines"))
    residual = gone.where("closes").groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("p"))
    residual = residual.select("target", F.lit("modules").alias("section"), F.lit(0).alias("position"), F.array(F.concat(F.lit(RESIDUAL), "p")).alias("lines"))
    out = judged.where("keep").select("target", "section", "position", "lines", "block")
    for part in (cut, residual):
        out = out.unionByName(part.withColumn("block", F.lit(None).cast(BLOCK)))
    return out


def rendered(rows: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(target, text, tokens) of trimmed packs; ``imports`` as given to ``packs``."""
    place = F.create_map(*(x for i, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(i))))
    plain = F.when(F.col("block").isNull(), F.struct(place[F.col("section")].alias("s"), "position", "lines"))
    each = rows.groupBy("target").agg(F.array_sort(F.collect_list(plain)).alias("r"), F.max("block").alias("block"))
    if imports is not None:
        each = each.withColumn("at", F.coalesce("block.file", "target")).join(by_file(imports).select(F.col("file").alias("at"), "library"), "at", "left")
        each = each.withColumn("e", _leaving(F.col("block.names"), F.col("library")))
        over, start = F.col("block.over"), F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).alias("n"))
        gone = F.aggregate("e", start, lambda a, e: F.struct((a["before"] + F.length(e["line"]) + 1).alias("before"), (a["n"] + F.when(a["before"] < over, 1).otherwise(0)).alias("n")), lambda a: a["n"])
        each = each.withColumn("e", F.when(over.isNull(), F.col("e")).otherwise(F.slice("e", gone + 1, F.greatest(F.size("e"), F.lit(0)))))
        named = F.transform("e", lambda e: F.struct(F.lit(SECTIONS.index("imports")).alias("s"), (-e["p"]).alias("position"), F.array(e["line"]).alias("lines")))
        each = each.withColumn("r", F.when(F.col("block").isNull(), F.col("r")).otherwise(F.array_sort(F.concat("r", named))))
    text = F.array_join(F.flatten(F.transform("r", lambda x: x["lines"])), "\n")
    return each.select("target", text.alias("text")).withColumn("tokens", F.floor(F.length("text") / 4))


def pack_scores(near: DataFrame, symbols: DataFrame, edges: DataFrame, task: tuple[str, ...], weight: float = 0.5, listed: DataFrame | None = None) -> DataFrame:
    """(target, id, score): neighbours of each target by what the task says and by degree, each scaled within the pack.
    ``listed``: the listing of symbols by the task, if known."""
    rated = (listing(symbols, edges, task) if listed is None else listed).select("id", "raw", "degree")
    w = Window.partitionBy("target")
    found = near.select("target", "id").join(rated, "id").withColumns({"top": F.max("raw").over(w), "lo": F.min("degree").over(w), "hi": F.max("degree").over(w)})
    lexical = F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0)
    central = F.when(F.col("hi") > F.col("lo"), (F.col("degree") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return found.select("target", "id", (weight * lexical + (1 - weight) * central).alias("score"))


def file_pack(path: str, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of a file's pack: its symbols (the first always stays, the others may leave from the last), and callers from
    outside."""
    own = symbols.where(F.col("path") == path)
    line = F.concat(F.lit("  "), F.col("start_line").cast("string"), F.lit("  "), _signature())
    order = Window.partitionBy("path").orderBy("start_line", "qualname", "id")
    listed = stored(own.select(F.lit(path).alias("target"), F.lit("symbols").alias("section"), F.row_number().over(order).alias("position"), F.array(line).alias("lines"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("title")))
    near = edges.join(own.select(F.col("id").alias("callee")), "callee", "left_semi").where((F.regexp_extract("caller", r"^(.*?)::", 1) != path) | (F.endswith("caller", F.lit(MODULE)) & (_module_path("caller") != path)))
    first = near.groupBy(F.col("caller").alias("id")).agg(F.min("callee").alias("via")).select(F.lit(path).alias("target"), "id", "via", F.lit(1).alias("hop"), F.lit("caller").alias("direction"))
    shown = entries(first, edges, symbols)
    row = F.concat(F.lit("  [1] "), "path", F.lit(":"), F.col("line").cast("string"), F.lit("  "), "signature")
    by = Window.partitionBy("target").orderBy("path", "line", "id")
    callers = stored(shown.select("target", F.lit("callers").alias("section"), F.row_number().over(by).alias("position"), F.array(row).alias("lines"), F.when(F.col("kind") == "module", F.col("path")).alias("path"), F.lit(False).alias("title"), F.row_number().over(Window.partitionBy("target").orderBy("degree", "id", "line")).alias("leaves")))
    n = callers.groupBy("target").agg(F.max("leaves").alias("n"))
    last = listed.join(n, "target", "left").withColumn("leaves", F.when(F.col("position") > 1, F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("target").orderBy(F.desc("position"))))).drop("n")

    def titled(section: str, title: bool) -> DataFrame:
        some = (callers if section == "callers" else listed).select("target").distinct()
        return some.select("target", F.lit(section).alias("section"), F.lit(0).alias("position"), F.array(F.lit(TITLES[section])).alias("lines"), F.lit(None).cast("string").alias("path"), F.lit(title).alias("title"), F.lit(None).cast("int").alias("leaves"))

    return callers.unionByName(last).unionByName(titled("callers", True)).unionByName(titled("symbols", False))

