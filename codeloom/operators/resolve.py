"""Name resolution: raw calls and references to edges, by an ordered ladder of lookups.

Candidates of a common name are never exploded per call: each rung looks up a count and a least id that were
aggregated by its own key beforehand, so a call stays one row through all rungs, however many owners its name has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import SELF_NAMES, TYPE_NOISE, import_segments, path_parts, stem_of
from codeloom.operators.graph import stored
from codeloom.schemas import MODULE, TYPE_KINDS


def first_imports(imports: DataFrame) -> DataFrame:
    """Of the imports that bind a name in a file, the first."""
    return imports.groupBy("path", "name").agg(F.min_by("source", "ordinal").alias("source"))


def constructors(symbols: DataFrame) -> DataFrame:
    """(cls, ctor) of types with a constructor method of their own: "constructor", "__init__" or the type's name, in this order."""
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("cls"), "path", F.col("name").alias("own"), F.col("qualname").alias("q"))
    names = F.array(F.struct(F.lit(0).alias("rank"), F.lit("constructor").alias("n")), F.struct(F.lit(1).alias("rank"), F.lit("__init__").alias("n")), F.struct(F.lit(2).alias("rank"), F.col("own").alias("n")))
    wanted = types.select("cls", "path", "q", F.explode(names).alias("w")).select("cls", "path", "w.rank", F.col("w.n").alias("name"), F.concat_ws(".", "q", "w.n").alias("qualname"))
    methods = symbols.where("kind = 'method'").select("path", "name", "qualname", F.col("id").alias("ctor"), "start_line")
    return wanted.join(methods, ["path", "name", "qualname"]).groupBy("cls").agg(F.min_by("ctor", F.struct("rank", "start_line", "ctor")).alias("ctor"))


def _counted(symbols: DataFrame, keys: list[str], n: str, one: str) -> DataFrame:
    return symbols.groupBy(*keys).agg(F.count("*").alias(n), F.min("id").alias(one))


def _by_stem(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("stem", stem_of(F.col("path"))).groupBy("name", "stem").agg(F.count("*").alias("n"), F.min("id").alias("one"))


def hinted(asked: DataFrame, symbols: DataFrame, source: str, name: str) -> DataFrame:
    """For distinct (name, source): how many symbols of the name lie in a file that the source names, and the least."""
    pairs = asked.select(F.col(name).alias("name"), F.col(source).alias("source")).dropna().distinct()
    each = pairs.withColumn("stem", F.explode(import_segments(F.col("source"))))
    return each.join(_by_stem(symbols), ["name", "stem"]).groupBy("name", "source").agg(F.sum("n").alias("n"), F.min("one").alias("one"))


def rungs(raw: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Every raw call with what each rung finds: external_receiver, n_candidates, container, typed, same_file, hint, only,
    pair, alias_n, alias. A rung's column is an id, or null where it doesn't decide."""
    first = first_imports(imports)
    if "call" not in raw.columns:  # a call is known by what it says, so that a task run again names it alike
        raw = raw.withColumn("call", F.xxhash64("caller_id", "path", "text", "name", "receiver", "line"))
    calls = raw
    calls = calls.withColumn("caller", F.coalesce("caller_id", F.concat("path", F.lit(MODULE))))
    calls = calls.withColumn("head", F.when(F.col("receiver") != "", path_parts(F.col("receiver"))[0]))
    owner = symbols.select(F.col("id").alias("caller_id"), F.col("qualname").alias("caller_qualname"), F.col("params").alias("caller_params"))
    calls = calls.join(owner, "caller_id", "left")

    # imports of the receiver's head and of the name itself
    by_head = first.select("path", F.col("name").alias("head"), F.col("source").alias("head_source"))
    by_own = first.select("path", "name", F.col("source").alias("own_source"))
    calls = calls.join(by_head, ["path", "head"], "left").join(by_own, ["path", "name"], "left")
    stems = files.select(stem_of(F.col("path")).alias("stem")).distinct()
    known = first.select(F.col("source").alias("head_source")).distinct().withColumn("stem", F.explode(import_segments(F.col("head_source")))).join(stems, "stem", "left_semi").select("head_source").distinct().withColumn("in_repo", F.lit(True))
    calls = calls.join(known, "head_source", "left").withColumn("external_receiver", F.col("head_source").isNotNull() & F.col("in_repo").isNull())

    # candidates by name, by name and file, by name and qualified name
    of_name = symbols.groupBy("name").agg(F.count("*").alias("n_candidates"), F.min("id").alias("only_id"), F.max("id").alias("other_id"))
    calls = calls.join(of_name.select("name", "n_candidates", "only_id"), "name", "left").join(_pairs(of_name, constructors(symbols)), "name", "left")
    calls = calls.join(_counted(symbols, ["name", "path"], "n_same", "same_id"), ["name", "path"], "left")
    container = F.when(F.col("head").isin(*SELF_NAMES) & F.col("caller_qualname").contains("."), F.concat_ws(".", F.regexp_replace("caller_qualname", r"\.[^.]*$", ""), "name"))
    in_file = _counted(symbols, ["path", "name", "qualname"], "n_container", "container_id").withColumnRenamed("qualname", "container_qualname")
    calls = calls.withColumn("container_qualname", container).join(in_file, ["path", "name", "container_qualname"], "left")

    # what the name's own import may stand for, if nothing is called so
    calls = calls.withColumn("original", F.when(F.col("n_candidates").isNull(), F.element_at(path_parts(F.col("own_source")), -1)))
    calls = stored(calls)  # the rungs below read it several times: its joins are made once

    # the type of the caller's parameter that the receiver names: its tokens in order
    kind = F.get(F.filter("caller_params", lambda p: (p["name"] == F.col("head")) & (p["type"] != "")), F.lit(0))["type"]
    asked = calls
    types = asked.select("call", "name", F.posexplode(F.regexp_extract_all(kind, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("at", "token")).where(~F.col("token").isin(*TYPE_NOISE))
    by_qualname = _counted(symbols, ["name", "qualname"], "n", "one").where("n = 1")
    typed = types.withColumn("qualname", F.concat_ws(".", "token", "name")).join(by_qualname, ["name", "qualname"]).groupBy("call").agg(F.min_by("one", "at").alias("typed"))
    calls = calls.join(typed, "call", "left")

    # import hints: the name's own import, then the receiver's
    own, head = (hinted(asked, symbols, s, "name").where("n = 1").select("name", F.col("source").alias(s), F.col("one").alias(f"{s}_id")) for s in ("own_source", "head_source"))
    calls = calls.join(own, ["name", "own_source"], "left").join(head, ["name", "head_source"], "left")

    # an import under another name: the name in its source
    alias = hinted(asked, symbols, "own_source", "original").select(F.col("name").alias("original"), F.col("source").alias("own_source"), F.col("n").alias("alias_n"), F.col("one").alias("alias"))
    calls = calls.join(alias, ["original", "own_source"], "left")
    return calls.select(
        "call", "caller", "caller_id", "path", "name", "text", "receiver", "line", "own_source", "original", "external_receiver",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.when(F.col("n_container") == 1, F.col("container_id")).alias("container"), "typed",
        F.when(F.col("n_same") == 1, F.col("same_id")).alias("same_file"),
        F.coalesce("own_source_id", "head_source_id").alias("hint"),
        F.when(F.col("n_candidates") == 1, F.col("only_id")).alias("only"), "pair",
        F.coalesce("alias_n", F.lit(0)).alias("alias_n"), "alias",
    )


def _pairs(of_name: DataFrame, ctor: DataFrame) -> DataFrame:
    """Names with two owners, a type and its constructor: the type."""
    two = of_name.where("n_candidates = 2")
    sides = two.select("name", F.col("only_id").alias("cls"), F.col("other_id").alias("ctor")).unionByName(two.select("name", F.col("other_id").alias("cls"), F.col("only_id").alias("ctor")))
    return sides.join(ctor, ["cls", "ctor"]).select("name", F.col("cls").alias("pair"))


def decide(found: DataFrame, references: bool = False) -> DataFrame:
    """The verdict of the ladder: outcome (edge, ambiguous, external or dropped) and callee.

    A call on an external receiver is external before anything else; references know no such test, and drop what
    isn't one edge.
    """
    target = F.coalesce("container", "typed", "same_file", "hint", "only", "pair")
    outcome = (
        F.when(F.lit(not references) & F.col("external_receiver"), "external")
        .when((F.col("n_candidates") == 0) & (F.col("alias_n") == 1), "edge")
        .when((F.col("n_candidates") == 0) & (F.col("alias_n") > 1), "ambiguous")
        .when(F.col("n_candidates") == 0, "external")
        .when(target.isNotNull(), "edge")
        .otherwise("ambiguous")
    )
    out = found.withColumn("outcome", F.when(F.lit(references) & (outcome != "edge"), "dropped").otherwise(outcome))
    return out.withColumn("callee", F.when(F.col("outcome") == "edge", F.when(F.col("n_candidates") == 0, F.col("alias")).otherwise(target)))


def edges_of(decided: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(caller, callee, lines): distinct sorted lines of each edge, without edges to oneself. With ``symbols``, an
    edge to a type also gives one to its constructor."""
    edges = decided.where("outcome = 'edge'").select("caller", "callee", "line")
    if symbols is not None:
        edges = edges.unionByName(edges.join(constructors(symbols), F.col("callee") == F.col("cls")).select("caller", F.col("ctor").alias("callee"), "line"))
    return dedupe(edges)


def dedupe(edges: DataFrame) -> DataFrame:
    return edges.where("caller <> callee").groupBy("caller", "callee").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def external_of(decided: DataFrame) -> DataFrame:
    """(caller, callee text, lines) of external calls."""
    return decided.where("outcome = 'external'").groupBy("caller", F.col("text").alias("callee")).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _asked(decided: DataFrame) -> DataFrame:
    return decided.where("outcome = 'ambiguous'").groupBy("caller", "name").agg(F.min(F.struct("n_candidates", "original", "own_source")).alias("a"))


def ambiguous_rows(decided: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, name, candidate, test): one row for each owner of the name, or of what an alias stands for."""
    asked, own = _asked(decided), symbols.select("name", F.col("id").alias("candidate"), "test", "path")
    direct = asked.where("a.n_candidates > 0").join(own, "name").select("caller", "name", "candidate", "test")
    aliased = asked.where("a.n_candidates = 0").select("caller", "name", F.col("a.original").alias("original"), F.explode(import_segments(F.col("a.own_source"))).alias("stem"))
    by_stem = own.select(F.col("name").alias("original"), stem_of(F.col("path")).alias("stem"), "candidate", "test")
    return direct.unionByName(aliased.join(by_stem, ["original", "stem"]).select("caller", "name", "candidate", "test"))


def ambiguous_of(decided: DataFrame, symbols: DataFrame, sep: str | None = None) -> DataFrame:
    """(caller, name, candidates) as a map holds them: production code first, then by id. With ``sep``, candidates are a text
    and n counts them.

    The owners of a name (or of what an alias in one source stands for) are listed once and meet their askers last, so that
    no list is shuffled for each asker."""
    asked, own = _asked(decided), symbols.select("name", F.col("id").alias("candidate"), "test", "path")
    found = F.sort_array(F.collect_list(F.struct("test", "candidate")))
    ids = F.transform("c", lambda o: o["candidate"])
    shown = (ids if sep is None else F.array_join(ids, sep)).alias("candidates")

    def listed(owners: DataFrame, *by: str) -> DataFrame:
        return owners.groupBy(*by).agg(found.alias("c")).select(*by, F.size("c").alias("n"), shown)

    direct = asked.where("a.n_candidates > 0").select("caller", "name")
    aliased = asked.where("a.n_candidates = 0").select("caller", "name", F.col("a.original").alias("original"), F.col("a.own_source").alias("own_source"))
    by_stem = own.select(F.col("name").alias("original"), stem_of(F.col("path")).alias("stem"), "candidate", "test")
    meant = aliased.select("original", "own_source").distinct().withColumn("stem", F.explode(import_segments(F.col("own_source")))).join(by_stem, ["original", "stem"])
    columns = ["caller", "name", "candidates", *(["n"] if sep is not None else [])]
    plain = direct.join(listed(own.join(direct.select("name").distinct(), "name", "left_semi"), "name").hint("merge"), "name")
    return plain.select(*columns).unionByName(aliased.join(listed(meant, "original", "own_source").hint("merge"), ["original", "own_source"]).select(*columns))


def invert_ambiguous(ambiguous: DataFrame) -> DataFrame:
    """(candidate, caller, name): who may mean each symbol."""
    return ambiguous.select(F.explode("candidates").alias("candidate"), "caller", "name")


def ambiguous_in(decided: DataFrame, symbols: DataFrame) -> DataFrame:
    """(candidate, n): how many (caller, name) may mean each symbol. Askers are counted by name before owners meet them, so
    a common name is one row, however many callers and owners it has."""
    asked = _asked(decided)
    direct = asked.where("a.n_candidates > 0").groupBy("name").agg(F.count("*").alias("n")).join(symbols.select("name", F.col("id").alias("candidate")), "name")
    stems = asked.where("a.n_candidates = 0").select(F.col("a.original").alias("name"), F.explode(import_segments(F.col("a.own_source"))).alias("stem")).groupBy("name", "stem").agg(F.count("*").alias("n"))
    aliased = stems.join(symbols.select("name", stem_of(F.col("path")).alias("stem"), F.col("id").alias("candidate")), ["name", "stem"])
    return direct.select("candidate", "n").unionByName(aliased.select("candidate", "n")).groupBy("candidate").agg(F.sum("n").alias("n"))


def call_graph(raw_calls: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame, raw_refs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables edges, ambiguous, external and referenced."""
    decided = decide(rungs(raw_calls, symbols, imports, files))
    out = {"edges": edges_of(decided, symbols), "ambiguous": ambiguous_of(decided, symbols), "external": external_of(decided)}
    if raw_refs is not None:
        refs = decide(rungs(raw_refs.withColumn("text", F.col("name")), symbols, imports, files), references=True)
        out["referenced"] = edges_of(refs)
    return out


def nth_ids(symbols: DataFrame) -> DataFrame:
    """Ids path::qualname, with #n from the second of a file's equal qualified names, in match order."""
    nth = F.row_number().over(Window.partitionBy("path", "qualname").orderBy("ordinal"))
    return symbols.withColumn("id", F.concat("path", F.lit("::"), "qualname", F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise("")))
