"""Every operator as a query over the fixture tables. The SQL that each is held against is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import budget, change, graph, lean, lookup, packs, rank, resolve, rollups, session
from codeloom.sources.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: A symbol that exists at every size, and two that calls connect.
TASK = ("red", "widget", "gear", "bol")


def query(f: Callable[[Fixtures], DataFrame]) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
    return f


def fine(f: Callable[[Fixtures], DataFrame]) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir, fine=True))
    return f


def joined(c: str, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep).alias(c)


def edges_of(x: Fixtures) -> DataFrame:
    return resolve.dedupe(x.raw_edges())


def id_of(x: Fixtures, partkey: int) -> str:
    return x.symbols().where(F.col("p_partkey") == partkey).first()["id"]


# scans and predicates


@query
def symbols_scan(x):
    return x.symbols().select("id", "name", "qualname", "kind", "path", "start_line", "end_line", "decorated", "exported", "test")


@query
def files_scan(x):
    return x.files().select("path", "language", "doc", "size", "content_hash")


def _verdicts(x: Fixtures) -> DataFrame:
    """Some files are in a language that is known but not read."""
    files = x.files().withColumn("path", F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("path", r"\.txt$", ".astro")).otherwise(F.col("path")))
    return lookup.verdicts(files, excludes=("*5.txt",), max_file_size=4000, languages={"txt": "text"}, subpath="")


@query
def skipped_verdicts(x):
    return _verdicts(x).groupBy("verdict").agg(F.count("*").alias("n"))


@query
def test_path_filter(x):
    return x.symbols().where(T.is_test_path(F.col("path"))).select("id", "path")


@query
def prod_view_edges(x):
    return rollups.without_tests({"edges": edges_of(x)})["edges"].select("caller", "callee", joined("lines"))


@query
def signature_render(x):
    return x.symbols().select("id", T.signature(*(F.col(c) for c in ("kind", "qualname", "params", "returns", "path"))).alias("signature"))


@query
def scalar_functions(x):
    s = x.symbols()
    return s.select("id", T.dir_of(F.col("path")).alias("dir"), T.stem_of(F.col("path")).alias("stem"), T.tokens(F.col("id")).alias("tokens"), T.slug(F.col("id")).alias("slug"), T.callee_base(F.col("id")).alias("base"), F.array_join(T.import_segments(F.translate("path", "/", ".")), "|").alias("segments"), F.array_join(T.terms(F.col("qualname")), "|").alias("terms"), T.oneline(F.col("id"), 20).alias("short"), T.project_folder(F.col("id")).alias("folder"), T.strip_generics(F.concat("name", F.lit(" <T, U>"))).alias("plain"), T.strip_quotes(F.concat(F.lit("'"), "name", F.lit("'"))).alias("unquoted"))


@query
def outline_file(x):
    return lookup.outline(x.symbols().where("path = 'src/brand_2/mod_11.py' OR path = 'src/brand_17/mod_28.py'")).select("path", "row", "line")


@query
def outline_dir(x):
    return lookup.outline_dirs(x.symbols()).select("path", "symbols", "position")


# adjacency


@query
def edge_dedupe(x):
    return edges_of(x).select("caller", "callee", joined("lines"))


@query
def adjacency_in(x):
    return graph.adjacency(edges_of(x), "in").select("id", joined("neighbours"))


@query
def adjacency_out(x):
    return graph.adjacency(edges_of(x), "out").select("id", joined("neighbours"))


@query
def degree(x):
    return graph.degrees(x.symbols(), edges_of(x)).select("id", "fan_in", "fan_out", "degree")


@query
def relevance_order(x):
    return graph.ranked(graph.degrees(x.symbols(), edges_of(x))).limit(50).select("id", "degree")


@query
def callers_of(x):
    return graph.related(edges_of(x), x.symbols(), id_of(x, 7), "in").select("id", joined("lines"))


@query
def callees_of(x):
    return graph.related(edges_of(x), x.symbols(), id_of(x, 7), "out").select("id", joined("lines"))


@query
def caller_sites(x):
    return graph.sites(edges_of(x), x.symbols(), id_of(x, 7)).select("id", "path", "line")


@query
def symbol_card(x):
    return lookup.cards(x.symbols(), edges_of(x), x.notes()).select("id", "kind", "path", "start_line", "fan_in", "fan_out", "notes")


@query
def file_symbols(x):
    return lookup.file_symbols(x.symbols(), "src/brand_1/").select("path", "start_line", "qualname", "kind")


@query
def definition_order(x):
    return lookup.definition_order(x.symbols()).select("id", "position")


@query
def duplicate_ids(x):
    return resolve.nth_ids(x.symbols().drop("id").withColumn("ordinal", F.col("start_line"))).select("p_partkey", "id")


@query
def import_first_wins(x):
    return resolve.first_imports(x.imports())


@query
def external_uses(x):
    return lookup.uses(x.external(), "The").select("caller", "callee")


@query
def external_grouping(x):
    return rollups.external_counts(x.external())


@query
def shadow_names(x):
    bases = x.external().select(T.callee_base(F.col("callee")).alias("base")).distinct()
    return lookup.shadows(bases, x.symbols().withColumn("name", F.substring_index("name", "_", 1)))


@query
def target_resolution(x):
    return rank.resolve_target(x.symbols(), "mod_11.py:small_ring").select("id")


@query
def zero_fan_types(x):
    """Decorated symbols stand for classes; what calls refers to them the other way round."""
    kinds = x.symbols().withColumn("kind", F.when(F.col("decorated"), "class").otherwise(F.col("kind")))
    return lookup.zero_fan_types(kinds, edges_of(x).where("size(lines) > 1"), _referenced(x))


def _referenced(x: Fixtures) -> DataFrame:
    """References run against the calls."""
    return x.module_edges().select(F.col("callee").alias("caller"), F.col("caller").alias("callee"), "lines")


@query
def referenced_fallback(x):
    return lookup.referenced_rows(x.module_edges(), edges_of(x).where("size(lines) > 1"), x.symbols())


@query
def minor_files(x):
    """Files without a doc in two languages; symbols in a part of them."""
    files = x.files().select("path", "language", F.when(F.col("language").isin("en", "fr"), F.lit(None)).otherwise(F.col("doc")).alias("doc"), F.lit(None).cast("string").alias("error"), "size")
    return lookup.minor_files(files, files.where("size > 2000")).select("path", "language")


@query
def unique_anchors(x):
    """Keys of which many have one slug."""
    return lookup.anchors(x.symbols().select(F.concat_ws(" ", "kind", "name").alias("key"), "p_partkey"), ["p_partkey"]).select("p_partkey", "anchor")


@query
def section_order(x):
    found = lookup.section_order(x.described(), x.symbols(), edges_of(x), "fan-in")
    return budget.running(found.withColumn("dir", T.dir_of(F.col("path"))), [F.col("dir"), F.desc(F.coalesce("file_fan_in", F.lit(0))), F.col("path")], {}).select("path", "rank")


@query
def size_advice(x):
    full = x.symbols().groupBy("path").agg((F.count("*") * 400).alias("full"))
    return lookup.size_advice(full, lookup.outline(x.symbols()), 800)


@query
def sparse_outlines(x):
    """Every seventh symbol is as long as a hundred lines, so that outlines say little of some files."""
    full = x.symbols().groupBy("path").agg(F.sum(F.when(F.col("p_partkey") % 7 == 0, 2000).otherwise(20)).alias("full"))
    return lookup.sparse(lookup.outline(x.symbols()), full).select("path", "outline", "symbols", "full")


# packs


@query
def pack_neighbours(x):
    near = packs.neighbours(x.symbols(), x.module_edges(), x.symbols(), 1)
    return packs.entries(near, x.module_edges(), x.symbols()).select("target", "id", "direction", "path", "line", "signature", "degree")


@query
def call_site_excerpts(x):
    near = packs.neighbours(x.symbols(), x.module_edges(), x.symbols(), 1)
    return packs.call_sites(near, x.module_edges(), x.source_lines())


def _tables(x: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges and imports of written fixtures, imports written as well, as a real map's are."""
    return x.symbols(), x.module_edges(), graph.tidied(x.imports())


def _text(x: Fixtures, budget: int | None, **options) -> DataFrame:
    def finish(rows: DataFrame, imports: DataFrame) -> DataFrame:
        return packs.rendered(packs.trimmed(rows, budget), imports).select("target", "tokens", F.md5("text").alias("text"))

    symbols, edges, imports = _tables(x)
    return packs.by_rounds(symbols, symbols, edges, imports, finish, **options)


@query
def pack_whole(x):
    """A pack of every symbol, with its notes."""
    x = x.written()
    return _text(x, None, notes=graph.stored(x.notes()))


@query
def pack_trim(x):
    return _text(x.written(), 90)


@query
def pack_trim_source(x):
    """Packs with the body and call sites, whose source has to go in part."""
    x = x.written()
    return _text(x, 60, lines=graph.stored(x.source_lines()))


@query
def pack_trim_task(x):
    """By what a task says: neighbours that it doesn't mean go first."""
    def finish(rows: DataFrame, imports: DataFrame) -> DataFrame:
        return packs.trimmed(rows, 90).where("section IN ('callers', 'callees') AND position > 0").select("target", "section", "position", F.get("lines", F.lit(0)).alias("line"))

    symbols, edges, imports = _tables(x.written())
    return packs.by_rounds(symbols, symbols, edges, imports, finish, task=TASK)


# resolution


def _rungs(x: Fixtures) -> DataFrame:
    """The ladder reads each table many times, so the derived tables are written first, as a real map's are."""
    x = x.paired()
    symbols, calls, imports = (graph.tidied(t) for t in (x.symbols(), x.raw_calls(), x.imports()))
    return resolve.rungs(calls, symbols, imports, symbols.select("path").distinct())


def _rung(name: str, wide: bool = True):
    def f(x: Fixtures) -> DataFrame:
        return _rungs(x).where(F.col(name).isNotNull()).select("caller", "name", "line", F.col(name).alias("callee")).distinct()

    f.__name__ = f"resolve_{name}"
    return (fine if wide else query)(f)


for _name, _wide in (("same_file", False), ("hint", False), ("only", True), ("container", True), ("typed", True)):
    _rung(_name, _wide)


@fine
def resolve_external_receiver(x):
    gone = x.imports().withColumn("name", F.when(F.col("ordinal") == 1, "ring").otherwise(F.col("name"))).withColumn("source", F.when(F.col("name") == "ring", "numpy.linalg").otherwise(F.col("source"))).withColumn("ordinal", F.lit(1))
    files = x.symbols().select("path").distinct()
    return resolve.rungs(x.raw_calls(), x.symbols(), gone.distinct(), files).where("external_receiver").select("caller", "text", "line").distinct()


@fine
def resolve_alias(x):
    """Every import is bound under another name, and calls use that name."""
    imports = x.imports().withColumn("name", F.concat(F.lit("al_"), "name"))
    calls = x.raw_calls().withColumn("name", F.concat(F.lit("al_"), "name")).withColumn("receiver", F.lit(None).cast("string"))
    return resolve.rungs(calls, x.symbols(), imports, x.symbols().select("path").distinct()).where("alias_n > 0").select("caller", "name", "line", "alias_n", "alias").distinct()


@fine
def resolve_ctor_pair(x):
    """Some classes and their constructors beside the fixture's symbols."""
    return resolve._pairs(lookup.class_fixture(x.symbols()).groupBy("name").agg(F.count("*").alias("n_candidates"), F.min("id").alias("only_id"), F.max("id").alias("other_id")), resolve.constructors(lookup.class_fixture(x.symbols())))


@fine
def ctor_credit(x):
    s = lookup.class_fixture(x.symbols())
    decided = s.where("kind = 'class'").select(F.concat(F.lit("src/a.py::f"), F.lit("")).alias("caller"), F.col("id").alias("callee"), F.lit(3).alias("line"), F.lit("edge").alias("outcome"))
    return resolve.edges_of(decided, s).select("caller", "callee", joined("lines"))


@fine
def call_graph_full(x):
    return resolve.edges_of(resolve.decide(_rungs(x)), x.symbols()).select("caller", "callee", joined("lines"))


@fine
def refs_graph_full(x):
    return resolve.edges_of(resolve.decide(_rungs(x), references=True)).select("caller", "callee", joined("lines"))


@query
def ambiguous_calls(x):
    return resolve.ambiguous_of(resolve.decide(_rungs(x)), x.symbols(), ",").select("caller", "name", "n", "candidates")


@fine
def ambiguous_in(x):
    return resolve.ambiguous_in(resolve.decide(_rungs(x)), x.symbols())


@fine
def ambiguous_owners(x):
    return resolve.ambiguous_rows(resolve.decide(_rungs(x)), x.symbols()).select("caller", "name", "candidate")


@fine
def external_calls(x):
    """Every seventh line calls something that no file defines."""
    calls = x.raw_calls().withColumn("name", F.when(F.col("line") % 7 == 0, "outside").otherwise(F.col("name")))
    return resolve.external_of(resolve.decide(resolve.rungs(*(graph.stored(t) for t in (calls, x.symbols(), x.imports())), x.symbols().select("path").distinct()))).select("caller", "callee", joined("lines"))


# rollups


@query
def hotspots_fan_in(x):
    return graph.hotspots(x.symbols(), edges_of(x), "fan_in").select("id", "fan_in", "path", "start_line")


@query
def hotspots_fan_out(x):
    return graph.hotspots(x.symbols(), edges_of(x), "fan_out").select("id", "fan_out", "path", "start_line")


@query
def largest_files(x):
    return rollups.largest_files(x.symbols())


@query
def language_mix(x):
    """Files have one to three symbols."""
    files = x.files()
    return rollups.language_mix(files, files.select("path", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3))))


@query
def kind_counts(x):
    return rollups.kind_counts(x.symbols())


@query
def run_summary(x):
    calls = graph.stored(edges_of(x))
    return rollups.run_summary(calls, calls.where("size(lines) > 1"), x.external())


@query
def stats_row(x):
    return rollups.stats(x.symbols().select("path").distinct(), x.symbols(), edges_of(x))


@query
def directory_rollup(x):
    return rollups.directories(x.described(), x.symbols(), edges_of(x)).select("dir", "files", "symbols", "internal", "cross", "purpose")


@query
def directory_coupling(x):
    return rollups.coupling(edges_of(x))


@query
def directory_purpose(x):
    return rollups.directory_purpose(x.files())


@query
def entrypoints(x):
    return rollups.entry_points(x.symbols(), edges_of(x)).select("id", "path", "start_line")


@query
def churn_counts(x):
    return rollups.churn(x.commits(), 20)


@query
def churn_hotspots(x):
    return rollups.churn_hotspots(x.commits(), x.symbols(), edges_of(x), 20).select("path", "commits", "fan_in", "score")


@query
def file_fan_in(x):
    return rollups.file_fan_in(x.symbols(), edges_of(x))


@query
def unused_symbols(x):
    return rollups.unused(x.symbols(), x.imports(), edges_of(x), root_globs=("src/brand_3/*",)).select("id", "path", "start_line")


@query
def reexports(x):
    return rollups.reexports(x.imports().withColumn("path", F.when(F.col("path").contains("mod_1.py"), "src/pkg/__init__.py").otherwise(F.col("path"))))


@query
def used_key_closure(x):
    return rollups.used_keys(x.symbols(), edges_of(x))


@query
def skip_reasons(x):
    return rollups.skip_reasons(_verdicts(x).where("verdict NOT IN ('ok', 'drop')").withColumnRenamed("verdict", "reason"))


# changes


def _old(x: Fixtures) -> DataFrame:
    price = F.when(F.col("p_partkey") % 29 == 0, F.col("p_partkey") + 1).otherwise(F.col("p_partkey"))
    return x.symbols().where("p_partkey % 23 <> 0").withColumn("body_hash", F.substring(F.sha2(price.cast("string"), 256), 1, 16))


def _new(x: Fixtures) -> DataFrame:
    return x.symbols().where("p_partkey % 31 <> 0").withColumn("body_hash", F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 16))


@query
def symbol_diff(x):
    return change.symbol_diff(_old(x), _new(x))


@query
def freshness_diff(x):
    now = x.files().where("doc_id % 17 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 19 == 0, "changed").otherwise(F.col("content_hash")))
    new = x.files().where("doc_id % 101 = 0").withColumn("path", F.concat(F.lit("new/"), "path"))
    return change.freshness_diff(x.files().select("path", "content_hash"), now.unionByName(new).select("path", "content_hash"))


@query
def cache_misses(x):
    cached = x.files().withColumn("content_hash", F.when(F.col("doc_id") % 19 == 0, "old").otherwise(F.col("content_hash")))
    return change.cache_misses(x.files(), cached).select("path", "content_hash")


@query
def impacted_tests(x):
    delta = graph.stored(change.symbol_diff(_old(x), _new(x)))
    return change.impacted_tests(delta, edges_of(x), x.symbols(), x.imports()).select("path", "tier", F.size("symbols").alias("symbols"))


@query
def pytest_hint(x):
    seed = x.symbols().where("p_partkey = 7").select("id")
    return change.pytest_hint(change.call_impacts(seed, edges_of(x), x.symbols()))


@query
def symbol_diff_callers(x):
    found = change.with_callers(change.symbol_diff(_old(x), _new(x)), edges_of(x), x.module_edges())
    return found.select("id", "change", F.array_join(F.coalesce("callers", F.array()), ",").alias("callers"))


@query
def diff_lines(x):
    return change.diff_lines(change.with_callers(change.symbol_diff(_old(x), _new(x)), edges_of(x), x.module_edges()))


@query
def impacted_import_tier(x):
    return change.import_hits(x.imports(), x.symbols().where("path LIKE 'src/brand_2/%'").select("path").distinct())


@query
def symbol_impact(x):
    seed = x.symbols().where("p_partkey = 7").select("id")
    return change.call_impacts(seed, edges_of(x), x.symbols()).select("path", "tier")


@query
def reverse_reach(x):
    return graph.reverse_hops(x.symbols().where("p_partkey = 7").select("id"), edges_of(x))


# graph


@query
def neighbourhood_2hop(x):
    return graph.neighbourhood(edges_of(x), x.symbols(), id_of(x, 7), 2).select("id", "hop", "direction")


@query
def file_neighbourhood(x):
    return graph.file_neighbourhood(edges_of(x), x.symbols(), "src/brand_2/mod_11.py").select("id")


@query
def trace_path_lengths(x):
    return graph.path_count(edges_of(x), x.symbols(), id_of(x, 7), id_of(x, 11))


@query
def trace_all_shortest(x):
    return graph.shortest_paths(edges_of(x), x.symbols(), id_of(x, 7), id_of(x, 11)).select("length", F.array_join("path", ">").alias("path"))


@query
def file_graph(x):
    return graph.projection(edges_of(x), "file")


@query
def dir_graph(x):
    return graph.projection(edges_of(x), "dir")


@query
def symbol_graph(x):
    return graph.projection(edges_of(x), "symbol")


@query
def mermaid_lines(x):
    return lookup.diagram(graph.projection(edges_of(x), "dir"), "mermaid")


@query
def dot_lines(x):
    return lookup.diagram(graph.projection(edges_of(x), "dir"), "dot")


@query
def module_edges(x):
    return rollups.module_edges(graph.projection(edges_of(x), "dir"))


# budgets and ranking


def _callers(x: Fixtures) -> DataFrame:
    many = edges_of(x).groupBy("callee").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee").first()["callee"]
    return graph.degrees(x.symbols(), edges_of(x)).join(edges_of(x).where(F.col("callee") == many).select(F.col("caller").alias("id")), "id", "left_semi")



def _order():
    return [F.col("test"), F.desc("degree"), F.col("path"), F.col("start_line")]


@query
def budget_fit_callers(x):
    return budget.fit(_callers(x), _order(), F.col("id"), 60, 50, prefix=12).select("id", "rank", "cost")


@query
def budget_fit_files(x):
    return budget.fit_each(x.symbols(), ["path"], [F.col("start_line")], F.col("id"), 20).select("id", "path", "rank", "cost")


@query
def meter_row(x):
    rows = _callers(x)
    return budget.meter(budget.fit(rows, _order(), F.col("id"), 60, 50), rows, 60, 50).select("tokens", "returned", "total", "omitted", "truncated_by", "per_signal")


@query
def json_budget(x):
    return budget.fit_json(_callers(x), _order(), ["id", "kind", "path", "start_line", "test"], 300, 50).select("id", "rank", "cost", "entry")


@query
def budget_all(x):
    """Without a limit the running sum goes by ranges."""
    rows = graph.degrees(x.symbols(), edges_of(x))
    return budget.fit(rows, [*_order(), F.col("id")], F.col("id"), None).select("id", "rank", "cost")


@query
def group_caps(x):
    return budget.capped(x.symbols(), ["path"], [F.col("start_line")], 3).select("id", "rank", "more")


@query
def relevance_scores(x):
    c = x.symbols().select("id", F.concat_ws(" ", "qualname", "path").alias("text"), "path")
    return rank.lexical(c, TASK, ("src/brand_2/mod_11.py",), ("src/brand_4/mod_5.py",)).select("id", (F.col("raw") * 2).cast("long").alias("raw2"))


@query
def blended_rank(x):
    c = graph.degrees(x.symbols(), edges_of(x)).select("id", F.concat_ws(" ", "qualname", "path").alias("text"), "path", F.col("fan_in").alias("central"))
    return rank.blended(rank.lexical(c, TASK)).select("id", F.round("blend", 6).alias("blend"))


@query
def task_files(x):
    files = x.files().select("path", F.concat_ws(" ", "path", "doc").alias("text"))
    return rank.task_files(files, ("src1", "fr")).select("path", (F.col("raw") * 2).cast("long").alias("raw2"))


@query
def custom_scorer(x):
    """Any function of text and path ranks."""
    c = x.symbols().select("id", F.col("qualname").alias("text"), "path")
    return rank.scored_by(c, lambda text, path: F.length(text) - F.length(path)).select("id", F.col("raw").cast("long").alias("raw"), F.round("score", 6).alias("score"))


@query
def lean_atoms(x):
    return rank.atoms(x.symbols(), edges_of(x), rollups.churn(x.commits(), 20)).select("id", "name", "signature", F.round("score", 6).alias("score"), "demotable")


def _flat_atoms(x: Fixtures) -> DataFrame:
    return graph.degrees(x.symbols(), edges_of(x)).select("id", "name", T.signature(*(F.col(c) for c in ("kind", "qualname", "params", "returns", "path"))).alias("signature"), F.col("fan_in").cast("double").alias("score"))


@query
def lean_ladder_cut(x):
    return budget.shed(_flat_atoms(x), 3000).select("id", "form")


@query
def lean_dense(x):
    return rank.dense(_flat_atoms(x)).select("id", "form")


@query
def lean_cap(x):
    n = x.symbols().select("path").distinct().count()
    return x.spark.createDataFrame([(n, lean.cap_of(n, 0))], "files long, cap long")


def _lean(x: Fixtures, **options) -> tuple[DataFrame, lean.Report]:
    symbols, edges = graph.stored(x.symbols()), graph.stored(edges_of(x))
    return lean.lean(x.described(), rank.atoms(symbols, edges, rollups.churn(x.commits(), 20)), edges, **options)


@query
def lean_report(x):
    _, report = _lean(x)
    shown = {k: v for k, v in report.as_dict().items() if k not in ("tokens_per_signal", "tokens")}
    return x.spark.createDataFrame([tuple(shown.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in shown.items()))


@query
def lean_lines(x):
    return _lean(x)[0].where("section <> 'diagram'")


@query
def lean_lines_dense(x):
    """With room for everything: signatures of the highest scores, and nothing of what is known."""
    seen = x.symbols().where("decorated").select("id")
    return _lean(x, budget=10_000_000, dense=True, seen=seen)[0].where("section = 'files'")


@query
def lean_backbone(x):
    return lookup.backbone(x.symbols()).select("dir", "files", "symbols", "demotable")


@query
def touched_file_rank(x):
    return rank.touched_files(x.symbols(), edges_of(x), change.symbol_diff(_old(x), _new(x)).where("change <> 'removed'"))


@query
def workset_rows(x):
    touched = x.symbols().where("p_partkey IN (7, 11, 13)")
    tests = change.call_impacts(touched, edges_of(x), x.symbols())
    return rank.workset(x.symbols(), edges_of(x), touched, tests).groupBy("tier").agg(F.count("*").alias("rows"))


@query
def close_names(x):
    return rank.close_names(x.symbols(), "red_widgt")


@query
def notes_attach(x):
    return lookup.attached(x.notes(), x.symbols()).select("id", "text")


@query
def notes_orphaned(x):
    return lookup.orphans(x.notes(), x.symbols()).select("symbol_id", "text")


# sessions


def _reads(x: Fixtures) -> DataFrame:
    n = x.table("part").agg(F.count("*").alias("n"))
    s = x.symbols().select("p_partkey", "path")
    t = x.transcript().join(F.broadcast(n)).withColumn("p_partkey", F.col("part") % F.col("n"))
    return t.join(s, "p_partkey")


@query
def ledger_sessions(x):
    return session.sessions(x.transcript())


@query
def ledger_files(x):
    return session.session_files(_reads(x), x.symbols())


@query
def ledger_read_range(x):
    return session.seen_symbols(_reads(x), x.symbols()).select("session_id", "id")


@query
def ledger_budget(x):
    return session.sessions(x.transcript()).select("session_id", session.remaining(F.col("consumed")).alias("left"), session.adaptive_k(session.remaining(F.col("consumed"))).alias("k"))


@query
def adaptive_pointer(x):
    """Pointers a prompt gets: the best files by task that the session has not read whole."""
    read = session.session_files(_reads(x).where("session_id = 1"), x.symbols()).where("fully_read")
    files = x.symbols().groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("names"))
    return rank.task_files(files.select("path", F.concat_ws(" ", "path", "names").alias("text")), ("red", "widget", "17"), seen=read).select("path", (F.col("raw") * 2).cast("long").alias("raw2"))


@query
def ledger_totals(x):
    return session.totals(x.transcript(), _reads(x), x.symbols())


@query
def ledger_top_files(x):
    return session.session_files(_reads(x), x.symbols(), k=2)


# extras: windows over commits


@query
def churn_tumbling(x):
    return rollups.churn_windows(x.commits())


@query
def churn_session(x):
    return rollups.churn_sessions(x.commits())


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten symbols that most others call."""
    return QUERIES["hotspots_fan_in"](spark, sf_dir)
