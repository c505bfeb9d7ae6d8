"""Graph, budgets, changes, ranking and sessions on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import budget, change, graph, lookup, rank, rollups, session


@pytest.fixture(scope="module")
def world(spark):
    rows = [(f"{p}::{q}", q, q, "function", p, "python", n, n + 5, False, False, p.startswith("tests/")) for n, (p, q) in enumerate([("src/a.py", "a"), ("src/b.py", "b"), ("src/c.py", "c"), ("src/d.py", "d"), ("tests/t.py", "t"), ("tests/u.py", "u"), ("lib/e.py", "e")], 1)]
    symbols = spark.createDataFrame(rows, "id string, name string, qualname string, kind string, path string, language string, start_line int, end_line int, decorated boolean, exported boolean, test boolean")
    ids = {r[1]: r[0] for r in rows} | {"m": "tests/m.py::<module>"}
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("t", "a"), ("u", "d"), ("m", "d"), ("d", "a")]
    edges = spark.createDataFrame([(ids[x], ids[y], [3, 1]) for x, y in pairs], "caller string, callee string, lines array<int>")
    return symbols, edges, ids


def test_graph(world, spark):
    symbols, edges, ids = world
    paths = [r["path"] for r in graph.shortest_paths(edges, symbols, ids["a"], ids["d"]).collect()]
    assert sorted(paths) == [[ids["a"], ids["b"], ids["d"]], [ids["a"], ids["c"], ids["d"]]]
    assert graph.shortest_paths(edges, symbols, ids["a"], ids["e"]).isEmpty()
    assert graph.shortest_paths(edges, symbols, ids["a"], ids["a"]).first()["path"] == [ids["a"]]
    hops = {r["id"]: r["hop"] for r in graph.reverse_hops(spark.createDataFrame([(ids["d"],)], "id string"), edges).collect()}
    assert hops == {ids["d"]: 0, ids["b"]: 1, ids["c"]: 1, ids["u"]: 1, ids["m"]: 1, ids["a"]: 2, ids["t"]: 3}
    near = {(r["id"], r["hop"], r["direction"]) for r in graph.neighbourhood(edges, symbols, ids["d"], 1).collect()}
    assert near == {(ids[x], 1, "caller") for x in "bcum"} | {(ids["a"], 1, "callee")}
    assert graph.related(edges, symbols, ids["d"]).where("module = 'tests/m.py'").count() == 1
    assert [r["id"] for r in graph.hotspots(symbols, edges, k=2).collect()] == [ids["d"], ids["a"]]
    assert graph.overview(edges, 100)[0] == "file" and graph.overview(edges, 3)[0] == "dir" and graph.overview(edges, 1)[0] == "omitted" and graph.overview(edges.limit(0), 9)[0] == "empty"
    assert {tuple(r) for r in graph.projection(edges, "dir").collect()} == {("tests", "src")}


def test_rollups(world, spark):
    symbols, edges, ids = world
    imports = spark.createDataFrame([("pkg/__init__.py", "e", "lib.e", 0)], "path string, name string, source string, ordinal int")
    assert [r["id"] for r in rollups.unused(symbols, imports.limit(0), edges).collect()] == [ids["e"]]
    assert rollups.unused(symbols, imports, edges).isEmpty()
    assert {r["dir"]: (r["internal"], r["cross"]) for r in rollups.coupling(edges).collect()} == {"src": (5, 3), "tests": (0, 3)}
    prod = rollups.without_tests({"symbols": symbols, "edges": edges})
    assert prod["symbols"].count() == 5 and prod["edges"].count() == 5
    assert rank.resolve_target(symbols, "src/a.py::a").first()["id"] == ids["a"]
    assert [r["name"] for r in rank.close_names(symbols, "B").collect()][0] == "b"


def test_budget_keeps_a_prefix_and_always_one_row(spark):
    rows = spark.createDataFrame([(i, "x" * 10) for i in range(6)], "n int, line string")
    assert [r["n"] for r in budget.fit(rows, [F.col("n")], F.col("line"), 8).collect()] == [0, 1, 2]
    assert [r["n"] for r in budget.fit(rows, [F.col("n")], F.col("line"), 0).collect()] == [0]
    assert budget.fit(rows, [F.col("n")], F.col("line"), None, 4).count() == 4
    m = budget.meter(budget.fit(rows, [F.col("n")], F.col("line"), 8, 5), rows, 8, 5).first()
    assert (m["returned"], m["total"], m["omitted"], m["truncated_by"]) == (3, 6, 3, "budget")
    assert budget.meter(budget.fit(rows, [F.col("n")], F.col("line"), None, 2), rows, None, 2).first()["truncated_by"] == "limit"


def test_change(world, spark):
    symbols, edges, ids = world
    old = symbols.where("name <> 'e'").withColumn("body_hash", F.col("name"))
    new = symbols.where("name <> 'c'").withColumn("body_hash", F.when(F.col("name") == "d", "x").otherwise(F.col("name")))
    delta = change.symbol_diff(old, new)
    assert {(r["id"], r["change"]) for r in delta.collect()} == {(ids["e"], "added"), (ids["c"], "removed"), (ids["d"], "changed")}
    imports = spark.createDataFrame([("tests/z.py", "c", "src.c.c", 0)], "path string, name string, source string, ordinal int")
    hit = [(r["path"], r["tier"]) for r in change.impacted_tests(delta, edges, symbols, imports).collect()]
    assert hit == [("tests/m.py", "direct"), ("tests/u.py", "direct"), ("tests/t.py", "transitive"), ("tests/z.py", "import")]
    f = spark.createDataFrame([("a", "1", 5), ("b", "2", 5), ("c", "3", 5)], "path string, content_hash string, stat int")
    g = spark.createDataFrame([("a", "other", 5), ("b", "other", 6), ("d", "3", 5)], "path string, content_hash string, stat int")
    assert {tuple(r) for r in change.freshness_diff(f, g).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(T.terms(F.lit("parseHTTPInput the_fix of x2 a"))) == ["parse", "http", "input", "x2"]
    assert one(T.stem_of(F.lit("pkg/__init__.py"))) == "pkg" and one(T.stem_of(F.lit("a/b.c.py"))) == "b.c" and one(T.stem_of(F.lit("__init__.py"))) == "__init__"
    assert one(T.callee_base(F.lit("a::b->c.d"))) == "d" and one(T.callee_base(F.lit(""))) is None
    assert one(T.is_test_path(F.lit("src/FooTest.java"))) and not one(T.is_test_path(F.lit("src/contest.py"))) and one(T.is_test_path(F.lit("spec")))
    assert one(T.oneline(F.lit("  abcdefgh\nx"), 5)) == "abcd…"
    assert one(T.slug(F.lit("--A b/C--"))) == "a-b-c"
    assert one(T.import_segments(F.lit("crate::a.b/c"))) == ["a", "b", "c"]
    raw = one(T.relevance(F.lit("red_widget"), F.lit("p"), ("red", "wid", "x"), ("p",)))
    assert raw == 1 + 0.5 + 2
    v = {r["path"]: r["verdict"] for r in lookup.verdicts(spark.createDataFrame([("a.py", 1), ("dist/a.py", 1), ("x.min.js", 1), ("b.py", 99), ("c.zz", 1), ("ex/q.py", 1)], "path string, size int"), {"py": "python", "js": "javascript"}, ("ex/*",), max_file_size=50).collect()}
    assert v == {"a.py": "ok", "dist/a.py": "drop", "x.min.js": "generated", "b.py": "too large", "c.zz": "drop", "ex/q.py": "excluded"}


def test_sessions_batch_and_stream(world, spark, tmp_path):
    from codeloom.streaming.sessions import session_totals, transcript_stream

    symbols = world[0]
    tool = lambda name, **inp: {"type": "tool_use", "name": name, "input": inp}
    rows = [
        {"type": "user", "sessionId": "s", "message": {"content": [{"type": "text", "text": "x" * 40}]}},
        {"type": "assistant", "sessionId": "s", "message": {"usage": {"input_tokens": 10, "cache_read_input_tokens": 90}, "content": [tool("Read", file_path="/r/src/a.py"), tool("Read", file_path="/elsewhere/x.py")]}},
        {"type": "assistant", "sessionId": "s", "message": {"usage": {"input_tokens": 0}, "content": [tool("Read", file_path="/r/src/b.py", offset=2, limit=1)]}},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/t.jsonl").write_text("\n".join([json.dumps(rows[0]), "", "{broken", "[1]", *map(json.dumps, rows[1:])]))
    facts = session.facts(session.read_transcript(spark, str(tmp_path / "in/t.jsonl")), "/r")
    total = session.sessions(facts).first()
    assert (total["session_id"], total["turns"], total["consumed"]) == ("s", 2, 100)
    files = {r["path"]: (r["fully_read"], r["symbols"]) for r in session.session_files(facts, symbols).collect()}
    assert files == {"src/a.py": (True, 1), "src/b.py": (False, 1)}
    q = session_totals(transcript_stream(spark, str(tmp_path / "in"), "/r")).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    live = spark.table("totals").first()
    assert (live["turns"], live["usage"], live["files"]) == (2, 100, ["src/a.py", "src/b.py"])


def test_long_call_chains(spark):
    """Paths and reach of any length: 70 calls in a row."""
    ids = [f"a.py::f{i:03d}" for i in range(71)]
    edges = spark.createDataFrame([(a, b, [1]) for a, b in zip(ids, ids[1:], strict=False)], "caller string, callee string, lines array<int>")
    symbols = spark.createDataFrame([(i,) for i in ids], "id string")
    path = graph.shortest_paths(edges, symbols, ids[0], ids[-1]).collect()
    assert [(r["length"], r["path"]) for r in path] == [(70, ids)]
    hops = {r["id"]: r["hop"] for r in graph.reverse_hops(symbols.where(F.col("id") == ids[-1]), edges).collect()}
    assert hops == {x: 70 - i for i, x in enumerate(ids)}


def test_risk_is_by_the_highest_fan_in_of_all_files(spark):
    import datetime

    now = datetime.datetime(2024, 1, 1)
    commits = spark.createDataFrame([("1", "b.py", now), ("2", "b.py", now)], "commit_id string, path string, ts timestamp")
    symbols = spark.createDataFrame([("a.py::f", "a.py"), ("b.py::g", "b.py")], "id string, path string")
    edges = spark.createDataFrame([(f"c{i}.py::x", "a.py::f", [1]) for i in range(7)] + [(f"c{i}.py::x", "b.py::g", [1]) for i in range(2)], "caller string, callee string, lines array<int>")
    assert [tuple(r) for r in rollups.churn_hotspots(commits, symbols, edges).select("path", "commits", "fan_in", "score").collect()] == [("b.py", 2, 2, 0.6)]


def test_anchors_are_unique(spark):
    keys = ["a b", "A-b", "a b 2", "a_b", "a b 3", "a.b", "!!", "??", "a b 2 2"]
    found = lookup.anchors(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n int"), ["n"]).collect()
    assert len({r["anchor"] for r in found}) == len(keys) and {r["key"]: r["anchor"] for r in found}["a b"] == "a-b"


def test_running_sums_by_ranges(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 13).alias("v")).repartition(7)
    found = sorted((r["k"], r["rank"], r["before"]) for r in budget.running(rows, [F.col("k")], {"before": F.col("v")}).collect())
    values = {(i * 7919) % 1000: i % 13 for i in range(1000)}
    assert found == [(k, k + 1, sum(values[j] for j in range(k))) for k in range(1000)]
    assert budget.running(rows.limit(0), [F.col("k")], {"before": F.col("v")}).isEmpty()


def test_terms(spark):
    cases = {"getHTTPResponse_code": ["get", "http", "response", "code"], "parseXML2JSON": ["parse", "xml", "json"], "A1b utf8Text": ["a1b", "utf8", "text"], "theURLs of ID7x": ["ur", "ls", "id", "7x"]}
    for text, want in cases.items():
        assert spark.range(1).select(T.terms(F.lit(text))).first()[0] == want


def test_token_counter_by_ranks(spark):
    P = pytest.importorskip("public_tokenizers")
    count = T.bpe_tokens(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert [r[0] for r in spark.createDataFrame([("def run(a):",), ("",), (None,)], "t string").select(count("t")).collect()] == [len(T._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary("def run(a):")), 0, 0]


def test_transcripts_are_found(tmp_path):
    folder = tmp_path / "projects" / "-home-me-repo"
    folder.mkdir(parents=True)
    (folder / "one.jsonl").write_text("{}")
    assert session.find_transcript(str(tmp_path / "projects"), "/home/me/repo").endswith("one.jsonl")
    assert session.find_transcript(str(tmp_path / "projects"), "/home/me/repo", "two") is None and session.find_transcript(str(tmp_path / "projects"), "/none") is None


def test_same_paths(spark):
    a, b = (spark.createDataFrame([(x,) for x in p], "path string") for p in (["x", "y", "x"], ["y", "x"]))
    assert change.same_paths(a, b) and not change.same_paths(a, b.limit(1))


def test_paths_are_counted_and_none_is_no_row(world, spark):
    symbols, edges, ids = world
    count = lambda a, b: [tuple(r) for r in graph.path_count(edges, symbols, ids[a], ids[b]).collect()]
    assert (count("a", "d"), count("t", "d"), count("a", "a"), count("a", "e")) == ([(2, 2)], [(3, 2)], [(0, 1)], [])


def test_path_lengths_of_symbols_that_no_path_connects(spark, tmp_path):
    """The SQL has no row then."""
    parts = [(k, "a gear", "Brand#1", "STANDARD", k, 1.0) for k in range(1, 13)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1, 7), (1, 2, 3), (2, 1, 11), (2, 2, 4)]
    rows = [(o, n, k, 1, 1.0, 50.0, 0.1, "A") for o, n, k in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    from codeloom.plans import catalog

    assert catalog.QUERIES["trace_path_lengths"](spark, str(tmp_path)).collect() == []
