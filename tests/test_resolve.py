"""The ladder, rung by rung, on hand-made rows."""

from pyspark.sql import functions as F

from codeloom.functions.text import is_test_path
from codeloom.operators import resolve
from codeloom.schemas import PARAMS


def tables(spark, symbols, calls, imports=(), files=()):
    s = spark.createDataFrame([(f"{p}::{q}", q.rsplit(".", 1)[-1], q, k, p, list(params), i) for i, (p, q, k, *params) in enumerate(symbols)], f"id string, name string, qualname string, kind string, path string, params {PARAMS}, start_line int")
    s = s.withColumn("test", is_test_path(F.col("path")))
    c = spark.createDataFrame(list(calls), "caller_id string, path string, receiver string, name string, line int").withColumn("text", F.concat_ws(".", "receiver", "name"))
    i = spark.createDataFrame([(*x, n) for n, x in enumerate(imports)], "path string, name string, source string, ordinal int")
    f = spark.createDataFrame([(p,) for p in {x[0] for x in symbols} | set(files)], "path string")
    return c, s, i, f


def edges(graph):
    return sorted((r["caller"], r["callee"], tuple(r["lines"])) for r in graph["edges"].collect())


def test_rungs(spark):
    symbols = [
        ("src/a.py", "A.run", "method", ("c", "Optional[Ctl]")), ("src/a.py", "A.go", "method"), ("src/a.py", "only_here", "function"), ("src/b.py", "go", "function"),
        ("src/b.py", "B.go", "method"), ("src/ctl.py", "Ctl.start", "method"), ("src/x.py", "Other.start", "method"), ("src/u.py", "tool", "function"), ("src/v.py", "tool", "function"),
        ("src/k.py", "Kls", "class"), ("src/k.py", "Kls.__init__", "method"), ("src/J.java", "Foo", "class"), ("src/J.java", "Foo.Foo", "method"),
    ]
    run = "src/a.py::A.run"
    calls = [
        (run, "src/a.py", "self", "go", 1), (run, "src/a.py", "c", "start", 2), (run, "src/a.py", None, "only_here", 3), (run, "src/a.py", None, "tool", 4), (run, "src/a.py", None, "Kls", 5),
        (run, "src/a.py", None, "Foo", 6), (run, "src/a.py", "np", "go", 7), (run, "src/a.py", None, "missing", 8), (None, "src/a.py", None, "helper", 9), ("src/b.py::go", "src/b.py", None, "start", 10),
        (run, "src/a.py", None, "run", 11), (run, "src/a.py", None, "only_here", 12), (run, "src/a.py", None, "only_here", 3),
    ]
    imports = [("src/a.py", "tool", "src.u.tool"), ("src/a.py", "tool", "src.v.tool"), ("src/a.py", "np", "numpy"), ("src/a.py", "helper", "src.v.tool")]
    graph = resolve.call_graph(*tables(spark, symbols, calls, imports))
    assert edges(graph) == [
        ("src/a.py::<module>", "src/v.py::tool", (9,)), (run, "src/J.java::Foo", (6,)), (run, "src/J.java::Foo.Foo", (6,)), (run, "src/a.py::A.go", (1,)), (run, "src/a.py::only_here", (3, 12)),
        (run, "src/ctl.py::Ctl.start", (2,)), (run, "src/k.py::Kls", (5,)), (run, "src/k.py::Kls.__init__", (5,)), (run, "src/u.py::tool", (4,)),
    ]
    assert sorted((r["callee"], tuple(r["lines"])) for r in graph["external"].collect()) == [("missing", (8,)), ("np.go", (7,))]
    assert [(r["name"], r["candidates"]) for r in graph["ambiguous"].collect()] == [("start", ["src/ctl.py::Ctl.start", "src/x.py::Other.start"])]


def test_same_file_ignores_the_receiver_and_references_drop_what_is_unclear(spark):
    symbols = [("a.py", "f", "function"), ("a.py", "g", "function"), ("b.py", "g", "function"), ("c.py", "h", "function"), ("d.py", "h", "function")]
    calls = [("a.py::f", "a.py", "anything", "g", 1), ("a.py::f", "a.py", None, "h", 2)]
    c, s, i, f = tables(spark, symbols, calls)
    graph = resolve.call_graph(c, s, i, f, c.drop("text"))
    assert edges(graph) == [("a.py::f", "a.py::g", (1,))]
    assert graph["referenced"].count() == 1 and graph["ambiguous"].count() == 1


def test_empty_tables(spark):
    c, s, i, f = tables(spark, [("a.py", "f", "function")], [("a.py::f", "a.py", None, "g", 1)])
    graph = resolve.call_graph(c.limit(0), s.limit(0), i, f.limit(0), c.drop("text").limit(0))
    assert all(t.isEmpty() for t in graph.values())


def test_owners_are_listed_once_a_name_not_for_each_asker(spark):
    symbols = [("a.py", "f", "function"), ("a.py", "g", "function"), ("tests/b.py", "h", "function"), ("c.py", "h", "function"), ("d.py", "h", "function"), ("u.py", "t", "function"), ("v/u.py", "t", "function")]
    calls = [("a.py::f", "a.py", None, "h", 1), ("a.py::g", "a.py", None, "h", 2), ("a.py::g", "a.py", None, "h", 3), ("a.py::f", "a.py", None, "al", 4)]
    c, s, i, f = tables(spark, symbols, calls, [("a.py", "al", "v.u.t")])
    found = resolve.ambiguous_of(resolve.decide(resolve.rungs(c, s, i, f)), s, ",")
    h = ("h", 3, "c.py::h,d.py::h,tests/b.py::h")
    assert sorted((r["caller"], r["name"], r["n"], r["candidates"]) for r in found.collect()) == [("a.py::f", "al", 2, "u.py::t,v/u.py::t"), ("a.py::f", *h), ("a.py::g", *h)]
    lists = resolve.ambiguous_of(resolve.decide(resolve.rungs(c, s, i, f)), s)
    assert sorted(len(r["candidates"]) for r in lists.collect()) == [2, 3, 3]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and not any("collect_list" in x and "caller" in x for x in plan.split("\n"))
