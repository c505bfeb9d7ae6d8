"""Context packs of a few symbols of one file that imports much."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import packs
from codeloom.schemas import MODULE, PARAMS


@pytest.fixture(scope="module")
def world(spark):
    names = [("src/a.py", "run"), ("src/a.py", "stop"), ("src/a.py", "idle"), ("src/b.py", "gear"), ("src/b.py", "bolt")]
    rows = [(f"{p}::{n}", n, n, "function", p, "python", [], None, 10 * i + 1, 10 * i + 9, None, False) for i, (p, n) in enumerate(names)]
    symbols = spark.createDataFrame(rows, f"id string, name string, qualname string, kind string, path string, language string, params {PARAMS}, returns string, start_line int, end_line int, doc string, test boolean")
    calls = [("src/a.py::run", "src/b.py::gear"), ("src/a.py::run", "src/b.py::bolt"), ("src/a.py::stop", "src/b.py::gear"), ("src/c.py" + MODULE, "src/a.py::run")]
    edges = spark.createDataFrame([(a, b, [3, 5]) for a, b in calls], "caller string, callee string, lines array<int>")
    bound = [("gear", "b.gear"), ("bolt", "b.bolt"), ("run", "x.y.run"), ("gear", "other.gear"), ("far", "z.far"), ("bolt", "other.of.bolt"), ("near", "z.near")]
    imports = spark.createDataFrame([("src/a.py", n, s, i) for i, (n, s) in enumerate(bound, 1)], "path string, name string, source string, ordinal int")
    lines = spark.createDataFrame([(p, i, f"text {i}") for p in ("src/a.py", "src/b.py", "src/c.py") for i in range(1, 16)], "path string, line int, text string")
    return symbols, edges, imports, lines


def test_lines_of_files_are_not_broadcast(world):
    """A stored table of lines is small as a file and large in the driver's memory."""
    symbols, edges, _, lines = world
    near = packs.neighbours(symbols, edges, symbols)
    assert "BroadcastHashJoin [path" not in packs.call_sites(near, edges, lines)._jdf.queryExecution().executedPlan().toString()


def test_source_ends_with_its_symbol_and_its_file(world):
    symbols, edges, imports, lines = world
    found = packs.packs(symbols, symbols, edges, imports, lines=lines).where("section = 'source' AND position > 0").groupBy("target").agg(F.min("position"), F.max("position"))
    assert {tuple(r) for r in found.collect()} == {("src/a.py::run", 1, 9), ("src/a.py::stop", 11, 15)}


def test_imports_are_one_row_a_target(world):
    """Not one for each of the file's imports, which would be as many as its targets times its imports."""
    symbols, edges, imports, _ = world
    rows = packs.packs(symbols, symbols, edges, imports).where("section = 'imports'")
    assert rows.count() == 3 + 3 + 2  # title, names if any, and how many more, of three symbols
    text = {r["target"]: r["text"].split("\n") for r in packs.rendered(packs.trimmed(packs.packs(symbols, symbols, edges, imports), None), imports).collect()}
    part = text["src/a.py::run"]
    assert part[part.index("imports (src/a.py):") :][:7] == ["imports (src/a.py):", "  gear  (from b.gear)", "  bolt  (from b.bolt)", "  run  (from x.y.run)", "  gear  (from other.gear)", "  bolt  (from other.of.bolt)", "  +2 more imports (irrelevant to this pack)"]
    assert "  +7 more imports (irrelevant to this pack)" in text["src/a.py::idle"] and not any("imports" in x for x in text["src/b.py::gear"])


@pytest.mark.parametrize("left", [7, 5])
def test_imports_leave_from_the_last_until_the_rest_fits(world, left):
    """With all imports relevant the title leaves with the last of them."""
    symbols, edges, imports, _ = world
    imports = imports if left == 7 else imports.where("name NOT IN ('far', 'near')")
    one = symbols.where("name = 'run'")
    rows = packs.packs(one, symbols, edges, imports)
    whole = packs.rendered(packs.trimmed(rows, None), imports).first()["text"].split("\n")
    states, named = ["\n".join(whole)], [x for x in whole if "(from " in x]
    for gone in range(1, len(named) + 1):
        lost = named[-gone:] + (["imports (src/a.py):"] if left == 5 and gone == len(named) else [])
        states.append("\n".join(x for x in whole if x not in lost))
    assert len(named) == 5
    for budget in (len(states[0]) // 4 - 1, len(states[3]) // 4, len(states[-1]) // 4):
        want = next(s for s in states if len(s) // 4 <= budget)
        got = packs.rendered(packs.trimmed(rows, budget), imports).first()
        assert (got["text"], got["tokens"]) == (want, len(want) // 4), budget
