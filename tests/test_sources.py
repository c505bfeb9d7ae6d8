"""Extraction, discovery, map documents, incremental updates and the API on small trees."""

import json
import subprocess

import pytest

from codeloom.api import CodeMap
from codeloom.sources import discover, extract, mapdoc
from codeloom.streaming.incremental import sink

PY = '"""Util."""\nfrom .b import helper as h\n\n\n@dec\ndef run(a: int, *b) -> str:\n    """Runs."""\n    return h(a)\n\n\nclass K:\n    def m(self):\n        self.n()\n\n    def n(self):\n        pass\n'
SOURCES = {
    "r.rs": ("use std::{fs, io::{self, Read as R}};\n/// A point.\npub struct P { x: i32 }\nimpl P {\n  pub fn new(x: i32) -> Self { helper(x) }\n}\nfn helper(a: u8) -> u8 { a }\n", ["P", "P.new", "helper"], ["fs", "io", "R"]),
    "c.cpp": ("#include <a/b.h>\nnamespace n {\nclass A {\n  int go(int x) { return f(x); }\n};\n}\n", ["n.A", "n.A.go"], ["b"]),
    "t.ts": ('import D, { a as b } from "./m";\nexport class K {\n  run(a?: string): void { this.go(a); new D(); }\n}\nexport const f = (q: number): number => { return b(q); };\n', ["K", "K.run", "f"], ["D", "b"]),
    "g.go": ('package x\nimport (\n  f "fmt"\n  "os/exec"\n)\ntype S struct { a int }\nfunc (s *S) Run(n int) error { f.Println(n) }\n', ["S", "S.Run"], ["f", "exec"]),
    "A.java": ("import java.util.List;\npublic class App {\n  public App(int x) { }\n  enum Kind { A }\n}\n", ["App", "App.App", "App.Kind"], ["List"]),
    "s.rb": ("class Store\n  def get(k)\n    fetch(k)\n  end\nend\n", ["Store", "Store.get"], []),
}


def test_python():
    m = extract.extract_file("p/a.py", PY.encode())
    assert [(s["qualname"], s["kind"]) for s in m["symbols"]] == [("run", "function"), ("K", "class"), ("K.m", "method"), ("K.n", "method")]
    assert m["symbols"][0]["params"] == [{"name": "a", "type": "int"}, {"name": "*b", "type": None}] and m["symbols"][0]["decorated"] and m["doc"] == "Util."
    assert [(c["caller_id"], c["text"], c["receiver"]) for c in m["calls"]] == [("p/a.py::run", "h", None), ("p/a.py::K.m", "self.n", "self")]
    assert m["imports"] == [{"name": "h", "source": ".b.helper"}]
    assert extract.extract_file("x.py", b"def (")["error"].startswith("SyntaxError") and extract.extract_file("x.zz", b"")["symbols"] == []
    twice = extract.extract_file("a.py", b"def f(): pass\ndef f(): pass\n")["symbols"]
    assert [s["id"] for s in twice] == ["a.py::f", "a.py::f#2"]


@pytest.mark.parametrize("path", SOURCES)
def test_languages(path):
    text, symbols, imports = SOURCES[path]
    m = extract.extract_file(path, text.encode())
    assert sorted(s["qualname"] for s in m["symbols"]) == sorted(symbols) and [i["name"] for i in m["imports"]] == imports


GENERIC = {
    "a.lua": ("-- Makes one.\nfunction M.new(a, b)\n  return setup(a)\nend\nfunction Store:put(key)\n  M.new(key, 1)\nend\n", ["M.new", "Store.put"], [("Store.put", "new")]),
    "a.php": ("<?php\nclass Store {\n  public function put($k) { return norm($k); }\n}\nfunction norm($x) { return $x; }\n", ["Store", "Store.put", "norm"], [("Store.put", "norm")]),
    "a.kt": ("class Store(val x: Int) {\n  fun put(k: String): Int {\n    return norm(k)\n  }\n}\nfun norm(k: String) = k\n", ["Store", "Store.put", "norm"], [("Store.put", "norm")]),
    "a.clj": ("(defn norm [x] (inc x))\n(defn put [k]\n  (norm k))\n", ["norm", "put"], [("put", "norm")]),
    "a.ex": ("defmodule Store do\n  def put(k, v) do\n    norm(k)\n  end\n  defp norm(x), do: x\nend\n", ["Store", "Store.put", "Store.norm"], [("Store.put", "norm")]),
    "a.sh": ("norm() {\n  echo $1\n}\nfunction put {\n  norm a\n}\n", ["norm", "put"], []),
    "a.gd": ("func put(k):\n\tnorm(k)\nfunc norm(x):\n\treturn x\n", ["put", "norm"], [("put", "norm")]),
}


@pytest.mark.parametrize("path", GENERIC)
def test_generic_languages(path):
    text, symbols, calls = GENERIC[path]
    m = extract.extract_file(path, text.encode())
    assert m["error"] is None and sorted(s["qualname"] for s in m["symbols"]) == sorted(symbols)
    made = {((c["caller_id"] or "").split("::")[-1], c["name"]) for c in m["calls"]}
    assert set(calls) <= made


def test_owners_are_the_shortest_spans():
    import random

    rng = random.Random(3)
    for _ in range(50):
        spans = []
        for i in range(rng.randrange(8)):
            a = rng.randrange(60)
            spans.append((a, a + rng.randrange(1, 30), f"s{i}"))
        owner = extract.owners(spans)
        for at in range(100):
            assert owner(at) == min(((e - s, e, n) for s, e, n in spans if s <= at <= e), default=(0, 0, None))[2]


def test_ignore_files(spark, tmp_path):
    """The last rule that matches decides, rules of inner folders count there, and known languages without a parser are
    reported."""
    for name in ("a.py", "gen/b.py", "gen/keep.py", "sub/c.py", "sub/d.py", "sub/deep/d.py", "page.astro", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# made\ngen/*\n!gen/keep.py\n")
    (tmp_path / "sub/.gitignore").write_text("/d.py\n")
    assert [f for f in sorted(discover.walk_files(tmp_path)) if f.endswith(".py")] == ["a.py", "gen/keep.py", "sub/c.py", "sub/deep/d.py"]
    assert discover.remember_ignored(str(tmp_path), ["sub/*", "!sub/c.py", "sub/*"]) == ["sub/*", "!sub/c.py"] and discover.remember_ignored(str(tmp_path), ["sub/*"]) == []
    files, skipped = discover.discover(spark, str(tmp_path))
    assert {r["path"] for r in files.collect()} == {"a.py", "gen/keep.py", "sub/c.py"}
    assert {(r["path"], r["reason"]) for r in skipped.collect()} == {("page.astro", "no parser (astro)"), ("sub/deep/d.py", "ignored"), ("sub/.gitignore", "ignored")}


def test_map_of_a_repository(spark, tmp_path):
    root, out = tmp_path / "repo", str(tmp_path / "map")
    (root / "pkg").mkdir(parents=True)
    (root / "tests").mkdir()
    (root / "pkg/__init__.py").write_text("from .a import run\n")
    (root / "pkg/a.py").write_text(PY)
    (root / "pkg/b.py").write_text("def helper(x):\n    return x\n")
    (root / "tests/test_a.py").write_text("from pkg.a import run\n\n\ndef test_run():\n    run(1)\n")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@example.com", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    m = CodeMap.build(spark, str(root), out)
    assert [r["id"] for r in m.callers("helper").collect()] == ["pkg/a.py::run"]
    assert m.trace("test_run", "helper").first()["path"] == ["tests/test_a.py::test_run", "pkg/a.py::run", "pkg/b.py::helper"]
    assert m.status().isEmpty() and m.symbol("K.m").first()["fan_out"] == 1
    assert {r["path"] for r in m.t["files"].collect()} == {"pkg/__init__.py", "pkg/a.py", "pkg/b.py", "tests/test_a.py"}
    written = (tmp_path / "map/provenance.json").stat().st_mtime_ns
    CodeMap.build(spark, str(root), out)  # nothing changed: nothing is written
    assert (tmp_path / "map/provenance.json").stat().st_mtime_ns == written and mapdoc.provenance(out)["extracted"] == 4
    pack = m.context("run", source=True)
    assert pack.split("\n")[0] == "context: pkg/a.py:run" and "  note" not in pack and "callers:" in pack and "tests/test_a.py:4  test_run()" in pack and "> 5: run(1)" in pack
    assert "source:" in pack and "return h(a)" in pack and m.context("run", tokens=1).count("\n") >= 2 and "callers:" not in m.context("run", tokens=1)
    of_file = m.context("pkg/b.py")
    assert of_file.startswith("context: pkg/b.py\nsymbols:\n") and "[1] pkg/a.py:6" in of_file
    document, report = m.lean()
    assert document.startswith("lean map · ~") and "pkg/" in document and "    helper(x)" in document and report.tokens <= report.cap
    small, shed = m.lean(tokens=1)
    assert shed.floored and shed.demotable_collapsed and "recover" in small and "helper" not in small
    assert m.orient(tokens=100_000).where("section = 'coverage'").first()["line"].startswith("4 files") and m.advise("pkg/b.py") is None and "tokens" in m.advise("pkg/b.py", threshold=1)
    assert m.coverage_note() is None and m.html(str(tmp_path / "map.html")) > 1000
    page = (tmp_path / "map.html").read_text()
    data = json.loads(page.split('id="data">')[1].split("</script>")[0])
    assert {s["id"] for s in data} == {r["id"] for r in m.t["symbols"].collect()}
    with pytest.raises(ValueError, match="more than 10"):
        m.html(str(tmp_path / "none.html"), most=10)
    assert not (tmp_path / "none.html").exists()
    assert {r["tier"] for r in m.workset("helper").collect()} >= {0, 1, 2}
    (root / "pkg/b.py").write_text("def helper(x):\n    return x + 1\n")
    assert [(r["path"], r["change"]) for r in m.status().collect()] == [("pkg/b.py", "changed")]
    assert [(r["id"], r["change"]) for r in m.diff("HEAD").collect()] == [("pkg/b.py::helper", "changed")]
    assert [(r["path"], r["tier"]) for r in m.affected("HEAD").collect()] == [("tests/test_a.py", "transitive")]
    with pytest.raises(KeyError):
        m.target("helpr_nothing")
    mapdoc.write_json(m.t, str(tmp_path / "map.json"))
    again = mapdoc.read_json(spark, str(tmp_path / "map.json"))
    assert again["edges"].count() == m.t["edges"].count() and again["imports"].count() == m.t["imports"].count() and mapdoc.read_json(spark, str(tmp_path / "none.json")) is None
    notes = mapdoc.Notes(str(tmp_path / "map/notes.json"))
    notes.add("pkg/b.py::helper", "slow")
    notes.add("pkg/b.py::helper", "old")
    assert notes.remove("pkg/b.py::helper", 1) == 1 and [r["text"] for r in notes.table(spark).collect()] == ["old"]
    assert "n0 --> n1" in m.export() or "n1 --> n0" in m.export()
    m.markdown(str(tmp_path / "map.md"))
    text = (tmp_path / "map.md").read_text()
    assert "## pkg/a.py" in text and "- [pkg/a.py](#pkg-a-py)" in text and '<a id="pkg-a-py"></a>' in text and text.count("Also there: pkg/__init__.py") == 1
    m.markdown(str(tmp_path / "index.md"), order="fan-in", shards="pages")
    assert len(list((tmp_path / "pages").glob("*.md"))) == 2 and "(pages/pkg-" in (tmp_path / "index.md").read_text()
    again = CodeMap.build(spark, str(root), out)  # one file is extracted anew
    assert mapdoc.provenance(out)["extracted"] == 1 and again.status().isEmpty() and again.t["symbols"].count() == 6
    assert notes.prune({"pkg/a.py::run"}) == 1 and notes.table(spark).isEmpty()
    assert [r["line"] for r in again.diff_lines("HEAD").collect()] == ["~ pkg/b.py::helper  <- pkg/a.py::run"] and again.workset(rev="HEAD").count() > 2


def test_incremental_batches(spark, tmp_path):
    seen, write = [], sink(str(tmp_path / "cache"), lambda n, c: seen.append(c))
    files = lambda **f: spark.createDataFrame([(k + ".py", v.encode()) for k, v in f.items()], "path string, content binary")
    write(files(a="def f(): pass", b="x = 1"), 0)
    write(files(a="def f(): pass", b="x = 1"), 1)
    write(files(a="def g(): pass", c="y = 1"), 2)
    assert seen == [{"reused": 0, "extracted": 2}, {"reused": 2, "extracted": 0}, {"reused": 0, "extracted": 2}]


def test_another_extractor_has_a_cache_of_its_own(spark, tmp_path, monkeypatch):
    from codeloom.streaming import incremental

    files = spark.createDataFrame([("a.py", b"def f(): pass")], "path string, content binary")
    assert incremental.update(spark, str(tmp_path), files, 1) == {"reused": 0, "extracted": 1}
    assert incremental.update(spark, str(tmp_path), files, 2) == {"reused": 1, "extracted": 0}
    monkeypatch.setattr(incremental, "spec_hash", lambda: "other")
    assert incremental.update(spark, str(tmp_path), files, 3) == {"reused": 0, "extracted": 1}
