"""The verbs: build a map of a source tree, ask it, compare it."""

from __future__ import annotations

import json
import re
import zlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.functions.text import base_name, dir_of, escape_html, signature, terms
from codeloom.operators import budget, change, graph, lean, lookup, packs, rank, resolve, rollups, session
from codeloom.sources import discover, extract, git, mapdoc


class CodeMap:
    """A repository's tables, and the questions asked of them. Every answer is a DataFrame."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], root: str = "."):
        self.spark, self.t, self.root = spark, tables, root

    @classmethod
    def build(cls, spark: SparkSession, root: str, folder: str, subpath: str = "", excludes: tuple[str, ...] = (), max_file_size: int = 1_000_000) -> CodeMap:
        """Discover, extract and resolve a tree, write all tables below ``folder``, and record what they were made from.

        Files of which the folder has the rows (same path and content, made by the same extractor) aren't extracted again;
        without any change to files or options, nothing is written. Contents are read and hashed by the executors, and
        only where size or time of change differ from what is recorded.
        """
        files, skipped = discover.discover(spark, root, subpath, excludes, max_file_size)
        if files.isEmpty():
            raise FileNotFoundError(f"no files to map in {root}")
        options = {"spec_hash": mapdoc.spec_hash(), "subpath": subpath, "excludes": list(excludes), "max_file_size": max_file_size}
        before = mapdoc.provenance(folder)
        same = before is not None and all(before.get(k) == v for k, v in options.items())
        old = mapdoc.stamps(spark, folder) if before is not None and before.get("spec_hash") == options["spec_hash"] else None
        now = cls._hashed(files, root, old)
        if old is not None and same and change.freshness_diff(old, now).isEmpty():
            return cls.open(spark, root, folder)
        now = graph.stored(now)
        n = now.count()
        misses = graph.stored(now if old is None else change.cache_misses(now, old))
        fresh = extract.extract(misses.select("path").repartition(max(1, n // 200)), root)
        if old is not None:
            cache = spark.read.schema(schemas.FILE_MAP).parquet(f"{folder}/file_maps")
            fresh = fresh.unionByName(change.cache_hits(now.select("path", "content_hash"), cache).select(fresh.columns))
        maps = graph.stored(fresh)
        maps.write.mode("overwrite").parquet(f"{folder}/file_maps")
        t = extract.tables(maps)
        mapdoc.save({k: t[k] for k in ("files", "symbols", "imports", "raw_calls", "raw_refs")}, folder)
        mapdoc.save({"stamps": now}, folder)
        t = mapdoc.load(spark, folder)
        mapdoc.save(resolve.call_graph(t["raw_calls"], t["symbols"], t["imports"], t["files"], t["raw_refs"]), folder)
        kept = options | {"git_commit": mapdoc.git_commit(root), "extracted": misses.count(), "skipped": {r["reason"]: r["files"] for r in rollups.skip_reasons(skipped).collect()}}
        Path(folder, "provenance.json").write_text(json.dumps(kept))
        return cls.open(spark, root, folder)

    @staticmethod
    def _hashed(files: DataFrame, root: str, old: DataFrame | None) -> DataFrame:
        """(path, content_hash, stat) of listed files: those whose stat is as recorded keep their hash."""
        now = files.withColumn("stat", F.array("size", "mtime_ns"))
        if old is None:
            return discover.hashed(now, root)
        known = now.join(old.withColumnRenamed("stat", "was"), "path", "left")
        same = known.where(F.col("stat") == F.col("was")).select("path", "content_hash", "stat")
        return same.unionByName(discover.hashed(known.where(F.col("was").isNull() | (F.col("stat") != F.col("was"))), root))

    @classmethod
    def open(cls, spark: SparkSession, root: str, folder: str) -> CodeMap:
        tables = mapdoc.load(spark, folder)
        if tables is None:
            raise FileNotFoundError(f"no map in {folder}")
        tables.setdefault("notes", mapdoc.Notes(f"{folder}/notes.json").table(spark))
        out = cls(spark, tables, root)
        out.folder = folder
        return out

    def status(self) -> DataFrame:
        """(path, change) of files that differ from the map; every file if extraction itself has changed."""
        kept = mapdoc.provenance(self.folder)
        files, _ = discover.discover(self.spark, self.root, kept["subpath"], tuple(kept["excludes"]), kept["max_file_size"])
        old = mapdoc.stamps(self.spark, self.folder)
        if kept["spec_hash"] != mapdoc.spec_hash():
            return change.freshness_diff(old.select("path", F.lit("").alias("content_hash")), discover.hashed(files.withColumn("stat", F.array("size", "mtime_ns")), self.root).select("path", "content_hash"))
        return change.freshness_diff(old, self._hashed(files, self.root, old))

    def without_tests(self) -> CodeMap:
        out = CodeMap(self.spark, rollups.without_tests(self.t), self.root)
        out.folder = getattr(self, "folder", None)
        return out

    def target(self, name: str) -> str:
        found = rank.resolve_target(self.t["symbols"], name).orderBy("test", "path", "qualname").limit(21).collect()
        if not found:
            raise KeyError(f"{name}: nothing found; close: " + ", ".join(r["name"] for r in self.close_names(name).collect()))
        if len(found) > 1:
            raise LookupError(f"{name}: ambiguous: " + ", ".join(r["id"] for r in found[:20]))
        return found[0]["id"]

    def relation(self, name: str, direction: str, limit: int = 50, tokens: int | None = 800) -> DataFrame:
        rows = graph.degrees(graph.related(self.t["edges"], self.t["symbols"], self.target(name), direction), self.t["edges"])
        line = F.concat_ws(":", F.coalesce("path", "module"), F.coalesce("qualname", F.lit("<module>")))
        return budget.fit(rows, [F.coalesce("test", F.lit(False)), F.desc("degree"), F.coalesce("path", "module"), F.col("start_line")], line, tokens, limit)

    def callers(self, name: str, **options) -> DataFrame:
        return self.relation(name, "in", **options)

    def callees(self, name: str, **options) -> DataFrame:
        return self.relation(name, "out", **options)

    def symbol(self, name: str) -> DataFrame:
        return lookup.cards(self.t["symbols"].where(F.col("id") == self.target(name)), self.t["edges"], self.t["notes"])

    def file(self, path: str) -> DataFrame:
        return self.t["symbols"].where((F.col("path") == path) | F.endswith("path", F.lit(f"/{path}"))).orderBy("path", "start_line")

    def uses(self, base: str) -> DataFrame:
        return lookup.uses(self.t["external"], base)

    def outline(self, path: str = ".") -> DataFrame:
        s = self.t["symbols"]
        return lookup.outline(s if path in ("", ".") else s.where((F.col("path") == path) | F.startswith("path", F.lit(f"{path}/"))))

    def lines(self) -> DataFrame:
        """(path, line, text) of the map's files, as far as they can be read."""
        return extract.source_lines(self.t["files"].select("path"), self.root)

    def context(self, name: str, hops: int = 1, tokens: int | None = 800, source: bool = False, task: str | None = None) -> str:
        """The context pack of a symbol (or a file's, if its path is given) as text, trimmed to ``tokens``. ``task`` lets
        neighbours that it means stay longest."""
        symbols, edges = self.t["symbols"], self.t["edges"]
        if not symbols.where(F.col("path") == name).isEmpty():
            rows, head = packs.file_pack(name, symbols, edges), f"context: {name}\n"
        else:
            target = symbols.where(F.col("id") == self.target(name)).select("id")
            scores = packs.pack_scores(packs.neighbours(target, edges, symbols, hops), symbols, edges, self._words(task)) if task else None
            rows, head = packs.packs(target, symbols, edges, self.t["imports"], self.t.get("notes"), self.lines() if source else None, hops, scores), ""
        return head + "".join(r["text"] for r in packs.rendered(packs.trimmed(rows, tokens), self.t["imports"]).collect())

    def _words(self, prompt: str) -> tuple[str, ...]:
        return tuple(r[0] for r in self.spark.range(1).select(F.explode(terms(F.lit(prompt)))).collect())

    def referenced(self, name: str) -> DataFrame:
        """Who refers to a symbol that nothing calls."""
        return lookup.referenced_rows(self.t["referenced"].where(F.col("callee") == self.target(name)), self.t["edges"], self.t["symbols"])

    def coverage_note(self) -> str | None:
        """What an answer leaves out, if files of known languages weren't read."""
        n = {k: v for k, v in (mapdoc.provenance(self.folder) or {}).get("skipped", {}).items() if k.startswith("no parser")}
        return f"{sum(n.values())} files not read: {', '.join(sorted(n))} — this answer may be incomplete" if n else None

    def orient(self, tokens: int = 2000) -> DataFrame:
        """The overview as lines that fit ``tokens``, in order."""
        rows = lean.overview(self.t["files"], self.t["symbols"], self.t["edges"], git.commits(self.spark, self.root))
        return budget.fit(rows, [F.col("number"), F.col("rank")], F.col("line"), tokens, 200)

    def advise(self, path: str, threshold: int = 1000) -> str | None:
        """For a file of ``threshold`` tokens or more: what its outline costs beside it. None for others."""
        full = self.lines().where(F.col("path") == path).groupBy("path").agg(F.floor(F.sum(F.length("text") + 1) / 4).alias("full"))
        for r in lookup.size_advice(full, lookup.outline(self.t["symbols"].where(F.col("path") == path)), threshold).collect():
            return f"{path}: about {r['full']} tokens, its outline about {r['outline']} ({r['percent']} %)"
        return None

    def trace(self, source: str, target: str, max_paths: int = 3) -> DataFrame:
        return graph.shortest_paths(self.t["edges"], self.t["symbols"], self.target(source), self.target(target)).orderBy("path").limit(max_paths)

    def diff(self, rev: str) -> DataFrame:
        """Symbols added, removed or changed since a revision."""
        old = git.revision_files(self.spark, self.root, rev)
        if old is None:
            raise LookupError(f"no revision {rev}")
        now = discover.contents(discover.discover(self.spark, self.root)[0], self.root)
        suffixes = tuple(f".{s}" for x in extract.LANGUAGES for s in x.suffixes)
        known = F.col("path").rlike("(?i)(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
        return change.symbol_diff(*(self._bodies(f.where(known)) for f in (old, now)))

    @staticmethod
    def _bodies(files: DataFrame) -> DataFrame:
        s = extract.tables(extract.extract(files))["symbols"]
        lines = files.select("path", F.split(F.decode("content", "UTF-8"), "\n").alias("all"))
        return s.join(lines, "path").withColumn("body_hash", change.body_hash(F.col("all"), F.col("start_line"), F.col("end_line"))).drop("all")

    def diff_lines(self, rev: str, k: int = 8) -> DataFrame:
        """What ``diff`` finds, as lines with callers, the first ``k`` of each kind."""
        return change.diff_lines(change.with_callers(self.diff(rev), self.t["edges"], self.t["edges"]), k)

    def affected(self, rev: str) -> DataFrame:
        return change.impacted_tests(self.diff(rev), self.t["edges"], self.t["symbols"], self.t["imports"])

    def workset(self, name: str | None = None, rev: str | None = None, most: int = 5, tokens: int | None = 6000) -> DataFrame:
        """(tier, rank, item, cost) of what work on a symbol, or on what changed since a revision, needs to look at."""
        if rev is not None:
            delta = self.diff(rev)
            touched, tests = delta.where("change <> 'removed'").select("id"), change.impacted_tests(delta, self.t["edges"], self.t["symbols"], self.t["imports"])
        else:
            touched = self.t["symbols"].where(F.col("id") == self.target(name))
            tests = change.call_impacts(touched, self.t["edges"], self.t["symbols"])
        rows = rank.workset(self.t["symbols"], self.t["edges"], touched, tests, most)
        return budget.fit(rows.withColumnRenamed("rank", "place"), [F.col("tier"), F.col("place"), F.col("item")], F.col("item"), tokens).select("tier", F.col("place").alias("rank"), "item", "cost")

    def unused(self, roots: tuple[str, ...] = ()) -> DataFrame:
        return rollups.unused(self.t["symbols"], self.t["imports"], self.t["edges"], self.t.get("referenced"), roots)

    def stats(self) -> DataFrame:
        return rollups.stats(self.t["files"], self.t["symbols"], self.t["edges"])

    def summary(self) -> DataFrame:
        return rollups.directories(self.t["files"], self.t["symbols"], self.t["edges"])

    def hotspots(self, by: str = "fan_in", k: int = 10) -> DataFrame:
        return graph.hotspots(self.t["symbols"], self.t["edges"], by, k)

    def lean(self, tokens: int | None = None, dense: bool = False, seen: DataFrame | None = None) -> tuple[str, lean.Report]:
        """The lean map as text, and what it had to leave out."""
        atoms = rank.atoms(self.t["symbols"], self.t["edges"], rollups.churn(git.commits(self.spark, self.root)))
        lines, report = lean.lean(self.t["files"], atoms, self.t["edges"], tokens, dense, seen)
        return lean.text(lines, report), report

    def relevant(self, prompt: str, k: int = 5) -> DataFrame:
        """Files that a prompt is about: nothing if no term matches."""
        files = self.t["symbols"].groupBy("path").agg(F.array_join(F.collect_set("qualname"), " ").alias("names"))
        return rank.task_files(files.select("path", F.concat_ws(" ", "path", "names").alias("text")), self._words(prompt), git.diff_paths(self.root), k=k)

    def close_names(self, name: str) -> DataFrame:
        return rank.close_names(self.t["symbols"], name.rsplit(":", 1)[-1])

    def ledger(self, transcript: str) -> DataFrame:
        return session.sessions(session.facts(session.read_transcript(self.spark, transcript), self.root))

    def export(self, style: str = "mermaid", scope: str = "file", max_nodes: int = 300) -> str:
        """A Mermaid or DOT diagram; refused beyond ``max_nodes`` nodes."""
        found = graph.projection(self.t["edges"], scope)
        if found.select("src").union(found.select("dst")).distinct().limit(max_nodes + 1).count() > max_nodes:
            raise ValueError(f"more than {max_nodes} nodes")
        lines = [r["line"] for r in lookup.diagram(found, style).collect()]
        return "\n".join(["graph LR", *lines] if style == "mermaid" else ["digraph g {", *lines, "}"])

    def markdown(self, path: str, order: str = "path", shards: str | None = None) -> None:
        """The map as Markdown: contents, a section per file and a line per symbol, with links to unique anchors. ``shards``
        names a folder: then each directory has a page there, and ``path`` links to them."""
        sections = budget.running(lookup.section_order(self.t["files"], self.t["symbols"], self.t["edges"], order).withColumn("dir", dir_of(F.col("path"))), [F.col("dir"), *self._section_keys(order)], {}).select("path", "dir", F.col("rank").alias("place"))
        sig = signature(*(F.col(c) for c in ("kind", "qualname", "params", "returns", "path")))
        keys = self.t["files"].select(F.col("path").alias("key")).unionByName(self.t["symbols"].select(F.col("id").alias("key")))
        named = lookup.anchors(keys, ["key"])
        minor = lookup.minor_files(self.t["files"], self.t["symbols"]).select("path", F.lit(True).alias("minor"))
        heads = sections.join(named, F.col("key") == F.col("path")).join(minor, "path", "left").select("place", "dir", "path", F.lit(0).alias("row"), "anchor", F.lit("").alias("text"), F.coalesce("minor", F.lit(False)).alias("minor"))
        rows = graph.degrees(self.t["symbols"], self.t["edges"]).join(named, F.col("key") == F.col("id")).join(sections, "path")
        said = F.concat(F.lit("`"), sig, F.lit("` L"), F.col("start_line").cast("string"), F.lit(", called by "), F.col("fan_in").cast("string"), F.lit(", calls "), F.col("fan_out").cast("string"), F.coalesce(F.concat(F.lit(" — "), "doc"), F.lit("")))
        lines = rows.select("place", "dir", "path", F.col("start_line").alias("row"), "anchor", said.alias("text"), F.lit(False).alias("minor"))
        page = lambda d: (re.sub("[^a-z0-9]+", "-", d.lower()).strip("-") or "x") + f"-{zlib.crc32(d.encode()):08x}.md"
        folder = Path(path).parent / shards if shards else None
        if folder:
            folder.mkdir(parents=True, exist_ok=True)
            for stale in folder.glob("*.md"):
                stale.unlink()
        at, out, folded = None, None, []
        with open(path, "w", encoding="utf-8") as index:
            index.write("# Map\n\n")
            for r in heads.where("NOT minor").orderBy("place").toLocalIterator():
                index.write(f"- [{r['path']}]({f'{shards}/{page(r["dir"])}' if shards else ''}#{r['anchor']})\n")
            for r in heads.unionByName(lines).orderBy("place", "row", "anchor").toLocalIterator():
                if r["dir"] != at:
                    if folded and out:
                        out.write(f"\nAlso there: {', '.join(folded)}\n")
                    at, folded = r["dir"], []
                    if folder and out:
                        out.close()
                    out = open(folder / page(at), "w", encoding="utf-8") if folder else index  # noqa: SIM115
                if r["minor"]:
                    folded.append(r["path"])
                else:
                    out.write(f'\n<a id="{r["anchor"]}"></a>\n## {r["path"]}\n\n' if not r["text"] else f'- <a id="{r["anchor"]}"></a>{r["text"]}\n')
            if folded and out:
                out.write(f"\nAlso there: {', '.join(folded)}\n")
            if folder and out:
                out.close()

    @staticmethod
    def _section_keys(order: str) -> list:
        if order == "fan-in":
            return [F.desc(F.coalesce("file_fan_in", F.lit(0))), F.col("path")]
        return [base_name(F.col("path")), F.col("path")] if order == "name" else [F.col("path")]

    def html(self, path: str, most: int = 10_000_000) -> int:
        """The map as one page with its data as JSON inside: symbols with callers and callees and their lines. Refused beyond
        ``most`` bytes, before anything is written; returns its size."""
        calls = lambda own, other: self.t["edges"].groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("id"), "lines"))).alias(f"{other}s"))
        sig = signature(*(F.col(c) for c in ("kind", "qualname", "params", "returns", "path")))
        rows = self.t["symbols"].join(calls("callee", "caller"), "id", "left").join(calls("caller", "callee"), "id", "left")
        entry = F.to_json(F.struct("id", "path", F.col("start_line").alias("line"), sig.alias("signature"), "doc", "callers", "callees"))
        shown = rows.select("path", "start_line", "id", escape_html(entry).alias("json"))
        size = shown.agg(F.coalesce(F.sum(F.octet_length("json") + 2), F.lit(0)).alias("n")).first()["n"] + len(PAGE)
        if size > most:
            raise ValueError(f"the page has {size} bytes, more than {most}")
        before, after = PAGE.split("@", 1)
        with open(path, "w", encoding="utf-8") as out:
            out.write(before)
            for i, r in enumerate(shown.orderBy("path", "start_line", "id").toLocalIterator()):
                out.write((",\n" if i else "") + r["json"])
            out.write(after)
        return size


#: A page that lists symbols, filters them by name and shows who calls them; "@" stands for the data.
PAGE = """<!doctype html><meta charset="utf-8"><title>Map</title><input id="q" placeholder="name"><div id="out"></div>
<script type="application/json" id="data">[@]</script>
<script>
const all = JSON.parse(document.getElementById("data").textContent), out = document.getElementById("out"), q = document.getElementById("q");
function show() {
  out.replaceChildren(...all.filter(s => s.id.includes(q.value)).slice(0, 200).map(s => {
    const d = document.createElement("details"), h = document.createElement("summary"), b = document.createElement("pre");
    h.textContent = s.path + ":" + s.line + "  " + s.signature;
    b.textContent = [s.doc || "", ...(s.callers || []).map(c => "< " + c.id + " " + c.lines), ...(s.callees || []).map(c => "> " + c.id + " " + c.lines)].join("\n");
    d.append(h, b);
    return d;
  }));
}
q.oninput = show;
show();
</script>
"""
