"""The lean map: one document of all files that fits a token cap, and the ladder by which it gives up depth.

The ladder never renders twice. Every line's cost is known beforehand, so each rung is a comparison of sums: one row of
totals is read, and where signatures and names are cut is a running sum over the symbols in order of their scores.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import base_name, dir_of, is_test_path, oneline
from codeloom.operators import graph, rollups
from codeloom.operators.budget import running
from codeloom.operators.graph import stored

#: Widths that a file's purpose shrinks through, tokens kept for the header, nodes of a diagram, signatures in dense mode.
WIDTHS, HEADER, DIAGRAM, DENSE = (72, 40, 0), 64, 40, 30
SECTIONS = ("files", "edges", "diagram")


def cost(line: Column) -> Column:
    """Tokens of a line and its end, four characters each."""
    return F.floor((F.length(line) + 1) / 4)


@dataclass
class Report:
    """What the ladder gave up."""

    tokens: int
    cap: int
    mermaid_dropped: bool
    demotable_collapsed: bool
    signatures_dropped: int
    names_dropped: int
    module_edges_dropped: bool
    purpose_width: int
    floored: bool
    signals: int
    already_seen: int

    @property
    def per_signal(self) -> float | None:
        return round(self.tokens / self.signals, 1) if self.signals > 0 else None

    def as_dict(self) -> dict:
        return asdict(self) | {"tokens_per_signal": self.per_signal}

    def header(self) -> list[str]:
        drops = [
            text
            for said, text in (
                (self.mermaid_dropped, "mermaid"), (self.demotable_collapsed, "tests collapsed"), (self.signatures_dropped, f"{self.signatures_dropped} signatures"), (self.names_dropped, f"{self.names_dropped} names"),
                (self.module_edges_dropped, "module edges"), (self.purpose_width < WIDTHS[0], f"purpose→{self.purpose_width}"), (self.already_seen, f"{self.already_seen} already in context"),
            )
            if said
        ]
        head = f"lean map · ~{self.tokens}/{self.cap} tok" + (f" · {self.signals} signals" if self.signals else "") + (f" · dropped: {', '.join(drops)}" if drops else "")
        shed = [d for d in drops if not d.endswith("in context")]
        return [head, *(["  recover: outline of a file, context of a symbol, queries"] if shed else []), ""]


def file_rows(files: DataFrame) -> DataFrame:
    """(dir, path, base, purpose, demotable): demotable if all files of the directory are tests."""
    rows = files.select("path", dir_of(F.col("path")).alias("dir"), base_name(F.col("path")).alias("base"), F.when(F.coalesce("doc", F.lit("")) != "", oneline(F.col("doc"), WIDTHS[0])).otherwise("").alias("purpose"))
    tests = rows.groupBy("dir").agg(F.bool_and(is_test_path(F.col("path"))).alias("demotable"))
    return rows.join(tests, "dir")


def file_line(width: int) -> Column:
    plain = F.concat(F.lit("  "), "base")
    return F.when(F.col("purpose") != "", F.concat(plain, F.lit("  "), oneline(F.col("purpose"), width))).otherwise(plain) if width else plain


def collapsed_line(directory: str, n: str) -> Column:
    return F.concat(directory, F.lit("/  ("), F.col(n).cast("string"), F.when(F.col(n) == 1, " file)").otherwise(" files)"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """(src, line): what each directory calls."""
    found = graph.projection(edges, "dir").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.concat("dst", F.lit("/")))), ", ").alias("to"))
    return found.select("src", F.concat(F.lit("  "), "src", F.lit("/ → "), "to").alias("line"))


def diagram_lines(edges: DataFrame, most: int = DIAGRAM) -> list[str]:
    """The directory graph as a fenced diagram; none without edges or beyond ``most`` directories."""
    from codeloom.operators.lookup import diagram

    found = graph.projection(edges, "dir")
    n = found.select("src").union(found.select("dst")).distinct().limit(most + 1).count()
    if not n or n > most:
        return []
    return ["```mermaid", "\n".join(["graph LR", *(r["line"] for r in diagram(found, "mermaid").collect())]), "```"]


def cap_of(n_files: int, floor: int, budget: int | None = None) -> int:
    """Tokens of a lean map: 3000 and 12 a file, 12000 at most, or the budget; but never under the floor."""
    return max(budget if budget is not None else min(12_000, 3_000 + 12 * n_files), floor)


def lean(files: DataFrame, atoms: DataFrame, edges: DataFrame, budget: int | None = None, dense: bool = False, seen: DataFrame | None = None) -> tuple[DataFrame, Report]:
    """(lines, report). lines: section, dir, path, position, line of the document below its header, in this order.

    files: path, doc. atoms: id, path, name, signature, score, start_line, qualname (``rank.atoms``); what has a low
    score goes first. In order: the diagram, symbols of directories that are all tests, signatures, names, lines
    between directories, and purposes of files, each only if the document is still too large. ``dense`` keeps the
    signatures of the highest scores alone; ``seen`` (id): symbols that are left out as known.
    """
    rows = stored(file_rows(files))
    marked = atoms.join(rows.select("path", "dir", "demotable"), "path") if "demotable" not in atoms.columns else atoms.drop("demotable").join(rows.select("path", "dir", "demotable"), "path")
    known = marked.withColumn("seen", F.lit(False)) if seen is None else marked.join(seen.select("id").distinct().withColumn("seen", F.lit(True)), "id", "left").fillna(False, ["seen"])
    indent = lambda c: cost(F.concat(F.lit("    "), c))
    priced = known.withColumns({"s": F.when(F.col("seen"), 0).otherwise(indent("signature")), "n": F.when(F.col("seen"), 0).otherwise(indent("name"))})
    live = running(priced.where("NOT demotable"), [F.col("score"), F.col("id")], {"before_s": F.col("s") - F.col("n"), "before_n": F.col("n")})
    live = stored(live)
    n_live = live.count()
    is_dense = F.lit(dense) & (F.col("rank") <= n_live - DENSE)  # the order is ascending: the last ones stay
    widths = {f"w{w}_{side}": F.sum(F.when(F.col("demotable") == (side == "test"), cost(file_line(w)))) for w in WIDTHS for side in ("prod", "test")}
    per_dir = rows.groupBy("dir", "demotable").agg(F.count("*").alias("n"))
    sums = rows.agg(F.count("*").alias("files"), F.count_if(~F.col("demotable")).alias("prod_files"), *(F.coalesce(c, F.lit(0)).alias(n) for n, c in widths.items()))
    dirs = per_dir.agg(*(F.coalesce(F.sum(F.when(F.col("demotable") == test, c)), F.lit(0)).alias(n) for n, test, c in (("head_prod", False, cost(F.concat("dir", F.lit("/")))), ("head_test", True, cost(F.concat("dir", F.lit("/")))), ("folded", True, cost(collapsed_line("dir", "n"))))))
    tests = priced.agg(F.coalesce(F.sum(F.when(F.col("demotable"), F.col("s"))), F.lit(0)).alias("test_atoms"))
    symbols = live.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("sigs"), F.coalesce(F.sum("n"), F.lit(0)).alias("names"), F.coalesce(F.sum(F.when(is_dense, F.col("s") - F.col("n"))), F.lit(0)).alias("dense"), F.count_if("seen").alias("seen"))
    links = edge_lines(edges)
    link = links.agg(F.count("*").alias("n_links"), F.coalesce(F.sum(cost(F.col("line"))), F.lit(0)).alias("links"))
    one = sums.join(dirs).join(tests).join(symbols).join(link).first()  # a row of totals
    drawn = diagram_lines(edges)
    x = one.asDict()
    edge_cost = x["links"] + len("module edges:\n") // 4 if x["n_links"] else 0
    drawn_cost = sum((len(line) + 1) // 4 for line in drawn)
    floor = x["head_prod"] + x["w0_prod"] + x["folded"] + HEADER
    cap = cap_of(x["files"], floor, budget)
    room = cap - HEADER

    def total(mermaid: bool, folded: bool, symbols: int, edges: bool, width: int) -> int:
        prod = x["head_prod"] + x[f"w{width}_prod"]
        test = x["folded"] if folded else x["head_test"] + x[f"w{width}_test"] + x["test_atoms"]
        return prod + test + symbols + edge_cost * edges + drawn_cost * mermaid

    symbol_cost = x["sigs"] - x["dense"]
    mermaid = total(True, False, symbol_cost, True, WIDTHS[0]) <= room
    folded = not mermaid and total(False, False, symbol_cost, True, WIDTHS[0]) > room
    rest = total(mermaid, folded, 0, True, WIDTHS[0])
    # a signature goes while what is there before it is too much; then names likewise
    sigs_before = symbol_cost - F.when(F.lit(dense) & (F.col("rank") <= max(n_live - DENSE, 0) + 1), 0).otherwise(F.col("before_s") - x["dense"])
    no_sig = (rest + sigs_before > room) if n_live else F.lit(False)
    if dense:  # those without a signature anyway: going through them saves nothing
        no_sig = F.when(is_dense, True).otherwise(no_sig)
    all_names = rest + x["names"] > room
    no_name = F.lit(all_names) & (rest + x["names"] - F.col("before_n") > room)
    formed = stored(live.withColumn("form", F.when(F.col("seen"), "none").when(no_name, "none").when(no_sig, "name").otherwise("sig")).withColumns({"no_sig": no_sig, "no_name": no_name}))
    after = formed.agg(F.coalesce(F.sum(F.when(F.col("form") == "sig", F.col("s")).when(F.col("form") == "name", F.col("n"))), F.lit(0)).alias("c"), F.count_if("no_sig").alias("no_sig"), F.count_if("no_name").alias("no_name"), F.count_if(F.col("form") != "none").alias("shown")).first()
    linked = total(mermaid, folded, after["c"], True, WIDTHS[0]) <= room
    width = WIDTHS[0]
    for w in WIDTHS[1:]:
        if total(mermaid, folded, after["c"], linked, width) > room:
            width = w
    report = Report(0, cap, not mermaid, folded, after["no_sig"], after["no_name"], not linked, width, width == 0, (x["prod_files"] if folded else x["files"]) + after["shown"], x["seen"])
    report.tokens = total(mermaid, folded, after["c"], linked, width) + sum((len(line) + 1) // 4 for line in report.header())

    # the document
    head = per_dir.select("dir", "demotable", F.lit("").alias("path"), F.lit(0).cast("long").alias("position"), F.when(F.col("demotable") & F.lit(folded), collapsed_line("dir", "n")).otherwise(F.concat("dir", F.lit("/"))).alias("line"))
    named = rows.select("dir", "demotable", "path", F.lit(0).cast("long").alias("position"), file_line(width).alias("line"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("start_line", "qualname", "id")).cast("long")
    of_tests = priced.where("demotable AND NOT seen").withColumn("form", F.lit("sig"))
    both = formed.select("dir", "demotable", "path", "id", "start_line", "qualname", "name", "signature", "form").unionByName(of_tests.select("dir", "demotable", "path", "id", "start_line", "qualname", "name", "signature", "form"))
    shown = both.withColumn("position", place).where("form <> 'none'").select("dir", "demotable", "path", "position", F.concat(F.lit("    "), F.when(F.col("form") == "sig", F.col("signature")).otherwise(F.col("name"))).alias("line"))
    body = named.unionByName(shown)
    body = head.unionByName(body.where("NOT demotable") if folded else body).select(F.lit("files").alias("section"), "dir", "path", "position", "line")
    if linked and x["n_links"]:
        title = edges.sparkSession.createDataFrame([("edges", "", "", 0, "module edges:")], body.schema)
        body = body.unionByName(title).unionByName(links.select(F.lit("edges").alias("section"), F.col("src").alias("dir"), F.lit("").alias("path"), F.lit(1).cast("long").alias("position"), "line"))
    if mermaid and drawn:
        body = body.unionByName(edges.sparkSession.createDataFrame([("diagram", "", "", i, line) for i, line in enumerate(drawn)], body.schema))
    return body, report


def text(lines: DataFrame, report: Report) -> str:
    """The document as one text: it is as small as its cap."""
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    return "\n".join([*report.header(), *(r["line"] for r in lines.orderBy(order, "dir", "path", "position").select("line").toLocalIterator())])


def overview(files: DataFrame, symbols: DataFrame, edges: DataFrame, commits: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(section, rank, line) of a map's overview: coverage, languages, directories, the most called and calling symbols, the
    largest files, files at risk, entry points. Each section is a top-k."""
    n = F.row_number

    def part(number: int, name: str, rows: DataFrame, order: list[Column], line: Column) -> DataFrame:
        return rows.limit(k).select(F.lit(number).alias("number"), F.lit(name).alias("section"), n().over(Window.orderBy(*order)).alias("rank"), line.alias("line"))

    number = lambda c: F.col(c).cast("string")
    place = F.concat(F.col("path"), F.lit(":"), number("start_line"))
    stats = rollups.stats(files, symbols, edges)
    out = part(0, "coverage", stats, [F.lit(1)], F.concat(number("files"), F.lit(" files, "), number("symbols"), F.lit(" symbols, "), number("edges"), F.lit(" calls")))
    parts = [
        part(1, "languages", rollups.language_mix(files, symbols), [F.desc("files"), F.col("language")], F.concat(F.coalesce("language", F.lit("?")), F.lit(": "), number("files"), F.lit(" files, "), number("symbols"), F.lit(" symbols"))),
        part(2, "directories", rollups.directories(files, symbols, edges, k), [F.desc("symbols"), F.col("dir")], F.concat("dir", F.lit("/: "), number("files"), F.lit(" files, "), number("symbols"), F.lit(" symbols, "), number("internal"), F.lit(" calls inside, "), number("cross"), F.lit(" across"))),
        part(3, "most called", graph.hotspots(symbols, edges, "fan_in", k), [F.desc("fan_in"), F.col("path"), F.col("start_line")], F.concat("qualname", F.lit(" ("), place, F.lit("): "), number("fan_in"), F.lit(" callers"))),
        part(4, "most calling", graph.hotspots(symbols, edges, "fan_out", k), [F.desc("fan_out"), F.col("path"), F.col("start_line")], F.concat("qualname", F.lit(" ("), place, F.lit("): "), number("fan_out"), F.lit(" callees"))),
        part(5, "largest files", rollups.largest_files(symbols, k), [F.desc("symbols"), F.col("path")], F.concat("path", F.lit(": "), number("symbols"), F.lit(" symbols"))),
        part(7, "entry points", rollups.entry_points(symbols, edges), [F.col("path"), F.col("start_line")], F.concat("qualname", F.lit(" ("), place, F.lit(")"))),
    ]
    if commits is not None:
        parts.append(part(6, "at risk", rollups.churn_hotspots(commits, symbols, edges, k=k), [F.desc("score"), F.col("path")], F.concat("path", F.lit(": "), number("commits"), F.lit(" commits, "), number("fan_in"), F.lit(" callers"))))
    for p in parts:
        out = out.unionByName(p)
    return out
