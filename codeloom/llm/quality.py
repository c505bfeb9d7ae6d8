"""Operator 1: quality rules. Base rules per document, and line frequency across the documents of a host."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WORD_RE, free_names, map_batches, normal_line, stored, without_lines, words_in

#: Tasks that the rows of one frequent line are dealt to.
SALTS = 8
MARKS = "#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def features(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    found = WORD_RE.findall(text)
    seen: set[str] = set()
    repeated_lines = 0
    for line in text.split("\n"):
        if line in seen:
            repeated_lines += 1
        elif WORD_RE.search(line):
            seen.add(line)
    windows = list(zip(found, found[1:], found[2:], strict=False))
    twice = {w for w, n in Counter(windows).items() if n > 1} if len(set(windows)) < len(windows) else ()
    repeated, covered = 0, 0  # covered: words before this position are counted
    if twice:
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(found), sum(map(len, found)), sum(map(text.count, MARKS)), repeated_lines, repeated


def base_features(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The named columns, and the counts that the base rules go by."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        counts = list(zip(*map(features, rows[text_col]), strict=True))
        return {c: rows[c] for c in columns} | {n.split()[0]: c for n, c in zip(FEATURES.split(", "), counts, strict=True)}

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return map_batches(docs, [*columns, text_col], run, f"{kinds}, {FEATURES}")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Lines with words: id, key (of the text), host, place, line (hash of the normalised line), n (words)."""
    text = F.col(text_col)
    # what is of the document comes before the lines, else it would be computed for each line
    whole = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.col(host_col).alias("host"), F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line).alias("all"))
    each = whole.select("id", "key", "host", F.posexplode_outer("all").alias("place", "t")).where("t <> ''")
    return each.select("id", "key", "host", "place", F.xxhash64("t").alias("line"), words_in(F.col("t")).alias("n"))


def host_limits(docs: DataFrame, text_col: str, host_col: str, min_docs: int, max_share: float) -> DataFrame:
    """(host, least): the number of distinct documents from which a line of the host is frequent."""
    texts = docs.select(F.col(host_col).alias("host"), text_key(F.col(text_col)).alias("key")).distinct()
    return texts.groupBy("host").agg(F.greatest(F.lit(min_docs), F.ceil(F.count("*") * F.lit(max_share))).alias("least"))


def frequent_lines(lines: DataFrame, limits: DataFrame, min_docs: int) -> DataFrame:
    """(host, line) of lines that stand in as many distinct documents of their host as its limit says, or more.

    A document counts once for a line, and so do exact copies of its text. Counts are summed before each shuffle, so a
    line that every document has is no hot key.
    """
    counted = lines.select("host", "line", "key").distinct().groupBy("host", "line").agg(F.count("*").alias("docs"))
    limit = limits.select(F.col("host").alias("of"), "least")
    counted = counted.where(F.col("docs") >= min_docs)  # no limit is below it
    return counted.join(limit, F.col("host").eqNullSafe(F.col("of"))).where(F.col("docs") >= F.col("least")).select("host", "line")


def at_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose (host, line) is frequent. The keys of this join are hot by their nature, so the rows
    of a line are dealt to SALTS tasks and the frequent lines, a tenth of all lines at most, go to each of these."""
    salted = frequent.select(F.col("host").alias("at"), F.col("line").alias("often"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    own = F.pmod(F.xxhash64("id", "key"), F.lit(SALTS))
    return lines.join(salted, F.col("host").eqNullSafe(F.col("at")) & (F.col("line") == F.col("often")) & (own == F.col("part"))).drop("at", "often", "part")


def removals(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, max_share: float) -> DataFrame:
    """Per document (id, key, host) with lines to remove: their places, and the words in them (once for repeated rows)."""
    lines = lines_of(docs, id_col, text_col, host_col)
    limits = stored(host_limits(docs, text_col, host_col, min_docs, max_share), "limits")
    frequent = stored(frequent_lines(lines, limits, min_docs), "frequent")
    marked = at_lines(lines, frequent)
    # a repeated row gives each of its places again; a line's place in its text tells them apart from repeated lines
    once = marked.groupBy("id", "key", "host", "place").agg(F.first("n").alias("n"))
    return once.groupBy("id", "key", "host").agg(F.collect_list("place").alias("places"), F.sum("n").alias("removed"))


def _with_removals(docs: DataFrame, left: DataFrame, id_col: str, key: str, host: str, text_col: str, host_col: str, min_docs: int, max_share: float, extra: list[str]) -> DataFrame:
    """``left`` (with the document's id, key of its text, and host) and the places and words to remove."""
    gone = removals(docs, id_col, text_col, host_col, min_docs, max_share)
    gone = gone.select(*(F.col(c).alias(x) for c, x in zip(("id", "key", "host", "places", "removed"), extra, strict=True)))
    return left.join(gone, left[id_col].eqNullSafe(gone[extra[0]]) & (left[key] == gone[extra[1]]) & left[host].eqNullSafe(gone[extra[2]]), "left")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, max_share: float = 0.05, max_removed: float = 0.5) -> DataFrame:
    """Verdicts: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.

    base_failed: under 50 words, or more than half of the words in repeated three-word windows. A line is frequent on a
    host from ``max_share`` of the host's distinct documents on, and from ``min_docs`` at least. Frequent lines are
    removed; a document that loses more than ``max_removed`` of its words is depleted and not kept. Lines compare
    lower-cased, with single spaces; lines without words don't count. Exact copies of a text are one document of the
    host. One row per input row: repeated rows get equal verdicts and don't count as further documents. A null text is
    empty (no words: base_failed). A null id is an id, a null host a host. An empty table gives none. Other columns
    aren't read, so their names can't clash.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), text_key(F.col(text_col)).alias("_key"), F.col(host_col).alias("_host"))
    base = base_features(rows, [id_col, "_key", "_host"], "_text")
    out = _with_removals(docs, base, id_col, "_key", "_host", text_col, host_col, min_docs, max_share, ["_id", "_k", "_h", "_places", "_removed"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce(F.col("_removed"), F.lit(0)).cast("long")
    return out.select(id_col, *(x.split()[0] for x in FEATURES.split(", ")), failed.alias("base_failed"), (~failed & (removed <= max_removed * F.col("n_words"))).alias("kept"), removed.alias("n_removed_words"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, max_share: float = 0.05, max_removed: float = 0.5) -> DataFrame:
    """The documents that ``quality`` keeps, without their frequent lines. All columns stay, whatever their names; only
    ``text_col`` changes. Nulls, repeated rows and empty tables are as in ``quality``."""
    key, *names = free_names(docs, "text_key", "gone_id", "gone_key", "gone_host", "gone_places", "gone_words")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    out = _with_removals(docs, keyed, id_col, key, host_col, text_col, host_col, min_docs, max_share, names)
    failed = free_names(out, "failed", "total")
    judged = map_all(out, text_col, failed)
    places, removed, total = F.col(names[3]), F.coalesce(F.col(names[4]), F.lit(0)), F.col(failed[1])
    kept = judged.where(~F.col(failed[0]) & (removed <= max_removed * total))
    return kept.withColumn(text_col, F.when(places.isNull(), F.col(text_col)).otherwise(without_lines(F.col(text_col), places))).select(*docs.columns)


def map_all(df: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """``df`` with base_failed and n_words under the given names, by an Arrow UDF."""
    @F.arrow_udf("struct<failed: boolean, total: bigint>")
    def judge(texts: pa.Array) -> pa.Array:
        counts = [features(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts], pa.bool_()), pa.array([c[0] for c in counts], pa.int64())], ["failed", "total"])

    found = free_names(df, *names, "judged")[-1]
    return df.withColumn(found, judge(F.col(text_col))).withColumns({names[0]: F.col(f"{found}.failed"), names[1]: F.col(f"{found}.total")}).drop(found)
