"""Operator 2: line deduplication, near duplicates included, by a deletion-neighbourhood join. DataFrame functions only.

Edit distance counts words: put in, left out or replaced. A variant of a line leaves out some words and blanks some
others, as many together as the edit bound at most. Two lines that blank h words each and leave out d and e words are
within distance h + d + e if what is left is equal; and lines within the bound have such equal variants. So equal
variants are joined, and a line goes if a variant's group has an earlier line whose deletions the bound still allows.

At bound 1 a variant's key comes from the sum and the exclusive or of hashes of neighbouring words, so that each
follows from the line's by three terms. Only lines that share their first or last words with another distinct line can
be within distance 1, so only these emit variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import free_names, normal_line, stored, without_lines, words_in


def pair_hashes(words: Column) -> Column:
    """Hashes of each two words in a row, and of the ends with nothing."""
    ahead = F.concat(F.array(F.lit("")), words)
    after = F.concat(words, F.array(F.lit("")))
    return F.zip_with(ahead, after, lambda a, b: F.xxhash64(a, b))


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_words: int, exact_min_words: int) -> DataFrame:
    """Lines of words, ``exact_min_words`` or more: id, key (of the text), pos, h1 and h2 (of the normalised line), and
    anchors (null under ``min_words`` words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # what is of the document comes before the lines, else it would be computed for each line
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.transform(F.split(text, "\n"), normal_line).alias("all"))
    each = whole.select("id", "key", F.posexplode_outer("all").alias("pos", "line")).where(F.col("line") != "")
    each = each.withColumn("n", words_in(F.col("line"))).where(F.col("n") >= exact_min_words)
    each = each.withColumns({"a": anchor_words(F.col("n")), "b": anchor_words(F.col("n") + 1)})
    return each.select("id", "key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.when(F.col("n") >= min_words, anchors(F.col("line"), F.col("a"), F.col("b"))).alias("anchors"))


def anchor_words(n: Column) -> Column:
    """The most words that fit twice into n - 1, rounded down to a power of two from four on."""
    out = F.floor((n - 1) / 2).cast("int")
    powers = F.when(out < 4, out)
    for i in range(2, 31):  # 2 ** 30 words don't fit into a line
        powers = powers.when(out < 1 << (i + 1), 1 << i)
    return powers


def anchors(line: Column, a: Column, b: Column) -> Column:
    """Hashes of what a line shares with any line within distance 1: the first or the last words, since the edit is in
    one place. ``a`` and ``b``: ``anchor_words`` of the line, and of a line of one word more; where they differ, the
    line has anchors of both sizes."""

    def both(a: Column) -> Column:
        return F.array(F.xxhash64(F.lit(0), a, F.call_function("substring_index", line, F.lit(" "), a)), F.xxhash64(F.lit(1), a, F.call_function("substring_index", line, F.lit(" "), -a)))

    return F.when(a == b, both(a)).otherwise(F.concat(both(a), both(b)))


def variants(lines: DataFrame) -> DataFrame:
    """The deletion neighbourhood of each line (h1, h2, first, words): size, variant (its key), at (1, 2, ...; 0: whole)."""
    w = F.col("words")
    ends = F.concat(F.array(F.lit("")), w, F.array(F.lit("")))
    near = lines.withColumn("pairs", pair_hashes(w)).withColumn("over", F.zip_with(F.slice(ends, 1, F.size(w)), F.slice(ends, 3, F.size(w)), lambda a, b: F.xxhash64(a, b)))
    total = F.aggregate("pairs", F.lit(0).cast("long"), lambda a, x: a + F.shiftright(x, 20))
    bits = F.aggregate("pairs", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    near = near.withColumns({"total": total, "bits": bits})

    def without(over: Column, i: Column) -> Column:
        left, right = F.get(F.col("pairs"), i), F.get(F.col("pairs"), i + 1)
        rest = F.col("total") - F.shiftright(left, 20) - F.shiftright(right, 20) + F.shiftright(over, 20)
        return F.xxhash64(rest, F.col("bits").bitwiseXOR(left).bitwiseXOR(right).bitwiseXOR(over))

    cut = F.concat(F.array(F.xxhash64("total", "bits")), F.transform("over", without))
    each = near.select("h1", "h2", "first", F.size(w).alias("n"), F.posexplode(cut).alias("at", "variant"))
    return each.withColumn("size", F.when(F.col("at") == 0, F.col("n")).otherwise(F.col("n") - 1)).drop("n")


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within edit distance 1: after their common start, what one edit leaves is equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False)).cast("int")  # the first difference; 0: none

    def rest(x: Column, start: Column) -> Column:
        return F.slice(x, start, F.greatest(F.size(x) - start + 1, F.lit(0)))

    return (
        F.when(at == 0, True)
        .when(F.size(a) == F.size(b), rest(a, at + 1) == rest(b, at + 1))
        .when(F.size(a) == F.size(b) + 1, rest(a, at + 1) == rest(b, at))
        .when(F.size(a) + 1 == F.size(b), rest(a, at) == rest(b, at + 1))
        .otherwise(False)
    )


def candidate_lines(docs: DataFrame, lines: DataFrame, distinct: DataFrame, id_col: str, text_col: str, bound: int) -> DataFrame:
    """(h1, h2, first, words) of the distinct lines that may have a near one: at bound 1 those that share an anchor
    with another distinct line, beyond it all of ``min_words`` words."""
    if bound == 1:
        each = distinct.select("h1", F.explode("anchors").alias("anchor"))
        # stored, so that both sides of the join have their own exchange and the rows of a common anchor are split
        shared = stored(each.groupBy("anchor").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("anchor"), "shared")
        some = each.join(shared, "anchor", "left_semi").select("h1").distinct()
    else:
        some = distinct.where("anchors IS NOT NULL").select("h1").distinct()
    wanted = distinct.join(some, "h1", "left_semi").select(F.col("first.id").alias("id_"), F.col("first.key").alias("key_"), F.struct(F.col("first.pos").alias("pos"), "h1", "h2").alias("line"))
    per_doc = wanted.groupBy("id_", "key_").agg(F.collect_list("line").alias("wanted"))  # as many as a text has lines
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = texts.join(per_doc, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")))
    parts = found.select("id", "key", F.split("text", "\n").alias("all"), "wanted")
    named = parts.select("id", "key", F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["pos"].alias("pos"), F.get(F.col("all"), w["pos"]).alias("line"))).alias("lines"))
    each = named.select("id", "key", F.explode("lines").alias("w"))
    return each.select("w.h1", "w.h2", F.struct("id", "key", F.col("w.pos").alias("pos")).alias("first"), F.split(normal_line(F.col("w.line")), " ").alias("words"))


def near_lines(some: DataFrame) -> DataFrame:
    """(h1, h2) of the lines (h1, h2, first, words) that have an earlier line within distance 1.

    A group of equal variants is never paired up: its earliest line stands for it, which every other line of the
    group is within distance 1 of (each differs from it in the word dropped, at one place).
    """
    every = variants(some)
    places = every.groupBy("size", "variant", "at").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    # rows of places in a window are at most as many as a line has words, however large the group is
    same = Window.partitionBy("size", "variant")
    spread = places.withColumns({"of_all": F.min("least").over(same), "of_whole": F.min(F.when(F.col("at") == 0, F.col("least"))).over(same), "total": F.sum("n").over(same)}).where("total > 1")
    group = stored(spread.select("size", "variant", "at", F.when(F.col("at") == 0, F.col("of_all")).otherwise(F.least("least", "of_whole")).alias("earliest")), "groups")
    pairs = every.join(group, ["size", "variant", "at"]).where(F.col("earliest") < F.col("first")).select("h1", "h2", "earliest").distinct()
    words_of = some.select(F.col("first").alias("earliest"), F.col("words").alias("other"))
    # only lines are hot here that stand for a large group: the rows of one are split, as both sides have an exchange
    verified = pairs.join(some.select("h1", "h2", "words"), ["h1", "h2"]).join(words_of, "earliest").where(within_one(F.col("words"), F.col("other")))
    return verified.select("h1", "h2").distinct()


def near_lines_beyond(some: DataFrame, bound: int) -> DataFrame:
    """As ``near_lines`` for any edit bound. A line of n words has about (2 n) ** bound / bound! variants.

    Words are gone through from left to right, and each edit blanks one or leaves it out. Members of a group that left
    out d words are within the bound of those that left out up to bound - blanks - d.
    """
    blank = F.lit("\x00")
    w, at = F.col("words"), F.col("at")
    step = some.select("h1", "h2", "first", "words", F.lit(0).alias("at"), F.lit(0).alias("blanks"), F.lit(0).alias("cuts"))
    every = step
    for _ in range(bound):
        spots = step.where(at < F.size(w)).select("h1", "h2", "first", "words", "blanks", "cuts", F.explode(F.sequence(at + 1, F.size(w))).alias("i"))
        i, before, behind = F.col("i"), F.slice(w, F.lit(1), F.col("i") - 1), F.slice(w, F.col("i") + 1, F.size(w))
        blanked = spots.select("h1", "h2", "first", F.concat(before, F.array(blank), behind).alias("words"), i.alias("at"), (F.col("blanks") + 1).alias("blanks"), "cuts")
        step = blanked.unionByName(spots.select("h1", "h2", "first", F.concat(before, behind).alias("words"), (i - 1).alias("at"), "blanks", (F.col("cuts") + 1).alias("cuts")))
        every = every.unionByName(step)
    keyed = every.select("h1", "h2", "first", F.size(w).alias("size"), F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), "blanks", "cuts")
    group = ["size", "k1", "k2", "blanks"]
    least = keyed.groupBy(*group, "cuts").agg(F.min("first").alias("least"))
    reach = least.select(*group, F.explode(F.sequence(F.lit(0), bound - F.col("blanks") - F.col("cuts"))).alias("cuts"), "least").groupBy(*group, "cuts").agg(F.min("least").alias("earliest"))
    # what remains is equal by 128 bits of hash, and the edits that lead to it are counted: that is the verification
    near = keyed.join(stored(reach, "reach"), [*group, "cuts"]).where(F.col("earliest") < F.col("first"))
    return near.select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, exact_min_words: int, bound: int) -> DataFrame:
    """Per document (id, key) with duplicates: places of lines equal to an earlier line (exact), and of near ones."""
    lines = stored(lines_of(docs, id_col, text_col, min_words, exact_min_words), "lines")
    distinct = stored(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "key", "pos")).alias("first"), F.count("*").alias("n"), F.first("anchors").alias("anchors")), "distinct")
    gone = distinct.where("n > 1").select("h1", "h2", "first", F.lit(None).cast("boolean").alias("near"))
    if bound:
        some = stored(candidate_lines(docs, lines, distinct, id_col, text_col, bound).dropDuplicates(["h1", "h2"]), "candidates")
        near = (near_lines(some) if bound == 1 else near_lines_beyond(some, bound)).withColumn("near", F.lit(True))
        gone = distinct.join(near, ["h1", "h2"], "left").where("n > 1 OR near").select("h1", "h2", "first", "near")
    places = lines.select("id", "key", "pos", "h1", "h2").join(stored(gone, "gone"), ["h1", "h2"])
    places = places.where(F.col("near") | (F.struct("id", "key", "pos") > F.col("first")))
    return places.groupBy("id", "key").agg(F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("near"), F.collect_set(F.when(F.col("near").isNull(), F.col("pos"))).alias("exact"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, counts: tuple[str, str] | None = None, exact_min_words: int = 1, bound: int = 1) -> DataFrame:
    """All rows and columns, with every line left out of ``text_col`` that has an earlier line within ``bound`` edits.

    Lines compare by lower-cased words; an edit puts in, leaves out or replaces a word. Earlier: in a document of
    smaller id (then smaller text hash), or further up. Whether the earlier line itself stays doesn't matter. Lines of
    fewer than ``min_words`` words have no near ones (one edit of a few words is another line), but go if they equal an
    earlier line and have ``exact_min_words`` words or more. Lines without a word always stay. Bound 0 removes equal
    lines only; the cost of a bound over 1 is in ``near_lines_beyond``.
    Repeated rows are one document, and are treated alike. A null text stays null; one that loses every line
    becomes empty. Null ids come first. An empty table gives none. ``counts`` names columns for the numbers of lines
    left out as (exact, near); columns of those names that the table has are replaced.
    """
    key, gid, gkey, exact, near = free_names(docs, "text_key", "gone_id", "gone_key", "gone_exact", "gone_near")
    gone = removed_lines(docs, id_col, text_col, min_words, min(exact_min_words, min_words), bound).select(F.col("id").alias(gid), F.col("key").alias(gkey), F.col("exact").alias(exact), F.col("near").alias(near))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = keyed.join(gone, keyed[id_col].eqNullSafe(gone[gid]) & (keyed[key] == gone[gkey]), "left")
    left = without_lines(F.col(text_col), F.concat(exact, near))
    out = out.withColumn(text_col, F.when(F.col(exact).isNull(), F.col(text_col)).otherwise(left))
    number = [F.coalesce(F.size(c), F.lit(0)).cast("long") for c in (exact, near)]
    clash = {c.lower() for c in counts or ()}
    return out.select(*(c for c in docs.columns if c.lower() not in clash), *(n.alias(c) for n, c in zip(number, counts or (), strict=False)))
