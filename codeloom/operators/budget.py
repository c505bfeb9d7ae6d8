"""Token budgets: the longest prefix of ranked rows that fits, as a running sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import stored


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with rank (from 1) and, under each name, the sum of that column over the rows before, in a total order.

    No task sees all rows: they are dealt out by ranges of the order and stored, each range is summed up, and what the
    ranges before hold is added to running sums inside a range.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_rows"), *(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select("_of", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_rows", *(f"_{n}" for n in sums))))
    own = Window.partitionBy("_range").orderBy(*order)
    to_here = own.rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({"rank": F.row_number().over(own), **{n: F.coalesce(F.sum(c).over(to_here), F.lit(0)) for n, c in sums.items()}})
    both = inside.join(F.broadcast(before), inside["_range"] == before["_of"])
    return both.select(*rows.columns, (F.col("rank") + F.col("_rows")).cast("int").alias("rank"), *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def fit(rows: DataFrame, order: list[Column], line: Column, budget: int | None, limit: int | None = None, prefix: int = 0) -> DataFrame:
    """``rows`` with rank (from 1) and cost (tokens of all lines up to it, joined by newlines after a prefix of that many
    characters), as far as they fit. The count limit comes first; the first row always stays.

    With a limit the sort is a top-k, and the running sum sees just those rows; without one it goes by ranges.
    """
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
        to_here = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the limit
        ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("_chars", F.coalesce(F.sum(F.length(line) + 1).over(to_here), F.lit(0)))
    else:
        ranked = running(rows, order, {"_chars": F.length(line) + 1})
    chars = F.col("_chars") + F.length(line) + 1 + prefix - (0 if prefix else 1)
    out = ranked.withColumn("cost", F.floor(chars / 4)).drop("_chars")
    return out if budget is None else out.where((F.col("cost") <= budget) | (F.col("rank") == 1))


def fit_json(rows: DataFrame, order: list[Column], columns: list[str], budget: int | None, limit: int | None = None) -> DataFrame:
    """``fit`` of rows as JSON objects (entry): the budget is for what is written, with ", " and ": " between its parts
    as JSON writers put them. ``columns`` are strings, numbers or booleans, none of them null."""
    text = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(c), r"([\\\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"'))
    kinds = dict(rows.dtypes)
    parts = [F.concat(F.lit(f'"{c}": '), text(c) if kinds[c] == "string" else F.col(c).cast("string")) for c in columns]
    entry = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return fit(rows.withColumn("entry", entry), order, F.col("entry"), budget, limit)


def fit_each(rows: DataFrame, group: list[str], order: list[Column], line: Column, budget: int) -> DataFrame:
    """``fit`` for many answers at once, one per group."""
    to_here = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    out = ranked.withColumn("cost", F.floor((F.sum(F.length(line) + 1).over(to_here) - 1) / 4))
    return out.where((F.col("cost") <= budget) | (F.col("rank") == 1))


def meter(fitted: DataFrame, total: DataFrame, budget: int | None, limit: int | None) -> DataFrame:
    """One row: tokens, returned, total, omitted, truncated_by and per_signal of a fitted answer."""
    kept = fitted.agg(F.coalesce(F.max("cost"), F.lit(0)).alias("tokens"), F.count("*").alias("returned"))
    out = kept.crossJoin(total.agg(F.count("*").alias("total")))
    cut = F.when(F.col("returned") >= F.col("total"), F.lit(None)).when(F.col("returned") >= (limit if limit is not None else 1 << 62), "limit").otherwise("budget")
    return out.select("tokens", "returned", "total", (F.col("total") - F.col("returned")).alias("omitted"), cut.alias("truncated_by"), F.bround(F.col("tokens") / F.greatest("returned", F.lit(1)), 1).alias("per_signal"))


def capped(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with more: how many there are beyond."""
    w = Window.partitionBy(*group)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - k, F.lit(0))).where(F.col("rank") <= k)


def shed(atoms: DataFrame, budget: int) -> DataFrame:
    """The lean map's ladder over atoms (id, name, signature, score): form "sig", "name" or "none" of each.

    Signatures go first, from the lowest score (then id); then names. Each row saves a known number of tokens, so
    the cut is where the running sum of savings first brings the total under the budget.
    """
    cost = lambda c: F.floor((F.length(c) + 1) / 4)
    priced = atoms.withColumn("s", cost("signature")).withColumn("n", cost("name"))
    total = priced.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    run = running(priced, [F.col("score"), F.col("id")], {"saved_s": F.col("s") - F.col("n"), "saved_n": F.col("n")}).drop("rank").join(F.broadcast(total))
    form = F.when(F.col("all_s") - F.col("saved_s") <= budget, "sig").when((F.col("all_n") <= budget) | (F.col("all_n") - F.col("saved_n") <= budget), "name").otherwise("none")
    return run.withColumn("form", form).drop("s", "n", "all_s", "all_n", "saved_s", "saved_n")
