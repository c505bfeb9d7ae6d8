"""Tables made in rounds: the whole, with the work of one round on disk at a time."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from codeloom.operators import graph, packs
from codeloom.plans import catalog
from codeloom.sources import fixtures

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture
def written(monkeypatch):
    """(columns, rows) of every table written, as it is written."""
    found, known, real = [], {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        real(self, path, *args, **kwargs)
        n = self._df.sparkSession.read.parquet(path).count()
        found.append((tuple(self._df.columns), n - known.get(path, 0)))
        known[path] = n

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return found


@pytest.fixture
def small(monkeypatch):
    """Rounds that are small enough for the test tables to need several."""
    for module, name, n in ((packs, "EDGES", 150), (fixtures, "LINES", 1500), (fixtures, "PAIRS", 150)):
        monkeypatch.setattr(module, name, n, raising=False)


def folders(spark):
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        found.add(files.next().getName())
    return {int(m[1]) for name in found if (m := re.match(r"shuffle_(\d+)_\d+_\d+\.data$", name))}


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_round_leaves_only_its_result(spark):
    before = folders(spark)
    table = spark.range(100).withColumn("id", F.when(F.col("id") > 4, F.col("id")))  # null is a key too
    found = graph.in_rounds(3, lambda k: graph.stored(graph.stored(table).where(graph.in_round("id", k, 3))))
    assert same(found, table) and len(folders(spark) - before) == 1


def test_rounds_in_a_round_go_with_it(spark):
    before = folders(spark)
    found = graph.in_rounds(2, lambda k: graph.in_rounds(2, lambda j: graph.stored(spark.range(10).where(F.col("id") % 4 == 2 * k + j))))
    assert same(found, spark.range(10)) and len(folders(spark) - before) == 1


@needs_tables
def test_lines_of_orders_are_sorted_by_rounds(spark, small, written):
    x = fixtures.Fixtures(spark, DATA)
    found = x.paired().pairs()
    assert same(found, x.pairs())
    assert max(n for _, n in written) < 0.5 * found.count()


@needs_tables
def test_pack_whole_is_made_by_rounds(spark, small, written):
    """No table on its way holds all neighbours, and none of these stays."""
    before = folders(spark)
    found = catalog.QUERIES["pack_whole"](spark, DATA)
    near = [n for c, n in written if "via" in c and "signature" not in c]
    assert found.count() == fixtures.Fixtures(spark, DATA).symbols().count()
    assert max(near) < 0.6 * sum(near)
    assert len(folders(spark) - before) <= 8  # pairs, symbols, edges, notes, imports, the listing, imports by file, packs


@needs_tables
def test_trimming_by_rounds_is_trimming_of_all(spark, monkeypatch, written):
    """With scores or without; no table of judged rows holds those of all targets."""
    x = fixtures.Fixtures(spark, DATA).written()
    symbols, edges, imports = x.symbols(), x.module_edges(), graph.stored(x.imports())

    def finish(rows, files):
        return packs.rendered(packs.trimmed(rows, 90), files)

    def made():
        written.clear()
        return packs.by_rounds(symbols, symbols, edges, imports, finish, task=catalog.TASK), [n for c, n in written if "keep" in c]

    whole, (judged,) = made()
    monkeypatch.setattr(packs, "EDGES", edges.count() // 2 - 1)
    parts, some = made()
    assert same(parts, whole) and sum(some) == judged and max(some) < 0.6 * judged


@needs_tables
@pytest.mark.parametrize("name", ["pack_trim", "pack_trim_task"])
def test_trimmed_packs_are_made_by_rounds(spark, small, written, name):
    catalog.QUERIES[name](spark, DATA)
    for column in ("via", "keep"):
        sizes = [n for c, n in written if column in c and "signature" not in c]
        assert max(sizes) < 0.6 * sum(sizes), column


def test_shuffles_go_with_the_query_that_made_them(spark):
    """No garbage has to be collected for that, and the session's own setting stays."""
    old, before = shuffles(spark), spark.conf.get(graph.CLEANUP, None)
    found = graph.stored(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count())
    until = time.time() + 20
    while shuffles(spark) - old and time.time() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - old and found.count() == 7
    assert spark.conf.get(graph.CLEANUP, None) == before


@needs_tables
def test_rows_of_packs_are_dealt_out_by_target_once(spark):
    x = fixtures.Fixtures(spark, DATA).written()
    symbols, edges = x.symbols(), x.module_edges()
    near = packs.direct(symbols, edges)
    found = packs.packs(symbols, symbols, edges, x.imports(), near=near)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(target") == 1
    known = packs.entries(packs.neighbours(symbols, edges, symbols), edges, symbols)
    assert same(packs.entries(near, edges, symbols), known)


@needs_tables
@pytest.mark.parametrize("words", [1, 1 << 17])
def test_orders_without_a_call_are_not_sorted(spark, monkeypatch, words):
    """Few bits leave more lines; none that makes a pair goes, of orders without a key either."""
    monkeypatch.setattr(fixtures, "WORDS", words)
    x = fixtures.Fixtures(spark, DATA)
    lines = x.table("lineitem").withColumn("l_orderkey", F.when(F.col("l_orderkey") % 50 > 0, F.col("l_orderkey")))
    some = x.calling(lines)
    assert same(x.pairs(some), x.pairs(lines)) and same(some, some.intersectAll(lines))
    assert words == 1 or some.count() < 0.6 * lines.count()
