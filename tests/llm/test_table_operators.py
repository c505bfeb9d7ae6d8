"""Operators across documents: against brute force on small tables with ties, copies, nulls and clashing names."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import line_dedup, near_dup, topk_search, url_filter
from codeloom.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102)] + [(200, 200 + i) for i in range(1, 30)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(30)}
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


def edits(a, b):
    """Edit distance of two word lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(docs, least=8, bound=1):
    lines, first = [], {}
    for i, text in sorted(docs.items()):
        for k, x in enumerate(text.split("\n")):
            w = tuple(WORD.findall(x.lower()))
            if w:
                lines.append((i, k, w))
                first.setdefault(w, (i, k))
    long = [w for w in first if len(w) >= least]
    near = {w for w in long if any(first[v] < first[w] and abs(len(v) - len(w)) <= bound and edits(w, v) <= bound for v in long if v != w)}
    return {(i, k) for i, k, w in lines if w in near or (i, k) > first[w]}


@pytest.mark.parametrize(("seed", "bound"), [(0, 1), (1, 1), (2, 1), (3, 2), (4, 3), (5, 0)])
def test_line_dedup_is_brute_force(spark, seed, bound):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(list("abcdefg"), rng.integers(6, 14))) for _ in range(12)]

    def noisy(line):
        w = line.split()
        for _ in range(rng.integers(0, 2 + max(bound, 1))):
            k, at = rng.integers(0, 3), rng.integers(0, len(w))
            w = w[:at] + ([] if k == 0 else [rng.choice(list("abcXY"))]) + w[at + (k < 2) :]
        return " ".join(w)

    docs = {i: "\n".join(noisy(base[rng.integers(0, 12)]) for _ in range(rng.integers(1, 6))) for i in range(60)}
    docs |= {100: "", 101: "   \n\t", 104: "a b a b a b a b a b\na b a b a b a b a b a b", 105: "Accept all cookies\nAccept all  cookies", 106: "accept ALL cookies\nown"}
    if bound == 1:
        docs |= {102: " ".join(["long"] * 800), 103: " ".join(["long"] * 799)}
    gone = brute_lines(docs, bound=bound)
    assert {(105, 1), (106, 0)} <= gone
    table = spark.createDataFrame([(i, t, "x", "old") for i, t in docs.items()], "doc_id long, text string, text_key string, n_near string").repartition(4)
    found = line_dedup.dedup_lines(table, counts=("n_exact", "n_near"), bound=bound)
    assert found.columns == ["doc_id", "text", "text_key", "n_exact", "n_near"]
    out = {r["doc_id"]: r for r in found.collect()}
    for i, t in docs.items():
        assert out[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), i
        assert out[i]["n_exact"] + out[i]["n_near"] == sum(g[0] == i for g in gone) and out[i]["text_key"] == "x"


def test_line_dedup_edges(spark):
    line = "one two three four five six seven eight"
    rows = [(1, f"{line}\nshort"), (1, f"{line}\nshort"), (2, line.upper()), (3, None), (None, line), (4, "\n".join(f"line {i % 30_000}" for i in range(60_000)))]
    out = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    left = "\n".join(f"line {i}" for i in range(30_000))
    assert out == sorted([(1, "short"), (1, "short"), (2, ""), (3, None), (None, line), (4, left)], key=str)  # a null id comes first
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def brute_classes(docs):
    sets = {}
    for i, t in docs.items():
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: {j for j in docs if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in docs}
    out = {}
    for i in sorted(docs):
        if i not in out:
            waiting = [i]
            while waiting:
                j = waiting.pop()
                if j not in out:
                    out[j] = i
                    waiting += links[j]
    return {i: (out[i], len(links[i])) for i in docs}


@pytest.mark.parametrize("together", [1000, 8])
def test_near_duplicates_are_brute_force(spark, together, monkeypatch):
    """With ``together`` at 8 the large group is compared block by block."""
    monkeypatch.setattr(near_dup, "TOGETHER", together)
    rng = np.random.default_rng(5)
    vocabulary, docs = [f"w{i}" for i in range(500)], {}
    for g in range(8):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(30 if g == 0 else 4):
            w = base.copy()
            for at in rng.choice(120, rng.integers(0, 4), replace=False):
                w[at] = "new"
            docs[len(docs)] = " ".join(w)
    docs |= {500: docs[3], 501: docs[3], 502: "", 503: None, 504: "two words", 505: "two words", 506: "Two words", 507: "  "}
    table = spark.createDataFrame([(i, t, "s", 1) for i, t in docs.items()], "doc_id long, text string, node string, class_id int").repartition(3)
    found = {r["id"]: (r["class_id"], r["n_links"]) for r in near_dup.classes(table).collect()}
    assert found == brute_classes(docs)
    kept = near_dup.keep_one(table)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in found.values()}) and kept.columns == table.columns


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.classes(empty).isEmpty() and near_dup.keep_one(empty).isEmpty()
    rows = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "other words stand here now")], "doc_id long, text string")
    assert sorted((r["id"], r["class_id"], r["n_links"]) for r in near_dup.classes(rows).collect()) == [(1, 1, 2)] * 3 + [(2, 2, 0)]
    assert near_dup.keep_one(rows).count() == 2
    assert near_dup.runs_for(0.999, 0.8, 1) < near_dup.runs_for(0.999, 0.8, 3)


def test_near_duplicates_without_ids(spark):
    """Different texts under no id or one id stay; copies of a text are one."""
    texts = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(6)]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0]), (7, texts[3]), (7, texts[4]), (8, texts[4]), (None, texts[5]), (9, texts[5]), (None, None), (10, "")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, t) for t in texts[:3]] + [(7, texts[3]), (7, texts[4]), (None, texts[5]), (None, None), (10, "")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def pairs_of_blocks(monkeypatch):
    """The stored tables of a search by name, to see which blocks met."""
    seen, stored = {}, topk_search.stored
    monkeypatch.setattr(topk_search, "stored", lambda df, name: seen.setdefault(name, stored(df, name)))
    return seen


@pytest.mark.parametrize("clustered", [False, True])
def test_top_k_is_brute_force(spark, clustered, monkeypatch):
    """Repeated ids too: each row is a candidate, and queries of one id with two vectors share a list. On clusters most
    blocks don't meet."""
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (3000, 6)).astype(float)
    if clustered:
        x = np.repeat(rng.integers(-300, 300, (10, 6)), 300, 0) + x
    ids = np.arange(3000)
    ids[50:60], ids[200] = 7, 100  # rows of one id: 100 is a query with two vectors
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(5000, None), (None, x[1].tolist()), (300, x[300].tolist()), (6000, [1.0, 2.0])]
    ids, x = np.append(ids, 300), np.append(x, x[300:301], 0)
    data = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, vector array<double>, score string")
    seen = pairs_of_blocks(monkeypatch)
    found = topk_search.top_k(data.where("vec_id % 100 = 0"), data, k=7, block_values=700 * 6, query_values=4 * 6).toPandas()
    assert found.query_id.nunique() == 30 - 1
    for q, g in found.groupby("query_id"):
        own = np.unique(x[ids == q], axis=0)
        s = np.where(ids != q, 1, np.nan) * (own @ x.T)
        want = sorted(((-v, int(i)) for r in s for v, i in zip(r, ids, strict=True) if not np.isnan(v)))[:7]
        g = g.sort_values("rank")
        assert [(-v, i) for v, i in zip(g.score, g.vec_id, strict=True)] == want and list(g["rank"]) == list(range(1, 8))
    blocks = seen["opened"].select("dim", "node", "block").distinct().count() * seen["data-nodes"].agg(F.sum("blocks")).first()[0]
    met = seen["pairs"].count()
    assert met < 0.4 * blocks if clustered else met <= blocks


def test_cover_tree():
    """Children cover their node's rows within the scale, are further apart than it, and share the rows out."""
    rng = np.random.default_rng(1)
    far = np.repeat(rng.normal(size=(8, 3)) * 1000, 2000, 0) + rng.normal(size=(16000, 3))

    def check(node):
        assert np.allclose(topk_search.distances(far[node.rows], node.centre).max(), node.radius)
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            centres = np.stack([c.centre for c in node.children])
            apart = min(np.sort(topk_search.distances(centres, c))[1] for c in centres)
            assert max(c.radius for c in node.children) < apart and (node.children[0].centre == node.centre).all()
        return 1 + sum(map(check, node.children))

    tree = topk_search.cover_tree(far)
    assert check(tree) > 30
    s = topk_search.Search(far[:40], np.arange(40), np.full(40, -np.inf), far, np.arange(16000), tree, 5)
    s.run()
    assert s.products < 0.5 * 40 * 16000
    same = topk_search.cover_tree(np.ones((1000, 4)))
    assert not same.children and same.radius == 0


def test_quantized_and_few_candidates(spark):
    rows = [(0, [0.5, -0.01]), (20, [1.0, 1.0]), (3, [float("nan"), 1.0]), (4, None), (5, [None, 1.0]), (6, [float("inf"), 0.0])]
    data = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", topk_search.quantized(F.col("e")).alias("vector"))
    found = [tuple(r) for r in topk_search.top_k(data.where("vec_id % 20 = 0"), data).orderBy("query_id").collect()]
    assert found == [(0, 1, 20, 32 * 64 - 64), (20, 1, 0, 32 * 64 - 64)]
    assert topk_search.top_k(data.limit(0), data).isEmpty() and topk_search.top_k(data, data.limit(0)).isEmpty()


def test_url_filter(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    entries = [("ads", "bad.example", "add", day(5)), ("ads", "bad.example", "remove", day(10)), ("ads", "bad.example", "add", day(20)), ("mal", "a.bad.example", "add", day(7)), ("mal", "tie.example", "remove", day(3)), ("mal", "tie.example", "add", day(3)), ("x", None, "add", day(1)), ("x", "odd.example", "hold", day(1))]
    e = spark.createDataFrame(entries, "list string, domain string, action string, at timestamp")
    urls = [("http://bad.example/x", 4, []), ("http://u:p@BAD.example.:80/x", 5, ["ads"]), ("https://www.bad.example", 9, ["ads"]), ("http://bad.example", 10, []), ("http://bad.example", 25, ["ads"]), ("http://a.bad.example?q", 8, ["ads", "mal"]), ("http://a.bad.example", 12, ["mal"]), ("http://notbad.example", 6, []), ("http://tie.example", 3, ["mal"]), ("nonsense", 6, []), (None, 6, []), ("http://odd.example", 6, [])]
    c = spark.createDataFrame([(i, u, day(d), "old") for i, (u, d, _) in enumerate(urls)] + [(1, urls[1][0], day(5), "old"), (99, "http://bad.example", None, "old")], "page_id int, url string, fetched_at timestamp, host string")
    out = url_filter.filter_urls(c, e).collect()
    assert len(out) == len(urls) + 2
    for r in out:
        want = [] if r["page_id"] == 99 else urls[r["page_id"]][2]
        assert r["lists"] == want and r["blocked"] == bool(want), r
    assert {r["matched"] for r in out if r["page_id"] == 5} == {"a.bad.example"} and {r["host"] for r in out if r["page_id"] == 1} == {"bad.example"}
    assert url_filter.filter_urls(c, e.limit(0)).where("blocked").isEmpty() and url_filter.filter_urls(c.limit(0), e).isEmpty()
