"""Operator 6: exact top-k search by inner product, with a dual-tree search over cover trees.

One cover tree serves queries and data. Its top is fit on a bounded sample: the first centres of a farthest-first
order, to the nearest of which every row of both tables goes. Below a centre, rows stand in blocks of bounded size, and
a task builds the rest of the tree over its block. A search goes twice over the top: first each block of queries has a
block under the centre that promises most, which gives every query a kth score; then it visits only the blocks whose
covering radii still allow a higher score than the block's worst kth one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_schema, stored

#: Points of a node that isn't split further; two such nodes are scored by one matrix product.
LEAF = 256
#: Blocks of queries that visit a block of data in one task.
VISITORS = 16
SCHEMA = "query_id long, vec_id long, score long"


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


@dataclass
class Node:
    """A ball of the cover tree: every row is within ``radius`` of ``centre``. A leaf has no children."""

    centre: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)
    worst: float = -math.inf  # of queries: the least kth score among them


def net(points: np.ndarray, scale: float, most: int) -> tuple[np.ndarray, list[int]] | None:
    """Centres over ``scale`` apart that cover all points within it, and the centre of each point; the first point is
    one. None if it takes more than ``most``."""
    nearest, owner, centres = distances(points, points[0]), np.zeros(len(points), dtype=np.int64), [0]
    while nearest.max() > scale:
        if len(centres) >= most:
            return None
        new = int(nearest.argmax())
        away = distances(points, points[new])
        owner[away < nearest] = len(centres)
        nearest = np.minimum(nearest, away)
        centres.append(new)
    return owner, centres


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, scale: float = math.inf) -> Node:
    """Nested nets: the children of a node are over ``scale`` apart and cover its points within it; each level halves
    the scale. The first row is the node's centre and goes on as its own first child. Where the net of a sample of the
    rows takes most of them as centres, nearly every point is a child by itself, and the node is a leaf with all."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    node = Node(own[0], float(np.sqrt((own[0] ** 2).sum())), float(distances(own, own[0]).max()), rows)
    scale = min(scale, node.radius) / 2
    while len(rows) > LEAF and node.radius > 0:
        if net(own[:: max(1, len(own) // LEAF)], scale, LEAF // 2) is None or (dealt := net(own, scale, len(own) // 2)) is None:
            break
        owner, centres = dealt
        if len(centres) > 1:
            for i, c in enumerate(centres):
                mine = rows[owner == i]
                node.children.append(cover_tree(points, np.concatenate([[rows[c]], mine[mine != rows[c]]]), scale))
            break
        scale /= 2
    return node


class Search:
    """Dual-tree search of queries in one tree of data. Scores are integers, which doubles hold exactly. ``kth`` has a
    score for each query that it has reached elsewhere: lower ones are not looked for."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, data: np.ndarray, data_ids: np.ndarray, tree: Node, k: int):
        self.q, self.qid, self.least, self.d, self.did, self.tree, self.k = queries, query_ids, kth.astype(float), data, data_ids, tree, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, dtype=np.int64)
        self.products = 0

    @staticmethod
    def bound(a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius

    def hopeless(self, a: Node, bound: float) -> bool:
        return bound < a.worst - 1e-9 * max(1.0, abs(a.worst))  # a tie may still be won by a smaller id

    def run(self) -> None:
        def start(a: Node) -> None:
            a.worst = float(self.least[a.rows].min())
            for c in a.children:
                start(c)

        root = cover_tree(self.q)
        start(root)
        self.visit(root, [self.tree])

    def visit(self, a: Node, frontier: list[Node]) -> None:
        """Node pairs of ``a`` with each of the frontier: the larger of both is split until both are leaves."""
        waiting = [(-self.bound(a, b), i, b) for i, b in enumerate(frontier)]
        waiting = [x for x in waiting if not self.hopeless(a, -x[0])]
        if a.children:
            closer = [c for _, _, b in sorted(waiting, key=lambda x: x[:2]) for c in (b.children if b.children and b.radius >= a.radius else [b])]
            for c in a.children:
                self.visit(c, closer)
            a.worst = min(c.worst for c in a.children)
            return
        heapq.heapify(waiting)
        n = len(waiting)
        while waiting and not self.hopeless(a, -waiting[0][0]):
            _, _, b = heapq.heappop(waiting)
            if not b.children:
                self.leaf(a, b)
            for c in b.children:
                n += 1
                heapq.heappush(waiting, (-self.bound(a, c), n, c))

    def leaf(self, a: Node, b: Node) -> None:
        scores = self.q[a.rows] @ self.d[b.rows].T
        self.products += scores.size
        scores[self.qid[a.rows][:, None] == self.did[b.rows][None, :]] = -np.inf
        i, j = np.nonzero(scores >= np.maximum(np.maximum(self.scores[a.rows, -1], self.least[a.rows]), -1e300)[:, None])
        if not len(i):
            return
        touched = np.unique(i)
        score = np.concatenate([self.scores[a.rows[touched]].ravel(), scores[i, j]])
        row = np.concatenate([self.found[a.rows[touched]].ravel(), b.rows[j]])
        query = np.concatenate([np.repeat(touched, self.k), i])
        ids = np.where(row >= 0, self.did[row], np.iinfo(np.int64).max)
        order = np.lexsort((ids, -score, query))
        query = query[order]
        best = order[np.searchsorted(query, touched)[:, None] + np.arange(self.k)]  # every query has its k old ones at least
        self.scores[a.rows[touched]], self.found[a.rows[touched]] = score[best], row[best]
        a.worst = float(np.maximum(self.scores[a.rows, -1], self.least[a.rows]).min())


def quantized(embedding: Column) -> Column:
    """floor(64 * x) of each component as double; null where the vector or a component is null or not finite."""
    x = embedding.cast("array<double>")
    bad = embedding.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * 64).cast("double")))


def centres_of(data: DataFrame, sample: int, block_values: int, most: int) -> dict[int, np.ndarray]:
    """Centres for the vectors of each length, from the ``sample`` rows with the smallest hashes: four for each block
    that the data will have, ``most`` at most."""
    n = {r["dim"]: r["n"] for r in data.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    rows = data.select("dim", "v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(sample).collect()
    out = {}
    for dim in sorted({r["dim"] for r in rows}):
        points = np.array([r["v"] for r in rows if r["dim"] == dim], dtype=float).reshape(-1, dim)
        wanted = min(most, len(points), 4 * math.ceil(n[dim] * max(dim, 1) / block_values))
        nearest, chosen = distances(points, points[0]), [0]
        while len(chosen) < wanted and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(points, points[chosen[-1]]))
        out[dim] = points[chosen]
    return out


def placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (id, v, dim) with node (the place of the nearest centre of that length) and its distance. A length that
    the sample has not is a node around the origin."""
    schema = "id long, v array<double>, dim int, node int, away double"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            values, ends = batch.column("v").flatten().to_numpy(), np.cumsum(dims)
            node, away = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                x = values[(ends[at] - dim)[:, None] + np.arange(dim)]
                c = centres.get(int(dim), np.zeros((1, dim)))
                far = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)
                node[at] = far.argmin(1)
                away[at] = np.sqrt(((x - c[node[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(away)], schema=arrow)

    return rows.select("id", "v", "dim").mapInArrow(run, schema)


def in_blocks(rows: DataFrame, values: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (stored, as ``name``) with their block of about ``values`` numbers, and (dim, node, blocks, n, radius) of the nodes,
    of which there are no more than centres."""
    rows = stored(rows, name)
    nodes = stored(rows.groupBy("dim", "node").agg(F.count("*").alias("n"), F.max("away").alias("radius")).withColumn("blocks", F.ceil(F.col("n") * F.greatest("dim", F.lit(1)) / values).cast("int")), f"{name}-nodes")
    some = nodes.select(F.col("dim").alias("d_"), F.col("node").alias("n_"), "blocks")
    both = rows.join(F.broadcast(some), (F.col("dim") == F.col("d_")) & (F.col("node") == F.col("n_")))
    return both.select("id", "v", "dim", "node", "away", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int").alias("block")), nodes


def tops(s: Search) -> pd.DataFrame:
    keep = np.isfinite(s.scores)
    return pd.DataFrame({"query_id": np.repeat(s.qid, s.k)[keep.ravel()], "vec_id": s.did[s.found[keep]], "score": s.scores[keep].astype("int64")})


def loaded(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(rows["v"]).astype(float), rows["id"].to_numpy()


def top_k(queries: DataFrame, data: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector", block_values: int = 2**20, query_values: int = 2**17, sample: int = 8192, max_centres: int = 1024) -> DataFrame:
    """For every query its ``k`` rows of the highest inner product: query_id, rank (from 1), vec_id, score (long).

    Vectors hold integers as doubles (``quantized``). Every row of ``data`` is a candidate, rows of equal id too, but for
    those with the query's own id; ties go to the smaller id. Queries of equal id and vector are one; those of one id
    with unequal vectors share a list: the best scores of any of them. Null ids and vectors take no part, and vectors of
    unequal length never meet. Fewer than k candidates give all, an empty table none. Other columns aren't read.

    Bounded are the sample that the top of the tree is fit on, its centres (broadcast: ``max_centres`` vectors for each
    length), and the numbers in a block of data and of queries. All rows are indexed and searched: what is left out
    can't enter a list.
    """
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim")]
    q = queries.select(*cols).where("id IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id", "v"])
    d = data.select(*cols).where("id IS NOT NULL AND v IS NOT NULL")
    centres = centres_of(d, sample, block_values, max_centres)
    q_rows, _ = in_blocks(placed(q, centres), query_values, "queries")
    d_rows, d_nodes = in_blocks(placed(d, centres), block_values, "data")
    nodes = [tuple(r) for r in d_nodes.select("dim", "node", "n", "radius", "blocks").orderBy("dim", "node").collect()]  # as many as centres
    by_dim = {dim: [x for x in nodes if x[0] == dim] for dim in {x[0] for x in nodes}}
    balls = {dim: (np.stack([centres.get(dim, np.zeros((1, dim)))[x[1]] for x in own]), np.array([x[3] for x in own])) for dim, own in by_dim.items()}

    def reach(dim: int, node: int, radius: float) -> np.ndarray:
        """The highest score of a query within ``radius`` of a centre with a row of each node."""
        c, r = balls[dim]
        own = centres.get(dim, np.zeros((1, dim)))[node]
        return c @ own + radius * np.sqrt((c**2).sum(1)) + r * math.sqrt(own @ own) + radius * r

    # first: one block under the centre that promises most, for every block of queries
    first = {}
    for dim in balls:
        for node in range(len(centres.get(dim, [0]))):
            order = sorted(range(len(by_dim[dim])), key=lambda i: (by_dim[dim][i][2] <= k, -reach(dim, node, 0.0)[i]))  # noqa: B023
            first[dim, node] = by_dim[dim][order[0]][1]
    empty = q.sparkSession.createDataFrame([], f"{SCHEMA}, rank int").select("query_id", "rank", "vec_id", "score")
    if not first:
        return empty
    start = q.sparkSession.createDataFrame([(*key, at) for key, at in first.items()], "d_ int, n_ int, first int")  # as many as centres
    asked = q_rows.join(F.broadcast(start), (F.col("dim") == F.col("d_")) & (F.col("node") == F.col("n_"))).drop("d_", "n_")
    hosts = asked.select("dim", "node", "block", "first").distinct().select(F.col("dim").alias("d_"), F.col("node").alias("qn"), F.col("block").alias("qb"), "first")
    opening = d_rows.where("block = 0").join(hosts, (F.col("dim") == F.col("d_")) & (F.col("node") == F.col("first"))).select("dim", F.col("qn").alias("node"), F.col("qb").alias("block"), "id", "v")

    def open_up(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        out = qs[["id", "v", "dim", "node", "block", "away"]].copy()
        if not len(qs) or not len(ds):
            return out.assign(kth=-math.inf, ids=[[] for _ in range(len(out))], scores=[[] for _ in range(len(out))])
        x, data_ids = loaded(ds)
        s = Search(*loaded(qs), np.full(len(qs), -np.inf), x, data_ids, cover_tree(x), k)
        s.run()
        keep = np.isfinite(s.scores)
        out["kth"] = s.scores[:, -1]
        out["ids"] = [s.did[f[m]].tolist() for f, m in zip(s.found, keep, strict=True)]
        out["scores"] = [f[m].astype("int64").tolist() for f, m in zip(s.scores, keep, strict=True)]
        return out

    opened = asked.groupBy("dim", "node", "block").cogroup(opening.groupBy("dim", "node", "block")).applyInPandas(open_up, "id long, v array<double>, dim int, node int, block int, away double, kth double, ids array<long>, scores array<long>")
    opened = stored(opened, "opened")

    # then: the blocks whose nodes still allow more than the worst kth score of a block of queries
    worst = opened.groupBy("dim", "node", "block").agg(F.min("kth").alias("worst"), F.max("away").alias("radius"))
    pairs_schema = "dim int, node int, block int, dn int, db int"

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                bounds = reach(r.dim, r.node, r.radius)
                for (_, dn, _, _, blocks), b in zip(by_dim[r.dim], bounds, strict=True):
                    if b >= r.worst - 1e-9 * max(1.0, abs(r.worst)):
                        out += [(r.dim, r.node, r.block, dn, db) for db in range(blocks) if (dn, db) != (first[r.dim, r.node], 0)]
            yield pd.DataFrame(out, columns=["dim", "node", "block", "dn", "db"]).astype("int32")

    left = stored(worst.mapInPandas(pairs, pairs_schema), "pairs")
    visits = left.groupBy("dim", "dn", "db").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("shifts"))
    shift = F.pmod(F.xxhash64("node", "block"), F.col("shifts")).cast("int")
    seat = left.join(visits, ["dim", "dn", "db"]).select(F.col("dim").alias("d_"), F.col("node").alias("n_"), F.col("block").alias("b_"), "dn", "db", shift.alias("shift"))
    coming = opened.select("id", "v", "dim", "node", "block", "kth").join(seat, (F.col("dim") == F.col("d_")) & (F.col("node") == F.col("n_")) & (F.col("block") == F.col("b_"))).drop("d_", "n_", "b_")
    there = visits.select(F.col("dim").alias("d_"), F.col("dn").alias("n_"), F.col("db").alias("b_"), F.explode(F.sequence(F.lit(0), F.col("shifts") - 1)).alias("shift"))
    waiting = d_rows.join(there, (F.col("dim") == F.col("d_")) & (F.col("node") == F.col("n_")) & (F.col("block") == F.col("b_"))).select("dim", F.col("node").alias("dn"), F.col("block").alias("db"), "shift", "id", "v")

    def search(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")]
        if len(qs) and len(ds):
            x, ids = loaded(ds)
            tree = cover_tree(x)
            for _, part in qs.groupby(["node", "block"], sort=False):
                s = Search(*loaded(part), part["kth"].to_numpy(), x, ids, tree, k)
                s.run()
                out.append(tops(s))
        return pd.concat(out)

    keys = ["dim", "dn", "db", "shift"]
    more = coming.groupBy(*keys).cogroup(waiting.groupBy(*keys)).applyInPandas(search, SCHEMA)
    had = opened.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return had.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
