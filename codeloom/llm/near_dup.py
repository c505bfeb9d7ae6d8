"""Operator 7: n-gram Jaccard join by chosen paths, and near-duplicate classes of documents.

Texts are sets of five-word shingles. Equal sets are one node. A set is embedded as a MinHash sketch: its tokens are
(coordinate, value), and two sets share each with a probability that is their Jaccard similarity. A run starts with
all nodes in one bucket. A bucket samples coordinates; for each, nodes of equal value go to a bucket of their own.
Small buckets are searched by brute force, others are split again, and runs are repeated until a pair at the
threshold has met with the target recall. What the sketches let meet is then verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WORD_RE, arrow_schema, free_names, stored
from codeloom.llm.components import components

#: Coordinates of a sketch, and the share of equal ones below which two sets of similarity 0.8 fall once in 30,000.
COORDINATES, SLACK = 64, 0.2
#: Members of a bucket or class that are compared in one piece, and shingles in it; larger ones are compared block by
#: block.
TOGETHER, SHINGLES = 1000, 2_000_000
#: Rows for one call of a grouped function.
BATCH = 3000
#: Words that a worker remembers, and their greatest length; a full table is emptied.
REMEMBERED, SHORT = 500_000, 64
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= SHORT:
            self[word] = out
        return out

    def of(self, text: str | None, n: int) -> np.ndarray:
        """Sorted distinct shingle hashes; a text of fewer than n words is one shingle, one of none has none."""
        words = WORD_RE.findall(text or "")
        h = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(n, len(h))
        if not width:
            return h
        out = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for i in range(width):
            out = mix(out * _STEP + h[i : i + len(out)])
        return np.unique(out)


_HASHES = Shingles()


def sketch(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 2**32 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        values = (shingles[i : i + 4096, None] * _MULTIPLY + _ADD) >> np.uint64(32)
        out = np.minimum(out, values.min(0))
    return out.astype(np.uint32)


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, key (of the text), node (digest of the shingle set; null: no words), sketch, width (number of shingles)."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, key long, node binary, sketch binary, width long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found, widths = [], [], []
            for text in batch.column(2):
                s = _HASHES.of(text.as_py(), n)
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found.append(sketch(s).tobytes() if len(s) else None)
                widths.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(found, pa.binary()), pa.array(widths, pa.int64())], schema=arrow)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs until a pair at the threshold has shared a bucket of the given depth with the probability ``recall``.

    A bucket takes each coordinate with probability 1 / (threshold * COORDINATES); a pair at the threshold shares
    its value with probability ``threshold``, so one child keeps both with probability 1 / COORDINATES each.
    """
    met = 1.0
    for _ in range(depth):
        met = 1 - (1 - met / COORDINATES) ** COORDINATES
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def children(rows: DataFrame, threshold: float, runs: int = 0) -> DataFrame:
    """(path, node) of the buckets that each row's bucket splits into. Rows: path, node, sketch; at first (``runs``)
    node and sketch, and each run is a path."""
    schema, chance = "path long, node binary", np.uint64(int(2**32 / (threshold * COORDINATES)))
    arrow = arrow_schema(schema)
    coordinates = np.arange(1, COORDINATES + 1, dtype=np.uint64) * _STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
            nodes = batch.column("node")
            starts = [np.full(len(values), mix(np.array([r + 1], dtype=np.uint64))[0]) for r in range(runs)] if runs else [np.array(batch.column("path").to_pylist(), dtype=np.int64).view(np.uint64)]
            for start in starts:
                chosen = (mix(start[:, None] + coordinates) >> np.uint64(32)) < chance
                row, at = np.nonzero(chosen)
                path = mix(mix(start[row] ^ coordinates[at]) + values[row, at])
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), nodes.take(pa.array(row))], schema=arrow)

    return rows.select(*(["node", "sketch"] if runs else ["path", "node", "sketch"])).mapInArrow(run, schema)


def forest(linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix the least row of its component."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            label[i], waiting = i, [i]
            while waiting:
                new = np.nonzero(linked[waiting.pop()] & (label < 0))[0]
                label[new] = i
                waiting += new.tolist()
    return label


def in_blocks(members: DataFrame, group: str, blocks: Column, batches: int) -> DataFrame:
    """``members`` with task and a, b: a group of one block is one piece, with others in a task. Of a larger group, each
    pair of its blocks is a task (a <= b), and a member goes to the pairs that have its block."""
    n = blocks.cast("int")
    block = F.pmod(F.xxhash64(F.lit(3), "node"), n).cast("int")
    split = members.withColumn("block", F.when(n > 1, block).otherwise(0)).withColumn("other", F.explode(F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))))
    split = split.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    return split.withColumn("task", F.when(n > 1, F.xxhash64(group, "a", "b")).otherwise(F.pmod(F.xxhash64(group), F.lit(batches)))).drop("other")


def met(buckets: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) that join all nodes of a bucket whose sketches agree: a spanning forest, not all pairs."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["path", "a", "b"], kind="stable")
        values = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint32).reshape(-1, COORDINATES)
        nodes, (path, a, b) = rows["node"].to_numpy(), (rows[c].to_numpy() for c in ("path", "a", "b"))
        ends = np.nonzero(np.append((path[1:] != path[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True))[0] + 1
        u, v, start, least = [], [], 0, (threshold - SLACK) * COORDINATES
        for end in ends:
            if end - start == 2:
                if (values[start] == values[start + 1]).sum() >= least:
                    u.append(nodes[start])
                    v.append(nodes[start + 1])
            elif end - start > 2:
                x = values[start:end]
                agree = np.zeros((len(x), len(x)), dtype=np.uint8)
                for i in range(COORDINATES):
                    agree += x[:, i, None] == x[None, :, i]
                for i, j in enumerate(forest(agree >= least)):
                    if i != j:
                        u.append(nodes[start + i])
                        v.append(nodes[start + j])
            start = end
        return pd.DataFrame({"u": u, "v": v}, dtype=object)

    return buckets.select("task", "path", "a", "b", "node", "sketch").groupBy("task").applyInPandas(search, "u binary, v binary").distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``wanted`` (id, key, node, ...: one document for each node) with shingles, from the documents' texts."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    asked = wanted.withColumnsRenamed({"id": "id_", "key": "key_"})
    rest = [c for c in asked.columns if c not in ("id_", "key_")]
    found = texts.join(asked, texts["id"].eqNullSafe(asked["id_"]) & (texts["key"] == asked["key_"])).dropDuplicates(["id_", "key_"])

    @F.arrow_udf("binary")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_HASHES.of(x.as_py(), n).tobytes() for x in texts], pa.binary())

    return found.select(*rest, sets("text").alias("shingles"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices of bounded width."""
    shingle, number = np.unique(np.concatenate(sets), return_inverse=True)
    member, out = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(number, kind="stable")
    number, member, width = number[order], member[order], max(256, 8_000_000 // len(sets))
    for low in range(0, len(shingle), width):
        i, j = np.searchsorted(number, (low, low + width))
        part = np.zeros((len(sets), min(width, len(shingle) - low)), dtype=np.float32)
        part[member[i:j], number[i:j] - low] = 1
        out += part @ part.T
    return out


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """node, links (documents at the threshold or more, copies counted; a part if its class is in blocks), least (of
    the nodes that its links lead to here). Members: task, component, a, b, block, node, copies, shingles."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, a, b), part in rows.groupby(["component", "a", "b"], sort=False):
            part = part.sort_values("node", kind="stable")
            sets, copies, block = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]], part["copies"].to_numpy(), part["block"].to_numpy()
            size = np.array([len(s) for s in sets])
            shared = overlaps(sets)
            linked = shared >= threshold * (size[:, None] + size - shared) - 1e-9
            np.fill_diagonal(linked, False)
            if a != b:  # pairs within a block are for its own task
                linked &= block[:, None] != block
            nodes = part["node"].to_numpy()
            out.append(pd.DataFrame({"node": nodes, "links": linked @ copies, "least": nodes[forest(linked)]}))
        return pd.concat(out)

    return members.groupBy("task").applyInPandas(search, "node binary, links long, least binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, depth: int = 3, only: DataFrame | None = None) -> DataFrame:
    """id, key, component, class_id, n_links of every row: documents linked at Jaccard ``threshold`` or more, directly or not.

    component tells classes apart (null: no words); class_id is the smallest id of the class, which several classes have
    if documents share an id or have none. n_links the number of other documents at the threshold or more, copies
    included. Words are compared as they stand. A document of fewer than ``n`` words is one shingle of all its words;
    one without words (or null) has no links and is a class of its own. Repeated rows are copies of each other. Buckets that are still large
    at ``depth`` are searched block by block, so none is cut. Exact on what met: links are verified on whole sets.
    ``only`` (key) leaves out documents of other texts. An empty table gives none; other columns aren't read.
    """
    rows = sketches(docs, id_col, text_col, n)
    rows = stored(rows if only is None else rows.join(only.select("key"), "key", "left_semi").select("id", "key", "node", "sketch"), "sketches")
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "key")).alias("first"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("width").alias("width")), "nodes")
    level, meeting = stored(children(nodes, threshold, runs_for(recall, threshold, depth)), "paths"), []
    for at in range(depth):
        # stored, so that both sides of the join have an exchange of their own and the rows of a large bucket are split
        sizes = stored(level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
        shared = stored(level.join(sizes, "path"), "shared")
        large = shared.where(F.col("size") > TOGETHER)
        if at == depth - 1 or large.isEmpty():
            meeting.append(shared)
            break
        meeting.append(shared.where(F.col("size") <= TOGETHER))
        level = stored(children(large.join(nodes.select("node", "sketch"), "node"), threshold).distinct(), "paths")
    buckets = meeting[0]
    for more in meeting[1:]:
        buckets = buckets.unionByName(more)
    batches = max(1, math.ceil(buckets.count() / BATCH))
    pairs = met(in_blocks(buckets.join(nodes.select("node", "sketch"), "node"), "path", F.ceil(F.col("size") / TOGETHER), batches), threshold)
    coarse = stored(components(pairs).join(nodes.select("node", "copies", "width", F.col("first.id").alias("id"), F.col("first.key").alias("key")), "node"), "coarse")
    # tasks are dealt by shingles too: texts may be long
    sizes = stored(coarse.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / TOGETHER, F.sum("width") / SHINGLES)).alias("blocks")), "sizes")
    members_n, shingles = coarse.agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    members = shingle_sets(docs, coarse.drop("width").join(sizes, "component"), id_col, text_col, n)
    found = stored(verified(in_blocks(members, "component", F.col("blocks"), max(1, math.ceil(members_n / BATCH), math.ceil(shingles / SHINGLES))), threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    of_node = stored(nodes.select("node", "copies", F.col("first.id").alias("id")).join(links, "node", "left").join(named, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    least = stored(of_node.groupBy("component").agg(F.min("id").alias("class_id")), "least")
    named = of_node.join(least, "component").select(F.col("node").alias("of"), "component", "class_id", "n_links")
    return rows.join(named, F.col("node") == F.col("of"), "left").select("id", "key", "component", F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of ``classes``: that of its smallest id (then smallest text hash). All columns stay.

    Repeated rows are one; documents without words (null texts too) are classes of their own. Ids may be null or shared:
    classes are told apart by their component. An empty table gives none; columns may have any names.
    """
    of = classes(docs, id_col, text_col, **options)
    alone = F.col("component").isNull()
    kept = of.groupBy("component", F.when(alone, F.col("id")).alias("i"), F.when(alone, F.col("key")).alias("t")).agg(F.min(F.struct("id", "key")).alias("k")).select("k.id", "k.key")
    key, kid, kkey = free_names(docs, "text_key", "kept_id", "kept_key")
    keyed, kept = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), kept.toDF(kid, kkey)
    return keyed.join(kept, keyed[id_col].eqNullSafe(kept[kid]) & (keyed[key] == kept[kkey])).dropDuplicates([kid, kkey]).select(*docs.columns)
