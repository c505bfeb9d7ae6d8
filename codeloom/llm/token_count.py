"""Operator 5: token counts without token ids."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_schema, stored
from codeloom.llm.word_tokens import WordTokens

#: Characters of the texts of a block (or one longer text).
BLOCK = 32_000_000


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers as one compressed value: all first bytes, then all second ones and so on, as most numbers
    are small."""
    sizes = np.array([len(a) for a in arrays])
    numbers = np.concatenate([[len(arrays)], sizes, *arrays]).astype("<i4")
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(value: bytes) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), dtype=np.uint8).reshape(4, -1)
    x = np.ascontiguousarray(planes.T).view("<i4").ravel()
    return np.split(x[1 + x[0] :], np.cumsum(x[1 : 1 + x[0]])[:-1])


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of runs of the given lengths, empty ones too."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(lengths, dtype=np.int64)
    return total[ends] - total[ends - lengths]


class Block:
    """Word frequencies of some texts, put together of their distinct pre-tokens."""

    def __init__(self, tokens: WordTokens):
        self.tokens, self.size = tokens, 0
        self.ids: list = []
        self.n_bytes: list[int] = []
        self.special: list[int] = []
        self.words: defaultdict[str, int] = defaultdict(count().__next__)
        self.steps: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, name: object, text: str | None) -> None:
        found = Counter(self.tokens.words(text))
        found.pop("", None)
        special = [w for w in found if isinstance(w, tuple)]
        self.special.append(sum(found.pop(w) for w in special))
        self.ids.append(name)
        self.n_bytes.append(len((text or "").encode("utf-8", "surrogatepass")))
        at = np.fromiter(map(self.words.__getitem__, found), dtype=np.int64, count=len(found))
        order = np.argsort(at)
        self.steps.append(np.diff(at[order], prepend=0))  # small numbers, which compress well
        self.times.append(np.fromiter(found.values(), dtype=np.int64, count=len(found))[order])
        self.size += len(text or "")

    def row(self) -> tuple:
        """ids, n_bytes, special, pieces (distinct pre-tokens), cells."""
        pieces: defaultdict[str, int] = defaultdict(count().__next__)
        spelt = [[pieces[p] for p in self.tokens.pretokens(w)] for w in self.words]
        cells = packed(np.array([len(x) for x in self.steps]), np.concatenate(self.steps), np.concatenate(self.times), np.array([len(x) for x in spelt]), np.array([p for x in spelt for p in x]))
        return self.ids, self.n_bytes, self.special, list(pieces), cells


def frequencies(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: block, ids, n_bytes, special (added tokens), pieces, cells (frequencies of words, and the
    pieces of each)."""
    schema = f"block long, ids array<{docs.schema[id_col].dataType.simpleString()}>, n_bytes array<long>, special array<long>, pieces array<string>, cells binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = WordTokens.open(tokenizer, ids=False), count(TaskContext.get().partitionId() << 32)
        block = Block(tokens)

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((next(number), *block.row()), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(name, text.as_py())
                if block.size >= BLOCK:
                    yield written()
                    block = Block(tokens)
        if block.ids:
            yield written()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def counted(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """(block, found) of rows (piece, block, at), where found is at * 2**32 + the number of tokens: the model counts each distinct piece once. All rows of a piece meet in
    one task, in order: they are one a block at most, so no piece is hot."""
    schema = "block long, found long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last, n = WordTokens.open(tokenizer, ids=False).model, None, 0
        for batch in batches:
            out = []
            for piece in batch.column("piece").to_pylist():
                if piece != last:
                    last, n = piece, len(model.tokenize(piece))
                out.append(n)
            found = (batch.column("at").to_numpy().astype(np.int64) << 32) + np.array(out, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(found)], schema=arrow)

    return pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, schema)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, n_distinct (words), over_limit (n_tokens > limit).

    Documents become word frequencies, gathered in blocks with their distinct pre-tokens; the model counts the pieces of
    each distinct pre-token once for all blocks; the counts are joined to the frequencies and summed. Ids are never
    made. A block shuffles each pre-token once, however many of its documents have it. One row per input row, repeated
    rows too. A null text counts as empty: no bytes, no tokens. A null id is an id. An empty table gives none. Other
    columns are not read, so their names can't clash.
    """
    blocks = stored(frequencies(docs, tokenizer, id_col, text_col), "frequencies")
    found = counted(blocks.select(F.posexplode("pieces").alias("at", "piece"), "block").select("piece", "block", "at"), tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def total(block: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in block.itertuples():
            lengths, steps, times, spelt, of = unpacked(r.cells)
            n = np.zeros(len(pieces), dtype=np.int64)
            found = pieces["found"].to_numpy()
            n[found >> 32] = found & 0xFFFFFFFF
            words = sums(n[of], spelt)
            at = np.cumsum(steps, dtype=np.int64)  # runs on over the documents: each starts again from 0
            starts = np.cumsum(lengths) - lengths
            before = np.repeat(np.where(starts > 0, at[starts - 1] if len(at) else 0, 0), lengths)
            tokens = sums(times * words[at - before] if len(at) else np.zeros(0), lengths) + np.array(r.special)
            out.append(pd.DataFrame({id_col: pd.Series(list(r.ids), dtype=object), "n_bytes": list(r.n_bytes), "n_tokens": tokens, "n_distinct": lengths}))
        return pd.concat(out)

    sides = blocks.select("block", "ids", "n_bytes", "special", "cells").groupBy("block").cogroup(found.groupBy("block"))
    return sides.applyInPandas(total, f"`{id_col}` {kind}, n_bytes long, n_tokens long, n_distinct long").withColumn("over_limit", F.col("n_tokens") > limit)
