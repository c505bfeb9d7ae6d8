"""Operator 9: packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from codeloom.llm.common import arrow_schema
from codeloom.llm.word_tokens import WordTokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most ``room`` of a multiset of lengths, and how often each length goes into it.

    Bit s of ``sums`` says that the lengths so far can give s. Each length is added as often as it is there, and
    the sums before it are kept, from which the counts are traced back. It ends early when ``room`` itself is met.
    """
    mask, sums, before = (1 << (room + 1)) - 1, 1, []
    for n in reversed(lengths):
        if n > room:
            continue
        before.append((n, sums))
        left, step = min(counts[n], room // n), 1
        while left:  # 1, 2, 4, ... copies, then the rest, give every number of copies up to all
            step = min(step, left)
            sums |= (sums << (n * step)) & mask
            left, step = left - step, step * 2
        if sums >> room & 1:
            break
    best = total = sums.bit_length() - 1
    used: dict[int, int] = {}
    for n, had in reversed(before):
        k = 0
        while not had >> total & 1:
            total, k = total - n, k + 1
        if k:
            used[n] = k
    return best, used


def fill_windows(counts: dict[int, int], window: int) -> Iterator[list[int]]:
    """Windows as lists of lengths until every length is used. Each starts with the longest length left, as minimum
    bin slack does; the multiset closest to the room beside it joins it. When even all that is left doesn't fill
    a window, the largest power of two that a multiset fills exactly goes first, as such a sequence needs no padding."""
    counts, lengths = dict(counts), sorted(counts)

    def take(n: int, k: int) -> None:
        counts[n] -= k
        if not counts[n]:
            del counts[n]
            lengths.remove(n)

    total = sum(n * k for n, k in counts.items())
    while lengths:
        top = lengths[-1]
        if total >= window:
            take(top, 1)
            _, used = fullest(lengths, counts, window - top)
            used[top] = used.get(top, 0) + 1
            for n, k in used.items():
                if k - (n == top):
                    take(n, k - (n == top))
        else:
            power = 1 << (total.bit_length() - 1)
            used = dict(counts)
            while total != power and power >= max(64, top):
                best, found = fullest(lengths, counts, power)
                if best == power:
                    used = found
                    break
                power //= 2
            for n, k in used.items():
                take(n, k)
        total -= sum(n * k for n, k in used.items())
        yield [n for n in sorted(used, reverse=True) for _ in range(used[n])]


def pack(pieces: list[tuple], window: int, first_sequence: int) -> Iterator[tuple]:
    """Pieces (length first) with sequence id and offset. Whole windows stand alone; the rest go by their lengths."""
    by_length, sequence = defaultdict(list), first_sequence
    for p in pieces:
        if p[0] == window:
            yield (*p, sequence, 0)
            sequence += 1
        else:
            by_length[p[0]].append(p)
    for filled in fill_windows({n: len(x) for n, x in by_length.items()}, window):
        offset = 0
        for n in filled:
            yield (*by_length[n].pop(), sequence, offset)
            offset += n
        sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``window`` tokens.

    A document is its ids and ``end_id``; it is cut at every multiple of ``window``, so each id lies in exactly one
    piece, and a document shorter than a window is not cut. Each input partition packs its own pieces: nothing is
    shuffled, a lost task repeats just itself, and the padding is that of the last sequences of a partition.
    sequence_id is the partition's number times 2**32 plus a count from 0. Columns: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and (``with_ids``) ids. A null or empty text is a document of
    ``end_id`` alone. Every row is a document, repeated rows too. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = SCHEMA.replace("doc_id long", f"`{id_col}` {kind}") + (", ids array<int>" if with_ids else "")

    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, pieces = WordTokens.open(tokenizer, ids=True), end_id.to_bytes(4, "little"), []
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for name, text in zip(names, (x.as_py() for x in texts), strict=True):
                ids = b"".join(map(tokens.__getitem__, tokens.words(text))) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    pieces.append((len(part) // 4, name, start, zlib.crc32(part), n, part if with_ids else None))
        rows = list(pack(pieces, window, TaskContext.get().partitionId() << 32))
        del pieces
        for i in range(0, len(rows), 20_000):
            n, name, start, crc, of, ids, sequence, offset = zip(*rows[i : i + 20_000], strict=True)
            columns = [name, start, n, crc, of, sequence, offset] + ([[np.frombuffer(x, dtype="<u4").astype("int32") for x in ids]] if with_ids else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
