"""Operator 4: byte-level BPE encoding and decoding, by recursive DuckDB queries inside each partition."""

from __future__ import annotations

import base64
import re
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codeloom.llm.common import map_batches

#: Words, and pieces, that a worker remembers at most; a full table is emptied, which costs time but no result.
REMEMBERED = 700_000
#: Texts whose new pieces are merged by one query, and pieces that one query takes.
TOGETHER, AT_ONCE = 4_000, 200_000
NO_MERGE = 1 << 30
_OPEN: dict[tuple[str, str], BytePairs] = {}

#: token-position rows (word, pos, id, next) join the merge table; then each step contracts the leftmost pair of
#: minimum rank of every word and looks up just the two pairs that are new. ids stands between sentinels -1.
MERGE = f"""
WITH RECURSIVE state(word, ids, ranks) USING KEY (word) AS (
  SELECT word, [-1] || list(p.id ORDER BY pos) || [-1], [{NO_MERGE}] || list(coalesce(m.id, {NO_MERGE}) ORDER BY pos)
  FROM positions p LEFT JOIN merges m ON m.pair = p.id::BIGINT * {1 << 32} + p.next GROUP BY word
 UNION ALL
  (WITH least AS (SELECT word, ids, ranks, list_min(ranks) AS k FROM state),
        leftmost AS (SELECT *, list_position(ranks, k) AS i FROM least WHERE k < {NO_MERGE})
   SELECT word, ids[:i - 1] || [k] || ids[i + 2:],
          ranks[:i - 2] || [coalesce(a.id, {NO_MERGE}), coalesce(b.id, {NO_MERGE})] || ranks[i + 2:]
   FROM leftmost LEFT JOIN merges a ON a.pair = ids[i - 1]::BIGINT * {1 << 32} + k
                 LEFT JOIN merges b ON b.pair = k::BIGINT * {1 << 32} + ids[i + 2])
)
SELECT word, ids[2:-2] AS ids FROM state"""
#: Decoding: each id joins its bytes (as Latin-1 letters), put together in the order of the positions.
DECODE = "SELECT word, string_agg(v.letters, '' ORDER BY i) AS decoded FROM (SELECT word, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM {rows}) JOIN vocabulary v USING (id) GROUP BY word"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class BytePairs:
    """A rank file opened in a worker: the merge and vocabulary tables and what has been encoded so far."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = read_ranks(path)
        self.split = regex.compile(pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        found = [(ranks[t[:i]] * (1 << 32) + ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({"pair": pa.array([p for p, _ in found], pa.int64()), "id": pa.array([k for _, k in found], pa.int32())})  # noqa: F841
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "letters": [t.decode("latin-1") for t in ranks]})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        # words between single spaces split alone only if the pattern lets a piece start with one space
        self.by_word = self.split.findall("a b, c\nd") == ["a", " b", ",", " c", "\n", "d"]
        self.uneven = re.compile(r"\s\s|\A\s|\s\Z")

    @classmethod
    def open(cls, path: str, pattern: str) -> BytePairs:
        if (path, pattern) not in _OPEN:
            _OPEN[path, pattern] = cls(path, pattern)
        return _OPEN[path, pattern]

    def learn(self, pieces: list[str]) -> None:
        """Merge and decode pieces; a piece that is a token itself stays whole, as the library has it."""
        for at in range(0, len(pieces), AT_ONCE):
            part = pieces[at : at + AT_ONCE]
            raw = [x.encode("utf-8", "surrogatepass") for x in part]
            whole = np.array([self.ranks.get(x, -1) for x in raw], dtype=np.int64)
            n = np.where(whole >= 0, 1, [len(x) for x in raw])
            ids = np.repeat(whole, n)
            ids[ids < 0] = self.of_byte[np.frombuffer(b"".join(x for x, w in zip(raw, whole, strict=True) if w < 0), dtype=np.uint8)]
            end = np.cumsum(n)
            following = np.append(ids[1:], -1)
            following[end - 1] = -1
            positions = pa.table({"word": np.repeat(np.arange(len(part), dtype=np.int32), n), "pos": np.arange(len(ids), dtype=np.int64), "id": ids.astype(np.int32), "next": following.astype(np.int32)})  # noqa: F841
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE merged AS {MERGE}")
            done = self.con.sql(f"SELECT m.word, array_to_string(ids, ',') AS ids, decoded FROM merged m JOIN ({DECODE.format(rows='merged')}) USING (word)").to_arrow_table()
            for w, i, d in zip(*(done[c].to_pylist() for c in ("word", "ids", "decoded")), strict=True):
                self.pieces[part[w]] = (i.encode(), d.encode("latin-1"))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Per text: its ids in decimal, joined by commas, and the bytes that they decode to."""
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        if len(self.words) > REMEMBERED:
            self.words = {}
        even = [self.by_word and not self.uneven.search(x) for x in texts]
        split = [x.split(" ") if e else self.split.findall(x) for x, e in zip(texts, even, strict=True)]
        heads = [self.split.findall(s[0]) if e and s else [] for s, e in zip(split, even, strict=True)]
        new = set().union(*(s[1:] for s, e in zip(split, even, strict=True) if e)) - self.words.keys()
        parts = {w: self.split.findall(f" {w}") for w in new}
        wanted = set().union(*parts.values(), *heads, *(s for s, e in zip(split, even, strict=True) if not e))
        self.learn([x for x in wanted if x not in self.pieces])
        for w, p in parts.items():
            self.words[w] = self.pieces[p[0]] if len(p) == 1 else tuple(sep.join(x) for sep, x in zip((b",", b""), zip(*map(self.pieces.__getitem__, p), strict=True), strict=True))
        out = []
        for s, h, e in zip(split, heads, even, strict=True):
            found = [*map(self.pieces.__getitem__, h), *map(self.words.__getitem__, s[1:])] if e else [*map(self.pieces.__getitem__, s)]
            ids, decoded = zip(*found, strict=True) if found else ((), ())
            out.append((b",".join(ids), b"".join(decoded)))
        return out


def _over(docs: DataFrame, ranks: str, pattern: str, id_col: str, text_col: str, columns: dict[str, tuple]) -> DataFrame:
    def run(rows: dict[str, list]) -> dict[str, list]:
        pairs, out = BytePairs.open(ranks, pattern), {id_col: rows[id_col], **{c: [] for c in columns}}
        texts = [x or "" for x in rows[text_col]]
        for i in range(0, len(texts), TOGETHER):
            for ids, decoded in pairs.encode(texts[i : i + TOGETHER]):
                for c, (_, make) in columns.items():
                    out[c].append(make(ids, decoded))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], run, ", ".join([f"`{id_col}` {kind}", *(f"{c} {t}" for c, (t, _) in columns.items())]))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text as an array: id, ids, n_tokens. A null text counts as empty: no ids.

    One row per input row, repeated rows too; other columns are not read. No special tokens.
    """
    return _over(docs, ranks, pattern, id_col, text_col, {"ids": ("array<int>", lambda i, _: np.array(i.split(b","), dtype=np.int32) if i else []), "n_tokens": ("long", lambda i, _: i.count(b",") + 1 if i else 0)})


def decode(tokens: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of every array of ids: id, decoded. A null array counts as empty; an id outside the vocabulary fails."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        pairs, given = BytePairs.open(ranks, r"\s+|\S+"), [x or [] for x in rows[ids_col]]
        if bad := {i for x in given for i in x} - set(pairs.ranks.values()):
            raise ValueError(f"ids outside the vocabulary: {sorted(bad)[:5]}")
        asked = pa.table({"word": pa.array(range(len(given)), pa.int64()), "ids": pa.array(given, pa.list_(pa.int32()))})  # noqa: F841
        found = dict(pairs.con.sql(DECODE.format(rows="asked")).fetchall())
        return {id_col: rows[id_col], "decoded": [found.get(i, "").encode("latin-1") for i in range(len(given))]}

    kind = tokens.schema[id_col].dataType.simpleString()
    return map_batches(tokens, [id_col, ids_col], run, f"`{id_col}` {kind}, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to: id, n_tokens, ids_sha256, decoded_sha256.

    Ids and bytes are made once per distinct piece and put together per text, so neither is stored for the corpus.
    Nulls, repeated rows and other columns are as in ``encode``.
    """
    return _over(docs, ranks, pattern, id_col, text_col, {"n_tokens": ("long", lambda i, _: i.count(b",") + 1 if i else 0), "ids_sha256": ("string", lambda i, _: sha256(i).hexdigest()), "decoded_sha256": ("string", lambda _, d: sha256(d).hexdigest())})
