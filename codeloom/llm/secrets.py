"""Operator 8: secret scans. Base patterns, and probabilistic automata inferred from the credentials that these label."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_schema, map_batches, stored

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the automata score: runs of the letters of assigned values, of their least length; marks of sentences and of
#: assignments don't stand at the ends.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{6,}[A-Za-z0-9+/_-]={0,2}")
END = ""
#: Formats whose verdict a worker remembers, and their greatest length; a full table is emptied.
REMEMBERED, SHORT = 300_000, 64


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the base patterns, leftmost and non-overlapping for each kind."""
    low, out = text.lower(), []
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]


def symbol(c: str) -> str:
    """Characters by class, as formats differ in classes: hex letters apart from others, digits, and each mark by itself."""
    if c.isdigit():
        return "0"
    if c.isalpha():
        return ("a" if c in "abcdef" else "z") if c.islower() else ("A" if c in "ABCDEF" else "Z")
    return c


SYMBOLS = str.maketrans({chr(i): symbol(chr(i)) for i in range(128)})


@dataclass
class State:
    through: int = 0
    ends: int = 0
    to: dict[str, int] = field(default_factory=dict)
    count: Counter = field(default_factory=Counter)


class Automaton:
    """A deterministic probabilistic automaton by state merging (ALERGIA).

    The prefix tree of the labelled strings, with counts, is folded: states are taken breadth first, and each is
    merged into the first kept state whose ending and outgoing frequencies, and those of all states that both reach,
    agree within Hoeffding's bound at ``alpha``; otherwise it is kept as a state of its own.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.states, self.bound, self.size = [State()], math.sqrt(0.5 * math.log(2 / alpha)), len(strings)
        for s in strings:
            at = 0
            for c in map(symbol, s):
                state = self.states[at]
                state.through += 1
                state.count[c] += 1
                if c not in state.to:
                    state.to[c] = len(self.states)
                    self.states.append(State())
                at = state.to[c]
            self.states[at].through += 1
            self.states[at].ends += 1
        kept, waiting = [0], [(0, c) for c in sorted(self.states[0].to)]
        while waiting:
            parent, c = waiting.pop(0)
            new = self.states[parent].to[c]
            if new in kept:
                continue
            if (same := next((k for k in kept if self.alike(k, new)), None)) is None:
                kept.append(new)
                waiting += [(new, x) for x in sorted(self.states[new].to)]
            else:
                self.states[parent].to[c] = same
                self.fold(same, new)
                waiting = [(k, x) for k in kept for x in sorted(self.states[k].to) if self.states[k].to[x] not in kept]
        number = {k: i for i, k in enumerate(kept)}
        self.states = [State(s.through, s.ends, {c: number[t] for c, t in s.to.items()}, s.count) for s in map(self.states.__getitem__, kept)]

    def alike(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            x, y = (self.states[i] for i in pairs.pop())
            if not x.through or not y.through:
                continue
            most = self.bound * (1 / math.sqrt(x.through) + 1 / math.sqrt(y.through))
            if abs(x.ends / x.through - y.ends / y.through) > most:
                return False
            for c in x.to.keys() | y.to.keys():
                if abs(x.count[c] / x.through - y.count[c] / y.through) > most:
                    return False
                if c in x.to and c in y.to and x.to[c] != y.to[c]:
                    pairs.append((x.to[c], y.to[c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        pairs = [(a, b)]
        while pairs:
            i, j = pairs.pop()
            x, y = self.states[i], self.states[j]
            x.through, x.ends = x.through + y.through, x.ends + y.ends
            x.count.update(y.count)
            for c, t in y.to.items():
                if c in x.to:
                    pairs.append((x.to[c], t))
                else:
                    x.to[c] = t

    def log_likelihood(self, s: str) -> float:
        """Of the string's format, natural logarithm; a step never seen costs as one in ten thousand."""
        at, out = 0, 0.0
        for c in [*map(symbol, s), END]:
            state = self.states[at]
            n = state.ends if c == END else state.count[c]
            out += math.log(max(n / max(state.through, 1), 1e-4))
            at = state.to.get(c, 0) if c != END else at
        return out


#: Ordinary writing by groups of symbols, as it is put together of words, names and numbers: chances of the next group
#: ("": the start or the end). Nothing is learned from a corpus here, as its unlabelled secrets would be learned with it.
WRITING = {
    "": {"lower": 0.6, "upper": 0.25, "digit": 0.1, "mark": 0.05},
    "lower": {"lower": 0.9, "upper": 0.02, "digit": 0.02, "mark": 0.03, "": 0.03},
    "upper": {"lower": 0.35, "upper": 0.55, "digit": 0.02, "mark": 0.05, "": 0.03},
    "digit": {"lower": 0.02, "upper": 0.02, "digit": 0.8, "mark": 0.1, "": 0.06},
    "mark": {"lower": 0.5, "upper": 0.2, "digit": 0.2, "mark": 0.07, "": 0.03},
}
#: Group of a symbol, and the symbol's share of it; any other is one of six marks.
GROUPS = {"a": ("lower", 6 / 26), "z": ("lower", 20 / 26), "A": ("upper", 6 / 26), "Z": ("upper", 20 / 26), "0": ("digit", 1.0), END: ("", 1.0)}


def ordinary_log_likelihood(s: str) -> float:
    """Of the string's symbols in ordinary writing, natural logarithm."""
    at, out = "", 0.0
    for c in [*map(symbol, s), END]:
        group, share = GROUPS.get(c, ("mark", 1 / 6))
        out += math.log(WRITING[at].get(group, 1e-4) * share)
        at = group
    return out


@dataclass
class Formats:
    """Automata of credentials by kind; the least advantage of a secret over ordinary writing, in nats a character, and
    the least in all: a short string says less, and few strings are secrets."""

    secrets: dict[str, Automaton]
    least: float
    in_all: float = math.log(10_000)
    known: dict[str, bool] = field(default_factory=dict, repr=False, compare=False)

    def advantage(self, s: str) -> float:
        """Of the likeliest credential format over ordinary writing, in nats."""
        return max(a.log_likelihood(s) for a in self.secrets.values()) - ordinary_log_likelihood(s)

    def score(self, s: str) -> float:
        return self.advantage(s) / (len(s) + 1)

    def is_secret(self, s: str) -> bool:
        """By its format alone, so formats that were judged before are remembered."""
        shape = s.translate(SYMBOLS)
        if (found := self.known.get(shape)) is None:
            advantage = self.advantage(s)
            found = advantage >= self.in_all and advantage >= self.least * (len(s) + 1)
            if len(shape) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[shape] = found
        return found


def scan(text: str, formats: Formats | None) -> list[tuple[str, int, int, int]]:
    """All spans by start, then kind as listed. A candidate that touches a base span is that span's."""
    base = sorted(base_spans(text), key=lambda x: (x[1], KINDS.index(x[0])))
    if not formats:
        return base
    added, at, reach = [], 0, 0  # reach: the end of the base spans that start before a candidate's end
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][1] < end:
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= start and formats.is_secret(m[0]):
            added.append(("format", start, end, start))
    return sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]))) if added else base


def labelled(docs: DataFrame, text_col: str, sample: int, max_length: int) -> DataFrame:
    """(kind, hash, value) of the base secrets: of each partition the ``sample`` distinct values of each kind with the
    smallest hashes, which hold the corpus's. One pass over the texts."""
    schema = "kind string, hash long, value string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[str, int]] = {k: {} for k in KINDS[:3]}

        def smallest(found: dict[str, int]) -> dict[str, int]:
            return dict(sorted(found.items(), key=lambda x: (x[1], x[0]))[:sample])

        for batch in batches:
            for text in filter(None, batch.column(0).to_pylist()):
                for kind, _, end, value in base_spans(text):
                    if end - value <= max_length:
                        v = text[value:end]
                        best[kind][v] = xxhash.xxh3_64_intdigest(v) >> 1
                        if len(best[kind]) > 4 * sample + 1000:
                            best[kind] = smallest(best[kind])
        rows = [(k, h, v) for k, found in best.items() for v, h in smallest(found).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(text_col).mapInArrow(run, schema)


def learn_formats(docs: DataFrame, text_col: str = "text", sample: int = 400, max_length: int = 512, least: float = 0.4) -> Formats | None:
    """Automata from at most ``sample`` labelled values of each kind: those with the smallest hashes in the corpus.

    Bounds are ``sample`` and ``max_length`` alone (characters of a value that is learned from; longer ones are still
    found by the base patterns): every text is searched for labelled values, and every candidate is scored. None if
    the texts have no labelled value. Null texts have none; repeated values count once.
    """
    values = stored(labelled(docs, text_col, sample, max_length), "labelled")
    found = {k: [r["value"] for r in values.where(F.col("kind") == k).select("hash", "value").distinct().orderBy("hash", "value").limit(sample).collect()] for k in KINDS[:3]}
    known = {k: Automaton(v) for k, v in found.items() if v}
    return Formats(known, least) if known else None


def _written(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def find_secrets(docs: DataFrame, formats: Formats | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: id, n_assign, n_access, n_hex, n_format, base_sha256, spans.

    spans is kind:start:end (code points, end exclusive) by start, joined by commas; base_sha256 digests those of the
    base kinds. Base spans always stay; kind "format" is what the automata add. One row per input row, repeated rows
    too; a null text has no spans; an empty table gives none; other columns are not read. ``id_col`` may not be named
    like a result.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {id_col: rows[id_col], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        for text in rows[text_col]:
            spans = scan(text or "", formats)
            n = Counter(k for k, *_ in spans)
            for k in KINDS:
                out[f"n_{k}"].append(n[k])
            out["base_sha256"].append(sha256(_written([x for x in spans if x[0] != "format"]).encode()).hexdigest())
            out["spans"].append(_written(spans))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


def masked(text: str, formats: Formats | None, mask: str) -> str:
    out, at = [], 0
    for _, _, end, value in scan(text, formats):
        if end > at:
            out += [text[at : max(value, at)], mask]
            at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, formats: Formats | None, text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """All rows and columns, whatever their names; in ``text_col`` each secret (of an assignment, its value) is replaced
    by ``mask``. Null and empty texts stay; repeated rows are treated alike; an empty table gives none."""
    @F.arrow_udf("string")
    def hide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([x and masked(x, formats, mask) for x in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, hide(F.col(text_col)))
