"""Map documents: the engine's tables as Parquet, and as one JSON document for other tools; notes beside them."""

from __future__ import annotations

import datetime
import hashlib
import inspect
import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.sources import extract

VERSION = 4
TABLES = ("files", "symbols", "imports", "edges", "ambiguous", "external", "referenced", "raw_calls", "raw_refs")


def spec_hash() -> str:
    """A digest of all that decides what extraction returns; another one makes caches and maps stale."""
    return hashlib.sha256(inspect.getsource(extract).encode()).hexdigest()[:16]


def git_commit(root: str) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=30, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def provenance(folder: str) -> dict | None:
    """What a folder's map was made from; None if there is none that can be read."""
    try:
        return json.loads(Path(folder, "provenance.json").read_text())
    except (OSError, ValueError):
        return None


def stamps(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content_hash, stat) of the files of a map."""
    return spark.read.schema("path string, content_hash string, stat array<bigint>").parquet(f"{folder}/stamps")


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The tables that a folder has; None without symbols. Schemas are explicit: absent columns come as nulls."""
    out = {}
    for name in TABLES + ("notes",):
        try:
            out[name] = spark.read.schema(schemas.schema(name)).parquet(f"{folder}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out if "symbols" in out else None


def write_json(tables: dict[str, DataFrame], path: str, root_label: str = "", provenance: dict | None = None) -> None:
    """The whole map as one JSON document. It is written by the driver, row by row: for maps that a tool can open."""
    def rows(df: DataFrame):
        return (r[0] for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator())

    imports = tables["imports"].groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "source"))), lambda i: F.struct(i["name"].alias("name"), i["source"].alias("source"))).alias("imports"))
    files = tables["files"].select("path", "language", "error", "doc").join(imports, "path", "left").withColumn("imports", F.coalesce("imports", F.array())).orderBy("path")
    with open(path, "w", encoding="utf-8") as out:
        head = {"generator": "codeloom", "version": VERSION, "root": root_label, "generated_at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "provenance": provenance or {}}
        out.write(json.dumps(head)[:-1])
        for name, df in (("files", files), ("symbols", tables["symbols"].orderBy("path", "start_line")), *((n, tables[n]) for n in ("edges", "ambiguous", "external", "referenced") if n in tables)):
            out.write(f', "{name}": [')
            for i, row in enumerate(rows(df)):
                out.write(("," if i else "") + "\n" + row)
            out.write("]")
        out.write("}\n")


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of a JSON map; None if it is missing or no map. Absent fields take their defaults."""
    parts = {n: f"array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in schemas.schema(n))}>>" for n in ("symbols", "edges", "ambiguous", "external", "referenced")}
    files = "files array<struct<path: string, language: string, error: string, doc: string, imports: array<struct<name: string, source: string>>>>"
    if not Path(path).exists():
        return None
    doc = spark.read.schema(f"version int, {files}, " + ", ".join(f"{n} {t}" for n, t in parts.items())).json(path, multiLine=True)
    if doc.where("version IS NOT NULL AND symbols IS NOT NULL").isEmpty():
        return None
    out = {n: doc.select(F.explode(n).alias("r")).select("r.*") for n in parts}
    f = doc.select(F.explode("files").alias("f"))
    out["files"] = f.select("f.path", "f.language", "f.error", "f.doc")
    out["imports"] = f.select("f.path", F.posexplode("f.imports").alias("ordinal", "i")).select("path", "i.name", "i.source", "ordinal")
    return out


class Notes:
    """Notes on symbols: a small JSON file; reads are tables."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _all(self) -> dict[str, list[dict]]:
        try:
            return json.loads(self.path.read_text())["notes"]
        except (OSError, ValueError, KeyError):
            return {}

    def _save(self, notes: dict[str, list[dict]]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps({"version": 1, "notes": {k: v for k, v in notes.items() if v}}, indent=1))

    def add(self, symbol_id: str, text: str) -> None:
        notes = self._all()
        notes.setdefault(symbol_id, []).append({"text": text, "created": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")})
        self._save(notes)

    def remove(self, symbol_id: str, number: int | None = None) -> int:
        """Remove one note (from 1) or all of a symbol; how many went."""
        notes = self._all()
        own = notes.get(symbol_id, [])
        keep = [] if number is None else [x for i, x in enumerate(own, 1) if i != number]
        notes[symbol_id] = keep
        self._save(notes)
        return len(own) - len(keep)

    def prune(self, known: set[str]) -> int:
        """Remove the notes on symbols that aren't known any more; how many notes went."""
        notes = self._all()
        gone = [k for k in notes if k not in known]
        n = sum(len(notes.pop(k)) for k in gone)
        if gone:
            self._save(notes)
        return n

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, i, n["text"], datetime.datetime.fromisoformat(n["created"])) for k, v in self._all().items() for i, n in enumerate(v, 1)]
        return spark.createDataFrame(rows, schemas.schema("notes"))
