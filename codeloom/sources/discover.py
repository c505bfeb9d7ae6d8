"""Discovery of source files: listing on the driver, verdicts as a Column expression."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.lookup import EXCLUDED_DIRS, verdicts
from codeloom.sources.extract import LANGUAGES

LISTING = "path string, size bigint, mtime_ns bigint"


def git_files(root: Path) -> list[str] | None:
    """Tracked files and untracked ones that aren't ignored; None outside of a work tree."""
    try:
        out = subprocess.run(["git", "ls-files", "-z", "--cached", "--others", "--exclude-standard"], cwd=root, capture_output=True, timeout=60, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return [x for x in out.stdout.decode("utf-8", "surrogateescape").split("\0") if x]


def ignore_rule(line: str, folder: str = "") -> tuple[bool, str] | None:
    """A line of an ignore file in ``folder`` as (ignores?, regular expression over paths from the root); None for comments.
    A rule that begins with "!" takes paths back in."""
    rule = line.rstrip("\r\n")
    rule = rule if rule.endswith("\\ ") else rule.rstrip()
    if not rule or rule[0] == "#":
        return None
    ignores, rule = not rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
    only_folders, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    body = re.escape(rule).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace(r"\[!", "[^").replace(r"\[", "[").replace(r"\]", "]")
    body = body.replace("/[^/]*", "/(?=[^/])[^/]*")  # a name isn't empty
    start = re.escape(f"{folder}/") if folder else ""
    return ignores, f"^{start}" + ("" if anchored else "(?:.*/)?") + body + ("/" if only_folders else "(?:/|$)")


def rules_of(path: Path, folder: str = "") -> list[tuple[bool, str]]:
    lines = path.read_text(errors="replace").splitlines() if path.is_file() else []
    return [r for r in (ignore_rule(x, folder) for x in lines) if r]


def walk_files(root: Path) -> list[str]:
    """The tree without excluded folders, honouring the ignore files of all its folders: the last rule that matches decides,
    and what stands in an ignored folder can't be taken back in."""
    found, rules = [], {}

    def ignored(path: str, known: list[tuple[bool, re.Pattern]]) -> bool:
        return next((ignores for ignores, r in reversed(known) if r.search(path)), False)

    for folder, folders, names in os.walk(root):
        at = Path(folder).relative_to(root).as_posix().removeprefix(".")
        above = rules.get(Path(at).parent.as_posix().removeprefix("."), []) if at else []
        rules[at] = [*above, *((i, re.compile(r)) for i, r in rules_of(Path(folder, ".gitignore"), at))]
        prefix = f"{at}/" if at else ""
        folders[:] = sorted(d for d in folders if d not in EXCLUDED_DIRS and not ignored(f"{prefix}{d}/", rules[at]))
        found += [prefix + n for n in names if not ignored(prefix + n, rules[at])]
    return found


def remember_ignored(root: str, patterns: list[str], ignore_file: str = ".codeloomignore") -> list[str]:
    """Add patterns to the ignore file of a tree, those that it hasn't; returns the new ones."""
    path = Path(root, ignore_file)
    had = path.read_text(errors="replace").splitlines() if path.is_file() else []
    new = [p for p in dict.fromkeys(patterns) if p not in had]
    if new:
        path.write_text("\n".join([*had, *new]) + "\n")
    return new


def discover(spark: SparkSession, root: str, subpath: str = "", excludes: tuple[str, ...] = (), max_file_size: int = 1_000_000, ignore_file: str = ".codeloomignore") -> tuple[DataFrame, DataFrame]:
    """(files, skipped): what to extract (path, size, mtime_ns), and what not (path, reason).

    Spark's own listing hides names that begin with "_" or ".", as package files do, so paths are listed here.
    """
    base = Path(root)
    listed = sorted(set(git_files(base) if git_files(base) is not None else walk_files(base)))
    rows = []
    for path in listed:
        try:
            st = (base / path).stat()
        except OSError:
            continue
        rows.append((path, st.st_size, st.st_mtime_ns))
    ignored = tuple(rules_of(base / ignore_file))
    judged = verdicts(spark.createDataFrame(rows, LISTING), {s: x.name for x in LANGUAGES for s in x.suffixes}, excludes, ignored, subpath, max_file_size)
    return judged.where("verdict = 'ok'").drop("verdict"), judged.where("verdict NOT IN ('ok', 'drop')").selectExpr("path", "verdict AS reason")


def content_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of listed files, read by the executors; what can't be read is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    data = (Path(root) / path).read_bytes()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [data]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return files.select("path").mapInArrow(run, "path string, content binary")


def hashed(files: DataFrame, root: str) -> DataFrame:
    """(path, content_hash, stat) of files (path, stat); contents stay on the executors. A file that can't be read has the
    hash "unreadable"."""

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str:
            try:
                return content_hash((Path(root) / path).read_bytes())
            except OSError:
                return "unreadable"

        return paths.map(one)

    return files.select("path", digest("path").alias("content_hash"), "stat")
