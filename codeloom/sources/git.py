"""Git as a source: commits per file, the working diff, and a revision's files. Failures give empty tables."""

from __future__ import annotations

import io
import subprocess
import tarfile

from pyspark.sql import DataFrame, SparkSession


def _run(root: str, *args: str, timeout: int = 60) -> bytes | None:
    try:
        return subprocess.run(["git", *args], cwd=root, capture_output=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def commits(spark: SparkSession, root: str, days: int = 90) -> DataFrame:
    """(commit_id, path, ts) of the last ``days`` days."""
    out, rows, commit, ts = _run(root, "log", f"--since={days} days ago", "--name-only", "--format=%x01%H %ct"), [], "", 0
    for line in (out or b"").decode("utf-8", "replace").splitlines():
        if line.startswith("\x01"):
            commit, seconds = line[1:].split()
            ts = int(seconds)
        elif line:
            rows.append((commit, line, ts))
    return spark.createDataFrame(rows, "commit_id string, path string, seconds bigint").selectExpr("commit_id", "path", "timestamp_seconds(seconds) AS ts")


def diff_paths(root: str) -> tuple[str, ...]:
    out = _run(root, "diff", "HEAD", "--name-only", "-z")
    return tuple(x for x in (out or b"").decode("utf-8", "replace").split("\0") if x)


def revision_files(spark: SparkSession, root: str, rev: str) -> DataFrame | None:
    """(path, size, content) of all files of a revision; None if there is no such revision."""
    out = _run(root, "archive", "--format=tar", rev, timeout=120)
    if out is None:
        return None
    rows = []
    with tarfile.open(fileobj=io.BytesIO(out)) as tar:
        for m in tar:
            if m.isfile():
                rows.append((m.name, m.size, tar.extractfile(m).read()))
    return spark.createDataFrame(rows, "path string, size bigint, content binary")
