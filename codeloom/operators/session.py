"""Session ledgers: what an agent's transcript says about its context."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Records as they are read from JSON lines.
RECORD = (
    "type string, sessionId string, message struct<usage: struct<input_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>, "
    "content: array<struct<type: string, name: string, text: string, content: string, caller: struct<type: string>, input: struct<file_path: string, path: string, target: string, offset: int, `limit`: int>>>>"
)


def records(lines: DataFrame) -> DataFrame:
    """``lines`` (value, ...) with record; blank and malformed lines and those that are no objects are left out."""
    body = F.trim("value")
    return lines.where(F.startswith(body, F.lit("{"))).withColumn("record", F.from_json(body, RECORD, {"mode": "PERMISSIVE"})).where(F.try_parse_json(body).isNotNull())


def find_transcript(folder: str, root: str, session: str | None = None) -> str | None:
    """The transcript of a session of the project at ``root`` below an agent's ``folder``, or the one changed last; None if
    there is none."""
    project = Path(folder, re.sub(r"[/\\:]", "-", str(root)))
    if session:
        path = project / f"{session}.jsonl"
        return str(path) if path.is_file() else None
    found = sorted(project.glob("*.jsonl"), key=lambda p: p.stat().st_mtime) if project.is_dir() else []
    return str(found[-1]) if found else None


def read_transcript(spark, path: str) -> DataFrame:
    """(seq, record) of JSON-lines files, one record a line and in their order: files are split between tasks, and seq grows
    with the place in a file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), "value")
    return records(lines).select("seq", "record")


def _rel(path, root: str):
    """A path under the root as a relative one; null outside of it."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    inside = F.when(F.startswith(plain, F.lit(base)), F.substr(plain, F.lit(len(base) + 1)))
    return F.when(plain == "", None).when(F.startswith(plain, F.lit("/")) | plain.rlike("^[A-Za-z]:"), inside).otherwise(plain)


def facts(rows: DataFrame, root: str, mark: str = "codeloom") -> DataFrame:
    """Flat rows (seq, session_id, type, usage, estimate, path, offset, limit, emitted) from records, one per block at least."""
    m = F.col("record.message")
    total = F.coalesce(m["usage"]["input_tokens"], F.lit(0)) + F.coalesce(m["usage"]["cache_read_input_tokens"], F.lit(0)) + F.coalesce(m["usage"]["cache_creation_input_tokens"], F.lit(0))
    each = rows.select("seq", F.col("record.sessionId").alias("session_id"), F.col("record.type").alias("type"), F.when((F.col("record.type") == "assistant") & m["usage"].isNotNull() & (total > 0), total).alias("usage"), F.posexplode_outer(m["content"]).alias("block", "b"))
    tool = (F.col("b.type") == "tool_use") & (F.coalesce(F.col("b.caller.type"), F.lit("direct")) == "direct")
    reads, emits = tool & (F.col("b.name") == "Read"), tool & F.lower("b.name").contains(mark)
    path = F.when(reads, _rel(F.col("b.input.file_path"), root)).when(emits, F.coalesce(_rel(F.col("b.input.target"), root), _rel(F.col("b.input.path"), root)))
    text = F.when((F.col("b.type").isNull()) | (F.col("b.type") != "tool_use"), F.floor(F.length(F.coalesce("b.content", "b.text")) / 4))
    first = F.coalesce("block", F.lit(0)) == 0  # what is of the record counts once
    return each.select("seq", "session_id", F.when(first, F.col("type")).alias("type"), F.when(first, F.col("usage")).alias("usage"), text.alias("estimate"), path.alias("path"), F.when(reads, F.col("b.input.offset")).alias("offset"), F.when(reads, F.col("b.input.limit")).alias("limit"), F.coalesce(emits, F.lit(False)).alias("emitted"))


def sessions(flat: DataFrame) -> DataFrame:
    """(session_id, turns, consumed): assistant records, and the highest usage or else the sum of estimates."""
    return flat.groupBy("session_id").agg(F.count_if(F.col("type") == "assistant").alias("turns"), F.coalesce(F.max("usage"), F.sum("estimate"), F.lit(0)).alias("consumed"))


def seen_symbols(reads: DataFrame, symbols: DataFrame) -> DataFrame:
    """(session_id, path, id): symbols that begin in the lines read. Without offset and limit a read is of the whole file."""
    low = F.coalesce(F.col("offset"), F.lit(1))
    whole = F.col("offset").isNull() & F.col("limit").isNull()
    found = reads.where("path IS NOT NULL").join(symbols.select("path", "id", "start_line"), "path")
    return found.where(whole | ((F.col("start_line") >= low) & (F.col("limit").isNull() | (F.col("start_line") < low + F.col("limit"))))).select("session_id", "path", "id").distinct()


def session_files(reads: DataFrame, symbols: DataFrame, k: int | None = None) -> DataFrame:
    """(session_id, path, fully_read, symbols) of files in context, those with most symbols first; the first ``k`` of each
    session."""
    whole = F.col("offset").isNull() & F.col("limit").isNull()
    files = reads.where("path IS NOT NULL").groupBy("session_id", "path").agg(F.bool_or(whole).alias("fully_read"))
    n = seen_symbols(reads, symbols).groupBy("session_id", "path").agg(F.count("*").alias("symbols"))
    out = files.join(n, ["session_id", "path"], "left").fillna(0, ["symbols"])
    if k is not None:
        rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("symbols"), "path"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    return out.orderBy("session_id", F.desc("symbols"), "path")


def totals(flat: DataFrame, reads: DataFrame, symbols: DataFrame) -> DataFrame:
    """(session_id, turns, consumed, files, files_whole, symbols) of each session."""
    found = session_files(reads, symbols).groupBy("session_id").agg(F.count("*").alias("files"), F.count_if("fully_read").alias("files_whole"), F.sum("symbols").alias("symbols"))
    return sessions(flat).join(found, "session_id", "left").fillna(0, ["files", "files_whole", "symbols"])


def remaining(consumed, window: int = 200_000, floor: int = 20_000):
    return F.greatest(F.lit(window) - consumed, F.lit(floor))


def adaptive_k(left):
    """How many pointers a prompt gets: five of a full window, one at least."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.floor(5 * left / 180_000)))
