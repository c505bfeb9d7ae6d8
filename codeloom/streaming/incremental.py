"""Incremental extraction: a stream of changed files keeps the extraction cache up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import change
from codeloom.schemas import FILE_MAP
from codeloom.sources.extract import extract
from codeloom.sources.mapdoc import spec_hash


def update(spark: SparkSession, cache_dir: str, files: DataFrame, version: int) -> dict[str, int]:
    """Extract those of ``files`` (path, content) that the cache lacks, and write version ``version`` of it.

    The cache keeps one row per path; versions are folders, so a reader never sees half of one, and a batch that runs
    again writes the same folder. Rows of another extractor (``mapdoc.spec_hash``) are never served: each has a cache of
    its own. Returns counts of reused and extracted files; a batch without changes writes nothing.
    """
    cache_dir = f"{cache_dir}/spec={spec_hash()}"
    latest = _latest(spark, cache_dir, version)
    now = files.withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16))
    misses = now if latest is None else change.cache_misses(now, latest)
    n = misses.count()
    total = files.count()
    if n:
        fresh = extract(misses.select("path", "content"))
        merged = fresh if latest is None else latest.join(misses.select("path"), "path", "left_anti").select(fresh.columns).unionByName(fresh)
        merged.write.mode("overwrite").parquet(f"{cache_dir}/v={version:08d}")
    return {"reused": total - n, "extracted": n}


def _latest(spark: SparkSession, cache_dir: str, before: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    names = [n for n in names if int(n[2:]) < before]
    return spark.read.schema(FILE_MAP).parquet(f"{cache_dir}/{names[-1]}") if names else None


def sink(cache_dir: str, done: Callable[[int, dict[str, int]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each batch updates the cache; equal batches are no-ops."""

    def write(batch: DataFrame, number: int) -> None:
        counts = update(batch.sparkSession, cache_dir, batch.dropDuplicates(["path"]), number + 1)
        if done:
            done(number, counts)

    return write
