"""Session ledgers as streams: transcripts arrive as lines of JSON files, the state is a monotone fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import session


def transcript_stream(spark: SparkSession, folder: str, root: str, mark: str = "codeloom") -> DataFrame:
    """Flat facts (``session.facts``) of all JSON-lines files in a folder, as they grow in number."""
    lines = spark.readStream.format("text").load(folder)
    records = session.records(lines).withColumn("seq", F.lit(0)).select("seq", "record")
    return session.facts(records, root, mark)


def session_totals(facts: DataFrame) -> DataFrame:
    """(session_id, turns, usage, estimate, files): sums, a maximum and a set, so late and repeated batches do no harm to
    order. For output mode complete or update."""
    return facts.groupBy("session_id").agg(F.count_if(F.col("type") == "assistant").alias("turns"), F.max("usage").alias("usage"), F.sum("estimate").alias("estimate"), F.array_sort(F.collect_set("path")).alias("files"))


def churn_stream(commits: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Commits per file and tumbling window, with a watermark: for output mode append."""
    return commits.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "path").agg(F.count("*").alias("commits")).select(F.col("w.start").alias("start"), "path", "commits")
