"""The corpus pipeline: documents in, packed token sequences out, in stages that are each written as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import line_dedup, near_dup, packing, quality, secrets
from codeloom.llm.common import stored


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars goes with the text."""
    return docs.selectExpr(*("cast(coalesce(length(text), 0) as long) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines that are frequent on their host."""
    return _measured(quality.keep_good(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, those of a few words if they equal it; so do documents without a word left."""
    return _measured(line_dedup.dedup_lines(docs)).where(r"text RLIKE '[^\\x20\\x09-\\x0D]'")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return _measured(secrets.mask_secrets(docs, secrets.learn_formats(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("packing", pack)]
#: Automata, sketches and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
