"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, line_dedup, near_dup, packing, pii, quality, secrets, token_count, topk_search, url_filter
from codeloom.llm.common import table
from codeloom.llm.oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_exact", "n_near"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key here is for tests; a production key comes from a secret store."""
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), "example key", found_col="found").select("doc_id", "text", *(F.col("found")[k].cast("long").alias(f"n_{k}") for k in pii.KINDS))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").select("vec_id", topk_search.quantized(F.col("embedding")).alias("vector"))
    return topk_search.top_k(data.where("vec_id % 20 = 0"), data)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.learn_formats(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time, which the table lacks: a day and hour of 2024 by the page's id."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 360 as int), cast(page_id % 24 as int))").alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made from the hosts of the pages: hosts enter, leave and come back by their lengths and letters."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("domain")).dropna().distinct()
    n, first = F.length("domain"), F.ascii("domain")
    steps = [("ads", n % 3 == 0, "add", n * 7 % 200), ("ads", n % 6 == 0, "remove", n * 7 % 200 + 60), ("ads", n % 12 == 0, "add", n * 7 % 200 + 90), ("malware", first % 4 == 0, "add", first % 50 + n), ("malware", first % 8 == 0, "remove", first % 50 + n + 100)]
    each = F.array(*(F.when(c, F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), day.alias("day"))) for name, c, action, day in steps))
    out = hosts.select("domain", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("e"))
    return out.select("e.list", F.when(n % 5 == 0, F.substring_index("domain", ".", -3)).otherwise(F.col("domain")).alias("domain"), "e.action", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(e.day)").alias("at"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures(spark, sf_dir)
    out = url_filter.filter_urls(found, list_entries(found))
    return out.select("page_id", "host", "blocked", F.array_join("lists", ",").alias("lists"), "matched", F.date_format("listed_since", "yyyy-MM-dd").alias("listed_since"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_pii, op4_bpe, op5_token_counts, op6_topk, op7_near_duplicates, op8_secrets, op9_packing, op10_url_filter)}
