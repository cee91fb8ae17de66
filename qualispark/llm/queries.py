"""The registered corpus queries: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualispark.llm import (
    chat_format,
    decontaminate,
    filter_audit,
    html_text,
    line_dedup,
    metric_join,
    oracles,
    packing,
    product_codes,
    quality_rules,
    simhash,
    site_quality,
    sstable,
    suffix_tree,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), path))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder, manifest = sstable.write_shards(_table(spark, sf_dir, "documents"), path)
    return sstable.digest(manifest, folder)


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(_table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(tricky).alias("text"),
    )
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(extra)))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.encode(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.group(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_simhash,
    op2_packing,
    op3_sstable,
    op4_site_quality,
    op5_suffix_tree,
    op6_decontamination,
    op7_line_dedup,
    op8_quality_rules,
    op9_chat_format,
    op10_html_text,
    op11_product_codes,
    op12_filter_audit,
    op13_metric_join,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
