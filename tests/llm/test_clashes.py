"""Stages on tables whose columns have the names that the stages might use, on odd and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qualispark.llm import decontaminate, line_dedup, near_documents, quality_rules

NAMES = ("__text", "__row", "__left", "__gone", "__id", "__hash", "__hit", "__text_hash", "text_hash", "row_hash", "first", "root")
TEXTS = ("one two three four five six seven eight nine ten\nshared line of several words here", "shared line of several words here\nbut this text goes on for itself", "a b c", None, "")


def stages(spark):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten shared")], "item_id long, text string")
    return {
        "quality": quality_rules.passing,
        "lines": line_dedup.cleaned,
        "near": near_documents.representatives,
        "benchmark": lambda d: decontaminate.cleaned(d, bench),
    }


@pytest.mark.parametrize("name", ["quality", "lines", "near", "benchmark"])
def test_columns_of_any_name_stay(spark, name):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    for k, c in enumerate(NAMES):
        docs = docs.withColumn(c, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    got = stages(spark)[name](docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert [r[c] for c in NAMES] == [f"{k}-{r['doc_id']}" for k in range(len(NAMES))]
        if r["text"] == TEXTS[r["doc_id"]]:
            assert r["n_chars"] == 7
        else:
            assert r["n_chars"] == len(r["text"])


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= max(1000, docs.count())
            if stage is not corpus_pipeline.pack:
                assert out.columns == docs.columns
                docs = out
