"""Held-out accuracy of the classifier and the shrinkage of sites."""

from pyspark.sql import functions as F

from qualispark.llm import site_quality as sq


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    scored = sq.classify(docs, labels.filter(~fold)).join(labels.filter(fold), "doc_id")
    row = scored.agg(
        F.avg(((F.col("quality_posterior") >= 0.5) == (F.col("quality") == 1)).cast("int")).alias("quality"),
        F.avg(((F.col("toxic_posterior") >= 0.5) == (F.col("toxic") == 1)).cast("int")).alias("toxic"),
        F.avg(F.when(F.col("toxic") == 1, (F.col("toxic_posterior") >= 0.5).cast("int"))).alias("caught"),
    ).first()
    print(row)
    assert row["quality"] > 0.97 and row["toxic"] > 0.97 and row["caught"] > 0.85


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [(i, "good", "good/a", 0.9 if i % 10 else 0.6, 0.01) for i in range(400)]
    rows += [(1000 + i, "bad", "bad/a", 0.2 if i % 10 else 0.6, 0.01) for i in range(400)]
    rows += [(2000, "lone", "lone/a", 0.6, 0.01), (2001, "pair", "pair/a", 0.6, 0.01), (2002, "pair", "pair/a", 0.1, 0.01)]
    got = {r["doc_id"]: r for r in sq.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, p_quality double, p_toxic double")).collect()}
    assert len(got) == len(rows)
    good, bad, lone, pair = (got[i]["quality_posterior"] for i in (0, 1000, 2000, 2001))
    assert good > lone > bad and abs(lone - 0.6) < 0.05 and good > pair > bad


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 1), (4, 0, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sq.classify(odd_docs, labels).count() == odd_docs.count()
    assert sq.classify(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert sq.classify(no_docs, labels).count() == 0
