"""Tables that explode: Spark's sizes don't count the rows that come of it, so they must not be left to choose a broadcast."""

from pyspark.sql import functions as F

from qualispark.llm import metric_join, simhash


def test_cells_of_fingerprints_are_not_broadcast(spark):
    """op1_simhash: 300,000 fingerprints passed for 7 MB, their 28 cells each were 856 MB on the driver."""
    prints = spark.range(2000).select(F.xxhash64("id").alias("fingerprint")).distinct()
    found = simhash.links(prints)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_of_regions_are_not_broadcast(spark, monkeypatch):
    """op13_metric_join: points of a region that pivots don't separate are in as many blocks as it has."""
    monkeypatch.setattr(metric_join, "REGION", 8)
    plans = []

    def joined(self, members, sets, was=metric_join._Join.joined):
        plans.append(was(self, members, sets)._jdf.queryExecution().executedPlan().toString())
        return was(self, members, sets)

    monkeypatch.setattr(metric_join._Join, "joined", joined)
    # 8 of 10 shingles are everyone's: too few for a link, and every pivot is as far as any other
    rows = [(i, " ".join([f"s{k}" for k in range(12)] + [f"a{i}", f"b{i}"])) for i in range(40)]
    found = metric_join.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(i, i) for i in range(40)]
    assert len(plans) == 1 and "Generate explode" in plans[0] and "Join" in plans[0] and "Broadcast" not in plans[0]
