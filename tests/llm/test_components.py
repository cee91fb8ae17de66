"""Components of small graphs in one task, of larger ones by rounds."""

import random

import pytest

from qualispark.llm import simhash


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("most", [1 << 17, 3])
def test_components_of_small_and_large_graphs(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "FOREST", most)
    rng = random.Random(3)
    wide = [(rng.randrange(-(2**63), 2**63), rng.randrange(-(2**63), 2**63)) for _ in range(20)]
    star, chain = [(5000, 5000 + i) for i in range(1, 60)], [(9000 - i, 8999 - i) for i in range(40)]
    pairs = [tuple(rng.sample(range(200), 2)) for _ in range(120)]
    edges = wide + star + chain + pairs + pairs[:9] + [(b, a) for a, b in pairs[:9]]
    found = simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert found.columns == ["node", "root"] and {r["node"]: r["root"] for r in found.collect()} == plain(edges)
    assert found.count() == len(plain(edges))
    assert not simhash.components(spark.createDataFrame([], "a long, b long")).collect()


def test_a_small_graph_takes_few_jobs(spark):
    edges = spark.createDataFrame([(1, i) for i in range(2, 50)], "a long, b long").coalesce(1)
    tracker, group = spark.sparkContext.statusTracker(), "components-of-a-star"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert simhash.components(edges).count() == 48
        assert len(tracker.getJobIdsForGroup(group)) <= 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
