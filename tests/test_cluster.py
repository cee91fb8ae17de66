"""k-means against plain steps, and its silhouette against all pairs."""

import numpy as np
import pytest

from qualispark.operators import cluster


def blobs(spark, parts=3):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.4, (60, 2)) for m in ((0, 0), (5, 0), (0, 6), (6, 6))]) * [1, 100]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)]
    return x, spark.createDataFrame(rows, "i int, a double, b double").repartition(parts)


def test_blobs_are_found_and_k_is_chosen(spark):
    x, df = blobs(spark)
    got = cluster.kmeans(df, ["a", "b"], k_max=6).collect()
    assert [r["n"] for r in got] == [60] * 4 and got[0]["k"] == 4
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    label = np.repeat(range(4), 60)
    centers = np.array([z[label == k].mean(0) for k in range(4)])
    assert got[0]["inertia"] == pytest.approx(((z - centers[label]) ** 2).sum())
    d = ((z[:, None] - z) ** 2).sum(2)
    s = []
    for i in range(240):
        a = d[i, label == label[i]].sum() / 59
        b = min(d[i, label == k].mean() for k in range(4) if k != label[i])
        s.append((b - a) / max(a, b))
    assert got[0]["silhouette"] == pytest.approx(np.mean(s))
    own = sorted(x[label == k].mean(0).tolist() for k in range(4))
    assert [[r["a"], r["b"]] for r in got] == [pytest.approx(c) for c in own]
    told = cluster.assign(df, cluster.kmeans(df, ["a", "b"], 4), ["a", "b"]).collect()
    by = {r["i"]: r["cluster"] for r in told}
    assert by[999] is None and len({by[i] for i in range(60)}) == 1 and len(set(by.values())) == 5


def test_result_does_not_depend_on_partitions(spark):
    a = cluster.kmeans(blobs(spark, 1)[1], ["a", "b"], 3).collect()
    b = cluster.kmeans(blobs(spark, 7)[1], ["a", "b"], 3).collect()
    assert [r["n"] for r in a] == [r["n"] for r in b] and a[0]["inertia"] == pytest.approx(b[0]["inertia"])


def test_steps_end_at_a_fixed_point(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(size=(200, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = cluster.kmeans(df, ["a", "b", "c"], 5, standardize=False).collect()
    centers = np.array([[r[c] for c in "abc"] for r in got])
    label = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
    assert [int((label == k).sum()) for k in range(5)] == [r["n"] for r in got]
    assert np.array([x[label == k].mean(0) for k in range(5)]) == pytest.approx(centers, abs=1e-6)


def test_few_and_equal_rows(spark):
    same = spark.createDataFrame([(1.0, 2.0)] * 8, "a double, b double")
    got = cluster.kmeans(same, ["a", "b"], 3).collect()
    assert len(got) == 1 and got[0]["n"] == 8 and got[0]["inertia"] == 0
    with pytest.raises(ValueError):
        cluster.kmeans(same.limit(2), ["a", "b"])
    with pytest.raises(ValueError):
        cluster.kmeans(same, ["a", "b"], 1000)


def test_equal_rows_are_one_with_a_weight(spark):
    """Passes go over distinct rows: many copies are no more work, and change a result only as their number does."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 2)).round(1)
    times = rng.integers(1, 9, 150)
    df = spark.createDataFrame([tuple(map(float, r)) for r, t in zip(x, times, strict=True) for _ in range(t)], "a double, b double")
    rows, *_, n = cluster._scaled(df, ["a", "b"], True)
    assert n == times.sum() and rows.count() == len(np.unique(x, axis=0)) and rows.agg({"w": "sum"}).first()[0] == n
    got = cluster.kmeans(df, ["a", "b"], 3, standardize=False).collect()
    every, centers = np.repeat(x, times, axis=0), np.array([[r["a"], r["b"]] for r in got])
    d = ((every[:, None] - centers) ** 2).sum(2)
    assert np.bincount(d.argmin(1)).tolist() == [r["n"] for r in got] and got[0]["inertia"] == pytest.approx(d.min(1).sum())
    pairs = ((every[:, None] - every) ** 2).sum(2)
    label = d.argmin(1)
    s = []
    for i, k in enumerate(label):
        a = pairs[i, label == k].sum() / ((label == k).sum() - 1)
        b = min(pairs[i, label == j].mean() for j in range(3) if j != k)
        s.append((b - a) / max(a, b))
    assert got[0]["silhouette"] == pytest.approx(np.mean(s))
