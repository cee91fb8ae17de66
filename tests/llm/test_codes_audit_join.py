"""Vector codes, the filter audit and the metric join against plain computations."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from qualispark.llm import filter_audit, metric_join, product_codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in kept]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : (p + 1) * w] for r in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[nearest(v[p * w : (p + 1) * w], books[p])[1]].append(v[p * w : (p + 1) * w])
            for e, members in got.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, labels = [], Counter()
    for i, v, g in kept:
        found = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        labels[g] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, g))
    return [(i, code, error, labels[g], sha) for i, code, error, g in out]


VECTORS = "vec_id long, embedding array<float>, label int, v string, now int, error int, was int"


def coded(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS).repartition(parts)
    return sorted((tuple(r) for r in product_codes.encode(df, **more).collect()), key=str)


def test_codes_against_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(90)]
    rows = [(i, [float(np.float32(x)) for x in v], g) for i, v, g in rows]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (201, [nan] + [0.0] * 7, 1), (202, [None] + [0.0] * 7, 2), (203, [-inf] + [0.0] * 7, None)]
    rows += [(None, rows[0][1], None), (3, rows[5][1], 2), (7, rows[7][1], rows[7][2])]  # no id, a repeated id, a repeated row
    for entries in (16, 256):
        want = sorted(plain_codes(rows, entries=entries), key=str)
        assert coded(spark, rows, entries=entries) == want == coded(spark, rows[::-1], parts=1, entries=entries)


def test_codes_of_few_and_of_bad_vectors(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    same = [(i, [0.5] * 4, None) for i in range(5)]
    assert coded(spark, same) == sorted(plain_codes(same), key=str)
    assert coded(spark, [(1, [], 1)])[0][:4] == (1, "00000000", 0, 0)
    for bad in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(ValueError):
            coded(spark, bad)


def test_rounds_shuffle_changed_parts_alone(spark):
    """Contributions of a round add up to the difference of the sums over all parts."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS)
    from pyspark.sql import functions as F

    state = product_codes._kept(df, "vec_id", "embedding", "label").withColumn("now", F.lit(None).cast("binary"))
    books = rng.integers(-1000, 1000, (4, 8, 2))
    one = product_codes._assigned(state, books)
    two = product_codes._assigned(one.drop("was", "error"), books + rng.integers(-200, 200, books.shape))
    moved = two.filter("was <> now").count()
    assert 0 < moved < 60

    def total(deltas):
        return {(r["part"], r["entry"]): (r["n"], r["sums"]) for r in product_codes._added(deltas, 2).collect() if r["n"] or any(r["sums"])}

    every = total(product_codes._contributions(two.withColumn("was", F.lit(None).cast("binary")), 4, 8, 2))
    step = product_codes._contributions(one, 4, 8, 2).unionByName(product_codes._contributions(two, 4, 8, 2))
    assert total(step) == every


def plain_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, part in docs:
        t = t or ""
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        fails = set()
        fails |= {"A"} if len(w) < 100 else set()
        fails |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and i > least[t] else set()
        parts[part or ""].append((i, fails))
    out = []
    for part, rows in parts.items():
        removed_by = Counter()
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in rows if f in r[1]]
                removed_by[f] += len(gone)
                lines.append((part, order, step, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out += [(*x, removed_by[x[1][x[2] - 1]]) for x in lines]
    return out


def test_audit_against_plain_orders(spark, odd_docs, no_docs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    for i in range(120):
        text = " ".join(rng.choice([x, x.upper()]) if i % 5 == 0 else x for x in rng.choices(words[: rng.choice([20, 300])], k=rng.choice([5, 99, 100, 140])))
        docs.append((i, text + rng.choice(["", "", " #", "\n|"]), rng.choice(["en", "", None, "de"])))
    docs += [(i + 500, t, g) for i, t, g in docs[20:60] if i is not None] + docs[-5:]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(-10, 700, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    df = spark.createDataFrame([(*d, "q", 1, 2) for d in docs], "doc_id long, text string, lang string, mask string, good int, least int").repartition(3)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = sorted(tuple(r) for r in filter_audit.audit(df, marks).collect())
    assert got == sorted(plain_audit(docs, labels))
    assert filter_audit.audit(no_docs, marks).count() == 0
    none = marks.filter("false")
    assert sorted(tuple(r) for r in filter_audit.audit(odd_docs, none).collect()) == sorted(plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()], []))


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_groups(rows):
    """doc_id, n_shingles, component_id of (id, text) rows, by all pairs."""
    sets, root, by_gram = [grams(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in by_gram[g]}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in s:
            by_gram[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def grouped(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, region int, cls string").repartition(parts)
    return sorted((tuple(r) for r in metric_join.group(df).collect()), key=str)


def families(rng, bases, copies, words=(8, 200)):
    """Texts with copies in which some words or line breaks changed, some near the radius."""
    texts = []
    for b in range(bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(*words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
            texts.append("".join(x + rng.choice([" ", " ", "\n"]) for x in w))
    return texts


def test_join_against_all_pairs(spark):
    texts = families(random.Random(8), 40, 7)
    rows = list(enumerate(texts))
    want = plain_groups(rows)
    assert 0.2 * len(rows) < len({r[2] for r in want}) < 0.9 * len(rows)
    assert grouped(spark, rows) == want


@pytest.mark.parametrize("region,leaf", [(8, 2), (40, 4)])
def test_cells_on_the_cluster_and_in_tasks(spark, monkeypatch, region, leaf):
    """Small regions make large ones of every family: cells, borders and blocks all have to find the links."""
    monkeypatch.setattr(metric_join, "REGION", region)
    monkeypatch.setattr(metric_join, "LEAF", leaf)
    rng = random.Random(region)
    shared = [f"s{i}" for i in range(14)]
    rows = list(enumerate(families(rng, 3, 40, (30, 60))))
    for family in range(6):  # strangers and families under the same rare shingles
        base = shared + [f"f{family}w{i}" for i in range(30)]
        for copy in range(7):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"v{copy}"
            rows.append((len(rows), " ".join(w)))
    assert grouped(spark, rows) == plain_groups(rows)


def test_chain_longer_than_the_radius(spark, monkeypatch):
    """Ends of a chain are far apart and yet one component."""
    monkeypatch.setattr(metric_join, "REGION", 16)
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(60)]
    want = plain_groups(rows)
    assert len({r[2] for r in want}) == 1
    assert grouped(spark, rows) == want


def test_region_finds_links_at_the_border():
    rng = random.Random(5)
    universe = list(range(400))
    for _ in range(20):
        sets = []
        for _ in range(6):
            base = rng.sample(universe, rng.randrange(5, 60))
            for _ in range(12):
                s = set(base)
                for _ in range(rng.randrange(1 + len(base) // 5)):
                    s.discard(rng.choice(base))
                    s.add(rng.choice(universe))
                sets.append(np.array(sorted(s), np.int64))
        own = np.array(rng.sample(range(len(sets)), 50))
        guests = np.array(sorted(set(range(len(sets))) - set(own.tolist())))
        region = metric_join.Region(list(range(len(sets))), sets)
        found = region.join(own, guests)

        def joined(pairs):
            root = list(range(len(sets)))
            for a, b in pairs:
                root = [root[a] if r == root[b] else r for r in root]
            return {frozenset(i for i, r in enumerate(root) if r == k) for k in set(root)}

        every = [(i, j) for i in own.tolist() for j in range(len(sets)) if i != j and metric_join._linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        assert joined(found) == joined(every)


def test_packed_sets():
    rng = np.random.default_rng(2)
    for n in (1, 2, 700):
        tokens = rng.integers(-(1 << 62), 1 << 62, n)
        assert metric_join.unpacked(metric_join.packed(tokens)).tolist() == sorted({int(t) & ((1 << 46) - 1) for t in tokens})
    assert metric_join.unpacked(metric_join.packed(np.zeros(3, np.int64))).tolist() == [0]


def test_join_of_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in metric_join.group(docs).collect()), key=str) == want


def test_join_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows += [(None, "only here"), (11, "  "), (12, None), (None, None), (13, rows[0][1]), (13, "other words under the same id of a row")]
    assert grouped(spark, rows) == plain_groups(rows) == grouped(spark, rows[::-1], 1)
    assert metric_join.group(no_docs).count() == 0
    assert metric_join.group(odd_docs).count() == odd_docs.count()
