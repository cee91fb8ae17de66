"""Suffix-tree scores against a direct computation."""

import math
import zlib
from collections import Counter

import numpy as np

from qualispark.llm import suffix_tree as st


def brute(rows, depth):
    docs = [(d, [*(t or "").encode().lower().split(), b" "]) for d, t in rows]
    learn = [w for d, w in docs if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    count = [Counter(tuple(w[i - n : i + 1]) for w in learn for i in range(n, len(w))) for n in range(depth + 1)]
    total, kinds, kept = sum(count[0].values()), len(count[0]), {()}

    def probability(history, w):
        """In the longest kept suffix of the history."""
        p = (count[0][(w,)] + st.ADD) / (total + st.ADD * (kinds + 1))
        for n in range(1, min(depth, len(history)) + 1):
            c = tuple(history[-n:])
            if c in kept:
                p = (count[n][(*c, w)] + st.STRENGTH * p) / (count[n - 1][c] + st.STRENGTH)
        return p

    tried = {()}
    for n in range(1, depth + 1):
        def may(c, n=n):
            return count[n - 1][c] >= st.LEAST and c[:-1] in tried and (n < 3 or c[2:] in kept)

        candidates = {c for c in count[n - 1] if may(c)}
        gain = Counter()
        for (*c, w), times in count[n].items():
            c = tuple(c)
            if c in candidates:
                parent, of = probability(c[1:], w), count[n - 1][c]
                gain[c] += times * math.log((times - 1 + st.STRENGTH * parent) / (of - 1 + st.STRENGTH) / parent)
        kept |= {c for c, g in gain.items() if g > st.GAIN and g > st.GAIN_RATE * count[n - 1][c]}
        tried |= candidates
    out = []
    for d, words in docs:
        base = sum(math.log10(probability((), w)) for w in words)
        score = sum(math.log10(probability(words[max(0, i - depth) : i], w)) for i, w in enumerate(words))
        out.append((d, len(words), sum(count[0][(w,)] > 0 for w in words), total, base, score))
    return out, Counter(map(len, kept))


def check(docs, depth=st.MAX_DEPTH, **options):
    want, sizes = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], depth)
    got = st.score(docs, max_depth=depth, **options).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    for a, b in zip(mine, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4]
        assert math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9), (a, b)
    return got, sizes


def test_whole_table(spark, sf):
    got, sizes = check(spark.read.parquet(f"{sf}/documents.parquet").repartition(3), chunk_bytes=20_000)
    assert sizes[1] > 5 and sizes[2] > 1
    out = [r for r in got if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert max(r["longest"] for r in got) <= max(sizes)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_depth_grows_with_the_evidence(spark):
    """Words that only the fourth word before tells apart need contexts of four words."""
    rows = [(i, " ".join(f"{s} x y z {e}" for s, e in [("a", "one"), ("b", "two")] for _ in range(3))) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, sizes = check(docs, 5)
    assert sizes[4] and max(r["longest"] for r in got) >= 4
    deep = sum(r["score"] for r in got)
    for depth in (1, 2):
        got, _ = check(docs, depth)
        assert max(r["longest"] for r in got) <= depth and sum(r["score"] for r in got) < deep


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs)
    check(odd_docs.filter("doc_id is null"))
    assert st.score(no_docs).count() == 0


def test_requests_are_short(spark, sf, monkeypatch):
    """A key of an n-gram is as long as the numbers of its context and word, not as a hash."""
    rounds, answers = [], st._answers

    def seen(requests, *rest):
        rounds.append([st._unpack(r["asked"]) for r in requests.select("asked").collect()])
        return answers(requests, *rest)

    monkeypatch.setattr(st, "_answers", seen)
    st.score(spark.read.parquet(f"{sf}/documents.parquet").repartition(3), chunk_bytes=20_000)
    assert len(rounds) > 3
    for d, asked in enumerate(rounds[1:], 1):
        for name, most in (("gap", 20), ("cgap", 8)):
            gaps = np.concatenate([a[name] for a in asked])
            assert not len(gaps) or np.log2(gaps.astype(float) + 1).mean() < most, (d, name)


def test_contexts_of_one_chunk_and_of_several(spark):
    """Words, pairs and triples seen often in one document alone, in all, and in two of them."""
    rows = []
    for i in range(1, 25):
        own = " ".join(f"own{i} pair{i} {'left' if j % 2 else 'right'} w{j % 3}" for j in range(20))
        two = " ".join(f"two{i // 2} half{i // 2} {'up' if j % 2 else 'down'}" for j in range(12))
        rows.append((i, " ".join([own, two, *(f"all x y {'one' if j % 2 else 'two'}" for j in range(9))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for size in (100, 5000, 1 << 20):
        _, sizes = check(docs, chunk_bytes=size)
        assert all(sizes[n] for n in (1, 2))


def test_names_tell_pairs_apart():
    context, word = np.divmod(np.arange(1 << 14), 1 << 7)
    for widths, bits in (((7, 7), 8), ((7, 7), 20), ((30, 34), 9), ((40, 40), 9)):
        names = st._name(context, word, widths, bits)
        assert len(np.unique(names)) == len(names)
        width = max(sum(widths), bits) if sum(widths) < 64 else 64
        order, slices = np.sort(names), np.sort(names) >> np.uint64(64 - bits)
        for s in np.unique(slices):
            own = order[slices == s]
            back = (np.cumsum(st._gaps(own, bits, width), dtype=np.uint64) << np.uint64(64 - width)) + (s << np.uint64(64 - bits))
            assert (back == own).all()
