"""The stage of near-duplicates against all pairs."""

import random
from collections import defaultdict

import corpus_pipeline
from qualispark.llm import near_documents


def grams(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def roots(texts):
    """The first text of the component of each text."""
    sets, by_gram = [grams(t) for t in texts], defaultdict(list)
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, s in enumerate(sets):
        for j in {j for g in s for j in by_gram[g]}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in s:
            by_gram[g].append(i)
    return [find(i) for i in range(len(texts))]


def kept(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    return [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()]


def near_copies(rng, n, bases):
    """Texts of 8 to 300 words with copies in which a few words or line breaks changed."""
    texts = []
    for b in range(bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(8, 300))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 30)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
            texts.append("".join(x + rng.choice([" ", " ", "\n"]) for x in w))
    return texts


def test_near_copies_against_all_pairs(spark):
    texts = near_copies(random.Random(8), 6, 40)
    want = roots(texts)
    assert len(set(want)) < 0.8 * len(texts)
    got = kept(spark, [(i, t, "en") for i, t in enumerate(texts)])
    assert sorted(r[0] for r in got) == sorted(set(want))


def test_large_family_over_blocks(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:at] + [f"v{i}"] + base[at + 1 :]) for i in range(700) for at in [rng.randrange(60)]]
    assert len(texts) > near_documents.BLOCK
    got = kept(spark, [(i, t, "en") for i, t in enumerate(texts)])
    assert sorted(r[0] for r in got) == sorted(set(roots(texts)))


def test_strangers_under_a_frequent_token(spark, monkeypatch):
    """Families that share their rarest shingles but are no copies of each other stay apart, whatever the blocks."""
    monkeypatch.setattr(near_documents, "BLOCK", 8)
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(8)]
    texts = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(30)]
        for copy in range(5):
            words = shared + base
            words[rng.randrange(len(words))] = f"v{copy}"
            texts.append(" ".join(words))
    got = kept(spark, [(i, t, "en") for i, t in enumerate(texts)])
    assert sorted(r[0] for r in got) == sorted(set(roots(texts)))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = {rows[i][0] for i in roots([r[1] or "" for r in rows])}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == want


def test_null_and_repeated_ids(spark):
    """Groups are of texts: an id that is null or repeated loses no text."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = a + " and more"
    rows = [(None, b, "en"), (None, c, "de"), (None, near, "fr"), (2, a, "en"), (5, near, "fr"), (5, d, "en"), (5, d, "de"), (7, d, "en"), (7, d, "en"), (9, None, "en"), (8, " ", "en")]
    want = [(2, a, "en"), (8, " ", "en"), (None, b, "en"), (None, c, "de")]
    for parts in (1, 4):
        got = kept(spark, rows, parts)
        assert all(r in got for r in want) and len(got) == 5
        assert [r[:2] for r in got if r not in want] == [(5, d)]
    assert sorted(map(str, got)) == sorted(map(str, kept(spark, rows[::-1], 3)))


def test_odd_rows(spark, odd_docs, no_docs):
    got = corpus_pipeline.near_duplicates(spark, odd_docs, None)
    assert got.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [-7, 1, 3, 4, 5, 6]
    assert corpus_pipeline.near_duplicates(spark, no_docs, None).count() == 0


def test_fingerprints_group_what_similarity_does_not(spark):
    """Operator 1's fingerprints count repeated shingles: two texts that mostly say one thing are one group."""
    block = " ".join(f"b{i}" for i in range(21))
    texts = [f"{block} " * 40 + " ".join(f"{tail}{i}" for i in range(30)) for tail in "pq"]
    texts.append(" ".join(f"z{i}" for i in range(200)))
    assert len(set(roots(texts))) == 3
    assert sorted(r[0] for r in kept(spark, [(i, t, "en") for i, t in enumerate(texts)])) == [0, 2]
