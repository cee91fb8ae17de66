"""The line join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from qualispark.llm import line_dedup


def grams(line):
    w = line.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """rows: (order, text) of distinct documents; per document the lines (no, class, links, removed)."""
    lines = []
    for at, (order, text) in enumerate(rows):
        for n, line in enumerate((text or "").encode().lower().split(b"\n")):
            if line.split():
                lines.append((order, n, at, b" ".join(line.split())))
    lines.sort()
    texts = list(dict.fromkeys(x[3] for x in lines))
    sets = {t: grams(t) for t in texts}
    by_gram = defaultdict(set)
    for t in texts:
        for g in sets[t]:
            by_gram[g].add(t)
    similar = {}
    for t in texts:
        near = set().union(*(by_gram[g] for g in sets[t])) - {t}
        similar[t] = {u for u in near if 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u])}
    out, seen = defaultdict(list), set()
    for _, n, at, t in lines:
        out[at].append((n, xxhash.xxh64_intdigest(t) - (1 << 63), len(similar[t]), t in seen or bool(similar[t] & seen)))
        seen.add(t)
    return out


def check(docs):
    text = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").distinct().collect()
    rows = sorted((((r["doc_id"] is not None, r["doc_id"] or 0, r["h"]), r["text"]) for r in text), key=lambda r: r[0])
    want = brute(rows)
    got = defaultdict(list)
    for r in line_dedup.report(docs).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == docs.count()
    for at, (order, _) in enumerate(rows):
        mine = want.get(at, [])
        expected = ([c for _, c, _, _ in mine], [k for _, _, k, _ in mine], [n for n, _, _, gone in mine if gone])
        found = [(r["classes"], r["links"], r["removed_lines"]) for r in got[order[1] if order[0] else None]]
        assert expected in found, (order, expected, found)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs)
    assert line_dedup.report(no_docs).count() == 0 and line_dedup.cleaned(no_docs).count() == 0


def test_families_of_similar_lines(spark, monkeypatch):
    """Many near copies of one line, over several blocks, lose no link."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(40)] = f"v{rng.randrange(4)}"
        rows.append((i, "\n".join([" ".join(w), f"own line {i} of this document", "a b c"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(docs)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(docs).collect()}
    assert kept[0] == rows[0][1] and len(kept) == 150 and all(f"own line {i} " in t for i, t in kept.items())


def test_cleaned_keeps_columns(spark):
    rows = [(1, "first line here\nsecond line", 9, "k"), (2, "first line here", 9, "k"), (3, None, 9, "k"), (4, "\nFIRST  line here\nmy own", 9, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, cls string")
    got = {r["doc_id"]: tuple(r) for r in line_dedup.cleaned(docs).collect()}
    assert got == {1: rows[0], 3: rows[2], 4: (4, "\nmy own", 7, "k")}


@pytest.mark.parametrize(("most", "batch"), [(2048, 1000), (2048, 7), (5, 50), (2, 1000)])
def test_runs_keep_what_may_link(most, batch):
    """A pair that may link under its token stays, one in which too few tokens follow it goes; by any batches."""
    rng = np.random.default_rng(5)
    rows = sorted(
        {(t, int(s), c): int(rng.integers(0, line_dedup.prefix(int(s)))) for t in range(40) for c in range(int(rng.integers(1, 14))) for s in [10 + 3 * c]}.items()
    )
    rows = [(*k, p) for k, p in rows for _ in range(1 + (k[2] == 3))]  # a class that two batches sent
    token, size, cls, place = (np.array(c) for c in zip(*rows, strict=True))
    found = line_dedup._Runs(most)
    for begin in range(0, len(rows), batch):
        found.add(*(c[begin : begin + batch] for c in (token, cls, size, place)))
    found.close()
    got = {}
    for gid, _, held, t in found.rows:
        got.setdefault(t, []).extend((gid is None, *m) for m in held.T.tolist())
    by_token = {}
    for t, s, c, p in rows:
        by_token.setdefault(t, {})[c] = (s, p)
    dropped = 0
    for t, members in by_token.items():
        fit = lambda a, b: min(a[0] - a[1], b[0] - b[1]) >= line_dedup.needed(a[0], b[0])
        want = sorted((c, *m) for c, m in members.items() if len(members) > most or any(o != c and fit(m, x) for o, x in members.items()))
        assert sorted(m[1:] for m in map(tuple, got.get(t, []))) == want
        assert {m[0] for m in got.get(t, [])} <= {len(members) > most}
        dropped += len(members) - len(want)
    assert dropped or most == 2


def test_words_of_uneven_lines():
    texts = [b"A b\nc  d\n \n\te\x0bf \n g\r\n\x0c\n", b"", b" x y ", b"a\x1cb\xc2\xa0 c\nd", b"a b\n a b", b"\n  \n"]
    want = [(d, n, b" ".join(x.split())) for d, t in enumerate(texts) for n, x in enumerate(t.lower().split(b"\n")) if x.split()]
    assert list(zip(*line_dedup.line_words(texts), strict=True)) == want
