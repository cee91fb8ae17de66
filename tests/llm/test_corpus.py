"""Operators with SQL against it, fingerprints against all pairs, and the pipeline's stages."""

import pytest
import xxhash

from oracle import compare
from qualispark.llm import chat_format, decontaminate, quality_rules, queries, simhash


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], sf)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_groups(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            names[find(i)] = min(names.get(find(i), r["doc_id"]), r["doc_id"])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(((r["doc_id"], f"{p:016x}", names.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints, strict=True))), key=key)
    got = sorted((tuple(r)[:3] for r in simhash.group(docs).collect()), key=key)
    assert got == want


def test_simhash_groups(spark, sf, odd_docs, no_docs):
    check_groups(spark.read.parquet(f"{sf}/documents.parquet"))
    check_groups(odd_docs)
    assert simhash.group(no_docs).count() == 0


def test_links_lose_no_pair(spark):
    import random

    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(12)} | set(seeds)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = [tuple(r) for r in simhash.links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "three FOUR five"), (None, "beta"), (2, None), (3, "")], "item_id long, text string")
    found = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.report(odd_docs, items).collect() if r["doc_id"] in (1, 3, -7)}
    assert found == {(1, 0, 0), (3, 3, 1), (-7, 3, 1)}
    assert decontaminate.report(odd_docs, items).count() == odd_docs.count()
    assert decontaminate.cleaned(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.report(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert decontaminate.report(no_docs, items).count() == 0
    assert quality_rules.score(odd_docs).count() == odd_docs.count() and quality_rules.score(no_docs).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 1, None, "</turn>\n###", "x"), (None, None, None, None, "x")], "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.digest(chat_format.format_conversations(turns)).collect()
    assert sorted(r["n_turns"] for r in made) == [1, 2]
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_long_text_spans_pieces(spark):
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words[93:107]))], "item_id long, text string")
    row = decontaminate.report(docs, items, shard_words=50).first()
    assert (row["n_hit"], row["n_items"], [tuple(s) for s in row["spans"]]) == (14, 1, [(93, 107)])


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == names and 0 < docs.count() <= before, name
        before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == before
