"""Packing and string tables against whole-text encoding."""

import io
import json
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from qualispark.llm import common, packing, queries, sstable, tokens
from qualispark.llm.piece_table import PieceTable, keys_of, padded
from qualispark.llm.tokens import Encoder, encoder, splitting

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def whole(path, text, end):
    t = Tokenizer.from_file(path) if path not in whole.loaded else whole.loaded[path]
    whole.loaded[path] = t
    return t.encode(text or "", add_special_tokens=False).ids + [end]


whole.loaded = {}


def foreign(tmp_path, extra=()):
    """A vocabulary that merges across spaces, which no cache of words can give."""
    vocab = {c: i for i, c in enumerate("abĠ")} | {"bĠ": 3, "bĠa": 4} | dict(extra)
    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["model"] |= {"vocab": vocab, "merges": [["b", "Ġ"], ["bĠ", "a"]]}
    spec["pre_tokenizer"]["use_regex"], spec["added_tokens"], spec["post_processor"] = False, [], None
    path = tmp_path / "foreign.json"
    path.write_text(json.dumps(spec))
    return str(path)


def test_foreign_vocabulary(spark, tmp_path):
    path = foreign(tmp_path)
    assert np.frombuffer(Encoder(path)("ab ab a"), "<u4").tolist() == whole(path, "ab ab a", 9)[:-1]
    docs = spark.createDataFrame([(1, "ab ab a"), (2, None)], "doc_id long, text string")
    check_packed(packing.digest(packing.pack(docs, path)).collect(), {1: [whole(path, "ab ab a", 2)], 2: [[2]]})
    wide = foreign(tmp_path, [("bĠab", 70_000)])
    folder, manifest = sstable.write_shards(docs, wide)
    assert sstable.digest(manifest, folder).count() == 2
    with pytest.raises(ValueError, match="fit"):
        sstable.write_shards(docs, wide, width=2)
    folder, manifest = sstable.write_shards(docs, path, end_id=70_000)
    ends = [np.frombuffer(r["ids"], "<u4")[-1] for r in sstable.read_shards(manifest, folder).collect()]
    assert ends == [70_000, 70_000]
    with pytest.raises(ValueError, match="fit"):
        sstable.narrowed(np.array([70_000], "<u4").tobytes(), 2)


@pytest.mark.parametrize(("path", "kind"), [(WORD, "words"), (BYTE, "spaces")])
def test_cached_words_equal_whole_texts(path, kind):
    assert splitting(path) == kind
    texts = ["", " ", "a", "\t \n x", "don't  stop'll 　  y", "\x1c a \x85b", "x​ y", "é ́", "ΑΣ Σ", "<|endoftext|> a\n\n\nb  ", "１２3 ½ _-_", "a, b. c.. d.,e é. ×, it's. x\x01y", "Word, WORD. word", "z.", "Don't.", "\x01", "3, 4.",
             "\nA", "a\nB", "a\n\nB", "a\r\nB \n\tc", "a1b2's x_y", "é=\u0338 a=\u0338b", "(it's)'tis", "a²,b½.c٣!d", "q&&& ###z'd've"]
    encode = Encoder(path)
    for text in texts * 2:
        assert np.frombuffer(encode(text), "<u4").tolist() + [9] == whole(path, text, 9), repr(text)


cuts: dict = {}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZé0²٣ß'sdt.,&_-=\u0338\u0301\n\r\t  \u3000漢ǅ×"), max_size=40))
def test_cuts_fall_on_boundaries(text):
    for path in (WORD, BYTE):
        encode = cuts.get(path) or cuts.setdefault(path, Encoder(path))
        assert np.frombuffer(encode(text), "<u4").tolist() + [9] == whole(path, text, 9)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("abZé0²ß'sdtİǰΣ각.,\u0301\x01\x1c\n\r\t  漢ǅ"), max_size=40), max_size=30))
def test_texts_encoded_together(texts):
    for path in (WORD, BYTE):
        encode = cuts.get(path) or cuts.setdefault(path, Encoder(path))
        found = list(encode.each(texts))
        assert [np.frombuffer(x, "<u4").tolist() + [9] for x in found] == [whole(path, t, 9) for t in texts]


def test_other_tasks_let_the_cache_go(spark):
    def held(batches, ask):
        for b in batches:
            if ask:
                encoder(WORD)("some words")
            yield {"pid": [os.getpid()], "n": [len(common.KEPT)]}

    one = spark.range(1, numPartitions=1)
    seen = [
        common.arrow_map(one, lambda batches, ask=ask: held(batches, ask), "pid long, n int", keeps).first()
        for ask, keeps in ((True, True), (False, True), (False, False), (False, True))
    ]
    assert seen[0]["n"] == 1
    before = seen[0]["pid"]
    assert seen[1]["n"] == 1 or seen[1]["pid"] != before
    assert seen[2]["n"] == 0
    assert seen[3]["n"] == 0 or seen[3]["pid"] != seen[2]["pid"]


def check_packed(rows, want):
    """rows: pieces with ids_crc32; want: Counter of (doc_id, ids)."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.002 * total + 4
    for doc, lists in want.items():
        found = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc.pop(doc))
        if len(lists) == 1:
            at = 0
            for start, length, crc, tokens in sorted(found):
                ids = lists[0][start : start + length]
                assert start == at and tokens == len(lists[0])
                assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())
                at += length
            assert at == len(lists[0])
        else:
            assert sum(n * k[1] for k, n in found.items()) == sum(map(len, lists))
    assert not by_doc


def texts_of(docs):
    out = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        out[r["doc_id"]].append(r["text"])
    return out


def test_packing_holds_each_id_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = packing.digest(packing.pack(docs, WORD)).collect()
    check_packed(rows, {d: [whole(WORD, t, 2) for t in ts] for d, ts in texts_of(docs).items()})


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    rows = packing.digest(packing.pack(odd_docs, WORD)).collect()
    check_packed(rows, {d: [whole(WORD, t, 2) for t in ts] for d, ts in texts_of(odd_docs).items()})
    assert packing.pack(no_docs, WORD).count() == 0


def test_classes_fill_their_sequences():
    per = packing.classes()
    assert per[1] == 4096 and per[4096] == 1
    for size, n in per.items():
        assert 0 <= 4096 - size * n <= packing.WASTE
    for length in (1, 2, 1000, 4095, 4096, 10_001):
        assert sum(packing.cuts(length, list(per))) == length


def test_sstable_reads_back_in_order(spark, sf):
    got = queries.op3_sstable(spark, sf).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    at = 0
    for r, d in zip(got, docs, strict=True):
        ids = whole(BYTE, d["text"], 0)
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d["doc_id"], at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_sstable_odd_rows_and_lookup(spark, odd_docs, no_docs):
    folder, manifest = sstable.write_shards(odd_docs, BYTE, shard_bytes=2000)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in sstable.digest(manifest, folder).collect())
    want = sorted(((d is not None, d or 0, len(whole(BYTE, t, 0))) for d, ts in texts_of(odd_docs).items() for t in ts))
    assert [(r[1], r[2]) for r in got] == [(d if known else None, n) for known, d, n in want]
    assert [r[0] for r in got] == np.cumsum([0] + [n for _, _, n in want])[:-1].tolist()
    assert manifest.count() > 1
    found = sstable.lookup(manifest, folder, [3, 5, 99]).collect()
    assert Counter(r["doc_id"] for r in found) == {3: 2, 5: 1}
    folder, manifest = sstable.write_shards(no_docs, BYTE)
    assert sstable.digest(manifest, folder).count() == 0


def test_sstable_hot_ids(spark):
    """An id of most rows is dealt over ranges, and the order of ids holds over files."""
    rows = [(None if i % 3 else i % 7 - 3, f"text {i}") for i in range(600)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder, manifest = sstable.write_shards(docs, BYTE, shard_bytes=500)
    got = [r["doc_id"] for r in sstable.digest(manifest, folder).orderBy("start").collect()]
    assert got == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert manifest.filter("last_key = x'00'").select("part").distinct().count() > 1


def test_shard_file():
    writer = sstable.ShardWriter(4)
    for i in range(-3000, 3000, 3):
        writer.add(sstable.key_of(i), np.arange(i % 50, dtype="<u4").tobytes())
    data = writer.finish()
    shard = sstable.Shard(io.BytesIO(data))
    assert len(shard.index) > 1 and shard.n_docs == 2000
    assert [sstable.id_of(k) for k, _ in shard.items()] == list(range(-3000, 3000, 3))
    for i in (-3000, 0, 2997):
        assert shard.get(sstable.key_of(i)) == [np.arange(i % 50, dtype="<u4").tobytes()]
    absent = [i for i in range(-3000, 3000) if i % 3]
    assert not any(shard.get(sstable.key_of(i)) for i in absent)
    assert sum(shard.may_have(sstable.key_of(i)) for i in absent) < 0.03 * len(absent)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Shard(io.BytesIO(b"\xff" + data[1:])).items())


def test_lookup_reads_one_block():
    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            Counting.read_bytes += n
            return super().read(n)

    writer = sstable.ShardWriter(4)
    for i in range(3000):
        writer.add(sstable.key_of(i), np.arange(300, dtype="<u4").tobytes())
    data = writer.finish()
    shard = sstable.Shard(Counting(data))
    Counting.read_bytes = 0
    assert len(shard.get(sstable.key_of(1234))) == 1 and Counting.read_bytes < 2 * sstable.BLOCK_BYTES < len(data) / 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZéÀß09'sdt.,&\x00\x01\x1b\x7f\n\r\t  ×漢"), max_size=60), max_size=8))
def test_cuts_by_bytes(texts):
    for path in (WORD, BYTE):
        encode = cuts.get(path) or cuts.setdefault(path, Encoder(path))
        assert [np.frombuffer(x, "<u4").tolist() + [9] for x in encode.each(texts)] == [whole(path, t, 9) for t in texts]


def test_known_pieces_are_looked_up_in_arrays(monkeypatch):
    """Python's work goes with new pieces, not with all pieces; full tables and long pieces are kept, too."""
    monkeypatch.setitem(tokens.CACHE, "spaces", (200, 1 << 20))
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (*rng.integers(1, 12, 300), 40, 70)]
    texts = [" ".join(rng.choice(words, 3000)) for _ in range(4)] + ["Ünd " * 5 + "x" * 20_000]
    encode, asked = Encoder(BYTE), []
    found, learn = encode.young.find, encode._learn
    encode._learn = lambda pieces, keys: asked.append(len(pieces)) or learn(pieces, keys)
    for text in texts * 2:
        assert np.frombuffer(encode(text), "<u4").tolist() + [9] == whole(BYTE, text, 9)
    assert 300 < sum(asked) < 3000 and encode.young.find != found


def test_piece_table_grows():
    table, words = PieceTable(4), [b"%d" % i for i in range(5000)]
    joined = b"".join(words)
    lengths = np.array([len(w) for w in words])
    keys = keys_of(padded(joined), np.cumsum(lengths) - lengths, lengths)
    counts = np.arange(5000) % 3
    places = table.store(np.repeat(np.arange(5000), counts), counts)
    table.add(keys[:2500], places[:2500])
    assert (table.find(keys)[2500:] == 0).all()
    table.add(keys[2500:], places[2500:])
    assert (table.find(keys) == places).all() and 2 * table.n <= len(table.rows)
    assert table.runs(places[::-1]).tolist() == np.repeat(np.arange(5000), counts)[::-1].tolist()
