"""Benchmark decontamination with an FM-index per training shard.

Each task gathers its documents into shards of bounded length, builds an
FM-index of the shard's words (Burrows-Wheeler transform, wavelet matrix with
block ranks, suffix positions sampled by text position), runs every benchmark
phrase backward through it, locates the occurrences and merges their spans.
Documents never leave their task: the operator has no shuffle.

A shard takes a bounded number of words, and so does its index; longer texts
are cut into overlapping pieces inside their task. The phrases are broadcast in
blocks of bounded size; a benchmark of more than one block is searched block by
block in the same pass.
"""

from __future__ import annotations

import hashlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import arrow_map, fresh, raw_texts

WINDOW = 10
#: Words of one shard; a longer document is cut into pieces that overlap.
SHARD_WORDS = 250_000
#: Bytes of benchmark text in one block of phrases; further blocks are further passes.
BLOCK_BYTES = 32 << 20
SAMPLE = 32

# Every ASCII byte but digits and a-z separates words, once A-Z are lower-cased.
_TO_SPACE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, a-z and non-ASCII bytes, once A-Z are lower-cased."""
    return text.translate(_TO_SPACE).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence of non-negative integers."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for bit in range(bits - 1, -1, -1):
            ones = (seq & (1 << bit)).astype(bool)
            ranks = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=ranks[1:])
            zeros = len(seq) - int(ranks[-1])
            self.levels.append(ranks)
            self.zeros.append(zeros)
            if bit:
                following = np.empty_like(seq)
                following[:zeros], following[zeros:] = seq[~ones], seq[ones]
                seq = following
        self.bits = bits

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        begin, end = np.zeros_like(upto), upto.copy()
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            cum, zero = self.levels[level], self.zeros[level]
            one = ((symbols >> bit) & 1).astype(bool)
            b1, e1 = cum[begin], cum[end]
            begin = np.where(one, zero + b1, begin - b1)
            end = np.where(one, zero + e1, end - e1)
        return end - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank before that position."""
        symbol, begin, end = np.zeros_like(at), np.zeros_like(at), at.copy()
        for level in range(self.bits):
            cum, zero = self.levels[level], self.zeros[level]
            one = (cum[end + 1] - cum[end]).astype(bool)
            b1, e1 = cum[begin], cum[end]
            begin = np.where(one, zero + b1, begin - b1)
            end = np.where(one, zero + e1, end - e1)
            symbol = symbol * 2 + one
        return symbol, end - begin


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in lexicographic order; every 0 (end of a piece) is a sentinel of its own.

    Keys of three words first, then doubled lengths for the suffixes that are
    still tied, which are those inside repeated passages.
    """
    n, end = len(text), text == 0
    m = int(end.sum())
    base = m + int(text.max()) + 1
    lead = np.where(end, np.cumsum(end) - 1, text.astype(np.int64) + m - 1)
    ahead = np.concatenate((lead, [0, 0]))
    key, h = lead * base + ahead[1 : n + 1], 2
    if base**3 < 1 << 62:
        key, h = key * base + ahead[2 : n + 2], 3
    order = np.argsort(key)
    rows, tied = np.arange(n), key[order]
    rank = np.empty(n, np.int64)
    while True:
        new = np.concatenate(([True], tied[1:] != tied[:-1]))
        rank[order[rows]] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        open_ = ~(new & np.concatenate((new[1:], [True])))
        rows = rows[open_]
        if not len(rows):
            return order
        suffix = order[rows]
        key = rank[suffix] * (n + 1) + rank[suffix + h]
        perm = np.argsort(key)
        order[rows], tied = suffix[perm], key[perm]
        h *= 2


class FMIndex:
    """Backward search and locate over one shard of word numbers.

    ``text`` holds numbers from 1 and ends with a sentinel 0, as may its parts;
    ``top`` is the largest number that may be searched.
    """

    def __init__(self, text: np.ndarray, top: int):
        order = _suffix_order(text)
        before = text[order - 1]
        self.n = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.matrix = WaveletMatrix(before.astype(np.int32), max(top, int(text.max())).bit_length())
        # no step to the left ever crosses a sentinel: the word after one is sampled too
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled, dtype=np.int32)))
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [begin, end) of each phrase; phrases are right-aligned, padded with -1."""
        begin = np.zeros(len(phrases), np.int64)
        end = np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[:, column]
            live = np.flatnonzero((word >= 0) & (begin < end))
            if not len(live):
                continue
            w = word[live]
            low, high = self.matrix.rank(w, begin[live]), self.matrix.rank(w, end[live])
            begin[live], end[live] = self.first[w] + low, self.first[w] + high
        return begin, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step to a sampled suffix by last-to-first."""
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        at, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            hit = self.sampled[at]
            done = open_[hit]
            out[done] = self.samples[self.sample_rank[at[hit]]] + steps[done]
            open_, at = open_[~hit], at[~hit]
            if len(open_):
                symbol, rank = self.matrix.access(at)
                at = self.first[symbol] + rank
                steps[open_] += 1
        return out


class Phrases:
    """Windows of benchmark items, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        vocab: dict[bytes, int] = {b"": 0}
        found: dict[tuple[int, ...], set] = {}
        for name, text in items:
            ids = [vocab.setdefault(w, len(vocab)) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(name)
        self.words = vocab
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.table = np.array([(-1,) * (window - len(p)) + p for p in found], np.int64).reshape(-1, window)
        self.items = [sorted(x for x in names if x is not None) for names in found.values()]
        self.window = window


def _occurrences(pieces: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and phrase of every occurrence in the shard of the pieces.

    The index has the alphabet of the phrases: a word that no phrase has is a
    sentinel, as is the end of a piece, since no occurrence can span it.
    """
    number, zero = phrases.words.get, repeat(0)
    total = sum(map(len, pieces)) + len(pieces)
    flat = np.fromiter(chain.from_iterable(chain(map(number, p, zero), (0,)) for p in pieces), np.int32, total)
    index = FMIndex(flat, len(phrases.words) - 1)
    begin, end = index.search(phrases.table)
    found = np.flatnonzero(begin < end)
    sizes = (end - begin)[found]
    if not len(found):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    offset = np.repeat(begin[found] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    rows = offset + np.arange(sizes.sum())
    which = np.repeat(found, sizes)
    return index.locate(rows), phrases.lengths[which], which


def _pieces(words: list[bytes], window: int, limit: int) -> list[tuple[int, list[bytes]]]:
    """(first word, words): a text whole, or cut with an overlap of window - 1."""
    if len(words) <= limit:
        return [(0, words)]
    return [(a, words[a : a + limit]) for a in range(0, len(words) - window + 1, limit - window + 1)]


class _Document:
    """Spans (begin, end in words) and items found in one document."""

    def __init__(self, n_words: int):
        self.n_words, self.spans, self.items = n_words, [], set()

    def merged(self) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for a, b in sorted(self.spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]


def _search_texts(texts, blocks: list[Phrases], shard_words: int):
    """A ``_Document`` for each text, in order, shard by shard."""
    waiting: list[_Document] = []
    shard: list[tuple[_Document, int, list[bytes]]] = []
    size = 0

    def flush():
        starts = np.cumsum([0] + [len(p) + 1 for _, _, p in shard])
        for phrases in blocks:
            at, length, which = _occurrences([p for _, _, p in shard], phrases)
            owner = np.searchsorted(starts, at, "right") - 1
            for a, n, w, k in zip(at.tolist(), length.tolist(), which.tolist(), owner.tolist(), strict=True):
                doc, base, _ = shard[k]
                first = a - int(starts[k]) + base
                doc.spans.append((first, first + n))
                doc.items.update(phrases.items[w])

    for text in texts:
        words = words_of(text)
        doc = _Document(len(words))
        waiting.append(doc)
        for base, piece in _pieces(words, max(p.window for p in blocks), shard_words):
            shard.append((doc, base, piece))
            size += len(piece) + 1
            if size >= shard_words:
                flush()
                shard, size = [], 0
                yield from waiting[:-1]
                waiting = waiting[-1:]
    if shard:
        flush()
    yield from waiting


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of the phrases, each of at most ``block_bytes`` of text.

    The benchmark is the stated query set. It is read in blocks by running
    sums of its text sizes; one block is the usual case.
    """
    spark = benchmark.sparkSession
    own = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text"))
    blocks, items, size = [], [], 0
    for row in own.filter("text is not null").toLocalIterator():
        items.append((row["name"], bytes(row["text"])))
        size += len(row["text"])
        if size >= block_bytes:
            blocks.append(Phrases(items, window))
            items, size = [], 0
    if items or not blocks:
        blocks.append(Phrases(items, window))
    return [spark.sparkContext.broadcast(b) for b in blocks]


def _find(docs: DataFrame, benchmark: DataFrame, schema: str, emit, text_at: int, window: int, shard_words: int) -> DataFrame:
    """Map each batch of ``docs`` to ``emit(batch, texts, documents)``."""
    shared = phrase_blocks(benchmark, window, BLOCK_BYTES)

    def rows(batches):
        blocks = [b.value for b in shared]
        held: list = []  # batches whose last documents wait for their shard

        def texts():
            for b in batches:
                raw = raw_texts(b.column(text_at))
                held.append((b, raw))
                yield from raw

        done: list[_Document] = []
        for document in _search_texts(texts(), blocks, shard_words):
            done.append(document)
            while held and len(done) >= held[0][0].num_rows:
                b, raw = held.pop(0)
                yield emit(b, raw, done[: b.num_rows])
                done = done[b.num_rows :]
        for b, raw in held:
            if not b.num_rows:
                yield emit(b, raw, [])

    return arrow_map(docs, rows, schema)


def report(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: words, words hit, items found, and the merged spans.

    Null and empty texts have no words. A benchmark row with a null text has no
    words and no window; one with a null item_id hits words but is no item in
    the count. Repeated rows are each reported; an empty benchmark or table
    gives no hits or no rows; columns other than the id and the text are not read.
    """
    schema = (
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
        "contaminated boolean, spans array<struct<begin:int,end:int>>"
    )

    def emit(batch, raw, found):
        spans = [d.merged() for d in found]
        hit = [sum(b - a for a, b in s) for s in spans]
        return {
            "doc_id": batch.column(0),
            "n_words": [d.n_words for d in found],
            "n_hit": hit,
            "n_items": [len(d.items) for d in found],
            "items_sha256": [hashlib.sha256(",".join(sorted(d.items)).encode()).hexdigest() for d in found],
            "contaminated": [h > 0 for h in hit],
            "spans": [[{"begin": a, "end": b} for a, b in s] for s in spans],
        }

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _find(own, benchmark, schema, emit, 1, window, shard_words)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the words of the spans; a line break marks each cut.

    A word's bytes go with the separators up to the next word kept, so that the
    rest of the text is untouched.
    """
    plain = text.translate(_TO_SPACE)
    at, ends, starts = 0, [], []
    for w in plain.split():
        at = plain.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : starts[a]])
        last = ends[b - 1]
    out.append(text[last:])
    return b"\n".join(out)


def cleaned(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    length_col: str = "n_chars",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The documents with every merged span removed; all columns stay.

    A document of nothing but spans goes; ``length_col``, where the table has
    it, is set anew for documents with a hit. A document without a hit is left
    byte for byte, null and length included. Other columns may have any names.
    """
    names = docs.columns
    left, hit = fresh(names, "__left", "__hit")
    at = names.index(text_col)

    def emit(batch, raw, found):
        columns = {n: batch.column(i) for i, n in enumerate(names)}
        new = [
            None if null else (_without(t, d.merged()) if d.spans else t)
            for null, t, d in zip(batch.column(at).is_null().to_pylist(), raw, found, strict=True)
        ]
        columns[text_col] = pa.array(new, pa.binary()).cast(pa.string())
        columns[hit] = [bool(d.spans) for d in found]
        columns[left] = [not d.spans or bool(words_of(t or b"")) for d, t in zip(found, new, strict=True)]
        return columns

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{left}` boolean, `{hit}` boolean"
    out = _find(docs, benchmark, fields, emit, at, window, shard_words).filter(F.col(left))
    if length_col in names:
        new = F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(hit), new).otherwise(F.col(f"`{length_col}`")))
    return out.select(*(F.col(f"`{c}`") for c in names))
