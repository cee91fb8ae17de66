"""Language-model scores from a probabilistic suffix tree of words.

A context is the last one to ``max_depth`` words. Its next-word distribution is
smoothed towards that of its parent, the longest of its proper suffixes in the
tree: ``P(w|c) = (N(cw) + STRENGTH * P(w|parent)) / (N(c) + STRENGTH)``; the
root has additive smoothing. A context stays in the tree if it was seen
``LEAST`` times and passes the divergence test: the log-likelihood gain of its
distribution over its parent's, each occurrence left out of its own counts,
exceeds ``GAIN`` nats and ``GAIN_RATE`` nats an occurrence. A word is scored in
the state of the longest suffix of its history that is in the tree.

The tree grows level by level: a context is tried if it was seen ``LEAST``
times, the same words without the last were tried, and its suffix two words
shorter is in the tree (the root is). Growth ends when no context is left to
try, or at ``max_depth``.

The counts of the corpus are too many for any one task, so they are never
gathered. The corpus is cut into chunks of bounded text, kept in buckets so
that the chunks themselves never move. In each round a chunk asks for the
totals of its distinct n-grams: it sends each key with its own count to the
slice of the key space that owns it, the slice adds up, and the totals go back
to the chunks that asked. Round d counts the n-grams under contexts of d words
and settles which contexts of d - 1 words stay; it writes its new arrays alone.
A chunk sends a key once however often it occurs, so no key is hot. An answer
tells whether the chunk was the only one that asked: then longer n-grams that
begin or end with this one are in no other chunk, and its own counts of them are
the totals, so it need not ask; most n-grams that are met once never move thus.
The number of slices grows with that of the chunks, so a slice doesn't.

Words are asked for by 64 bits of a hash. What more than one chunk has is
numbered by its slice, words and those n-grams that were seen ``LEAST`` times,
and the answer tells the number. A longer n-gram goes by the numbers of its
context and its last word, which are far shorter than a hash and tell n-grams
apart exactly (beyond 64 bits the two are hashed); a context goes by its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import arrow_map, bucketed, discard, dropped, emptied, raw_texts, written

LEAST = 16
STRENGTH = 20.0
GAIN, GAIN_RATE = 10.0, 0.02
#: Words of the longest context, if growth goes on that long.
MAX_DEPTH = 3
#: Additive smoothing of the root, the same as of the base score.
ADD = 0.1
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 6 << 20

_END = b" "  # no word has a space, so it is free to name the end
_BLOB = "chunk long, state binary"


def _planes(v: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: high bytes are mostly zero."""
    return np.ascontiguousarray(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.dtype.itemsize).T).tobytes()


def _pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed blob."""
    head = ";".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode()
    body = b"".join(map(_planes, arrays.values()))
    return zstandard.compress(len(head).to_bytes(4, "little") + head + body, 3)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    out, at = {}, 4 + n
    for item in raw[4 : 4 + n].decode().split(";"):
        name, kind, count = item.split(":")
        dtype = np.dtype(kind)
        size = int(count) * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, int(count))
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
        at += size
    return out


def _small(counts: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def _name(context: np.ndarray, word: np.ndarray, widths: tuple[int, int], bits: int) -> np.ndarray:
    """Names of n-grams by the numbers of context and word, of ``widths`` bits: the pair, scattered one to one over the key space."""
    context, word = context.astype(np.uint64), word.astype(np.uint64)
    if sum(widths) > 64:
        return _mix(context, word, 1)
    size = max(sum(widths), bits)
    key, every = context << np.uint64(widths[1]) | word, np.uint64((1 << size) - 1)
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        key = key * np.uint64(factor) & every
        key ^= key >> np.uint64(size // 2)
    return key << np.uint64(64 - size)


class Chunk:
    """The words of some documents by position, and what the rounds found about them.

    ``word`` (number of each token, 0 is the end), ``ends`` (positions after
    each document), ``train`` (by document), ``known`` and ``doc_id``; in round 0
    ``hash`` (by number). Rounds add ``count0`` and ``name0`` (by number),
    ``count<d>``, ``only<d>`` and ``kept<d>`` (n-grams under the contexts of d words,
    whether no other chunk has them, and fate of the contexts, by position of
    ``level(d)``) and ``name<d>`` (of the contexts of d words to try: by number of
    words seen often, longer ones in the order of ``contexts(d)``). A name is 1
    more than what the slice calls it, 0 if no other chunk has it.
    """

    def __init__(self, arrays: dict[str, np.ndarray], total: int = 0, kinds: int = 0):
        self.arrays = arrays
        self.word, self.ends = arrays["word"], arrays["ends"]
        self.lengths = np.diff(self.ends, prepend=0)
        self.place = np.arange(len(self.word), dtype=np.int32)
        self.place -= np.repeat((self.ends - self.lengths).astype(np.int32), self.lengths)
        self.trains = np.repeat(arrays["train"].astype(bool), self.lengths)
        self.total, self.kinds = total, kinds
        self._levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._names: dict[int, np.ndarray] = {}

    @staticmethod
    def of(docs: list[tuple[int | None, np.ndarray]]) -> dict[str, np.ndarray]:
        return {
            "word": np.concatenate([w for _, w in docs]),
            "ends": np.cumsum([len(w) for _, w in docs]),
            "train": np.array([not held_out(d) for d, _ in docs], np.uint8),
            "known": np.array([d is not None for d, _ in docs], np.uint8),
            "doc_id": np.array([d or 0 for d, _ in docs], np.int64),
        }

    def _flags(self, name: str, depth: int) -> np.ndarray:
        return np.unpackbits(self.arrays[f"{name}{depth}"], count=len(self.level(depth)[0])).astype(bool)

    def kept(self, depth: int) -> np.ndarray:
        """Which positions of the level have a context that is in the tree."""
        return self._flags("kept", depth)

    def local(self, depth: int) -> np.ndarray:
        """Which n-grams of the level have a context, an end of ``depth`` words or a last word that no other chunk has."""
        at = self.level(depth)[0]
        only = self.arrays["name0"][self.word] == 0
        if depth > 1:
            only[self.level(depth - 1)[0][self._flags("only", depth - 1)]] = True
        return only[at] | (self.names(depth) == 0)

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions with a context of ``depth`` words to try, and how often it was seen."""
        if depth not in self._levels:
            if depth == 1:
                before = self.arrays["count0"][self.word[:-1]].astype(np.int64)
                at = np.flatnonzero((self.place[1:] >= 1) & (before >= LEAST)) + 1
                self._levels[1] = at, before[at - 1]
            else:
                seen = self.arrays[f"count{depth - 1}"]
                often = np.flatnonzero(seen >= LEAST)
                at, of = self.level(depth - 1)[0][often] + 1, seen[often].astype(np.int64)
                good = at < len(self.word)
                at, of = at[good], of[good]
                good = self.place[at] >= depth
                if depth > 2:
                    grown = np.zeros(len(self.word), bool)
                    grown[self.level(depth - 2)[0][self.kept(depth - 2)]] = True
                    good &= grown[at]
                self._levels[depth] = at[good], of[good]
        return self._levels[depth]

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """What tells apart, in this chunk, the n-grams that end at the positions."""
        key = self.word[at - n + 1].astype(np.uint64)
        for back in range(n - 2, -1, -1):
            key = _mix(key, self.word[at - back].astype(np.uint64), n - back)
        return key

    def contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of the level's positions by context, and where in it each distinct context begins."""
        if depth not in self._contexts:
            self._contexts[depth] = _runs(self.keys(self.level(depth)[0] - 1, depth))
        return self._contexts[depth]

    def names(self, depth: int) -> np.ndarray:
        """Names of the contexts by position of the level."""
        if depth not in self._names:
            if depth == 1:
                by_number = np.zeros(len(self.arrays["count0"]), np.int64)
                by_number[self.arrays["count0"] >= LEAST] = self.arrays["name1"]
                self._names[1] = by_number[self.word[self.level(1)[0] - 1]]
            else:
                self._names[depth] = _back(self.arrays[f"name{depth}"].astype(np.int64), *self.contexts(depth))
        return self._names[depth]

    def shared(self, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct contexts that other chunks have, too: which of them, their slices (ascending) and numbers there."""
        order, at = self.contexts(depth)
        name = self.names(depth)[order[at]]
        which = np.flatnonzero(name)
        part, number = (name[which] - 1) & ((1 << bits) - 1), (name[which] - 1) >> bits
        by = np.argsort(part << 40 | number)
        return which[by], part[by], number[by]

    def fates(self, depth: int) -> np.ndarray:
        """What the chunk's training occurrences add to each distinct context's gain, as a part of what it needs to stay."""
        order, at = self.contexts(depth)
        return _sum(self.gains(depth), order, at, float) / np.maximum(GAIN, GAIN_RATE * self.level(depth)[1][order[at]])

    def root(self) -> np.ndarray:
        by_number = (self.arrays["count0"] + ADD) / (self.total + ADD * (self.kinds + 1))
        return by_number[self.word]

    def probability(self, depth: int) -> np.ndarray:
        """Probability of each word in its longest context of at most ``depth`` words in the tree."""
        p = self.root()
        for d in range(1, depth + 1):
            (at, of), stays = self.level(d), self.kept(d)
            at, of, n = at[stays], of[stays], self.arrays[f"count{d}"][stays]
            p[at] = (n + STRENGTH * p[at]) / (of + STRENGTH)
        return p

    def gains(self, depth: int) -> np.ndarray:
        """What each training occurrence of the level gains over its parent (others 0)."""
        at, of = self.level(depth)
        parent, n = self.probability(depth - 1)[at], self.arrays[f"count{depth}"].astype(np.int64)
        left = np.maximum(n - 1, 0) + STRENGTH * parent
        gain = np.log(left / (np.maximum(of - 1, 0) + STRENGTH) / parent)
        return np.where(self.trains[at], gain, 0.0)

    def asked(self, depth: int, last: int) -> np.ndarray:
        """Which positions of the level have an n-gram that round ``depth`` (1 or more) asks about."""
        return np.flatnonzero(~self.local(depth)) if depth <= last else np.zeros(0, np.int64)

    def grams(self, depth: int, asked: np.ndarray, widths: tuple[int, int], bits: int) -> np.ndarray:
        """Names of the n-grams asked about, by which the slices know them."""
        if not len(asked):
            return np.zeros(0, np.uint64)
        word = self.arrays["name0"][self.word[self.level(depth)[0][asked]]].astype(np.int64)
        return _name(self.names(depth)[asked] - 1, word - 1, widths, bits)

    def add(self, depth: int, last: int, widths: tuple[int, int], bits: int, told: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The new arrays of round ``depth`` from the answers: totals of the distinct n-grams asked, is no other chunk
        asking, their names; fates of the contexts that others have, too."""
        new = {}
        if depth == 0:
            runs = _runs(self.arrays["hash"])
            count = _back(told["count"], *runs)
            new["count0"], new["name0"] = _small(count), _small(_back(told["word"], *runs))
            new["name1"] = _small(_back(told["name"], *runs)[count >= LEAST])
            return new
        if depth > 1:
            order, at = self.contexts(depth - 1)
            which = self.shared(depth - 1, bits)[0]
            stays = self.fates(depth - 1) > 1 if len(which) < len(at) else np.zeros(len(at), bool)
            stays[which] = told["stays"]
            new[f"kept{depth - 1}"] = np.packbits(_back(stays, order, at))
        if depth <= last:
            level, asked = self.level(depth)[0], self.asked(depth, last)
            count, alone, name = np.zeros(len(level), np.int64), np.ones(len(level), bool), np.zeros(len(level), np.int64)
            runs = _runs(self.grams(depth, asked, widths, bits))
            count[asked], alone[asked], name[asked] = (_back(told[k], *runs) for k in ("count", "only", "name"))
            own = np.ones(len(level), bool)
            own[asked] = False
            runs = _runs(self.keys(level[own], depth + 1))
            count[own] = _back(_sum(self.trains[level[own]], *runs, np.int64), *runs)
            new[f"count{depth}"] = _small(count)
            if depth < last:
                new[f"only{depth}"] = np.packbits(alone)
                self.arrays = self.arrays | new
                at, (order, first) = self.level(depth + 1)[0], self.contexts(depth + 1)
                by_place = np.zeros(len(self.word), np.int64)
                by_place[level] = name
                new[f"name{depth + 1}"] = _small(by_place[at[order[first]] - 1])
        return new


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and where in it each distinct key begins."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)


def _sum(values: np.ndarray, order: np.ndarray, at: np.ndarray, kind) -> np.ndarray:
    return np.add.reduceat(values[order], at, dtype=kind) if len(at) else np.zeros(0, kind)


def _back(totals: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Totals of the distinct keys in order, by position of the keys."""
    out = np.empty(len(order), totals.dtype)
    out[order] = np.repeat(totals, np.diff(at, append=len(order)))
    return out


def _gaps(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Differences of ascending keys of one slice, without the bits that are the same in all."""
    start = keys[:1] >> np.uint64(64 - bits) << np.uint64(64 - bits)
    return _small(np.diff(keys, prepend=start) >> np.uint64(64 - width))


def _requests(state: DataFrame, load: Callable, depth: int, last: int, widths: tuple[int, int], bits: int) -> DataFrame:
    """slice, chunk, asked: what each chunk asks of each slice."""
    width = max(sum(widths), bits) if depth and sum(widths) < 64 else 64

    def rows(batches):
        for number, arrays in _loaded(batches):
            chunk = load(arrays)
            asked = chunk.asked(depth, last) if depth else None
            grams = chunk.grams(depth, asked, widths, bits) if depth else arrays["hash"]
            order, at = _runs(grams)
            keys = grams[order[at]]
            if depth:
                value = chunk.trains[chunk.level(depth)[0][asked]] if len(asked) else np.zeros(0, bool)
            else:
                value = np.bincount(chunk.word, chunk.trains, len(grams)).astype(np.int64)
            value = _sum(value, order, at, np.int64)
            part = rank = gain = np.zeros(0, np.int64)
            if depth > 1:
                which, part, rank = chunk.shared(depth - 1, bits)
                gain = chunk.fates(depth - 1)[which].astype(np.float32)
            del chunk, arrays, asked, grams, order, at
            every = np.arange((1 << bits) + 1)
            cut, ccut = np.searchsorted(keys >> np.uint64(64 - bits), every), np.searchsorted(part, every)
            there = np.flatnonzero(np.diff(cut) + np.diff(ccut)).tolist()

            def blob(s: int) -> bytes:
                g, c = slice(cut[s], cut[s + 1]), slice(ccut[s], ccut[s + 1])
                return _pack(gap=_gaps(keys[g], bits, width), value=_small(value[g]), cgap=_small(np.diff(rank[c], prepend=0)), gain=gain[c])

            for begin in range(0, len(there), 64):
                some = there[begin : begin + 64]
                yield {"slice": some, "chunk": [number] * len(some), "asked": [blob(s) for s in some]}

    return arrow_map(state, rows, "slice int, chunk long, asked binary")


def _loaded(batches):
    """Chunk number and all its arrays: every column after the first is a blob of some."""
    for b in batches:
        for i in range(b.num_rows):
            arrays: dict[str, np.ndarray] = {}
            for column in b.columns[1:]:
                arrays |= _unpack(column[i].as_py())
            yield b.column(0)[i].as_py(), arrays


def _slices(batches):
    """slice and its requests (chunk, blob), from rows sorted by slice."""
    last, held = None, []
    for b in batches:
        for s, c, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if s != last:
                if held:
                    yield last, held
                last, held = s, []
            held.append((c, blob.as_py()))
    if held:
        yield last, held


def _answers(requests: DataFrame, depth: int) -> DataFrame:
    """chunk, slice, answer (counts, who else asks, numbers, and fates in the order asked), kinds (keys with a count, once a slice).

    Rows come slice by slice and a task holds one slice at a time.
    """

    def rows(batches):
        for s, requests in _slices(batches):
            asked = [_unpack(blob) for _, blob in requests]
            cut, ccut = (np.cumsum([0] + [len(a[k]) for a in asked]) for k in ("gap", "cgap"))

            def every(name: str, asked=asked) -> np.ndarray:
                return np.concatenate([a[name] for a in asked])

            def summed(name: str, kind, asked=asked) -> np.ndarray:
                return np.concatenate([np.cumsum(a[name], dtype=kind) for a in asked])

            order, at = _runs(summed("gap", np.uint64))
            totals = _sum(every("value"), order, at, np.int64)
            alone = np.diff(at, append=len(order)) == 1
            often = ~alone & (totals >= LEAST)
            counts, only = _back(totals, order, at), _back(alone, order, at)
            number, word = (_back(np.cumsum(x) - 1, order, at) for x in (often, ~alone))
            rank = summed("cgap", np.int64)
            stays = np.bincount(rank, every("gain"))[rank] > 1 if len(rank) else np.zeros(0, bool)

            def answer(i: int) -> bytes:
                some = slice(cut[i], cut[i + 1])
                both = ~only[some]
                told = {
                    "slice": np.array([s]), "count": _small(counts[some]), "only": np.packbits(only[some]),
                    "name": _small(np.diff(number[some][both & (counts[some] >= LEAST)], prepend=0)),
                    "stays": np.packbits(stays[ccut[i] : ccut[i + 1]]), "n": np.array([ccut[i + 1] - ccut[i]]),
                }
                return _pack(**told | ({} if depth else {"word": _small(np.diff(word[some][both], prepend=0))}))

            yield {
                "chunk": [c for c, _ in requests],
                "slice": [s] * len(requests),
                "answer": [answer(i) for i in range(len(requests))],
                "kinds": [int((totals > 0).sum())] + [0] * (len(requests) - 1),
            }

    spread = requests.repartition("slice").sortWithinPartitions("slice", "chunk")
    return arrow_map(spread, rows, "chunk long, slice int, answer binary, kinds long")


def _told(blobs: list[bytes], bits: int) -> dict[str, np.ndarray]:
    """What all slices answer a chunk, in the order asked: count, only, name, word and stays."""
    out: dict[str, list[np.ndarray]] = {k: [np.zeros(0, kind)] for k, kind in (("count", np.int64), ("only", bool), ("name", np.int64), ("word", np.int64), ("stays", bool))}
    for x in map(_unpack, blobs):
        only = np.unpackbits(x["only"], count=len(x["count"])).astype(bool)
        out["count"].append(x["count"])
        out["only"].append(only)
        out["stays"].append(np.unpackbits(x["stays"], count=int(x["n"][0])).astype(bool))
        for k, some in (("name", ~only & (x["count"] >= LEAST)), ("word", ~only)):
            if k in x:
                full = np.zeros(len(only), np.int64)
                full[some] = (np.cumsum(x[k], dtype=np.int64) << bits | x["slice"][0]) + 1
                out[k].append(full)
    return {k: np.concatenate(v) for k, v in out.items()}


def _advance(state: DataFrame, answers: DataFrame, load: Callable, depth: int, last: int, widths: tuple[int, int], bits: int) -> DataFrame:
    """chunk, state (the round's new arrays), todo (positions that later rounds have to look at), names and words (the
    highest names of the contexts that the next round has, and of words)."""
    ordered = F.sort_array(F.collect_list(F.struct("slice", "answer")))
    grouped = answers.groupBy("chunk").agg(F.transform(ordered, lambda a: a["answer"]).alias("answers"))

    def rows(batches):
        for b in batches:
            held = pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1])
            for i, (number, arrays) in enumerate(_loaded([held])):
                told = _told(b.columns[-1][i].as_py() or [], bits)
                chunk = load(arrays)
                new = chunk.add(depth, last, widths, bits, told)
                del told
                todo = len(chunk.word)
                if depth:
                    chunk.arrays = arrays | new
                    todo = sum(len(chunk.level(d)[0]) for d in (depth, depth + 1) if d <= last)
                top = (int(new[k].max()) if k in new and len(new[k]) else 0 for k in (f"name{depth + 1}", "name0"))
                yield {"chunk": [number], "state": [_pack(**new)], "todo": [todo], "names": [next(top)], "words": [next(top)]}

    return arrow_map(state.join(grouped, "chunk", "left"), rows, f"{_BLOB}, todo long, names long, words long")


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """chunk, state, tokens, hashes: two rows a chunk, the second has the hashes of its words, which round 0 alone needs."""

    def rows(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        numbers: dict[bytes, int] = {_END: 0}
        held, size = [], 0

        def close():
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
            blobs = [_pack(**Chunk.of(held)), _pack(hash=hashes)]
            tokens = sum(len(w) for d, w in held if not held_out(d))
            return {"chunk": [(part << 32) + made] * 2, "state": blobs, "tokens": [tokens, 0], "hashes": [False, True]}

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True):
                words = [numbers.setdefault(w, len(numbers)) for w in text.lower().split()]
                words.append(0)
                held.append((doc, np.array(words, np.int32)))
                size += len(text)
                if size >= chunk_bytes:
                    yield close()
                    made, numbers, held, size = made + 1, {_END: 0}, [], 0
        if held:
            yield close()

    return arrow_map(docs, rows, f"{_BLOB}, tokens long, hashes boolean")


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states, longest.

    Words are runs of bytes other than space and 0x09-0x0D after A-Z are
    lower-cased; each text ends with one end token. Documents of which the
    CRC-32 of the id as text is no multiple of 10 are learned from (a null id
    counts as the empty text, so it is held out). Null and empty texts are the
    end alone; repeated rows are learned from and scored each; an empty table
    gives no rows; other columns are not read. ``n_states`` counts the tokens
    scored below the root, ``longest`` is the longest context used.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    base = bucketed(_chunks(own, chunk_bytes), "chunk", "hashes")
    size = base.agg(F.count_if(~F.col("hashes")), F.sum("tokens")).first()
    total, kinds = size[1] or 0, 0
    # half as many slices as chunks at least: a slice stays as large as a chunk or two, and rows that have few keys remain few
    bits = max(8, size[0].bit_length() - 1)
    tables = [base]

    def state() -> DataFrame:
        out = base.filter("not hashes").select("chunk", "state")
        if len(tables) == 1:
            out = out.join(base.filter("hashes").select("chunk", F.col("state").alias("hash")), "chunk")
        for i, t in enumerate(tables[1:]):
            out = out.join(t.select("chunk", F.col("state").alias(f"state{i}")), "chunk")
        return out

    depth, widths = 0, (0, 0)
    while True:
        known = kinds  # the closures of this round take its value
        load = lambda arrays, k=known: Chunk(arrays, total, k)
        # written, so that the requests are gone before the answers are dealt
        answers = written(_answers(_requests(state(), load, depth, max_depth, widths, bits), depth), "answers")
        if depth == 0:  # the first answers also tell the number of different words
            kinds = answers.agg(F.sum("kinds")).first()[0] or 0
        new = bucketed(_advance(state(), answers, load, depth, max_depth, widths, bits), "chunk")
        discard(answers)
        if depth == 0:
            emptied(base, "hashes = true")
        tables.append(new)
        todo, names, words = new.agg(F.sum("todo"), F.max("names"), F.max("words")).first()
        if not todo:
            break
        widths = max(0, names - 1).bit_length(), max(0, words - 1).bit_length() if depth == 0 else widths[1]
        depth += 1
    final = depth - 1  # the last round settled the contexts of so many words

    def rows(batches):
        for _, arrays in _loaded(batches):
            c = Chunk(arrays, total, kinds)
            used = np.zeros(len(c.word), np.int64)
            for d in range(1, final + 1):
                used[c.level(d)[0][c.kept(d)]] = d
            root, p, starts = c.root(), c.probability(final), c.ends - c.lengths
            add = np.add.reduceat
            yield {
                "doc_id": pa.array(arrays["doc_id"], mask=arrays["known"] == 0),
                "held_out": pa.array(arrays["train"] == 0),
                "n_tokens": pa.array(c.lengths),
                "n_known": pa.array(add((arrays["count0"][c.word] > 0).astype(np.int64), starts)),
                "train_tokens": [total] * len(starts),
                "base_score": pa.array(add(np.log10(root), starts)),
                "score": pa.array(add(np.log10(p), starts)),
                "n_states": pa.array(add((used > 0).astype(np.int64), starts)),
                "longest": pa.array(np.maximum.reduceat(used, starts)),
            }

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, n_states long, longest long"
    )
    out = written(arrow_map(state(), rows, schema), "scores")
    for t in tables:
        dropped(t)
    return out
