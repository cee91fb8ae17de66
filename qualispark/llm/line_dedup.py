"""Line de-duplication by an exact set-similarity join.

A line's tokens are its word shingles (five words; a shorter line is one
token), ordered by rarity. Two lines with Jaccard similarity of 0.8 or more
share a token among the first ``size - ceil(0.8 * size) + 1`` of each (prefix),
have sizes within the ratio (length: lines without any such partner under a
token go before their words are fetched), and their first common token lies
where enough tokens follow it in both (position); the pairs left are verified
on the words themselves. A line goes when an earlier line is equal or similar.

How it is spread:

* equal lines are one class, so copies never multiply the work;
* rarity comes from a count sketch of fixed size, the only thing broadcast;
  any one global order gives the same pairs, so the sketch affects speed alone;
* postings are sorted by token and read as a stream; tokens of one class go at
  once; a family of lines that shares several prefix tokens is verified once,
  under the first of them, because tokens with the same members are merged;
* members of a frequent token are cut into blocks by size, and pairs of blocks
  with sizes within the ratio are separate groups, so no task holds more than two blocks, and no pair of lines
  ever leaves a task: each line leaves with its number of links and the
  earliest line that it is linked to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import arrow_map, fresh, written

SHINGLE = 5
#: Similarity as a fraction, so that every bound is exact in integers.
SIMILARITY = (4, 5)
SKETCH_BITS = 16
BLOCK = 2048
#: Members of a token that are compared with those of other tokens at once.
SHORT_RUN = 8
#: Bytes of text that are tokenised at a time.
CHUNK = 1 << 20

#: What else than one space stands between words.
_GAPS = (b"  ", b"\t", b"\r", b"\v", b"\f")
_HASH_BITS = np.uint64((1 << 52) - 1)
_BASE = 0x9E3779B97F4A7C15
_POSITION = "struct<known:boolean,doc_id:bigint,dhash:bigint,line_no:int>"
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def needed(a: int, b: int) -> int:
    """Least overlap of sets of sizes a and b that are similar enough."""
    n, d = SIMILARITY
    return -(-n * (a + b) // (n + d))


def prefix(size):
    n, d = SIMILARITY
    return size - -(-n * size // d) + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table, step = np.ones(1, np.uint64), base
            while len(table) < size:
                table, step = np.concatenate((table, table * np.uint64(step))), step * step % (1 << 64)
            out.append(table)
        if size <= 1 << 22:
            _powers[size] = tuple(out)
        return tuple(out)
    return _powers[size]


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def line_words(texts: list[bytes]) -> tuple[list[int], list[int], list[bytes]]:
    """Text number, line number and words (A-Z lower-cased, joined by a space) of non-blank lines."""
    doc, number, raw = [], [], []
    for d, text in enumerate(texts):
        low = text.lower()
        uneven = any(gap in low for gap in _GAPS)
        for n, line in enumerate(low.split(b"\n")):
            # most lines are their words with one space between
            w = b" ".join(line.split()) if uneven and any(gap in line for gap in _GAPS) else line.strip(b" ")
            if w:
                doc.append(d)
                number.append(n)
                raw.append(w)
    return doc, number, raw


def classes(raw: list[bytes]) -> np.ndarray:
    """A signed 64-bit name for the words of each line."""
    found = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
    return (found ^ np.uint64(1 << 63)).view(np.int64)


def shingles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lines, and the number of them in each line.

    One rolling hash over the joined bytes: a shingle's hash is the difference
    of two prefix sums, moved to the origin.
    """
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    power, inverse = _powers_upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = np.flatnonzero(data[ends] == 10)
    words = np.diff(np.concatenate(([-1], last)))
    count = np.maximum(words - SHINGLE + 1, 1)
    begin = np.repeat(np.cumsum(words) - words - (np.cumsum(count) - count), count) + np.arange(count.sum())
    final = begin + np.repeat(np.minimum(words, SHINGLE), count) - 1
    at = starts[begin]
    return _mixed((sums[ends[final]] - sums[at]) * inverse[at]), count


def ordered(raw: list[bytes], sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each line, rarest first, and how many each line has.

    A token is named by its rarity class and 52 bits of its hash, so that plain
    order is rarity order.
    """
    token, count = shingles(raw)
    token = (sketch[_bucket(token)].astype(np.uint64) << np.uint64(52)) | (token & _HASH_BITS)
    token = token.view(np.int64)
    first = np.cumsum(count) - count
    width = 1 << np.ceil(np.log2(np.maximum(count, 2))).astype(int)
    distinct = count.copy()
    for w in np.unique(width):  # rows of like lengths are sorted together
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) * int(w) // (1 << 18))):
            at = first[part][:, None] + np.arange(w)
            inside = np.arange(w) < count[part][:, None]
            table = np.where(inside, token[np.minimum(at, len(token) - 1)], np.iinfo(np.int64).max)
            table.sort(axis=1)
            twice = (table[:, 1:] == table[:, :-1]) & inside[:, 1:]
            if twice.any():
                table[:, 1:][twice] = np.iinfo(np.int64).max
                table.sort(axis=1)
                distinct[part] -= twice.sum(axis=1)
            token[at[inside]] = table[inside]
    if (distinct != count).any():
        place = np.arange(len(token)) - np.repeat(first, count)
        token = token[place < np.repeat(distinct, count)]
    return token, distinct


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("dhash"), text.alias("text"))


def _batches(batches, chars: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text (one row at least)."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy().astype(np.int64))
        begin = 0
        while begin < b.num_rows:
            end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + chars, "right"))
            end = max(end, begin + 1)
            yield b.slice(begin, end - begin)
            begin = end


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]


def rarity_sketch(own: DataFrame):
    """Broadcast of rarity classes: logarithms of the counts in ``2 ** SKETCH_BITS`` buckets."""
    spark, parts = own.sparkSession, 16
    width = (1 << SKETCH_BITS) // parts

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in _batches(batches):
            raw = line_words(_texts(b))[2]
            if raw:
                total += np.bincount(_bucket(shingles(raw)[0]), minlength=len(total))
        yield {"range": list(range(parts)), "counts": [total[i * width : (i + 1) * width].tobytes() for i in range(parts)]}

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[r] = sums.get(r, 0) + np.frombuffer(c, np.int64)
        yield {"range": list(sums), "counts": [v.tobytes() for v in sums.values()]}

    schema = "range int, counts binary"
    found = arrow_map(arrow_map(own, count, schema).repartition(parts, "range"), add, schema).collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in found:
        sketch[row["range"] * width : (row["range"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    return spark.sparkContext.broadcast(np.minimum(2047, 48 * np.log2(1 + sketch)).astype(np.int64))


def _lines(own: DataFrame, text: bool) -> DataFrame:
    """doc_id, dhash, line_no, cls of every line; with its words if ``text``.

    Without text every document also has a row with line_no -1 and no class.
    """

    def rows(batches):
        for b in _batches(batches):
            doc, no, raw = line_words(_texts(b))
            cls = pa.array(classes(raw))
            if not text:
                doc, no = doc + list(range(b.num_rows)), no + [-1] * b.num_rows
                cls = pa.concat_arrays([cls, pa.nulls(b.num_rows, pa.int64())])
            take = pa.array(doc, pa.int64())
            out = {"doc_id": b.column("doc_id").take(take), "dhash": b.column("dhash").take(take), "line_no": no, "cls": cls}
            yield out | ({"words": pa.array(raw, pa.binary())} if text else {})

    return arrow_map(own, rows, "doc_id long, dhash long, line_no int, cls long" + ", words binary" * text)


def _position() -> Column:
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "dhash", "line_no")


def _postings(own: DataFrame, sketch) -> DataFrame:
    """token, cls, size, place: the prefix of each line, of a class once a batch."""

    def rows(batches):
        rarity = sketch.value
        for b in _batches(batches):
            raw = list(dict.fromkeys(line_words(_texts(b))[2]))
            if raw:
                token, size = ordered(raw, rarity)
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                keep = place < np.repeat(prefix(size), size)
                yield {
                    "token": pa.array(token[keep]),
                    "cls": pa.array(np.repeat(classes(raw), size)[keep]),
                    "size": pa.array(np.repeat(size, size)[keep].astype(np.int32)),
                    "place": pa.array(place[keep].astype(np.int32)),
                }

    return arrow_map(own, rows, "token long, cls long, size int, place int")


def _may_link(size: np.ndarray, place: np.ndarray, size2: np.ndarray, place2: np.ndarray) -> np.ndarray:
    """Do enough tokens follow in both lines, if theirs at these places is the first in common?"""
    n, d = SIMILARITY
    least = -(-n * (size + size2) // (n + d))  # more than the smaller size if the sizes are too far apart
    return (size - place >= least) & (size2 - place2 >= least)


def _partnered(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which members of a token have another that they may be linked to; of many, which have one of like size."""
    if len(size) <= 256:
        fit = _may_link(size[:, None], place[:, None], size, place)
        np.fill_diagonal(fit, False)
        return np.flatnonzero(fit.any(axis=1))
    n, d = SIMILARITY
    near = np.flatnonzero(size[1:] * n <= size[:-1] * d)  # sizes ascend: the next in size is the best partner
    return np.unique(np.concatenate((near, near + 1)))


class _Runs:
    """Classes under each token of two or more, from a stream sorted by token, size and class."""

    def __init__(self, most: int):
        self.rows: list[tuple] = []
        self.most = most
        self.token, self.block = None, 0
        self.held = np.zeros((3, 0), np.int64)  # class, size, place

    def _emit(self, gid, block, held: np.ndarray) -> None:
        self.rows.append((gid, block, held, self.token))

    def _extend(self, new: np.ndarray) -> None:
        if self.held.shape[1] and new.shape[1] and self.held[0, -1] == new[0, 0]:
            new = new[:, 1:]
        self.held = np.concatenate((self.held, new), axis=1)
        while self.held.shape[1] > self.most:  # a longer run is named by its token and leaves block by block
            self._emit(None, self.block, self.held[:, : self.most])
            self.held, self.block = self.held[:, self.most :], self.block + 1

    def close(self) -> None:
        if self.block:
            self._emit(None, self.block, self.held)
        elif self.held.shape[1] > 1:
            self._whole(self.held[:, _partnered(self.held[1], self.held[2])])
        self.held, self.block = np.zeros((3, 0), np.int64), 0

    def _whole(self, held: np.ndarray, token: int | None = None) -> None:
        if held.shape[1]:
            self.rows.append((xxhash.xxh64_intdigest(held[0].tobytes()) >> 1, 0, held, self.token if token is None else token))

    def add(self, token: np.ndarray, cls: np.ndarray, size: np.ndarray, place: np.ndarray) -> None:
        fresh = np.concatenate(([True], (cls[1:] != cls[:-1]) | (token[1:] != token[:-1])))
        token, every = token[fresh], np.stack((cls, size, place))[:, fresh]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        ends = np.append(starts[1:], len(token))
        n = ends - starts
        ending = np.zeros(len(starts), bool)
        ending[0] = ending[-1] = True  # these may go on in another batch
        most = min(SHORT_RUN, self.most)
        alone = ending | (n > most)
        for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True):
            if token[a] != self.token:
                self.close()
                self.token = int(token[a])
            self._extend(every[:, a:b])
        short = np.repeat(~alone & (n > 1), n)
        token, every = token[short], every[:, short]
        keep = np.zeros(len(token), bool)
        for step in range(1, SHORT_RUN):  # all short runs at once
            fit = (token[step:] == token[:-step]) & _may_link(every[1, step:], every[2, step:], every[1, :-step], every[2, :-step])
            keep[step:] |= fit
            keep[:-step] |= fit
        token, every = token[keep], every[:, keep]
        cuts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True]))).tolist() if len(token) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self._whole(every[:, a:b], int(token[a]))

    def take(self) -> dict:
        rows, self.rows = self.rows, []
        n = [r[2].shape[1] for r in rows]
        cls, size, place = np.concatenate([r[2] for r in rows], axis=1)
        return {
            "gid": [g for (g, *_), k in zip(rows, n, strict=True) for _ in range(k)],
            "block": np.repeat([r[1] for r in rows], n),
            "cls": cls,
            "token": np.repeat([r[3] for r in rows], n),
            "size": size,
            "place": place,
        }


def runs(postings: DataFrame, most: int) -> DataFrame:
    """gid, block, cls, token, size, place: the classes under each token of two or more.

    Tokens with the same members have the same gid; a token of more than
    ``most`` classes has none and leaves in blocks, smaller sizes first.
    """

    def rows(batches):
        found = _Runs(most)
        for b in batches:
            if b.num_rows:
                found.add(*(c.to_numpy() for c in b.columns))
            if len(found.rows) > 2000:
                yield found.take()
        found.close()
        if found.rows:
            yield found.take()

    order = ("token", "size", "cls")
    sorted_ = postings.repartition("token").sortWithinPartitions(*order).select("token", "cls", "size", "place")
    return written(arrow_map(sorted_, rows, "gid long, block int, cls long, token long, size int, place int"), "runs")


def small_groups(found: DataFrame) -> DataFrame:
    """gid, one, two, block, cls, token of the groups that have a gid, one row a member."""
    small = found.filter("gid is not null").groupBy("gid", "cls").agg(F.min("token").alias("token"))
    zero = F.lit(0)
    return small.select("gid", zero.alias("one"), zero.alias("two"), zero.alias("block"), "cls", "token")


def _members(found: DataFrame) -> DataFrame:
    """gid, one, two, block, cls, token: all groups; those of frequent tokens in pairs of blocks of like sizes."""
    large = found.filter("gid is null").select((-F.col("token") - 1).alias("gid"), "block", "cls", "token", "size")
    blocks = large.groupBy("gid", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    n, d = SIMILARITY
    a, b = blocks.alias("a"), blocks.alias("b")
    like = (F.col("a.block") <= F.col("b.block")) & (F.col("b.low") * n <= F.col("a.high") * d)
    pairs = a.join(b, (F.col("a.gid") == F.col("b.gid")) & like).select("a.gid", F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    return small_groups(found).unionByName(large.drop("size").join(sides, ["gid", "block"]))


def _groups(batches) -> Iterator[list[list[tuple]]]:
    """Lists of whole groups, some thousand members at a time; a group is consecutive rows."""
    ready, size, last, held = [], 0, None, []
    for b in batches:
        keys = zip(*(b.column(k).to_pylist() for k in ("gid", "one", "two")), strict=True)
        rows = zip(*(b.column(k).to_pylist() for k in ("one", "two", "block", "cls", "token", "words", "first")), strict=True)
        for key, row in zip(keys, rows, strict=True):
            if key != last:
                if len(held) > 1:
                    ready.append(held)
                    size += len(held)
                if size > 2000:
                    yield ready
                    ready, size = [], 0
                last, held = key, []
            held.append(row)
    if len(held) > 1:
        ready.append(held)
    if ready:
        yield ready


def _linked(members: list[tuple], lists: list[list[int]], sets: dict[bytes, frozenset]) -> Iterator[tuple[int, int]]:
    """Pairs that the group owns: similar, and with its token as the first in common.

    ``lists`` have each member's tokens in order, ``sets`` those of the lines that were compared.
    """
    one, two, _, _, here, _, _ = members[0]
    n, d = SIMILARITY
    order = sorted(range(len(members)), key=lambda i: len(lists[i]))
    places = [x.index(here) for x in lists]
    rest = [len(x) - p for x, p in zip(lists, places, strict=True)]  # tokens from the group's on
    before = [frozenset(x[:p]) for x, p in zip(lists, places, strict=True)]
    words: dict[int, frozenset] = {}
    for x, i in enumerate(order):
        size, left = len(lists[i]), rest[i]
        longest = size * d // n
        for y in range(x + 1, len(order)):
            j = order[y]
            if len(lists[j]) > longest:
                break
            if one != two and members[i][2] == members[j][2]:
                continue  # left to the block's group with itself
            least = needed(size, len(lists[j]))
            if left < least or rest[j] < least:
                continue  # too few tokens follow the first in common
            if not before[i].isdisjoint(before[j]):
                continue  # another token is the first in common
            for k in (i, j):
                if members[k][5] not in sets:
                    sets[members[k][5]] = frozenset(lists[k])
            if len(sets[members[i][5]] & sets[members[j][5]]) >= least:
                for k in (i, j):
                    if k not in words:
                        words[k] = _words(members[k][5])
                if len(words[i] & words[j]) >= needed(len(words[i]), len(words[j])):
                    yield i, j


def _verified(groups: DataFrame, sketch) -> DataFrame:
    """cls, n_links, linked: links of each line that its group owns, the earliest linked line."""

    def rows(batches):
        rarity = sketch.value
        for ready in _groups(batches):
            raw = list(dict.fromkeys(m[5] for g in ready for m in g))
            token, size = ordered(raw, rarity)
            tokens, ends = token.tolist(), np.cumsum(size).tolist()
            lists = {w: tokens[end - n : end] for w, n, end in zip(raw, size.tolist(), ends, strict=True)}
            sets: dict[bytes, frozenset] = {}
            out: dict[str, list] = {"cls": [], "n_links": [], "linked": []}
            for g in ready:
                links, earliest = [0] * len(g), [None] * len(g)
                places = [tuple(v or 0 for v in m[6].values()) for m in g]
                for i, j in _linked(g, [lists[m[5]] for m in g], sets):
                    for u, v in ((i, j), (j, i)):
                        links[u] += 1
                        if earliest[u] is None or places[v] < places[earliest[u]]:
                            earliest[u] = v
                for i, n in enumerate(links):
                    if n:
                        for column, value in zip(out.values(), (g[i][3], n, g[earliest[i]][6]), strict=True):
                            column.append(value)
            yield out

    return arrow_map(groups, rows, f"cls long, n_links long, linked {_POSITION}")


def _words(line: bytes) -> frozenset:
    w = line.split()
    return frozenset(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1)))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cls, first (place of its first line), n_links, linked (earliest similar line)."""
    own = _own(docs, id_col, text_col)
    sketch = rarity_sketch(own)
    members = _members(runs(_postings(own, sketch), BLOCK))
    texts = _lines(own, True).groupBy("cls").agg(F.min(F.struct(_position().alias("first"), "words")).alias("x"))
    texts = texts.select("cls", "x.first", "x.words")
    with_text = members.join(texts, "cls").repartition("gid", "one", "two").sortWithinPartitions("gid", "one", "two")
    found = _verified(with_text.select("gid", "one", "two", "block", "cls", "token", "words", "first"), sketch)
    return found.groupBy("cls").agg(F.sum("n_links").alias("n_links"), F.min("linked").alias("linked"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, dhash, line_no, cls, n_links, removed for every line (and line_no -1 a document).

    ``n_links`` counts the different lines similar to it. Lines are ordered by
    document id (nulls first), hash of the text and number in the text.
    """
    own = _own(docs, id_col, text_col)
    similar = written(links(docs, id_col, text_col), "links")
    lines = written(_lines(own, False), "lines")
    firsts = lines.filter("cls is not null").groupBy("cls").agg(F.min(_position()).alias("first"))
    known = firsts.join(similar, "cls", "left").select("cls", F.least("first", "linked").alias("first"), "n_links")
    known = written(known, "known")  # a table of its own, so that the lines of a frequent class can be dealt to several tasks
    removed = F.coalesce(_position() > F.col("first"), F.lit(False))
    decided = lines.filter("cls is not null").join(known, "cls").select(
        "doc_id", "dhash", "line_no", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"), removed.alias("removed")
    )
    # the rows that stand for documents have no class and stay out of the join
    none = lines.filter("cls is null").select("doc_id", "dhash", "line_no", "cls", F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("removed"))
    return decided.unionByName(none)


def _by_document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    line = F.struct("line_no", "cls", "n_links", "removed")
    return (
        decide(docs, id_col, text_col)
        .groupBy("doc_id", "dhash")
        .agg(F.collect_set(line).alias("all"), F.count_if(F.col("line_no") < 0).alias("copies"))
        .select("doc_id", "dhash", "copies", F.filter(F.sort_array("all"), lambda e: e["line_no"] >= 0).alias("lines"))
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_lines, n_removed, n_links, and for each line its class and links.

    Blank lines are not lines; null and empty texts have none. Rows equal in id
    and text are the same document, reported once each and never removed for
    one another; an empty table gives no rows; other columns are not read. Two
    different lines have the same class with a chance of 2 ** -64.
    """
    found = _by_document(docs, id_col, text_col)
    lines = F.col("lines")
    return found.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda e: e["removed"])).cast("long").alias("n_removed"),
        F.aggregate(lines, F.lit(0).cast("long"), lambda s, e: s + e["n_links"]).alias("n_links"),
        F.transform(lines, lambda e: e["cls"]).alias("classes"),
        F.transform(lines, lambda e: e["n_links"]).alias("links"),
        F.transform(F.filter(lines, lambda e: e["removed"]), lambda e: e["line_no"]).alias("removed_lines"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents without their removed lines; all columns stay.

    A document that had lines and loses them all goes; one that loses none is
    left as it is, null included. ``length_col``, where there is one, is set anew
    for documents that lose lines. Other columns may have any names.
    """
    doc, hash_, gone_lines, left = fresh(docs.columns, "__id", "__hash", "__gone", "__left")
    found = _by_document(docs, id_col, text_col).filter(F.exists("lines", lambda e: e["removed"]))
    gone = found.select(
        F.col("doc_id").alias(doc),
        F.col("dhash").alias(hash_),
        F.transform(F.filter("lines", lambda e: e["removed"]), lambda e: e["line_no"]).alias(gone_lines),
        F.exists("lines", lambda e: ~e["removed"]).alias(left),
    )
    text = F.col(f"`{text_col}`")
    on = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(hash_))
    joined = docs.join(gone, on, "left").filter(F.coalesce(left, F.lit(True)))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone_lines, i)), "\n")
    out = joined.withColumn(text_col, F.when(F.col(gone_lines).isNull(), text).otherwise(kept))
    if length_col in docs.columns:
        was = F.col(f"`{length_col}`")
        new = F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(gone_lines).isNull(), was).otherwise(new))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
