"""Near-duplicate documents: all pairs of Jaccard similarity 0.8 or more.

A document's tokens are the word shingles of its whole text (five words, line
breaks are spaces); tokens, order, prefixes and blocks are those of the line
join. No pair is lost: two similar documents share a token in their prefixes,
and the group of the first such token counts their whole overlap.

64-bit fingerprints alone cannot give this: at similarity 0.8 they differ in
about ten bits, which no grid of a few cells reaches. ``representatives`` groups
by both: what operator 1's fingerprints link at two bits, and all similar pairs.

Only links that join two parts of a group leave it, so a family of near copies
leaves one link a member. A token of more than ``BLOCK`` documents is first
tried as a star: the document with the fewest rarer tokens against all others,
one row each. What the stars join needs no more pairs; then the documents
outside a token's largest part meet all of the token's, block by block, so a
family costs rows in proportion to its members. A link is decided on 52-bit
hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.llm import line_dedup as lines
from qualispark.llm import simhash
from qualispark.llm.common import arrow_map, fresh, raw_texts, written
from qualispark.llm.simhash import components


#: Documents of a block; a group has two blocks at most.
BLOCK = 512
#: Words of a shingle of the fingerprints.
PRINT_SHINGLE = 3


def _classes(docs: DataFrame, prints: bool = False) -> DataFrame:
    """All columns but text, and cls: a name for the words of each text (of no words: one name); fingerprints if asked for."""
    kept = [c for c in docs.columns if c != "text"]

    def rows(batches):
        for b in batches:
            raw = [b" ".join(t.lower().split()) for t in raw_texts(b.column("text"))]
            out = {c: b.column(c) for c in kept} | {"cls": pa.array(lines.classes(raw))}
            if prints:
                found = np.array([simhash._fingerprint(t, PRINT_SHINGLE) for t in raw], np.uint64)
                out["fingerprint"] = pa.array(found.view(np.int64))
            yield out

    schema = ", ".join(f"{c} {kind}" for c, kind in docs.dtypes if c != "text")
    return arrow_map(docs, rows, f"{schema}, cls long" + (", fingerprint long" if prints else ""))


def _print_links(marked: DataFrame) -> DataFrame:
    """a, b: each class and the least class of its component of fingerprints, by operator 1's grid."""
    own = marked.select("cls", "fingerprint").distinct()
    rooted = components(simhash.links(own.select("fingerprint").distinct()))
    named = own.join(rooted, F.col("fingerprint") == F.col("node"), "left").select("cls", F.coalesce("root", "fingerprint").alias("group"))
    least = named.groupBy("group").agg(F.min("cls").alias("b"))
    return named.join(least, "group").filter("cls <> b").select(F.col("cls").alias("a"), "b")


def _tokenised(own: DataFrame, sketch, columns: list[str], made) -> DataFrame:
    """cls and what ``made`` makes of the ordered tokens of each text, of a class once a batch."""

    def rows(batches):
        rarity = sketch.value
        for b in lines._batches(batches):
            raw = list(dict.fromkeys(lines.line_words(lines._texts(b))[2]))
            if raw:
                token, size = lines.ordered(raw, rarity)
                ends = np.cumsum(size).tolist()
                cut = [made(token[e - n : e]) for e, n in zip(ends, size.tolist(), strict=True)]
                yield {"cls": pa.array(lines.classes(raw)), "size": size, "made": pa.array(cut, pa.binary())}

    return arrow_map(own, rows, "cls long, size int, made binary").groupBy("cls").agg(F.first(F.struct("size", "made")).alias("x")).select("cls", *columns)


def named_texts(own: DataFrame) -> DataFrame:
    """cls, text: the words of each text joined by a space, of a class once a batch."""

    def rows(batches):
        for b in batches:
            raw = list(dict.fromkeys(b" ".join(t.lower().split()) for t in raw_texts(b.column("text"))))
            yield {"cls": pa.array(lines.classes(raw)), "text": pa.array(raw, pa.binary()).cast(pa.string())}

    return arrow_map(own.select("text"), rows, "cls long, text string")


def texts_of(own: DataFrame, classes: DataFrame) -> DataFrame:
    """text: the texts of the classes named, once each.

    They are dealt by class before anything tokenises them: where the names are
    broadcast, two Python maps would be in one stage, and an executor would keep
    two workers a core from then on, each as large as its largest task.
    """
    found = named_texts(own).join(classes.select("cls").distinct(), "cls", "left_semi")
    return found.groupBy("cls").agg(F.first("text").alias("text")).select("text")


def _tokens_of(own: DataFrame, classes: DataFrame, sketch) -> DataFrame:
    """cls, made: all tokens of the classes named."""
    return _tokenised(texts_of(own, classes), sketch, ["x.made"], np.ndarray.tobytes)


def _width(size: int) -> int:
    """Bits of the parity map of a set: twice its size or more, a power of two."""
    return 1 << max(9, (2 * size - 1).bit_length())


def _parities(tokens: np.ndarray) -> bytes:
    """Whether an odd number of tokens falls on each bit: two maps never differ in more bits than the sets in tokens."""
    width = _width(len(tokens))
    odd = np.bincount(tokens & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _groups(batches, *columns: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Keys and rows of whole groups of consecutive rows, of two members or more."""
    last, held = None, []
    for b in batches:
        keys = zip(*(b.column(k).to_pylist() for k in ("gid", "one", "two")), strict=True)
        rows = zip(*(b.column(k).to_pylist() for k in columns), strict=True)
        for key, row in zip(keys, rows, strict=True):
            if key != last:
                if len(held) > 1:
                    yield last, held
                last, held = key, []
            held.append(row)
    if len(held) > 1:
        yield last, held


def _possible(members: list[tuple], apart: bool) -> list[tuple]:
    """The members that sizes and parities let be similar to another (of another block if ``apart``).

    A row is block, cls, token, size, parities.
    """
    n, d = lines.SIMILARITY
    members = sorted(members, key=lambda m: m[3])
    maps = [int.from_bytes(m[4], "little") for m in members]
    widths = [_width(m[3]) for m in members]
    halves = [(x ^ (x >> (w >> 1))) & ((1 << (w >> 1)) - 1) for x, w in zip(maps, widths, strict=True)]
    stays = [False] * len(members)
    for i, a in enumerate(members):
        for j in range(i + 1, len(members)):
            b = members[j]
            if b[3] * n > a[3] * d:
                break
            if (stays[i] and stays[j]) or (apart and a[0] == b[0]) or a[1] == b[1]:
                continue
            other = maps[j] if widths[i] == widths[j] else halves[j]
            if (maps[i] ^ other).bit_count() <= a[3] + b[3] - 2 * lines.needed(a[3], b[3]):
                stays[i] = stays[j] = True
    return [m for m, stay in zip(members, stays, strict=True) if stay]


def _joined(members: list[tuple]) -> Iterator[tuple[int, int]]:
    """Classes of similar pairs of a group, none within a part that is already joined.

    Overlaps count from the group's token on: in the group of a pair's first
    common token that is the whole overlap, and no other group needs the pair.
    """
    n, d = lines.SIMILARITY
    sets = sorted(((len(m[3]) // 8, m[1], np.frombuffer(m[3], np.int64)) for m in members), key=lambda s: s[:2])
    rest = [s[2][np.searchsorted(s[2], members[0][2]) :] for s in sets]
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (size, cls, _) in enumerate(sets):
        for j in range(i + 1, len(sets)):
            more = sets[j][0]
            if more * n > size * d:
                break
            least = lines.needed(size, more)
            if min(len(rest[i]), len(rest[j])) < least or cls == sets[j][1] or find(i) == find(j):
                continue
            if len(np.intersect1d(rest[i], rest[j], assume_unique=True)) >= least:
                root[find(j)] = find(i)
                yield cls, sets[j][1]


def _star(batches) -> Iterator[tuple[int, int]]:
    """Pivot and similar classes of each group: one member is the pivot (block -1)."""
    n, d = lines.SIMILARITY
    for _, members in _groups(batches, "block", "cls", "made"):
        sets = [(block, cls, np.frombuffer(made, np.int64)) for block, cls, made in members]
        pivot = next((s for s in sets if s[0] < 0), None)
        for block, cls, tokens in sets if pivot else ():
            small, large = sorted((len(tokens), len(pivot[2])))
            if block >= 0 and large * n <= small * d:
                if len(np.intersect1d(pivot[2], tokens, assume_unique=True)) >= lines.needed(small, large):
                    yield pivot[1], cls


def _crossing(large: DataFrame, joined: DataFrame) -> DataFrame:
    """gid, one, two, block, cls, token: documents outside each token's largest part against all of it.

    ``joined`` (node, root) are the parts that are known; the few outside are
    dealt to groups of about ``BLOCK``, each with every block of the token.
    """
    placed = large.join(joined, F.col("cls") == F.col("node"), "left").select("token", "block", "cls", F.coalesce("root", "cls").alias("root"))
    parts = placed.groupBy("token", "root").agg(F.count("*").alias("n"))
    tops = parts.groupBy("token").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("out"))
    tops = tops.filter("out > 0").select("token", F.col("top.root").alias("top"), F.ceil(F.col("out") / BLOCK).cast("int").alias("deals"))
    open_ = placed.join(tops, "token")
    gid = (-F.col("token") - 1).alias("gid")
    outside = open_.filter("root <> top").select(gid, "token", "cls", F.pmod(F.xxhash64("cls"), "deals").cast("int").alias("one"))
    blocks = open_.select(gid, F.col("block"), "deals").distinct()
    two = (F.col("block") + F.col("deals")).alias("two")  # numbers of their own: a group is never of one block
    few = outside.join(blocks.select("gid", two), "gid").select("gid", "one", "two", F.lit(-1).alias("block"), "cls", "token")
    deal = F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("one")
    many = open_.select(gid, "block", "cls", "token", two, deal)
    return few.unionByName(many.select("gid", "one", "two", "block", "cls", "token"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: classes whose connected components are those of all similar pairs."""
    flat = docs.withColumn(text_col, F.translate(F.col(f"`{text_col}`"), "\n", " "))
    own = lines._own(flat, id_col, text_col)
    sketch = lines.rarity_sketch(own)
    key = ["gid", "one", "two"]

    def grouped(members: DataFrame, more: DataFrame) -> DataFrame:
        return members.join(more, "cls").repartition(*key).sortWithinPartitions(*key)

    def star(batches):
        found = list(_star(batches))
        yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    def possible(batches):
        names = ("gid", "one", "two", "block", "cls", "token")
        for group, members in _groups(batches, "block", "cls", "token", "size", "made"):
            stay = _possible(members, group[1] != group[2])
            if stay:
                yield dict(zip(names, zip(*(group + m[:3] for m in stay), strict=True), strict=True))

    def joined(batches):
        for _, members in _groups(batches, "block", "cls", "token", "made"):
            found = list(_joined(members))
            yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    found = lines.runs(lines._postings(own, sketch), BLOCK)
    large = found.filter("gid is null").select("token", "block", "cls", "size", "place")
    pivots = large.groupBy("token").agg(F.min(F.struct("place", "cls")).alias("x")).select("token", F.col("x.cls").alias("pivot"))
    spokes = large.join(pivots, "token").filter("cls <> pivot").groupBy("pivot", "cls").agg(F.min(F.struct("token", "block")).alias("x"))
    deal = [F.hash("x.token").alias("one"), F.col("x.block").alias("two")]
    spokes = spokes.select(F.col("pivot").alias("gid"), *deal, F.lit(0).alias("block"), "cls")
    hubs = spokes.select("gid", "one", "two").distinct().select("*", F.lit(-1).alias("block"), F.col("gid").alias("cls"))
    wheel = written(spokes.unionByName(hubs), "stars")
    stars = written(arrow_map(grouped(wheel, _tokens_of(own, wheel, sketch)), star, "a long, b long"), "links")
    members = lines.small_groups(found).unionByName(_crossing(large, components(stars)))
    maps = _tokenised(own.select("text"), sketch, ["x.size", "x.made"], _parities)
    found = arrow_map(grouped(members, maps), possible, "gid long, one int, two int, block int, cls long, token long")
    found = written(found, "possible")
    rest = arrow_map(grouped(found, _tokens_of(own, found, sketch)), joined, "a long, b long")
    return stars.unionByName(rest)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all columns kept: the first by id (nulls last), hash of the text, hash of the row.

    A group is connected by fingerprints at two bits or less (operator 1) and by similarity.
    Groups are of texts, not of ids: null ids and ids that name several texts
    lose no text. Texts without words are one group; rows equal in all columns
    are one row. Columns that cannot be hashed (maps) decide no tie, so of rows
    that differ in these alone any one stays. Other columns may have any names.
    """
    text, row, text_hash, row_hash = fresh(docs.columns, "__text", "__row", "__text_hash", "__row_hash")
    known = F.col(f"`{id_col}`").cast("long")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text_col and "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumns(
        {text: F.xxhash64(F.lit(0), F.col(f"`{text_col}`")), row: F.xxhash64(F.lit(1), F.struct(*plain))}
    )
    own = keyed.select(known.alias("doc_id"), F.col(text).alias("text_hash"), F.col(row).alias("row_hash"), F.col(f"`{text_col}`").alias("text"))
    marked = written(_classes(own, prints=True), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "row_hash")
    firsts = marked.groupBy("cls").agg(F.min(order).alias("first"))
    rooted = components(_print_links(marked).unionByName(links(docs, id_col, text_col)))
    named = firsts.join(rooted, F.col("cls") == F.col("node"), "left").select("first", F.coalesce("root", "cls").alias("root"))
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.text_hash").alias(text_hash), F.col("first.row_hash").alias(row_hash))
    on = (F.col(text) == F.col(text_hash)) & (F.col(row) == F.col(row_hash))
    stay = keyed.join(kept, on, "left_semi").dropDuplicates([text, row])
    return stay.select(*(F.col(f"`{c}`") for c in docs.columns))
