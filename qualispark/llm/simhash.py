"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of their bit counts. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints, so it is a safe lower bound.
The vectors are put on a unit grid: 8 blocks of 4 coordinates. Two vectors at
Manhattan distance 2 or less differ in two blocks at most, so they share the
cell of at least one projection on 6 of the 8 blocks. The range join is the
equi-join on those 28 cells, filtered by the Manhattan bound and verified by
the exact number of differing bits inside the join.

Only distinct fingerprints are joined: a group of exact copies, however large,
is one of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import arrow_map, discard, raw_texts, written

#: Edges of a graph whose components one task finds; a larger graph goes by rounds.
FOREST = 1 << 17
SEGMENT_BITS = 2
BLOCKS = 8
MAX_BITS = 2
_ODD = 0x5555555555555555


def _fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the bits of XXH64 (seed 42) over the word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    k = min(shingle, len(words))
    begin, end = starts[: len(words) - k + 1].tolist(), (starts + lengths)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin)
    )
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (long, same bits) of each whole text.

    Words are runs of bytes other than space and 0x09-0x0D after A-Z are
    lower-cased; a text of fewer words than a shingle is one shingle; a null or
    empty text has fingerprint zero.
    """

    def rows(batches):
        for b in batches:
            found = [_fingerprint(t, shingle) for t in raw_texts(b.column(1))]
            yield {
                "doc_id": b.column(0),
                "fingerprint": pa.array(np.array(found, np.uint64).view(np.int64)),
            }

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return arrow_map(own, rows, "doc_id long, fingerprint long")


def segment_counts(x: Column) -> Column:
    """The 32 two-bit counts packed in a long: the embedding itself."""
    low, high = x.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_ODD))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed embeddings.

    A count of 0, 1 or 2 as its unary code (0, 01, 11) turns the difference of
    counts into a number of differing bits.
    """

    def unary(v: Column) -> Column:
        one = v.bitwiseAND(F.lit(_ODD))
        two = F.shiftrightunsigned(v, 1).bitwiseAND(F.lit(_ODD))
        return one.bitwiseOR(two).bitwiseOR(F.shiftleft(two, 1))

    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def _cells(counts: Column) -> Column:
    """The 28 grid cells of an embedding: the two blocks left out, and the key."""
    width, cells = 64 // BLOCKS, []
    for i, j in combinations(range(BLOCKS), MAX_BITS):
        mask = sum(((1 << width) - 1) << (width * b) for b in range(BLOCKS) if b not in (i, j))
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        key = F.xxhash64(F.lit(i * BLOCKS + j), counts.bitwiseAND(F.lit(signed)))
        cells.append(F.struct(key.alias("key"), F.lit(i * BLOCKS + j).cast("byte").alias("out")))
    return F.array(*cells)


def _first_shared(diff: Column, out: Column) -> Column:
    """Whether this is the first of the cells that a pair shares.

    ``diff`` is the exclusive or of the packed embeddings; the pair shares the
    cells whose left-out blocks cover every block that differs.
    """
    width = F.lit(64 // BLOCKS)
    block = F.lit((1 << (64 // BLOCKS)) - 1).cast("long")
    i, j = (out / BLOCKS).cast("int"), out % BLOCKS
    at_i = F.call_function("shiftrightunsigned", diff, (i * width).cast("int")).bitwiseAND(block) != 0
    at_j = F.call_function("shiftrightunsigned", diff, (j * width).cast("int")).bitwiseAND(block) != 0
    return (at_i & at_j) | ((i == 0) & ~at_i & at_j) | ((i == 0) & (j == 1) & ~at_j)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs a < b of distinct fingerprints at ``max_bits`` (2 or 1) bits at most.

    The members of a cell are compared where they are; a pair leaves the join
    once, at its first shared cell and only when verified. Both sides read one
    exchange by cell, which adaptive execution may split where a cell is hot.
    Keys that two cells share by chance cost comparisons and change no result.
    A merge join is asked for: Spark's size of ``keyed`` does not count the 28
    rows that a fingerprint becomes, and some 300,000 would pass for a table to
    broadcast.
    """
    counts = segment_counts(F.col("fingerprint"))
    keyed = prints.select(F.col("fingerprint").alias("x"), F.explode(_cells(counts)).alias("c")).select(
        "x", F.col("c.key").alias("cell"), F.col("c.out").alias("out")
    )
    a, b = keyed.hint("merge").alias("a"), keyed.hint("merge").alias("b")
    ca, cb = segment_counts(F.col("a.x")), segment_counts(F.col("b.x"))
    near = (
        (F.col("a.x") < F.col("b.x"))
        & (F.col("a.out") == F.col("b.out"))
        & (manhattan(ca, cb) <= max_bits)
        & (F.bit_count(F.col("a.x").bitwiseXOR(F.col("b.x"))) <= max_bits)
        & _first_shared(ca.bitwiseXOR(cb), F.col("a.out").cast("int"))
    )
    return a.join(b, (F.col("a.cell") == F.col("b.cell")) & near).select(
        F.col("a.x").alias("a"), F.col("b.x").alias("b")
    )


def _forest(batches):
    """node, root of all edges of a small graph: larger roots hook to smaller ones beside them until none are left."""
    ends = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
    if ends:
        nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (root[root] != root).any():
                root = root[root]
        moved = root != np.arange(len(nodes))
        yield {"node": nodes[moved], "root": nodes[root[moved]]}


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component of (a, b), for nodes that aren't it.

    Alternating large-star and small-star rounds; each round is a grouped
    minimum and a join, written to the shared folder. No node is in a task with
    more than its own neighbours, and nothing is collected but one count. A
    graph of at most ``FOREST`` edges (two megabytes) is one task's work instead:
    there a round's fixed cost is all that its dozen stages would spend.
    """
    current = written(edges.select("a", "b").distinct(), "edges")
    lows: list[DataFrame] = []

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = written(low, "low")  # a table of its own, so that the neighbours of a hub can be dealt to several tasks
        lows.append(low)
        joined = both.join(low, "a")
        if large:
            moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = signature(current)
    if before[0] <= FOREST:
        return written(arrow_map(current.coalesce(1), _forest, "node long, root long"), "forest")
    while before[0]:
        following = written(star(star(current, True), False), "edges")
        for table in (current, *lows):
            discard(table)
        lows.clear()
        current, now = following, signature(following)
        if tuple(now) == tuple(before):
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest doc_id reachable over links, the row's own
    included. Null ids keep a row of their own in their component and are never
    its name unless all are null; repeated rows give repeated results; an empty
    table gives no rows; other columns are not read.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    prints = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    rooted = components(links(prints, max_bits))
    named = prints.join(rooted, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    members = named.join(least, "root").select("fingerprint", "component_id")
    return marked.join(members, "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
