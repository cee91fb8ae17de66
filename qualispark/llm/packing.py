"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of
``capacity // k`` tokens, of which exactly k fill a sequence. Texts may be cut,
so each is cut greedily into pieces of class sizes, largest first; only classes
that waste ``WASTE`` tokens or less are used. Every task fills the sequences of
each class on its own. Pieces left in open sequences (a bounded number for each
task) are numbered across tasks by prefix sums of their counts and fill
sequences in the same way; what remains then is less than one sequence for each
class, however large the corpus, and is joined end to end, the last of it in
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualispark.llm.common import arrow_map, written
from qualispark.llm.tokens import encoder

CAPACITY = 4096
#: Tokens of padding that a full sequence may have.
WASTE = 4

_PIECE = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "class int, part long, rank long, ids binary"
)


def classes(capacity: int = CAPACITY, waste: int = WASTE) -> dict[int, int]:
    """size -> pieces of that size in a sequence; size 1 is always among them."""
    sizes = {capacity // k for k in range(1, capacity + 1)}
    return {s: capacity // s for s in sorted(sizes) if capacity % s <= waste}


def cuts(length: int, sizes: list[int]) -> list[int]:
    """The sizes of the pieces of a text, largest first; ``sizes`` ascend."""
    out = []
    while length:
        s = sizes[bisect_right(sizes, length) - 1]
        out += [s] * (length // s)
        length %= s
    return out


def _cut_and_fill(path: str, end_id: int, capacity: int):
    """Batches of (doc_id, text) to pieces, with the full sequences of this task."""
    per = classes(capacity)
    sizes = list(per)
    end = end_id.to_bytes(4, "little")

    def rows(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        encode = encoder(path)
        held: dict[int, list] = {s: [] for s in sizes}

        def columns(pieces):
            names = [x.strip().split()[0] for x in _PIECE.split(",")]
            return dict(zip(names, map(list, zip(*pieces, strict=True)), strict=True))

        out: list = []
        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), encode.each(batch.column(1).to_pylist()), strict=True):
                ids = found + end
                total, at = len(ids) // 4, 0
                for size in cuts(total, sizes):
                    held[size].append((doc, at, total, ids[4 * at : 4 * (at + size)]))
                    at += size
                    if len(held[size]) == per[size]:
                        for n, (d, a, t, x) in enumerate(held[size]):
                            out.append((d, a, size, t, (part << 32) + made, n * size, size, part, None, x))
                        made += 1
                        held[size] = []
                if len(out) >= 2000:
                    yield columns(out)
                    out = []
        for size, pieces in held.items():
            out += [(d, a, size, t, None, None, size, part, n, x) for n, (d, a, t, x) in enumerate(pieces)]
        if out:
            yield columns(out)

    return rows


def _joined(capacity: int):
    """The last pieces, ordered by class and rank, end to end; cut where a sequence ends."""

    def rows(batches):
        pieces = [r for b in batches for r in b.to_pylist()]
        pieces.sort(key=lambda r: (-r["class"], r["at"]))
        left = sum(r["length"] for r in pieces)
        out, number, room, fill = [], -(1 << 62), 0, 0

        def open_sequence():
            """A whole sequence while there are tokens for it, then powers of two."""
            return capacity if left >= capacity else 1 << (left.bit_length() - 1)

        for r in pieces:
            done = 0
            while done < r["length"]:
                if not room:
                    number, room, fill = number + 1, open_sequence(), 0
                n = min(room, r["length"] - done)
                out.append(
                    r
                    | {
                        "start": r["start"] + done, "length": n, "sequence_id": number, "offset": fill,
                        "ids": r["ids"][4 * done : 4 * (done + n)],
                    }
                )
                done, room, fill, left = done + n, room - n, fill + n, left - n
        if out:
            names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
            yield {name: [r[name] for r in out] for name in names}

    return rows


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's token ids (little-endian unsigned 32 bits). Each
    text's ids end with ``end_id``; a null or empty text is that id alone. Null
    ids and repeated rows are packed like any other; an empty table gives no
    rows; other columns are not read. The pieces are written once to the shared
    folder.
    """
    per = classes(capacity)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = written(arrow_map(own, _cut_and_fill(path, end_id, capacity), _PIECE, keeps=True), "pieces")
    result = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    open_ = pieces.filter("sequence_id is null").drop("sequence_id", "offset")
    by_class = Window.partitionBy("class")
    counts = (
        open_.groupBy("class", "part")
        .agg((F.max("rank") + 1).alias("n"))
        .select(
            "class",
            "part",
            F.sum("n").over(by_class.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
            F.sum("n").over(by_class).alias("of_class"),
        )
    )
    k = (F.lit(capacity) / F.col("class")).cast("long")
    numbered = open_.join(counts, ["class", "part"]).withColumn("at", F.coalesce("before", F.lit(0)) + F.col("rank"))
    filled = F.col("at") < F.col("of_class") - F.col("of_class") % k
    across = numbered.filter(filled).select(
        "doc_id", "start", "length", "doc_tokens",
        (-(F.col("class").cast("long") * (1 << 40)) - (F.col("at") / k).cast("long") - 1).alias("sequence_id"),
        ((F.col("at") % k) * F.col("class")).alias("offset"),
        "ids",
    )
    rest = numbered.filter(~filled).select("doc_id", "start", "length", "doc_tokens", "class", "at", "ids")
    assert sum(n - 1 for n in per.values()) < 20_000 * max(1, capacity // CAPACITY)  # rows of ``rest`` at most
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    last = arrow_map(rest.repartition(1), _joined(capacity), schema)
    return pieces.filter("sequence_id is not null").select(*result).unionByName(across).unionByName(last)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids instead of the ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
