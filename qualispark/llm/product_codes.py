"""Vector codes by product quantisation with delta-maintained Lloyd rounds.

Vectors become integers, are cut into equal parts, and each part is named by
the nearest entry of its position's codebook. Between rounds two things are
kept in the shared folder: the rows with the entries they had and have now, and
the running integer sums (count and components) of every entry. A round reads
the rows once, and only parts whose entry changed give contributions: plus to
the new entry, minus to the old one. They are added up within each task, so a
task shuffles ``parts * entries`` rows at most, whatever its share of the
vectors; the driver sees the sums alone, whose size is set by the parameters.

All arithmetic is on integers, so neither the number of tasks nor their order
changes a code.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import arrow_map, discard, written

PARTS = 4
#: Entries of a codebook; codes are bytes, so no more than 256.
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors compared at a time.
_BATCH = 2048


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v: integer vectors of the rows whose components are all finite."""
    v = F.col(f"`{vector_col}`")

    def fine(x: Column) -> Column:
        wide = x.cast("double")
        return x.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < float("inf"))

    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    own = vectors.filter(v.isNotNull()).filter(F.forall(v, fine))
    return own.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), whole.alias("v"))


def _checked(kept: DataFrame, parts: int) -> int:
    """The length of a part; an error where vectors differ in length, can't be cut or are too large for exact sums."""
    top = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x))))
    low, high, most = kept.agg(F.min(F.size("v")), F.max(F.size("v")), top).first()
    if low is None:
        return 0
    if low != high or low % parts:
        raise ValueError(f"vectors of {low} to {high} components can't be cut into {parts} equal parts")
    if 4 * max(low // parts, 1) * most**2 >= 1 << 62 or most >= 1 << 31:
        raise ValueError(f"components up to {most / SCALE} are too large for exact distances")
    return low // parts


def _matrix(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """Rows, parts, components."""
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, parts, width)


def _nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row of one part; ties go to the lower entry."""
    if not v.shape[1]:
        return np.zeros(len(v), np.uint8), np.zeros(len(v), np.int64)
    exact = 4 * v.shape[1] * max(int(np.abs(v).max(initial=0)), int(np.abs(book).max(initial=0))) ** 2 < 1 << 53
    kind = np.float64 if exact else np.int64  # doubles hold these integers, and their product is faster
    a, b = v.astype(kind), book.astype(kind)
    far = (b * b).sum(1) - 2 * (a @ b.T)
    at = far.argmin(1)
    return at.astype(np.uint8), (far[np.arange(len(v)), at] + (a * a).sum(1)).astype(np.int64)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def _assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows with the entries of their parts (``now``), those they had (``was``) and the squared error."""
    parts, _, width = books.shape

    def assign(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                b = whole.slice(at, _BATCH)
                v = _matrix(b, parts, width)
                found = [_nearest(v[:, p], books[p]) for p in range(parts)]
                now = np.stack([entry for entry, _ in found], axis=1)
                yield {c: b.column(c) for c in ("vec_id", "label", "v")} | {
                    "was": b.column("now"),
                    "now": [code.tobytes() for code in now],
                    "error": np.sum([far for _, far in found], axis=0),
                }

    kinds = dict(rows.dtypes)
    return arrow_map(rows, assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v {kinds['v']}, was binary, now binary, error long")


def _contributions(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """part, entry, n, sums: what the changed parts of each task add to and take from the entries."""

    def deltas(batches):
        n = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        touched = np.zeros((parts, entries), bool)
        for b in batches:
            if not b.num_rows:
                continue
            v, now = _matrix(b, parts, width), _codes(b.column("now"), parts)
            first = b.column("was").null_count > 0
            was = now if first else _codes(b.column("was"), parts)
            for p in range(parts):
                moved = slice(None) if first else np.flatnonzero(was[:, p] != now[:, p])
                for code, sign in ((now, 1),) if first else ((now, 1), (was, -1)):
                    entry = code[moved, p]
                    np.add.at(n[p], entry, sign)
                    np.add.at(sums[p], entry, sign * v[moved, p])
                    touched[p, entry] = True
        part, entry = np.nonzero(touched)
        yield {"part": part, "entry": entry, "n": n[part, entry], "sums": list(sums[part, entry])}

    changed = rows.filter("was is null or was <> now").select("v", "was", "now")
    return arrow_map(changed, deltas, "part int, entry int, n long, sums array<long>")


def _added(rows: DataFrame, width: int) -> DataFrame:
    sums = F.array(*(F.sum(F.col("sums")[i]) for i in range(width))) if width else F.array().cast("array<bigint>")
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums"))


def _moved(books: np.ndarray, totals: DataFrame) -> np.ndarray:
    """Each entry at the floor of its parts' mean; entries without parts stay."""
    out = books.copy()
    for r in totals.filter("n > 0").collect():  # parts * entries rows at most
        out[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return out


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row.

    A row is dropped if its vector is null or has a null, NaN or infinite
    component. Null ids come after all others in the choice of the first
    entries and keep their rows; repeated ids and repeated rows each count as a
    row (ties by the vector itself). Fewer rows than ``entries`` give so many
    entries. Null labels are one label; an empty table gives no rows; vectors
    of no components have code zero and error zero. Vectors of several lengths,
    lengths that can't be cut evenly, or components past 2 ** 21 are an error.
    Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are bytes: 1 to 256 entries")
    state = written(_kept(vectors, id_col, vector_col, label_col).withColumn("now", F.lit(None).cast("binary")), "vectors")
    width = _checked(state, parts)
    first = state.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    totals = None
    for _ in range(rounds if len(first) else 0):
        following = written(_assigned(state, books), "vectors")
        discard(state)
        state, delta = following, _contributions(following, parts, len(first), width)
        sums = written(_added(totals.unionByName(delta) if totals else delta, width), "sums")
        if totals:
            discard(totals)
        totals, books = sums, _moved(books, sums)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = written(_assigned(state, books).select("vec_id", "label", F.lower(F.hex("now")).alias("code"), "error"), "codes")
    discard(state)
    by_label = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
