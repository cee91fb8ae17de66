"""Sorted-string-table shards of token ids.

Texts are encoded where they lie; ids, not texts, move to the range of their
document id (bounds are quantiles of the ids; an id as frequent as several
ranges is dealt over all of them). Each task writes its range as shard files in the shared
folder, so a lost task writes the same files again. Files are read by footer,
index and block, never whole.
A file holds

* data blocks of about ``BLOCK_BYTES``: entries in key order, each with the
  length of the prefix it shares with the key before it, the rest of the key
  and the value; a block begins with a whole key and ends with a CRC-32;
* a sparse index: for each block its last key, offset and length;
* a Bloom filter over the keys;
* a footer of fixed size: where index and filter are, documents, tokens, width
  of an id, checksum and magic.

A key is a byte that tells null from a value and the id in big-endian order
with its sign flipped, so that byte order is id order.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualispark.llm.common import arrow_map, scratch_path, written
from qualispark.llm.tokens import encoder, largest_id

BLOCK_BYTES = 64 << 10
SHARD_BYTES = 16 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7
MAGIC = b"QSSTABL1"
_FOOTER = struct.Struct("<QQQQQQII8s")  # index at, size; filter at, size; docs, tokens; id width, CRC; magic


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 33) | 1
    return [(h + i * step) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """One file in memory; keys come in ascending order, equal ones allowed.

    Values are ids as bytes, ``width`` bytes each.
    """

    def __init__(self, width: int):
        self.width, self.data, self.block, self.index, self.keys = width, bytearray(), bytearray(), [], []
        self.last, self.tokens = b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        n = _shared(self.last, key) if self.block else 0
        self.block += _varint(n) + _varint(len(key) - n) + key[n:] + _varint(len(value)) + value
        self.last, self.tokens = key, self.tokens + len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.block:
            at = len(self.data)
            self.data += self.block + zlib.crc32(self.block).to_bytes(4, "little")
            self.index.append((self.last, at, len(self.block)))
            self.block = bytearray()

    def __len__(self) -> int:
        return len(self.data) + len(self.block)

    def finish(self) -> bytes:
        self._close()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        mask = np.zeros(bits, bool)
        for k in set(self.keys):
            mask[_probes(k, bits)] = True
        bloom = bits.to_bytes(8, "little") + np.packbits(mask, bitorder="little").tobytes()
        at = len(self.data)
        tail = (at, len(index), at + len(index), len(bloom), len(self.keys), self.tokens, self.width)
        check = zlib.crc32(bloom, zlib.crc32(index))
        return bytes(self.data) + index + bloom + _FOOTER.pack(*tail, check, MAGIC)


def narrowed(ids: bytes, width: int) -> bytes:
    """Little-endian 32-bit ids as ids of ``width`` bytes; an id that doesn't fit is an error."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) > 0xFFFF:
        raise ValueError(f"token id {wide.max()} does not fit into {width} bytes")
    return wide.astype("<u2").tobytes()


def widened(value: bytes, width: int) -> bytes:
    return value if width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()


class Shard:
    """A file's reader; ``get`` reads one block, or none if the filter says no.

    ``file`` is a binary file that can seek; footer, index and filter are read
    at once, blocks when they are asked for.
    """

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2) or file.tell()
        tail = self._read(size - _FOOTER.size, _FOOTER.size) if size >= _FOOTER.size else b""
        if tail[-8:] != MAGIC:
            raise ValueError("damaged shard: footer")
        at, size, bloom_at, bloom_size, self.n_docs, self.n_tokens, self.width, check, _ = _FOOTER.unpack(tail)
        index, bloom = self._read(at, size), self._read(bloom_at, bloom_size)
        if zlib.crc32(bloom, zlib.crc32(index)) != check:
            raise ValueError("damaged shard: index or filter")
        self.bits = int.from_bytes(bloom[:8], "little")
        self.bloom, self.index, p = bloom[8:], [], 0
        while p < size:
            n, p = _read_varint(index, p)
            key, p = index[p : p + n], p + n
            offset, p = _read_varint(index, p)
            length, p = _read_varint(index, p)
            self.index.append((key, offset, length))
        self.ends = [k for k, _, _ in self.index]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def entries(self, number: int):
        _, at, length = self.index[number]
        whole = self._read(at, length + 4)
        block = whole[:length]
        if zlib.crc32(block) != int.from_bytes(whole[length:], "little"):
            raise ValueError("damaged shard: block")
        p, key = 0, b""
        while p < length:
            n, p = _read_varint(block, p)
            m, p = _read_varint(block, p)
            key, p = key[:n] + block[p : p + m], p + m
            size, p = _read_varint(block, p)
            value, p = block[p : p + size], p + size
            yield key, widened(value, self.width)

    def items(self):
        for number in range(len(self.index)):
            yield from self.entries(number)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key, self.bits))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, all of them where it is repeated."""
        found: list[bytes] = []
        if not self.may_have(key):
            return found
        for number in range(bisect_left(self.ends, key), len(self.index)):
            same = [v for k, v in self.entries(number) if k == key]
            found += same
            if not same or self.ends[number] != key:
                break
        return found


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _encoded(docs: DataFrame, path: str, end_id: int, width: int, bounds: list[int]) -> DataFrame:
    """range, doc_id, number, ids (narrow) of each text; number orders equal ids."""
    null = np.iinfo(np.int64).min

    def rows(batches):
        from pyspark import TaskContext

        encode, end = encoder(path), end_id.to_bytes(4, "little")
        cuts = np.array(bounds, np.int64)
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                some = b.slice(begin, 256)
                numbers = np.arange(number, number + some.num_rows)
                number += some.num_rows
                key = some.column(0).fill_null(null).to_numpy()
                low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
                own = low + numbers % (high - low + 1)
                last = (key == null) & some.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = [narrowed(x + end, width) for x in encode.each(some.column(1).to_pylist())]
                yield {"range": np.where(last, high, own), "doc_id": some.column(0), "number": numbers, "ids": ids}

    return arrow_map(docs, rows, "range int, doc_id long, number long, ids binary", keeps=True)


def write_shards(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    width: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> tuple[str, DataFrame]:
    """Encode, sort and write; the folder and the manifest (one row per file).

    Manifest: part, number, name, first_key, last_key, n_docs, n_tokens,
    n_bytes. Files are named by their place in the order. A null text is empty;
    null ids come first, rows of one id in the order of their partitions and
    ranges; an empty table writes no file; other columns are
    not read. ``width`` is the bytes of an id in the file: 2 where all ids of
    the vocabulary fit, else 4, unless it is given; ids that don't fit are an
    error.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "sstable")
    most = max(end_id, largest_id(path))
    width = width or (2 if most <= 0xFFFF else 4)
    if width not in (2, 4) or most >> (8 * width):
        raise ValueError(f"ids up to {most} do not fit into {width} bytes (2 and 4 are possible)")

    def rows(batches):
        from pyspark import TaskContext

        store, root = _store(folder)
        part, made = TaskContext.get().partitionId(), 0
        shard = ShardWriter(width)

        def save():
            name = f"part-{part:06d}-{made:06d}.sst"
            store.create_dir(root, recursive=True)
            own = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
            data = shard.finish()
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, f"{root}/{name}")  # whole files only, the same from any attempt
            return {"part": [part], "number": [made], "name": [name], "first_key": [shard.keys[0]], "last_key": [shard.keys[-1]],
                    "n_docs": [len(shard.keys)], "n_tokens": [shard.tokens], "n_bytes": [len(data)]}

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(key_of(doc), ids.as_py())
                if len(shard) >= shard_bytes:
                    yield save()
                    shard, made = ShardWriter(width), made + 1
        if shard.keys:
            yield save()

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = own.agg(F.percentile_approx(key, shares, 20 * ranges + 10_000)).first()[0] or []
    encoded = _encoded(own, path, end_id, width, bounds[: ranges - 1])
    order = [F.col("doc_id").asc_nulls_first(), F.col("number")]
    ranged = encoded.repartitionById(ranges, F.col("range")).sortWithinPartitions(*order).select("doc_id", "ids")
    schema = "part long, number long, name string, first_key binary, last_key binary, n_docs long, n_tokens long, n_bytes long"
    return folder, written(arrow_map(ranged, rows, schema), "manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``before``, the ids in all files before each: sums by part, then within parts."""
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("__n"))  # one row a task that wrote
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return manifest.withColumn("__own", own).join(totals, "part").withColumn("before", F.col("__ahead") + F.col("__own")).drop("__own", "__ahead")


def _files(manifest: DataFrame) -> DataFrame:
    """Files dealt over the cluster whatever files their rows came from."""
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every entry, block by block."""

    def rows(batches):
        store, root = _store(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    shard = Shard(file)
                    for number in range(len(shard.index)):
                        entries = list(shard.entries(number))
                        n = [len(ids) // 4 for _, ids in entries]
                        at = np.cumsum([before, *n])
                        before = int(at[-1])
                        yield {"doc_id": [id_of(k) for k, _ in entries], "start": at[:-1].tolist(), "n_tokens": n, "ids": [v for _, v in entries]}

    schema = "doc_id long, start long, n_tokens long, ids binary"
    return arrow_map(_files(starts(manifest)).select("name", "before"), rows, schema)


def lookup(manifest: DataFrame, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of a stated list of ids.

    Only files whose range of keys holds one of them are opened, and of these
    the footer, the index, the filter and the block that may have the key.
    """
    keys = sorted({key_of(d) for d in doc_ids})

    def rows(batches):
        store, root = _store(folder)
        for batch in batches:
            for name, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = keys[bisect_left(keys, first) : bisect_right(keys, last)]
                if not mine:
                    continue
                with store.open_input_file(f"{root}/{name}") as file:
                    shard = Shard(file)
                    found = [(id_of(k), v) for k in mine for v in shard.get(k)]
                yield {"doc_id": [d for d, _ in found], "ids": [v for _, v in found]}

    return arrow_map(_files(manifest).select("name", "first_key", "last_key"), rows, "doc_id long, ids binary")


def digest(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the files."""
    return read_shards(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
