"""Sorted-string-table shards: documents keyed by identifier, for lookup by binary search.

A shard's bytes::

    block*          entries (varint shared, varint rest, varint value length, key's rest, value); every
                    16th key is whole; then the restarts' offsets and their number (u32) and a crc32 (u32)
    index           for each block: u16 key length, last key, u64 offset, u32 length
    Bloom filter    bits; 10 a key, 7 probes
    footer          6 x u64 (index offset, index length, filter offset, filter length, entries, blocks), magic

Keys are the id's eight bytes, big-endian with the sign bit turned, so that byte order is the order of ids; a null
id is the empty key.  A value is a flag byte (0 null, 1 present) and the bytes: UTF-8 text, or token ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = b"SSTSHRD1"
FOOTER = struct.Struct("<6Q8s")
_M = (1 << 64) - 1


def encode_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id & _M) ^ (1 << 63)).to_bytes(8, "big")


def decode_key(key: bytes) -> int | None:
    if not key:
        return None
    x = int.from_bytes(key, "big") ^ (1 << 63)
    return x - (1 << 64) if x >> 63 else x


def _varint(x: int) -> bytes:
    if x < 128:
        return bytes((x,))
    out = bytearray()
    while x >= 128:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def _probes(key: bytes, bits: int, n: int = 7) -> list[int]:
    h = int.from_bytes(key.rjust(8, b"\0"), "big") + len(key)
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _M
    h ^= h >> 31
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(n)]


class ShardWriter:
    """Builds one shard from keys in ascending order; equal keys may follow each other."""

    def __init__(self, block_bytes: int = 32 << 10, restart: int = 16, bits_per_key: int = 10):
        self.block_bytes, self.restart, self.bits_per_key = block_bytes, restart, bits_per_key
        self.out, self.block, self.restarts, self.index, self.keys = bytearray(), bytearray(), [], [], []
        self.last, self.n, self.in_block = b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block % self.restart == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last, self.n, self.in_block = key, self.n + 1, self.in_block + 1
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.in_block:
            self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, len(self.out), len(self.block)))
            self.out += self.block
            self.block, self.restarts, self.in_block = bytearray(), [], 0

    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self._end_block()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index)
        bits = max(64, len(self.keys) * self.bits_per_key)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        at = len(self.out)
        self.out += index + bloom
        self.out += FOOTER.pack(at, len(index), at + len(index), len(bloom), self.n, len(self.index), MAGIC)
        return bytes(self.out)


class ShardReader:
    """Looks keys up in a shard's bytes: Bloom filter, binary search of the index, then of the restarts."""

    def __init__(self, data: bytes):
        self.data = memoryview(data).cast("B")  # an Arrow buffer's own view has signed bytes
        if len(data) < FOOTER.size:
            raise ValueError("not a shard")
        i, n, b, m, self.entries, self.blocks, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom, self.last, self.place = self.data[b : b + m], [], []
        at = i
        while at < i + n:
            size = struct.unpack_from("<H", self.data, at)[0]
            self.last.append(bytes(self.data[at + 2 : at + 2 + size]))
            self.place.append(struct.unpack_from("<QI", self.data, at + 2 + size))
            at += 14 + size

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8))

    def _block(self, k: int) -> tuple[memoryview, list[int], int]:
        offset, size = self.place[k]
        block = self.data[offset : offset + size]
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        count = struct.unpack("<I", block[-8:-4])[0]
        end = size - 8 - 4 * count
        return block, list(struct.unpack(f"<{count}I", block[end : end + 4 * count])), end

    @staticmethod
    def _entries(block: memoryview, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            head = []
            for _ in range(3):
                x = shift = 0
                while True:
                    byte = block[at]
                    at += 1
                    x |= (byte & 127) << shift
                    shift += 7
                    if byte < 128:
                        break
                head.append(x)
            key = key[: head[0]] + bytes(block[at : at + head[1]])
            at += head[1]
            yield key, bytes(block[at : at + head[2]])
            at += head[2]

    def get(self, key: bytes) -> list[bytes]:
        """All values of the key, in the order of writing."""
        out: list[bytes] = []
        if not self.may_have(key):
            return out
        for k in range(bisect_left(self.last, key), self.blocks):
            block, restarts, end = self._block(k)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:  # the last restart whose key is below the key
                mid = (lo + hi + 1) // 2
                if next(self._entries(block, restarts[mid], end))[0] < key:
                    lo = mid
                else:
                    hi = mid - 1
            for found, value in self._entries(block, restarts[lo], end):
                if found > key:
                    return out
                if found == key:
                    out.append(value)
        return out

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(self.blocks):
            block, restarts, end = self._block(k)
            yield from self._entries(block, 0, end)


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, value): token ids as 32-bit numbers without sign, the lowest byte first; null stays null, and a null token or one beyond 32 bits raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for row in batch.column(1):
                ids = None if row.values is None else row.values.to_numpy(zero_copy_only=False)
                if ids is not None and len(ids) and not (ids.dtype.kind == "i" and 0 <= ids.min() and ids.max() < 1 << 32):
                    raise ValueError("a token isn't a number of 32 bits without sign")
                values.append(None if ids is None else ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["doc_id", "value"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, value binary")


def unpack_tokens(value: bytes) -> list[int]:
    """The token ids of a value."""
    return np.frombuffer(value, "<u4").tolist()


def build_shards(docs: DataFrame, id_col: str = "doc_id", value_col: str = "text", block_bytes: int = 32 << 10, max_shard_bytes: int = 32 << 20, bits_per_key: int = 10) -> DataFrame:
    """(shard, first_id, last_id, n_entries, n_blocks, data): the table as shards in the order of ids.

    Rows are range-partitioned by id, so shards hold ranges that at most share an id at their ends; adaptive
    execution sizes the partitions, and a partition starts a new shard beyond ``max_shard_bytes``.  The value is a string
    (kept as UTF-8), a binary column, or token ids in an array of whole numbers, which ``pack_tokens`` makes binary.
    Ids are whole numbers; strings that aren't raise an error.

    - A null id is kept under the empty key, first of all; a null value stays apart from an empty one.
    - Rows that repeat an id are all kept, in the order of their values; a long value makes a long block.
    - No rows in, no shards out.  Other columns are ignored, whatever their names.
    """
    if docs.schema[value_col].dataType.simpleString() in ("array<int>", "array<bigint>"):
        docs = pack_tokens(docs, id_col, value_col).withColumnsRenamed({"doc_id": id_col, "value": value_col})
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(value_col).cast("binary").alias("value"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer, first = TaskContext.get().partitionId(), 0, None, None

        def done() -> pa.RecordBatch:
            data = writer.finish()
            return pa.RecordBatch.from_pydict({"shard": [f"{part:06d}-{number:04d}"], "first_id": pa.array([decode_key(first)], pa.int64()), "last_id": pa.array([decode_key(writer.last)], pa.int64()), "n_entries": pa.array([writer.n], pa.int64()), "n_blocks": pa.array([len(writer.index)], pa.int32()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            ids, values = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                key, value = encode_key(doc_id), values[i].as_buffer()
                if writer is None:
                    writer, first = ShardWriter(block_bytes, bits_per_key=bits_per_key), key
                writer.add(key, b"\0" if value is None else b"\1" + value.to_pybytes())
                if writer.size() >= max_shard_bytes:
                    yield done()
                    writer, number = None, number + 1
        if writer is not None:
            yield done()

    return rows.mapInArrow(run, "shard string, first_id bigint, last_id bigint, n_entries bigint, n_blocks int, data binary")


def lookup(shards: DataFrame, ids: list[int | None]) -> DataFrame:
    """(doc_id, value) for the ids; a shard whose range holds none of them isn't opened."""
    wanted = sorted({x for x in ids if x is not None})
    null = None in ids
    near = F.lit(False)
    for x in wanted:
        near = near | ((F.coalesce("first_id", F.lit(x)) <= x) & (F.col("last_id") >= x))
    if null:
        near = near | F.col("first_id").isNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                reader = ShardReader(data.as_buffer())
                for x in [*wanted, *[None] * null]:
                    for v in reader.get(encode_key(x)):
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x], pa.int64()), "value": pa.array([None if v[:1] == b"\0" else v[1:]], pa.binary())})

    return shards.filter(near).select("data").mapInArrow(run, "doc_id bigint, value binary")


def save(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each shard to ``folder``/<shard>.sst, by rename, so that a task that runs again does no harm; returns (shard, path, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = os.path.join(folder, f"{name}.sst")
                data = data.as_buffer()
                with open(f"{path}.{os.getpid()}.tmp", "wb") as f:
                    f.write(data)
                os.replace(f.name, path)
                yield pa.RecordBatch.from_pydict({"shard": [name], "path": [path], "size": pa.array([data.size], pa.int64())})

    return shards.select("shard", "data").mapInArrow(run, "shard string, path string, size bigint")
