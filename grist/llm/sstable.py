"""Token ids in sorted-string-table shards.

File layout: magic; data blocks; Bloom filter; block index; footer.  A block
holds entries in key order, each ``varint shared | varint rest | varint value
length | key rest | value``, and is compressed as a whole.  The index has the
last key, offset and length of each block, so a lookup asks the Bloom filter,
bisects the index and reads one block (more only while a key repeats).

Key: one byte 0 for a null id, else byte 1 and the id, sign bit flipped, big
endian; keys therefore sort as null first, then ascending.  Value: width byte
(2 or 4) and the ids, little endian.

Rows repeated under one id are all kept, in order of their texts' hash.  Null
text is empty; an empty text has the end id alone.  An empty table gives no
shard.  Shards are ranges of (id, hash, place of the row), so one id and even one
row with many copies is split, and a task begins a new shard after SHARD_IDS ids,
which bounds a shard's size and the keys held for its filter.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, new_folder, written
from .tokens import encoder as shared_encoder
from .tokens import tokenizer_path
from .words import slices

MAGIC = b"GRSST01\n"
FOOTER = struct.Struct("<QQQQQQI8s")  # bloom offset, length; index offset, length; entries, ids; crc; magic
BLOCK = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
SHARD_IDS = 1 << 26  # ids of a shard, and those of one row


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def value_of(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\4" + ids


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=f"<u{value[0]}", offset=1).astype("<u4")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = buf[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    h, step = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(h + i * step) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out):
        import zstandard

        self.out, self.at, self.zip = out, 0, zstandard.ZstdCompressor(level=1)
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.last, self.entries, self.ids = bytearray(), b"", 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + n_ids
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.index.append((self.last, self.at, len(data)))
            self._put(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, dtype=np.uint8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<Q", bits) + bloom.tobytes()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        b, i = self.at, self.at + len(bloom)
        self._put(bloom)
        self._put(index)
        self._put(FOOTER.pack(b, len(bloom), i, len(index), self.entries, self.ids, zlib.crc32(bloom + index), MAGIC))


class Reader:
    """Reads one shard: ``get`` for a key, ``scan`` for everything in order."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard")
        b, nb, i, ni, self.entries, self.ids, crc, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        bloom, index = self._at(b, nb), self._at(i, ni)
        if magic != MAGIC or zlib.crc32(bloom + index) != crc:
            raise ValueError("damaged footer, filter or index")
        (self.bits,), self.bloom = struct.unpack_from("<Q", bloom), bloom[8:]
        self.last, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            o, at = _read_varint(index, at)
            n, at = _read_varint(index, at)
            self.last.append(key)
            self.blocks.append((o, n))

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = self.unzip.decompress(self._at(*self.blocks[i])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + length]
            at += rest + length

    def get(self, key: bytes) -> list[bytes]:
        """The values of the key, in order; none if it is absent."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return []
        found = []
        for i in range(bisect_left(self.last, key), len(self.last)):
            found += [v for k, v in self._block(i) if k == key]
            if self.last[i] != key:
                break
        return found

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._block(i)


def open_shard(path: str) -> Reader:
    fs, name = filesystem(path)
    return Reader(fs.open_input_file(name), fs.get_file_info(name).size)


def write_shards(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the shards and returns their manifest (shard, path, entries, ids, first, last), one row each.

    A task writes under a name of its own and only names of finished tasks get into the manifest.
    """
    tokenizer = tokenizer or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, out, first, path = TaskContext.get().partitionId() << 20, None, None, None, ""
        encoder = None

        def finish() -> pa.RecordBatch:
            nonlocal shard, writer
            writer.close()
            out.close()
            row = {"shard": pa.array([shard], pa.int64()), "path": [path], "entries": [writer.entries], "ids": [writer.ids], "first": pa.array([first], pa.int64()), "last": pa.array([id_of(writer.last)], pa.int64())}
            shard, writer = shard + 1, None
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or shared_encoder(tokenizer)
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 2_000_000):
                for key, ids in zip(keys[a:b], encoder.encode(texts[a:b])):
                    if writer is None:
                        fs, name = filesystem(folder)
                        fs.create_dir(name, recursive=True)
                        path = f"{folder}/{shard:012d}-{uuid.uuid4().hex}.sst"
                        out = fs.open_output_stream(filesystem(path)[1])
                        writer, first = Writer(out), key
                    writer.add(key_of(key), value_of(ids + end), len(ids) // 4 + 1)
                    if writer.ids >= SHARD_IDS:
                        yield finish()
        if writer is not None:
            yield finish()

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.monotonically_increasing_id().alias("place"))
    ranged = rows.repartitionByRange("key", "tie", "place").sortWithinPartitions("key", "tie", "place").select("key", "text")
    return written(ranged.mapInArrow(write, "shard long, path string, entries long, ids long, first long, last long"), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each entry, read from the files; start counts ids before it over all shards."""
    shards, start = [], 0
    for row in manifest.orderBy("shard").toLocalIterator():  # one row a file
        shards.append((row.path, start))
        start += row.ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for key, value in open_shard(path).scan():
                    ids = ids_of(value)
                    rows.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    files = spark.createDataFrame(shards, "path string, start long").repartition(max(1, len(shards)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def lookup(spark: SparkSession, manifest: DataFrame, doc_ids: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Ids of a few documents by binary search; opens only shards whose range may hold them."""
    rows = manifest.orderBy("shard").collect()
    out: dict[int | None, list[np.ndarray]] = {}
    for doc_id in doc_ids:
        key = key_of(doc_id)
        near = [r.path for r in rows if key_of(r.first) <= key <= key_of(r.last)]
        out[doc_id] = [ids_of(v) for path in near for v in open_shard(path).get(key)]
    return out


def token_shards(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes ``docs`` to fresh shards in the shared folder and reads them back."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, new_folder(spark, "sst"), id, text, tokenizer, end_id))
