"""Sorted-string-table shards of token ids, keyed by document id.

A shard file::

    magic
    data blocks     zstd frames; entries with prefix-compressed keys, about BLOCK bytes each
    bloom filter    bits of the double-hashed keys
    block index     first key, offset, size and entry count of every block
    footer          fixed size: places of the sections, totals, magic

Keys are eight big-endian bytes of the id with the sign bit turned (a null id is
the empty key), so byte order is id order.  A value is one byte for the width of an
id (2 or 4) and the little-endian ids.  ``ShardReader.get`` asks the Bloom
filter, finds the block by binary search in the sparse index, then scans it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from codeloom.llm.bytewords import U64, mix, slices, text_buffers
from codeloom.llm.subword import encoder
from codeloom.llm.worker import small_batches
from codeloom.storage import materialize, new_path
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAGIC = b"LOOMSST1"
BLOCK = 64 << 10
SHARD_BYTES = 64 << 20
#: Text of an id range, which one task encodes, and ranges at most.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 14
BITS_PER_KEY = 10
PROBES = 7
_FOOTER = struct.Struct("<QQQQQQQ8s")
_INDEX = struct.Struct("<QII")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


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
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\x04" + ids.astype("<u4").tobytes()) if wide else (b"\x02" + ids.astype("<u2").tobytes())


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<u4" if value[0] == 4 else "<u2", offset=1).astype("<u4")


def _bloom_bits(keys: list[bytes], n_bits: int) -> np.ndarray:
    """Bit numbers of each key: shape (keys, PROBES)."""
    base = mix(np.array([(int.from_bytes(k, "big") + len(k)) & ((1 << 64) - 1) for k in keys], dtype=U64))
    step = mix(base) | U64(1)
    return ((base[:, None] + step[:, None] * np.arange(PROBES, dtype=U64)[None, :]) % U64(n_bits)).astype(np.int64)


class ShardWriter:
    """Writes one shard to a binary stream; entries must come in key order."""

    def __init__(self, out) -> None:
        self.out, self.at = out, 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self.tokens = 0
        self._open()
        self._put(MAGIC)

    def _open(self) -> None:
        self.block, self.size, self.count, self.last, self.first = [], 0, 0, b"", b""

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.count:
            self.first = key
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        value = pack_ids(ids)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.count += 1
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if self.size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            data = zstandard.ZstdCompressor(level=1, write_checksum=True).compress(b"".join(self.block))
            self.index.append(_varint(len(self.first)) + self.first + _INDEX.pack(self.at, len(data), self.count))
            self._put(data)
        self._open()

    def close(self) -> None:
        self._flush()
        bloom_at = self.at
        n_bits = max(64, BITS_PER_KEY * len(self.keys))
        bits = np.zeros(n_bits, dtype=bool)
        if self.keys:
            bits[_bloom_bits(self.keys, n_bits).ravel()] = True
        self._put(np.packbits(bits).tobytes())
        index_at = self.at
        self._put(b"".join(self.index))
        self._put(_FOOTER.pack(bloom_at, n_bits, index_at, len(self.index), len(self.keys), self.tokens, self.at - index_at, MAGIC))
        self.out.close()


class ShardReader:
    """Reads one shard through a random-access file; only footer, index and Bloom filter stay in memory."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        self.bloom_at, self.n_bits, index_at, n_blocks, self.n_docs, self.n_tokens, index_size, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard, or a cut one")
        source.seek(self.bloom_at)
        self.bits = np.unpackbits(np.frombuffer(source.read(index_at - self.bloom_at), dtype=np.uint8))
        data, at = source.read(index_size), 0
        self.first: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        for _ in range(n_blocks):
            n, at = _read_varint(data, at)
            self.first.append(data[at : at + n])
            self.blocks.append(_INDEX.unpack_from(data, at + n))
            at += n + _INDEX.size

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        at, size, count = self.blocks[block]
        self.source.seek(at)
        data, key, at = zstandard.ZstdDecompressor().decompress(self.source.read(size)), b"", 0
        for _ in range(count):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + length]
            at += length

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in key order."""
        for block in range(len(self.blocks)):
            for key, value in self._entries(block):
                yield id_of(key), unpack_ids(value)

    def may_contain(self, doc_id: int | None) -> bool:
        return bool(self.bits[_bloom_bits([key_of(doc_id)], self.n_bits)[0]].all())

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of a document, the first if it was written twice; None if there is none."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_contain(doc_id):
            return None
        block = max(0, bisect_right(self.first, key) - 1)
        while block > 0 and self.first[block] == key:  # repeated keys may begin in the block before
            block -= 1
        for b in range(block, len(self.blocks)):
            if self.first[b] > key:
                return None
            for k, value in self._entries(b):
                if k == key:
                    return unpack_ids(value)
        return None


def open_shard(uri: str) -> ShardReader:
    files, path = fs.FileSystem.from_uri(uri)
    return ShardReader(files.open_input_file(path))


def _write_batches(folder: str, tokenizer: str, end_id: int, shard_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        enc, rows, writer, name = encoder(tokenizer), [], None, ""
        lo = hi = None

        def finish() -> None:
            nonlocal writer
            writer.close()
            rows.append((part, len(rows), f"{folder}/{name}", len(writer.keys), writer.tokens, lo, hi))
            writer = None

        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            ids_of = batch.column(0).to_pylist()
            for i, j in slices(offs):
                got = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for d in range(j - i):
                    if writer is None:
                        # a name of its own for every attempt; the manifest says which files count
                        name = f"shard-{part:06d}-{len(rows):06d}-{uuid.uuid4().hex}.sst"
                        writer, lo = ShardWriter(files.open_output_stream(f"{root}/{name}")), ids_of[i + d]
                    hi = ids_of[i + d]
                    writer.add(key_of(hi), np.append(got.ids[got.bounds[d] : got.bounds[d + 1]], np.uint32(end_id)))
                    if writer.at >= shard_bytes:
                        finish()
        if writer is not None:
            finish()
        if rows:
            part_no, seq, path, n, tokens, first, last = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part_no, pa.int32()), pa.array(seq, pa.int32()), pa.array(path, pa.string()), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                names=["part", "seq", "path", "n_docs", "n_tokens", "first_id", "last_id"],
            )

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` and write them as shards in ascending id order; returns the manifest.

    ``tokenizer`` is the path of a ``tokenizers`` file on the workers; ``end_id`` ends each document.
    ``folder`` is a URI that all workers can write (default: in the shared folder).
    The manifest, itself a table in the shared folder, has one row per shard:
    ``part, seq, path, n_docs, n_tokens, first_id, last_id, start``, with ``start`` the ids in all
    shards before it.  Tasks that run again write files of new names, which
    only count if the manifest names them.

    A null or empty text is its end id alone; a null id sorts first; repeated ids
    are all kept, in the order of hashes of their texts.  Other columns are not read.  An empty table gives no shard.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, 1 + size // RANGE_BYTES)
    order = [F.col("doc_id"), F.xxhash64("text")]  # the text's hash deals rows of one id, or of none, over ranges
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = "part int, seq int, path string, n_docs long, n_tokens long, first_id long, last_id long"
    manifest, _ = materialize(dealt.mapInArrow(_write_batches(folder, tokenizer, end_id, shard_bytes), schema), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _read_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out: list[tuple] = []
            for doc_id, ids in open_shard(uri).scan():
                out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
                if len(out) == 4096:
                    yield _summary(out)
                    out = []
            if out:
                yield _summary(out)


def _summary(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_summaries(manifest: DataFrame) -> DataFrame:
    """One row per document, read back from the shards: ``doc_id, start, n_tokens, ids_crc32``."""
    shards = manifest.select("path", "start").repartition(max(1, min(MOST_RANGES, manifest.count())))
    return shards.mapInArrow(_read_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """The ids of one document: the manifest gives the shard, the shard's index the block."""
    for row in manifest.filter((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)).orderBy("part", "seq").toLocalIterator():
        found = open_shard(row.path).get(doc_id)
        if found is not None:
            return found
    return None
