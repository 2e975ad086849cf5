"""Cost-balanced packing of documents into sequences of bounded length.

The cost of a piece of ``n`` tokens is estimated as ``LINEAR * n + QUADRATIC * n**2``
(attention within the piece).  Whole runs of ``capacity`` tokens become sequences of
their own.  The remainders of a group of documents go, in descending order of
cost, each to the sequence of lowest cost that still has room for it; what fits
nowhere is cut over the sequences that have room left, lowest cost first.  A group
has as many sequences as its tokens fill, so every one ends up full; what is
over moves to the next group.  The last group of a task ends in sequences whose
lengths are powers of two, which need no padding.

Groups are formed within a task, from its documents as they come: no shuffle.  What waits for its
group is a copy of a document's last tokens, less than a sequence, so a task needs memory for one group and one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from codeloom.llm.bytewords import slices, text_buffers
from codeloom.llm.subword import encoder
from codeloom.llm.worker import small_batches
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Sequences of a group.
GROUP = 256
LINEAR = 1.0
QUADRATIC = 1.0 / 2048


def cost(n: np.ndarray | float) -> np.ndarray | float:
    """Estimated cost of a piece of ``n`` tokens."""
    return LINEAR * n + QUADRATIC * n * n


@dataclass
class Piece:
    item: int
    start: int
    length: int
    sequence: int
    offset: int


def pack(lengths: list[int], capacities: list[int]) -> tuple[list[Piece], dict[int, int]]:
    """Assign items to sequences of the given capacities; also what is left of items: item -> tokens placed."""
    room = np.array(capacities, dtype=np.int64)
    load = np.zeros(len(room))
    used = np.zeros(len(room), dtype=np.int64)
    pieces: list[Piece] = []
    over: list[int] = []

    def place(item: int, start: int, n: int, s: int) -> None:
        pieces.append(Piece(item, start, n, s, int(used[s])))
        used[s] += n
        room[s] -= n
        load[s] += cost(n)

    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fits = np.where(room >= n, load, np.inf)
        s = int(fits.argmin()) if len(fits) else 0
        if len(fits) and fits[s] < np.inf:
            place(item, 0, n, s)
        else:
            over.append(item)
    left: dict[int, int] = {}
    for item in over:
        start = 0
        while start < lengths[item]:
            fits = np.where(room > 0, load, np.inf)
            s = int(fits.argmin()) if len(fits) else 0
            if not len(fits) or fits[s] == np.inf:
                left[item] = start
                break
            n = min(int(room[s]), lengths[item] - start)
            place(item, start, n, s)
            start += n
    return pieces, left


def _powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


@dataclass
class _Doc:
    doc_id: int | None
    tail: np.ndarray  # the tokens that lie in no piece yet
    tokens: int  # of the whole document

    @property
    def start(self) -> int:
        return self.tokens - len(self.tail)


class _Packer:
    """Packs the documents of one task."""

    def __init__(self, first_sequence: int, capacity: int, group: int) -> None:
        self.next, self.capacity, self.group = first_sequence, capacity, group
        self.waiting: list[_Doc] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            yield doc_id, start, self.capacity, _crc(ids[start : start + self.capacity]), len(ids), self.next, 0
            self.next += 1
        if len(ids) > whole:
            self.waiting.append(_Doc(doc_id, ids[whole:].copy(), len(ids)))
            self.tokens += len(ids) - whole
            if self.tokens >= self.group * self.capacity:
                yield from self._group(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.waiting:
            yield from self._group(last=True)

    def _group(self, last: bool) -> Iterator[tuple]:
        capacities = [self.capacity] * (self.tokens // self.capacity)
        if last:
            capacities += _powers_of_two(self.tokens % self.capacity)
        pieces, left = pack([len(d.tail) for d in self.waiting], capacities)
        for p in pieces:
            d = self.waiting[p.item]
            yield d.doc_id, d.start + p.start, p.length, _crc(d.tail[p.start : p.start + p.length]), d.tokens, self.next + p.sequence, p.offset
        self.next += len(capacities)
        self.waiting = [_Doc(self.waiting[i].doc_id, self.waiting[i].tail[done:].copy(), self.waiting[i].tokens) for i, done in sorted(left.items())]
        self.tokens = sum(len(d.tail) for d in self.waiting)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack_batches(tokenizer: str, end_id: int, capacity: int, group: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, group)
        enc, rows = encoder(tokenizer), []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_NAMES)
            rows.clear()
            return made

        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in slices(offs):
                got = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for d in range(j - i):
                    rows.extend(packer.add(names[i + d], np.append(got.ids[got.bounds[d] : got.bounds[d + 1]], np.uint32(end_id))))
                if len(rows) > 4096:
                    yield out()
        rows.extend(packer.finish())
        if rows:
            yield out()

    return run


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a ``tokenizers`` file on the workers; ``end_id``
    ends each document.  Sequence ids are unique, not consecutive; the offsets in
    a sequence have no gaps.  Every sequence has ``capacity`` tokens or a power of two.

    A null or empty text is its end id alone.  Null ids are passed on; repeated
    rows are packed each.  Other columns are not read.  An empty table gives no
    rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack_batches(tokenizer, end_id, capacity, group), ", ".join(f"{n} long" for n in _NAMES))
