"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a run of documents of one task.  Its text is mapped to the alphabet
of the benchmark: a word that no benchmark item has becomes a separator, as no
phrase can lie across it, and runs of words shorter than every phrase are left out.  The
index of that text answers all test phrases by backward search; occurrences are
located through sampled suffix positions and merged into removal spans.

No document is shuffled.  A benchmark of at most ``BLOCK_BYTES`` of text is broadcast.
A larger one is dealt into blocks of about that size, whose phrases tasks write to the
shared folder; a worker reads them one after another for every ``SHARD_BYTES`` of documents, so that
neither the driver nor a worker ever holds more than one block.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from codeloom.llm.bytewords import ALNUM, Words, slices, text_buffers, words
from codeloom.llm.fm_index import FMIndex
from codeloom.llm.worker import release, small_batches
from codeloom.storage import materialize, new_path
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Text of documents that is searched at a time where blocks are read from the shared folder.
SHARD_BYTES = 32 << 20
#: Words of an index at most, unless one document has more.
SHARD_WORDS = 1 << 20


@dataclass
class Phrases:
    """The windows of a block of benchmark items."""

    vocabulary: np.ndarray  # sorted word hashes; the symbol of a word is its index + 1
    windows: list[np.ndarray]  # one array (windows, words) per length
    owner_first: list[np.ndarray]  # items of window w: owners[first[w] : first[w + 1]]
    owners: list[np.ndarray]
    items: list[str]

    @property
    def shortest(self) -> int:
        return min((w.shape[1] for w in self.windows), default=0)


def phrases(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    """All windows of ``window`` consecutive words; a shorter item, but not an empty one, is one window."""
    buf, offs = text_buffers(pa.array([t for _, t in items], pa.string()))
    w = words(buf, offs, ALNUM)
    vocabulary, symbol = np.unique(w.hash, return_inverse=True)
    symbol = symbol.astype(np.int64) + 1
    names = sorted({i for i, _ in items})
    number = {x: n for n, x in enumerate(names)}
    by_length: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    for i, (name, _) in enumerate(items):
        s = symbol[w.first[i] : w.first[i + 1]]
        if len(s):
            size = min(window, len(s))
            got = np.lib.stride_tricks.sliding_window_view(s, size)
            rows, own = by_length.setdefault(size, ([], []))
            rows.append(got)
            own.append(np.full(len(got), number[name]))
    out = Phrases(vocabulary, [], [], [], names)
    for _, (rows, own) in sorted(by_length.items()):
        unique, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.ravel(), np.concatenate(own)], axis=1), axis=0)
        out.windows.append(unique)
        out.owner_first.append(np.searchsorted(pairs[:, 0], np.arange(len(unique) + 1)))
        out.owners.append(pairs[:, 1])
    return out


def _search(w: Words, ph: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Which words are hit, and distinct (document, item) pairs as an array of two columns."""
    hit = np.zeros(len(w.hash), dtype=bool)
    none = np.zeros((0, 2), dtype=np.int64)
    if not ph.windows or not len(w.hash):
        return hit, none
    at = np.minimum(np.searchsorted(ph.vocabulary, w.hash), len(ph.vocabulary) - 1)
    known = ph.vocabulary[at] == w.hash
    doc = w.doc
    # runs of known words within one document
    joined = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
    begin = np.flatnonzero(known & ~np.concatenate([[False], joined]))
    stop = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
    long = stop - begin >= ph.shortest
    begin, stop = begin[long], stop[long]
    found = [none]
    while len(begin):
        upto = max(1, int(np.searchsorted(np.cumsum(stop - begin), SHARD_WORDS, side="right")))
        b, e = begin[:upto], stop[:upto]
        begin, stop = begin[upto:], stop[upto:]
        size = e - b
        place = 1 + np.cumsum(size + 1) - (size + 1)  # where each run starts in the text
        text = np.zeros(int(size.sum()) + len(size) + 1, dtype=np.int64)
        inside = np.repeat(place - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        word = np.repeat(b - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        text[inside] = at[word] + 1
        of_text = np.full(len(text), -1, dtype=np.int64)
        of_text[inside] = word
        index = FMIndex(text, len(ph.vocabulary))
        for windows, first, owners in zip(ph.windows, ph.owner_first, ph.owners, strict=True):
            lo, hi = index.search(windows)
            which = np.flatnonzero(hi > lo)
            n = hi[which] - lo[which]
            if not len(which):
                continue
            rows = np.repeat(lo[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            start = of_text[index.locate(rows)]
            pattern = np.repeat(which, n)
            mark = np.zeros(len(hit) + 1, dtype=np.int64)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + windows.shape[1], -1)
            hit |= np.cumsum(mark[:-1]) > 0
            seen = np.unique(np.stack([doc[start], pattern], axis=1), axis=0)
            n_own = first[seen[:, 1] + 1] - first[seen[:, 1]]
            own = owners[np.repeat(first[seen[:, 1]] - np.cumsum(n_own) + n_own, n_own) + np.arange(int(n_own.sum()))]
            found.append(np.stack([np.repeat(seen[:, 0], n_own), own], axis=1))
    return hit, np.unique(np.concatenate(found), axis=0)


@dataclass
class Blocks:
    """The benchmark's phrases: one broadcast block, or files that are read one at a time."""

    one: Broadcast | None
    files: list[str]

    def __iter__(self) -> Iterator[Phrases]:
        if self.one is not None:
            yield self.one.value
        for uri in self.files:
            files, path = fs.FileSystem.from_uri(uri)
            with files.open_input_stream(path) as stream:
                yield pickle.loads(stream.read())

    def shards(self, batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows to search at a time, with the buffer and offsets of their texts."""
        for batch in gathered(batches, SHARD_BYTES) if self.files else batches:
            buf, offs = text_buffers(batch.column(column))
            for i, j in slices(offs, SHARD_BYTES if self.files else 8 << 20):
                yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _search_all(w: Words, blocks: Blocks) -> tuple[np.ndarray, dict[int, list[str]]]:
    """Hit words over all blocks, and the sorted names of the items of each document that has any."""
    hit = np.zeros(len(w.hash), dtype=bool)
    items: dict[int, set[str]] = {}
    for ph in blocks:
        more, pairs = _search(w, ph)
        hit |= more
        for d, o in pairs.tolist():
            items.setdefault(d, set()).add(ph.items[o])
        del ph  # before the next one is read
    return hit, {d: sorted(x) for d, x in items.items()}


def removal_spans(w: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged byte spans of consecutive hit words: document, begin, end."""
    doc = w.doc
    joined = hit[1:] & hit[:-1] & (doc[1:] == doc[:-1])
    begin = np.flatnonzero(hit & ~np.concatenate([[False], joined])) if len(hit) else np.zeros(0, dtype=np.int64)
    stop = np.flatnonzero(hit & ~np.concatenate([joined, [False]])) if len(hit) else begin
    return doc[begin], w.start[begin], w.end[stop]


def _report(blocks: Blocks):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        nothing = hashlib.sha256(b"").hexdigest()
        for part, buf, offs in blocks.shards(batches, 1):
            w = words(buf, offs, ALNUM)
            hit, items = _search_all(w, blocks)
            count = np.concatenate([[0], np.cumsum(hit)])
            n_hit = count[w.first[1:]] - count[w.first[:-1]]
            owned = [items.get(d, []) for d in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(w.first), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in owned], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else nothing for x in owned], pa.string()),
                    pa.array(n_hit > 0, pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _cut(texts: list[bytes], blocks: Blocks) -> list[bytes]:
    """``texts`` without their hit words, again until none is left."""
    texts, todo = list(texts), list(range(len(texts)))
    while todo:
        offs = np.concatenate([[0], np.cumsum([len(texts[d]) for d in todo])]).astype(np.int64)
        w = words(np.frombuffer(b"".join(texts[d] for d in todo), dtype=np.uint8), offs, ALNUM)
        doc, begin, end = removal_spans(w, _search_all(w, blocks)[0])
        bounds = np.searchsorted(doc, np.arange(len(todo) + 1))
        left = []
        for n, d in enumerate(todo):
            keep, at = [], 0
            for k in range(bounds[n], bounds[n + 1]):
                keep.append(texts[d][at : begin[k] - offs[n]])
                at = end[k] - offs[n]
            if keep:
                texts[d] = b"".join([*keep, texts[d][at:]])
                left.append(d)
        todo = left
    return texts


def _remove(blocks: Blocks, column: int, drop_emptied: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part, buf, offs in blocks.shards(batches, column):
            w = words(buf, offs, ALNUM)
            hit, _ = _search_all(w, blocks)
            count = np.concatenate([[0], np.cumsum(hit)])
            bad = np.flatnonzero(count[w.first[1:]] > count[w.first[:-1]]).tolist()
            if not bad:
                yield part
                continue
            texts = part.column(column).to_pylist()
            for d, text in zip(bad, _cut([texts[d].encode() for d in bad], blocks), strict=True):
                texts[d] = text.decode()
            columns = list(part.columns)
            columns[column] = pa.array(texts, part.schema.field(column).type)
            cut = pa.RecordBatch.from_arrays(columns, schema=part.schema)
            if drop_emptied:
                stay = np.ones(part.num_rows, dtype=bool)
                after, ends = text_buffers(columns[column])
                stay[bad] = np.diff(words(after, ends, ALNUM).first)[bad] > 0
                cut = cut.filter(pa.array(stay))
            yield cut

    return run


def _block_files(folder: str, window: int):
    """(item_id, text) of a block to a file of its phrases: path."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if items:
            files, root = fs.FileSystem.from_uri(folder)
            files.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.phrases"  # each attempt has its own; the table of paths says which counts
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(pickle.dumps(phrases(items, window), protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Blocks:
    """The benchmark as one broadcast of bounded size, or as files of blocks of about that size; an empty one gives none."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    spark = benchmark.sparkSession
    small_batches(spark)
    if total <= block_bytes:
        items = [(r.item_id, r.text) for r in rows.collect()]
        return Blocks(spark.sparkContext.broadcast(phrases(items, window)) if items else None, [])
    rows = rows.distinct()  # a task holds its block's items, and copies of one item are one
    dealt = rows.repartition(-(-total // block_bytes), F.xxhash64("item_id", "text"))
    paths, _ = materialize(dealt.mapInArrow(_block_files(new_path(spark, "benchmark-blocks"), window), "path string"), "benchmark-paths")
    return Blocks(None, sorted(r.path for r in paths.collect()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What of each document occurs in the benchmark.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of
    ``docs``.  Words are runs of letters, digits and non-ASCII characters, A-Z
    folded.  ``n_hit`` words lie in some occurrence of a window of an item; the
    ``n_items`` items with occurring windows are hashed as sorted, comma-joined strings.

    A null or empty text has no words and no hits.  Items with a null id or
    text, or without words, have no windows.  Items that share an id count as one.
    Repeated documents each get their row; a null ``doc_id`` is passed on.  Other
    columns are not read.  Without items nothing is hit.
    """
    blocks = _blocks(benchmark, window, block_bytes)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_report(blocks), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with all its rows and columns, without the hit words of ``contamination``.

    Each removal span reaches from the first to the last of consecutive hit words;
    what lies round it stays, and the rest of the text is searched again until
    nothing is hit, as words may come together that were apart.  ``drop_emptied`` drops rows that lost their last word.
    Null and empty texts, repeated rows, empty tables and odd items are as in ``contamination``; all columns are passed on.
    """
    blocks = _blocks(benchmark, window, block_bytes)
    return docs.mapInArrow(_remove(blocks, docs.columns.index("text"), drop_emptied), docs.schema)
