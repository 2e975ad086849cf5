"""Encoding, shards, packing and token counts against the plain tokenizer."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from codeloom.llm import packing, sstable, token_counts
from codeloom.llm.bytewords import text_buffers
from codeloom.llm.subword import ChunkEncoder, tokenizer_path
from tokenizers import Tokenizer

from .conftest import prose

PATTERNS = ["a", "B", "é", "ß", " ", "  ", "\n", " ", "　", "'s", "'", "1", "0", "23", "!", "...", "́", "中", " ", "\t", "\x85", "İ", "Σ", "the", "\U0001f600", "\x1c", "<|endoftext|>"]


def plain(name: str, texts: list[str | None]) -> list[list[int]]:
    t = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_whole_texts(name, odd_rows):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PATTERNS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [t for _, t in odd_rows] + ["x" * 70000 + " y" * 10, " ", ""]
    enc = ChunkEncoder(tokenizer_path(name))
    for _ in range(2):  # the second time from the table of chunks
        buf, offs = text_buffers(pa.array(texts, pa.string()))
        got = enc.encode(buf, offs)
        assert [got.ids[got.bounds[i] : got.bounds[i + 1]].tolist() for i in range(len(texts))] == plain(name, texts)


def test_shards_round_trip(spark, odd_docs, odd_rows, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    manifest = sstable.write_shards(odd_docs, path, 2, shard_bytes=4096)
    assert manifest.count() > 1
    got = sorted(map(tuple, sstable.read_summaries(manifest).collect()), key=lambda r: r[1])
    ids = [x + [2] for x in plain("byte_bpe_50k.json", [t for _, t in odd_rows])]
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for (i, _), x in zip(odd_rows, ids, strict=True))
    keys = [(r[0] is not None, r[0] or 0) for r in got]
    assert keys == sorted(keys)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    for (i, _), x in zip(odd_rows, ids, strict=True):
        if i is not None:
            assert sstable.lookup(manifest, i).tolist() == x
    assert sstable.lookup(manifest, 999) is None and sstable.lookup(manifest, 10**15) is None
    assert sstable.read_summaries(sstable.write_shards(no_docs, path, 2)).collect() == []


def test_rows_of_one_id_are_dealt(spark, monkeypatch):
    """An id with a third of all rows, and rows without an id, are in several shards, in order of ids."""
    monkeypatch.setattr(sstable, "RANGE_BYTES", 4000)
    rows = [(i if i % 3 else 700, f"text {i} {prose(i, 5)}") for i in range(900)] + [(None, f"none {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = sstable.write_shards(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    shards = manifest.orderBy("part", "seq").collect()
    assert sum(r.first_id == r.last_id == 700 for r in shards) > 1 and sum(r.last_id is None for r in shards) > 1
    got = sorted(map(tuple, sstable.read_summaries(manifest).collect()), key=lambda r: r[1])
    assert [(r[0] is not None, r[0]) for r in got] == sorted(((i is not None, i) for i, _ in rows), key=lambda x: (x[0], x[1] or 0))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]


def test_shard_file_lookup(tmp_path):
    ids = {k: np.arange(k % 50 + 1, dtype=np.uint32) + (70000 if k % 7 == 0 else 0) for k in range(-3000, 30000, 11)}
    w = sstable.ShardWriter((tmp_path / "s").open("wb"))
    for k, v in ids.items():
        w.add(sstable.key_of(k), v)
    w.close()
    r = sstable.open_shard(f"file://{tmp_path}/s")
    assert len(r.blocks) >= 3 and r.n_docs == len(ids) and r.n_tokens == sum(map(len, ids.values()))
    assert all((r.get(k) == v).all() for k, v in ids.items())
    assert all(r.get(k) is None for k in range(-4000, 31000) if k not in ids)
    assert sum(r.may_contain(k) for k in range(40000, 50000)) < 300
    assert [k for k, _ in r.scan()] == list(ids)


def test_packing(spark, odd_docs, odd_rows, no_docs):
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.packed(odd_docs, path, 1).collect()
    ids = [x + [1] for x in plain("word_bpe_49k.json", [t for _, t in odd_rows])]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    by_id = {i: x for (i, _), x in zip(odd_rows, ids, strict=True) if i not in (None, 2)}
    for i, x in by_id.items():
        at = 0
        for p in sorted((p for p in rows if p.doc_id == i), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(x))
            assert p.ids_crc32 == zlib.crc32(np.array(x[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(x)
    sequences: dict[int, list] = {}
    for p in rows:
        sequences.setdefault(p.sequence_id, []).append(p)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    assert packing.packed(no_docs, path, 1).collect() == []


def test_waiting_documents_hold_their_tails_only():
    import tracemalloc

    packer, pieces = packing._Packer(0, 2048, 256), 0
    tracemalloc.start()
    for i in range(400):
        pieces += sum(1 for _ in packer.add(i, np.full(1_020_000 + i, i, dtype=np.uint32)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pieces += sum(1 for _ in packer.finish())
    assert peak < 40 << 20 and pieces > 400 * 498


def test_pack_balances_cost():
    rng = random.Random(2)
    lengths = [rng.choice([5, 60, 300, 900, 1500]) for _ in range(4000)]
    n = sum(lengths) // 2048
    pieces, left = packing.pack(lengths, [2048] * n)
    load = np.zeros(n)
    for p in pieces:
        load[p.sequence] += packing.cost(p.length)
    assert sum(p.length for p in pieces) == n * 2048 and len(left) < 40
    naive, at = np.zeros(n + 1), 0
    for x in lengths:
        while x:
            take = min(x, 2048 - at % 2048)
            naive[at // 2048] += packing.cost(take)
            at, x = at + take, x - take
    assert load.std() < naive[:n].std()


def test_token_counts(spark, odd_docs, odd_rows, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    sums = token_counts.suffix_sums(token_counts.length_histogram(odd_docs, path))
    n = sorted(len(x) for x in plain("byte_bpe_50k.json", [t for _, t in odd_rows]))
    for r in sums.collect():
        assert r.docs == n.count(r.length)
        assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= r.length for x in n), sum(x for x in n if x >= r.length))
        assert r.truncated_tokens == sum(min(x, r.length) for x in n)
        assert (r.docs_truncated, r.tokens_lost) == (sum(x > r.length for x in n), sum(max(0, x - r.length) for x in n))
        assert abs(r["rank"] - sum(x <= r.length for x in n) / len(n)) < 1e-12
    for limit in (0, 1, 7, 100, 2048, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in n)
    assert token_counts.quantile(sums, 0.5) == n[(len(n) + 1) // 2 - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(no_docs, path)).collect() == []


def test_prose_is_fixed():
    assert prose(1, 3) == prose(1, 3) != prose(2, 3)
