"""Fill-in-the-middle against a plain version, the index of texts, and Elias-Fano lists."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from codeloom.llm import elias_fano, fill_middle
from codeloom.llm.fill_middle import distinct_texts, fill_in_middle, restored
from pyspark.sql import functions as F


def plain(doc_id, text, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def key(row):
    return tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in row)


@pytest.mark.parametrize("seed", range(40))
def test_lists(seed):
    rng = np.random.default_rng(seed)
    universe = int(rng.integers(1, 10 ** rng.integers(1, 9)))
    values = np.sort(rng.integers(0, universe + 1, rng.integers(0, 3000)))
    data = elias_fano.encode(values, universe)
    assert elias_fano.size(data) == len(values)
    for k in range(0, len(values), max(1, len(values) // 50)):
        assert elias_fano.select(data, k) == values[k]
    with pytest.raises(IndexError):
        elias_fano.select(data, len(values))


def test_lists_are_small():
    ends = np.arange(80, 80 * 10001, 80)
    assert len(elias_fano.encode(ends, int(ends[-1]))) < 10000 * (2 + np.log2(80) + 1) / 8


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = fill_in_middle(odd_docs).collect()
    assert sorted(map(key, got)) == sorted(key(plain(i, t)) for i, t in odd_rows)
    assert fill_in_middle(no_docs).collect() == []
    assert fill_in_middle(odd_docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


@pytest.fixture(scope="module")
def lined():
    """Texts of lines, with signs, long texts, copies, one text with a third of the rows, and ids that repeat."""
    rng = random.Random(5)
    parts = ["a line", "", "é中\U0001f600", "\r", "x" * 300, "<P", "S>", "<", "\n", "\n", "\n", "word word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [t + sign + "\nend" for t in texts[:6] for sign in ("<P>", "<S>", "<M>")] + ["\n" * 500, "y" * 100000 + "\n" * 3000 + "z"]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(i, "hot\ntext\nof\nall") for i in range(400, 600)]
    return rows + rows[:20] + [(None, texts[3]), (7, None)]


@pytest.mark.parametrize(("fim", "spm"), [(100, 50), (60, 0), (0, 50), (90, 100)])
def test_lines(spark, lined, fim, spm):
    docs = spark.createDataFrame(lined, "doc_id long, text string").repartition(5)
    made = fill_in_middle(docs, fim_percent=fim, spm_percent=spm)
    rows = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(key(r[:6]) for r in rows) == sorted(key(plain(i, t, fim, spm)) for i, t in lined)
    texts = sorted((t or "") for _, t in lined)
    assert sorted(r.back for r in rows) == texts


def test_each_text_is_listed_once(spark, lined):
    rows = spark.createDataFrame([(hashlib.sha256((t or "").encode()).hexdigest(), t or "") for _, t in lined], "digest string, body string").repartition(6)
    index = distinct_texts(rows, salts=3).collect()
    assert sorted(r.body for r in index) == sorted({t or "" for _, t in lined})
    assert sum(r.rows for r in index) == len(lined)
    for r in index:
        ends = [m.end() for m in re.finditer(rb"[^\n]*\n|[^\n]+", r.body.encode())]
        assert [elias_fano.select(bytes(r.ends), k) for k in range(elias_fano.size(bytes(r.ends)))] == ends


def test_equal_digests_do_not_mix_texts(spark, lined, monkeypatch):
    """With digests that say little, rows of a digest with several texts keep their own."""

    class Blind:
        def __getattr__(self, name):
            return getattr(F, name)

        def sha2(self, col, bits):
            return F.substring(F.sha2(col, bits), 1, 1) if isinstance(col, str) else F.sha2(col, bits)

    docs = spark.createDataFrame([*lined, (900, "only one")], "doc_id long, text string")
    monkeypatch.setattr(fill_middle, "F", Blind())
    got = fill_in_middle(docs).collect()
    assert sorted(map(key, got)) == sorted(key(plain(i, t)) for i, t in [*lined, (900, "only one")])
