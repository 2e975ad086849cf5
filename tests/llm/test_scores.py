"""Toxicity and quality scores against plain versions, and what window, automaton and loss decide."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from codeloom.llm import nbsvm, toxicity
from codeloom.llm.bytewords import written_words

from .brute import fold
from .conftest import prose

TERMS = ["moron", "stupid", "worthless", "scumbag", "crétin", "垃"]
#: Misspellings that no labelled row has.
SPELLED = ["mornn", "stvpid", "worthlless", "scumbg", "crértin", "m0ron"]
MARKS = "\u0080-©«-´¶-¹»-¿ -ⁿ　-〿＀-／：-＠［-｀｛-･"
LONE = "฀-໿က-ჿក-៿぀-鿿\U00020000-\U0002ffff"
WORD = re.compile(f"[{LONE}]|[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F{MARKS}{LONE}]+")


def buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def scores(model, texts: list[str]) -> np.ndarray:
    return toxicity.Scorer(model).scores(*buffers(texts))


def test_written_words():
    rng = random.Random(2)
    parts = ["moron", "“moron”", "垃圾", "Éa", " ", "a b", "«x»", "、", "ไทย", "ｆｕｌｌ！", "é", "x" * 600, "𠀀", "…", "1", "—", "ª", "한국어", "\n", "", "។ ខ្ម"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    w = written_words(*buffers(texts))
    raw = "".join(texts).encode()
    got = [[raw[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]


@pytest.fixture(scope="module")
def learned(spark):
    """Toxic documents name terms at people; a few clean ones quote them."""
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(900):
        w = prose(i, 40).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                term = rng.choice(TERMS)
                if len(term) > 4 and rng.random() < 0.3:
                    at = rng.randrange(2, len(term))
                    other = term[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + term[at + rng.randint(0, 1) :]
                    term = term if other in SPELLED else other
                w.insert(rng.randrange(len(w)), term)
        elif i % 30 == 1:
            at = rng.randrange(len(w))
            w[at:at] = f'then she said “the {rng.choice(TERMS)} there” and {rng.choice(["he wrote", "she called"])} it a word'.split()
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_score(model, text: str) -> float:
    """The score by comparing every word with every term, and looking at the text of each window."""
    text = fold(text)
    raw = text.encode()
    found = [(len(text[: m.start()].encode()), len(text[: m.end()].encode()), m.group()) for m in WORD.finditer(text)]
    abuse = quoted = 0.0
    seen: dict[str, float] = {}
    hits = 0
    for p, (start, end, word) in enumerate(found):
        weight = model.terms.get(word, 0.0)
        if not weight:
            for n in (6, 5, 4):
                if len(word) > n and word[:n] in model.stems:
                    weight = model.stems[word[:n]] * model.stem_share
                    break
            near = [(1, t) for t in model.terms if len(t) >= 5 and abs(len(t) - len(word)) < 2 and distance(word, t) == 1]
            if near:
                weight = max(weight, min(model.terms[min(near)[1]], model.fuzzy.get(min(near)[1], model.fuzzy_weight)))
            weight = model.forms.get(word, weight) if weight else 0.0
        if not weight:
            continue
        hits += 1
        a, b = max(0, p - 8), min(len(found), p + 9)
        before = raw[found[a][0] if a else max(0, found[0][0] - 4) : start].decode(errors="ignore")
        after = raw[end : found[b - 1][1] + 4].decode(errors="ignore")
        opened = sum(before.count(c) for c in '"“”„«»‹›') % 2 == 1
        closed = any(c in after for c in '"“”„«»‹›')
        said = any(found[i][2] in toxicity.REPORTING for i in range(a, b) if i != p)
        q = (0.7 if opened and closed else 0.0) + (0.3 if said and opened else 0.15 if said else 0.0)
        abuse += weight * (1 - q) * (0.3 if word in seen else 1)
        quoted += weight * q
        seen[word] = max(seen.get(word, weight), weight)
    x = [0.0] * 6
    if hits:
        x = [math.asinh(abuse), math.asinh(quoted), max(seen.values()), math.log1p(sum(v > 2 for v in seen.values())), abuse / hits, abuse / math.sqrt(len(found))]
    return 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, model.coef)) + model.bias))))


def test_plain_score_agrees(learned):
    rng = random.Random(7)
    bits = [*TERMS, "morron", "MORON", "stupidly", "worthles", "scumbags", '"', "“", "”", "«", "»", "said", "wrote", "x" * 400, "中文", "the", "of", "moronmoron", "", "cretin"]
    texts = [" ".join(rng.choice(bits) if rng.random() < 0.4 else prose(i * 40 + j, 1) for j in range(rng.randint(0, 40))) for i in range(300)]
    got = scores(learned, texts)
    assert np.allclose(got, [plain_score(learned, t) for t in texts], rtol=1e-9)
    assert (got >= 0.5).any() and (got < 0.5).any()


def test_window_decides(learned, monkeypatch):
    said = [f"{prose(5000 + i, 12)} and then she said “the {t} there” as he wrote it {prose(6000 + i, 12)}" for i, t in enumerate(TERMS)]
    abuse = [f"{prose(5000 + i, 12)} and then the {t} there as it was {prose(6000 + i, 12)}" for i, t in enumerate(TERMS)]
    assert (scores(learned, abuse) >= 0.5).all() and (scores(learned, said) < 0.5).all()
    monkeypatch.setattr(toxicity, "quotation", lambda *_: 0.0)
    assert (scores(learned, said) >= 0.5).all()


def test_automaton_decides(learned, monkeypatch):
    spelled = [f"{prose(7000 + i, 15)} you {t} thing {prose(8000 + i, 15)}" for i, t in enumerate(SPELLED)]
    learned.stems, stems = {}, learned.stems
    try:
        assert all(t not in learned.forms and t not in learned.terms for x in spelled for t in x.split())
        assert (scores(learned, spelled) >= 0.5).all()
        monkeypatch.setattr(toxicity.LexiconAutomaton, "match", lambda *_: None)
        assert (scores(learned, spelled) < 0.5).all()
    finally:
        learned.stems = stems


def test_no_word_is_too_long_and_no_script_hides_a_term(learned):
    plain = f"{prose(1, 20)} you moron"
    base = scores(learned, [plain])[0]
    assert base >= 0.5
    assert scores(learned, [f"{prose(1, 20)} {'中' * 100}moron"])[0] >= 0.5
    assert scores(learned, [f"{prose(1, 20)} “moron”—moron"])[0] >= scores(learned, [prose(1, 22)])[0]
    long = "q" * 300
    model = toxicity.Model({long: 5.0}, {}, coef=np.array([3.0, 0, 0, 0, 0, 0]), bias=-3.0)
    assert (scores(model, [f"a {long} b", f"a {long}s b"]) >= 0.4).all() and scores(model, ["a b"])[0] < 0.1


def test_scores_do_not_depend_on_neighbours(learned):
    texts = ["x “", "moron”", '"', "stupid thing", "”"]
    assert np.allclose(scores(learned, texts), [scores(learned, [t])[0] for t in texts])


def test_large_lexicons_are_whole(spark):
    """Each toxic document pair has words of its own: thousands of terms, all kept."""
    names = ["".join(chr(97 + (i // 26**k * 7 + k) % 26) for k in range(4)) + "zq" * (1 + i % 2) for i in range(12000)]
    names = sorted(set(names))
    docs = [(i, " ".join(names[(i // 3) * 200 : (i // 3 + 1) * 200]), 1) for i in range(3 * (len(names) // 200))]
    docs += [(10000 + i, prose(i, 30), 0) for i in range(4 * len(docs))]
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(table, table.select("doc_id", "toxic"))
    whole = {n for k in range(len(names) // 200) for n in names[k * 200 : (k + 1) * 200]}
    assert len(whole) > 4000 and whole <= set(model.terms)


def primal_dual(values: list[np.ndarray], y: np.ndarray, w: np.ndarray, b: float, cost: float) -> float:
    margins = np.array([v @ w + b for v in values]) * y
    return (w @ w + b * b) / 2 + cost * np.maximum(0, 1 - margins).sum()


def test_hinge_loss_is_minimal():
    """No step in any direction betters the primal objective; slack rows sit at the bound."""
    rng = np.random.default_rng(4)
    n, width = 60, 12
    rows = [np.sort(rng.choice(width, rng.integers(1, 6), replace=False)) for _ in range(n)]
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    value = np.zeros(nbsvm.BUCKETS)
    value[:width] = rng.normal(size=width)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    w, b = nbsvm.dual_coordinate_descent(np.concatenate(rows).astype(np.int32), bounds, value, y, cost=0.5, rounds=4000, tolerance=1e-9)
    dense = []
    for r in rows:
        v = np.zeros(width)
        v[r] = value[r] / np.sqrt(len(r))
        dense.append(v)
    best = primal_dual(dense, y, w[:width], b, 0.5)
    for _ in range(400):
        step = rng.normal(size=width + 1) * 10 ** rng.uniform(-6, 0)
        assert primal_dual(dense, y, w[:width] + step[:-1], b + step[-1], 0.5) >= best - 1e-7
    squared = (w[:width] @ w[:width] + b * b) / 2
    assert squared < best  # some rows have slack, so the loss counts


def test_ngrams_are_words_and_pairs():
    def own(text: str) -> set[int]:
        return set(nbsvm.ngram_buckets(*buffers([text]), additions=False)[0].tolist())

    rng = random.Random(3)
    texts = ["", "one", *(" ".join(rng.choice(["A", "b", "c,", "D!", "é"]) for _ in range(rng.randint(1, 8))) for _ in range(60))]
    got, at = nbsvm.ngram_buckets(*buffers(texts), additions=False)
    for i, t in enumerate(texts):
        w = fold(t).split()
        expected = set().union(*(own(x) for x in w), *(own(f"{x} {z}") for x, z in zip(w[:-1], w[1:], strict=True)))
        assert set(got[at[i] : at[i + 1]].tolist()) == expected
        assert len(expected) == len(set(w) | set(zip(w[:-1], w[1:], strict=True)))


def test_ratio_and_score_agree_with_plain():
    rng = random.Random(5)
    rows = [sorted(rng.sample(range(9), rng.randint(1, 5))) for _ in range(20)]
    y = np.array([i % 2 for i in range(20)])
    buckets, bounds = np.concatenate(rows).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = nbsvm.log_count_ratio(buckets, bounds, y)
    p = [1 + sum(f in r for r, t in zip(rows, y, strict=True) if t) for f in range(nbsvm.BUCKETS)][:9]
    q = [1 + sum(f in r for r, t in zip(rows, y, strict=True) if not t) for f in range(9)]
    rest = nbsvm.BUCKETS - 9
    for f in range(9):
        assert math.isclose(got[f], math.log(p[f] / (sum(p) + rest)) - math.log(q[f] / (sum(q) + rest)))
    model = nbsvm.train(buckets, bounds, y)
    for r, s in zip(rows, model.scores(buckets, bounds), strict=True):
        margin = sum(float(model.weight[f]) for f in r) / math.sqrt(len(r)) + model.bias
        assert math.isclose(s, 1 / (1 + math.exp(-(model.slope * margin + model.offset))), rel_tol=1e-6)


def test_sample_is_bounded_by_rows(spark):
    """An id with ten thousand rows and clashing labels counts once, and always in the same way."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(10000)] + [(i, f"other {i}") for i in range(2, 100)] + [(None, "no id"), (50, None)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, k) for i in range(1, 100) for k in (0, i % 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", 1000).collect()
    assert len(rows) == 99
    assert sorted(rows, key=str) == sorted(toxicity.labelled_sample(docs.repartition(3), labels.repartition(2), "toxic", 1000).collect(), key=str)
    assert {r.label for r in rows if r.text and r.text.startswith("text")} == {1}
    assert toxicity.labelled_sample(docs, labels, "toxic", 50).count() == 50


def test_null_ids_are_not_held_out(spark, odd_docs, tmp_path):
    from codeloom.llm.queries import QUERIES

    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op6_toxicity", "op10_nbsvm_quality"):
        rows = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(rows) == odd_docs.count()
        assert {r.held_out for r in rows if r.doc_id is None} == {False}
