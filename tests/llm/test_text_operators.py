"""HTML text, license scans, decontamination, toxicity, quality and the pipeline."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from codeloom.llm import decontaminate, license_scan, nbsvm, toxicity
from codeloom.llm.fm_index import FMIndex, WaveletMatrix, suffix_array
from codeloom.llm.html_text import extract_main_text, main_text

from .brute import ALNUM, fold, hits, near_classes, windows
from .conftest import prose

A = "The first paragraph of the article has a fair number of words in it."
B = "The second one, too, goes on for a while &amp; ends with a&nbsp;<b>bold</b> word."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"),
        (page(f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{A}</p><p>{B}</p></article><footer>foot</footer>"), f"Head\n{A}\nThe second one, too, goes on for a while & ends with a bold word."),
        (page(f"<div id='cookie-bar'><p>We use cookies, and say so at length, here and there.</p></div><div class=main><p>{A}</p><p>{A}</p></div><div class='comments'><p>I liked it a lot, this text is great.</p></div>"), f"{A}\n{A}"),
        (page(f"<div class='sidebar'><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div><section><p>{A}</p></section><section><p>{A}</p><ul><li>x one<li>y two</ul></section></div><form>Name <input></form>"), f"{A}\n{A}\nx one\ny two"),
        (page(f"<article><p><b>{A}<br><p>{A}</p></article><aside>{A}</aside>"), f"{A}\n{A}"),
        (page(f"<header><h1>Site</h1></header><div class='siteHeader'>x</div><main><div class='article-header'><h1>Head</h1></div><div class='text'><p>{A}</p><p>{A}</p></div></main><div role='complementary'><p>{A}</p></div><section id='commentlist'><p>{A}</p></section><div class='newsletter-signup'>Join us</div><ul><li><a href=a>More</a></li><li><a href=b>Even more</a></li></ul>"), f"Head\n{A}\n{A}"),
        (page(f"<div><a href=a>Home</a> <a href=b>News</a> <a href=c>About us</a></div><div><div><p>{A}</p><p>{A}</p><table><tr><td>cell one</td><td>cell two</td></tr></table></div></div>"), f"{A}\n{A}\ncell one\ncell two"),
        ("<div>" * 20000 + "deep", "deep"), ("a < b and c", "a < b and c"), ("<!-- never closed", ""), ("<p title='a>b'>in</p>", "in"), ("<script>x", ""),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_extract_pages(spark):
    rows = [(1, "u", page(f"<article><p>{A}</p></article>"), "x"), (1, "u", None, "x"), (None, None, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", A, len(A)), (1, "u", "", 0), (None, None, "", 0)], key=str)
    assert extract_main_text(df.limit(0)).collect() == []


def license_rows():
    rng = random.Random(8)
    parts = ["All rights reserved.", "cc-BY", "GNU General\nPublic License", "CC BY-NC 4.0", "rights all reserved", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "all rights", "reserved"]
    return [(i, " ".join(rng.choice(parts) if rng.random() < 0.2 else prose(i * 50 + j, 3) for j in range(rng.randint(0, 80)))) for i in range(60)]


def test_license_scan(spark, odd_docs, odd_rows, no_docs):
    rows = license_rows() + odd_rows
    got = license_scan.scan_licenses(spark.createDataFrame(license_rows(), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text")))
    expected = []
    for i, t in rows:
        w = ALNUM.findall(fold(t))
        at = [(k, label) for label, p in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels, score = {x for _, x in at}, 1.0 if at else 0.0
        blocks = [w[s : s + 64] for s in range(0, max(1, len(w)), 32) if s == 0 or s + 32 < len(w)]
        for label, text, key, *own in license_scan.TEMPLATES:
            tokens, k = set(text.split()), key.split()
            best = max((len(tokens & set(b)) / len(tokens) for b in blocks if any(b[n : n + len(k)] == k for n in range(len(b)))), default=0)
            if best >= (own[0] if own else 0.8) - 1e-9:
                labels.add(label)
                score = max(score, best)
        expected.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), round(score, 9)))
    assert sorted(((*r[:7], round(r[7], 9)) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert any("apache-2.0" in e[6] for e in expected) and any("mit" in e[6] for e in expected)
    assert license_scan.scan_licenses(no_docs).collect() == []


def labels_of(spark, texts: list[str]) -> list[str]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return [r.labels for r in license_scan.scan_licenses(rows).orderBy("doc_id").collect()]


def test_licenses_are_told_apart(spark):
    probes = {
        "The album was released under the label after the driver's license": "",
        "released under the Apache license": "",
        "She studied at MIT under the dean, and got a license": "",
        "GNU General Public License version 2": "gpl",
        "licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "gpl,lgpl",
        "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation": "",
        "licensed under the Apache License, Version 2.0": "apache-2.0",
        "is made available under the MIT license": "mit",
        "was released under the terms of the MIT license": "mit",
    }
    assert labels_of(spark, list(probes)) == list(probes.values())
    texts = [t for _, t, *_ in license_scan.TEMPLATES]
    for (label, text, *_), got in zip(license_scan.TEMPLATES, labels_of(spark, texts), strict=True):
        base = {x for x, p in license_scan.PHRASES if f" {p} " in f" {text} "}
        assert set(got.split(",")) == {label} | base, text
    # each license with one word put in place of each word of its key
    changed = [(label, " ".join("other" if x == w else x for x in t.split())) for label, t, key, *_ in license_scan.TEMPLATES for w in key.split()]
    for (label, text), got in zip(changed, labels_of(spark, [t for _, t in changed]), strict=True):
        assert label not in set(got.split(",")) - {x for x, p in license_scan.PHRASES if f" {p} " in f" {text} "}, text


@pytest.mark.parametrize("longest", [0, 45])
def test_every_block_that_matches_is_reported(spark, longest):
    """With a key or without, and with templates longer than the stride."""
    templates = list(license_scan.TEMPLATES) + ([("long", prose(1, longest), "no such key")] if longest else [])
    stride = max(32, longest)
    rng = random.Random(3)
    parts = [t.rsplit(" ", 1)[0] for _, t, *_ in templates] + [t for _, t, *_ in templates]
    rows = [(i, " ".join(rng.choice(parts) if rng.random() < 0.3 else prose(i * 90 + j, 5) for j in range(rng.randint(0, 30)))) for i in range(80)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    every = [(label, text, text, 1.0) for label, text in license_scan.PHRASES] + templates
    for i, t in rows:
        w = ALNUM.findall(fold(t))
        blocks = [w[s : s + 2 * stride] for s in range(0, max(1, len(w)), stride) if s == 0 or s + stride < len(w)]
        shares = [[(len(set(text.split()) & set(b)) / len(set(text.split())), label) for label, text, _, *own in every if len(set(text.split()) & set(b)) / len(set(text.split())) >= (own[0] if own else 0.8) - 1e-9] for b in blocks]
        best = min(((-x, label) for found in shares for x, label in found), default=(0.0, ""))
        assert (got[i].n_matched, got[i].best_label, round(got[i].best_share, 9)) == (sum(map(bool, shares)), best[1], round(-best[0], 9))
        assert got[i].n_blocks <= got[i].n_matched
    assert sum(r.n_blocks < r.n_matched for r in got.values()) >= 5
    assert not longest or any(r.best_label == "long" for r in got.values())


def test_named_relatives_of_the_gpl(spark):
    probes = {
        "Licensed under the GNU Lesser General Public License version 3": "gpl,lgpl",
        "Licensed under the GNU Affero General Public License version 3": "agpl-3.0",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "made available under the terms of the Eclipse Public License 2.0": "epl-2.0",
    }
    assert [set(x.split(",")) - {"gpl"} for x in labels_of(spark, list(probes))] == [set(x.split(",")) - {"gpl"} for x in probes.values()]


def test_fm_index():
    rng = np.random.default_rng(1)
    for trial in range(40):
        runs = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(rng.integers(1, 8))] * (1 + trial % 3)
        text = np.concatenate([[0], *(np.append(r, 0) for r in runs)])
        index = FMIndex(text, 5)
        for m in (1, 2, 4):
            patterns = rng.integers(1, 6, (20, m))
            for p, lo, hi in zip(patterns, *index.search(patterns), strict=True):
                assert sorted(index.locate(np.arange(lo, hi)).tolist()) == [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]
    s = rng.integers(0, 9, 200)
    assert suffix_array(s).tolist() == sorted(range(200), key=lambda i: s[i:].tolist())
    w = WaveletMatrix(s, 4)
    assert [int(w.rank(np.array([c]), np.array([i]))[0]) for c in range(9) for i in (0, 50, 200)] == [int((s[:i] == c).sum()) for c in range(9) for i in (0, 50, 200)]


def leak_tables(spark, odd_rows):
    items = [("7", prose(70, 30)), ("10", prose(71, 9)), ("8", None), ("9", "..."), ("11", prose(70, 12)), (None, prose(72, 12)), ("12", "solo")]
    rng = random.Random(3)
    docs = []
    for i in range(40):
        w = prose(100 + i, rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 3)):
            src = rng.choice([x for _, x in items if x]).split()
            a = rng.randrange(len(src))
            at = rng.randint(0, len(w))
            w[at:at] = src[a : a + rng.randint(1, 20)]
        docs.append((i, "\n- ".join(w).upper() if i % 2 else ", ".join(w)))
    docs += odd_rows
    return items, docs, spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", odd_column()), spark.createDataFrame(items, "item_id string, text string")


def odd_column():
    from pyspark.sql import functions as F

    return F.lit("x")


def test_contamination(spark, odd_rows, odd_docs, no_docs):
    items, docs, table, benchmark = leak_tables(spark, odd_rows)
    found = windows([(n, t) for n, t in items if n is not None])
    expected = []
    for i, t in docs:
        w, hit, own = hits(t, found)
        expected.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    for block in (1 << 20, 200):  # also in several blocks of items
        assert sorted(map(tuple, decontaminate.contamination(table, benchmark, block_bytes=block).collect()), key=str) == sorted(expected, key=str)
    assert any(e[5] for e in expected) and not all(e[5] for e in expected)
    for block in (1 << 20, 200):
        clean = decontaminate.remove_contamination(table, benchmark, block_bytes=block)
        assert clean.columns == table.columns
        texts = {(r.doc_id, r.text) for r in clean.collect()}
        assert all(not hits(t, found)[1] for _, t in texts)
        assert {(i, t) for (i, t), e in zip(docs, expected, strict=True) if not e[5]} <= texts
    assert decontaminate.contamination(no_docs, benchmark).collect() == []
    assert len(decontaminate.contamination(odd_docs, benchmark).collect()) == odd_docs.count()
    assert decontaminate.remove_contamination(odd_docs, benchmark).columns == odd_docs.columns
    assert {r.n_hit for r in decontaminate.contamination(table, benchmark.limit(0)).collect()} == {0}


def test_one_block_at_a_time(spark, monkeypatch):
    """Phrases of a benchmark in several blocks lie in files; a worker drops each before it reads the next."""
    import gc
    import weakref

    items = [(f"i{i}", prose(5000 + i, 60)) for i in range(30)]
    blocks = decontaminate._blocks(spark.createDataFrame(items, "item_id string, text string"), 10, 2000)
    assert blocks.one is None and len(blocks.files) > 3
    alive = []
    for ph in blocks:
        gc.collect()
        assert not [r for r in alive if r() is not None]
        alive.append(weakref.ref(ph))
        names = ph.items
        del ph
    assert len(alive) == len(blocks.files) and names


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_accepts_one_edit():
    terms = ["moron", "scum", "stupid", "stupor", "café", "loser"]
    automaton = toxicity.LexiconAutomaton(terms)
    rng = random.Random(6)
    tried = set(terms)
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "é"])
            tried.add("".join(w))
    for w in tried:
        best = min((distance(w, t), t) for t in terms if distance(w, t) == 0 or distance(w, t) == 1 and len(t) >= toxicity.FUZZY_LENGTH) if any(distance(w, t) <= (len(t) >= toxicity.FUZZY_LENGTH) for t in terms) else None
        got = automaton.match(w)
        assert (got is None) == (best is None) and (got is None or got[1] == best[0])


def labelled(n: int = 400):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(n):
        w = prose(i, 40).split()
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["moron", "stupid", "worthless", "scumbag"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if i % 3 == 0 else 1, int(bad)))
    return docs, labels


def test_toxicity(spark, odd_docs, no_docs):
    docs, labels = labelled()
    extra = [(1000, "you worthles morron, you stupid thing"), (1001, 'he said the word "stupid" was in the quote "moron" she wrote'), (1002, None), (1003, "")]
    table = spark.createDataFrame(docs + extra, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, marks)
    got = {r.doc_id: r for r in toxicity.toxicity(table, model).collect()}
    assert all(got[i].predicted == t for i, _, t in labels)
    assert got[1000].score > got[1001].score and got[1000].predicted == 1
    assert got[1002].predicted == got[1003].predicted == 0 and 0 <= got[1002].score <= 1
    assert len(toxicity.toxicity(odd_docs, model).collect()) == odd_docs.count()
    assert toxicity.drop_toxic(odd_docs, model).columns == odd_docs.columns
    assert toxicity.drop_toxic(table, model).count() == sum(1 - t for _, _, t in labels) + sum(1 - got[i].predicted for i in range(1000, 1004))
    assert toxicity.toxicity(no_docs, model).collect() == []
    assert {r.predicted for r in toxicity.toxicity(table, toxicity.fit(table, marks.limit(0))).collect()} == {0}


def test_quotation_window():
    from codeloom.llm.bytewords import ALNUM as SPEC
    from codeloom.llm.bytewords import words

    def share(text: str, word: str) -> float:
        raw = text.encode()
        w = words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), SPEC)
        p = [raw[s:e] for s, e in zip(w.start, w.end, strict=True)].index(word.encode())
        return toxicity.quotation(raw, w.start, w.end, p, 0, len(w.start), 0, len(raw))

    assert share('she said "you moron" to him', "moron") == 1.0
    assert share("you are a moron and that is it", "moron") == 0
    assert 0 < share("the term moron is old", "moron") < share('a "moron" there', "moron")


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        w = prose(i, rng.randint(20, 60)).split()
        text = " ".join(w) + "." if good else rng.choice([" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 30 + w[:5])])
        docs.append((i, text))
        labels.append((i, int(good)))
    table, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = nbsvm.fit(table, marks.filter("doc_id < 200"))
    got = {r.doc_id: r for r in nbsvm.quality(table, model).collect()}
    held = [i for i in range(200, 300)]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert len(nbsvm.quality(odd_docs, model).collect()) == odd_docs.count()
    assert nbsvm.quality(no_docs, model).collect() == []
    assert len({r.score for r in nbsvm.quality(table, nbsvm.fit(table, marks.limit(0))).collect()}) == 1


def test_dual_coordinate_descent_separates():
    buckets = np.array([0, 1, 0, 2, 3, 4, 3, 5], dtype=np.int32)
    bounds = np.array([0, 2, 4, 6, 8])
    y = np.array([1.0, 1.0, -1.0, -1.0])
    w, b = nbsvm.dual_coordinate_descent(buckets, bounds, np.ones(nbsvm.BUCKETS), y)
    margins = [w[buckets[bounds[i] : bounds[i + 1]]].sum() / np.sqrt(2) + b for i in range(4)]
    assert all(m * t > 0 for m, t in zip(margins, y, strict=True))


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version, on the rows that the stage before it kept."""
    import corpus_pipeline

    docs, labels = labelled(200)
    rng = random.Random(4)
    benchmark = [(1, prose(900, 25)), (2, prose(901, 12))]
    docs += [(500 + i, docs[i][1].upper()) for i in range(0, 40, 3)]
    for i in range(20):
        w = prose(600 + i, 60).split()
        docs.append((600 + i, " ".join(w)))
        w[rng.randrange(60)] = "changed"
        docs.append((700 + i, " ".join(w)))
        docs.append((800 + i, f"{prose(800 + i, 30)} {rng.choice(benchmark)[1]} {prose(820 + i, 10)}"))
    docs += [(900, None), (901, ""), (902, benchmark[0][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{n}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{n}")
        if name != "packing":
            assert now.columns == columns
            seen[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in now.collect()})
    toxic = {i for i, _, t in labels if t}
    before, after = seen["toxicity"]
    gone = set(before) - set(after)
    assert all(i in toxic or i - 500 in toxic and 500 <= i < 600 for i in gone)  # clean documents stay
    assert len(toxic - gone) <= 3
    before, after = seen["exact_dedup"]
    best: dict[str, int] = {}
    for i, t in before.items():
        best[fold(t)] = max(i, best.get(fold(t), i))
    assert set(after) == set(best.values())
    before, after = seen["minhash_near_dedup"]
    assert set(after) == {i for i, c in near_classes(list(before.items())).items() if i == c}
    before, after = seen["decontamination"]
    found = windows([(str(i), t) for i, t in benchmark])
    assert set(before) - set(after) == ({902} & set(before))
    assert all(not hits(t, found)[1] for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not hits(t, found)[1])
    pieces = now.collect()
    assert {p.doc_id for p in pieces} == set(after)
    for i in after:
        assert sum(p.length for p in pieces if p.doc_id == i) == {p.doc_tokens for p in pieces if p.doc_id == i}.pop()
    assert sum(p.length for p in pieces) == sum(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_pipeline_of_odd_tables(spark, tmp_path, odd_docs, no_docs):
    """Null and repeated ids, null texts and clashing columns pass every stage; an empty table gives nothing."""
    import corpus_pipeline
    from codeloom import storage
    from pyspark.sql import functions as F

    clash = odd_docs.withColumns({"__before": F.col("doc_id") * 10, "__keep": F.lit("k"), "maybe": F.lit(True), "c0": F.lit(1)})
    for name, table in (("some", clash), ("none", no_docs)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, prose(2, 20)), (2, None), (None, "word")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, f"{tmp_path}/some")
        assert out.columns == clash.columns
        out.write.parquet(f"{tmp_path}/stage{n}")
        now = spark.read.parquet(f"{tmp_path}/stage{n}")
        assert all(r["__before"] == (None if r.doc_id is None else 10 * r.doc_id) for r in now.collect())
    rows = now.collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and {3, 9, 10, 11, 12, 14, -5} <= set(ids)
    assert not {None, 1, 2, 4} & set(ids)  # equal to 3, but for 4, which is near it
    before = set(storage._MADE)
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} == set(ids)
    assert len(set(storage._MADE) - before) <= 1  # the table that the last stage reads
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
