"""License scans as an exact set-similarity join of text blocks with templates.

A text block is a run of ``BLOCK`` words, and blocks begin every ``STRIDE`` words, so that
any ``STRIDE`` consecutive words lie in one block; with a template of more words, it sets the stride, and blocks are twice as long.
A block matches a template if it contains
at least the template's threshold of its distinct tokens.  The join finds every such block, is exact and uses

* one global order of the templates' tokens, the rarest over all documents first;
* the prefix filter: of ``n`` tokens with ``need`` required, a match has one of the first ``n - need + 1``;
* the length filter: a block has at least ``need`` tokens of the vocabulary;
* the positional filter: tokens before the first common one are missing, those after it bound the overlap.

The templates are few and fixed, so the vocabulary goes to the workers and no
text is shuffled; only token counts are.  All blocks that match are reported.  For the *labels* an exact check of places follows: each template names a
key, the words that tell its license from others, which must stand in the block one after
another, as licenses share most of their words.  A phrase is a template that needs all its tokens and is its own key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from codeloom.llm.bytewords import ALNUM, hash_words, slices, text_buffers, words
from codeloom.llm.worker import small_batches
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, STRIDE = 64, 32
THRESHOLD = 0.8
#: Phrases whose consecutive places are counted, and their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Labels and words of licenses in common use; the key; the threshold where it is not the common one.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0", 1.0),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0", 1.0),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0", 1.0),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd 4 0", 1.0),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0", 1.0),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


@dataclass
class Plan:
    """Templates over one vocabulary; tokens are numbered in the global order."""

    hashes: np.ndarray  # sorted hashes of the vocabulary
    number: np.ndarray  # token number of each of them
    labels: list[str]
    tokens: list[list[int]]  # distinct tokens of each template, rarest first
    need: list[int]
    key: list[list[int]]  # the tokens that must stand as they do here
    prefix: dict[int, list[tuple[int, int]]]  # token -> (template, its place in the template)
    phrases: int  # so many of the templates are phrases
    stride: int = STRIDE
    block: int = BLOCK

    def number_of(self, h: np.ndarray) -> np.ndarray:
        """Token number of each word hash, -1 outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], -1)


def vocabulary(templates: Sequence[tuple]) -> list[str]:
    return sorted({t for x in templates for part in x[1:3] if isinstance(part, str) for t in part.split()})


def make_plan(templates: Sequence[tuple], phrases: Sequence[tuple[str, str]], threshold: float, frequency: dict[str, int]) -> Plan:
    every = [*phrases, *templates]
    terms = vocabulary(every)
    order = {t: n for n, t in enumerate(sorted(terms, key=lambda t: (frequency.get(t, 0), t)))}
    h = hash_words(terms, ALNUM)
    by_hash = np.argsort(h)
    plan = Plan(h[by_hash], np.array([order[terms[i]] for i in by_hash]), [], [], [], [], {}, len(phrases))
    longest = max(len(text.split()) for _, text, *_ in every)
    if longest > STRIDE:
        plan.stride, plan.block = longest, 2 * longest
    for k, (label, text, *rest) in enumerate(every):
        key, *own = rest or [text, 1.0]
        tokens = sorted({order[t] for t in text.split()})
        need = math.ceil((own[0] if own else threshold) * len(tokens) - 1e-9)
        plan.labels.append(label)
        plan.tokens.append(tokens)
        plan.need.append(need)
        plan.key.append([order[t] for t in key.split()])
        for place, t in enumerate(tokens[: len(tokens) - need + 1]):
            plan.prefix.setdefault(t, []).append((k, place))
    return plan


def matches(plan: Plan, number: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, int, float]]:
    """Matches of the document with words ``lo .. hi``: template, block's first and last word + 1, containment."""
    probe = [p for p in np.flatnonzero(number[lo:hi] >= 0).tolist() if int(number[lo + p]) in plan.prefix]
    starts = sorted({s for p in probe for s in range(max(0, (p - plan.block) // plan.stride * plan.stride), p + 1, plan.stride) if s <= p < s + plan.block and (s == 0 or s + plan.stride < hi - lo)})
    for s in starts:
        block = number[lo + s : min(hi, lo + s + plan.block)]
        have = sorted(set(block[block >= 0].tolist()))
        present = set(have)
        tried: set[int] = set()
        for rank, t in enumerate(have):
            for k, place in plan.prefix.get(t, ()):
                need = plan.need[k]
                if k in tried or len(have) < need:
                    continue
                tried.add(k)  # t is the template's first common token, as both go in the global order
                if 1 + min(len(plan.tokens[k]) - place - 1, len(have) - rank - 1) < need:
                    continue
                common = sum(x in present for x in plan.tokens[k])
                if common >= need:
                    yield k, lo + s, lo + s + len(block), common / len(plan.tokens[k])


def places(sequence: list[int], number: np.ndarray, lo: int, hi: int) -> list[int]:
    """Words at which ``sequence`` stands, within ``lo .. hi``."""
    n = len(sequence)
    if hi - lo < n:
        return []
    ok = np.ones(hi - lo - n + 1, dtype=bool)
    for k, t in enumerate(sequence):
        ok &= number[lo + k : hi - n + 1 + k] == t
    return (np.flatnonzero(ok) + lo).tolist()


def _count_batches(terms: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hash_words(terms, ALNUM)
        order = np.argsort(h)
        known = h[order]
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for i, j in slices(offs):
                w = words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM)
                at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                hit = known[at] == w.hash
                pairs = np.unique(w.doc[hit] * len(terms) + order[at[hit]])
                total += np.bincount(pairs % len(terms), minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(total)], names=["term", "docs"])

    return run


def token_frequency(docs: DataFrame, terms: list[str]) -> dict[str, int]:
    """Documents that have each term, over all of ``docs``."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_batches(terms), "term string, docs long")
    return {r.term: r.docs for r in rows.groupBy("term").agg(F.sum("docs").alias("docs")).collect()}


def _scan_batches(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for i, j in slices(offs):
                w = words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM)
                number = plan.number_of(w.hash)
                count = np.concatenate([[0], np.cumsum(np.isin(number, list(plan.prefix)))])
                busy = set(np.flatnonzero(count[w.first[1:]] > count[w.first[:-1]]).tolist())
                rows = [_summary(plan, number, int(w.first[d]), int(w.first[d + 1])) if d in busy else (0, None, None, "", "", 0.0, 0, 0, "", 0.0) for d in range(j - i)]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(w.first), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks", "n_matched", "best_label", "best_share"],
                )

    return run


def _summary(plan: Plan, number: np.ndarray, lo: int, hi: int) -> tuple:
    """Columns of one document after its number of words."""
    base: set[tuple[int, int]] = set()
    labels: set[str] = set()
    blocks: set[int] = set()
    matched: set[int] = set()
    score, best = 0.0, (0.0, "")
    for k, a, b, share in matches(plan, number, lo, hi):
        matched.add(a)
        best = min(best, (-share, plan.labels[k]))
        found = places(plan.key[k], number, a, b)
        if not found:
            continue
        if k < plan.phrases:
            base.update((k, p - lo) for p in found)
        labels.add(plan.labels[k])
        blocks.add(a)
        score = max(score, share)
    starts = [p for _, p in base]
    names = sorted({plan.labels[k] for k, _ in base})
    return len(base), min(starts, default=None), max(starts, default=None), ",".join(names), ",".join(sorted(labels)), score, len(blocks), len(matched), best[1], -best[0]


def scan_licenses(docs: DataFrame, templates: Sequence[tuple] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """What licenses each document names.

    Returns per row of ``docs``: ``doc_id, n_words, n_base`` (places of phrases), ``first_word,
    last_word`` (their smallest and largest start, words from 0, null without any),
    ``base_labels, labels`` (of phrases; of phrases and templates; sorted, comma-joined),
    ``score`` (the largest containment of a labelled match, 0 without any), ``n_blocks`` with a labelled match,
    ``n_matched`` blocks that reach the threshold of a template, with its key or without, and ``best_label, best_share``
    of the template that some block contains most of (the first label on ties; empty and 0 without a match).

    A null or empty text has no words and no match.  Repeated rows give their row each; a null
    id is passed on.  Other columns are not read.  An empty table gives no rows.
    Templates may have any length.
    """
    small_batches(docs.sparkSession)
    terms = vocabulary([*templates, *phrases])
    plan = make_plan(templates, phrases, threshold, token_frequency(docs, terms))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long, n_matched long, best_label string, best_share double"
    return rows.mapInArrow(_scan_batches(docs.sparkSession.sparkContext.broadcast(plan)), schema)
