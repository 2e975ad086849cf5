"""Toxicity scores: Levenshtein automata over a learned lexicon, with context windows.

Learning, from a bounded sample of labelled rows: words and word beginnings that are
far more frequent in toxic documents form the lexicon.  Its trie is intersected
with Levenshtein automata (one edit for terms of five characters or more) into one automaton, which
is made deterministic state by state as texts need it.  A word that it accepts is
an exact, a misspelled or an inflected form of a term and weighs the log-odds
of its own counts, or else of its kind.

Words are parted by script and by all punctuation, so that a term stands out of text
without spaces and between typographic quotation marks.  No word is too long or too rare to be looked up.

Each match is looked at in a window of words: quotation marks round it and words of
reporting make it a quotation, else it is abuse.  A logistic model over
the sums of both gives the score.  The size of the lexicon is bounded by the labelled sample only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from codeloom.llm.bytewords import U64, slices, text_buffers, written_words
from codeloom.llm.worker import release, resource, small_batches
from codeloom.storage import materialize, remove
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learned from at most; the ones of smallest hash of their id.
SAMPLE_ROWS = 20000
#: Log-odds and toxic documents that a term needs.
LEAST_LOG_ODDS, LEAST_DOCS = 2.0, 3
#: Terms of fewer characters must match exactly.
FUZZY_LENGTH = 5
STEMS = (4, 5, 6)
#: Words before and after a match in its context window.
WINDOW = 8
#: Words that report speech, in four languages.
REPORTING = frozenset("said says wrote writes quote quoted quoting called calls word term slur insult dit disait écrit cité mot insulte sagte sagt schrieb zitat wort dijo dice escribió cita palabra insulto".split())
_QUOTES = '"“”„«»‹›'
_SLOTS = 1 << 20
#: Members of the automaton's states that are held before it starts anew, and words and beginnings counted before they are put out.
_HELD_ITEMS, _HELD_COUNTS = 1 << 19, 1 << 17


class LexiconAutomaton:
    """Deterministic automaton of all strings within one edit of a long term, or equal to a short one."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in terms:
            node = 0
            for ch in t:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = nxt
            self.term[node] = t
        self.edited = [[2 * c + 1 for c in x.values()] for x in self.children]
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []  # members are 2 * node + edits
        self.held = 0
        self.accept: list[tuple[str, int] | None] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({0})

    def _state(self, items: set[int]) -> int:
        """Number of a set of nodes with edits; -1 for the empty set."""
        full = set(items)
        for x in items:
            if not x & 1:  # a character of the term is missing
                full.update(self.edited[x >> 1])
        full.difference_update([x + 1 for x in full if not x & 1])
        if not full:
            return -1
        key = frozenset(full)
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.states)
            self.states.append(key)
            self.held += len(key)
            ends = [(x & 1, self.term[x >> 1]) for x in key if self.term[x >> 1] is not None and (not x & 1 or len(self.term[x >> 1]) >= FUZZY_LENGTH)]
            self.accept.append(min(ends)[::-1] if ends else None)
        return got

    def _move(self, state: int, ch: str) -> int:
        out: set[int] = set()
        for x in self.states[state]:
            child = self.children[x >> 1].get(ch)
            if child is not None:
                out.add(2 * child + (x & 1))
            if not x & 1:
                out.add(x + 1)
                out.update(self.edited[x >> 1])
        return self._state(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, the first in order on ties; None beyond the allowed one."""
        if len(self.moves) > 1 << 16 or self.held > _HELD_ITEMS:
            self._reset()
        state, moves = self.start, self.moves
        for ch in word:
            nxt = moves.get((state, ch))
            if nxt is None:
                nxt = moves[state, ch] = self._move(state, ch)
            if nxt < 0:
                return None
            state = nxt
        return self.accept[state]


def log_odds(pos: float, neg: float, n_pos: int, n_neg: int) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


@dataclass
class Model:
    """Lexicon with weights, weights of single forms and of each term's rare misspellings, and the logistic model."""

    terms: dict[str, float]
    stems: dict[str, float]
    forms: dict[str, float] = field(default_factory=dict)
    fuzzy: dict[str, float] = field(default_factory=dict)
    fuzzy_weight: float = 1.0
    stem_share: float = 0.75
    coef: np.ndarray | None = None
    bias: float = -10.0


class Scorer:
    """Matches and features of documents; one per worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.automaton = LexiconAutomaton(model.terms)
        self.key = np.zeros(_SLOTS, dtype=U64)
        self.code = np.zeros(_SLOTS, dtype=np.int32)
        self.weights = [0.0]

    def weight(self, word: str) -> float:
        """Log-odds of a word as the form of a term; 0 if it is none."""
        own = self.model.terms.get(word)
        if own is not None:
            return own
        base = 0.0
        for n in reversed(STEMS):
            if len(word) > n and word[:n] in self.model.stems:
                base = self.model.stems[word[:n]] * self.model.stem_share
                break
        near = self.automaton.match(word)
        if near is not None:
            base = max(base, min(self.model.terms[near[0]], self.model.fuzzy.get(near[0], self.model.fuzzy_weight)))
        return self.model.forms.get(word, base) if base else 0.0

    def codes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Per word 0, or the index of its weight."""
        slot = (h & U64(_SLOTS - 1)).astype(np.int64)
        code = np.where(self.key[slot] == h, self.code[slot], -1)
        miss = np.flatnonzero(code < 0)
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            raw = buf.tobytes()
            new = np.zeros(len(at), dtype=np.int32)
            for n, (s, e) in enumerate(zip(start[at].tolist(), end[at].tolist(), strict=True)):
                w = self.weight(_fold(raw[s:e]))
                if w:
                    new[n] = len(self.weights)
                    self.weights.append(w)
            code[miss] = new[inverse]
            self.key[slot[at]], self.code[slot[at]] = h[at], new
        return code

    def features(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """One row of features per document."""
        w = written_words(buf, offs)
        code = self.codes(buf, w.start, w.end, w.hash)
        out = np.zeros((len(offs) - 1, 6))
        n_words = np.diff(w.first)
        hits = np.flatnonzero(code)
        doc = np.searchsorted(w.first, hits, side="right") - 1
        cut = np.searchsorted(doc, np.arange(len(offs)))
        raw = None
        for d in np.unique(doc).tolist():
            at = hits[cut[d] : cut[d + 1]]
            raw = buf.tobytes() if raw is None else raw
            seen: dict[bytes, float] = {}
            abuse = quoted = 0.0
            for p in at.tolist():
                weight = self.weights[code[p]]
                q = quotation(raw, w.start, w.end, p, int(w.first[d]), int(w.first[d + 1]), int(offs[d]), int(offs[d + 1]))
                word = _fold(raw[w.start[p] : w.end[p]])
                before = seen.get(word)
                seen[word] = max(before or -1e9, weight)
                abuse += weight * (1 - q) * (0.3 if before is not None else 1)
                quoted += weight * q
            values = list(seen.values())
            out[d] = (
                math.asinh(abuse), math.asinh(quoted), max(values),
                math.log1p(sum(v > LEAST_LOG_ODDS for v in values)), abuse / len(at),
                abuse / math.sqrt(n_words[d]),
            )
        return out

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.model.coef is None:
            return np.zeros(len(offs) - 1)
        z = self.features(buf, offs) @ self.model.coef + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fold(word: bytes) -> str:
    return word.decode("utf-8", "replace").translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def quotation(raw: bytes, start: np.ndarray, end: np.ndarray, p: int, lo: int, hi: int, begin: int, stop: int) -> float:
    """How much the window round word ``p`` of the document with words ``lo .. hi`` and bytes ``begin .. stop`` is a quotation, from 0 to 1."""
    a, b = max(lo, p - WINDOW), min(hi, p + WINDOW + 1)
    before = raw[start[a] if a > lo else max(begin, start[a] - 4) : start[p]].decode("utf-8", "ignore")
    after = raw[end[p] : min(stop, end[b - 1] + 4)].decode("utf-8", "ignore")
    opened = sum(before.count(c) for c in _QUOTES) % 2 == 1
    closed = any(c in after for c in _QUOTES)
    said = any(_fold(raw[start[i] : end[i]]) in REPORTING for i in range(a, b) if i != p)
    return (0.7 if opened and closed else 0.0) + (0.3 if said and opened else 0.15 if said else 0.0)


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to documents per word and word beginning: feature, pos, neg."""
    release()
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        pos, neg = zip(*counts.values(), strict=True)
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], names=["feature", "pos", "neg"])
        counts.clear()
        return made

    for batch in batches:
        labels = batch.column(1).to_pylist()
        buf, offs = text_buffers(batch.column(0))
        for i, j in slices(offs, 1 << 20):
            w = written_words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            raw = buf[offs[i] : offs[j]].tobytes()
            names = [_fold(raw[s:e]) for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
            for d in range(j - i):
                mine = {names[x] for x in np.unique(inverse[w.first[d] : w.first[d + 1]]).tolist()}
                mine |= {f"{x[:n]}*" for x in mine for n in STEMS if len(x) > n}
                side = 0 if labels[i + d] else 1
                for x in mine:
                    got = counts.get(x)
                    if got is None:
                        got = counts[x] = [0, 0]
                    got[side] += 1
            if len(counts) > _HELD_COUNTS:
                yield out()
    if counts:
        yield out()
    del counts
    release()


def _feature_batches(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model.value)
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for i, j in slices(offs):
                x = scorer.features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(i, j - i)], names=["x", "label"])

    return run


def _form_batches(model):
    """Counted words that only match inexactly: feature, pos, neg, and the term next to those that begin with no stem."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = model.value
        automaton = LexiconAutomaton(m.terms)
        for batch in batches:
            keep, terms = [], []
            for n, x in enumerate(batch.column(0).to_pylist()):
                if x not in m.terms:
                    stem = any(len(x) > k and x[:k] in m.stems for k in STEMS)
                    near = None if stem else automaton.match(x)
                    if stem or near is not None:
                        keep.append(n)
                        terms.append(near and near[0])
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(terms, pa.string())], names=["feature", "pos", "neg", "term"])

    return run


def _scorer(model: Model) -> Scorer:
    return resource(("scorer", id(model)), lambda: Scorer(model))  # the scorer holds the model, so its id stays its own


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method, on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    coef = w[:-1] / scale
    return coef, float(w[-1] - coef @ mean)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``text, label`` of at most ``rows`` labelled documents: those whose ids have the smallest hashes.

    Of several labels of an id the largest counts.  Of several rows of an id one is taken, by the hash of its text, so
    the bound holds for rows, however often an id repeats.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    picked = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    one = found.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"), F.first("__label").alias("label"))
    return one.select("first.text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` rows of ``labels(doc_id, label)``.

    Rows with a null id or label are left out; of labels of one id the largest
    counts, and of rows of one id one.  If the sample lacks either class, the model scores every text 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample, sample_path = materialize(labelled_sample(docs, labels, label, sample_rows), "toxic-sample")
    sizes = {bool(r.label): r.n for r in sample.groupBy((F.col("label") > 0).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_neg:
        remove(spark, sample_path)
        return Model({}, {})
    binary = sample.select("text", (F.col("label") > 0).cast("int").alias("label"))
    counts, counts_path = materialize(binary.mapInArrow(_count_batches, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-words")
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    # terms are in at least LEAST_DOCS of the sample's documents, so the sample bounds what is collected here
    top = counts.filter(F.col("pos") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_LOG_ODDS).collect()
    model = Model({r.feature: r.odds for r in top if not r.feature.endswith("*")}, {r.feature[:-1]: r.odds for r in top if r.feature.endswith("*") and r.pos >= 3 * LEAST_DOCS and r.odds >= 1.5 * LEAST_LOG_ODDS})
    sc = spark.sparkContext
    shared = sc.broadcast(model)
    forms = counts.filter(~F.col("feature").endswith("*")).mapInArrow(_form_batches(shared), "feature string, pos long, neg long, term string")
    rare = F.col("pos") + F.col("neg") < LEAST_DOCS  # too rare for a weight of their own: together, by term
    rows = forms.groupBy(F.when(rare, F.col("term")).alias("term"), F.when(~rare, F.col("feature")).alias("feature")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    for r in rows:
        if r.feature is not None:
            model.forms[r.feature] = log_odds(r.pos, r.neg, n_pos, n_neg)
        elif r.term is not None and r.pos + r.neg >= LEAST_DOCS:
            model.fuzzy[r.term] = log_odds(r.pos, r.neg, n_pos, n_neg)
    few = [r for r in rows if r.feature is None and r.term is not None]
    if few:
        model.fuzzy_weight = max(0.5, log_odds(sum(r.pos for r in few), sum(r.neg for r in few), n_pos, n_neg))
    shared = sc.broadcast(model)
    points = binary.mapInArrow(_feature_batches(shared), "x array<double>, label int").toLocalIterator()
    x, y = zip(*((r.x, r.label) for r in points), strict=True)
    model.coef, model.bias = fit_logistic(np.array(x), np.array(y, dtype=float))
    remove(spark, counts_path, sample_path)
    return model


def _score_batches(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model.value)
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for i, j in slices(offs):
                s = scorer.scores(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``.

    A null or empty text, and one without matches, gets the score of no match.
    Repeated rows give their row each; a null id is passed on.  Other
    columns are not read.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean_batches(model, column: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model.value)
        for batch in batches:
            buf, offs = text_buffers(batch.column(column))
            for i, j in slices(offs):
                s = scorer.scores(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield batch.slice(i, j - i).filter(pa.array(s < 0.5))

    return run


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_clean_batches(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")), docs.schema)


def fold(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string")) % parts
