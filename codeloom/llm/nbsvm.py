"""Quality scores by Naive Bayes support vectors (Wang and Manning, 2012).

A document is the set of its n-grams: words and word pairs.  Additions to the
method, which ``additions=False`` leaves out: one to three *shapes* in a row.  A shape says how a word is written: case, digits, length
class, the sign it ends in, whether it repeats the word before; shapes also
count in classes of their share of the text, and the text's length is a class.  N-grams are hashed into a fixed number of
buckets; an indicator per bucket is scaled by the bucket's log-count ratio
between the classes, and a linear hinge-loss model over them is fitted by dual
coordinate descent (Hsieh et al., 2008).  Ratio and weight fold into one number
per bucket, so that scoring is a sum over a document's distinct buckets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from codeloom.llm.bytewords import U64, VISIBLE, Words, mix, seeds, slices, text_buffers, words
from codeloom.llm.toxicity import fit_logistic, labelled_sample
from codeloom.llm.worker import small_batches
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learned from at most; the ones of smallest hash of their id.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 20
#: Share of the support vector weights against their mean size (the paper's interpolation).
BETA = 0.25
COST = 1.0
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 sign, 1 lower, 2 upper, 3 digit, 4 not ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def _shapes(buf: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for how each word is written, and whether it repeats the word before."""
    s, e = w.start, w.end
    size = e - s
    kind = _CLASS[buf]
    count = np.zeros((5, len(buf) + 1), dtype=np.int32)
    for c in range(5):
        np.cumsum(kind == c, out=count[c, 1:])
    has = [count[c, e] - count[c, s] for c in range(5)]
    last, before_last = buf[e - 1], buf[np.maximum(e - 2, s)]
    sign = np.where(kind[e - 1] == 0, last, 0).astype(np.int64)
    double = (sign > 0) & (size > 1) & (before_last == last)
    letters = has[1] + has[2] + has[4]
    case = np.where(letters == 0, 0, np.where(has[2] == 0, 1, np.where((has[2] > 1) & (has[1] == 0), 2, np.where(kind[s] == 2, 3, 4))))
    length = np.minimum(np.log2(size + 1).astype(np.int64), 6)
    digits = (has[3] > 0).astype(np.int64) + (has[3] == size)
    inner = np.minimum(has[0] - (sign > 0) - double, 2)
    doc = w.doc
    repeat = np.zeros(len(s), dtype=bool)
    repeat[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    code = ((((sign * 2 + double) * 5 + case) * 8 + length) * 3 + digits) * 3 + inner
    return code * 2 + repeat, repeat


def _coarse(code: np.ndarray) -> np.ndarray:
    """A shape without its length class."""
    rest = code // 18
    return (rest // 8) * 18 + code % 18


def _shape_grams(buf: np.ndarray, w: Words, c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Documents and hashes of one to three shapes in a row, of shares of shapes, and of lengths."""
    shape, repeat = _shapes(buf, w)
    doc, n_docs = w.doc, len(w.first) - 1
    same = doc[1:] == doc[:-1]
    fine = mix(shape.astype(U64) + U64(1))
    coarse = mix(_coarse(shape).astype(U64) + U64(1 << 40))
    grams = [(doc, mix(fine * c[1])), (doc[1:][same], mix(coarse[1:] * c[4] + coarse[:-1] * c[5])[same])]
    if len(doc) > 2:
        three = doc[2:] == doc[:-2]
        grams.append((doc[2:][three], mix(coarse[2:] * c[4] + coarse[1:-1] * c[6] + coarse[:-2] * c[7])[three]))
    # shares of shapes, and of repeats, as classes of their own
    total = np.maximum(np.diff(w.first), 1)
    for values, salt in ((coarse, 1), (mix(repeat.astype(U64) + U64(5)), 2)):
        pair = mix(values + seeds(1, salt)[0])
        key = (doc.astype(U64) << U64(40)) | (pair >> U64(24))
        unique, count = np.unique(key, return_counts=True)
        of = (unique >> U64(40)).astype(np.int64)
        level = np.floor(2 * np.log2(count / total[of])).astype(np.int64)
        grams.append((of, mix((unique & U64((1 << 40) - 1)) * c[3] + (level + 64).astype(U64) * c[6])))
    grams.append((np.arange(n_docs), mix(np.log2(np.diff(w.first) + 1).astype(U64) * c[7] + U64(99))))
    return grams


def ngram_buckets(buf: np.ndarray, offs: np.ndarray, additions: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each document, and their bounds."""
    w = words(buf, offs, VISIBLE)
    n_docs = len(offs) - 1
    if not len(w.hash):
        return np.zeros(0, dtype=np.int32), np.zeros(n_docs + 1, dtype=np.int64)
    doc = w.doc
    c = seeds(8, 41)
    same = doc[1:] == doc[:-1]
    grams = [(doc, mix(w.hash * c[0])), (doc[1:][same], mix(w.hash[1:] * c[2] + w.hash[:-1] * c[3])[same])]
    if additions:
        grams += _shape_grams(buf, w, c)
    key = np.concatenate([(d.astype(U64) << U64(20)) | (g >> U64(44)) for d, g in grams])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    of = (key >> U64(20)).astype(np.int64)
    return (key & U64(BUCKETS - 1)).astype(np.int32), np.searchsorted(of, np.arange(n_docs + 1))


@dataclass
class Model:
    """One weight per bucket; margins become probabilities by a logistic curve."""

    weight: np.ndarray  # float32
    bias: float
    slope: float
    offset: float
    additions: bool = True

    def scores(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weight[buckets], dtype=np.float64)])
        size = np.diff(bounds)
        margin = (total[bounds[1:]] - total[bounds[:-1]]) / np.sqrt(np.maximum(size, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def log_count_ratio(buckets: np.ndarray, bounds: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Logarithm of the smoothed share of each bucket in the positive class over that in the negative one."""
    of = np.repeat(y > 0, np.diff(bounds))
    p = np.bincount(buckets[of], minlength=BUCKETS) + alpha
    q = np.bincount(buckets[~of], minlength=BUCKETS) + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(buckets: np.ndarray, bounds: np.ndarray, value: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = 40, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss support vector machine; ``y`` is -1 or 1.

    Minimises ``(|w|^2 + bias^2) / 2 + cost * sum(max(0, 1 - margin))`` over its dual, whose variables lie in [0, cost].
    ``value`` gives each bucket's value; rows are scaled by the root of their number of buckets.
    """
    n = len(y)
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(n)
    rows = [buckets[bounds[i] : bounds[i + 1]] for i in range(n)]
    vals = [value[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([v @ v + 1.0 for v in vals])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(n):
            g = y[i] * (w[rows[i]] @ vals[i] + bias) - 1
            projected = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == cost else g
            if abs(projected) > 1e-12:
                worst = max(worst, abs(projected))
                old = alpha[i]
                alpha[i] = min(max(old - g / norm[i], 0.0), cost)
                step = (alpha[i] - old) * y[i]
                w[rows[i]] += step * vals[i]
                bias += step
        if worst < tolerance:
            break
    return w, bias


def train(buckets: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> Model:
    """Fit on documents given by their buckets, calibrating on every fourth one."""

    def core(pick: np.ndarray) -> tuple[np.ndarray, float]:
        sizes = np.diff(bounds)[pick]
        own = np.concatenate([buckets[bounds[i] : bounds[i + 1]] for i in pick])
        at = np.concatenate([[0], np.cumsum(sizes)])
        ratio = log_count_ratio(own, at, y[pick])
        w, bias = dual_coordinate_descent(own, at, ratio, np.where(y[pick] > 0, 1.0, -1.0))
        w = (1 - BETA) * np.abs(w).mean() + BETA * w
        return (w * ratio).astype(np.float32), bias

    if len(np.unique(y > 0)) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 0.0, 30.0 if len(y) and y[0] > 0 else -30.0)
    every = np.arange(len(y))
    held = every % 4 == 3
    slope, offset = 4.0, 0.0
    if len(np.unique(y[held] > 0)) == 2 == len(np.unique(y[~held] > 0)):
        weight, bias = core(every[~held])
        total = np.concatenate([[0.0], np.cumsum(weight[buckets], dtype=np.float64)])
        margin = (total[bounds[1:]] - total[bounds[:-1]]) / np.sqrt(np.maximum(np.diff(bounds), 1)) + bias
        coef, offset = fit_logistic(margin[held][:, None], (y[held] > 0).astype(float), ridge=0.1)
        slope = float(coef[0])
    weight, bias = core(every)
    return Model(weight, bias, slope, float(offset))


def _bucket_batches(additions: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for i, j in slices(offs, 2 << 20):
                b, at = ngram_buckets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], additions)
                yield pa.RecordBatch.from_arrays([pa.array([b[at[d] : at[d + 1]].tobytes() for d in range(j - i)], pa.binary()), batch.column(1).slice(i, j - i)], names=["buckets", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, additions: bool = True) -> Model:
    """Learn from at most ``sample_rows`` rows of ``labels(doc_id, label)``.

    Rows with a null id or label are left out; of labels of one id the largest counts, and of rows of one id one.
    If the sample lacks a class, every text gets the score of the other one, 0 if it lacks both.
    """
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, sample_rows).mapInArrow(_bucket_batches(additions), "buckets binary, label int")
    parts, y = [], []
    for r in rows.toLocalIterator():
        parts.append(np.frombuffer(r.buckets, dtype=np.int32))
        y.append(r.label)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    model = train(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), bounds, np.array(y))
    model.additions = additions
    return model


def _score_batches(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for i, j in slices(offs, 1 << 20):
                s = m.scores(*ngram_buckets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], m.additions))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``.

    A null or empty text has no n-grams and gets the score of the model's bias.  Repeated
    rows give their row each; a null id is passed on.  Other columns are not
    read.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
