"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector, three ordered
thresholds, four grades (0 clean to 3 severe). x marks which words and word
beginnings (4 to 8 bytes) a text holds; beginnings carry over to words that were
not seen in fitting. Features are chosen by chi-square against the label, weights
and thresholds fitted together by Adam with an L2 penalty. The output is the
expected grade, its most likely value and P(grade >= 1).

The labels say only toxic or not. Grades for fitting: 0 if not toxic; a toxic
text is graded by how many distinct words it holds that are almost only found in
toxic texts: up to one 1, two 2, more 3.

Fitted on at most ``SAMPLE`` labelled rows on the driver; scoring is one pass
over all rows and whole texts, however long, without a shuffle. Null and empty texts
have no features and get the base rate. Repeated rows score alike; where one id has
several rows, the smallest text is the one that is learned from. Of equally likely
grades the lowest is given. Without labels of both classes, or words to learn from,
every severity is 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardspark.llm import common, lex, sampling

BITS, SAMPLE, CHOSEN, STEPS, GRADES = 31, 10_000, 2000, 250, 4
SHORTEST, LONGEST = 4, 8  # of the word beginnings, in bytes
RARE = 3  # texts of the sample that must hold a term
RESULT = "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean"


def found(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed word or word beginning), repeats included."""
    w = lex.Words(texts)
    at, hashes = zip((np.arange(len(w)), w.hash), *w.prefixes(SHORTEST, LONGEST), strict=True)
    return w.doc[np.concatenate(at)], (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same, each pair once, ordered by text."""
    doc, term = found(texts)
    pairs = np.unique(doc.astype(np.int64) << BITS | term)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Model:
    """``terms`` in ascending order with their ``weights``, and the thresholds."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.terms, self.weights, self.thresholds = terms, weights, thresholds

    def grades(self, strength: np.ndarray) -> np.ndarray:
        """P(grade) by row."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - strength[:, None], -30, 30)))
        full = np.concatenate([np.zeros((len(strength), 1)), below, np.ones((len(strength), 1))], 1)
        return np.diff(full, axis=1)

    def strength(self, texts: list[str]) -> np.ndarray:
        doc, term = found(texts)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        used = self.terms[at] == term
        pairs = np.unique(doc[used].astype(np.int64) << BITS | at[used])
        return np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], len(texts))


def choose(docs: np.ndarray, terms: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms by chi-square, those found almost only in toxic texts); terms are small numbers."""
    all_ = np.bincount(terms).astype(float)
    pos = np.bincount(terms[y[docs] > 0], minlength=len(all_)).astype(float)
    n, p = len(y), y.sum()
    ok = all_ >= RARE
    a, b, c = pos[ok], all_[ok] - pos[ok], p - pos[ok]
    d = n - a - b - c
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    best = np.flatnonzero(ok)[np.argsort(-chi, kind="stable")[:most]]
    marked = np.flatnonzero((all_ >= 5) & (pos >= 0.9 * all_) & (p < 0.5 * n))
    return best, marked


def thresholds_of(p: np.ndarray, k: int) -> np.ndarray:
    return p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))])


def loss_and_gradient(p: np.ndarray, row: np.ndarray, col: np.ndarray, grade: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades with an L2 penalty on the weights, and its gradient.

    ``p`` has the weights, the first threshold, and the logarithms of the steps to the
    next ones; (row, col) are the features that texts hold.
    """
    k, n = len(p) - GRADES + 1, len(grade)
    w, rows = p[:k], np.arange(n)
    s = np.bincount(row, w[col], n)
    below = 1 / (1 + np.exp(-np.clip(thresholds_of(p, k)[None, :] - s[:, None], -30, 30)))
    full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
    slope = full * (1 - full)
    likely = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-9)
    up, low = slope[rows, grade + 1] / likely, slope[rows, grade] / likely
    d_theta = np.zeros(GRADES - 1)
    for j in range(GRADES - 1):
        d_theta[j] = (-up[grade == j].sum() + low[grade == j + 1].sum()) / n
    d_steps = np.array([d_theta[j:].sum() for j in range(1, GRADES - 1)]) * np.exp(p[k + 1 :])
    loss = -float(np.log(likely).mean()) + decay / 2 * float(w @ w)
    return loss, np.concatenate([np.bincount(col, ((up - low) / n)[row], k) + decay * w, [d_theta.sum()], d_steps])


def fit(docs: np.ndarray, terms: np.ndarray, y: np.ndarray, steps: int = STEPS, decay: float = 2e-4) -> Model | None:
    """``docs`` and ``terms`` are the pairs of features(); ``y`` is 0 or 1 by document."""
    if not len(y) or y.min() == y.max():
        return None
    ordered = np.sort(terms)
    heads = np.flatnonzero(np.diff(ordered, prepend=-1))
    known = ordered[heads[np.diff(np.append(heads, len(ordered))) >= RARE]]
    if not len(known):
        return None
    del ordered, heads
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1).astype(np.int32)
    often = known[at] == terms
    docs, terms = docs[often], at[often]
    del at, often
    best, marked = choose(docs, terms, y, CHOSEN)
    is_marked = np.zeros(len(known), bool)
    is_marked[marked] = True
    hits = np.bincount(docs[is_marked[terms]], minlength=len(y))
    grade = np.where(y == 1, np.clip(hits, 1, GRADES - 1), 0)
    best = np.sort(best)
    place = np.full(len(known), -1)
    place[best] = np.arange(len(best))
    col = place[terms]
    row, col = docs[col >= 0], col[col >= 0]
    # the first threshold and the logarithms of the steps to the next ones: always in order
    share = np.clip(np.cumsum(np.bincount(grade, minlength=GRADES))[:-1] / len(y), 0.01, 0.99)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 0.01 * np.arange(GRADES - 1))
    p = np.concatenate([np.zeros(len(best)), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    m, v, k = 0 * p, 0 * p, len(best)
    for step in range(1, steps + 1):
        _, grad = loss_and_gradient(p, row, col, grade, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(known[best], p[:k], thresholds_of(p, k))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, most=2 << 20):
        doc, term = features(part.column("text").to_pylist())
        ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
        made = [term[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array(made, pa.binary())], names=["doc_id", "label", "terms"])


def train(docs: DataFrame, labels: DataFrame, where=None, most: int = SAMPLE) -> Model | None:
    rows = sampling.gathered(sampling.labelled(docs, labels, "toxic", most, where), _featured, "doc_id long, label int, terms binary")
    if not rows:
        return None
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r.terms) // 4 for r in rows])
    y = np.array([int(r.label > 0) for r in rows])
    terms = np.concatenate([np.frombuffer(r.terms, "<i4") for r in rows])
    del rows
    return fit(doc, terms, y)


def _scorer(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, most=2 << 20):
            if model is None:
                p = np.tile([1.0] + [0.0] * (GRADES - 1), (part.num_rows, 1))
            else:
                p = model.grades(model.strength(part.column("text").to_pylist()))
            toxic = 1 - p[:, 0]
            cols = [part.column("doc_id"), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= 0.5)]
            yield pa.record_batch(cols, names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return run


def scored(docs: DataFrame, labels: DataFrame, where=None, most: int = SAMPLE) -> DataFrame:
    """RESULT for every row. ``where`` restricts the labels that may be learned from."""
    return common.texts(docs).mapInArrow(_scorer(train(docs, labels, where, most)), RESULT)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
