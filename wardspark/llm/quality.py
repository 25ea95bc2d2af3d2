"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 100 words. Each passage gives shares of byte
classes, word shapes, stop words and distinct words, and its words hashed with signs
into ``HASHED`` sums; a small network encodes it, gated attention (tanh times sigmoid) weighs the passages of a document, and the
weighted sum of the encodings is scored. Only documents are labelled; what
matters inside them is learned.

Fitted on at most ``SAMPLE`` labelled rows whose crc32(doc_id as text) mod 4 is
not 2, by full-batch Adam on the driver (a few MB of features). Scoring is one
pass over all rows without a shuffle. Inputs of a score are the text alone.

Null and empty texts are one passage of zeros; of very long texts every passage
counts. Repeated rows get equal scores; where one id has several rows, the smallest
text is the one that is learned from, and the smallest label counts. Without labels
of both classes every score is 0.5, and ``keep_good``, which then has nothing to
reject by, keeps all. A score that ties with the threshold is good. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import common, lex, sampling
from wardspark.llm.html_text import STOP

PASSAGE, SAMPLE, HIDDEN, GATE, STEPS, THRESHOLD = 100, 6000, 16, 8, 400, 0.7
_B = np.arange(256)
_CLASSES = [
    (_B >= 97) & (_B <= 122),
    (_B >= 65) & (_B <= 90),
    (_B >= 48) & (_B <= 57),
    _B >= 128,
    np.isin(_B, list(b".,;:?'\"-")),
    _B == ord("!"),
    _B == ord("|"),
    np.isin(_B, list(b"#$%&*@^~<>={}[]\\/_+`")),
    np.isin(_B, [10, 13]),
]
#: Sums of hashed words, and how much they weigh beside the surface features.
HASHED, CONTENT = 64, 0.3
SURFACE = len(_CLASSES) + 7
FEATURES = SURFACE + HASHED
_STOPS = np.sort(lex.hash_of(sorted(w for w in STOP if w.isascii())))


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, first passage of each text with the total at the end); at least one passage a text."""
    w = lex.Words(texts, lex.SOLID)
    counts = np.diff(w.first)
    bags = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    x = np.zeros((first[-1], FEATURES), np.float32)
    if not len(w):
        return x, first
    inside = np.arange(len(w)) - w.first[w.doc]
    at = first[w.doc] + inside // PASSAGE
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    used, n = at[heads], np.diff(np.concatenate([heads, [len(w)]])).astype(np.float32)
    char_heads = w.starts[heads]
    size = np.diff(np.concatenate([char_heads, [len(w.raw)]])).astype(np.float32)
    for k, table in enumerate(_CLASSES):
        x[used, k] = np.add.reduceat(table[w.raw].view(np.uint8), char_heads, dtype=np.int64) / size
    lens = (w.ends - w.starts).astype(np.float32)
    last = w.raw[w.ends - 1]
    per = lambda values: np.add.reduceat(values.astype(np.float32), heads) / n
    k = len(_CLASSES)
    x[used, k] = np.log1p(per(lens))
    x[used, k + 1] = per(~lex.LETTER[last])
    where = np.minimum(np.searchsorted(_STOPS, w.hash), len(_STOPS) - 1)
    x[used, k + 2] = per(_STOPS[where] == w.hash)
    order = np.lexsort((w.hash, at))
    fresh = np.ones(len(w), bool)
    fresh[1:] = (at[order][1:] != at[order][:-1]) | (w.hash[order][1:] != w.hash[order][:-1])
    x[used, k + 3] = np.add.reduceat(fresh.astype(np.float32), heads) / n
    x[used, k + 4] = per(lens == 1)
    x[used, k + 5] = np.log1p(n) / 5
    x[used, k + 6] = np.log1p(counts[w.doc[heads]]) / 10
    cell = at * HASHED + (w.hash >> np.uint64(40)).astype(np.int64) % HASHED
    sums = np.bincount(cell, 1.0 - 2.0 * (w.hash >> np.uint64(63)).astype(float), len(x) * HASHED).reshape(-1, HASHED)
    x[used, SURFACE:] = sums[used] / np.sqrt(n)[:, None]
    return x, first


class Model:
    """Gated-attention network over passage features."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, params: dict[str, np.ndarray]):
        self.mean, self.std, self.p = mean, std, params

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, doc = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc])
        a = e / np.add.reduceat(e, first[:-1])[doc]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return doc, h, t, g, a, z, z @ p["c"] + p["d"][0]

    def scores(self, texts: list[str]) -> np.ndarray:
        x, first = passages(texts)
        logit = self.forward((x - self.mean) / self.std, first)[-1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def loss_and_gradient(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy with an L2 penalty, and its gradient by parameter; x is scaled."""
    p = model.p
    doc, h, t, g, a, z, logit = model.forward(x, first)
    logit = np.clip(logit, -30, 30)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit)) + decay / 2 * sum(float((v * v).sum()) for v in p.values())
    d_logit = (1 / (1 + np.exp(-logit)) - y) / len(y)
    d_z = d_logit[:, None] * p["c"]
    d_a = (d_z[doc] * h).sum(1)
    d_e = a * (d_a - np.add.reduceat(a * d_a, first[:-1])[doc])
    d_tg = d_e[:, None] * p["w"]
    d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
    d_h = (a[:, None] * d_z[doc] + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - h * h)
    grad = {"W": x.T @ d_h, "b": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "w": (t * g).T @ d_e, "c": z.T @ d_logit, "d": d_logit.sum(keepdims=True)}
    return loss, {k: v + decay * p[k] for k, v in grad.items()}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, decay: float = 1e-4, seed: int = 1) -> Model | None:
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-3
    std[SURFACE:] /= CONTENT
    x = (x - mean) / std
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    p = {"W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
    model, m, v = Model(mean, std, p), {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}
    for step in range(1, steps + 1):
        _, grad = loss_and_gradient(model, x, first, y, decay)
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] -= 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, most=2 << 20):
        x, first = passages(part.column("text").to_pylist())
        bags = [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])


def train(docs: DataFrame, labels: DataFrame, where=None, most: int = SAMPLE) -> Model | None:
    rows = sampling.gathered(sampling.labelled(docs, labels, "quality", most, where), _featured, "doc_id long, label int, bag binary")
    if not rows:
        return None
    bags = [np.frombuffer(r.bag, "<f4").reshape(-1, FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return fit(np.concatenate(bags).astype(np.float64), first, np.array([r.label for r in rows], float))


def _scorer(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, most=2 << 20):
            made = np.full(part.num_rows, 0.5) if model is None else model.scores(part.column("text").to_pylist())
            yield pa.record_batch([*part.columns[:-1], pa.array(made, pa.float64())], names=[*part.schema.names[:-1], "_score"])

    return run


def learnable() -> "F.Column":
    return common.crc_mod(F.col("doc_id"), 4) != 2


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, score) for every row."""
    model = train(docs, labels, learnable(), most)
    return common.texts(docs).mapInArrow(_scorer(model), "doc_id long, _score double").withColumnRenamed("_score", "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score of ``threshold`` or more, with all their columns, in one pass."""
    model = train(docs, labels, learnable())
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, most=2 << 20):
            good = model.scores([t or "" for t in part.column("text").to_pylist()]) >= threshold
            yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
