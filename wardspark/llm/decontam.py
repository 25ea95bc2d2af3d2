"""Benchmark decontamination by latent semantic retrieval.

Every document becomes once a row of numbers: for each word its place in the
benchmark's vocabulary, or none. Blocks of 16 words, two neighbouring ones a
window, are TF-IDF vectors over that vocabulary without terms that are more
frequent than ``MAX_SHARE`` a block. A distributed randomised SVD finds the
latent space: each task multiplies its windows into A'(A G) for a random G, the
sums are orthogonalised, a second pass gives the small matrix of the singular
directions. Benchmark passages enter A with the weight of all windows together,
so their own directions are kept.

Windows whose cosine with a benchmark passage in that space reaches ``COSINE``
are candidates. So are, whatever their vectors, all windows that share so many
words with an item that the limits below can be met: words that a leak itself
makes frequent have no weight in the vectors, and are found by this exact search.
It looks at the words of each item that the corpus has least often, just so many
that a leak must hold ``SHARED`` of the item in them. Each candidate is checked with as many words on either side as the item
has: the longest common subsequence of words, as a share of the item, must reach
``LCS``, or ``PARAPHRASE`` where also the item's answer (its last ``ANSWER``
words) is found in order to ``ANSWER_SHARE``. Words outside the benchmark's
vocabulary cannot be part of it, so the numbers are all it needs.

The benchmark is the stated query set: its vocabulary, vectors and items go to
every task, ``ITEMS`` items at a time; documents stay where they are: no shuffle of
texts, no pairs kept. A larger benchmark is judged in parts of that size, and the
worst verdict of a row counts.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.
Null text is empty and clean, as are items without words. Very long texts are judged
window by window to their end. Repeated rows are judged each; of items that a row
holds equally one is named.
An empty benchmark leaves all clean, empty documents give an empty result. Other
columns are ignored. ``keep_clean`` goes by ids: rows of one id stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import common, lex
from wardspark.llm.katz import pack, unpack

BLOCK, RANK, EXTRA, SEED = 16, 96, 8, 11
MAX_SHARE, COSINE, LCS, PARAPHRASE, ANSWER, ANSWER_SHARE = 0.01, 0.5, 0.8, 0.6, 8, 0.75
#: Share of an item's words that the exact search asks for among its rarest words.
SHARED = 0.2
#: Items of the benchmark that go to a task at once.
ITEMS = 50_000
RESULT = "doc_id long, contaminated boolean, item_id long, lcs_share double, answer_share double, cosine double"


class Items:
    """The benchmark as arrays: (item, words) and the sorted vocabulary."""

    def __init__(self, rows: list):
        kept = [(r.item_id, lex.Words([r.text or ""]).hash) for r in rows]
        self.ids = [i for i, w in kept if len(w)]
        self.words = [w for _, w in kept if len(w)]
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.terms = [self.term(w) for w in self.words]

    def term(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each word in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)



class Slice:
    """The benchmark terms of some documents in blocks and windows.

    ``terms`` has a number or -1 for every word, ``first`` the first word of each
    document with the total at the end. A document of n blocks has n - 1 windows, of
    two neighbouring blocks each, or one of its only block.
    """

    def __init__(self, terms: np.ndarray, first: np.ndarray):
        self.terms, self.first = terms, first
        counts = np.diff(first)
        blocks = -(-counts // BLOCK)
        self.base = np.concatenate([[0], np.cumsum(blocks)])
        used = np.flatnonzero(terms >= 0)
        doc = np.searchsorted(first, used, "right") - 1
        self.term, self.block = terms[used], self.base[doc] + (used - first[doc]) // BLOCK
        self.n = int(self.base[-1])
        # a block opens a window unless it is the last of several
        last = np.zeros(self.n, bool)
        last[self.base[1:][blocks > 1] - 1] = True
        self.opens = ~last
        self.pairs = np.zeros(self.n, bool)
        self.pairs[:-1] = True
        self.pairs[self.base[1:][blocks > 0] - 1] = False
        self.doc = np.repeat(np.arange(len(counts)), blocks)

    def both(self, values: np.ndarray) -> np.ndarray:
        """Sums over the two blocks of the window that each block opens."""
        out = values.copy()
        out[:-1] += values[1:]
        alone = np.flatnonzero(~self.pairs)
        out[alone] = values[alone]
        return out


class Space:
    """Latent vectors of windows."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray):
        self.idf, self.basis = idf.astype(np.float32), basis.astype(np.float32)
        self.weighted = self.basis * self.idf[:, None]

    def _kept(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight = self.idf[s.term]
        used = weight > 0
        return s.term[used], s.block[used], weight[used]

    def rows(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(unit TF-IDF vectors of all windows times the basis, 1 / their norm), by the block that opens them."""
        term, block, weight = self._kept(s)
        out = np.zeros((s.n, self.basis.shape[1]), np.float32)
        if len(term):
            heads = np.flatnonzero(np.diff(block, prepend=-1))
            lengths = np.diff(np.concatenate([heads, [len(block)]]))
            sums = self.weighted[term[heads]]
            for k in range(1, int(lengths.max())):  # a block has BLOCK words at most
                more = np.flatnonzero(lengths > k)
                sums[more] += self.weighted[term[heads[more] + k]]
            out[block[heads]] = sums
        squares = s.both(np.bincount(block, weight * weight, s.n))
        scale = np.where(s.opens & (squares > 0), 1 / np.sqrt(np.maximum(squares, 1e-12)), 0).astype(np.float32)
        out = s.both(out)
        out *= scale[:, None]
        return out, scale

    def back(self, s: Slice, rows: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """A' rows: (terms, columns)."""
        term, block, _ = self._kept(s)
        out = np.zeros((len(self.idf), rows.shape[1]))
        if len(term):
            scaled = rows * scale[:, None]
            whole = scaled.copy()  # of both windows that a block is in
            whole[1:] += scaled[:-1]
            heads = s.base[:-1][np.diff(s.base) > 0]  # no window before a document's first block
            whole[heads] = scaled[heads]
            order = np.argsort(term, kind="stable")
            t = term[order]
            heads = np.flatnonzero(np.diff(t, prepend=-1))
            out[t[heads]] = np.add.reduceat(whole[block[order]], heads, axis=0)
            out *= self.idf[:, None]
        return out


# ---- passes over the corpus --------------------------------------------------------
CODED = "doc_ids array<long>, terms binary, lengths binary"


def _coded(items: Items):
    """Each slice as the benchmark terms of its words (0 for other words), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, most=4 << 20):
            w = lex.Words(part.column("text").to_pylist())
            row = [part.column("doc_id").to_pylist(), pack(items.term(w.hash) + 1, "<u4"), pack(np.diff(w.first), "<u4")]
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["doc_ids", "terms", "lengths"])

    return run


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Slice]]:
    for b in batches:
        for doc_ids, terms, lengths in zip(*[b.column(c).to_pylist() for c in ("doc_ids", "terms", "lengths")], strict=True):
            first = np.concatenate([[0], np.cumsum(unpack(lengths, "<u4").astype(np.int64))])
            yield doc_ids, Slice(unpack(terms, "<u4").astype(np.int64) - 1, first)


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, blocks = np.zeros(size, np.int64), 0
        for _, s in _decoded(batches):
            found += np.bincount(s.term, minlength=size)
            blocks += s.n
        used = np.flatnonzero(found)
        yield pa.record_batch([pa.array(np.append(used, -1)), pa.array(np.append(found[used], blocks))], names=["term", "n"])

    return run


STRIP = 256


def _products(space: Space, square: bool):
    """Strips of rows of A'(A basis), or of the small matrix (A basis)'(A basis)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0.0
        for _, s in _decoded(batches):
            rows, scale = space.rows(s)
            out = out + ((rows.T @ rows).astype(np.float64) if square else space.back(s, rows, scale))
        if not isinstance(out, float):
            made = []
            for at in range(0, len(out), STRIP):
                strip = out[at : at + STRIP]
                used = np.flatnonzero(strip.any(1))
                if len(used):
                    made.append((at, used.astype("<u2").tobytes(), np.ascontiguousarray(strip[used], "<f8").tobytes()))
            if made:
                yield _strips(made)

    return run


#: Rows of a matrix by strips of ``STRIP``: only those that are not zero, with their places inside the strip.
STRIPS = "strip long, used binary, data binary"


def _strips(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["strip", "used", "data"])


def _summed(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, used, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                sums.setdefault(at, np.zeros((STRIP, columns)))[np.frombuffer(used, "<u2")] += np.frombuffer(data, "<f8").reshape(-1, columns)
        if sums:
            whole = np.arange(STRIP, dtype="<u2").tobytes()
            yield _strips([(at, whole, x.tobytes()) for at, x in sums.items()])

    return run


def _total(parts: DataFrame, size: int, columns: int) -> np.ndarray:
    """The sum of the tasks' matrices of ``size`` rows: added up by strip on executors, put together on the driver."""
    spark, out = parts.sparkSession, np.zeros((-(-size // STRIP) * STRIP, columns))
    for r in parts.repartition(common.partitions(spark), "strip").mapInArrow(_summed(columns), STRIPS).collect():
        out[r.strip : r.strip + STRIP] = np.frombuffer(r.data, "<f8").reshape(-1, columns)
    return out[:size]


class Rarest:
    """For each term the items that it is one of the rarest words of, and how many such words a leak of an item has.

    A subsequence of ``PARAPHRASE`` of n words misses n - ceil(PARAPHRASE n) of
    them at most; it has the others of any set of the item's words.
    """

    def __init__(self, items: Items, found: np.ndarray):
        terms, owners, need, span = [], [], [], []
        for j, x in enumerate(items.terms):
            n = len(x)
            missed = n - int(np.ceil(PARAPHRASE * n - 1e-9))
            distinct, times = np.unique(x, return_counts=True)
            order = np.argsort(found[distinct], kind="stable")
            total = np.cumsum(times[order])
            some = int(np.searchsorted(total, missed + int(np.ceil(SHARED * n)))) + 1
            terms.append(distinct[order[:some]])
            owners.append(np.full(len(terms[-1]), j))
            need.append(int(total[len(terms[-1]) - 1]) - missed)
            span.append(2 * n + 2 * BLOCK)
        term, owner = np.concatenate(terms), np.concatenate(owners)
        order = np.argsort(term, kind="stable")
        self.owner, self.need, self.span = owner[order], np.array(need), np.array(span)
        self.start = np.searchsorted(term[order], np.arange(len(found) + 1))

    def windows(self, s: Slice) -> set[tuple[int, int]]:
        """(block, item) of all windows whose words checked hold enough of the item's rarest words."""
        at = np.flatnonzero(s.terms >= 0)
        reps = np.diff(self.start)[s.terms[at]]
        at, reps = at[reps > 0], reps[reps > 0]
        place = np.repeat(at, reps)
        inside = np.arange(len(place)) - np.repeat(np.cumsum(reps) - reps, reps)
        item = self.owner[self.start[s.terms[place]] + inside]
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        last = np.arange(len(item)) + self.need[item] - 1
        at = np.flatnonzero(last < len(item))
        last = last[at]
        ok = item[last] == item[at]
        at, last = at[ok], last[ok]
        at, last = at[(close := place[last] - place[at] < self.span[item[at]])], last[close]
        p, q, j = place[at], place[last], item[at]
        doc = np.searchsorted(s.first, p, "right") - 1
        same = q < s.first[doc + 1]
        p, q, j, doc = p[same], q[same], j[same], doc[same]
        size = self.span[j] // 2 - BLOCK
        # heads of windows that have both p and q among the words checked
        low = -(-np.maximum(q - 2 * BLOCK - size + 1 - s.first[doc], 0) // BLOCK)
        high = np.minimum((p + size - s.first[doc]) // BLOCK, s.base[doc + 1] - s.base[doc] - 1)
        n = np.maximum(high - low + 1, 0)
        block = np.repeat(s.base[doc] + low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(block * len(self.need) + np.repeat(j, n))
        return set(zip((pairs // len(self.need)).tolist(), (pairs % len(self.need)).tolist(), strict=True))


class Ready:
    """What a search needs: the items, the space, the latent vectors of their passages with their item, and their rarest words."""

    def __init__(self, items: Items, space: Space, own: Slice, found: np.ndarray):
        rows, _ = space.rows(own)
        used = np.flatnonzero(own.opens)
        self.items, self.space, self.queries, self.owner = items, space, unit(rows[used]), own.doc[used]
        self.rarest = Rarest(items, found)
        self.tables = [(set(x.tolist()), masks_of(x), len(x), masks_of(x[-ANSWER:]), min(ANSWER, len(x))) for x in items.terms]


def prepared(coded: DataFrame, items: Items, rank: int = RANK, seed: int = SEED) -> Ready:
    """The latent space of the corpus and the benchmark."""
    size = len(items.vocabulary)
    # one row a term of the benchmark at most
    counts = coded.mapInArrow(_frequencies(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r.term: r.n for r in counts}
    blocks = n.pop(-1, 0)
    found = np.array([n.get(t, 0) for t in range(size)])
    idf = np.where(found <= max(MAX_SHARE * blocks, 2), np.log((blocks + 2) / (found + 1)), 0.0)
    own = Slice(np.concatenate(items.terms), np.concatenate([[0], np.cumsum([len(t) for t in items.terms])]))
    share = max(blocks, 1) / own.n

    columns = min(rank + EXTRA, size)
    start = Space(idf, np.random.default_rng(seed).normal(size=(size, columns)))
    y = _total(coded.mapInArrow(_products(start, False), STRIPS), size, columns) + share * start.back(own, *start.rows(own))
    basis = Space(idf, np.linalg.qr(y)[0])
    small = _total(coded.mapInArrow(_products(basis, True), STRIPS), columns, columns)
    rows = basis.rows(own)[0].astype(np.float64)
    small = small + share * rows.T @ rows
    values, vectors = np.linalg.eigh(small)
    return Ready(items, Space(idf, basis.basis @ vectors[:, np.argsort(-values)[:rank]]), own, found)


# ---- candidates and checks -----------------------------------------------------------
def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Longest common subsequence with the item that ``masks`` describes, bit-parallel."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-12)


def verdicts(s: Slice, ready: Ready, cosine: float = COSINE) -> list[tuple]:
    """(contaminated, item_id, lcs_share, answer_share, cosine) of each document: its worst candidate."""
    best: list[tuple] = [(False, None, 0.0, 0.0, 0.0)] * (len(s.first) - 1)
    rows, _ = ready.space.rows(s)
    top: dict[tuple[int, int], float] = {}
    for lo in range(0, s.n, 20_000):
        near = unit(rows[lo : lo + 20_000]) @ ready.queries.T
        at, q = np.nonzero(near >= cosine)
        for i, j, c in zip((lo + at).tolist(), ready.owner[q].tolist(), near[at, q].tolist(), strict=True):
            top[i, j] = max(c, top.get((i, j), 0.0))
    for b, j in ready.rarest.windows(s):
        top.setdefault((b, j), -1.0)
    known: dict[tuple, tuple[float, float]] = {}
    for (b, j), c in top.items():
        d = int(s.doc[b])
        words, masks, size, answer_masks, answer_size = ready.tables[j]
        first, end = int(s.first[d]), int(s.first[d + 1])
        head = first + (b - int(s.base[d])) * BLOCK
        region = [x for x in s.terms[max(first, head - size) : min(end, head + 2 * BLOCK + size)].tolist() if x in words]
        if len(region) < PARAPHRASE * size:  # no subsequence is longer than the words shared
            continue
        key = (j, *region)
        if key not in known:
            known[key] = lcs(masks, size, region) / size, lcs(answer_masks, answer_size, region) / answer_size
        share, answer = known[key]
        bad = share >= LCS or (share >= PARAPHRASE and answer >= ANSWER_SHARE)
        if c < 0:  # found by its words: what its vector says
            if not bad:
                continue
            c = max(0.0, float((unit(rows[b : b + 1]) @ ready.queries[ready.owner == j].T).max()))
        best[d] = max(best[d], (bad, ready.items.ids[j], share, answer, c), key=lambda v: (v[0], v[2], v[3], v[4]))
    return best


def _judge(ready: Ready):
    kinds = [pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, s in _decoded(batches):
            cols = list(zip(*verdicts(s, ready), strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def judged(docs: DataFrame, benchmark: DataFrame, most: int = ITEMS) -> DataFrame:
    """RESULT for every row. The benchmark is the query set: ``most`` items at a time are read on the driver."""
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = -(-asked.count() // most)
    if parts <= 1:
        return _judged(common.texts(docs), asked.collect())
    # more items: every part judges the numbered rows, and the worst of their verdicts is each row's
    rows = common.texts(docs).withColumn("row", F.monotonically_increasing_id())
    rows = common.saved(rows, common.work_dir(docs.sparkSession, "numbered"))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    order = ["contaminated", "lcs_share", "answer_share", "cosine", "item_id"]
    found = None
    for k in range(parts):
        some = _judged(rows.select(F.col("row").alias("doc_id"), "text"), asked.filter(own == k).collect())
        found = some if found is None else found.unionByName(some)
    worst = found.groupBy(F.col("doc_id").alias("row")).agg(F.max(F.struct(*order)).alias("x"))
    return rows.select("row", "doc_id").join(worst, "row").select("doc_id", *[f"x.{c.split()[0]}" for c in RESULT.split(", ")[1:]])


def _judged(rows: DataFrame, asked: list) -> DataFrame:
    items = Items(sorted(asked, key=lambda r: (r.item_id is None, r.item_id or 0, r.text or "")))
    if not items.words:
        none = F.lit(None).cast("long")
        return rows.select("doc_id", F.lit(False).alias("contaminated"), none.alias("item_id"), *[F.lit(0.0).alias(c) for c in ("lcs_share", "answer_share", "cosine")])
    coded = common.saved(rows.mapInArrow(_coded(items), CODED), common.work_dir(rows.sparkSession, "decontam"))
    return coded.mapInArrow(_judge(prepared(coded, items)), RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose id is not that of a contaminated document, with all their columns."""
    bad = judged(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.alias("d").join(bad.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k._bad")), "left_anti")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
