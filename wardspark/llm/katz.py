"""Katz back-off language model over word triples, kept in partitioned tables.

Events are the training words, the end of a text, and one unknown word. With
counts r of (history, word) and Good-Turing discounts d_r for r up to 5, of each
order for itself, and h' the history h without its first word:

    P(w | h) = d_r r / n(h)            if (h, w) was seen
             = alpha(h) P(w | h')      if only h was seen
             = P(w | h')               if h was not
    P(w)     = d_c c / N, and what discounting leaves for the unknown word

alpha(h) is what the seen words leave, over the mass that the lower order leaves
to words not seen after h: both sums are taken over all words seen after h, so
each distribution sums to 1. A history whose counts are all too high to be
discounted counts one more event. Before the first word of a text stands one end,
which is all of that word's history.

How it runs:
1. Each slice of documents becomes a row: its distinct words, and its tokens as
   indices into them (packed). This table stands for the text from then on.
2. Words are counted and numbered by falling count. So a count is a step function
   of the number, with at most sqrt(2N) steps: that table, unlike the
   vocabulary, is small enough to be handed to every task. Each slice gets the
   numbers of its own words by a join and keeps them in a file.
3. A triple (a, b, c) belongs to the owner of its middle word. That owner has all
   of a history (a, b), all of (b), all pairs (b, c) and all triples, so both
   orders and their sums are local. Each task writes the triples of its slices,
   with their documents, to one file in segments by owner; a table lists them.
   Middle words so frequent that they would fill an owner (at most twice as many
   as owners) are dealt by the first word too, and first words of texts by
   themselves; their pairs alone are spread. The rows of one history are not.
4. Owners add up their segments, write their part of the tables of triples and
   pairs, and report counts of counts. Pairs of frequent words meet by word and
   range, and are written as files of a range each.
5. With the discounts known, owners read their parts, make and write the tables of
   totals and back-off weights (kept to single precision; scores use double), and
   score their segments from the lowest order up: a partial sum a document. The sums of a slice meet and give the scores.

An owner works through its share of the tokens in ``PARTS`` parts, by middle words;
more shuffle partitions make shares smaller.

Null text is empty: one token, the end. Very long texts are scored whole. Repeated
rows count and score each. Ties in the numbering go by word. Null ids are like the
empty text in the choice of training rows. An empty training part gives N = 0: every
token is then unknown with probability 1; an empty table gives an empty result. More
than 2^32 - 2 different words are an error. Other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import common

END, UNKNOWN, DISCOUNTED = 0, 0xFFFFFFFF, 5
SLICE = 16 << 20
CHUNK = "chunk long, words array<binary>, counts array<long>, tokens binary, doc_ids array<long>, lengths array<int>, held array<boolean>"
SEGMENT = "owner int, name string, start long, size long"
COUNTED = "kind int, id long, n long, span long, words binary, counts binary"
HOT = "kind int, id long, n long, span long, uni double, left array<long>"
#: What the rows of COUNTED and HOT are: counts of counts of triples and of pairs, and pairs of a frequent word.
TRIPLES, PAIRS, FREQUENT = 3, 2, 1
#: Bits of the ranges of word numbers that pairs of frequent words are kept in.
SPAN = 20
#: Parts of an owner's share, of which it holds one at a time.
PARTS = 4
PART = "chunk long, kind int, doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, at array<int>, value array<double>"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---- packed arrays -----------------------------------------------------------
def pack(values: np.ndarray, kind: str) -> bytes:
    """Bytes of equal rank side by side, compressed."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def pack_all(arrays: list[np.ndarray]) -> bytes:
    parts = [pack(x, "<u4") for x in arrays]
    return struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)) + b"".join(parts)


def unpack_all(data: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<Q", data)
    sizes = struct.unpack_from(f"<{n}Q", data, 8)
    ends = np.cumsum((8 + 8 * n, *sizes))
    return [unpack(data[a:b], "<u4") for a, b in zip(ends[:-1], ends[1:], strict=True)]


# ---- 1. slices -----------------------------------------------------------------
def _chunks(mod: int, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for part in common.slices(batches, most=SLICE):
            doc_ids = part.column("doc_id").to_pylist()
            held = [common.crc_of(i) % mod == rest for i in doc_ids]
            index: dict[bytes, int] = {}
            tokens, lengths = [], []
            for text in part.column("text").to_pylist():
                words = common.words_of(text)
                lengths.append(len(words))
                tokens.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint32, len(words)))
            trained = [t for t, h in zip(tokens, held, strict=True) if not h]
            counts = np.bincount(np.concatenate(trained), minlength=len(index)) if trained else np.zeros(len(index), np.int64)
            row = [task << 24 | n, list(index), counts, pack(np.concatenate(tokens), "<u4"), doc_ids, lengths, held]
            kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            n += 1
            yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["chunk", "words", "counts", "tokens", "doc_ids", "lengths", "held"])

    return run


# ---- 2. vocabulary ---------------------------------------------------------------
def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        at = np.arange(n, n + b.num_rows)
        n += b.num_rows
        yield pa.record_batch([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at), b.column("word"), b.column("c")], names=["part", "at", "word", "c"])


def vocabulary(chunks: DataFrame, folder: str) -> DataFrame:
    """(word, c, gid): training words numbered from 1 by falling count, ties by word; kept as ``ranked`` with each part's first number beside it."""
    spark = chunks.sparkSession
    each = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words = each.filter("c > 0").groupBy("word").agg(F.sum("c").alias("c"))
    order = [F.col("c").desc(), F.col("word")]
    placed = words.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    placed = common.saved(placed.mapInArrow(_ranked, "part int, at long, word binary, c long"), f"{folder}/ranked")
    base, starts = 1, []
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r.part, base))
        base += r.n
    offsets = common.saved(spark.createDataFrame(starts, "part int, base long").coalesce(1), f"{folder}/ranked_parts")  # a row a partition
    return placed.join(F.broadcast(offsets), "part").select("word", "c", (F.col("at") + F.col("base")).alias("gid"))


class Unigrams:
    """Count and probability of a numbered word, from the step table."""

    def __init__(self, firsts: np.ndarray, counts: np.ndarray, words: int, ends: int):
        self.firsts, self.counts = firsts, counts  # first number of every count, numbers rising
        self.words, self.ends = words, ends
        spans = np.diff(np.concatenate([firsts, [words + 1]]))
        self.n = int((spans * counts).sum()) + ends
        self.distinct = words + (ends > 0)
        histogram = {int(c): int(s) for c, s in zip(counts, spans, strict=True)}
        if ends:
            histogram[ends] = histogram.get(ends, 0) + 1
        self.d = discounts(histogram)
        used = sum(self._weight(c) * s for c, s in histogram.items())
        self.total = float(self.n) if used < self.n - 1e-9 else self.n + 1.0
        self.unknown = 1.0 - used / self.total if self.n else 1.0

    def _weight(self, c: int) -> float:
        return c * self.d[c] if c < len(self.d) else float(c)

    def count(self, gid: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(gid), np.int64)
        at = np.searchsorted(self.firsts, gid, "right") - 1
        table = self.counts if len(self.counts) else np.zeros(1, np.int64)
        out = table[np.maximum(at, 0)]
        return np.where(gid == UNKNOWN, 0, np.where(gid == END, self.ends, out))

    def probability(self, gid: np.ndarray) -> np.ndarray:
        c = self.count(gid)
        scale = np.concatenate([self.d, [1.0]])[np.minimum(c, len(self.d))]
        return np.where(c > 0, c * scale / self.total, self.unknown)


def discounts(histogram: dict[int, int]) -> np.ndarray:
    """d_0..d_k of Good-Turing with Katz's cut-off k: the largest of 5..1 that gives factors in (0, 1).

    If none does, counts of one keep half their weight.
    """
    for k in range(DISCOUNTED, 0, -1):
        n = [histogram.get(r, 0) for r in range(k + 2)]
        if not all(n[1:]):
            continue
        cut = (k + 1) * n[k + 1] / n[1]
        if cut >= 1:
            continue
        d = np.array([1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) for r in range(1, k + 1)])
        if (d[1:] > 0).all() and (d[1:] < 1).all():
            return d
    return np.array([1.0, 0.5])


# ---- 3. segments ---------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def joint(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers of 32 bits as one that sorts like them."""
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def _ranked_tokens(row: dict, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of all tokens, with an end after every text, among the slice's numbers; these numbers; document of each token)."""
    lengths = np.array(row["lengths"], np.int64)
    # a slice without words has no file of numbers
    local = np.frombuffer(common.read_file(f"{folder}/numbers", f"{row['chunk']}.u4") if lengths.any() else b"", "<u4")
    numbers, place = np.unique(np.append(local, np.uint32(END)), return_inverse=True)
    tokens = unpack(row["tokens"], "<u4")
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    out = np.zeros(len(doc), np.int32)  # the end has the smallest number
    is_word = np.ones(len(doc), bool)
    is_word[np.cumsum(lengths + 1) - 1] = False
    out[is_word] = place.astype(np.int32)[tokens]
    return out, numbers, doc


def _runs(a: np.ndarray, b: np.ndarray, c: np.ndarray, known: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(order of the known triples by b, a and c; where each distinct one begins in it; its a, b and c); all are below ``size``."""
    n, bits = int(known.sum()), int(size).bit_length()
    if 3 * bits < 64:  # as in all slices but those of a very long text: one number that sorts like the three
        key = b.astype(np.int64)
        key <<= bits
        key |= a
        key <<= bits
        key |= c
        key[~known] = np.iinfo(np.int64).max
        order = np.argsort(key)[:n]
        key = key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        key, mask = key[heads], (1 << bits) - 1
        return order, heads, key >> bits & mask, key >> 2 * bits, key & mask
    order = np.flatnonzero(known)
    order = order[np.lexsort((c[order], a[order], b[order]))]
    a, b, c = a[order], b[order], c[order]
    heads = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
    return order, heads, a[heads], b[heads], c[heads]


def _write_numbers(folder: str):
    """Rows (chunk, pos, gid), sorted by chunk and pos: one file of numbers a chunk, unknown where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []

        def close() -> None:
            common.write_file(f"{folder}/numbers", f"{chunk}.u4", np.concatenate(held).astype("<u4").tobytes())

        for b in batches:
            ids = b.column("chunk").to_numpy()
            gid = b.column("gid").fill_null(UNKNOWN).to_numpy()
            for start, end in zip(cuts := np.flatnonzero(np.diff(ids, prepend=-1)), [*cuts[1:], len(ids)], strict=True):
                if ids[start] != chunk:
                    if held:
                        close()
                    chunk, held = int(ids[start]), []
                held.append(gid[start:end])
        if held:
            close()
            yield pa.record_batch([pa.array([0], pa.int32())], names=["done"])

    return run


def _segments(folder: str, owners: list[int], hot: int, most: int = 256 << 20):
    """Writes the triples of a task's slices by owner; reports where each owner's segment is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[] for _ in range(PARTS * len(owners))]
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            name, made = f"{uuid.uuid4().hex}.seg", [b"".join(struct.pack("<Q", len(x)) + x for part in held[k : k + PARTS] for x in part) for k in range(0, len(held), PARTS)]
            common.write_file(f"{folder}/segments", name, b"".join(made))
            sizes = np.array([len(x) for x in made])
            used, starts = np.flatnonzero(sizes), np.cumsum(sizes) - sizes
            held, size = [[] for _ in held], 0
            cols = [pa.array(np.array(owners, np.int32)[used]), pa.array([name] * len(used)), pa.array(starts[used]), pa.array(sizes[used])]
            return pa.record_batch(cols, names=["owner", "name", "start", "size"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("chunk", "tokens", "lengths", "held")}
                c, numbers, doc = _ranked_tokens(row, folder)
                b = np.zeros_like(c)
                b[1:] = c[:-1]  # an end stands before every text
                a = np.zeros_like(c)
                a[1:] = b[:-1]
                a[np.flatnonzero(np.diff(doc, prepend=-1))] = 0
                known = numbers[b] != UNKNOWN
                if not known.any():
                    continue
                order, heads, a, b, c = _runs(a, b, c, known, len(numbers))
                doc, reps = doc[order], np.diff(np.append(heads, len(order)))
                del order, known
                trained = np.add.reduceat(~np.array(row["held"], bool)[doc], heads, dtype=np.int64)
                ba, c = joint(numbers[b], numbers[a]), numbers[c]
                b = ba >> np.uint64(32)
                owner = (mix(np.where(b == END, c, np.where(b < hot, ba, b))) % np.uint64(len(held))).astype(np.int32)
                by = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[by], np.arange(len(held) + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    at = by[cuts[k] : cuts[k + 1]]
                    r = reps[at]
                    place = np.repeat(heads[at] - (np.cumsum(r) - r), r) + np.arange(r.sum())
                    steps = np.diff(b[at].astype(np.int64), prepend=0)
                    arrays = [steps, ba[at] & np.uint64(0xFFFFFFFF), c[at], trained[at], r, doc[place]]
                    made = struct.pack("<qq", row["chunk"], k % PARTS) + pack_all(arrays)
                    held[k].append(made)
                    size += len(made)
                if size > most:
                    yield close()
        if size:
            yield close()

    return run


def _owned(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[int, list[list[tuple]]]]:
    """(owner, the segments of each of its parts as (chunk, packed)); a partition has one owner, or few where keys fall together."""
    where: dict[int, list[tuple]] = {}
    for batch in batches:
        for owner, *at in zip(*[batch.column(c).to_pylist() for c in ("owner", "name", "start", "size")], strict=True):
            where.setdefault(owner, []).append(at)
    for owner, places in sorted(where.items()):
        found: list[list[tuple]] = [[] for _ in range(PARTS)]
        for name, start, size in sorted(places):
            data, at = common.read_file(f"{folder}/segments", name, start, size), 0
            while at < len(data):
                n, chunk, part = struct.unpack_from("<Qqq", data, at)
                found[part].append((chunk, data[at + 24 : at + 8 + n]))
                at += 8 + n
        yield owner, found


def _opened(packed: bytes) -> list[np.ndarray]:
    """[b and a joint, c, trained, reps, docs] of a segment."""
    steps, a, *rest = unpack_all(packed)
    return [joint(np.cumsum(steps, dtype=np.uint64), a), *rest]


# ---- 4. counts ---------------------------------------------------------------------------
def summed(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (high, low) in order, with the sums of their counts."""
    if not len(high):
        return high, low, counts.astype(np.int64)
    distinct, place = np.unique(high, return_inverse=True)
    key = joint(place, low)
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return distinct[(key[heads] >> np.uint64(32)).astype(np.int64)], key[heads].astype(low.dtype), np.add.reduceat(counts[order].astype(np.int64), heads)


#: First words rise inside a middle word: steps are shorter. Counts and middle words repeat: Parquet's dictionaries.
ENCODED = {"a": "DELTA_BINARY_PACKED", "c": "BYTE_STREAM_SPLIT", "alpha": "BYTE_STREAM_SPLIT"}


def _table(**columns: np.ndarray) -> bytes:
    sink = io.BytesIO()
    coded = {k: v for k, v in ENCODED.items() if k in columns}
    pq.write_table(pa.table(columns), sink, compression="zstd", use_dictionary=[k for k in columns if k not in coded], column_encoding=coded)
    return sink.getvalue()


def _read_table(folder: str, owner: int, part: int) -> list[np.ndarray]:
    table = pq.read_table(io.BytesIO(common.read_file(f"{folder}/owner={owner}", f"part-{part}.parquet")))
    return [table.column(c).to_numpy() for c in table.column_names]


def _counts_of_counts(kind: int, n: np.ndarray) -> list[tuple]:
    seen = np.bincount(np.minimum(n, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return [(kind, r, int(seen[r])) for r in range(1, DISCOUNTED + 2)]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    rows = [(*r, *[None] * (len(fields) - len(r))) for r in rows]
    return pa.record_batch([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _count(folder: str, hot: int):
    """Writes each owner's part of the tables of triples and pairs; COUNTED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, part, segments in ((o, k, x) for o, found in _owned(batches, folder) for k, x in enumerate(found) if x):
            trained = [[x[s[2] > 0] for x in s[:3]] for s in (_opened(packed) for _, packed in segments)]
            ba, c, n = summed(*(np.concatenate(x) for x in zip(*trained, strict=True)))
            del trained, segments
            b = (ba >> np.uint64(32)).astype(np.uint32)
            inner = b != END
            counts = n.astype(np.uint32) if n.max(initial=0) <= UNKNOWN else n
            common.write_file(f"{folder}/triples/owner={owner}", f"part-{part}.parquet", _table(a=ba.astype(np.uint32)[inner], b=b[inner], c=c[inner], n=counts[inner]))
            rows = _counts_of_counts(TRIPLES, n[inner])
            pb, pc, pn = summed(b, c, n)
            cold = pb >= hot
            common.write_file(f"{folder}/pairs/owner={owner}", f"part-{part}.parquet", _table(b=pb[cold], c=pc[cold], n=pn[cold]))
            rows += _counts_of_counts(PAIRS, pn[cold])
            pb, pc, pn = pb[~cold], pc[~cold], pn[~cold]
            span = pc >> np.uint32(SPAN)
            heads = np.flatnonzero(np.concatenate([[True], (pb[1:] != pb[:-1]) | (span[1:] != span[:-1])])) if len(pb) else []
            for x, y in zip(heads, [*heads[1:], len(pb)], strict=True) if len(pb) else ():
                rows.append((FREQUENT, int(pb[x]), int(pn[x:y].sum()), int(span[x]), pack(np.diff(pc[x:y], prepend=np.uint32(0)), "<u4"), pack(pn[x:y], "<u8")))
            yield _batch(rows, COUNTED)

    return run


def _frequent(folder: str, uni: Unigrams):
    """Pairs of frequent words, sorted by word and range, in: a file of each range, and HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            words = np.concatenate([np.cumsum(unpack(w, "<u4"), dtype=np.uint32) for w, _ in held])
            _, words, counts = summed(np.zeros(len(words), np.uint8), words, np.concatenate([unpack(n, "<u8") for _, n in held]))
            common.write_file(f"{folder}/frequent/word={now[0]}", f"{now[1]}.parquet", _table(c=words, n=counts))
            left = np.bincount(np.minimum(counts, DISCOUNTED + 1), minlength=DISCOUNTED + 2)[1 : DISCOUNTED + 1]
            own = (FREQUENT, now[0], int(counts.sum()), now[1], float(uni.probability(words.astype(np.int64)).sum()), left.tolist())
            return _batch([own, *_counts_of_counts(PAIRS, counts)], HOT)

        for batch in batches:
            for word, span, w, n in zip(*[batch.column(c).to_pylist() for c in ("id", "span", "words", "counts")], strict=True):
                if (word, span) != now and held:
                    yield close()
                    held = []
                now = (word, span)
                held.append((w, n))
        if held:
            yield close()

    return run


def backoff(n: np.ndarray, by_count: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total to divide by, alpha) of histories with n events, by_count[:, r-1] words seen r times, whose lower-order mass is ``lower``."""
    r = np.arange(1, DISCOUNTED + 1)
    factor = np.array([1 - d[x] if x < len(d) else 0.0 for x in r])
    freed = by_count @ (factor * r)
    total = np.where(freed > 1e-12, n, n + 1).astype(float)
    left = np.where(freed > 1e-12, freed, 1.0) / np.maximum(total, 1)
    return total, left / np.maximum(1 - lower, 1e-300)


class Order:
    """The histories and events of one order, in order: keys of histories, and counts of (history, word) with the lower order's probabilities."""

    def __init__(self, history: np.ndarray, word: np.ndarray, n: np.ndarray, lower: np.ndarray, d: np.ndarray):
        heads = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]])) if len(history) else np.zeros(0, np.int64)
        self.histories, self.d = history[heads], d
        spans = np.diff(np.append(heads, len(history)))
        self.events, self.n = joint(np.repeat(np.arange(len(heads), dtype=np.uint32), spans), word), n
        if len(heads):
            by_count = np.stack([np.add.reduceat(n == r, heads, dtype=np.int32) for r in range(1, DISCOUNTED + 1)], 1)
            self.total, self.alpha = backoff(np.add.reduceat(n, heads), by_count, np.add.reduceat(lower, heads), d)
        else:
            self.total = self.alpha = np.zeros(0)

    def probability(self, history: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P(word | history), given that of the lower order."""
        if not len(self.histories) or not len(history):
            return lower
        heads = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]]))  # rows of a history stand together
        at = np.minimum(np.searchsorted(self.histories, history[heads]), len(self.histories) - 1)
        at = np.repeat(at, np.diff(np.append(heads, len(history))))
        known = self.histories[at] == history
        event = joint(at, word)
        place = np.minimum(np.searchsorted(self.events, event), len(self.events) - 1)
        seen = known & (self.events[place] == event)
        return np.where(seen, discounted(self.n[place], self.d) / self.total[at], np.where(known, self.alpha[at] * lower, lower))


def discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return n * np.concatenate([d, [1.0]])[np.minimum(n, len(d))]


class Pairs:
    """P(c | b) of a part of an owner: its own pairs, and those of frequent words from their files, range by range."""

    def __init__(self, folder: str, owner: int, part: int, uni: Unigrams, d: np.ndarray, hot: dict[int, tuple[float, float, list[int]]]):
        b, c, n = _read_table(f"{folder}/pairs", owner, part)
        self.order = Order(b.astype(np.uint64), c, n.astype(np.int64), uni.probability(c.astype(np.int64)), d)
        self.folder, self.uni, self.d, self.hot = folder, uni, d, hot

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Of distinct pairs (b and c joint), in order: each file is read once, and one at a time."""
        b, c = keys >> np.uint64(32), keys.astype(np.uint32)
        lower = self.uni.probability(c.astype(np.int64))
        out = self.order.probability(b, c, lower)
        for word, (total, alpha, spans) in self.hot.items():
            x, y = np.searchsorted(keys, np.array([word << 32, (word + 1) << 32], np.uint64))
            if x == y:
                continue
            out[x:y] = alpha * lower[x:y]
            for s in spans:
                lo, hi = x + np.searchsorted(c[x:y] >> np.uint32(SPAN), np.array([s, s + 1], np.uint32))
                if lo == hi:
                    continue
                table = pq.read_table(io.BytesIO(common.read_file(f"{self.folder}/frequent/word={word}", f"{s}.parquet")))
                words, n = (table.column(k).to_numpy() for k in ("c", "n"))
                at = np.minimum(np.searchsorted(words, c[lo:hi]), len(words) - 1)
                seen = words[at] == c[lo:hi]
                out[lo + np.flatnonzero(seen)] = discounted(n[at[seen]], self.d) / total
        return out


def _score(folder: str, uni: Unigrams, d2: np.ndarray, d3: np.ndarray, hot: dict[int, tuple[float, float, list[int]]], order: int):
    """Reads each owner's tables, writes its back-off tables, and scores its segments."""

    def scores(owner: int, part: int, segments: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        pairs = Pairs(folder, owner, part, uni, d2, hot)
        # the segments stay packed, and are opened one by one: once for their pairs, once for their scores
        asked = np.unique(np.concatenate([np.unique(joint(ba >> np.uint64(32), c)) for ba, c, *_ in (_opened(packed) for _, packed in segments)]))
        of_pairs = pairs.probability(asked)
        a, b, c, n = _read_table(f"{folder}/triples", owner, part)
        triples = Order(joint(b, a), c, n.astype(np.int64), of_pairs[np.searchsorted(asked, joint(b, c))], d3)
        known, top = pairs.order, triples.histories
        common.write_file(f"{folder}/backoff2/owner={owner}", f"part-{part}.parquet", _table(b=known.histories.astype(np.uint32), total=known.total, alpha=known.alpha.astype(np.float32)))
        common.write_file(f"{folder}/backoff3/owner={owner}", f"part-{part}.parquet", _table(a=top.astype(np.uint32), b=(top >> np.uint64(32)).astype(np.uint32), total=triples.total, alpha=triples.alpha.astype(np.float32)))
        del a, b, c, n
        for chunk, packed in segments:
            ba, c, _, reps, docs = _opened(packed)
            p = uni.probability(c.astype(np.int64)) if order == 1 else of_pairs[np.searchsorted(asked, joint(ba >> np.uint64(32), c))]
            p = triples.probability(ba, c, p) if order == 3 else p
            sums = np.bincount(docs, np.repeat(np.log10(p), reps))
            used = np.flatnonzero(sums)
            yield chunk, used.astype(np.int32), sums[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, found in _owned(batches, folder):
            sums: dict[int, list[tuple]] = {}  # of the documents of each slice, over the parts
            for part, segments in enumerate(found):
                for chunk, at, value in scores(owner, part, segments) if segments else ():
                    sums.setdefault(chunk, []).append((at, value))
            for chunk, made in sums.items():
                at, value = (np.concatenate(x) for x in zip(*made, strict=True))
                used, place = np.unique(at, return_inverse=True)
                yield _part(chunk, 1, at=used, value=np.bincount(place, value))

    return run


# ---- 5. scores ---------------------------------------------------------------------------
_PART_KINDS = {"chunk": pa.int64(), "kind": pa.int32(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "n_tokens": pa.list_(pa.int64()), "n_known": pa.list_(pa.int64()), "base": pa.list_(pa.float64()), "at": pa.list_(pa.int32()), "value": pa.list_(pa.float64())}


def _part(chunk: int, kind: int, **given) -> pa.RecordBatch:
    given |= {"chunk": chunk, "kind": kind}
    return pa.record_batch([pa.array([given.get(k)], t) for k, t in _PART_KINDS.items()], names=list(_PART_KINDS))


def _stats(folder: str, uni: Unigrams):
    """Counts and base score of every document, and the score of words after unknown ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i].as_py() for k in ("chunk", "tokens", "lengths", "held", "doc_ids")}
                at, numbers, doc = _ranked_tokens(row, folder)
                n, gid = len(row["doc_ids"]), numbers.astype(np.int64)
                c = uni.count(gid)
                base = np.bincount(doc, np.log10((c + 1) / (uni.n + uni.distinct + 1))[at], n)
                lost = np.flatnonzero(numbers[np.concatenate([[0], at[:-1]])] == UNKNOWN)
                plain = np.bincount(doc[lost], np.log10(uni.probability(gid))[at[lost]], n)
                c = c[at]
                yield _part(row["chunk"], 0, doc_ids=row["doc_ids"], held=row["held"], n_tokens=np.bincount(doc, minlength=n), n_known=np.bincount(doc[c > 0], minlength=n), base=base, at=np.arange(n, dtype=np.int32), value=plain)

    return run


def _gather(n_train: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sums = None, None

        def close() -> pa.RecordBatch:
            n = len(head["doc_ids"])
            cols = [pa.array(head["doc_ids"], pa.int64()), pa.array(head["held"], pa.bool_()), pa.array(head["n_tokens"], pa.int64()), pa.array(head["n_known"], pa.int64()), pa.array(np.full(n, n_train)), pa.array(head["base"], pa.float64()), pa.array(sums)]
            return pa.record_batch(cols, names=[x.split()[0] for x in RESULT.split(", ")])

        for b in batches:
            for i in range(b.num_rows):
                if b.column("kind")[i].as_py() == 0:
                    if head is not None:
                        yield close()
                    head = {k: b.column(k)[i].as_py() for k in ("doc_ids", "held", "n_tokens", "n_known", "base")}
                    sums = np.zeros(len(head["doc_ids"]))
                at = b.column("at")[i].values.to_numpy()
                sums[at] += b.column("value")[i].values.to_numpy()
        if head is not None:
            yield close()

    return run


def score(docs: DataFrame, mod: int = 7, rest: int = 2, folder: str | None = None, order: int = 3) -> DataFrame:
    """RESULT for every row; rows whose crc32(id) mod ``mod`` is ``rest`` are not learned from.

    ``order`` is the longest that a token is looked up in: 3, 2 or 1 words. The model
    stays in ``folder``: triples, pairs and backoff by owner, pairs of frequent words
    by word and range, and the ranked vocabulary.
    """
    spark = docs.sparkSession
    folder = folder or common.work_dir(spark, "katz")
    chunks = common.saved(common.texts(docs).mapInArrow(_chunks(mod, rest), CHUNK), f"{folder}/chunks")
    vocab = vocabulary(chunks, folder)
    steps = vocab.groupBy("c").agg(F.min("gid").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # at most sqrt(2N) rows
    steps.sort(key=lambda r: r.first)
    words = sum(r.n for r in steps)
    if words >= UNKNOWN:
        raise ValueError(f"{words} different words: their numbers have 32 bits")
    ends = chunks.select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.sum("n")).first()[0] or 0
    uni = Unigrams(np.array([r["first"] for r in steps], np.int64), np.array([r.c for r in steps], np.int64), words, ends)
    each = chunks.select("chunk", F.posexplode("words").alias("pos", "word"))
    numbers = each.join(vocab.select("word", "gid"), "word", "left").select("chunk", "pos", "gid")
    numbers = numbers.repartition(common.partitions(spark), "chunk").sortWithinPartitions("chunk", "pos")
    numbers.mapInArrow(_write_numbers(folder), "done int").write.mode("overwrite").parquet(f"{folder}/numbered")
    owners = common.owner_keys(spark, common.partitions(spark))
    # middle words with more than half an owner's share of all tokens; word numbers rise as counts fall
    limit = uni.n / (2 * len(owners))
    hot = 1 + sum(r.n for r in steps if r.c > limit)
    slim = chunks.select("chunk", "tokens", "lengths", "held")
    segments = common.saved(slim.mapInArrow(_segments(folder, owners, hot), SEGMENT), f"{folder}/placed")
    owned = segments.repartition(len(owners), "owner")
    counted = common.saved(owned.mapInArrow(_count(folder, hot), COUNTED), f"{folder}/counted")
    spread = counted.filter(F.col("kind") == FREQUENT).repartition(common.partitions(spark), "id", "span").sortWithinPartitions("id", "span")
    frequent = common.saved(spread.mapInArrow(_frequent(folder, uni), HOT), f"{folder}/met")
    plain = counted.filter(F.col("kind") != FREQUENT).select("kind", "id", "n").unionByName(frequent.filter(F.col("kind") != FREQUENT).select("kind", "id", "n"))
    seen = {(r.kind, r.id): r["sum(n)"] for r in plain.groupBy("kind", "id").agg(F.sum("n")).collect()}  # 12 rows
    d2, d3 = (discounts({r: n for (k, r), n in seen.items() if k == kind}) for kind in (PAIRS, TRIPLES))
    left = [F.sum(F.get("left", F.lit(i))).alias(f"l{i}") for i in range(DISCOUNTED)]
    # a row a frequent word, at most 1 + 2 x owners, with its ranges
    sums = frequent.filter(F.col("kind") == FREQUENT).groupBy("id").agg(F.sum("n").alias("n"), F.sum("uni").alias("uni"), F.collect_list("span").alias("spans"), *left).collect()
    by_word = {}
    for r in sums:
        total, alpha = backoff(np.array([r.n]), np.array([[r[f"l{i}"] for i in range(DISCOUNTED)]]), np.array([r.uni]), d2)
        by_word[r.id] = (float(total[0]), float(alpha[0]), sorted(r.spans))
    parts = segments.repartition(len(owners), "owner").mapInArrow(_score(folder, uni, d2, d3, by_word, order), PART)
    stats = chunks.select("chunk", "tokens", "lengths", "held", "doc_ids").mapInArrow(_stats(folder, uni), PART)
    met = stats.unionByName(parts).repartition(common.partitions(spark), "chunk").sortWithinPartitions("chunk", "kind")
    return met.mapInArrow(_gather(uni.n), RESULT)


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to 6 places: sums of the same numbers in another order differ beyond."""
    out = score(common.table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def _sql() -> str:
    """The whole model in DuckDB SQL: counts of three orders, discounts, back-off weights, and the three cases from the lowest order up."""
    orders = []
    keys = {1: [], 2: ["b"], 3: ["a", "b"]}
    for k, h in keys.items():
        by = ", ".join([*h, "c"])
        cuts = " UNION ALL ".join(
            f"SELECT {m} AS k, ({m + 1} * max(m) FILTER (WHERE n = {m + 1})) / (max(m) FILTER (WHERE n = 1))::DOUBLE AS cut, "
            f"count(*) FILTER (WHERE n <= {m + 1}) = {m + 1} AS whole FROM seen{k}"
            for m in range(1, DISCOUNTED + 1)
        )
        orders.append(f"""count{k} AS MATERIALIZED (SELECT {by}, count(*) AS n FROM train{" WHERE b <> ''" if k == 3 else ""} GROUP BY ALL),
seen{k} AS MATERIALIZED (SELECT n, count(*) AS m FROM count{k} GROUP BY n),
cuts{k} AS ({cuts}),
factors{k} AS (SELECT k, s.n, ((s.n + 1) * t.m / (s.n * s.m)::DOUBLE - cut) / (1 - cut) AS f FROM cuts{k} JOIN seen{k} s ON s.n <= k JOIN seen{k} t ON t.n = s.n + 1 WHERE whole AND cut < 1),
best{k} AS (SELECT max(k) AS k FROM (SELECT k FROM factors{k} GROUP BY k HAVING min(f) > 0 AND max(f) < 1)),
d{k} AS MATERIALIZED (SELECT n, f FROM factors{k} JOIN best{k} USING (k) UNION ALL SELECT 1, 0.5 FROM best{k} WHERE k IS NULL),
cut{k} AS MATERIALIZED (SELECT c.*, c.n * coalesce(f, 1.0) AS kept FROM count{k} c LEFT JOIN d{k} USING (n))""")
        if k == 1:
            orders.append("total1 AS (SELECT CASE WHEN sum(n) - sum(kept) > 1e-9 THEN sum(n) ELSE sum(n) + 1 END AS total, sum(kept) AS kept, sum(n) AS big, count(*) AS v FROM cut1)")
            orders.append("p1 AS MATERIALIZED (SELECT c, kept / total AS p FROM cut1, (SELECT total FROM total1))")
            continue
        low = ", ".join(["c", *h[1:]])
        mass = f"""SELECT {', '.join(h)}, sum(n) AS n, sum(n) - sum(kept) AS freed, sum(p) AS lower FROM cut{k} JOIN p{k - 1} USING ({low}) GROUP BY ALL"""
        orders.append(f"""history{k} AS MATERIALIZED (SELECT {', '.join(h)}, CASE WHEN freed > 1e-9 THEN n ELSE n + 1 END AS total,
  CASE WHEN freed > 1e-9 THEN freed / n ELSE 1 / (n + 1)::DOUBLE END / (1 - lower) AS alpha FROM ({mass}))""")
        orders.append(f"p{k} AS MATERIALIZED (SELECT {by}, kept / total AS p FROM cut{k} JOIN history{k} USING ({', '.join(h)}))")
    return f"""
WITH texts AS MATERIALIZED (SELECT doc_id, crc32 % 7 = 2 AS held_out, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+'), ['']) AS w FROM (SELECT *, {_CRC} AS crc32 FROM documents)),
tokens AS MATERIALIZED (SELECT doc_id, held_out, CASE WHEN i > 2 THEN w[i - 2] ELSE '' END AS a, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS b, w[i] AS c
  FROM texts, unnest(range(1, len(w) + 1)) AS t(i)),
train AS (SELECT a, b, c FROM tokens WHERE NOT held_out),
{", ".join(orders)},
scored AS (SELECT t.doc_id, t.held_out, coalesce(n1.n, 0) AS n, coalesce(p3.p, coalesce(h3.alpha, 1) * coalesce(p2.p, coalesce(h2.alpha, 1) * coalesce(p1.p, 1 - total1.kept / total1.total))) AS p, big, v
  FROM tokens t CROSS JOIN total1 LEFT JOIN count1 n1 ON t.c = n1.c LEFT JOIN p1 ON t.c = p1.c LEFT JOIN p2 ON t.b = p2.b AND t.c = p2.c LEFT JOIN history2 h2 ON t.b = h2.b
  LEFT JOIN p3 ON t.a = p3.a AND t.b = p3.b AND t.c = p3.c LEFT JOIN history3 h3 ON t.a = h3.a AND t.b = h3.b)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE n > 0) AS n_known, max(big)::BIGINT AS train_tokens,
  round(sum(log10((n + 1) / (big + 1 * (v + 1))::DOUBLE)), 6) AS base_score, round(sum(log10(p)), 6) AS score FROM scored GROUP BY doc_id, held_out"""


#: CRC-32 of the id as text, bit by bit: eight steps a byte, of 20 bytes at most.
_CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substring(doc_id::VARCHAR, i, 1))::BIGINT)), "
    "lambda x, y: list_reduce(list_concat([xor(x, y)], range(0, 8)), lambda z, k: xor(z >> 1, CASE WHEN z % 2 = 1 THEN 3988292384 ELSE 0 END))))"
)
SQL = _sql()
