"""Near-duplicates of similarity 0.8 or more by wide SimHash and Golay indices.

The similarity is that of Jaccard over the sets of five-word shingles, repeats
not counted; a text of fewer words is one shingle. The 64 bits and 4 errors of the
narrow fingerprint reach only texts that are almost equal. Here a text has 512
bits over its set. Texts with a similarity of 0.8 differ in about 77 bits, with a
standard deviation of 8, unrelated ones in about 256. Texts within ``REACH`` are
candidates.

Search: 44 segments of 23 bits, 22 of the bits in order and 22 of them shuffled,
are decoded to the nearest codeword of the perfect Golay code. Its 12-bit index
absorbs errors: at 15 % of errors two texts agree in an eighth of their indices,
unrelated ones in 1 of 4096. Rows meet by segment and index. Sets of up to
``SHORT`` shingles, whose distances vary most, meet by shingles too: two of
similarity 0.8 have one of the first fifth of either set, in the order of the
hashes, in common. Large groups give the links of a spanning forest instead of
pairs; none is capped. A group of over ``CROWD`` texts that is also ``CROWDED`` times
as large as groups are on average, such as copies of one text, is taken as one
candidate as it streams by: what does not belong together is divided later.

What candidates connect is divided again by the similarity of the sets, one text a
node: only links of ``SIMILARITY`` or more make classes. It comes together in one
task up to ``BLOCK`` bytes of sets; beyond, it is cut into blocks of that size, which
are divided each. Then a few members of the largest classes are compared with all
blocks, which joins what a large group of copies fell into; and whatever is still
outside the largest class of its group is compared with all blocks, too. So every
pair is compared or known to be connected, and no task holds more than two blocks.

Texts of equal sets are one node, so copies cost nothing. Null text is empty;
texts without words are all alike. Very long texts are taken whole. Repeated rows
stay repeated, and a similarity of just 0.8 links; null ids, other columns and empty
tables are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import common, simhash

SHINGLE, LANES, SEED, LARGE = 5, 8, 42, 256
SIMILARITY, REACH, SHORT = 0.8, 110, 24
BLOCK, SPEAKERS = 32 << 20, 8
CROWD, CROWDED = 65_536, 16
#: Bits of the segments, 23 each: all in order, then shuffled.
ORDER = np.concatenate([np.arange(22 * 23), np.random.default_rng(7).permutation(512)[: 22 * 23]])
SEGMENTS = len(ORDER) // 23


# ---- fingerprints ------------------------------------------------------------------
def sets_of(texts: list[str]) -> list[np.ndarray]:
    """The hashes of the distinct shingles of each text, sorted."""
    out = []
    for text in texts:
        w = common.words_of(text)
        grams = map(b" ".join, zip(*[w[i:] for i in range(SHINGLE)], strict=False)) if len(w) >= SHINGLE else [b" ".join(w)] if w else []
        out.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)))
    return out


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """(text, lane) fingerprints of 64 bits a lane: a bit is set if over half the texts' distinct shingles have it."""
    return wide_of(sets_of(texts))


def wide_of(hashes: list[np.ndarray]) -> np.ndarray:
    texts, counts = hashes, [len(x) for x in hashes]
    h, n = np.concatenate(hashes), np.array(counts)
    place = np.repeat(np.arange(len(texts)) * 256, n)
    out = np.zeros((len(texts), LANES), np.uint64)
    for lane in range(LANES):
        with np.errstate(over="ignore"):
            z = h + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        cells = z.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            seen = np.bincount(place + cells[:, byte], minlength=256 * len(texts)).reshape(-1, 256)
            bits = (2 * (seen @ simhash._BIT_TABLE) > n[:, None]).astype(np.uint64)
            out[:, lane] |= (bits << (np.uint64(8 * byte) + np.arange(8, dtype=np.uint64))).sum(1, dtype=np.uint64)
    return out


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, most=4 << 20):
        texts = part.column("text").to_pylist()
        known = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        sets = sets_of(list(known))
        wide, nodes = wide_of(sets), [node_of(x) for x in sets]
        few = [x.tobytes() if len(x) <= SHORT else b"" for x in sets]
        at = [known[t] for t in texts]
        cols = [pa.array([nodes[i] for i in at], pa.int64()), pa.array([wide[i].tobytes() for i in at], pa.binary()), pa.array([few[i] for i in at], pa.binary()), pa.array([sets[i].nbytes for i in at], pa.int64())]
        yield pa.record_batch([part.column("doc_id"), *cols], names=["doc_id", "node", "wide", "few", "size"])


def _sets(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            some = batch.filter(pa.array(marks.value[place >> 3] >> (place & 7) & 1 > 0))
            for part in common.slices([some], most=4 << 20):
                sets = sets_of(part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "node", "shingles"])

    return run


#: Marks of ids, by their hash: how many, and how many of them a row has on the way to the driver.
MARKS, STRETCH = 1 << 24, 1 << 15


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        place = batch.column("place").to_numpy()
        for k in np.unique(place // STRETCH).tolist():
            found.setdefault(k, np.zeros(STRETCH, bool))[place[place // STRETCH == k] % STRETCH] = True
    rows = [(k, np.packbits(x, bitorder="little").tobytes()) for k, x in found.items()]
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["stretch", "bits"])


def sets_of_some(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, node, shingles) of the rows with these ids and some others: those whose hash is marked among ``MARKS`` bits.

    The marks are 2 MB, whatever the number of ids, and go to every task, so that
    few sets are made and shuffled; with tens of millions of ids they rule out less.
    """
    spark = rows.sparkSession
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).alias("place")
    places = ids.select(place).distinct().repartition(common.partitions(spark), F.floor(F.col("place") / STRETCH))
    marks = np.zeros(MARKS // 8, np.uint8)
    for r in places.mapInArrow(_marked, "stretch long, bits binary").collect():
        marks[r.stretch * STRETCH // 8 : (r.stretch + 1) * STRETCH // 8] |= np.frombuffer(r.bits, np.uint8)
    asked = rows.select("doc_id", "text", place)
    return asked.mapInArrow(_sets(spark.sparkContext.broadcast(marks)), "doc_id long, node long, shingles binary")


# ---- candidates ----------------------------------------------------------------------
def indices_of(wide: np.ndarray) -> np.ndarray:
    """(node, segment) Golay indices."""
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")[:, ORDER]
    words = bits.reshape(len(wide), SEGMENTS, 23).astype(np.int64) @ (1 << np.arange(23))
    return simhash.decoded(words.reshape(-1)).reshape(len(wide), SEGMENTS)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a segment, keyed by segment and index."""
    for batch in batches:
        for start in range(0, batch.num_rows, 10_000):
            some = batch.slice(start, 10_000)
            index = indices_of(_matrix(some.column("wide").to_pylist()))
            for s in range(SEGMENTS):
                yield pa.record_batch([pa.array((s << 12 | index[:, s]).astype(np.int32)), some.column("node"), some.column("wide")], names=["key", "node", "wide"])


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint64).reshape(-1, LANES)


def close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether rows are within ``bits``. The first three lanes alone rule out nearly all that are not."""
    out = np.bitwise_count(a[..., :3] ^ b[..., :3]).sum(-1, dtype=np.int64) <= bits
    at = np.flatnonzero(out)
    a, b = np.broadcast_arrays(a, b)
    out[at] = np.bitwise_count(a[at] ^ b[at]).sum(-1, dtype=np.int64) <= bits
    return out


def forest(wide: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (reached from, reached) of a spanning forest over all pairs within ``bits``."""
    left = np.arange(len(wide))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for f in front:
                near = close(wide[f][None, :], wide[left], bits)
                if near.any():
                    reached.append(left[near])
                    yield np.full(int(near.sum()), f), left[near]
                    left = left[~near]
                if not len(left):
                    break
            front = np.concatenate(reached) if reached else left[:0]


def pairs_within(key: np.ndarray, wide: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked rows among whole key groups, sorted by key."""
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    for g in np.flatnonzero(sizes > LARGE):
        for a, b in forest(wide[starts[g] : starts[g] + sizes[g]], bits):
            yield starts[g] + a, starts[g] + b
    end = np.repeat(np.where(sizes <= LARGE, starts + sizes, 0), sizes)
    for k in range(1, LARGE):
        at = np.flatnonzero(np.arange(len(key)) + k < end)
        if not len(at):
            break
        ok = at[close(wide[at], wide[at + k], bits)]
        yield ok, ok + k


def _links(bits: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # all of one key, but for the first batch after a flush
        crowded, first = None, None  # the key of a crowd that streams by, and its first node

        def star(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column("node"), pa.array(np.full(batch.num_rows, first))], names=["u", "v"])

        def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows)
            node = table.column("node").to_numpy()
            found = list(pairs_within(table.column("key").to_numpy(), _matrix(table.column("wide").to_pylist()), bits))
            if sum(len(a) for a, _ in found):
                a, b = (np.concatenate(c) for c in zip(*found, strict=True))
                made = simhash.spanning(node[a], node[b])  # what connects the groups, not their pairs
                yield pa.record_batch([pa.array(c) for c in made], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            if crowded is not None:
                end = int(np.searchsorted(keys, crowded, "right"))
                yield star(batch.slice(0, end))
                if end == len(keys):
                    continue
                batch, keys, crowded = batch.slice(end), keys[end:], None
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if last:
                yield from flush([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            elif held and held[-1].column("key")[0].as_py() != keys[0]:
                yield from flush(held)
                held = [batch]
            else:
                held.append(batch)
            if sum(b.num_rows for b in held) > crowd and held[0].column("key")[0].as_py() == keys[-1]:
                crowded, first = int(keys[-1]), held[0].column("node")[0].as_py()
                yield from map(star, held)
                held = []
        if held:
            yield from flush(held)

    return run


def links(nodes: DataFrame, bits: int = REACH, crowd: int = CROWD) -> DataFrame:
    """(u, v) that connect nodes (node long, wide binary) that are candidates."""
    crowd = max(crowd, CROWDED * nodes.count() // 4096)
    rows = nodes.select("node", "wide").mapInArrow(_spread, "key int, node long, wide binary")
    met = rows.repartition(common.partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return met.mapInArrow(_links(bits, crowd), "u long, v long").filter("u <> v").distinct()


# ---- short texts -----------------------------------------------------------------------
def _first_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, node, few = [], [], []
        for n, x in zip(batch.column("node").to_pylist(), batch.column("few").to_pylist(), strict=True):
            size = len(x) // 8
            some = np.frombuffer(x, np.int64)[: size - int(np.ceil(SIMILARITY * size - 1e-9)) + 1] if size else ()
            key.extend(some)
            node.extend([n] * len(some))
            few.extend([x] * len(some))
        yield pa.record_batch([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(few, pa.binary())], names=["key", "node", "few"])


def divided(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The first member of each set's class, where links are pairs of ``similarity`` or more.

    Members are found from one another; what is found leaves the search, so sets that are alike cost one pass.
    """
    root, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    terms, at = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, int))
    owner = np.repeat(np.arange(len(sets)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(at, kind="stable")
    holders, term = owner[order], at[order]
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    left, n_left, indexed = np.ones(len(sets), bool), len(sets), len(sets)
    for r in range(len(sets)):
        if not left[r]:
            continue
        left[r], front = False, [r]
        n_left -= 1
        while front and n_left:
            if 2 * n_left < indexed:  # what has left the search leaves the index too
                holders, term, indexed = holders[left[holders]], term[left[holders]], n_left
                start = np.searchsorted(term, np.arange(len(terms) + 1))
            f = front.pop()
            mine = at[first[f] : first[f + 1]]
            # one that is as similar has one of any so many of the shingles: those that the fewest have
            some = mine[np.argsort(start[mine + 1] - start[mine], kind="stable")[: len(mine) - int(np.ceil(similarity * len(mine) - 1e-9)) + 1]]
            near = np.unique(np.concatenate([holders[start[t] : start[t + 1]] for t in some])) if len(some) else np.zeros(0, int)
            near = near[left[near]]
            near = near[(np.minimum(sizes[near], sizes[f]) >= similarity * np.maximum(sizes[near], sizes[f]) - 1e-9)]
            if len(near) > 64:
                counts = np.bincount(np.concatenate([holders[start[t] : start[t + 1]] for t in mine]), minlength=len(sets))[near]
            else:
                counts = np.array([len(np.intersect1d(mine, at[first[o] : first[o + 1]], assume_unique=True)) for o in near.tolist()], int)
            near = near[counts >= similarity * (sizes[f] + sizes[near] - counts) - 1e-9]
            left[near], root[near] = False, r
            n_left -= len(near)
            front.extend(near.tolist())
    return root


def _grouped(key: list[str], made: str):
    """For each whole group of rows, sorted by ``key``: links of its nodes by the similarity of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            nodes = list(held)
            if len(nodes) < 2:
                return
            root = divided([np.frombuffer(held[n], np.uint64) for n in nodes])
            rest = np.flatnonzero(root != np.arange(len(root)))
            if len(rest):
                nodes = np.array(nodes)
                yield pa.record_batch([pa.array(nodes[rest]), pa.array(nodes[root[rest]])], names=["u", "v"])

        for batch in batches:
            for *k, n, x in zip(*[batch.column(c).to_pylist() for c in (*key, "node", made)], strict=True):
                if k != now:
                    yield from flush()
                    now, held = k, {}
                held[n] = x
        yield from flush()

    return run


def short_links(nodes: DataFrame) -> DataFrame:
    """(u, v) that connect all texts of few shingles of ``SIMILARITY`` or more."""
    rows = nodes.filter("few <> X''").select("node", "few").mapInArrow(_first_shingles, "key long, node long, few binary")
    met = rows.repartition(common.partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return met.mapInArrow(_grouped(["key"], "few"), "u long, v long").distinct()


# ---- groups of many blocks ---------------------------------------------------------------
class Sets:
    """An index of sets that finds those of ``SIMILARITY`` or more to another one."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(x) for x in sets])
        self.terms, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.holders = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(at, kind="stable")]
        self.start = np.append(0, np.cumsum(np.bincount(at, minlength=len(self.terms))))

    def near(self, x: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
        if not len(self.terms) or not len(x):
            return np.flatnonzero(self.sizes == 0) if not len(x) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, x), len(self.terms) - 1)
        held = np.where(self.terms[at] == x, self.start[at + 1] - self.start[at], 0)
        # one that is as similar has one of any so many of the shingles: those that the fewest have
        some = np.argsort(held, kind="stable")[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1]
        met = [self.holders[self.start[t] : self.start[t + 1]] for t in at[some][held[some] > 0]]
        found = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        found = found[np.minimum(self.sizes[found], len(x)) >= similarity * np.maximum(self.sizes[found], len(x)) - 1e-9]
        if len(found) > 64:
            counts = np.bincount(np.concatenate([self.holders[self.start[t] : self.start[t + 1]] for t in at[held > 0]]), minlength=len(self.sets))[found]
        else:
            counts = np.array([len(np.intersect1d(x, self.sets[o], assume_unique=True)) for o in found.tolist()], int)
        return found[counts >= similarity * (len(x) + self.sizes[found] - counts) - 1e-9]


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of rows sorted by (root, block, part, asks), those that are asked first: (u, v) of the classes that similar sets connect."""
    now, members, index, links = None, [], None, set()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["u", "v"])

    for batch in batches:
        for *key, asks, top, x in zip(*[batch.column(c).to_pylist() for c in ("root", "block", "part", "asks", "top", "shingles")], strict=True):
            if key != now:
                if links:
                    yield out()
                now, members, index, links = key, [], None, set()
            x = np.frombuffer(x, np.uint64)
            if not asks:
                members.append((top, x))
                continue
            if not members:
                continue
            index = index or (np.array([t for t, _ in members]), Sets([y for _, y in members]))
            for other in np.unique(index[0][index[1].near(x)]).tolist():
                if other != top:
                    links.add((max(top, other), min(top, other)))
    if links:
        yield out()


def asked(blocks: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(u, v) of classes connected by a query and a member of a block of its group.

    blocks: (root, block, blocks, top, shingles); queries: (root, node, top, shingles). Queries of a group come in parts
    of ``most`` bytes; a part goes to every block of the group and a block to every part.
    """
    spark = blocks.sparkSession
    loads = queries.groupBy("root").agg(F.sum(F.octet_length("shingles")).alias("load"), F.count(F.lit(1)).alias("m"))
    loads = loads.select("root", F.ceil(F.col("load") / most).cast("int").alias("parts"), "m")
    many = blocks.groupBy("root").agg(F.first("blocks").alias("blocks"), F.count(F.lit(1)).alias("n")).join(loads, "root")
    n, m = blocks.count(), queries.count()
    members = common.joined(blocks.drop("blocks"), many.select("root", "parts", "n"), "root", n)
    members = members.select("root", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "top", "shingles")
    asking = common.joined(queries, many.select("root", "blocks", "parts", F.col("m").alias("n")), "root", m)
    asking = asking.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"), "top", "shingles")
    both = members.unionByName(asking).repartition(common.partitions(spark), "root", "block", "part").sortWithinPartitions("root", "block", "part", "asks")
    return both.mapInArrow(_answered, "u long, v long").filter("u <> v").distinct()


def across(blocks: DataFrame, own: DataFrame, folder: str, most: int) -> DataFrame:
    """(u, v) that connect the classes of the blocks of large groups.

    blocks: (root, block, blocks, node, shingles) of groups of several blocks; own: (u, v), the members and first
    members of the classes inside blocks.
    """

    def labelled(links: DataFrame, name: str) -> DataFrame:
        """The members with ``top``, the class that they are in by these links of classes."""
        tops = simhash.components(links, f"{folder}/{name}").select(F.col("node").alias("first"), F.col("root").alias("top"))
        return common.saved(firsts.join(tops, "first", "left").withColumn("top", F.coalesce("top", "first")), f"{folder}/{name}-tops")

    first = own.select(F.col("u").alias("node"), F.col("v").alias("first"))
    firsts = common.saved(blocks.drop("shingles").join(first, "node", "left").withColumn("first", F.coalesce("first", "node")), f"{folder}/firsts")
    sets = blocks.select("node", "shingles")
    # the first members of the largest classes of the largest blocks speak for these classes
    sizes = firsts.groupBy("root", "block", "first").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("root", "block").agg(F.max(F.struct("n", F.col("first").alias("node"))).alias("x"))
    speakers = largest.groupBy("root").agg(F.slice(F.sort_array(F.collect_list("x"), False), 1, SPEAKERS).alias("xs"))
    speakers = speakers.select("root", F.explode("xs.node").alias("node")).withColumn("top", F.col("node"))
    plain = firsts.withColumn("top", F.col("first")).select("root", "block", "blocks", "node", "top").join(sets, "node")
    spoken = common.saved(asked(plain.drop("node"), speakers.join(sets, "node"), most), f"{folder}/spoken")
    placed = labelled(spoken, "spoken-classes")
    # all but the largest class of each group ask every block
    counts = placed.groupBy("root", "top").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("root").agg(F.max(F.struct("n", "top")).alias("x")).select(F.col("x.top").alias("top"))
    rest = placed.join(main, "top", "left_anti").select("root", "node", "top").join(sets, "node")
    whole = placed.select("root", "block", "blocks", "node", "top").join(sets, "node").drop("node")
    return spoken.unionByName(common.saved(asked(whole, rest, most), f"{folder}/asked"))


# ---- classes -----------------------------------------------------------------------------
def classes(docs: DataFrame, bits: int = REACH, most: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id) for every row; the class is named by its smallest id. ``most`` is the bytes of sets of a block, ``crowd`` the rows of a large group."""
    folder, parts = common.work_dir(docs.sparkSession, "near"), common.partitions(docs.sparkSession)
    rows = common.texts(docs)
    fps = common.saved(rows.mapInArrow(_wide, "doc_id long, node long, wide binary, few binary, size long"), f"{folder}/fingerprints")
    nodes = common.saved(fps.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("wide").alias("wide"), F.first("few").alias("few"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")), f"{folder}/nodes")
    met = simhash.components(links(nodes, bits, crowd).unionByName(short_links(nodes)), f"{folder}/met")
    members = common.saved(nodes.select("node", "least", "size").join(met, "node"), f"{folder}/members")
    loads = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / most), F.lit(1)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    members = common.joined(members, loads, "root", members.count())
    members = members.select(F.col("node").alias("_node"), "least", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    # the set of one row of each node, of those that met any
    sets = sets_of_some(rows, members.select(F.col("least").alias("doc_id")))
    chosen = sets.join(members, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("least")))
    chosen = common.saved(chosen.dropDuplicates(["node"]).select("root", "block", "blocks", "node", "shingles"), f"{folder}/sets")
    blocks = chosen.repartition(parts, "root", "block").sortWithinPartitions("root", "block")
    own = common.saved(blocks.mapInArrow(_grouped(["root", "block"], "shingles"), "u long, v long"), f"{folder}/own")
    roots = own.select(F.col("u").alias("node"), F.col("v").alias("root"))
    large = chosen.filter("blocks > 1")
    if not large.isEmpty():
        small = own.join(large.select(F.col("node").alias("u")), "u", "left_anti").select(F.col("u").alias("node"), F.col("v").alias("root"))
        met = own.join(large.select(F.col("node").alias("u")), "u", "left_semi").unionByName(across(large, own, folder, most))
        roots = small.unionByName(common.saved(simhash.components(met, f"{folder}/large"), f"{folder}/large-roots"))
    return simhash.named(fps.select("doc_id", "node"), nodes.select("node", "least", "n"), roots, "node", folder).drop("node")


def keep_one(docs: DataFrame, bits: int = REACH) -> DataFrame:
    """The rows of ``docs`` whose id names their class: one document of each group."""
    kept = classes(docs, bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k._kept")), "left_semi")
