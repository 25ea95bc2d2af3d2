"""SimHash near-duplicates found through Golay-code keys.

Fingerprint: 64 bits; bit b is set if more than half of the XXH64 hashes (seed
42) of the text's word shingles, repeats included, have it set. Shorter texts
are one shingle; texts without words have fingerprint zero.

Search for pairs within 4 bits: the fingerprint is cut into segments of 22, 21
and 21 bits, each read as a word of the perfect (23, 12) Golay code. Of 4 errors
over three segments, either a segment has none, which the segment itself finds
as a key, or two segments have one each. For such a pair of segments, one side
gives the index of the codeword it decodes to (distance 3 at most), the other
those of all codewords within distance 4, about 5 a segment; the codeword of one
side is then among those of the other. Keys meet by sort, candidates are
verified by bit count, and each key's group gives only the links of a spanning
forest: no pair lists, no cap. Groups are of distinct fingerprints; copies of a
text share one.

Links become classes by alternating large-star and small-star steps over
written tables. The hub of a large class and the fingerprint of a large group of
copies are joined by broadcast, at most 8 a task, and so are not dealt to one.

Null text is empty; very long texts are hashed whole. Repeated rows stay repeated;
ties (equal counts of a bit) leave it unset. Null ids never name a class unless it has
no other. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import common

SHINGLE, SEED, BITS = 4, 42, 4
#: (shift, bits) of the segments.
SEGMENTS = [(42, 22), (21, 21), (0, 21)]
PAIRS = [(0, 1), (0, 2), (1, 2)]
#: Generator polynomial of the (23, 12) Golay code.
GOLAY = 0b101011100011
_BIT_TABLE = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.int64)


# ---- fingerprints --------------------------------------------------------------
def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False)) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    cells, out = hashes.view(np.uint8).reshape(-1, 8), 0
    for byte in range(8):
        ones = np.bincount(cells[:, byte], minlength=256) @ _BIT_TABLE
        out |= sum(1 << (8 * byte + b) for b in range(8) if 2 * ones[b] > len(hashes))
    return out


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            known: dict[str, int] = {}
            for t in part.column("text").to_pylist():
                if t not in known:
                    known[t] = fingerprint(common.words_of(t), size)
            made = np.array([known[t] for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([part.column("doc_id"), pa.array(made)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row."""
    return common.texts(docs).mapInArrow(_fingerprints(size), "doc_id long, fp long")


# ---- keys ------------------------------------------------------------------------
@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(remainder of the upper 12 bits, coset leader, error patterns by syndrome, their starts)."""

    def rest(v: int) -> int:
        for b in range(22, 10, -1):
            if v >> b & 1:
                v ^= GOLAY << (b - 11)
        return v

    upper = np.array([rest(m << 11) for m in range(4096)], np.int64)
    one = [rest(1 << b) for b in range(23)]
    found: list[list[tuple[int, int]]] = [[] for _ in range(2048)]

    def add(first: int, weight: int, error: int, syndrome: int) -> None:
        found[syndrome].append((weight, error))
        if weight < 4:
            for b in range(first, 23):
                add(b + 1, weight + 1, error | 1 << b, syndrome ^ one[b])

    add(0, 0, 0, 0)
    leader = np.array([min(x)[1] for x in found], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return upper, leader, np.array([e for x in found for _, e in x], np.int64), starts


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, index) of every codeword within distance 4 of each 23-bit word."""
    upper, _, errors, starts = _golay()
    syndrome = (words & 2047) ^ upper[words >> 11]
    counts = (starts[1:] - starts[:-1])[syndrome]
    at = np.repeat(np.arange(len(words)), counts)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return at, (words[at] ^ errors[starts[syndrome[at]] + inside]) >> 11


def decoded(words: np.ndarray) -> np.ndarray:
    upper, leader, _, _ = _golay()
    return (words ^ leader[(words & 2047) ^ upper[words >> 11]]) >> 11


#: Sides of a key: gives one index, gives many, or both (whole segments).
ONE, MANY, BOTH = 1, 2, 3


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position of the fingerprint, side) of all keys."""
    u = fps.view(np.uint64)
    segs = [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    base = np.arange(len(u))
    keys, at, side = [], [], []
    for k, seg in enumerate(segs):
        keys.append((k << 32) | seg)
        at.append(base)
        side.append(np.full(len(u), BOTH, np.int8))
    lists = [near_indices(seg) for seg in segs]
    for k, (i, j) in enumerate(PAIRS, 3):
        keys.append((k << 32) | (decoded(segs[i]) << 12) | decoded(segs[j]))
        at.append(base)
        side.append(np.full(len(u), ONE, np.int8))
        # all combinations of the two lists of each fingerprint
        (pi, ci), (pj, cj) = lists[i], lists[j]
        n_j, first_j = np.bincount(pj, minlength=len(u)), np.searchsorted(pj, base)
        reps = n_j[pi]
        left = np.repeat(np.arange(len(pi)), reps)
        right = first_j[pi[left]] + np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
        keys.append((k << 32) | (ci[left] << 12) | cj[right])
        at.append(pi[left])
        side.append(np.full(len(left), MANY, np.int8))
    return np.concatenate(keys), np.concatenate(at), np.concatenate(side)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for start in range(0, len(fps), 20_000):
            some = fps[start : start + 20_000]
            key, at, side = keys_of(np.ascontiguousarray(some))
            yield pa.record_batch([pa.array(key), pa.array(some[at]), pa.array(side)], names=["key", "fp", "side"])


# ---- links ---------------------------------------------------------------------------
def forest(nodes: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest over all pairs of nodes within ``bits``; the matrix is never held whole."""
    left, out = nodes.view(np.uint64), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            new_front = []
            for start in range(0, len(front), 256):
                block = front[start : start + 256]
                near = np.zeros(len(left), bool)
                parent = np.zeros(len(left), np.int64)
                for lo in range(0, len(left), 65_536):
                    hit = np.bitwise_count(block[:, None] ^ left[None, lo : lo + 65_536]) <= bits
                    any_hit = hit.any(0)
                    near[lo : lo + 65_536] = any_hit
                    parent[lo : lo + 65_536] = hit.argmax(0)
                if near.any():
                    reached = left[near]
                    out.append((block[parent[near]].view(np.int64), reached.view(np.int64)))
                    new_front.append(reached)
                    left = left[~near]
                if not len(left):
                    break
            front = np.concatenate(new_front) if new_front else left[:0]
    return out


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its class) for the classes that links (x, y) make, without the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b, label = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _links(bits: int, big: int = 200_000):
    def pairs(key: np.ndarray, fp: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links among whole key groups, sorted by key."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        group = np.repeat(np.arange(len(starts)), sizes)
        ones, many = (side & ONE) > 0, (side & MANY) > 0
        n_one, n_many = np.bincount(group[ones], minlength=len(starts)), np.bincount(group[many], minlength=len(starts))
        heavy = n_one * n_many > big
        for g in np.flatnonzero(heavy):
            yield from forest(np.unique(fp[starts[g] : starts[g] + sizes[g]]), bits)
        fair = ~heavy & (n_one > 0) & (n_many > 0)
        one_at, many_at = np.flatnonzero(ones & fair[group]), np.flatnonzero(many & fair[group])
        if not len(one_at):
            return
        first = np.searchsorted(group[many_at], np.arange(len(starts)))
        reps = n_many[group[one_at]]
        for lo, hi in _cut(reps, 4_000_000):
            r = reps[lo:hi]
            a = np.repeat(one_at[lo:hi], r)
            b = many_at[np.repeat(first[group[one_at[lo:hi]]], r) + np.arange(len(a)) - np.repeat(np.cumsum(r) - r, r)]
            x, y = fp[a], fp[b]
            ok = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= bits)
            yield x[ok], y[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for x, y in pairs(*cols):
                if len(x):
                    yield pa.record_batch([pa.array(c) for c in spanning(x, y)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "side")])
            if held[0][0][0] == held[-1][0][-1]:
                continue  # still one key
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = np.searchsorted(cols[0], cols[0][-1])
            yield from flush([c[:last] for c in cols])
            held = [[c[last:] for c in cols]]
        if held:
            yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most, "right")))
        yield start, end
        start = end


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v), u > v: enough of the pairs within ``bits`` (at most 4) to connect all that are connected."""
    if not 0 <= bits <= 4:
        raise ValueError("the segment keys find up to 4 errors")
    spark = nodes.sparkSession
    keys = nodes.select("fp").mapInArrow(_keys, "key long, fp long, side byte")
    met = keys.repartition(common.partitions(spark), "key").sortWithinPartitions("key")
    return met.mapInArrow(_links(bits), "u long, v long").distinct()


# ---- classes ---------------------------------------------------------------------------
def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of all nodes with an edge; the root is the smallest node of the class.

    Large-star and small-star in turn, each over written tables, until nothing
    changes; the number of rounds grows with the logarithm of the longest path.
    The links of a hub are not dealt to one task (``common.joined``).
    """

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()

    e = common.saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/edges-0")
    seen, n = mark(e), 0
    while seen.n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        upward = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        n += 1
        large = common.joined(upward, least, "u", seen.n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.saved(large, f"{folder}/large-{n}")
        lows = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = common.joined(large, lows, "u", seen.n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.saved(small.unionByName(lows.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/edges-{n}")
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def named(rows: DataFrame, nodes: DataFrame, roots: DataFrame, key: str, folder: str) -> DataFrame:
    """The rows with component_id, the smallest id of the class of their node.

    ``nodes`` has key, least and n (how many of the rows) for every node, ``roots``
    (node, root) for those that are linked.
    """
    placed = nodes.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    placed = common.saved(placed.withColumnRenamed("n", "rows"), f"{folder}/placed")
    tops = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    said = common.joined(placed, tops, "root", placed.count()).select(key, "component_id", F.col("rows").alias("n"))
    return common.joined(rows, common.saved(said, f"{folder}/named"), key, rows.count())


def classes(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    spark = docs.sparkSession
    folder = common.work_dir(spark, "simhash")
    fps = common.saved(fingerprints(docs, size), f"{folder}/fingerprints")
    nodes = common.saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), f"{folder}/nodes")
    return named(fps, nodes, components(links(nodes, bits), folder), "fp", folder)


def keep_one(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` whose id names their class: one document of each group."""
    kept = classes(docs, size, bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- SQL ---------------------------------------------------------------------------------
# The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _sql() -> str:
    """The whole result in DuckDB SQL: XXH64 of every distinct shingle in 128-bit arithmetic, all pairs of fingerprints, and their closure."""
    num = lambda x: f"{x % (1 << 64)}::UHUGEINT"
    cut = lambda x: f"(({x}) & {num(-1)})"
    times = lambda x, p: cut(f"{x} * {num(p)}")
    turned = lambda x, r: cut(f"(({x}) << {r}) | (({x}) >> {64 - r})")
    #: Bytes o .. o + n as a little-endian number; r has the bytes of the shingle from the last to the first.
    lane = lambda o, n: f"('0x' || substring(r, 2 * (l - ({o}) - {n}) + 1, {2 * n}))::UBIGINT::UHUGEINT"
    stripe = lambda k, seed: turned(cut(f"{seed} + " + times(lane(f"o + {8 * k}", 8), P2)), 31) + f" * {num(P1)}"
    mixed_in = lambda h, v: f"xor({h}, " + times(turned(times(v, P2), 31), P1) + ")"
    starts = [SEED + P1 + P2, SEED + P2, SEED, SEED - P1]
    steps, h, source = [], "h", "begun"

    def step(name: str, made: str, when: str, moved: int) -> None:
        nonlocal source
        steps.append(f"{name} AS MATERIALIZED (SELECT g, r, l, CASE WHEN {when} THEN {made} ELSE h END AS h, o + CASE WHEN {when} THEN {moved} ELSE 0 END AS o FROM {source})")
        source = name

    merged = "+".join(turned(f"v{k + 1}", r) for k, r in enumerate((1, 7, 12, 18)))
    merges = []
    for k in range(4):
        merges.append(f"m{k} AS MATERIALIZED (SELECT * EXCLUDE (h), {cut(times(mixed_in('h', f'v{k + 1}'), P1) + ' + ' + num(P4))} AS h FROM {f'm{k - 1}' if k else 'summed'})")
    for k in range(3):
        step(f"eight{k}", cut(times(turned(f"xor({h}, " + times(turned(times(lane("o", 8), P2), 31), P1) + ")", 27), P1) + f" + {num(P4)}"), "o + 8 <= l", 8)
    step("four", cut(times(turned(f"xor({h}, " + times(lane("o", 4), P1) + ")", 23), P2) + f" + {num(P3)}"), "o + 4 <= l", 4)
    for k in range(3):
        step(f"one{k}", times(turned(f"xor({h}, " + times(lane("o", 1), P5) + ")", 11), P1), "o < l", 1)
    falls = [("f1", f"xor(h, h >> 33)"), ("f2", times("h", P2)), ("f3", "xor(h, h >> 29)"), ("f4", times("h", P3)), ("f5", "xor(h, h >> 32)")]
    for name, made in falls:
        steps.append(f"{name} AS (SELECT g, {made} AS h FROM {source})")
        source = name
    bits = ", ".join(f"sum(n * ((h >> {b}) & 1::UBIGINT)::BIGINT) AS b{b}" for b in range(64))
    total = " + ".join(f"CASE WHEN 2 * b{b} > shingles THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
    return f"""
WITH RECURSIVE lists AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: {" || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE))}) END) AS g FROM lists) GROUP BY ALL),
bytes AS MATERIALIZED (SELECT g, reverse(regexp_replace(hex(encode(g)), '(.)(.)', '\\2\\1', 'g')) AS r, octet_length(encode(g)) AS l FROM (SELECT DISTINCT g FROM grams)),
stripes AS (SELECT g, r, l, 0 AS o, {", ".join(f"{num(s)} AS v{k + 1}" for k, s in enumerate(starts))} FROM bytes WHERE l >= 32
  UNION ALL SELECT g, r, l, o + 32, {", ".join(cut(stripe(k, f"v{k + 1}")) for k in range(4))} FROM stripes WHERE o + 32 <= l),
summed AS MATERIALIZED (SELECT *, {cut(merged)} AS h FROM stripes WHERE o + 32 > l),
{", ".join(merges)},
begun AS MATERIALIZED (SELECT g, r, l, {cut("h + l::UHUGEINT")} AS h, o FROM m3 UNION ALL SELECT g, r, l, {cut(num(SEED + P5) + " + l::UHUGEINT")}, 0 FROM bytes WHERE l < 32),
{", ".join(steps)},
hashed AS MATERIALIZED (SELECT g, h::UBIGINT AS h FROM {source}),
counted AS MATERIALIZED (SELECT doc_id, sum(n) AS shingles, {bits} FROM grams JOIN hashed USING (g) GROUP BY doc_id),
prints AS MATERIALIZED (SELECT doc_id, coalesce({total}, 0::UBIGINT) AS fp FROM documents LEFT JOIN counted USING (doc_id)),
nodes AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
links AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON bit_count(xor(a.fp, b.fp)::HUGEINT) <= {BITS}),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS fp, min(least) AS component_id FROM reach JOIN nodes ON b = fp GROUP BY a)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN named USING (fp)"""


SQL = _sql()
