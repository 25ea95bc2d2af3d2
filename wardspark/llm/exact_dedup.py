"""Exact deduplication by an extendible-hash index on shared files.

1. Bytes per hash prefix are summed; a directory starts as one bucket and
   doubles until every overfull bucket is split, or until the prefix is used up.
   The directory is a table in the shared folder.
2. Map tasks send each text of a slice of their input once, with its largest id and
   its copies counted; a text of a bucket that could not be split, such as one that
   a third of all rows share, goes out once a task.
3. Owner tasks take ranges of the hash: neighbouring buckets of about equal bytes.
   They stream through the entries sorted by hash, chain different texts of one hash,
   compare bytes, and write a row a text: its chain number, digest, count, and the id
   to keep. Nothing grows with a group.
4. The index has a folder a bucket. ``lookup`` reads it by the directory.
5. Rows learn their group by digest from the index; groups of many rows by
   broadcast, so that no task has them all.

Texts of equal SHA-256 that differ in their bytes are an error. Null text is empty
text; very long texts are entries like others. Repeated rows count in group_size;
every row whose id is the largest of its group is kept, so ties keep all (null ids
are the smallest). Any other columns of the input are ignored. An empty table gives
an empty index and result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import common

PREFIX_BITS = 16
ENTRY = "owner int, bucket int, h long, sha binary, text binary, top long, n long"
INDEX = "bucket int, h long, chain int, sha binary, keep_id long, n long"
DIRECTORY = "bucket int, first int, last int, depth int, bytes long, owner int"
#: Bytes of texts of unsplit buckets that a task holds back to send them once.
HELD = 32 << 20


def directory(loads: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket of every hash prefix: 2^depth equal parts, split while one holds too much."""
    full = int(math.log2(len(loads)))
    sums = [loads.astype(np.int64)]
    while len(sums[0]) > 1:
        sums.insert(0, sums[0].reshape(-1, 2).sum(1))
    out, nxt, todo = np.zeros(len(loads), np.int32), 0, [(0, 0)]
    while todo:
        depth, at = todo.pop()
        if sums[depth][at] > capacity and depth < full:
            todo += [(depth + 1, 2 * at + 1), (depth + 1, 2 * at)]
            continue
        width = 1 << (full - depth)
        out[at * width : (at + 1) * width] = nxt
        nxt += 1
    return out



def _hashes(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))


def _entries(buckets: np.ndarray, owners: np.ndarray, unsplit: np.ndarray, bits: int):
    schema = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("h", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("top", pa.int64()), ("n", pa.int64())])

    def made(groups: dict[bytes, list], hashes: np.ndarray) -> pa.RecordBatch:
        bucket = buckets[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
        tops, counts = zip(*groups.values(), strict=True)
        cols = [owners[bucket], bucket, hashes.view(np.int64), [hashlib.sha256(t).digest() for t in groups], list(groups), tops, counts]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for part in common.slices(batches):
            groups: dict[bytes, list] = {}
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                _add(groups, text, doc_id, 1)
            if not groups:
                continue
            hashes = _hashes(list(groups))
            late = unsplit[buckets[(hashes >> np.uint64(64 - bits)).astype(np.int64)]]
            if late.any():
                for text, wait in zip(list(groups), late.tolist(), strict=True):
                    if wait:
                        size += 0 if text in held else len(text)
                        _add(held, text, *groups.pop(text))
            if groups:
                yield made(groups, hashes[~late])
            if size > HELD:
                yield made(held, _hashes(list(held)))
                held, size = {}, 0
        if held:
            yield made(held, _hashes(list(held)))

    return run


def _add(groups: dict[bytes, list], text: bytes, top: int | None, n: int) -> None:
    """Counts copies of a text and the largest of their ids; null is the smallest."""
    seen = groups.setdefault(text, [top, 0])
    seen[1] += n
    if top is not None and (seen[0] is None or top > seen[0]):
        seen[0] = top


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by bucket and hash in; a row a distinct text out."""
    now, chain, rows = None, {}, []

    def close() -> None:
        digests = {}
        for k, (text, (sha, keep, n)) in enumerate(sorted(chain.items())):
            if digests.setdefault(sha, text) != text:
                raise ValueError("different texts of one SHA-256")
            rows.append((*now, k, sha, keep, n))

    def out() -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    for batch in batches:
        for bucket, h, sha, text, top, n in zip(*[batch.column(c).to_pylist() for c in ("bucket", "h", "sha", "text", "top", "n")], strict=True):
            if (bucket, h) != now:
                if chain:
                    close()
                now, chain = (bucket, h), {}
            # a dict probe by a text compares the bytes of those that fall together
            sha, keep, many = chain.get(text, (sha, None, 0))
            chain[text] = (sha, top if keep is None or (top is not None and top > keep) else keep, many + n)
        if len(rows) > 10_000:
            yield out()
            rows = []
    if chain:
        close()
    if rows:
        yield out()


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the distinct texts of each slice, by hash prefix."""
    for part in common.slices(batches):
        found = list(set(part.column("text").cast(pa.binary()).to_pylist()))
        at = (_hashes(found) >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)
        sums = np.bincount(at, np.array([len(t) for t in found], float), 1 << PREFIX_BITS) if len(at) else np.zeros(0)
        used = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(sums[used].astype(np.int64))], names=["prefix", "size"])


def build_index(docs: DataFrame, folder: str, capacity: int = 4 << 20) -> DataFrame:
    """Writes directory and index (INDEX) below ``folder``; ``capacity`` is the bytes of text a bucket should hold.

    The driver gets at most 2^PREFIX_BITS sums, whatever the size of the input.
    """
    spark = docs.sparkSession
    rows = common.texts(docs)
    loads = np.zeros(1 << PREFIX_BITS, np.int64)
    for r in rows.mapInArrow(_loads, "prefix int, size long").groupBy("prefix").agg(F.sum("size").alias("size")).collect():
        loads[r.prefix] = r["size"]
    capacity = max(capacity, int(loads.sum()) >> (PREFIX_BITS - 2))
    buckets = directory(loads, capacity)
    sizes, firsts, widths = (np.bincount(buckets, loads), *np.unique(buckets, return_index=True, return_counts=True)[1:])
    keys = common.owner_keys(spark, common.partitions(spark))
    # neighbouring buckets up to an equal share of all bytes
    share = (np.cumsum(sizes) - sizes / 2) / max(sizes.sum(), 1)
    owners = np.array(keys, np.int32)[np.minimum((share * len(keys)).astype(np.int64), len(keys) - 1)]
    depths = PREFIX_BITS - np.log2(widths).astype(np.int64)
    table = [(b, int(f), int(f + w - 1), int(d), int(x), int(o)) for b, (f, w, d, x, o) in enumerate(zip(firsts, widths, depths, sizes, owners, strict=True))]
    common.saved(spark.createDataFrame(table, DIRECTORY).coalesce(1), f"{folder}/directory")
    entries = rows.mapInArrow(_entries(buckets, owners, sizes > capacity, PREFIX_BITS), ENTRY)
    owned = entries.repartition(len(keys), "owner").sortWithinPartitions("bucket", "h")
    owned.mapInArrow(_own, INDEX).write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        texts = part.column("text").cast(pa.binary()).to_pylist()
        known = {t: hashlib.sha256(t).digest() for t in set(texts)}
        h = _hashes(texts)
        cols = [part.column("doc_id"), pa.array((h >> np.uint64(64 - PREFIX_BITS)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array([known[t] for t in texts], pa.binary())]
        yield pa.record_batch(cols, names=["doc_id", "prefix", "h", "sha"])


def hashed(docs: DataFrame) -> DataFrame:
    return common.texts(docs).mapInArrow(_hashed, "doc_id long, prefix int, h long, sha binary")


def lookup(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, keep_id, n) of every row: the group of its text in the index below ``folder``; null and 0 where there is none."""
    spark = docs.sparkSession
    places = spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")  # 2^PREFIX_BITS rows at most
    at = hashed(docs).join(F.broadcast(places.select("bucket", "first", "last")), F.col("prefix").between(F.col("first"), F.col("last")))
    met = at.join(read_index(spark, folder), ["bucket", "h", "sha"], "left")
    return met.select("doc_id", "keep_id", F.coalesce("n", F.lit(0)).alias("n"))


def dedup(docs: DataFrame, capacity: int = 4 << 20, folder: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. The index stays below ``folder``."""
    folder = folder or common.work_dir(docs.sparkSession, "exact")
    index = build_index(docs, folder, capacity)
    rows = common.saved(hashed(docs).select("doc_id", "sha"), f"{folder}/rows")
    groups = index.select("sha", "keep_id", "n", F.col("n").alias("group_size"))
    found = common.joined(rows, groups, "sha", rows.count())
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents),
g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, s AS text_sha256 FROM t JOIN g USING (s)
"""
