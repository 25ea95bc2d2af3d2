"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id; each task streams its range into
``part-<task>-<n>.warc.gz`` files that roll by compressed size, one gzip member
per record, with headers and digests made anew from the payload. A file is
written under a temporary name and renamed; a manifest table is committed last
and is what readers go by. Same input, same partitions: same bytes.

Of records with equal payloads of at least ``least`` bytes the one with the
largest page id is a response, the others revisit it. Equality is by SHA-1 and
length of the full payload. The one payload of a third of all pages (an error page)
is not dealt to one task: frequent ones are joined by broadcast, at most 8 a task.
Very long payloads are records of their own, whatever the file limit. Null html is an empty payload; null page ids are the
smallest; rows that repeat the largest id are all responses. Other columns are
ignored; an empty table makes no file and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import common

MANIFEST = "name string, records long, bytes long, first_page long, last_page long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, file_offset long"
#: Fixed capture time: headers depend on nothing but the record.
DATE = "2020-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. What WARC lacks a header for stands in X- headers."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Has-Target: {int(bool(url))}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _writer(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, out, size, ids = TaskContext.get().partitionId(), 0, [], 0, []
        mark = None  # (page_id, sha, refers_to) of the revisit mark that stands before its record

        def close() -> pa.RecordBatch:
            nonlocal n, out, size, ids
            name, data = f"part-{task:05d}-{n:05d}.warc.gz", b"".join(out)
            common.write_file(folder, name, data)
            known = [i for i in ids if i is not None]
            row = [name, len(ids), len(data), known[0] if known else None, known[-1] if known else None, hashlib.sha256(data).hexdigest()]
            n, out, size, ids = n + 1, [], 0, []
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["name", "records", "bytes", "first_page", "last_page", "sha256"])

        for batch in common.slices(batches, "html"):
            for page_id, url, html, sha, is_mark, refers in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "mark", "refers_to")], strict=True):
                if is_mark:
                    mark = (page_id, sha, refers)
                    continue
                revisit = mark is not None and mark[:2] == (page_id, sha)
                made = make_record(page_id, url, html.encode("utf-8", "surrogatepass"), mark[2] if revisit else None, revisit)
                out.append(made)
                ids.append(page_id)
                size += len(made)
                if size >= limit:
                    yield close()
        if out:
            yield close()

    return run


def write(pages: DataFrame, folder: str, least: int = 0, limit: int = 16 << 20) -> DataFrame:
    """Writes the archive into ``folder`` and returns its committed manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    kept = rows.filter(F.octet_length("html") >= least).select("page_id", F.concat_ws("/", "sha", F.octet_length("html")).alias("payload"), "sha")
    named = common.saved(kept, f"{folder}/_named")
    tops = named.groupBy("payload").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marks = common.joined(named.distinct(), tops, "payload", named.count()).filter(~F.col("page_id").eqNullSafe(F.col("top")))
    none = F.lit(None)
    marks = marks.select("page_id", none.cast("string").alias("url"), F.lit("").alias("html"), "sha", F.lit(True).alias("mark"), F.col("top").alias("refers_to"))
    records = rows.select("page_id", "url", "html", "sha", F.lit(False).alias("mark"), none.cast("long").alias("refers_to"))
    both = records.unionByName(marks).repartitionByRange(common.partitions(spark), "page_id")
    ordered = both.sortWithinPartitions("page_id", "sha", F.col("mark").desc(), "url")
    return common.saved(ordered.mapInArrow(_writer(folder, limit), MANIFEST), f"{folder}/_manifest")


def parse_members(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive file."""
    at = 0
    while at < len(data):
        member, parts, fed, view = zlib.decompressobj(31), [], at, memoryview(data)
        while not member.eof:
            if fed >= len(data):
                raise ValueError("the last record is cut off")
            parts.append(member.decompress(view[fed : fed + 32768]))
            fed += 32768
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield at, headers, rest[: int(headers["Content-Length"])]
        at = min(fed, len(data)) - len(member.unused_data)


def _reader(folder: str):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sha in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                rows, data = [], common.read_file(folder, name)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                for at, h, block in parse_members(data):
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    payload = block.partition(b"\r\n\r\n")[2]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{name}: record at {at} does not match its digest")
                    page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page")
                    size = len(payload) if kind == "response" else int(h["X-Payload-Length"])
                    url = h["WARC-Target-URI"] if h["X-Has-Target"] == "1" else None
                    rows.append((int(page) if page else None, url, size, digest, kind, int(refers) if refers else None, name, at))
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records (RECORD) of the files that a manifest lists."""
    spark = manifest.sparkSession
    return manifest.select("name", "sha256").repartition(common.partitions(spark), "name").mapInArrow(_reader(folder), RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_dir(spark, "warc")
    manifest = write(common.table(spark, sf_dir, "pages"), folder)
    return read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the 40 hexadecimal digits of a SHA-1: five of them are four letters.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, sha1(payload) AS x FROM p),
t AS (SELECT payload, max(page_id) AS top FROM p GROUP BY payload),
b AS (SELECT page_id, top, octet_length(payload) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
    substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substring(x, 5 * (k // 4) + 1, 5))::INTEGER >> (15 - 5 * (k % 4))) % 32 + 1, 1)), '') AS payload_digest
  FROM d JOIN t USING (payload))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM b
"""
