"""Exact dedup, WARC and token files: brute force and exact round trips."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from compare import compare, duck
from hypothesis import given, settings
from hypothesis import strategies as st

from wardspark.llm import common, exact_dedup, token_codes, warc

SF = "/root/testdata/sf0.001"


def test_exact_dedup_equals_sql(spark):
    got, want = compare(spark, duck(SF), SF, exact_dedup.op5_exact_dedup, exact_dedup.SQL)
    assert got == want


def _dedup_want(rows):
    want = []
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    for i, text in rows:
        ids = groups[text]
        keep = max((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(want, key=repr)


def test_exact_dedup_odd_rows(spark, odd_docs, no_docs):
    got = [tuple(r) for r in exact_dedup.dedup(odd_docs, capacity=64).collect()]
    assert sorted(got, key=repr) == _dedup_want([(r.doc_id, r.text or "") for r in odd_docs.collect()])
    assert exact_dedup.dedup(no_docs).count() == 0


def test_exact_dedup_index(spark, tmp_path):
    """Owners have ranges of the hash, buckets their folders; a hot text is one entry a task, and the index answers by its directory."""
    rows = [(i, "the same text" if i % 3 else f"text {i % 500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.dedup(docs, capacity=200, folder=str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == _dedup_want(rows)
    index = exact_dedup.read_index(spark, str(tmp_path)).collect()
    assert len(index) == len({t for _, t in rows}) and {r.n for r in index if r.n > 100} == {2000}
    places = sorted(spark.read.parquet(str(tmp_path / "directory")).collect(), key=lambda r: r["first"])
    assert [p["first"] for p in places] == [0, *(p["last"] + 1 for p in places[:-1])] and places[-1]["last"] == 65535
    owners = [p.owner for p in places]
    assert len(set(owners)) > 3 and len([1 for a, b in zip(owners, owners[1:]) if a != b]) == len(set(owners)) - 1
    of = {p.bucket: p for p in places}
    assert all(of[r.bucket]["first"] <= (r.h % 2**64) >> 48 <= of[r.bucket]["last"] for r in index)
    assert len(list((tmp_path / "index").glob("bucket=*"))) == len({r.bucket for r in index})
    asked = spark.createDataFrame([(1, "the same text"), (2, "no such text"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.lookup(asked, str(tmp_path)).collect())) == [(1, 2999, 2000), (2, None, 0), (3, None, 0)]


def test_directory_splits_overfull_buckets():
    loads = np.zeros(16, np.int64)
    loads[[0, 1, 5, 6]] = [10, 10, 3, 3]
    d = exact_dedup.directory(loads, 10)
    assert d[0] != d[1] and d[5] == d[6] and d[8] == d[15] and (np.diff(d) >= 0).all()
    assert set(exact_dedup.directory(loads, 100)) == {0}


def test_colliding_hashes_are_chained():
    """All texts in one hash: the chain still tells them apart; one digest for two texts is an error."""
    columns = [[0] * 3, [7] * 3, [b"x", b"y", b"x"], [b"b", b"a", b"b"], [3, 4, 5], [1, 1, 2]]
    batch = exact_dedup.pa.record_batch(columns_of(columns), names=["bucket", "h", "sha", "text", "top", "n"])
    (out,) = exact_dedup._own(iter([batch]))
    assert [(r["chain"], r["sha"], r["keep_id"], r["n"]) for r in out.to_pylist()] == [(0, b"y", 4, 1), (1, b"x", 5, 3)]
    columns[2] = [b"x"] * 3
    with pytest.raises(ValueError, match="SHA-256"):
        list(exact_dedup._own(iter([exact_dedup.pa.record_batch(columns_of(columns), names=batch.schema.names)])))


def columns_of(columns):
    return [exact_dedup.pa.array(c) for c in columns]


def _warc_want(rows, least):
    top = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        t = top.get(h or "", i)
        revisit = len(p) >= least and t != i and t >= 0
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", t if revisit else None))
    return want


def test_warc(spark, tmp_path):
    rows = [(i, f"http://x/{i}\n", h) for i, h in enumerate(["<p>a</p>", None, "", "<p>a</p>", "é" * 50_000, "<p>a</p>", "b"])]
    rows += [(5, None, "<p>a</p>"), (None, "u", "<p>a</p>"), (None, None, "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int")
    for least in (0, 5):
        folder = f"{tmp_path}/{least}"
        manifest = warc.write(df, folder, least, limit=2000)
        out = warc.read(manifest, folder).collect()
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
        assert sorted(got, key=repr) == sorted(_warc_want(rows, least), key=repr)
        assert manifest.count() > 1 and sum(r.records for r in manifest.collect()) == len(rows)
    again = warc.write(df, f"{tmp_path}/again", 5, limit=2000)
    assert sorted(r.sha256 for r in again.collect()) == sorted(r.sha256 for r in manifest.collect())
    assert warc.read(warc.write(df.limit(0), f"{tmp_path}/none"), f"{tmp_path}/none").count() == 0


def test_readers_refuse_other_files(spark, tmp_path):
    """A file that is not the one of the manifest is an error, not other rows."""
    pages = spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    for made, read, pattern in (
        (warc.write(pages, f"{tmp_path}/w"), lambda m: warc.read(m, f"{tmp_path}/w"), "w/*.gz"),
        (token_codes.write(docs, f"{tmp_path}/t", token_codes.vocabulary()), lambda m: token_codes.read(m, f"{tmp_path}/t"), "t/*.dac"),
    ):
        assert read(made).count() == 1
        (file,) = tmp_path.glob(pattern)
        file.write_bytes(file.read_bytes() + b"x")
        with pytest.raises(Exception, match="not the file of the manifest"):
            read(made).collect()


def test_warc_equals_sql(spark):
    got, want = compare(spark, duck(SF), SF, warc.op7_warc, warc.SQL)
    assert got == want


def test_warc_one_payload_of_most_pages(spark, tmp_path):
    """The hot payload's pages are joined by broadcast; the result is the same."""
    rows = [(i, f"u{i}", "<p>error</p>" if i % 3 else f"<p>{i}</p>") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.read(warc.write(df, f"{tmp_path}/hot"), f"{tmp_path}/hot").collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got) == sorted(_warc_want(rows, 0))


def test_warc_whole_table(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "pages").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op7_warc(spark, SF).collect())) == sorted(_warc_want(rows, 0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_round_trip(ids):
    codes = token_codes.Codes(token_codes.encode(np.array(ids, np.uint64)))
    assert codes.slice(0, len(ids)).tolist() == ids and len(codes) == len(ids)
    for i in range(0, len(ids), 37):
        assert codes[i] == ids[i]
        assert codes.slice(i, min(i + 50, len(ids))).tolist() == ids[i : i + 50]


def _tokens_want(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_codes.vocabulary())
    start, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*t.encode(text, add_special_tokens=False).ids, token_codes.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    manifest = token_codes.write(odd_docs, f"{tmp_path}/a", token_codes.vocabulary(), limit=50)
    got = [tuple(r) for r in token_codes.read(manifest, f"{tmp_path}/a").collect()]
    assert sorted(got, key=lambda r: r[1]) == _tokens_want(rows)
    assert token_codes.read(token_codes.write(no_docs, f"{tmp_path}/b", token_codes.vocabulary()), f"{tmp_path}/b").count() == 0
    whole = [(r.doc_id, r.text or "") for r in common.table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, token_codes.op4_token_codes(spark, SF).collect()), key=lambda r: r[1]) == _tokens_want(whole)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 .,'\n\tZé_#!-½²😀ñ\x01 ")), max_size=60))
def test_pieces_encode_like_whole_texts(text):
    e = token_codes.encoder(token_codes.vocabulary())
    assert np.frombuffer(e.text(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
