"""The pipeline as a whole: against plain versions of its stages, and on odd and empty tables."""

import pytest
from test_codes_warc_dedup import _tokens_want
from test_near_and_leaks import _brute, _similar_classes

import corpus_pipeline
from wardspark.llm import common, decontam, mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of tables as the stages read them, with the documents given."""

    def make(docs, labels=None, benchmark=None):
        for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
            df = common.table(spark, SF, name) if df is None else df
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_run_against_plain_stages(spark):
    """Rows kept by the scores of op9, by all pairs of shingle sets, by all windows against all items, by the draw; their ids by the tokenizer."""
    docs = {r.doc_id: r for r in common.table(spark, SF, "documents").collect()}
    kept = {r.doc_id for r in quality.op9_quality(spark, SF).collect() if r.score >= quality.THRESHOLD}
    rows = [(i, docs[i].text) for i in sorted(kept)]
    classes = _similar_classes(rows)
    rows = [(i, t) for i, t in rows if classes[i] == i]
    items = decontam.Items(sorted(common.table(spark, SF, "benchmark").collect(), key=lambda r: r.item_id))
    rows = [(i, t) for (i, t), bad in zip(rows, _brute([t for _, t in rows], items), strict=True) if not bad]
    left = spark.createDataFrame([docs[i] for i, _ in rows], common.table(spark, SF, "documents").schema)
    drawn = {r.doc_id for r in mixing.weighed(left).filter("selected").collect()}
    want = _tokens_want([(i, t) for i, t in rows if i in drawn])
    assert 0 < len(want) < len(rows) < len(classes) < len(docs)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_on_odd_and_empty_tables(spark, folder, odd_docs, no_docs):
    """Nulls, empty and very long texts, repeated rows, clashing columns; no documents, no labels, no benchmark."""
    labels, benchmark = (common.table(spark, SF, n).limit(0) for n in ("labels", "benchmark"))
    got = corpus_pipeline.run(spark, folder(odd_docs)).collect()
    assert len(got) <= odd_docs.count() and [r.start for r in sorted(got, key=lambda r: r.start)][:1] in ([], [0])
    got = corpus_pipeline.run(spark, folder(odd_docs, labels, benchmark)).collect()  # nothing to reject by
    assert 0 < len(got) <= odd_docs.count()
    assert corpus_pipeline.run(spark, folder(no_docs)).count() == 0
    assert corpus_pipeline.run(spark, folder(no_docs, labels, benchmark)).count() == 0
