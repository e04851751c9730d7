"""Registered queries against their SQL, and the pipeline against its parts."""

import pytest

import corpus_pipeline
from ledgerlens.compare import compare
from ledgerlens.llm import decontaminate, quality, queries, simhash


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_small, name):
    result = compare(spark, sf_small, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert result["ok"], result


def test_pipeline_matches_its_parts(spark, sf_small):
    """Each stage's survivors, worked out in Python from the operators' own
    per-row results (which other tests hold against brute force)."""
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    benchmark = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score(docs, labels).where("kept").collect()}
    last = {}
    for d in sorted(good):
        last[texts[d]] = d
    unique = set(last.values())
    some = docs.where(docs.doc_id.isin(list(unique)))
    first = {}
    for d, c in sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(some).collect()):
        first.setdefault(c, d)
    apart = set(first.values())
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(docs.where(docs.doc_id.isin(list(apart))), benchmark).collect()}
    got = corpus_pipeline.run(spark, sf_small).collect()
    assert {r["doc_id"] for r in got} == apart - leaked and len(got) == len(apart - leaked)
    assert 0 < len(got) < len(texts) and leaked
    direct = {r["doc_id"]: r for r in queries.op10_bpe(spark, sf_small).collect()}
    assert all(r == direct[r["doc_id"]] for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_small):
    rows = [(None, None, None, None, None, "e"), (1, "", "en", "s", 0, "e"), (1, "", "en", "s", 0, "e"), (2, "A text here.", "en", "s", 12, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    long = docs.union(spark.createDataFrame([(3, "many words in one long text " * 40_000, "en", "s", 1, "e")], docs.schema))
    for frame in (docs, docs.limit(0), long):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf_small)
            assert out.columns == docs.columns and out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf_small).count() == frame.count()
