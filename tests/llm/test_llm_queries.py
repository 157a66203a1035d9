"""Registered queries against their SQL, and the pipeline against each operator's own results."""

import re

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from assaykit.llm import decontaminate, lang_id, ngram_join, secret_scan
from assaykit.llm.common import table
from assaykit.llm.oracle import ORACLE
from assaykit.llm.queries import PIECE_BPE, QUERIES
from conftest import SF_SMALL
from test_llm_near import brute
from tools.oracle_check import rows_of


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    got, rel = [tuple(r) for r in df.collect()], con.sql(ORACLE[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns) and len(got) == len(want) > 0
    assert rows_of(df.columns, got) == rows_of(rel.columns, want)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = table(spark, SF_SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "benchmark_decontamination", "secret_scans", "sentencepiece"]
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == [*docs.columns, "ids", "lossless"]
    rows = out.collect()
    assert all(r.lossless for r in rows)
    model = lang_id.fit(docs.where(~lang_id.held_out(docs.doc_id)))
    known = [(r.doc_id, r.text) for r in lang_id.predict(docs, model).collect() if not r.rejected]
    one = {d for d, c, _ in brute(known) if d == c}
    hits = {r.doc_id for r in decontaminate.find_contamination(docs, table(spark, SF_SMALL, "benchmark")).collect() if r.n_hit}
    assert {r.doc_id for r in rows} == one - hits and hits & one
    # The library reads the sampled pieces as the text the stage was given.
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    assert all(sp.decode(list(r.ids)) == (r.text or "") for r in rows)
    # Of the given texts the masking stage has changed those with a finding and no others, and nothing round it.
    given, masked = dict(known), 0
    for r in rows:
        parts = (r.text or "").split(secret_scan.MASK)
        masked += len(parts) > 1
        if len(parts) == 1:
            assert r.text == given[r.doc_id]
        else:
            assert re.fullmatch(".+?".join(map(re.escape, parts)), given[r.doc_id], re.DOTALL)
    assert not any(re.search(r"\bAKIA[0-9A-Z]{16}\b", r.text or "") for r in rows) and masked <= len(rows) // 4


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF_SMALL, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF_SMALL)
        assert got.columns[:len(docs.columns)] == docs.columns and got.count() == 0, name


def test_stage_of_near_duplicates_keeps_all_without_words(spark):
    df = spark.createDataFrame([(1, "...", "en", "s", 3), (2, None, None, "s", None)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    assert ngram_join.keep_one(df).count() == 2
