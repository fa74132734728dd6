"""The stages of the pipeline, each judged on its own input, and the whole of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as near_brute
from test_suffix_dedup import brute as repeat_brute
from tools import rows

import corpus_pipeline as pipeline
from docfacts.llm.common import written

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        out.append(docs)
    return out


def test_columns_stay(results):
    for before, after in zip(results, results[1:-1]):
        assert after.dtypes == before.dtypes


def test_near_copies(results):
    data = rows(results[1], "doc_id", "text")
    assert {i for i, in rows(results[2], "doc_id")} == {i for i, _, c in near_brute(data) if i == c}


def test_repeated_passages(results):
    data = rows(results[2], "doc_id", "text")
    lost = {i: n for i, _, n, *_ in repeat_brute(data)}
    texts = dict(data)
    for i, text in rows(results[3], "doc_id", "text"):
        assert len(text.encode()) <= len(texts[i].encode()) - lost[i]
        assert lost[i] or text == texts[i]


def test_mix_and_packing(results):
    copies = dict(rows(results[4].groupBy("doc_id").count()))
    assert max(copies.values()) <= 2
    tokens = results[5].selectExpr("sum(length)").first()[0]
    whole = results[5].where("start = 0").selectExpr("sum(doc_tokens)").first()[0]
    assert tokens == whole and results[5].where("start = 0").count() == results[4].count()


def test_run_equals_the_stages(spark, results):
    run = pipeline.run(spark, SF_DIR)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    per_document = lambda df: rows(df.groupBy("doc_id").sum("length"))
    assert run.columns == results[5].columns and per_document(run) == per_document(results[5])
    assert set(columns) <= set(run.columns)


def test_odd_rows_pass_all_stages(spark):
    """Nulls in every column, repeated rows, one long text and columns with the stages' own names."""
    long = " ".join(f"w{k}" for k in range(30_000))
    passage = " ".join(f"shared{k}" for k in range(60))
    data = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, None, None, None, None), (None, "no id at all here", None, "b", 1), (None, None, None, None, None), (3, "", "de", "b", 0)]
    data += [(10 + k, f"{passage} and the own words number {k} " + " ".join(f"own{k}x{j}" for j in range(80)), "fr", "a", k) for k in range(6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumns({c: F.lit("own") for c in ("n", "row", "size", "copies", "component", "score", "record", "starts", "__x")})
    for name, stage in pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, SF_DIR), name)
        assert after.columns == docs.columns and after.where("n <> 'own' or row <> 'own' or score <> 'own'").count() == 0
        found = {r.doc_id for r in after.select("doc_id").collect()}
        if name != "source_mix":
            assert found == {1, 2, None, 3, *range(10, 16)} and after.count() == (12 if name == "toxicity" else 11)
        docs = after
    packed = pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.where("start = 0").count() == docs.count()


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), name)
        assert docs.count() == 0
