"""Known ids are asked of filters: new ids read no old ids, and none is lost or done twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docfacts.session import configure, work_folder
from docfacts.streaming import ingest, known

SCHEMA = "doc_id long, response string"


def _buckets(spark, ids):
    return ids.withColumn("bucket", ingest.bucket_of(F.col("doc_id"), 4))


def test_filters_hold_every_id_and_few_others(spark, tmp_path):
    folder = str(tmp_path / "f")
    known.create_filters(spark, folder)
    for k in range(3):
        known.write_filters(_buckets(spark, spark.range(k * 2000, (k + 1) * 2000).withColumnRenamed("id", "doc_id")), folder, f"b{k}", [f"b{k}"])
    asked = _buckets(spark, spark.range(0, 40_000).withColumnRenamed("id", "doc_id"))
    hits = known.perhaps_known(asked, known.live_filters(spark, folder)).collect()
    assert {(i, f"b{i // 2000}") for i in range(6000)} <= {(r.doc_id, r.batch) for r in hits}
    assert len(hits) < 6000 + 40
    assert known.perhaps_known(asked.where("false"), known.live_filters(spark, folder)).collect() == []


@pytest.fixture
def arriving(spark, tmp_path):
    configure(spark)
    folder = tmp_path / "in"

    def arrive(ids):
        spark.createDataFrame([(i, f"[{i}]") for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    def run(outcomes, checkpoint, files=None):
        reader = spark.readStream.schema(SCHEMA)
        stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(str(folder))
        ingest.ingest_answers(stream, outcomes, str(tmp_path / checkpoint), buckets=4).awaitTermination()
        return sorted(r.doc_id for r in ingest.read_outcomes(spark, outcomes).collect())

    return arrive, run


def test_new_ids_read_no_old_ones(spark, arriving, monkeypatch):
    arrive, run = arriving
    outcomes = work_folder(spark, "outcomes")
    asked = []
    original = ingest.known_ids
    monkeypatch.setattr(ingest, "known_ids", lambda *a: asked.append(a[2:]) or original(*a))
    arrive(range(0, 300))
    assert run(outcomes, "c") == list(range(300))
    arrive(range(300, 600))
    assert run(outcomes, "c") == list(range(600)) and asked == []
    # Known ids among new ones: only the parts that know them are read.
    arrive([*range(290, 300), *range(600, 700)])
    assert run(outcomes, "c") == list(range(700))
    assert len(asked) == 1 and len(asked[0][1]) == 1
    # A new checkpoint sends everything again.
    assert run(outcomes, "other") == list(range(700))


def test_filters_are_merged(spark, arriving, monkeypatch):
    monkeypatch.setattr(known, "MERGE", 3)
    arrive, run = arriving
    outcomes = work_folder(spark, "outcomes")
    for k in range(7):
        arrive(range(k * 20, k * 20 + 30))  # ten of each batch come again
    assert run(outcomes, "c", files=1) == list(range(150))
    live = known.live_filters(spark, ingest.filter_folder(outcomes)).select("name", "generation", "covers").distinct().collect()
    batches = [b for r in live for b in r.covers]
    assert len(live) <= 4 and len(batches) == len(set(batches)) == 7 and max(r.generation for r in live) >= 1
    assert run(outcomes, "again", files=1) == list(range(150))


def test_a_table_without_filters_gets_them(spark, arriving):
    arrive, run = arriving
    outcomes = work_folder(spark, "outcomes")
    arrive(range(50))
    assert run(outcomes, "c") == list(range(50))
    moved = work_folder(spark, "moved")
    spark.read.parquet(outcomes).write.partitionBy("bucket", "batch").parquet(moved)
    arrive(range(40, 60))
    assert run(moved, "d") == list(range(60))


def test_one_file_a_bucket(spark, arriving):
    arrive, run = arriving
    outcomes = work_folder(spark, "outcomes")
    for k in range(5):
        arrive(range(k * 100, k * 100 + 100))
    run(outcomes, "c")
    files = spark.read.parquet(outcomes).where("bucket >= 0").select("bucket", F.input_file_name().alias("f")).distinct()
    assert files.groupBy("bucket").count().where("count > 1").count() == 0
