"""Incremental parse of arriving answers: only documents without an outcome are worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docfacts.operators.documents import id_before_first_dot
from docfacts.operators.responses import parse_v2
from docfacts.streaming.known import create_filters, live_filters, merge_filters, perhaps_known, write_filters


def stream_answer_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of ``doc_id, response`` from a folder with one text file per answer."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return stream.select(id_before_first_dot(F.col("_metadata.file_name")).alias("doc_id"), F.col("value").alias("response"))


def stream_pdfs(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of ``doc_id, path, content`` from a folder of PDF files."""
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.pdf")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return stream.select(id_before_first_dot(F.col("_metadata.file_name")).alias("doc_id"), "path", "content")


#: Parts in which outcomes are laid out by the hash of their id.
BUCKETS = 64


def bucket_of(doc_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(buckets)).cast("int")


def read_outcomes(spark: SparkSession, outcomes: str) -> DataFrame:
    """The outcome table: results and quarantined answers, told apart by ``status``."""
    return spark.read.parquet(outcomes)


def create_outcomes(answers: DataFrame, outcomes: str) -> None:
    """Make the outcome table exist, so that the first batch can read it."""
    columns = {
        "doc_id": answers.schema["doc_id"].dataType, "status": "string", "candidate_no": "int", "repaired": "boolean",
        "json": "string", "raw": "string",
    }
    empty = answers.sparkSession.range(0, 1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]).where("doc_id is not null")
    empty.write.mode("overwrite").parquet(f"{outcomes.rstrip('/')}/bucket=-1/batch=none")
    spark, folder = answers.sparkSession, filter_folder(outcomes)
    create_filters(spark, folder)
    # Outcomes without a filter, as of a table from elsewhere: their batches get one set of filters.
    covered = live_filters(spark, folder).select(F.explode("covers").alias("batch")).distinct()
    bare = [r.batch for r in read_outcomes(spark, outcomes).where("bucket >= 0").select("batch").distinct().join(covered, "batch", "left_anti").collect()]
    if bare:
        write_filters(_ids_of(spark, outcomes, bare), folder, f"found-{min(bare)}", bare)


def parse_outcomes(answers: DataFrame, *keep: str) -> DataFrame:
    parsed = parse_v2(answers)
    return parsed.select(
        *keep,
        "doc_id",
        "status",
        F.col("candidate_no").cast("int").alias("candidate_no"),
        "repaired",
        F.to_json("json").alias("json"),
        F.when(F.col("status") != "ok", F.col("response")).alias("raw"),
    )


def known_ids(spark: SparkSession, outcomes: str, buckets: list[int], batches: list[str]) -> DataFrame:
    """Ids with an outcome in some buckets and batches; other parts are not read."""
    known = read_outcomes(spark, outcomes).where(F.col("bucket").isin(*buckets) & F.col("batch").isin(*batches))
    return known.select("doc_id").distinct()


def _ids_of(spark: SparkSession, outcomes: str, batches: list[str]) -> DataFrame:
    return read_outcomes(spark, outcomes).where(F.col("batch").isin(*batches)).select("doc_id", "bucket")


def filter_folder(outcomes: str) -> str:
    """Where the filters of an outcome table lie: beside it."""
    return f"{outcomes.rstrip('/')}-known"


def without_known(ids: DataFrame, outcomes: str, but: str) -> DataFrame:
    """``ids`` (with ``doc_id, bucket``) that have no outcome in batches other than ``but``.

    Filters are asked first. Only where one may know an id are the ids of its outcomes read; a batch of new ids reads none.
    """
    spark = ids.sparkSession
    hits = perhaps_known(ids, live_filters(spark, filter_folder(outcomes))).where(F.col("batch") != but)
    parts = hits.select("bucket", "batch").distinct().collect()  # parts of the table, not ids
    if not parts:
        return ids
    known = known_ids(spark, outcomes, sorted({p["bucket"] for p in parts}), sorted({p["batch"] for p in parts}))
    return ids.join(known, "doc_id", "left_anti")


def ingest_answers(answers: DataFrame, outcomes: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Start a query over a stream of ``doc_id, response`` that handles what is there, then stops.

    Of several answers to one document in a micro-batch the first in text order counts, so a repeated batch
    chooses alike. Each micro-batch skips ids that already have an outcome (see :func:`without_known`),
    parses the rest and writes its part of each bucket, one file a bucket. A repeated batch overwrites its own parts, so a failure
    between write and commit adds nothing twice. The known ids live in the outcome table and its filters, not in stream state, so a
    new checkpoint does not start over.
    """
    create_outcomes(answers, outcomes)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        one = batch.groupBy("doc_id").agg(F.min("response").alias("response")).withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
        folder = filter_folder(outcomes)
        write_filters(one, folder, name, [name])
        outcome = parse_outcomes(without_known(one, outcomes, name), "bucket").withColumn("batch", F.lit(name))
        outcome.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(outcomes)
        merge_filters(spark, folder, lambda batches: _ids_of(spark, outcomes, batches))

    return (
        answers.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
