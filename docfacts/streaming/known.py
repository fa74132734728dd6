"""Which documents already have an outcome, asked of Bloom filters instead of the outcome table.

Every batch leaves one filter for each bucket of ids. A filter says of an id that it is surely new or perhaps known, so only the few ids that
are perhaps known need a look into the ids of outcomes, and only into the parts (bucket and batch) whose filters spoke. When there are ``MERGE`` sets of filters
of one generation, one of the next generation is built over the outcomes they cover: the number of sets stays logarithmic, and each id is read
once a generation.

A set is written before the outcomes it covers, so none is ever missing; a set whose batch failed only costs a look.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BITS_PER_ID, PROBES = 24, 8
#: Sets of one generation that are merged into one.
MERGE = 8
_SCHEMA = "bucket int, n long, bits binary, covers array<string>, generation int, name string"


def _hashed(ids: DataFrame) -> DataFrame:
    text = F.col("doc_id").cast("string")
    return ids.select("*", F.xxhash64(text).alias("_h1"), (F.xxhash64(text, F.lit(1)).bitwiseOR(F.lit(1))).alias("_h2"))


def _places(table: pa.Table, bits: int) -> np.ndarray:
    """The probed bits of each id: a row of ``PROBES`` numbers. ``bits`` is a power of two."""
    one, two = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("_h1", "_h2"))
    return ((one[:, None] + np.arange(PROBES, dtype=np.uint64) * two[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _filter_of(table: pa.Table) -> bytes:
    bits = 1 << max(10, int(table.num_rows * BITS_PER_ID - 1).bit_length())
    held = np.zeros(bits, bool)
    held[_places(table, bits).ravel()] = True
    return np.packbits(held).tobytes()


def write_filters(ids: DataFrame, folder: str, name: str, covers: Sequence[str], generation: int = 0) -> None:
    """One filter for each bucket over ``doc_id, bucket``. A repeated batch replaces its own set."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": [table.num_rows], "bits": pa.array([_filter_of(table)], pa.binary())})

    built = _hashed(ids.select("doc_id", "bucket")).groupBy("bucket").applyInArrow(build, "bucket int, n long, bits binary")
    labelled = built.select("*", F.array(*map(F.lit, covers)).alias("covers"), F.lit(generation).alias("generation"), F.lit(name).alias("name"))
    labelled.write.mode("overwrite").parquet(f"{folder}/set={name}")


def create_filters(spark: SparkSession, folder: str) -> None:
    """Make the folder exist, so that the first batch can read it."""
    spark.createDataFrame([], _SCHEMA).write.mode("overwrite").parquet(f"{folder}/set=none")


def live_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The filters that no later generation covers."""
    every = spark.read.schema(_SCHEMA).parquet(folder).drop("set")
    gone = every.where("generation > 0").select("generation", F.explode("covers").alias("batch")).distinct()
    covered = every.select("name", "generation", F.explode("covers").alias("batch")).distinct().join(gone.withColumnRenamed("generation", "later"), "batch")
    return every.join(covered.where("later > generation").select("name").distinct(), "name", "left_anti")


def perhaps_known(ids: DataFrame, filters: DataFrame) -> DataFrame:
    """The ids that some filter may hold, once for each batch it covers: ``doc_id, bucket, batch``."""
    kind = ids.schema["doc_id"].dataType.simpleString()

    def ask(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        rows, batches = [], []
        for raw, covers in zip(asked.column("bits").to_pylist(), asked.column("covers").to_pylist()):
            bits = np.unpackbits(np.frombuffer(raw, np.uint8))
            for row in np.flatnonzero(bits[_places(table, len(bits))].all(1)) if table.num_rows else []:
                rows += [row] * len(covers)
                batches += covers
        found = table.select(["doc_id", "bucket"]).take(pa.array(rows, pa.int64()))
        return found.append_column("batch", pa.array(batches, pa.string()))

    slim = filters.select("bucket", "bits", "covers")
    return _hashed(ids.select("doc_id", "bucket")).groupBy("bucket").cogroup(slim.groupBy("bucket")).applyInArrow(ask, f"doc_id {kind}, bucket int, batch string")


def merge_filters(spark: SparkSession, folder: str, read_ids: Callable[[list[str]], DataFrame]) -> int:
    """Build sets of the next generation where there are ``MERGE`` of one. ``read_ids`` gives ``doc_id, bucket`` of some batches. The number of sets built."""
    sets = live_filters(spark, folder).select("name", "generation", "covers").distinct().collect()  # a logarithm of the batches
    built = 0
    for generation in sorted({s["generation"] for s in sets}):
        merged = sorted((s for s in sets if s["generation"] == generation), key=lambda s: s["name"])
        if len(merged) >= MERGE:
            covers = sorted({batch for s in merged for batch in s["covers"]})
            write_filters(read_ids(covers), folder, f"{generation + 1}-{merged[0]['name']}", covers, generation + 1)
            built += 1
    return built
