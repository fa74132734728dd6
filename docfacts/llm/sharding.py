"""Sharding into parts of equal size by sampled splitters.

Records have an order: by the digest of their text, then by id, so equal texts are neighbours. The order is cut into many
ranges: keys are sampled with a chance in proportion to their record's size, and the quantiles of the sample are the
splitters. The ranges are then measured over all records; one that holds too many bytes or rows is sampled again and
subdivided, until none is left. Each range is worked through by one task, which knows from the measured ranges before it how
many bytes and rows come before. So every record knows its exact place in the whole order, and where a shard ends
depends on that place alone, not on the sample: shards take equal shares of all bytes.

A group of equal texts goes to one shard as a whole, by its middle, unless it holds more than ``1 / WHOLE`` of a shard in bytes or
rows (or more than a range). Larger groups, which may hold any share of all rows, are cut record by record. The number of such groups is at most twice the
number of shares by construction, so their digests may be sent to all tasks. No text is shuffled unless it is asked for.

Defined cases: a null text has no bytes and stands with empty ones; a null id comes before others; repeated rows
are records of their own, kept apart by a number that no result shows; other columns are ignored or carried along whole, whatever their
names; an empty table gives an empty result; a record larger than a shard makes its shard larger, and shards may then be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from docfacts.llm.common import thrifty, written

SHARDS = 8
#: Groups of equal texts up to this part of a shard stay whole.
WHOLE = 128
#: Records of a range, and the least and largest number of ranges. The largest bounds what the driver holds of splitters.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1_000, 64, 65_536
#: Sampled keys for each range.
DRAWN = 8
#: Rounds of subdividing. Places do not depend on it, only the balance of tasks.
ROUNDS = 12
LAW = "bytes"

_KEY = 16 + 9 + 8


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The order of the records as byte strings: digest, id (null first), number."""
    n = batch.num_rows
    ids = batch.column("doc_id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    raw = np.zeros((n, _KEY), np.uint8)
    raw[:, :16] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(n, 16)
    raw[:, 16] = known
    shifted = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    raw[:, 17:25] = np.where(known, shifted, np.uint64(0)).astype(">u8").view(np.uint8).reshape(n, 8)
    raw[:, 25:] = batch.column("tie").to_numpy().astype(">u8").view(np.uint8).reshape(n, 8)
    return raw.view(f"S{_KEY}").ravel()


def _located(records: DataFrame, splitters: Broadcast, heavy: Broadcast) -> DataFrame:
    """Adds ``range``, the number of splitters up to the record, and ``heavy``, whether its group is cut."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(splitters.value, f"S{_KEY}")
        large = heavy.value
        for batch in batches:
            place = np.searchsorted(cuts, _keys(batch), side="right").astype(np.int32)
            is_heavy = [d in large for d in batch.column("digest").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(is_heavy, pa.bool_())], [*batch.schema.names, "range", "heavy"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in records.dtypes)
    return records.mapInArrow(thrifty(locate), f"{schema}, range int, heavy boolean")


def _sampled(records: DataFrame, chance, heavy: set[bytes], seed: int) -> list[tuple[int, bytes]]:
    """Range and key of the records drawn by ``chance``; a key inside a group that stays whole becomes the group's start."""
    draw = F.shiftrightunsigned(F.xxhash64("digest", "doc_id", "tie", F.lit(seed)), 11) / float(1 << 53)
    drawn = records.where(draw < chance).select("range", "digest", "doc_id", "tie")
    out = []
    for batch in drawn.toArrow().to_batches():
        for place, key, group in zip(batch.column("range").to_pylist(), _keys(batch).tolist(), batch.column("digest").to_pylist()):
            out.append((place, key if group in heavy else group))
    return sorted(out)


def _splitters(records: DataFrame, total: int, rows: int, ranges: int, share: int, heavy: set[bytes]) -> tuple[list[bytes], dict[int, tuple[int, int]]]:
    """Splitters under which no range is overfull, and the bytes and rows of each range.

    A range is overfull when it holds more than twice its share of rows, or of bytes without its largest record, and a group that stays whole.
    """
    context = records.sparkSession.sparkContext
    keys = _sampled(records.withColumn("range", F.lit(0)), F.col("size") * (DRAWN * ranges / total), heavy, 0)
    cuts = sorted({key for _, key in keys[DRAWN - 1 :: DRAWN]})
    big = context.broadcast(heavy)
    for turn in range(1, ROUNDS + 1):
        located = _located(records, context.broadcast(cuts), big)
        counts = located.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("most"))
        measured = {r["range"]: r for r in counts.collect()}  # at most one row for each splitter
        full = {
            k: max(r["bytes"] * ranges / total, r["rows"] * ranges / rows)
            for k, r in measured.items()
            if r["bytes"] - r["most"] > (2 / ranges + 1 / share) * total or r["rows"] > (2 / ranges + 1 / share) * rows
        }
        if not full or turn == ROUNDS:
            break
        spark = records.sparkSession
        wanted = spark.createDataFrame([(k, DRAWN * pieces / measured[k]["bytes"], DRAWN * pieces / measured[k]["rows"]) for k, pieces in full.items()], "range int, by_byte double, by_row double")
        again = located.join(F.broadcast(wanted), "range")
        found = _sampled(again, F.greatest(F.col("size") * F.col("by_byte"), F.col("by_row")), heavy, turn)
        inside: dict[int, set[bytes]] = {}
        for place, key in found:
            inside.setdefault(place, set()).add(key)
        for place, keys in inside.items():
            step = max(1, round(len(keys) / (full[place] + 1)))
            cuts.extend(sorted(keys)[step::step])
        cuts = sorted(set(cuts))
    return cuts, {k: (r["bytes"], r["rows"]) for k, r in measured.items()}


def assigned(documents: DataFrame, shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """The shard of every record and its place there: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's bytes plus 1. ``slot`` counts from 0 in each shard, without gaps. With ``carry`` the whole row travels
    along as ``record``, with ``range``, by which the rows of a shard can be spread.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = {
        "doc_id": F.col("doc_id").cast("long"),
        "size": (F.octet_length(text) + 1).cast("long"),
        "text_crc32": F.crc32(text),
        "digest": F.unhex(F.md5(text)),
        "tie": F.monotonically_increasing_id(),
    }
    if carry:
        columns["record"] = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    records = written(documents.select(*(c.alias(name) for name, c in columns.items())), "records")
    slim = records.drop("record")
    total, rows = slim.agg(F.sum("size"), F.count(F.lit(1))).first()
    shown = ["doc_id", "size", "text_crc32", *(["record", "range"] if carry else []), "shard", "slot"]
    if not rows:
        empty = records.withColumns({"range": F.lit(0), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
        return empty.select(*shown)
    ranges = min(max(-(-rows // RANGE_ROWS), LEAST_RANGES), MOST_RANGES)
    share = max(shards * WHOLE, ranges)
    groups = slim.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    large = groups.where((F.col("bytes") * share > total) | (F.col("rows") * share > rows)).select("digest")
    heavy = {bytes(r["digest"]) for r in large.collect()}  # fewer than 2 * share, as each holds more than a share
    cuts, measured = _splitters(slim, total, rows, ranges, share, heavy)
    before, so_far = [], (0, 0)
    for k in sorted(measured):
        before.append((k, *so_far))
        so_far = so_far[0] + measured[k][0], so_far[1] + measured[k][1]
    starts = F.broadcast(spark.createDataFrame(before, "range int, bytes_before long, rows_before long"))  # one row for each range
    context = spark.sparkContext
    located = _located(slim, context.broadcast(cuts), context.broadcast(heavy)).join(starts, "range")
    inside = Window.partitionBy("range").orderBy("digest", "doc_id", "tie")
    placed = located.withColumns(
        {
            "begin": F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
            "place": F.col("rows_before") + F.row_number().over(inside) - 1,
        }
    )
    same = Window.partitionBy("range", "digest")
    # Twice the middle: of the record in a group that is cut, else of the group.
    middle = F.when(F.col("heavy"), 2 * F.col("begin") + F.col("size")).otherwise(2 * F.min("begin").over(same) + F.sum("size").over(same))
    placed = placed.withColumn("middle", middle).withColumn("shard", F.expr(f"cast(least({shards - 1}, {shards} * middle div {2 * total}) as int)"))
    placed = written(placed.select("doc_id", "size", "text_crc32", "tie", "range", "place", "shard"), "placed")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # one row for each shard
    slotted = placed.join(firsts, "shard").withColumn("slot", F.col("place") - F.col("first"))
    if carry:
        slotted = slotted.join(records.select("tie", "record"), "tie")
    return slotted.select(*shown)


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All documents, every column kept, in folders ``shard=<n>`` under ``path``, each file in the order of the slots.

    A shard is written by as many tasks as it has ranges, at most.
    """
    dealt = assigned(documents, shards, carry=True).select("shard", "range", "slot", "record")
    spread = dealt.repartition("shard", "range").sortWithinPartitions("shard", "slot")
    spread.select("shard", "slot", "record").write.mode("overwrite").partitionBy("shard").parquet(path)


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shards under the law of equal bytes: one row for each document row."""
    return assigned(documents, shards).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
