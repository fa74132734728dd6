"""Grouping helpers that stay whole and balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docfacts.session import written


def bounded_lists(
    rows: DataFrame, key: str, order: str, item: Column, list_size: int = 10_000, block: int = 65_536
) -> DataFrame:
    """Collect ``item`` per key into sorted lists of ``list_size`` entries (the last one may be shorter).

    ``order`` is a whole number, unique per row of a key. A key's rows are ranked block by block of order
    values, so that no task ranks a whole heavy key, and dealt to lists by rank. One plan for light and heavy keys.
    Result: key, ``list_no``, ``n_lists``, ``n_items``, ``items``.
    """
    cut = rows.select(key, F.col(order).alias("_order"), item.alias("_item")).withColumn("_block", F.floor(F.col("_order") / F.lit(block)))
    by_key = Window.partitionBy(key)
    earlier = by_key.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        cut.groupBy(key, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(by_key).alias("_all"))
    )
    inside = Window.partitionBy(key, "_block").orderBy("_order")
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1).join(blocks, [key, "_block"])
    return (
        ranked.withColumn("list_no", F.floor((F.col("_before") + F.col("_rank")) / F.lit(list_size)).cast("int"))
        .groupBy(key, "list_no")
        .agg(
            F.ceil(F.max("_all") / F.lit(list_size)).cast("int").alias("n_lists"),
            F.sort_array(F.collect_list(F.struct("_order", "_item"))).alias("_items"),
        )
        .select(key, "list_no", "n_lists", F.size("_items").alias("n_items"), F.col("_items._item").alias("items"))
    )


def previous_in_group(rows: DataFrame, key: str, order: str, value: str, block: int = 256) -> DataFrame:
    """Adds ``previous``: the value before this one in its group, by a whole-number order column.

    Groups are cut into ranges of ``block`` order values, so a long group is spread over
    many tasks. The first row of a range takes the last value of the range before, which
    is one row per range. Keeps ``_block`` so that later grouping by key, ``_block``
    and more needs no further shuffle.
    """
    cut = rows.select(key, order, value, F.floor(F.col(order) / F.lit(block)).cast("bigint").alias("_block"))
    in_block = Window.partitionBy(key, "_block").orderBy(order)
    last = cut.groupBy(key, "_block").agg(F.max_by(value, order).alias("_carry"))
    by_block = Window.partitionBy(key).orderBy("_block")
    carried = last.select(key, F.lead("_block").over(by_block).alias("_block"), "_carry").where(
        F.col("_block").isNotNull()
    )
    return (
        cut.withColumn("previous", F.lag(value).over(in_block))
        .withColumn("_first", F.row_number().over(in_block) == 1)
        .join(carried, [key, "_block"], "left")
        .withColumn("previous", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("previous")))
        .drop("_first", "_carry")
    )


def spread_positions(rows: DataFrame, by: str, order: Sequence[str], bucket: str) -> DataFrame:
    """Adds ``position``, the 0-based rank within ``by``, without sorting a whole ``by`` in one task.

    ``bucket`` must rise with ``order`` and, like ``by``, take few values by construction
    (epochs times a fixed number of buckets), so the offsets are small enough to broadcast.
    """
    earlier = Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(by, bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(by, bucket, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(by, bucket).orderBy(*order)
    return (
        rows.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), [by, bucket])
        .withColumn("position", F.col("_offset") + F.col("_inside") - 1)
        .drop("_inside", "_offset")
    )


def with_position(rows: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Adds the 0-based place in the order of all rows, as a column.

    Rows are range-partitioned and sorted once, into a table in the shared folder; a place is the place in its part and the rows of the parts
    before it (one number for each part). End ``order`` with what tells rows apart, so that no value fills a part.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranked")
    parts = sorted(held.groupBy("_part").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_part"])
    shifts, before = [], 0
    for part in parts:
        shifts.append((part["_part"], before - part["first"]))
        before += part["n"]
    by_part = F.broadcast(rows.sparkSession.createDataFrame(shifts, "_part int, _shift long"))  # one row for each part
    return held.join(by_part, "_part").withColumn(name, F.col("_row") + F.col("_shift")).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def chains_within(rows: DataFrame, key: str, value: str, tolerance: float, cells: int = 16) -> DataFrame:
    """Adds ``chain``, the least value of the chain that a value belongs to: neighbours in a chain differ by ``tolerance`` at most.

    ``value`` holds finite doubles, distinct within ``key`` (which is not null). Values are ordered in blocks of ``cells`` tolerances, and a block
    learns the last value and the last chain before it from one row a block, so no task orders a whole heavy key.
    """
    width = tolerance * cells if tolerance > 0 else 1.0
    cut = rows.withColumn("_block", F.floor(F.col(value) / F.lit(width)))
    inside = Window.partitionBy(key, "_block").orderBy(value)
    by_block = Window.partitionBy(key).orderBy("_block")
    last = cut.groupBy(key, "_block").agg(F.max(value).alias("_last"))
    carried = last.select(key, "_block", F.lag("_last").over(by_block).alias("_carry"))
    previous = F.coalesce(F.lag(value).over(inside), F.col("_carry"))
    begun = cut.join(carried, [key, "_block"]).withColumn("_begin", F.when(previous.isNull() | (F.col(value) - previous > tolerance), F.col(value)))
    starts = begun.groupBy(key, "_block").agg(F.max("_begin").alias("_start"))
    before = F.last("_start", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    so_far = F.last("_begin", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chained = begun.withColumn("_so_far", so_far).join(starts.select(key, "_block", before.alias("_before")), [key, "_block"])
    return chained.withColumn("chain", F.coalesce("_so_far", "_before")).drop("_block", "_carry", "_begin", "_so_far", "_before")
