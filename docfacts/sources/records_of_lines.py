"""Records of text files that run over several lines, read by as many tasks as a file has byte ranges.

A file is read line by line in its ranges. Whether a line begins a record may depend on all lines before it (a quoted cell may be open), so
each range is first summarised alone, for every state it could begin in; the summaries, one row for each range, are followed in
order, which gives every range its state, and then the ranges are read again: records inside a range are put
together on the spot, and only the pieces of records that cross a border are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Tells which of some lines begin a record, and the state after them: ``(lines, state) -> (flags, state)``.
Scan = Callable[[list[str], int], tuple[list[bool], int]]

_RECORD = "file string, block long, seq long, part long, text string"


def quoted_cells(lines: list[str], state: int) -> tuple[list[bool], int]:
    """Lines outside of quotes begin a record. State 1: a quoted cell is open. Quotes stand around whole cells and are doubled inside."""
    flags = []
    for line in lines:
        flags.append(state == 0)
        state ^= line.count('"') & 1
    return flags, state


def marked_lines(pattern: str) -> Scan:
    """Lines that match ``pattern`` at their start begin a record."""
    begins = re.compile(pattern).match

    def scan(lines: list[str], state: int) -> tuple[list[bool], int]:
        return [begins(line) is not None for line in lines], state

    return scan


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Runs of lines of one file and range, in order; a range may come in several runs."""
    for batch in batches:
        files, blocks, lines = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        at = 0
        for end in range(1, len(lines) + 1):
            if end == len(lines) or (files[end], blocks[end]) != (files[at], blocks[at]):
                yield (files[at], blocks[at]), lines[at:end]
                at = end


def _summaries(scan: Scan, states: int):
    """For each range and possible first state: whether its first line and any line begins a record, and the last state."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, []
        for now, lines in _ranges(batches):
            if now != key:
                if key is not None:
                    yield _summary(key, found)
                key, found = now, [[None, False, s] for s in range(states)]
            for entry in found:
                flags, entry[2] = scan(lines, entry[2])
                entry[0] = flags[0] if entry[0] is None else entry[0]
                entry[1] = entry[1] or any(flags)
        if key is not None:
            yield _summary(key, found)

    return summarise


def _summary(key: tuple[str, int], found: list) -> pa.RecordBatch:
    columns = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([[e[0] for e in found]]), pa.array([[e[1] for e in found]]), pa.array([[e[2] for e in found]], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["file", "block", "first", "some", "last"])


def _followed(rows: list) -> dict[tuple[str, int], tuple[int, int, bool]]:
    """For each range: its first state, the range in which the record open at its begin began, and whether its last record goes on."""
    out, before = {}, None
    for row in sorted(rows, key=lambda r: (r["file"], r["block"])):
        key = row["file"], row["block"]
        state, origin = (before[1], before[2]) if before is not None and before[0][0] == row["file"] else (0, -1)
        if before is not None and before[0][0] == row["file"] and not row["first"][state]:
            previous = out[before[0]]
            out[before[0]] = previous[0], previous[1], True
        out[key] = state, origin, False
        before = key, row["last"][state], row["block"] if row["some"][state] else origin
    return out


def _gathered(scan: Scan, ranges):
    """The records of each range; pieces of one that crosses a border carry the range in which it began."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held = None, [], []
        state = seq = origin = 0
        leading = goes_on = False

        def flush(last: bool) -> None:
            """The lines held so far are a record, or a piece of one."""
            if not held:
                return
            crosses = leading or (last and goes_on)
            rows.append((key[0], origin if leading else key[1], None if leading else seq, key[1] if crosses else None, "\n".join(held)))
            held.clear()

        for now, lines in _ranges(batches):
            if now != key:
                flush(True)
                key, seq, leading = now, -1, True
                state, origin, goes_on = ranges.value[now]
            flags, state = scan(lines, state)
            for begins, line in zip(flags, lines):
                if begins:
                    flush(False)
                    leading, seq = False, seq + 1
                held.append(line)
            if len(rows) >= 1000:
                yield _batch(rows)
                rows.clear()
        flush(True)
        yield _batch(rows)

    return gather


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["file", "block", "seq", "part", "text"])


def records_of_lines(spark: SparkSession, path: str, scan: Scan, states: int = 1) -> DataFrame:
    """The records of all files under ``path``: ``file, block, seq, text``, where ``block`` and ``seq`` give their order in a file.

    Lines end with a line feed, which is kept inside a record. What stands before the first record of a file is left out. A record is held whole by
    one task, a range is not.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    summaries = lines.mapInArrow(_summaries(scan, states), "file string, block long, first array<boolean>, some array<boolean>, last array<int>")
    ranges = spark.sparkContext.broadcast(_followed(summaries.collect()))  # one row for each byte range
    found = lines.mapInArrow(_gathered(scan, ranges), _RECORD).where("block >= 0")
    whole = found.where("part is null").drop("part")
    pieces = found.where("part is not null").groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "text"))).alias("p"))
    joined = pieces.select("file", "block", F.element_at("p", 1)["seq"].alias("seq"), F.array_join(F.col("p.text"), "\n").alias("text"))
    return whole.unionAll(joined)
