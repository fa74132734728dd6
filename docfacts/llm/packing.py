"""Packing documents into token sequences of one length: bounded-space online best fit.

Each partition reads its documents once and keeps ``OPEN_WINDOWS`` open windows. A document's
full windows are cut off and closed at once. What remains goes to the open window that it
fills best; where it fits in none and all windows are in use, the fullest window is emitted
with its padding and a new one opened. When the partitions end, their open windows are
merged: their pieces are laid end to end and cut at the window length, so that each merging
task pads one window at most. Only those leftovers carry their ids to the second step:
at most ``OPEN_WINDOWS`` windows for each input partition.

Defined cases: a null text counts as empty, an empty document is its end id alone; repeated
rows and null ids are packed each for itself; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from docfacts.llm.common import slices, thrifty, written
from docfacts.llm.tokenizer import encoder

LENGTH = 2048
OPEN_WINDOWS = 64
END_ID = 1
#: Leftover windows that one merging task takes on.
MERGED_WINDOWS = 4096
_MERGED = 1 << 62

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Windows:
    """The open windows of one partition. ``place`` says where a remainder goes."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free: list[tuple[int, int]] = []  # (free places, window), ascending
        self.opened = 0
        self.held: dict[int, list] = {}

    def new(self) -> int:
        self.opened += 1
        return self.opened - 1

    def place(self, size: int) -> tuple[int, int, list]:
        """The window and offset for a remainder, and the pieces of a window that had to be emitted."""
        emitted: list = []
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                _, fullest = self.free.pop(0)
                emitted = self.held.pop(fullest)
            free, window = self.length, self.new()
            self.held[window] = []
        offset = self.length - free
        if free > size:
            insort(self.free, (free - size, window))
        return window, offset, emitted



def pack(documents: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it starts, how long it is, and its place in a sequence.

    With ``keep_ids`` a column ``ids`` (little-endian 32-bit numbers) is added, so that the rows of
    a sequence in order of ``offset`` are the sequence itself.
    """
    spark = documents.sparkSession
    schema = f"{PIECES}, open boolean, ids binary"
    columns = [f.split()[0] for f in schema.split(", ")]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, codes = Windows(length, OPEN_WINDOWS), encoder(path)
        base = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(codes.ids(text or "").astype("<u4"), np.uint32(END_ID))
                total = len(ids)
                rest = total % length
                for start in range(0, total - rest, length):
                    piece = ids[start : start + length]
                    rows.append((doc_id, start, length, checksum(piece), total, base | windows.new(), 0, False, piece.tobytes() if keep_ids else None))
                if rest:
                    piece = ids[total - rest :]
                    window, offset, emitted = windows.place(rest)
                    rows += [(*r[:-1], r[-1] if keep_ids else None) for r in emitted]
                    windows.held[window].append((doc_id, total - rest, rest, checksum(piece), total, base | window, offset, False, piece.tobytes()))
                    if offset + rest == length:
                        rows += [(*r[:-1], r[-1] if keep_ids else None) for r in windows.held.pop(window)]
            yield _rows(rows, columns)
        yield _rows([(*r[:7], True, r[8]) for held in windows.held.values() for r in held], columns)

    found = written(documents.select("doc_id", "text").mapInArrow(thrifty(first, keeps_caches=True), schema), "packed")
    open_rows = found.where("open")
    count = open_rows.select(F.approx_count_distinct("sequence_id")).first()[0]
    tasks = max(1, round(count / MERGED_WINDOWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _MERGED | TaskContext.get().partitionId() << 32
        sequence, offset = 0, 0
        for batch in batches:
            rows = []
            for doc_id, start, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                ids = np.frombuffer(raw, "<u4")
                at = 0
                while at < len(ids):
                    piece = ids[at : at + length - offset]
                    rows.append((doc_id, start + at, len(piece), checksum(piece), total, base | sequence, offset, False, piece.tobytes() if keep_ids else None))
                    at += len(piece)
                    offset += len(piece)
                    if offset == length:
                        sequence, offset = sequence + 1, 0
            yield _rows(rows, columns)

    merged = (
        open_rows.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(thrifty(merge, keeps_caches=True), schema)
    )
    out = found.where("not open").unionByName(merged)
    return out.drop("open") if keep_ids else out.drop("open", "ids")


def _rows(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], columns)
