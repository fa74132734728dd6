"""Helpers shared by the operators: tables, shared folders, words, Arrow batches."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from docfacts.session import work_folder

# Fixed value: what ends a word (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session was given for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_for(documents: DataFrame, bytes_each: int, at_least: int, at_most: int) -> int:
    """A number of groups that follows the bytes of all texts, whatever the session's shuffle partitions are."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(-(-total // bytes_each), at_least), at_most)


#: Rows of an Arrow batch between Spark and Python. Whole texts travel in them, each held several times on the way.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Keep what a task holds of texts on their way small, for jobs of many stages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, min(int(spark.conf.get(key)), BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system. Python workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


#: What empties the caches that outlive a task in a Python worker; their modules add to it.
CACHES: list[Callable] = []


def thrifty(work: Callable, keeps_caches: bool = False) -> Callable:
    """A function over Arrow batches that gives its memory back at the end of the task.

    Unless it ``keeps_caches`` it also drops, at its start, what tasks of other operators left in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_caches:
            for clear in CACHES:
                clear()
            give_back()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def thrifty_group(work: Callable) -> Callable:
    """A function over the Arrow table of a group that gives its memory back after each group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        for clear in CACHES:
            clear()
        try:
            return work(key, table)
        finally:
            give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one slice hold about ``budget`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + budget, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of the texts in it. Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


#: Words longer than this are hashed one by one.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes a step are mixed into the state, all ranges at once; long ones by BLAKE2.

    Sums of powers would not do here: modulo 2^64 they cannot tell some regular words apart, whatever the base.
    """
    sizes = ends - starts
    state = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    left = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    at = 0
    while len(left):
        chunk = eights[starts[left] + at].view("<u8").ravel()
        short = sizes[left] - at
        cut = np.uint64(64) - np.uint64(8) * np.minimum(short, 8).astype(np.uint64)
        state[left] = mix((state[left] ^ ((chunk << cut) >> cut)) + _MIX2)
        at += 8
        left = left[short > 8]
    raw = data.tobytes() if (sizes > LONG_WORD).any() else b""
    for k in np.flatnonzero(sizes > LONG_WORD):
        state[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return state


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: A power is the product of one of so many neighbours and one of the steps, so that the tables stay short.
_STEP_BITS = 12
_STEP = 1 << _STEP_BITS


class Rolling:
    """Hashes of any ranges of a byte array, by differences of one running sum of powers."""

    def __init__(self, room: int = 0):
        self.up, self.down = _powers(_BASE, _STEP - 1), _powers(_INVERSE, _STEP - 1)
        self.widen(room)

    def widen(self, room: int) -> None:
        steps = room >> _STEP_BITS
        self.up_steps, self.down_steps = (_powers(pow(base, _STEP, 1 << 64), steps) for base in (_BASE, _INVERSE))

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >> _STEP_BITS >= len(self.up_steps):
            self.widen(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        terms = out[1:]
        terms[:] = data
        terms += np.uint64(1)
        for step, at in enumerate(range(0, len(data), _STEP)):
            some = terms[at : at + _STEP]
            some *= self.up[: len(some)] * self.up_steps[step]
        return np.cumsum(out, out=out)

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = sums[ends]
        out -= sums[starts]
        out *= self.down[starts & (_STEP - 1)]
        out *= self.down_steps[starts >> _STEP_BITS]
        return out


@lru_cache(maxsize=1)
def rolling() -> Rolling:
    """One table of powers for each Python worker, for slices of the usual size; a longer text widens it."""
    return Rolling(SLICE_BYTES + (SLICE_BYTES >> 3))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in joined texts, and for each text the index of its first word (one more at the end).

    ``blank`` says for each byte whether it ends a word.
    """
    space = np.ones(len(data) + 1, bool)
    space[:-1] = blank[data]
    begin = np.empty(len(data) + 1, bool)
    begin[0] = not space[0]
    begin[1:] = space[:-1] & ~space[1:]
    borders = offsets[1:-1]
    inner = borders[~space[borders]] if len(data) else borders
    begin[inner] = True  # a text starts in the middle of a run of letters
    starts = np.flatnonzero(begin)
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = ~space[:-1] & space[1:]
    cut = inner[~space[inner - 1]] if len(inner) else inner
    stop[cut] = True
    return starts, np.flatnonzero(stop), np.searchsorted(starts, offsets, side="left")


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
