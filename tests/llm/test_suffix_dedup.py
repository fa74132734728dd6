from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm import suffix_dedup as sd
from docfacts.llm.common import SLICE_BYTES, rolling


def brute(data: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    first: dict[bytes, int] = {}
    for i, t in data:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1 if i is not None else 0):
            first[raw[k : k + length]] = min(i, first.get(raw[k : k + length], i))
    out = []
    for i, t in data:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1 if i is not None else 0):
            if first[raw[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    letters = "abé e" if seed < 3 else "a"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    data: list[tuple] = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 200), (9, "x" * 120), (9, "x" * 60), (None, "x" * 90)]
    for i in range(10, 60):
        data.append((i, "".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randrange(90)) for _ in range(rng.randrange(6)))))
    rng.shuffle(data)
    table = documents(data).withColumn("n_bytes", F.lit("clash"))
    assert rows(sd.removed_bytes(table)) == brute(data)


def test_empty_table(spark, documents):
    assert sd.removed_bytes(documents([(1, "a")]).where("false")).count() == 0


def test_long_copies(spark, documents):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij ") for _ in range(200_000))
    data = [(1, long), (2, long[:100_000] + "#" + long[100_000:]), (3, long[500:600])]
    assert rows(sd.removed_bytes(documents(data))) == brute(data)


def test_text_form_keeps_whole_characters(spark, documents):
    passage = "é" * 40
    out = rows(sd.without_repeats(documents([(1, passage + "ü tail"), (2, "ö" + passage + "ä end")])), "doc_id", "text", "n_chars")
    assert out == [(1, passage + "ü tail", 46), (2, "ö end", 5)]  # of "ä" the first byte is part of the passage


def suffixes(strings: list[bytes]) -> list[tuple]:
    """All suffixes in order: ends are smaller than symbols, and among themselves by string."""
    every = [([(c + 1, 0) for c in s[k:]] + [(0, i)], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)]
    return sorted(every)


@pytest.mark.parametrize("seed", range(6))
def test_transform_and_prefixes(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab" if seed % 2 else b"abcdz") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 30))]
    joined, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings)))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    used = np.zeros(256, bool)
    used[joined] = True
    transform, prefixes = sd.collection_transform(np.cumsum(used).astype(np.uint8)[joined], starts, sizes, sd.Scratch())
    order = suffixes(strings)
    code = np.cumsum(used)
    assert transform.tolist() == [code[strings[i][k - 1]] if k else 0 for _, i, k in order]
    common = [0] + [next((n for n, (x, y) in enumerate(zip(a[0], b[0])) if x != y or not x[0]), 0) for a, b in zip(order, order[1:])]
    assert prefixes.tolist() == common
    piece, offset, place = sd.suffix_places(transform, sizes, 3)
    assert sorted(zip(place.tolist(), piece.tolist(), offset.tolist())) == [(n, i, k) for n, (_, i, k) in enumerate(order) if len(strings[i]) - k >= 3]


def test_collections_in_files(monkeypatch):
    monkeypatch.setattr(sd, "IN_FILES", 10)
    test_transform_and_prefixes(1)


def test_a_slice_needs_little_memory():
    """What is held while a slice of texts is cut stays a small multiple of its bytes, tables of powers included."""
    data = np.random.default_rng(3).integers(97, 123, SLICE_BYTES).astype(np.uint8)
    rolling.cache_clear()
    tracemalloc.start()
    try:
        start, size, *_ = sd.cut_pieces(data, np.array([0, len(data)]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert start[0] == 0 and start[-1] + size[-1] == len(data)
    assert peak < 32 * len(data)
