from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfacts.llm import packing
from docfacts.llm.tokenizer import Encoder, special_path

PATH = special_path("word_bpe_49k.json")


@pytest.mark.parametrize("length,windows", [(2048, 64), (32, 4), (7, 1)])
def test_every_id_in_one_piece(spark, documents, monkeypatch, length, windows):
    monkeypatch.setattr(packing, "OPEN_WINDOWS", windows)
    rng = random.Random(length)
    data = [(i, " ".join(rng.choice(["the", "reading", "éclair", "xyzzyx"]) for _ in range(rng.choice([0, 1, 5, 50, 300])))) for i in range(200)]
    data += [(1000, None), (1001, ""), (None, "a b"), (None, "a b"), (1002, "word " * 9000)]
    table = documents(data, 5).withColumn("start", F.lit("clash"))
    found = packing.pack(table, PATH, length, keep_ids=True).collect()
    encoder, expected = Encoder(PATH), defaultdict(list)
    for i, t in data:
        expected[i].append([*encoder.ids(t or "").tolist(), 1])
    pieces, places = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length, ids.tolist(), r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    for i, texts in expected.items():
        for start, size, ids, total in pieces[i]:
            assert any(t[start : start + size] == ids and len(t) == total for t in texts)
        assert sum(p[1] for p in pieces[i]) == sum(map(len, texts))
    padding = 0
    for spans in places.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length
        padding += length - at
    assert padding < 0.1 * length * len(places) + 5 * length


def test_empty(spark, documents):
    assert packing.pack(documents([(1, "a")]).where("false"), PATH).count() == 0


def test_best_fit_emits_the_fullest():
    windows = packing.Windows(10, 2)
    for size in (6, 8, 4):  # 4 fills the first window exactly
        window, offset, emitted = windows.place(size)
        windows.held[window].append((size, offset))
        assert emitted == []
    assert windows.held[0] == [(6, 0), (4, 6)]
    windows.place(5), windows.held.setdefault(2, [])
    *_, emitted = windows.place(6)
    assert emitted == [(8, 0)]
