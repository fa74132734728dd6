"""Shards against a plain running sum, and the files that are written."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from tools import rows

from docfacts.llm import sharding
from docfacts.llm.sharding import assigned, sharded, write_shards


def plain_shards(table, shards=8):
    """Shard and slot by one running sum over all rows."""
    sized = sorted(((hashlib.md5((t or "").encode()).digest(), i is not None, i or 0), i, t or "") for i, t in table)
    total, n = sum(len(t.encode()) + 1 for _, _, t in sized), len(sized)
    share = max(shards * sharding.WHOLE, min(max(-(-n // sharding.RANGE_ROWS), sharding.LEAST_RANGES), sharding.MOST_RANGES))
    groups = defaultdict(lambda: [0, 0])
    for _, _, t in sized:
        groups[t][0] += len(t.encode()) + 1
        groups[t][1] += 1
    out, so_far, begin, slots = [], 0, {}, defaultdict(int)
    for _, i, t in sized:
        size = len(t.encode()) + 1
        begin.setdefault(t, so_far)
        b, r = groups[t]
        middle = 2 * so_far + size if b * share > total or r * share > n else 2 * begin[t] + b
        shard = min(shards - 1, shards * middle // (2 * total))
        out.append((i, size, zlib.crc32(t.encode()), shard, slots[shard]))
        slots[shard] += 1
        so_far += size
    return sorted(out, key=repr)


def mixed(n=3000):
    table = [(i, f"text {i % 997} " + "é" * (i * 37 % 113)) for i in range(n)]
    table += [(n + i, "a hot text") for i in range(n // 2)] + [(n * 2 + i, None if i % 2 else "") for i in range(n // 3)]
    return table + [(n * 3, "very long " * 30_000), (None, "no id"), (None, None), (5, "repeated"), (5, "repeated")]


def test_equals_running_sum(spark, documents):
    table = mixed()
    assert rows(assigned(documents(table), 8)) == plain_shards(table)
    assert rows(assigned(documents(table), 3)) == plain_shards(table, 3)


def test_equal_bytes_and_whole_groups(spark, documents):
    table = [(i, f"text {i // 2} " + "x" * (i // 2 % 50)) for i in range(20_000)]
    found = rows(sharded(documents(table)), "doc_id", "size", "text_crc32", "shard", "slot")
    by_shard = defaultdict(list)
    for doc_id, size, crc, shard, slot in found:
        by_shard[shard].append((slot, size, crc))
    total = sum(size for _, size, *_ in found)
    assert len(by_shard) == 8
    for held in by_shard.values():
        assert sorted(slot for slot, _, _ in held) == list(range(len(held)))
        assert abs(sum(size for _, size, _ in held) - total / 8) <= total / 8 / sharding.WHOLE + 100
    shards_of = defaultdict(set)
    for _, _, crc, shard, _ in found:
        shards_of[crc].add(shard)
    assert all(len(s) == 1 for s in shards_of.values())


def test_overfull_ranges_are_subdivided(spark, documents):
    """Nearly all rows are one short text, nearly all bytes another one: no range keeps more than its bound of either."""
    table = [(i, "s") for i in range(30_000)] + [(100_000 + i, "long " * 2000) for i in range(40)] + [(200_000 + i, f"t{i}") for i in range(500)]
    found = assigned(documents(table), 8, carry=True).groupBy("range").agg(F.sum("size").alias("b"), F.max("size").alias("most"), F.count("*").alias("n")).collect()
    ranges = sharding.LEAST_RANGES
    share = 8 * sharding.WHOLE
    total, n = sum(r.b for r in found), sum(r.n for r in found)
    assert all(r.n <= (2 / ranges + 1 / share) * n and r.b - r.most <= (2 / ranges + 1 / share) * total for r in found)
    assert rows(assigned(documents(table), 8)) == plain_shards(table)


def test_written_shards_hold_all_rows(spark, documents, tmp_path):
    df = documents(mixed(300)).withColumns({"range": F.lit("r"), "shard": F.lit("s"), "slot": F.lit(1), "size": F.lit(None).cast("int"), "record": F.lit(2), "tie": F.lit(3), "digest": F.lit("d")})
    write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back.select("record.*")) == rows(df)
    want = rows(assigned(df), "doc_id", "shard", "slot")
    assert rows(back.select(F.col("record.doc_id").alias("doc_id"), "shard", "slot")) == want


def test_empty_one_and_huge(spark, documents):
    assert sharded(documents([(1, "a")]).where("false")).collect() == []
    assert rows(sharded(documents([(1, None)]))) == [(1, 1, 0, "bytes", 4, 0, None)]
    table = [(i, "tiny") for i in range(50)] + [(99, "huge" * 100_000)]
    assert rows(assigned(documents(table))) == plain_shards(table)
