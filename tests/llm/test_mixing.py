from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm import mixing


def water(sizes: dict, weights=(5, 2, 1), volume=1.5, most=2.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full: set = set()
    while True:
        rest = volume * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target | {s: most * sizes[s] for s in full}
        full |= above


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_words(spark, documents, seed):
    rng = random.Random(seed)
    data = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 400])), rng.choice(["b", "a", "é", None, "hot", "hot", "hot"])) for i in range(600)]
    data += [(1000, None, "a"), (1001, "x y", "small"), (1002, "", "zero")]
    rng.shuffle(data)
    table = documents(data).withColumn("size", F.lit("clash")).withColumn("copies", F.lit(0))
    found = mixing.mixed_words(table).collect()
    sizes: dict = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = water(sizes)
    source = {i: s for i, _, s in data}
    words = {i: len((t or "").split()) for i, t, _ in data}
    taken: dict = dict.fromkeys(sizes, 0)
    assert sorted(r.doc_id for r in found) == sorted(words)
    for r in found:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (words[r.doc_id], sizes[s])
        assert math.isclose(r.target, goal[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        shortest = min((words[i] for i in words if source[i] == s and words[i]), default=0)
        assert abs(taken[s] - goal[s]) <= max(0.001 * goal[s], shortest / 2 + 1e-6)
    again = mixing.mixed_words(table.repartition(7))
    assert sorted(map(tuple, found)) == sorted(map(tuple, again.collect()))


def test_rates_are_tilted(spark):
    sizes = spark.createDataFrame([("a", 10, 50), ("a", 100, 50), ("b", 10, 50), ("b", 100, 50)], "source string, size long, n long")
    goal = spark.createDataFrame([("a", 5500, 3000.0), ("b", 5500, 11000.0)], "source string, source_size long, target double")
    for r in mixing.balanced(sizes, goal).collect():
        rate = lambda z: min(2.0, math.exp(r.dual * z / r.scale))  # noqa: E731, B023
        assert math.isclose(50 * (10 * rate(10) + 100 * rate(100)), r.target, rel_tol=1e-6)
        assert (r.dual < 0) == (r.source == "a")


def test_repeated_rows_and_empty(spark, documents):
    data = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a", "s"), (None, "a b", None)]
    found = rows(mixing.mixed_words(documents(data)), "doc_id", "size", "taken")
    assert len(found) == 4 and all(taken <= 2 * size for _, size, taken in found)
    assert mixing.mixed_words(documents(data).where("false")).count() == 0


def test_documents_are_copied(spark, documents):
    data = [(i, " ".join(["w"] * (i % 9)), "ab"[i % 2]) for i in range(80)]
    table = documents(data)
    taken = {r.doc_id: r.taken for r in mixing.mixed_words(table).collect()}
    copied = mixing.mixed_documents(table)
    assert copied.columns == table.columns
    count = {i: n for i, n in rows(copied.groupBy("doc_id").count())}
    assert all(count.get(i, 0) * len(t.split()) == taken[i] for i, t, _ in data)


@pytest.mark.parametrize("others", [0, 3_000])
def test_a_third_of_equal_rows(spark, documents, monkeypatch, others):
    """Equal rows need not all take the same: the words still come near the target. 407,589 of 450,000 were taken once."""
    monkeypatch.setattr(mixing, "PIECE", 700)
    data = [(7, "w " * 30, "s")] * 5_000 + [(i + 10, "w " * (i % 9 + 1), "s") for i in range(10_000)] + [(i + 50_000, "w " * 20, "t") for i in range(others)]
    table = documents(data)
    sums = mixing.mixed_words(table).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"))
    for r in sums.collect():
        assert abs(r.taken - r.target) <= 0.001 * r.target
    assert sum(r.n for r in sums.collect()) == len(data)
    copied = mixing.mixed_documents(table)
    assert copied.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in sums.collect())
    by_row = rows(mixing.mixed_words(table).where("doc_id = 7").groupBy("taken").count())
    assert len(by_row) == 2 and rows(copied.where("doc_id = 7").groupBy("text").count())[0][1] * 30 == sum(t * n for t, n in by_row)


def test_few_passes_and_an_error_at_the_end(spark, documents, monkeypatch):
    sizes = spark.createDataFrame([("a", z, 1000 // z + 1) for z in range(1, 3000, 7)], "source string, size long, n long")
    total = sizes.selectExpr("sum(size * n)").first()[0]
    goal = spark.createDataFrame([("a", total, 0.37 * total)], "source string, source_size long, target double")
    monkeypatch.setattr(mixing, "PASSES", 8)
    assert mixing.balanced(sizes, goal).count() == 1
    monkeypatch.setattr(mixing, "PASSES", 1)
    with pytest.raises(RuntimeError):
        mixing.balanced(sizes, goal)
