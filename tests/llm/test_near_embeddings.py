from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm.near_embeddings import nearest_cells, near_duplicates


def brute(vectors: list[tuple]) -> list[tuple]:
    best: dict = {}
    for i, v in vectors:
        if i not in best or (v is not None and (best[i] is None or v < best[i])):
            best[i] = v
    good = {i: np.array(v, float) for i, v in best.items() if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / math.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.95] for i in good}
    out = []
    for i in best:
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near.get(todo.pop(), []) if j not in seen]
            seen.update(new)
            todo += new
        out.append((i, len(near.get(i, [])), min(seen, key=lambda x: (x is None, x)), None if i is None else min(seen) == i))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vectors: list[tuple] = []
    for g in range(40):
        centre = [rng.gauss(0, 1) for _ in range(8)]
        vectors += [(len(vectors) + k, [c + rng.gauss(0, rng.choice([0.01, 0.1, 0.2])) for c in centre]) for k in range(rng.randrange(1, 12))]
    n = len(vectors)
    vectors += [(n, None), (n + 1, []), (n + 2, [0.0] * 8), (n + 3, [1.0] * 7 + [None]), (n + 4, [1.0] * 7 + [float("inf")]), (n + 5, [1.0] * 7 + [float("nan")])]
    vectors += [(n + 6, vectors[0][1]), (n + 6, vectors[0][1]), (n + 7, [1e30] * 8), (n + 8, [2e30] * 8), (n + 9, [1.0, 2.0, 3.0]), (n + 10, [1.0, 2.0, 3.1]), (n + 11, [5.0]), (n + 12, [7.0])]
    frame = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<double>, label int, member string")
    found = rows(near_duplicates(frame))
    expected = brute(vectors)
    # The index may miss partners at the very threshold; none did here, and none may be made up.
    assert found == expected


def test_hot_group_over_many_blocks(spark, monkeypatch):
    import docfacts.llm.near_embeddings as ne

    monkeypatch.setattr(ne, "BLOCK", 16)
    rng = random.Random(4)
    vectors = [(k, [1 + rng.gauss(0, 0.01) for _ in range(6)]) for k in range(200)] + [(200 + k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(50)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    as_floats = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    assert rows(near_duplicates(frame)) == brute(as_floats)


def test_null_id_and_empty(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert rows(near_duplicates(frame), "vec_id", "n_links", "component_id") == [(1, 0, 1), (None, 0, None)]
    assert near_duplicates(frame.where("false")).count() == 0


def test_cells_come_in_order():
    first, second = np.array([0.5, 0.0, 0.2]), np.array([0.3, 0.1])
    visited = list(nearest_cells(first, second, 0.5))
    bounds = [first[i] + second[j] for i, j in visited]
    assert bounds == sorted(bounds)
    assert set(visited) == {(i, j) for i in range(3) for j in range(2) if first[i] + second[j] <= 0.5}


def spanned(n: int, span: int, size: int = 64, seed: int = 0) -> np.ndarray:
    """Vectors of ``size`` numbers that lie in a space of ``span`` dimensions, in single precision."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(size, span)))[0]
    return (rng.normal(size=(n, span)) @ basis.T).astype(np.float32)


def partner_counts(vectors: np.ndarray) -> np.ndarray:
    unit = vectors.astype(np.float64)
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    return np.concatenate([(unit[a : a + 1000] @ unit.T >= 0.95).sum(1) - 1 for a in range(0, len(unit), 1000)])


def found_counts(spark, vectors: np.ndarray, **options) -> np.ndarray:
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": vectors.tolist()}), "vec_id long, embedding array<float>").repartition(4)
    return near_duplicates(frame, **options).select("vec_id", "n_links").toPandas().sort_values("vec_id")["n_links"].to_numpy()


@pytest.mark.parametrize("span", [3, 4, 8, 64])
def test_recall_on_data_of_low_span(spark, span):
    vectors = spanned(5_000, span)
    true, found = partner_counts(vectors), found_counts(spark, vectors)
    assert (found <= true).all() and found.sum() >= 0.995 * true.sum()


def test_exact_way(spark):
    vectors = spanned(3_000, 4, seed=1)
    assert (found_counts(spark, vectors, target_recall=1) == partner_counts(vectors)).all()


def test_many_equal_vectors_are_one(spark):
    """Linear work: 60,000 copies and a near one would be billions of pairs."""
    same = F.array(*[F.lit(float(x)).cast("float") for x in range(1, 9)])
    near = F.array(*[F.lit(x + 0.01).cast("float") for x in range(1, 9)])
    frame = spark.range(60_001).select(F.col("id").alias("vec_id"), F.when(F.col("id") == 17, near).otherwise(same).alias("embedding"))
    groups = near_duplicates(frame).groupBy("n_links", "component_id", "kept").count()
    assert rows(groups) == [(60_000, 0, False, 60_000), (60_000, 0, True, 1)]
