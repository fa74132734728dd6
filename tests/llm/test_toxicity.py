from __future__ import annotations

import math
import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm import toxicity as tx


def corpus(rng: random.Random, n: int):
    plain = [f"word{k}" for k in range(400)]
    data, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot", "scum,", "vile!"]))
        data.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return data, labels


def test_held_out_accuracy(spark, documents):
    data, labels = corpus(random.Random(1), 900)
    data += [(5000, None), (5001, ""), (None, "word1"), (5002, "word1 " * 50_000 + "idiot")]
    frame = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    table = documents(data).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(0))
    found = {r.doc_id: r for r in tx.toxicity(table, frame).collect()}
    assert len(found) == len(data)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in set(held)) for i in truth)
    assert sum(found[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert found[5000].score == found[5001].score and found[5002].predicted == 1


def test_held_out_labels_are_not_used(spark, documents):
    data, labels = corpus(random.Random(2), 200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    scores = [rows(tx.toxicity(documents(data), spark.createDataFrame(x, schema))) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_repeated_rows_are_learnt_once(spark, documents):
    data, labels = corpus(random.Random(4), 200)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    often = data + [row for row in data if row[0] % 3 == 0] * 5
    once, many = (tx.learn(documents(x), frame) for x in (data, often))
    assert once[0].tolist() == many[0].tolist() and once[1].tolist() == many[1].tolist()


def test_weights_are_those_of_a_plain_learner(spark, documents):
    """The recurrence per coordinate over Python dictionaries, rows in the learner's order."""
    data, labels = corpus(random.Random(7), 300)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5}
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in known], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(7))).collect()]
    texts = dict(data)
    marks = {}
    for i in order:
        _, place = tx.features(pa.array([texts[i]]))
        marks[i] = sorted({*place.tolist(), tx.CONSTANT})
    z, n = dict.fromkeys(range(0), 0.0), {}
    weight = lambda p: 0.0 if abs(z.get(p, 0.0)) <= tx.L1 else -(z[p] - math.copysign(tx.L1, z[p])) / ((tx.BETA + math.sqrt(n[p])) / tx.ALPHA + tx.L2)
    for _ in range(tx.EPOCHS):
        for i in order:
            w = {p: weight(p) for p in marks[i]}
            gradient = 1 / (1 + math.exp(-sum(w.values()))) - known[i]
            for p in marks[i]:
                before = n.get(p, 0.0)
                n[p] = before + gradient**2
                z[p] = z.get(p, 0.0) + gradient - (math.sqrt(n[p]) - math.sqrt(before)) / tx.ALPHA * w[p]
    want = {p: weight(p) for p in z if weight(p)}
    places, weights = tx.learn(documents(data), frame)
    got = dict(zip(places.tolist(), weights.tolist()))
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-6, abs_tol=1e-9) for p in want)


def test_training_is_bounded_in_bytes(spark, documents):
    data, labels = corpus(random.Random(8), 120)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    few, none = (tx.learn(documents(data), frame, train_bytes=b) for b in (40_000, 1))
    assert len(few[0]) and none[0].tolist() == [tx.CONSTANT] and none[1].tolist() == [tx.NO_LABELS]


def test_no_labels_and_empty(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(tx.toxicity(documents([(1, "a")]), labels), "doc_id", "predicted") == [(1, 0)]
    assert tx.toxicity(documents([(1, "a")]).where("false"), labels).count() == 0


def test_features_stay_in_their_text():
    one, _ = tx.features(pa.array(["bad words", "here", None, ""]))
    two, places = tx.features(pa.array(["Bad-words", "HERE"]))
    assert sorted(one.tolist()) == sorted(two.tolist())
    assert set(two.tolist()) == {0, 1} and places.max() < tx.CONSTANT


def test_stage_keeps_clean_rows(spark, documents):
    data, labels = corpus(random.Random(3), 600)
    table = documents(data).withColumn("_x", F.lit(1))
    kept = tx.without_toxic(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = [i for i, _, t in labels if not t]
    assert sum(i in ids for i in clean) >= 0.99 * len(clean)
    assert sum(i in ids for i, _, t in labels if t) <= 0.1 * sum(t for *_, t in labels)
