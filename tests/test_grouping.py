"""Results stay whole and lists stay bounded when one key holds a large part of the rows."""

from __future__ import annotations

import itertools

import brute
import pytest
from plans import executed_plan
from pyspark.sql import functions as F

from docfacts.operators import labels, prompts, verdicts
from docfacts.operators.grouping import bounded_lists, previous_in_group


def _heavy(spark, n: int = 3000):
    """A third of the rows under key 0, the rest three per key."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.floor(F.col("id") / 5)).cast("int").alias("k"),
        F.lit("copy").alias("text"),
    )


@pytest.mark.parametrize("block", [7, 100, 65_536])
def test_lists_are_bounded_and_whole(spark, block):
    lists = bounded_lists(_heavy(spark), "k", "id", F.struct("id", "text"), list_size=50, block=block).collect()
    assert max(r.n_items for r in lists) == 50
    by_key: dict = {}
    for r in sorted(lists, key=lambda r: (r.k, r.list_no)):
        by_key.setdefault(r.k, []).append(r)
    for k, pieces in by_key.items():
        ids = [i.id for r in pieces for i in r["items"]]
        assert ids == sorted(r.id for r in _heavy(spark).where(F.col("k") == k).collect()) if k in (0, 1) else ids == sorted(ids)
        assert [r.list_no for r in pieces] == list(range(len(pieces))) and {r.n_lists for r in pieces} == {len(pieces)}
        assert all(r.n_items == 50 for r in pieces[:-1])
    assert sum(r.n_items for r in lists) == 3000


@pytest.mark.parametrize("block", [1, 3, 7, 100_000])
def test_previous_value_over_ranges_and_gaps(spark, block):
    rows = [(run, version, f"{run}-{version}") for run in (1, 2, 3) for version in range(0, 40 * run, run) if version % 11]
    df = spark.createDataFrame(rows, "run_id int, version int, prompt string").repartition(4)
    got = {(r.run_id, r.version): r.previous for r in previous_in_group(df, "run_id", "version", "prompt", block).collect()}
    want = {}
    for run, group in itertools.groupby(rows, key=lambda r: r[0]):
        before = None
        for _, version, prompt in group:
            want[run, version] = before
            before = prompt
    assert got == want


def test_similarity_agrees_with_plain_python(spark):
    texts = ["Read the PDF file", "read a pdf file, and the table", "", "été_1 é Été_1 of of of", "Of été_1", "a b", "c d"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "run_id int, version int, prompt string")
    for block in (2, 1000):
        got = {r.version: r.similarity for r in prompts.prompt_similarity(df, block=block).collect()}
        assert got == {i + 1: pytest.approx(brute.similarity(a, b)) for i, (a, b) in enumerate(zip(texts, texts[1:]))}


def test_a_long_run_is_spread_over_tasks(spark):
    """One run with 100,000 versions: the shuffle spreads its ranges over all partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    history = spark.range(100_000).select(F.lit(1).alias("run_id"), F.col("id").alias("version"), F.format_string("word%d same", "id").alias("prompt"))
    steps = previous_in_group(history.repartition(8), "run_id", "version", "prompt")
    spread = [r.n for r in steps.where("previous is not null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(spread) == 4 and max(spread) < 50_000
    assert steps.where("version > 0 and previous <> concat('word', version - 1, ' same')").isEmpty()
    assert steps.where("previous is null").count() == 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batches_cover_every_epoch(spark):
    ids = spark.range(1000).unionAll(spark.range(10)).withColumnRenamed("id", "doc_id")
    rows = labels.mini_batches(ids, buckets=16, seed=4).collect()
    orders = []
    for epoch in range(3):
        mine = sorted((r.batch, r.position, r.doc_id) for r in rows if r.epoch == epoch)
        assert [(b, p) for b, p, _ in mine] == [(i // 3, i % 3) for i in range(1000)]
        assert sorted(i for *_, i in mine) == list(range(1000))
        orders.append([i for *_, i in mine])
    assert orders[0] != orders[1] != orders[2]
    again = labels.mini_batches(ids, buckets=7, seed=4).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}
    assert {tuple(r) for r in labels.mini_batches(ids, seed=5).collect()} != {tuple(r) for r in rows}


def test_copies_are_counted_not_paired(spark):
    predicted = spark.createDataFrame([(1, "AlCo", 3.414)] * 300 + [(1, None, None), (2, "Fe", 2.8), (3, "Ni", 3.5)],
                                      "paper_id int, name string, lattice_constant double")
    labelled = spark.createDataFrame([(1, "AlCo", 3.4141)] * 299 + [(1, "AlCo", 3.415), (1, None, None), (2, "Fe", 2.8), (4, "Cu", 3.6)],
                                     "paper_id int, name string, lattice_constant double")
    got = {r.paper_id: r for r in labels.label_reconcile(predicted, labelled).collect()}
    assert (got[1].n_pred, got[1].n_label, got[1].n_match, got[1].same_count, got[1].verdict) == (301, 301, 300, True, "no match")
    assert got[2].verdict == "match"
    assert (got[3].n_extra, got[3].n_missed, got[4].n_extra, got[4].n_missed) == (1, 0, 0, 1)
    assert "Join" not in executed_plan(labels.label_reconcile(predicted, labelled))


def test_label_sets(spark):
    table = spark.createDataFrame(
        [(1, 7, "B", "B1", None, float("nan"), "BCC", "cast", "d"), (0, 7, "A", "A1", "A1", 3.2, "FCC", None, "d")],
        "row_no int, Paperid int, HEAname string, nominal_compositions string, measured_compositions string,"
        " RT_Lattice_Constant_A double, Phase string, Processing_Method string, Ref string",
    )
    row = labels.label_sets(labels.label_records(table, keep=("row_no", "Paperid")), "row_no", folder="p/").first()
    assert (row.path, row.list_no, row.n_lists) == ("p/7.pdf", 0, 1) and [r.name for r in row.records] == ["A", "B"]
    assert row.records[1].lattice_constant is None and row.records[0].measured_composition == "A1"


def test_verdicts(spark):
    text = "Yes\n\n2. no\nYES it is\nunclear\nyes\nyes\nyes\nyes\nNo"
    df = spark.createDataFrame([(1, text), (2, "no")], "doc_id long, verdict_text string")
    repeated = df.unionAll(spark.createDataFrame([(1, "Another"), (3, "no batch")], "doc_id long, verdict_text string"))
    got = {r.question_no: (r.n_answers, r.n_yes, r.n_no, r.n_unclear, r.good_rate) for r in verdicts.verdict_scores(df).collect()}
    assert got[1] == (2, 1, 1, 0, 0.5) and got[2] == (1, 0, 1, 0, 0.0)
    assert got[4] == (1, 0, 0, 1, None) and got[9] == (1, 0, 1, 0, 1.0)
    batches = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 0, 2), (1, 5, 0, 1)], "epoch int, batch long, position int, doc_id long")
    joined = {(r.epoch, r.batch): (r.n_verdicts, r.feedback) for r in verdicts.batch_feedback(batches, repeated).collect()}
    assert joined == {(0, 0): (3, "no\n\nAnother\n\n" + text), (1, 5): (2, "Another\n\n" + text)}
    twelve = spark.createDataFrame([(1, "\n".join(["yes"] * 12))], "doc_id long, verdict_text string")
    rates = {r.question_no: r.good_rate for r in verdicts.verdict_scores(twelve, good_if_no=(2, 12)).collect()}
    assert rates == {n: 0.0 if n in (2, 12) else 1.0 for n in range(1, 13)}
