"""Agreement under a tolerance against a search for the largest matching."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docfacts.functions.matching import matches_within
from docfacts.operators.grouping import chains_within
from docfacts.operators.labels import label_reconcile_within, reconcile_chains

SIDES = "paper_id int, name string, lattice_constant double"


def largest_matching(left: list[float], right: list[float], tolerance: float) -> int:
    """Augmenting paths over all pairs that are near enough."""
    partner: dict[int, int] = {}

    def augment(i: int, seen: set[int]) -> bool:
        for j, b in enumerate(right):
            if abs(left[i] - b) <= tolerance and j not in seen:
                seen.add(j)
                if j not in partner or augment(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(augment(i, set()) for i in range(len(left)))


def test_sweep_finds_the_largest_matching(spark):
    rng = random.Random(3)
    cases = []
    for k in range(400):
        step = rng.choice([1, 2, 5, 9])
        left = sorted(rng.randrange(0, 25 * step) / 16 for _ in range(rng.randrange(0, 14)))
        right = sorted(rng.randrange(0, 25 * step) / 16 for _ in range(rng.randrange(0, 14)))
        cases.append((k, left, right))
    entries = [(k, [(v, left.count(v), right.count(v)) for v in sorted({*left, *right})]) for k, left, right in cases]
    df = spark.createDataFrame(entries, "k int, e array<struct<v:double,p:bigint,l:bigint>>")
    got = {r.k: r.n for r in df.select("k", F.expr(matches_within("e", 0.25)).alias("n")).collect()}
    assert got == {k: largest_matching(left, right, 0.25) for k, left, right in cases}


@pytest.mark.parametrize("cells", [1, 3, 1000])
def test_chains_end_at_gaps(spark, cells):
    rng = random.Random(cells)
    rows = [(key, v) for key in ("a", "b", "c") for v in {rng.randrange(-300, 300) / 8 for _ in range(150)}]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {(r.k, r.v): r.chain for r in chains_within(df, "k", "v", 0.25, cells=cells).collect()}
    want = {}
    for key in "abc":
        values = sorted(v for k, v in rows if k == key)
        for i, v in enumerate(values):
            want[key, v] = v if i == 0 or v - values[i - 1] > 0.25 else want[key, values[i - 1]]
    assert got == want


def _tables(spark, predicted, labelled):
    return spark.createDataFrame(predicted, SIDES).repartition(3), spark.createDataFrame(labelled, SIDES).repartition(3)


def test_agreement_over_papers(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, float("nan"), *[3 + rng.randrange(40) * 0.0002 for _ in range(12)]])
    predicted = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", "A", "B"]), value()) for _ in range(300)]
    labelled = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", "A", "B"]), value()) for _ in range(300)]
    known = lambda x: x is not None and x == x
    want: dict = {}
    for paper in (None, 1, 2, 3):
        met = 0
        for name in (None, "", "A", "B"):
            left, right = ([r[2] for r in side if r[:2] == (paper, name)] for side in (predicted, labelled))
            met += largest_matching([x for x in left if known(x)], [x for x in right if known(x)], 5e-4)
            met += min(sum(not known(x) for x in left), sum(not known(x) for x in right))
        want[paper] = sum(r[0] == paper for r in predicted), sum(r[0] == paper for r in labelled), met
    got = {r.paper_id: (r.n_pred, r.n_label, r.n_match) for r in label_reconcile_within(*_tables(spark, predicted, labelled)).collect()}
    assert got == want


def test_by_hand(spark):
    one = lambda a, b: label_reconcile_within(*_tables(spark, [(1, "x", v) for v in a], [(1, "x", v) for v in b])).first()
    # Apart when rounded to three decimals, but near each other.
    assert one([3.0004], [3.0006]).verdict == "match"
    assert one([3.0004], [3.001]).verdict == "no match"
    # a~b~c: two pairs, although the nearest pair would leave the ends alone.
    chain = one([3.0, 3.0008], [3.0004, 3.0012])
    assert (chain.n_match, chain.verdict) == (2, "match")
    assert one([3.0] * 5, [3.0] * 3 + [3.0004]).n_match == 4


def test_one_heavy_material_is_cut_at_gaps(spark):
    n = 30_000
    predicted = spark.range(n).select(F.lit(1).alias("paper_id"), F.lit("hot").alias("name"), (F.lit(3.0) + F.col("id") % 997 * 0.01).alias("lattice_constant"))
    labelled = predicted.withColumn("lattice_constant", F.col("lattice_constant") + 0.0003)
    details = reconcile_chains(predicted, labelled)
    assert details.count() == 997 and details.agg(F.sum("n_match")).first()[0] == n
    assert details.agg(F.max("n_pred")).first()[0] <= 31


def test_empty_tables_and_extra_columns(spark):
    predicted, labelled = _tables(spark, [(1, "x", 3.0)], [])
    assert label_reconcile_within(predicted, labelled).collect()[0].n_missed == 0
    assert label_reconcile_within(labelled, labelled).collect() == []
    clashing = predicted.withColumns({c: F.lit(1) for c in ("p", "l", "v", "paper", "low", "chain", "_key")})
    assert label_reconcile_within(clashing, clashing).first().verdict == "match"
