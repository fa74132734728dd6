"""Strict reading of compositions: by hand, next to the usual reading, and on any text."""

from __future__ import annotations

import random

import pytest
from plans import executed_plan
from pyspark.sql import functions as F

from docfacts.functions import composition as C
from docfacts.functions.strict_composition import SYMBOLS, parse_strict
from docfacts.operators.compositions import check_compositions, parse_and_normalize


def _read(spark, texts, parse):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("p", F.expr(parse("t")))
    return [r.p.asDict() if r.p is not None else None for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, amounts, unit, problems",
    [
        ("Al 20 at.%", {"Al": 20.0}, "at", []),
        ("Al=20 wt%", {"Al": 20.0}, "wt", []),
        ("Al = 20 wt. % ; Ni=80wt.%", {"Al": 20.0, "Ni": 80.0}, "wt", []),
        ("Not found", None, None, ["Not", "found"]),
        ("FeCrX", None, None, ["X"]),
        ("Al:20 Ni:80", {"Al": 20.0, "Ni": 80.0}, None, []),
        ("Al:Ni=20:80", {"Al": 20.0, "Ni": 80.0}, None, []),
        ("Al:Al=20:80", None, None, ["Al:Al=20:80"]),
        ("Al 20% Ni 80%", {"Al": 20.0, "Ni": 80.0}, None, []),
        ("Al at% 20", None, None, ["at%"]),
        ("Al0.5Nb1e-1Ti.25", {"Al": 0.5, "Nb": 0.1, "Ti": 0.25}, None, []),
        ("Al == 3", None, None, ["="]),
        ("= 3", None, None, ["=", "3"]),
        ("Al 3 4", None, None, ["4"]),
        ("Al＝20，Nb", None, None, ["，"]),
        ("balance Fe", None, None, ["balance"]),
        ("3", None, None, ["3"]),
        ("–", None, None, ["-"]),
        ("é", None, None, ["é"]),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_by_hand(spark, text, amounts, unit, problems):
    [got] = _read(spark, [text], parse_strict)
    assert got == (None if problems is None else {"amounts": amounts, "unit": unit, "problems": problems})


def test_agrees_with_the_usual_reading_where_both_understand(spark):
    rng = random.Random(1)
    number = lambda: rng.choice(["1", "20", "0.5", ".25", "33.3"])
    texts = []
    for _ in range(150):
        names = rng.sample(SYMBOLS, rng.randrange(2, 6))
        unit = rng.choice(["at%", "wt%", "at.%", "%"])
        texts += ["".join(n + rng.choice(["", number()]) for n in names), ", ".join(f"{n} {number()}{unit}" for n in names)]
        texts += [":".join(names) + "=" + ":".join(number() for _ in names)]
    for text, strict, usual in zip(texts, _read(spark, texts, parse_strict), _read(spark, texts, C.parse_composition)):
        assert strict["problems"] == [] and strict["amounts"] == usual["amounts"], text
        # The usual reading takes a formula that adds up to 100 as atomic percent.
        assert strict["unit"] == usual["unit"] or strict["unit"] is None


def test_nothing_is_passed_over(spark):
    """On random texts: a result only if every token is known, and never both a result and problems."""
    rng = random.Random(2)
    parts = ["Al", "Nb", "Xx", "20", "-3", "at%", " at. %", "wt%", "=", ":", " ", ",", "(", "word", "%", "–", "½", "\n", "C", "1e3"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    for text, got in zip(texts, _read(spark, texts, parse_strict)):
        if got is None:
            assert not text.strip(" ,\n")
        elif got["amounts"] is not None:
            assert got["problems"] == [] and not any(bad in text for bad in ("Xx", "-3", "(", "word", "½")), text
        else:
            assert got["problems"], text


def test_a_long_text(spark):
    [good, bad] = _read(spark, ["AlNb0.5" * 10_000, "AlNb0.5?" * 3_000], parse_strict)
    assert good["amounts"] == {"Al": 10_000.0, "Nb": 5_000.0} and len(bad["problems"]) == 3_000 and bad["amounts"] is None


def test_operators(spark):
    df = spark.createDataFrame([("AlNb", "Al 50 at.% Nb 50 at.%", "Not found"), ("AlNb", "Not found", None)], "name string, nominal_composition string, measured_composition string")
    done = parse_and_normalize(df, "nominal_composition", "n", strict=True).collect()
    assert done[0].n_fractions == {"Al": 0.5, "Nb": 0.5} and done[0].n_problems == [] and done[1].n_fractions is None and done[1].n_problems == ["Not", "found"]
    rows = check_compositions(df, strict=True).collect()
    assert rows[0].consistency_check == "OK"
    assert rows[0].measured_problems == ["Not", "found"] and rows[1].measured_problems is None and rows[0].measured_parsed is None
    usual = check_compositions(df)
    assert "nominal_problems" not in usual.columns and usual.collect()[0].measured_parsed == '{"No": 1.0}'


def test_one_narrow_stage(spark, tmp_path):
    spark.createDataFrame([("AlNb", "Al2Nb")], "name string, nominal_composition string").write.parquet(str(tmp_path / "t"))
    plan = executed_plan(check_compositions(spark.read.parquet(str(tmp_path / "t")), strict=True))
    assert "Exchange" not in plan and "Python" not in plan
