from __future__ import annotations

import random

import brute
import pytest
from plans import executed_plan
from pyspark.sql import functions as F

from docfacts.functions import composition as C
from docfacts.functions.numbers import compensated_sum, double_text, fixed_decimals
from docfacts.operators import compositions

PARSED = [
    ("Al0.25NbTiMoV", {"Al": 0.25, "Nb": 1, "Ti": 1, "Mo": 1, "V": 1}, None),
    ("Nb25Mo25Ta25W25", {"Nb": 25, "Mo": 25, "Ta": 25, "W": 25}, "at"),
    ("Al:Nb:Ti=1:1:2", {"Al": 1, "Nb": 1, "Ti": 2}, None),
    ("Al Nb Ti = 1 1 2", {"Al": 1, "Nb": 1, "Ti": 2}, None),
    ("Al 20at.% Nb 80at.%", {"Al": 20, "Nb": 80}, "at"),
    ("Al 20 wt% Nb 30 wt%", {"Al": 20, "Nb": 30}, None),
    ("Al 20wt% Nb 30wt%", {"Al": 20, "Nb": 30}, "wt"),
    ("Al=20 wt%", {"Al": 20}, None),
    ("Al=20, Nb=30", {"Al": 1, "Nb": 1}, None),
    ("Al = 20 Nb = 30", {"Al": 20, "Nb": 30}, None),
    ("Al 20 Nb", {"Al": 20}, None),
    ("Al2CoAl", {"Al": 3, "Co": 1}, None),
    ("(FeCo)2", {"Fe": 1, "Co": 1}, None),
    ("Al.Co-3", {"Al": 1, "Co": -3}, None),
    ("Al:Al=1:3", {"Al": 3}, None),
    ("Not found", {"No": 1}, None),
    ("Not Available", {"No": 1, "Av": 1}, None),
    ("", None, None),
    (" \t", None, None),
    ("none", None, None),
    (None, None, None),
]

VERDICTS = [
    ("HfNbTaTiZr", "Hf1.0Nb1.0Ta1.0Ti1.0Zr1.0", "Hf20.8Nb18.9Ta20.2Ti20.2Zr19.9", 0.0, 0.024, "OK"),
    ("AlCoCrFeNi", "Al1.0Co1.0Cr1.0Fe1.0Ni1.0", "Not found", 0.0, 2.0, "OK"),
    ("AlCo", "Al1.0Co9.0", None, 0.8, None, "OK"),
    ("AlCo", "Al1.0Co9.0", "Not found", 0.8, 2.0, "inconsistent: name,measured"),
    ("AlCo", None, "Al50Co50", 1.0, 1.0, "inconsistent: name,measured"),
    (None, "AlCo", None, None, None, "unknown"),
]


def test_golden_parses(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PARSED)], "i int, txt string")
    rows = df.withColumn("p", F.expr(C.parse_composition("txt"))).orderBy("i").collect()
    assert [(r.p and r.p.amounts, r.p and r.p.unit) for r in rows] == [(m, u) for _, m, u in PARSED]


def test_verdicts(spark):
    data = [(i, n, c, m) for i, (n, c, m, *_) in enumerate(VERDICTS)]
    df = spark.createDataFrame(data, "i int, Name string, `Nominal composition` string, MEASURED_COMPOSITION string")
    rows = compositions.check_compositions(df).orderBy("i").collect()
    for row, (*_, l1_name, l1_measured, verdict) in zip(rows, VERDICTS):
        assert row.l1_nom_vs_name == (None if l1_name is None else pytest.approx(l1_name))
        assert row.l1_nom_vs_measured == (None if l1_measured is None else pytest.approx(l1_measured))
        assert row.consistency_check == verdict
    assert compositions.consistency_summary(compositions.check_compositions(df)).first().asDict() == {
        "n_ok": 3, "n_inconsistent": 2, "n_unknown": 1
    }


def test_check_columns_and_json(spark):
    df = spark.createDataFrame([("AlNb0Ti", "Al0.00005Nb0Ti99999", 7)], "name string, nominal_composition string, extra int")
    row = compositions.check_compositions(df).first()
    assert row.nominal_parsed == '{"Al": 5e-05, "Nb": 0.0, "Ti": 99999.0}'
    assert row["name_without_zero"] == "Ti"
    assert row["cleanned composition"] == "Ti1.0"
    assert row.extra == 7 and row.measured_parsed is None
    with pytest.raises(KeyError):
        compositions.check_compositions(df.drop("nominal_composition"))


def test_check_is_one_narrow_stage(spark, tmp_path):
    spark.createDataFrame(
        [("AlCo", "Al1Co1", "Al50Co50", "x")], "name string, nominal_composition string, measured_composition string, other string"
    ).write.parquet(str(tmp_path / "t"))
    checked = compositions.check_compositions(spark.read.parquet(str(tmp_path / "t")))
    assert "Exchange" not in executed_plan(checked)
    narrow = executed_plan(checked.select("consistency_check"))
    assert "other" not in narrow and "format_number" not in narrow


def test_weight_percent(spark):
    df = spark.createDataFrame([("Al 20wt% Nb 30wt%",), ("Xx 2wt% Al 26.982wt%",), ("Al-1Nb1",)], "txt string")
    got = compositions.parse_and_normalize(df, "txt", "c").select("c_fractions").collect()
    assert got[0][0] == {"Al": pytest.approx(0.69656, abs=1e-5), "Nb": pytest.approx(0.30344, abs=1e-5)}
    assert got[1][0] == {"Xx": pytest.approx(2 / 3), "Al": pytest.approx(1 / 3)}
    assert got[2][0] is None
    ambiguous = spark.createDataFrame([({"Al": 40.0, "Nb": 60.0},)], "m map<string,double>")
    as_weight = C.normalize_composition("m", "cast(null as string)", assume_weight_if_ambiguous=True)
    assert ambiguous.select(F.expr(as_weight)).first()[0] == {
        "Al": pytest.approx(40 / 26.982 / (40 / 26.982 + 60 / 92.906)),
        "Nb": pytest.approx(60 / 92.906 / (40 / 26.982 + 60 / 92.906)),
    }


PIECES = [  # text, pairs (amounts, unit), ratio form, formula; traced by hand
    ("Al 20 at% Nb 80at%", ({"Al": 20, "Nb": 80}, "at"), None, {"Al": 1, "Nb": 1}),
    ("Al 2wt. % Nb -3WT%", ({"Al": 2, "Nb": -3}, "wt"), None, {"Al": 1, "Nb": 1, "W": 1, "T": 1}),
    ("Al = 0.5 Al 1e2at.%", ({"Al": 100.5}, "at"), None, {"Al": 2}),
    ("Al = Nb", (None, None), None, {"Al": 1, "Nb": 1}),
    ("AlNb=1 2", (None, None), {"Al": 1, "Nb": 2}, {"Al": 1, "Nb": 1}),
    ("Al=1 2", (None, None), None, {"Al": 1}),
    ("Fe-3Co.5W1.", (None, None), None, {"Fe": -3, "Co": 0.5, "W": 1}),
    ("Al1e2Nbe5(", (None, None), None, {"Al": 100, "Nb": 1}),
    ("x 20 0.5", (None, None), None, None),
]


def test_parsers_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(PIECES)], "i int, txt string")
    rows = df.select(
        "i", F.expr(C.parse_pairs("txt")).alias("p"), F.expr(C.parse_ratio_form("txt")).alias("r"), F.expr(C.parse_formula("txt")).alias("f")
    ).collect()
    for row in rows:
        text, pairs, ratio, formula = PIECES[row.i]
        assert ((row.p and row.p.amounts, row.p and row.p.unit), row.r, row.f) == (pairs, ratio, formula), text


def test_what_is_printed_is_read(spark):
    """Any composition, printed in each of the spellings, is parsed to itself; its fractions add up to 1."""
    rng = random.Random(5)
    elements = ["Al", "Nb", "Fe", "Co", "W", "V", "Ti", "Zr"]
    data, wanted = [], {}
    for i in range(600):
        amounts = {e: round(rng.choice([1, 2.5, 10, 0.125]) * rng.randint(1, 9), 4) for e in rng.sample(elements, rng.randint(2, 6))}
        unit = rng.choice(["at", "wt"])
        spelling = i % 4
        if spelling == 0:
            text = "".join(f"{e}{a}" for e, a in amounts.items())
        elif spelling == 1:
            text = rng.choice([":", " "]).join(amounts) + "=" + ":".join(map(str, amounts.values()))
        elif spelling == 2:
            text = rng.choice([" ", ", ", "; "]).join(f"{e} {a}{unit}{rng.choice(['%', '.%'])}" for e, a in amounts.items())
        else:
            text = " ".join(f"{e} = {a}" for e, a in amounts.items())
        data.append((i, text))
        hint = unit if spelling == 2 else "at" if spelling == 0 and abs(sum(amounts.values()) - 100) < 1e-3 else None
        wanted[i] = (amounts, hint)
    for row in compositions.parse_and_normalize(spark.createDataFrame(data, "i int, txt string"), "txt", "c").collect():
        amounts, hint = wanted[row.i]
        assert row.c_parsed == pytest.approx(amounts) and row.c_unit == hint, row.txt
        assert sum(row.c_fractions.values()) == pytest.approx(1) and row.c_fractions.keys() == amounts.keys()


def test_any_text_gives_shares_or_nothing(spark):
    rng = random.Random(6)
    pieces = ["Al", "Nb", "Fe", "x", "20", "0.5", "-3", "1e2", ".", "at%", "wt%", "=", ":", " ", ",", "–", "＝", "%", "(", "\t", "At", "WT%"]
    data = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))) for i in range(3000)]
    df = spark.createDataFrame(data, "i int, txt string").repartition(4)
    for row in compositions.parse_and_normalize(df, "txt", "c").collect():
        if row.c_fractions is not None:
            assert row.c_parsed and sum(row.c_fractions.values()) == pytest.approx(1)
        elif row.c_parsed:
            assert sum(row.c_parsed.values()) <= 0


def test_column_names_do_not_meet_lambda_names(spark):
    """A lambda's variable hides a column of the same name, so none may have a name that a column has."""
    columns = {f"v{i}": F.lit(f"Al{i + 1}Co") for i in range(61)}
    df = spark.range(1).select(*[c.alias(n) for n, c in columns.items()])
    for i in range(0, 61, 6):
        got = df.select(F.expr(C.parse_composition(f"v{i}")).alias("p")).first().p.amounts
        assert got == {"Al": i + 1, "Co": 1}


def test_distances_agree_with_plain_python_to_the_last_bit(spark):
    rng = random.Random(9)

    def some() -> dict:
        amounts = {e: rng.choice([1, 2, 0.1, 0.3, 7]) * rng.random() for e in rng.sample(["Al", "Nb", "Fe", "Co", "W", "V"], 4)}
        return {e: a / sum(amounts.values()) for e, a in amounts.items()}

    data = [(i, some(), some()) for i in range(500)]
    df = spark.createDataFrame(data, "i int, a map<string,double>, b map<string,double>")
    for row in df.withColumn("d", F.expr(C.distances("a", "b"))).collect():
        assert row.d.l1 == brute.l1(row.a, row.b)
        assert row.d.cosine == pytest.approx(brute.cosine(row.a, row.b), abs=1e-15)
        assert 0 <= row.d.l1 <= 2 + 1e-12
    shares = df.select(F.expr(C.normalize_composition("a", "cast(null as string)")).alias("f"))
    assert all(abs(sum(r.f.values()) - 1) < 1e-12 for r in shares.collect())


def test_ratio_text(spark):
    df = spark.createDataFrame(
        [({"Al": 0.1, "Nb": 0.125, "W": 0.0, "V": 0.775}, ["V", "Zr", "Al", "V"]), ({"Al": 0.5, "Co": 0.5}, []), ({"Al": 0.0}, ["Al"])],
        "f map<string,double>, o array<string>",
    )
    got = [r[0] for r in df.select(F.expr(C.ratio_string("f", "o"))).collect()]
    assert got == ["V7.8Al1.0V7.8Nb1.2", "Al1.0Co1.0", None]
    again = df.limit(2).select("f", F.expr(C.ratio_string("f", decimals=6)).alias("t")).withColumn(
        "back", F.expr(C.normalize_composition(f"{C.parse_formula('t')}", "cast(null as string)"))
    )
    for row in again.collect():
        for element, share in row.back.items():
            assert share == pytest.approx(row.f[element], abs=1e-5)


def test_number_text(spark):
    values = [0.0, 1.0, 20.0, 0.25, 1e-4, 0.0005, 9.5e-5, 1e-5, 1.5e-7, 1e7, 123456789.125, 1e15, 1e16, 2.5e17, -0.25, -1e-5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(F.expr(double_text("v")).alias("t"), F.expr(fixed_decimals("v", 1)).alias("d")).collect()
    assert [r.t for r in got] == [repr(v) for v in values]
    halves = spark.createDataFrame([(v,) for v in (1.25, 1.15, 1.35, 1.45, 0.05, 2.5, 1234.56)], "v double")
    assert [r[0] for r in halves.select(F.expr(fixed_decimals("v", 1))).collect()] == ["1.2", "1.1", "1.4", "1.4", "0.1", "2.5", "1234.6"]
    sums = spark.createDataFrame([([0.1] * 10,), ([1e16, 1.0, -1e16],), ([],)], "v array<double>")
    assert [r[0] for r in sums.select(F.expr(compensated_sum("v"))).collect()] == [1.0, 1.0, 0.0]
