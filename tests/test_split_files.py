"""Files read in many byte ranges give the rows of the one-task readers."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from docfacts.functions.jsontext import marked_non_finite, strict_json
from docfacts.operators.grouping import with_position
from docfacts.operators.prompts import parse_prompt_log
from docfacts.sources import files
from docfacts.sources.records_of_lines import marked_lines, quoted_cells, records_of_lines


@pytest.fixture
def small_ranges(spark):
    """Sets the size of a byte range for a test."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(k) for k in keys]

    def use(size: int) -> None:
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 1)

    yield use
    for key, value in zip(keys, old):
        spark.conf.set(key, value)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size, line_end", [(60, "\n"), (500, "\r\n")])
def test_split_csv_equals_one_task(spark, tmp_path, small_ranges, size, line_end):
    rng = random.Random(size)
    parts = ["a", ",", '"', "\n", "\r\n", "é", "NA", " x", '""', "long cell " * 4]
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=line_end, quoting=csv.QUOTE_ALL if name == "two.csv" else csv.QUOTE_MINIMAL)
            out.writerow(["id", "first cell", "second, with comma"])
            for i in range(30):
                out.writerow([i, *("".join(rng.choice(parts) for _ in range(rng.randrange(0, 6))) for _ in range(2))])
    small_ranges(10**9)
    want = files.read_table(spark, str(tmp_path), multi_line=True)
    expected = _rows(want)
    small_ranges(size)
    got = files.read_split_table(spark, str(tmp_path))
    assert got.columns == want.columns and len(expected) == 60
    # The one-task reader turns line ends inside of cells to line feeds.
    plain = lambda rows: [tuple(c.replace("\r\n", "\n") if isinstance(c, str) else c for c in r) for r in rows]
    assert sorted(plain(_rows(got)), key=repr) == sorted(plain(expected), key=repr)
    assert dict(files.read_split_table(spark, str(tmp_path), infer=True).dtypes)["id"] == "bigint"


def test_one_file_spans_many_tasks(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n" + "".join(f'{i},"cell {i}\nsecond line"\n' for i in range(3000)))
    small_ranges(8000)
    read = files.read_split_table(spark, str(path), schema="k int, v string")
    found = read.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.k, r.v) for r in found) == [(i, f"cell {i}\nsecond line") for i in range(3000)]
    assert len({r.task for r in found}) > 4


def test_a_cell_over_many_ranges_and_empty_files(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('k,v\n1,"' + "line\n" * 100 + '"\n2,x\n\n\n')
    (tmp_path / "b.csv").write_text("k,v\n")
    (tmp_path / "c.csv").write_text("")
    small_ranges(50)
    assert _rows(files.read_split_table(spark, str(tmp_path))) == [("1", "line\n" * 100), ("2", "x")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.csv").write_text("")
    assert files.read_split_table(spark, str(tmp_path / "none")).collect() == []


def test_records_in_order(spark, tmp_path, small_ranges):
    (tmp_path / "l.txt").write_text("before\n" + "".join(f"# {i}\nbody {i}\n\n" + "more\n" * (i % 7) for i in range(30)))
    for size in (40, 10**6):
        small_ranges(size)
        found = records_of_lines(spark, str(tmp_path / "l.txt"), marked_lines("# ")).orderBy("block", "seq").collect()
        assert [r.text for r in found] == ["\n".join([f"# {i}", f"body {i}", "", *["more"] * (i % 7)]) for i in range(30)]


def test_quotes_carry_over_lines():
    assert quoted_cells(['a,"b', 'c",d', "e", '"f"""', "g"], 0) == ([True, False, True, True, True], 0)
    assert quoted_cells(['x"'], 1) == ([False], 0) and quoted_cells(['x,"y'], 0) == ([True], 1)


@pytest.mark.parametrize("size", [300, 10**6])
def test_split_logs_equal_whole_texts(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    for name in ("one.log", "two.log"):
        steps = [
            f"Training step {i}. Epoch {i // 3}: : {i}it [0{i % 10}:25, {i}.58s/it]\n\n" + "".join(rng.choice(["prompt line\n", "\n", "[x, y]\n", "é\n"]) for _ in range(rng.randrange(1, 30)))
            + f"TF-IDF Cosine Similarity: 0.{100 + i}\n\n"
            for i in range(12)
        ]
        (tmp_path / name).write_text("header line\n" + "".join(steps), encoding="utf-8")
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_name").alias("log_id"), "value")
    expected = _rows(parse_prompt_log(whole))
    small_ranges(size)
    assert _rows(files.read_prompt_logs(spark, str(tmp_path))) == expected and len(expected) == 24


def test_an_unfinished_step_is_left_out(spark, tmp_path):
    step = "Training step {0}. Epoch 0: : 1it [00:25, 1.5s/it]\n\nprompt {0}\n"
    (tmp_path / "l").write_text(step.format(1) + step.format(2) + "TF-IDF Cosine Similarity: 0.5\n" + step.format(3))
    assert [(r.version, r.step, r.prompt) for r in files.read_prompt_logs(spark, str(tmp_path)).collect()] == [(1, 2, "prompt 2")]


def test_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["", "a", "é", "b", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    found = {r.i: r.position for r in with_position(df, ["k", "i"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert found == {i: place for place, (_, i) in enumerate(order)}
    assert with_position(df.where("false"), ["k", "i"]).collect() == []
    hot = spark.range(9000).select(F.lit("same").alias("k"), "id")
    assert with_position(hot, ["k", "id"]).where("position <> id").count() == 0


def test_number_words_outside_of_strings(spark):
    texts = ['[NaN, "NaN", {"Infinity": -Infinity}]', '["a\\" NaN", NaN]', "NaN", "[1, 2]", '{"NaN": "x NaN y"}', "[-NaN]", '"open NaN', None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.expr(marked_non_finite("t"))).collect()]
    mark = lambda w: '{"$numberDouble":"' + w + '"}'
    assert got == [
        f'[{mark("NaN")}, "NaN", {{"Infinity": {mark("-Infinity")}}}]', f'["a\\" NaN", {mark("NaN")}]', mark("NaN"), "[1, 2]", '{"NaN": "x NaN y"}', "[-NaN]",
        '"open NaN', None, "",
    ]
    valid = lambda flag: [r[0] for r in df.orderBy("i").select(F.expr(strict_json("t", flag)).isNotNull()).collect()]
    assert valid(True) == [True, True, True, True, True, False, False, False, False]
    assert valid(False) == [False, False, False, True, True, False, False, False, False]
