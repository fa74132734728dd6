from __future__ import annotations

import random

import pytest
from plans import executed_plan
from pyspark.sql import functions as F

from docfacts.functions.text import normalize_text, tokens_from_chars, tokens_from_words
from docfacts.operators import text_budget


TEXTS = [  # text, normalised form, words; traced by hand
    ("", "", 0),
    (" \t\r\n ", "", 0),
    ("  one\ttwo\r\nthree  ", "one two three", 3),
    ("co-\nop", "coop", 1),
    ("co- \nop", "co- op", 2),
    ("x-\ny-\nz", "xy-\nz".replace("-\n", "- "), 2),
    ("l'été co-op don't_2", "l'été co-op don't_2", 3),
    ("'quoted' -dash- _", "'quoted' -dash- _", 3),
    ("½ ٣ 中文, \U0001f600", "½ ٣ 中文, \U0001f600", 3),
    ("a\x1c\x85b\u3000\u3000c", "a b c", 3),
]


def test_texts_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TEXTS)], "doc_id int, text string")
    for row in df.select("doc_id", F.expr(normalize_text("text")).alias("norm")).collect():
        assert row.norm == TEXTS[row.doc_id][1], TEXTS[row.doc_id]
    for row in text_budget.text_stats(df).collect():
        text, norm, words = TEXTS[row.doc_id]
        assert (row.characters, row.words, row.tokens_tiktoken) == (len(norm), words, None), text


def test_counts_add_up_over_joined_texts(spark):
    rng = random.Random(1)
    pieces = ["a", "Übung", "l'été", "co-op", "-", "'", "_", ".", "½", "٣", "é", "中文", "\U0001f600"]
    halves = [[" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(2)] for _ in range(500)]
    rows = [(f"{i}-{k}", t) for i, pair in enumerate(halves) for k, t in enumerate([*pair, "  \n ".join(pair)])]
    got = {r.doc_id: (r.characters, r.words) for r in text_budget.text_stats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for i in range(len(halves)):
        left, right, both = (got[f"{i}-{k}"] for k in range(3))
        assert both == (left[0] + 1 + right[0], left[1] + right[1])


def test_token_estimates_round_half_to_even(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 6, 10, 14, 18, 1001)], "n long")
    got = df.select("n", F.expr(tokens_from_chars("n")).alias("c"), F.expr(tokens_from_words("n")).alias("w")).collect()
    assert [(r.c, r.w) for r in got] == [(round(r.n / 4), round(r.n / 0.75)) for r in got]


def _budget(spark, **options):
    docs = spark.createDataFrame(
        [("a.pdf", "one two", 2, 7), ("b.pdf", None, 1, None), ("c.pdf", "", 0, None), ("d.pdf", "x", None, 1)],
        "doc_id string, text string, pages int, exact long",
    )
    geometry = spark.createDataFrame([("a.pdf", 1, 8.5, 11.0), ("a.pdf", 2, 10.0, 10.0), ("z.pdf", 1, 1.0, 1.0)],
                                     "doc_id string, page_no int, width_in double, height_in double")
    stats = text_budget.text_stats(docs, pages=F.col("pages"), engine=F.lit("pypdf"), exact_tokens=F.col("exact"))
    sized = text_budget.image_megapixels(stats, geometry, dpi=100, default_size="a4")
    return text_budget.token_budget(sized, **options)


def test_budget(spark):
    rows = {r.doc_id: r for r in _budget(spark, image_divisor=750, image_tokens_per_mp=1.0).collect()}
    assert set(rows) == {"a.pdf", "c.pdf", "d.pdf"}
    a, c = rows["a.pdf"], rows["c.pdf"]
    assert a.image_mp == pytest.approx(0.935 + 1.0) and a.pages_used == 2
    assert a.image_tokens == round(1.935e6 / 750) and a.total_tokens_tiktoken == 7 + a.image_tokens
    assert (c.pages_used, c.words, c.tokens_char_est) == (1, 0, 0)
    assert c.image_mp == pytest.approx(827 * 1169 / 1e6) and c.total_tokens_tiktoken is None
    rate = {r.doc_id: r.image_tokens for r in _budget(spark, image_tokens_per_mp=1000.0).collect()}
    assert rate["a.pdf"] == 1935
    off = _budget(spark).where("doc_id = 'a.pdf'").first()
    assert off.image_tokens is None and off.total_tokens_word_est is None
    assert text_budget.default_page_size("letter", 3.0, 4.0) == (3.0, 4.0)
    assert text_budget.default_page_size("a4", 3.0, None) == (8.27, 11.69)


def test_report_csv_and_totals(spark):
    budget = _budget(spark, image_divisor=750)
    line = text_budget.token_report(budget).where("doc_id = 'a.pdf'").first().line
    assert line == (
        "a.pdf\tpages=2\tchars=7\twords=2\ttokens(word-est)=3\ttokens(char-est)=2\ttokens(tiktoken)=7\tengine=pypdf"
        "\timage_mp=1.94\timage_tokens=2580\ttotal_tokens(word-est)=2583\ttotal_tokens(char-est)=2582\ttotal_tokens(tiktoken)=2587"
    )
    csv = text_budget.token_budget_csv(budget)
    assert csv.columns == text_budget.CSV_COLUMNS
    assert csv.where("file = 'd.pdf'").first().tokens_tiktoken == "1" and csv.where("file = 'c.pdf'").first().tokens_tiktoken == ""
    assert csv.where("file = 'a.pdf'").first().image_mp == "1.9350"
    total = text_budget.token_totals(budget).first()
    assert (total.files, total.words, total.chars, total.tokens_tiktoken) == (3, 3, 8, 8)
    assert (total.tokens_word_est, total.tokens_char_est) == (4, 2)
    assert total.total_tokens_tiktoken == 8 + total.image_tokens
    plain = text_budget.token_totals(text_budget.without_images(text_budget.text_stats(
        spark.createDataFrame([("a", "b c")], "doc_id string, text string")))).first()
    lines = {text_budget.token_total_line(text_budget.token_totals(b)).first().line for b in (budget,)}
    assert lines == {
        "TOTAL\tfiles=3\twords=3\tchars=8\ttokens(word-est)=4\ttokens(char-est)=2\ttokens(tiktoken)=8\timage_mp="
        f"{total.image_mp:.2f}\timage_tokens={total.image_tokens}\ttotal_tokens(word-est)={4 + total.image_tokens}"
        f"\ttotal_tokens(char-est)={2 + total.image_tokens}\ttotal_tokens(tiktoken)={8 + total.image_tokens}"
    }
    assert plain.image_mp is None and plain.tokens_tiktoken is None and plain.total_tokens_word_est is None


def test_only_needed_columns_are_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = executed_plan(text_budget.text_stats(docs))
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("regexp_extract_all") == 1


def test_failures(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id int, text string")
    assert [tuple(r) for r in text_budget.text_failures(docs).collect()] == [(2, "no_text")]
