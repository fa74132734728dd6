from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm.token_counts import PrefixCounts, _symbols, prefix_tables, token_counts
from docfacts.llm.tokenizer import Encoder, special_path

PATH = special_path("word_bpe_49k.json")
TEXTS = [
    "",
    " \n\t ",
    "Hello, World! it's 12.5% done...",
    "naïve café ÀÉÎ façade ﬁne İstanbul ΟΔΟΣ",
    "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>",
    "x" * 300,
    "éa ́b c d\x1ce",
    "日本語 текст, 👩‍👩‍👧.",
    "don't 'S 'll, we'Re. ,. ., ...",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_the_librarys(library):
    encoder = Encoder(PATH)
    rng = random.Random(3)
    pieces = [p for t in TEXTS for p in t.split(" ")] + [" ", "\n", ",", "."]
    for text in TEXTS + ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(12)) for _ in range(300)]:
        assert encoder.ids(text).tolist() == library(text), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_encode_whole_texts(name):
    encoder = Encoder(special_path(name))
    assert not encoder.by_words
    assert len(encoder.ids("Hello world, twice  two")) == encoder.counts(encoder.parts("Hello world, twice  two")).sum()


def test_every_prefix_counts_what_the_library_counts(library):
    counts = PrefixCounts(PATH)
    for text in [*TEXTS[:5], *TEXTS[6:], "unbelievably Straightforward transformations, internationalization reading"]:
        assert counts.every_prefix(text).tolist() == [len(library(text[:k])) for k in range(len(text) + 1)], text


def test_sums_end_with_the_librarys_counts(library):
    """``n_tokens`` is the last entry of the table: words that share beginnings, cases, marks, long steps, special strings."""
    counts, rng = PrefixCounts(PATH), random.Random(11)
    pieces = ["the", "Éa", "ch", "aaa", "!!", "...", "7", "'ll", "İ", "日本", "e\u0301", "\t", "<|endoftext|>", "<|endof", "ß", "x" * 120, "é" * 70]
    for text in TEXTS + [" ".join("".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(6)) for _ in range(300)]:
        parts = counts.encoder.parts(text)
        assert counts.sums(parts)[-1] == len(library(text)), text
        budget = int(counts.sums(parts)[-1] // 2)
        fits = counts.longest_prefix(text, budget)
        assert len(library(text[:fits])) <= budget or budget == 0 and not fits


def test_borders_hold_as_merging_from_scratch_says():
    merges, rng = PrefixCounts(PATH)._merges, random.Random(2)

    def scratch(left: str, right: str) -> bool:
        symbols = list(left) + _symbols(right, merges.end)
        while True:
            ranked = [(merges.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges.rank]
            if not ranked:
                return symbols == [left, right]
            _, i = min(ranked)
            symbols[i : i + 2] = ["".join(symbols[i : i + 2])]

    tokens = sorted(merges.vocabulary)
    open_tokens = [t for t in tokens if not t.endswith(merges.end)]
    short = [t for t in open_tokens if len(t) < 4]
    alike = [t for t in tokens if len(set(t.removesuffix(merges.end))) == 1]
    pairs = [(a, b) for a in alike for b in alike if a[0] == b[0] and not a.endswith(merges.end)]
    pairs += [(rng.choice(short), rng.choice(tokens)) for _ in range(4000)] + [(rng.choice(open_tokens), rng.choice(tokens)) for _ in range(4000)]
    assert {merges._beside(a, b) for a, b in pairs} == {True, False}
    assert [p for p in pairs if merges._beside(*p) != scratch(*p)] == []


def test_a_full_table_is_begun_anew(monkeypatch, library):
    monkeypatch.setattr("docfacts.llm.token_counts.KEPT_PREFIXES", 50)
    monkeypatch.setattr("docfacts.llm.token_counts.KEPT_WORDS", 10)
    counts = PrefixCounts(PATH)
    for text in [f"word{i} reading{'abc'[i % 3]} unbelievably thereof" for i in range(60)]:
        assert counts.sums(counts.encoder.parts(text))[-1] == len(library(text))
    assert len(counts._merges.table) < 200


def test_longest_prefix(library):
    counts = PrefixCounts(PATH)
    text = "Anon thereof, reading the unbelievable internationalization of éclairs again"
    for budget in range(len(library(text)) + 2):
        fits = [k for k in range(len(text) + 1) if len(library(text[:k])) <= budget]
        assert counts.longest_prefix(text, budget) == max(fits)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_longest_prefix_of_any_script(name):
    counts = PrefixCounts(special_path(name))
    rng = random.Random(5)
    for piece in ["日本", "ก", "=/+", "é", "ậ각", "İ=", "'re", "a<|endoftext|>", "\t", "12x", "👩\u200d"]:
        text = "".join(rng.choice([piece, piece[0]]) for _ in range(90)) + rng.choice(["a'll", "b"])
        sizes = [len(counts.encoder.library(text[:k])) for k in range(len(text) + 1)]
        for budget in {0, 1, sizes[-1] // 2, sizes[-1] - 1} - {sizes[-1], -1}:
            assert counts.longest_prefix(text, budget) == max(k for k, n in enumerate(sizes) if n <= budget), (piece, budget)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_a_megabyte_without_blanks(name):
    counts = PrefixCounts(special_path(name))
    for text in ("=/+-_*" * 170_000, "日本語文" * 90_000):
        fits = counts.longest_prefix(text, 2048)
        assert len(counts.encoder.library(text[:fits])) <= 2048
        assert all(len(counts.encoder.library(text[:k])) > 2048 for k in range(fits + 1, fits + 40))


def test_a_cased_vocabulary_keeps_its_case(tmp_path):
    """The same file without its lower-casing step: words are not folded."""
    spec = json.load(open(PATH, encoding="utf-8"))
    steps = spec["normalizer"].get("normalizers", [spec["normalizer"]])
    kept = [s for s in steps if s["type"] != "Lowercase"]
    assert len(kept) < len(steps)
    spec["normalizer"] = {"type": "Sequence", "normalizers": kept} if kept else None
    (tmp_path / "cased.json").write_text(json.dumps(spec), encoding="utf-8")
    encoder = Encoder(str(tmp_path / "cased.json"))
    for text in ("Hello Wonderful World", "hello, Wonderful. ÀB c", *TEXTS):
        assert encoder.ids(text).tolist() == encoder.library(text), text
    assert len(encoder.ids("Hello Wonderful World")) > len(Encoder(PATH).ids("Hello Wonderful World"))


def test_query_columns(spark, documents, library):
    table = documents([(1, "a b c"), (2, None), (2, ""), (None, "word " * 3000), (3, "é")]).withColumn("n_tokens", F.lit(1))
    found = rows(token_counts(table, PATH), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert found == sorted([(1, 5, 3, False), (2, 0, 0, False), (2, 0, 0, False), (3, 2, 1, False), (None, 15000, 3000, True)], key=repr)
    assert token_counts(documents([(1, "a")]).where("false"), PATH).count() == 0
    assert prefix_tables(documents([(1, "ab cd")]), PATH).first()[1:] == ([0, 2, 5], [0, 1, 2])

