"""Fill-in-the-middle texts against plain string slicing, and the sparse index against encoding."""

from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm.fill_middle import ExceptionIndex, digests, fill_in_middle, restored


def plain_form(doc_id, text, seed=1):
    """The definition, over Python strings."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, whether, which = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or whether % 100 >= 90:
        return len(text), "plain", None, None, text
    low, high = sorted((one % (len(text) + 1), two % (len(text) + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if which % 100 < 20:
        return len(text), "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(text), "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


CASES = [
    None, "", "a", "é", "日本語のテキスト", "plain ascii only", "mixed é日🙂z " * 50, "🙂" * 9, "has <P> inside", "<S>", "x<M>", "<<P", "ends with <", "<S" * 7,
    "\x00nul\n\r", "á combining", "x" * 300_000 + "é" * 1000 + "y" * 100_000,
]


def test_equals_slicing(spark, documents):
    table = [(i, text) for i, text in enumerate(CASES * 12)] + [(None, "no id é"), (7, "again"), (7, "again")]
    got = rows(fill_in_middle(documents(table)))
    assert got == sorted(((i, *plain_form(i, t)) for i, t in table), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_rebuilt_from_output_and_form(spark, documents):
    table = [(i, text) for i, text in enumerate(CASES * 12)]
    back = restored(fill_in_middle(documents(table)), "doc_id", "prefix_chars", "middle_chars")
    for doc_id, prefix, middle, text, low, high in rows(back):
        assert text == (table[doc_id][1] or "")
        assert (low, high) == ((None, None) if prefix is None else (prefix, prefix + middle))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6), st.data())
def test_index_converts_both_ways(texts, data):
    whole = "".join(texts)
    index = ExceptionIndex(np.frombuffer(whole.encode(), np.uint8))
    cut = data.draw(st.integers(0, len(whole)))
    byte = len(whole[:cut].encode())
    assert index.bytes(np.array([cut]))[0] == byte and index.chars(np.array([byte]))[0] == cut
    assert len(index.at_byte) == sum(len(c.encode()) > 1 for c in whole)


def test_rates_and_sentinels(spark, documents):
    df = documents([(i, f"text number {i} é") for i in range(300)])
    assert rows(fill_in_middle(df, cut_percent=0), "form") == [("plain",)] * 300
    moved = rows(fill_in_middle(df, seed=5, cut_percent=100, suffix_first_percent=100, sentinels=("[pre]", "[suf]", "[mid]")), "form", "output")
    assert all(form == "spm" and text.startswith("[suf]") and "[pre]" in text and "[mid]" in text for form, text in moved)


def test_narrow_empty_and_extra_columns(spark, documents):
    df = documents([(1, "some text é"), (2, None)])
    more = df.withColumns({"form": F.lit(1), "output": F.lit(None), "n": F.lit("x"), "h1": F.lit(2), "restored": F.lit(3)})
    assert rows(digests(more)) == rows(digests(df))
    assert digests(df.where("false")).count() == 0
    assert "Exchange" not in digests(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
