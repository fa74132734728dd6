from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm.quality import clean_documents, quality

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(8)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


@pytest.mark.parametrize("seed", [1, 2])
def test_base_counts(spark, documents, seed):
    rng = random.Random(seed)
    data = [(0, None), (1, ""), (2, " \n\t\n"), (3, "a " * 40), (4, "é x #*$%&|<> " * 3)]
    for i in range(5, 60):
        vocabulary = [f"w{k}" for k in range(rng.choice([3, 30, 500]))]
        data.append((i, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\r\n", "\n\n"]) for _ in range(rng.randrange(120)))))
    data.append((5, "twice"))
    table = documents(data).withColumn("words", F.lit(1)).withColumn("kept", F.lit("x"))
    assert rows(quality(table), *COLUMNS) == sorted((brute(i, t) for i, t in data), key=repr)
    assert quality(table.where("false")).count() == 0


def test_lines(spark, documents):
    prose = " ".join("plain{0}x%d ordinary{0}y%d" % (k, k) for k in range(7)) + "."
    body = "\n".join(prose.format(k) for k in range(6))
    bad = ["Home | About | Contact | Help", "--- 123 ---", "BUY!! NOW!! HERE!!", "Please accept cookies to go on with this page.", prose.format(1)]
    kept = {r.doc_id: r for r in clean_documents(documents([(1, body), (2, body + "\n" + bad[0]), (3, body + "\n" + "\n".join(bad * 3)), (4, "\n".join(f"{b} {k}" for k in range(9) for b in bad[:1]))])).collect()}
    assert kept[1].kept and kept[1].cleaned_text == body
    assert kept[2].kept and kept[2].cleaned_text == body
    assert not kept[3].kept and kept[3].cleaned_text == body
    assert not kept[4].kept and kept[4].cleaned_text == ""


def test_phrases_and_thresholds_are_arguments(spark, documents):
    lines = ["Ein ganz gewöhnlicher Satz mit vielen Wörtern steht in dieser Zeile hier.", "Alle Rechte vorbehalten", "Cliquez ici pour continuer la lecture", "Our house rules apply to everyone here"]
    df = documents([(1, "\n".join(lines)), (2, None)])
    kept = lambda **options: clean_documents(df, **options).where("doc_id = 1").first().cleaned_text.split("\n")
    assert kept() == [lines[0], lines[3]]
    assert kept(phrases=("house rules",)) == lines[:3] and kept(phrases=()) == lines
    long = documents([(1, "\n".join([f"word{k} and more words of line {k} go on" for k in range(9)] + ["click here " * 8]))])
    assert [clean_documents(long, most_lost=m).first().kept for m in (5, 90)] == [False, True]


def test_no_python_in_the_plan(spark, documents):
    plan = quality(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
