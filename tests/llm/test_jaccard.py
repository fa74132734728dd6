from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm import jaccard
from docfacts.llm.common import word_hashes
from docfacts.llm.graph import components


def shingles(text: str | None) -> frozenset:
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(pairs: list[tuple[int, str | None]]) -> list[tuple]:
    sets = [(i, shingles(t)) for i, t in pairs]
    top = {k: i for k, (i, _) in enumerate(sets)}
    changed = True
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a][1] and sets[b][1] and 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1])]
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            changed |= top[a] != low or top[b] != low
            top[a] = top[b] = low
    return sorted(((i, len(s), top[k]) for k, (i, s) in enumerate(sets)), key=repr)


def edited(rng: random.Random, words: list[str], share: float) -> str:
    return " ".join(rng.choice("abcdefgh") * 3 + str(rng.random()) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, documents, seed):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    texts: list[str | None] = [None, "", " \t\n", "one two", "ONE  two", "one two three four five", "One two three four five", "é È", "É È"]
    for g in range(8):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([12, 60, 200]))]
        texts += [" ".join(base)] + [edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04])) for _ in range(rng.randrange(1, 14))]
        texts += [" ".join(passage + base[:10]), " ".join(base[:5] + passage)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    data = list(zip(ids, texts))
    assert rows(jaccard.linked_components(documents(data).withColumn("n", F.lit(1)))) == brute(data)


def test_chain_crosses_stars(spark, documents):
    """Links that no star holds are found in the second round: a chain of neighbours, each far from its next but one."""
    words = [f"w{k}" for k in range(400)]
    data = [(100 - s, " ".join(words[6 * s : 6 * s + 60])) for s in range(40)]
    found = rows(jaccard.linked_components(documents(data)))
    assert found == brute(data)
    assert {c for _, _, c in found} == {61}


def test_every_link_is_listed(spark, documents):
    """Also those inside a group that hold nothing together: counts with copies, and pairs of classes, against all pairs."""
    rng = random.Random(4)
    texts: list[str | None] = [None, "", " \n", "one two", "ONE two"]
    for _ in range(4):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([120, 200, 300]))]
        texts += [" ".join(base)] * rng.randrange(1, 5) + [edited(rng, base, rng.choice([0.005, 0.01, 0.02])) for _ in range(12)]
    data = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    table = documents([*data, (None, texts[5])]).withColumns({"n_links": F.lit(1), "copies": F.lit(2), "class_id": F.lit(3)})
    expected = [(i, len(s), sum(i in pair for pair in linked)) for i, s in enumerate(sets)] + [(None, len(sets[5]), 0)]
    assert rows(jaccard.link_counts(table)) == sorted(expected, key=repr)
    pairs, membership = jaccard.links(table)
    first = {s: min(i for i, other in enumerate(sets) if other == s) for s in sets}
    classes = {tuple(sorted((first[sets[a]], first[sets[b]]))) for a, b in linked if sets[a] != sets[b]}
    found = [tuple(sorted(r)) for r in rows(pairs, "a.rep", "b.rep")]
    assert set(found) == classes and len(found) == len(classes) > 40
    assert rows(membership, "doc_id", "class_id.rep") == sorted([(i, first[s] if s else None) for i, s in enumerate(sets)] + [(None, None)], key=repr)
    assert jaccard.link_counts(table.where("false")).collect() == []


def test_nulls_ties_and_empty(spark, documents):
    same = "a b c d e f g"
    found = rows(jaccard.linked_components(documents([(None, same), (5, same), (5, same), (3, same), (None, None), (9, "x")])))
    assert found == sorted([(None, 3, None), (5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 0, None), (9, 1, 9)], key=repr)
    assert jaccard.linked_components(documents([(1, "a")]).where("false")).count() == 0


def test_one_of_each_group_stays(spark, documents):
    words = [f"w{k}" for k in range(100)]
    data = [(4, " ".join(words)), (2, " ".join(words)), (7, " ".join([*words[:-1], "z"])), (8, "other words of another kind here"), (1, None)]
    assert rows(jaccard.without_near_copies(documents(data)), "doc_id") == [(1,), (2,), (8,)]


def test_rows_of_one_id_are_judged_by_their_own_text(spark, documents):
    words = [f"w{k}" for k in range(100)]
    near, clean = " ".join([*words[:-1], "z"]), "a clean text of its own with words"
    data = [(1, " ".join(words)), (4, near), (4, clean), (4, None), (6, "some other words that nobody else has here"), (6, "some other words that nobody else has here"), (7, near), (None, near), (None, near), (None, None)]
    # 4's clean text stays although another row of this id is a near copy; of repeated rows one stays.
    left = documents(data).withColumns({"row": F.lit(1), "n": F.lit(2), "component": F.lit(3), "d1": F.lit(4)})
    kept = jaccard.without_near_copies(left)
    assert kept.columns == left.columns
    assert rows(kept, "doc_id", "text") == sorted([(1, " ".join(words)), (4, clean), (4, None), (6, "some other words that nobody else has here"), (None, near), (None, near), (None, None)], key=repr)
    assert (4, 4) in rows(jaccard.linked_components(documents(data)), "doc_id", "component_id")
    assert jaccard.without_near_copies(left.where("false")).collect() == []


def test_regular_words_are_told_apart(spark, documents):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever the base."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    short = [one[:n] for n in (64, 128, 255, 256, 257)] + [two[:n] for n in (64, 128, 255, 256, 257)]
    data = [(k, t) for k, t in enumerate([one, two, *short])]
    assert rows(jaccard.linked_components(documents(data))) == sorted(((k, 1, k) for k in range(12)), key=repr)


def test_word_hashes_depend_on_every_byte():
    rng = random.Random(1)
    seen: dict = {}
    words = {rng.randbytes(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 64, 255, 256, 257, 1000])) for _ in range(2_000)}
    words |= {b"\0" * n for n in range(1, 40)} | {w[:-1] + bytes([w[-1] ^ 1]) for w in list(words)[:500]}
    words = sorted(words)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    hashes = word_hashes(data, ends - [len(w) for w in words], ends)
    assert len(np.unique(hashes)) == len(words)
    again = word_hashes(np.frombuffer(b"xx" + words[7] + b"yyyyyyyyy", np.uint8), np.array([2]), np.array([2 + len(words[7])]))
    assert again[0] == hashes[7]


def test_very_long_text(spark, documents):
    long = " ".join(f"w{k}" for k in range(60_000))
    found = rows(jaccard.linked_components(documents([(1, long), (2, long + " more"), (3, "w1 w2 w3 w4 w5")])))
    assert found == [(1, 59_996, 1), (2, 59_997, 1), (3, 1, 3)]


def test_ngrams_do_not_cross_texts():
    text, _ = jaccard.ngram_sets(pa.array(["a b c", None, "d e f g h i"]))
    assert text.tolist() == [0, 2, 2]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    found = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 140)}
