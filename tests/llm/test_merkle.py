"""The distributed manifest against a tree built in one process."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm.merkle import Frontier, digest, folded, manifest, verified_manifest


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and witnesses, level by level over whole lists."""
    witnesses, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for leaf in owners[a + k]:
                    witnesses[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(H("".join(run)))
            held.append([leaf for own in owners[a : a + 8] for leaf in own])
        nodes, owners = above, held
    return nodes[0], witnesses


def plain_manifest(table: list[tuple]) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) to what the query returns."""
    by_lang = defaultdict(list)
    for doc_id, text, lang, source, n in table:
        by_lang[lang].append((doc_id, H("".join(map(field, (doc_id, source, lang, n, text)))), (doc_id, text, lang, source, n)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = plain_tree([leaf for _, leaf, _ in by_lang[lang]])
    root, upper = plain_tree([trees[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, upper):
        subroot, witnesses = trees[lang]
        for (doc_id, leaf, (_, text, _, source, n)), witness in zip(by_lang[lang], witnesses):
            proof = "".join(left + right for left, right in witness + above)
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                node = H("".join(map(field, (doc_id, source, lang, n, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))))
            for left, right in witness + above:
                node = H(left + node + right)
            out.append((doc_id, leaf, subroot, root, H(proof), node, node == root))
    return sorted(out, key=repr)


@pytest.fixture
def table(spark):
    def make(rows_):
        return spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)

    return make


def test_equals_one_process(spark, table):
    rows_ = [(i * 3 % 1009, f"Text {i} É", ["en", "de", None, "é", "z"][i % 5 if i % 3 else 0], None if i % 7 == 0 else f"s{i % 4}", i if i % 5 else None) for i in range(700)]
    rows_ += [(5, None, "one", None, None), (6, "", "", "", 0), (None, "No id", "en", "s", 1), (11, "Twice", "en", "s", 5), (11, "Twice", "en", "s", 5), (11, "Thrice", "en", "s", 5), (-4, "Below", "en", "s", 5)]
    assert rows(verified_manifest(table(rows_))) == plain_manifest(rows_)
    # Blocks of one level, so that there are many steps of block roots.
    assert rows(verified_manifest(table(rows_), block_levels=1)) == plain_manifest(rows_)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 513, 4096, 4097])
def test_sizes_at_borders(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = manifest(df)
    assert got.where(folded(F.col("leaf"), F.col("witness")) == F.col("root")).count() == n
    first = got.orderBy("doc_id").first()
    root, witnesses = plain_tree([r.leaf for r in sorted(got.select("doc_id", "leaf").collect())])
    assert first.root == first.subroot == root and [tuple(s) for s in first.witness] == witnesses[0]


def test_one_hot_group_and_repeated_rows(spark, table):
    rows_ = [(1, "same Row", "en", "s", 3)] * 400 + [(i, "Other", "fr", "s", 1) for i in range(30)]
    assert rows(verified_manifest(table(rows_))) == plain_manifest(rows_)


def test_a_change_breaks_its_own_witness_only(spark, table):
    found = rows(verified_manifest(table([(i, f"Capital {i}", "en", "s", 1) for i in range(60)])), "doc_id", "verified")
    assert found == sorted(((i, zlib.crc32(str(i).encode()) % 3 != 0) for i in range(60)), key=repr)


def test_frontier_by_hand():
    frontier = Frontier(2)
    for leaf in "abcdefghi":
        frontier.append(leaf)
    root = frontier.close()
    one, two = H("abcdefgh"), H("i")
    assert root == H(one + two) == digest(one + two)
    assert frontier.witnesses[2] == [("ab", "defgh"), ("", two)] and frontier.witnesses[8] == [("", ""), (one, "")]


def test_empty_and_extra_columns(spark, table):
    df = table([(1, "A", "en", "s", 1), (2, "B", "fr", "s", 1)])
    more = df.withColumns({c: F.lit(9) for c in ("tree", "pos", "leaf", "root", "order", "digest", "part", "row", "n", "tie", "witness", "seen")})
    assert rows(verified_manifest(more)) == rows(verified_manifest(df))
    assert verified_manifest(df.where("false")).collect() == []
