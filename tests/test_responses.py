from __future__ import annotations

import json
import random

import brute
from plans import executed_plan
from pyspark.sql import functions as F

from docfacts.functions.jsontext import balanced_chunks, json_kind, json_size, light_fix, strict_json
from docfacts.operators import records, responses

OBJ = '{"name": "Al2Co", "x": 2, "c": {"name": 5}}'
SHAPES = [
    (f"Result:\n```json\n[{OBJ}]\n```", "ok", (1, False, "array", 1)),
    (f"```json\n{OBJ}\n```", "dropped_not_list", (1, False, "object", 3)),
    (f"```JSON\n[{OBJ},]\n``` done", "invalid", (1, True, "array", 1)),
    (f"Plain list [{OBJ},{OBJ}] end", "ok", (1, False, "array", 2)),
    (f"Object {OBJ} end", "invalid", (1, False, "object", 3)),
    (f"bad [1,2,,] then [{OBJ}]", "invalid", (2, False, "array", 1)),
    ("No alloy was reported.", "raw", None),
    ("", "raw", None),
    ("open [1 [2]", "invalid", None),
    ("```json\nnull\n```", "dropped_not_list", (1, False, "null", None)),
    ("```json```", "invalid", None),
    ("it's [1, 'a]b'] and [2]", "invalid", (2, False, "array", 1)),
    ("[a] [b] [c] [4]", "invalid", (4, False, "array", 1)),
]
CHUNKS = [  # text, arrays, objects; traced by hand
    ("[1][2] [3]", ["[1]", "[2]", "[3]"], []),
    ("a ]b[ [c] ] d", ["[ [c] ]"], []),
    ("x [y [z] w] {v}", ["[y [z] w]"], ["{v}"]),
    ('["]"] {"a": "}"}', ['["]"]'], ['{"a": "}"}']),
    (r'["a\"]"] [2]', [r'["a\"]"]', "[2]"], []),
    (r'["a\\"] [2]', [r'["a\\"]', "[2]"], []),
    (r"\[1\] [2]", [r"[1\]", "[2]"], []),
    ("don't [1] it's [2]", ["[1]", "[2]"], []),
    ("[it's] [2]", [], []),
    ("{'a': '}'}", [], ["{'a': '}'}"]),
    ("é[ü]é[\U0001f600]", ["[ü]", "[\U0001f600]"], []),
]


def _answers(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, response string")


def test_golden_shapes(spark):
    df = _answers(spark, [t for t, *_ in SHAPES])
    v1 = {r.doc_id: r.status for r in responses.parse_v1(df).collect()}
    v2 = responses.parse_v2(df).withColumn("kind", F.expr(json_kind("json"))).withColumn("n", F.expr(json_size("json")))
    for row in v2.drop("json").collect():
        _, status, outcome = SHAPES[row.doc_id]
        assert v1[row.doc_id] == status
        got = None if row.status == "raw" else (row.candidate_no, row.repaired, row.kind, row.n)
        assert got == outcome, SHAPES[row.doc_id]
    held = {r.doc_id: r.raw for r in responses.quarantine(responses.parse_v2(df)).collect()}
    assert held == {i: t for i, (t, _, o) in enumerate(SHAPES) if o is None}


def test_v2_keeps_what_v1_keeps_in_one_fence(spark):
    kept = [r.doc_id for r in responses.parse_v1(_answers(spark, [t for t, *_ in SHAPES])).where("status = 'ok'").collect()]
    assert all(SHAPES[i][2] is not None for i in kept)


def test_strictness(spark):
    texts = ["[1] tail", "1] foo", "", "[1,]", "['a']", '1,"x":2', " 1 ", "null", "true", '"a"', "NaN", "[1", "01", '"\t"', "{}", "[]"]
    df = _answers(spark, texts).select("response", F.expr(strict_json("response")).isNotNull().alias("ok"))
    assert {r.response: r.ok for r in df.collect()} == {t: brute.strictly(t)[0] for t in texts}


def test_the_texts_digest_inside_a_text_is_no_end(spark):
    """The mark that closes the probe depends on the text, so nothing in a text can pass for it."""
    texts = ['["e7c1f0a94b5d4f2c8a36d0b1957e2c48"]', '1, "' + "0" * 32 + '"', '1,"x"] foo', "1], [2", '"a", "b"']
    df = _answers(spark, texts).select("response", F.expr(strict_json("response")).isNotNull().alias("ok"))
    assert {r.response: r.ok for r in df.collect()} == {t: brute.strictly(t)[0] for t in texts}


def test_chunks_by_hand(spark):
    df = _answers(spark, [t for t, *_ in CHUNKS])
    for opener, closer, column in (("[", "]", 1), ("{", "}", 2)):
        got = {r.doc_id: r.c for r in df.select("doc_id", F.expr(balanced_chunks("response", opener, closer)).alias("c")).collect()}
        assert got == {i: row[column] for i, row in enumerate(CHUNKS)}
        two = {r.doc_id: r.c for r in df.select("doc_id", F.expr(balanced_chunks("response", opener, closer, 2)).alias("c")).collect()}
        assert two == {i: row[column][:2] for i, row in enumerate(CHUNKS)}


def test_repairs_by_hand(spark):
    fixes = {
        "[1,]": "[1]",
        "[1, \n]": "[1 \n]",
        "{'a': 1}": '{ "a": 1}',
        "{'a': 'b', 'c': 'd'}": '{ "a": "b", "c": "d"}',
        "{'a': 'it''s'}": "{ \"a\": 'it''s'}",
        "no change": "no change",
    }
    got = {r.response: r.f for r in _answers(spark, list(fixes)).select("response", F.expr(light_fix("response")).alias("f")).collect()}
    assert got == fixes


def _random_answers(n: int) -> list[str]:
    rng = random.Random(3)
    pieces = ["[", "]", "{", "}", '"', "'", "\\", "\n", ",", ":", " ", "1", "a", '"k":', "'k':", "```", "```json\n", "```JSON", "```text\n",
              "[1]", '{"a": 1}', "{'a': 'b'}", "[1,]", "null", '"]"', "it's", "é", OBJ]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 16))) for _ in range(n)]


def test_random_answers_keep_the_rules(spark):
    """Candidates are parts of the text; the first that decodes, as it is or repaired, is the result."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    texts = _random_answers(3000)
    df = _answers(spark, texts).repartition(4)
    rows = responses.candidate_rows(df).withColumn("fixed", F.expr(light_fix("candidate"))).orderBy("doc_id", "candidate_no").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
        assert r.candidate in texts[r.doc_id] and len(found[r.doc_id]) == r.candidate_no
    for row in responses.parse_v2(df).withColumn("json", F.to_json("json")).collect():
        tried = [(r.candidate_no, repaired, brute.strictly(t)) for r in found.get(row.doc_id, []) for repaired, t in ((False, r.candidate), (True, r.fixed))]
        first = next(((n, repaired, value) for n, repaired, (ok, value) in tried if ok), None)
        assert (row.candidate_no, row.repaired) == (first[:2] if first else (None, None)), texts[row.doc_id]
        assert row.status == ("ok" if first else "raw")
        assert not first or json.loads(row.json) == first[2]
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_long_answers_are_scanned_whole(spark):
    entry = '{"a": "x]}\'", "n": [1, [2, 3]]}'
    long = "It's long: [" + ",".join([entry] * 20_000) + "] end"
    fenced = "Here:\n```json\n[" + ",".join([entry] * 60_000) + "]\n```"
    row = responses.parse_v2(_answers(spark, [long, "[" * 5000 + "text", "{\"a\": \"" + "y" * 500_000 + "\"}", fenced]))
    got = {r.doc_id: (r.status, r.n) for r in row.select("doc_id", "status", F.expr(json_size("json")).alias("n")).collect()}
    # The apostrophe before the list is outside of it; the one inside is in a string.
    assert got == {0: ("ok", 20_000), 1: ("raw", None), 2: ("ok", 1), 3: ("ok", 60_000)}


def test_filters_do_not_repeat_the_parse(spark):
    held = executed_plan(responses.quarantine(responses.parse_v2(_answers(spark, ["[1]"]))))
    whole = executed_plan(responses.parse_v2(_answers(spark, ["[1]"])))
    assert held.count("parseJson") == whole.count("parseJson")
    files = spark.createDataFrame([("a.json", "[1]")], "file_name string, value string")
    assert executed_plan(records.file_issues(files)).count("parseJson") == 1


def test_records(spark):
    full = '{"name": "AlCo", "lattice_constant": "Not found", "phases": ["BCC", "FCC"], "confidence_scores": {"name": 95, "doi": "high"}}'
    files = spark.createDataFrame(
        [("b.1.json", f"[{full}, {{\"lattice_constant\": 3.414, \"is_single_phase\": true}}]"), ("a.json", '[{"name": 5}]'),
         ("c.json", full), ("d.json", "[1,]"), (".json", "[]")],
        "file_name string, value string",
    )
    combined = records.combine_records(files).orderBy("Paperid", "pos").collect()
    assert [(r.Paperid, r.pos) for r in combined] == [("a", 0), ("b.1", 0), ("b.1", 1)]
    assert combined[0].name == "5"
    assert (combined[1].lattice_constant, combined[1].lattice_text, combined[1].phases) == (None, "Not found", '["BCC","FCC"]')
    assert (combined[1].conf_name, combined[1].conf_doi, combined[2].lattice_constant) == (95, None, 3.414)
    assert {(r.file_name, r.reason) for r in records.file_issues(files).collect()} == {("c.json", "not_a_list"), ("d.json", "bad_json")}
    keys = sorted(r.key for r in records.record_keys(files).collect())
    assert keys == ["confidence_scores", "is_single_phase", "lattice_constant", "name", "phases"]
    long = {(r.Paperid, r.pos, r.key): r.value for r in records.combine_all_keys(files).collect()}
    assert len(long) == 7 and long["b.1", 1, "is_single_phase"] == "true" and long["a", 0, "name"] == "5"
    wide = records.combine_with_keys(files, keys).orderBy("Paperid", "pos").collect()
    assert wide[2].is_single_phase == "true" and wide[0].phases is None
    parsed = records.parse_record_files(files)
    flat = records.flatten_records(parsed, "Paperid", accept_object=True, placeholder="Not found")
    assert flat.count() == 4 and flat.where("lattice_text is not null").count() == 1
    profile = {r.field: (r.n_records, r.n_scored, r.n_high) for r in records.confidence_profile(flat).collect()}
    assert profile["name"] == (4, 2, 2) and profile["doi"] == (4, 0, 0)


def _record_files(spark, values):
    return spark.createDataFrame([(f"f{i}.json", v) for i, v in enumerate(values)], "file_name string, value string").repartition(3)


def test_wide_table_has_all_keys_and_types(spark):
    many = "{" + ", ".join(f'"k{i}": {i}' for i in range(600)) + "}"
    wide = records.combine_wide(
        _record_files(
            spark,
            [
                '[{"n": 1, "x": 1, "s": "a", "b": true, "nul": null}, {"n": 2.5, "x": "one", "b": false}]',
                '[{"n": 1e300, "x": [1, {"y": null}], "N": "other case", "Paperid": "own", "a.b": 1, "q\\"": 2, "it\'s": 3, "\'\\"": 4}]',
                f"[{many}]", '{"not": "a list"}', "[1, null, []]", "[broken", "[]",
            ],
        )
    )
    kinds = dict(wide.dtypes)
    assert (kinds["n"], kinds["x"], kinds["s"], kinds["b"], kinds["nul"], kinds["a.b"], kinds["k599"]) == ("double", "string", "string", "boolean", "string", "bigint", "bigint")
    assert len(wide.columns) == 2 + 5 + 6 + 600 and "not" not in kinds
    rows_ = {(r.Paperid, r.pos): r.asDict() for r in wide.collect()}
    assert [rows_["f0", 0][c] for c in ("n", "x", "s", "b", "nul")] == [1.0, "1", "a", True, None] and rows_["f0", 1]["x"] == "one"
    got = rows_["f1", 0]
    assert (got["n"], got["x"], got["N_2"], got["Paperid_2"], got["a.b"], got['q"'], got["it's"], got["'\""]) == (1e300, '[1,{"y":null}]', "other case", "own", 1, 2, 3, 4)
    assert rows_["f2", 0]["k599"] == 599 and len(rows_) == 7 and set(rows_["f4", 1].values()) == {"f4", 1, None}


def test_wide_table_of_nothing(spark):
    assert records.combine_wide(_record_files(spark, ["oops"])).collect() == []
    assert records.combine_wide(_record_files(spark, ["[{}]"])).columns == ["Paperid", "pos"]
