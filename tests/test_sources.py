from __future__ import annotations

import base64
import json
import re
from pathlib import Path

import pytest
from plans import executed_plan
from pyspark.sql import functions as F

from docfacts.operators import documents, records, requests, responses
from docfacts.plans import queries
from docfacts.session import configure, work_folder
from docfacts.sources import files, sinks
from docfacts.streaming import ingest

PDF, PNG, JPEG = b"%PDF-1.7 x" * 20, b"\x89PNG\r\n\x1a\n00", b"\xff\xd8\xff\xe000"


@pytest.fixture
def folder(tmp_path):
    inside = tmp_path / "in"
    (inside / "sub").mkdir(parents=True)
    for name, content in {"a.v1.pdf": PDF, "b.PDF": PDF, "c.txt": b"no", "sub/d.Pdf": PNG, "sub/a.v1.pdf": JPEG}.items():
        (inside / name).write_bytes(content)
    (inside / "r.1.json").write_text('[{"name": "AlCo"}]')
    (inside / "s.json").write_text('{"name":\n"AlCo"}')
    (inside / "t.JSON").write_text("[]")
    return inside


def test_scans(spark, folder):
    flat = files.scan_pdfs(spark, str(folder))
    assert [(r.doc_id, bytes(r.content)) for r in flat.collect()] == [("a", PDF)]
    assert "content:binary" not in executed_plan(files.scan_pdfs(spark, str(folder), content=False))
    deep = sorted(r.path.split("/in/")[1] for r in files.scan_pdfs_recursive(spark, [str(folder), str(folder / "sub")]).collect())
    assert deep == ["a.v1.pdf", "b.PDF", "sub/a.v1.pdf", "sub/d.Pdf"]
    read = {r.file_name: r.value for r in files.read_record_files(spark, str(folder)).collect()}
    assert read == {"r.1.json": '[{"name": "AlCo"}]', "s.json": '{"name":\n"AlCo"}'}


def test_path_rules_and_pairs(spark):
    paths = spark.createDataFrame([(p,) for p in ("/in/a.b.pdf", "/in/x/c.pdf", "/in/d.PDF", "/in/a.b.pdf", "/other/e.pdf", "/in/f.pdf.txt")], "path string")
    assert {(r.path, r.doc_id) for r in documents.flat_pdfs(paths, "/in").collect()} == {("/in/a.b.pdf", "a")}
    assert sorted(r.path for r in documents.all_pdfs(paths).collect()) == ["/in/a.b.pdf", "/in/d.PDF", "/in/x/c.pdf", "/other/e.pdf"]
    outputs = spark.createDataFrame([("/in/a.b.json",), ("/in/d.json",)], "path string")
    paired = documents.pair_outputs(outputs, paths.distinct())
    assert sorted(tuple(r) for r in paired.collect()) == [("/in/a.b.json", "/in/a.b.pdf"), ("/in/d.json", None)]
    both = documents.both_scans(paths, "/in").collect()
    assert sorted(r.path for r in both if r.scan == "flat") == sorted(r.path for r in documents.flat_pdfs(paths, "/in").collect())
    assert sorted(r.path for r in both if r.scan == "recursive") == sorted(r.path for r in documents.all_pdfs(paths).collect())


def test_pending_and_kinds(spark):
    docs = spark.createDataFrame([(1, bytearray(PDF)), (2, bytearray(PNG)), (3, bytearray(JPEG)), (4, bytearray(b"%PDF")), (5, bytearray())], "doc_id long, content binary")
    done = docs.where("doc_id = 1").unionAll(docs.where("doc_id = 1"))
    left = documents.pending_docs(docs, done, docs.where("doc_id = 5"))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    kinds = {r.doc_id: (r.kind, r.is_pdf) for r in documents.classify_docs(docs).collect()}
    assert kinds == {1: ("pdf", True), 2: ("png", False), 3: ("jpeg", False), 4: ("unsupported", False), 5: ("unsupported", False)}
    wanted, rejected = requests.extraction_requests(docs, 'say "x"')
    bodies = {r.doc_id: json.loads(r.content) for r in wanted.collect()}
    assert bodies[1] == [
        {"type": "text", "text": 'say "x"'},
        {"type": "document", "source": {"type": "base64", "media_type": "application/pdf", "data": base64.b64encode(PDF).decode()}},
    ]
    assert bodies[2][1]["source"]["media_type"] == "png" and bodies[3][1]["type"] == "image"
    assert sorted(r.doc_id for r in rejected.collect()) == [4, 5]
    judged, refused = requests.evaluation_requests(docs.withColumn("answer", F.lit("[]")).withColumn("truth", F.lit("t")), "i", "q", ground_truth="truth")
    fields = json.loads(judged.where("doc_id = 1").first().fields)
    assert [f["field"] for f in fields] == requests.EVALUATION_FIELDS
    assert [f["block"]["type"] for f in fields] == ["text", "text", "document", "text", "text"]
    assert sorted(r.doc_id for r in refused.collect()) == [4, 5]
    answers = spark.createDataFrame([(1, "[1]"), (1, "[2]"), (4, "[4]")], "doc_id long, answer string")
    truths = spark.createDataFrame([(1, "t0", 0, 2), (1, "t1", 1, 2), (2, "t", 0, 1)], "doc_id long, truth string, list_no int, n_lists int")
    every = requests.all_requests(docs, answers, truths, "p", "i")
    rows = sorted((r.doc_id, r.request, r.list_no, r.reason) for r in every.collect() if r.list_no is None)
    assert rows == [
        (1, "extract", None, None), (1, "judge", None, None), (1, "judge", None, None), (2, "extract", None, None), (3, "extract", None, None),
        (4, "extract", None, "unsupported"), (4, "judge", None, "unsupported"), (5, "extract", None, "unsupported"),
    ]
    trained = [json.loads(r.body) for r in every.where("request = 'train'").collect()]
    assert sorted((t[3]["block"]["text"], t[4]["block"]["text"]) for t in trained) == [("[1]", "t0"), ("[1]", "t1"), ("[2]", "t0"), ("[2]", "t1")]
    assert every.where("body is null and reason is null").count() == 0


def test_first_working_backend(spark):
    df = spark.createDataFrame(
        [(1, None, None, "", 3, "t", 4), (2, "p", 1, "m", 2, None, None), (3, None, None, None, None, None, None)],
        "doc_id int, text_pypdf string, pages_pypdf int, text_pdfminer string, pages_pdfminer int, text_pdftotext string, pages_pdftotext int",
    )
    got = [tuple(r) for r in documents.pick_text(df).orderBy("doc_id").collect()]
    assert got == [(1, "", 3, "pdfminer"), (2, "p", 1, "pypdf"), (3, None, None, None)]
    forced = [tuple(r) for r in documents.pick_text(df, engine="pdftotext").orderBy("doc_id").collect()]
    assert forced == [(1, "t", 4, "pdftotext"), (2, None, None, None), (3, None, None, None)]
    with pytest.raises(ValueError):
        documents.pick_text(df, engine="other")


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,size,note\nAlCo,3.5,"a ""b"",\nc"\nNone,NA,N/A\n,nan,x\n')
    rows = files.read_table(spark, str(tmp_path / "t.csv"), "name string, size double, note string", multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("AlCo", 3.5, 'a "b",\nc'), (None, None, None), (None, None, "x")]
    (tmp_path / "typed.csv").write_text("n,x,b,t,e\n1,1.5,true,1,\n-2,NA,False,1x,\n,3,,,\n")
    typed = files.read_table(spark, str(tmp_path / "typed.csv"), infer=True)
    assert dict(typed.dtypes) == {"n": "bigint", "x": "double", "b": "boolean", "t": "string", "e": "string"}
    assert [tuple(r) for r in typed.collect()] == [(1, 1.5, True, "1", None), (-2, None, False, "1x", None), (None, 3.0, None, None, None)]
    df = spark.createDataFrame([("a,b", None, {"Al": 1.0}, 'q"x')], "name string, miss string, m map<string,double>, t string")
    sinks.write_csv(df, str(tmp_path / "out" / "deep"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "out" / "deep")).first()
    assert tuple(back) == ("a,b", None, '{"Al":1.0}', 'q"x')


def test_log_file(spark, tmp_path):
    step = "Training step {s}. Epoch {e}: : {s}it [{c}, {r}s/it]\n\nPrompt {s}\n\n[with] lines, too\nTF-IDF Cosine Similarity: {v}\n\n"
    (tmp_path / "run.txt").write_text(
        step.format(s=1, e=0, c="01:25", r="85.58", v="0.4733") + step.format(s=2, e=0, c="1:03:11", r="97.69", v="1.0000")
    )
    got = [tuple(r) for r in files.read_prompt_logs(spark, str(tmp_path)).orderBy("version").collect()]
    assert got == [
        ("run.txt", 1, 0, 1, 85, 85.58, "Prompt 1\n\n[with] lines, too", 0.4733),
        ("run.txt", 2, 0, 2, 3791, 97.69, "Prompt 2\n\n[with] lines, too", 1.0),
    ]


def test_results_and_verdict_tables(spark, tmp_path):
    answers = spark.createDataFrame([(1, "[1]"), (2, "none")], "doc_id long, response string")
    for _ in range(2):  # a repeated run replaces its own rows
        sinks.write_outcomes(responses.parse_v2(answers), str(tmp_path / "t"), "run1")
    sinks.write_outcomes(responses.parse_v2(answers.where("false")), str(tmp_path / "t"), "run2")
    results, held = sinks.read_results(spark, str(tmp_path / "t")), sinks.read_quarantine(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in results.collect()] == [(1, "[1]")]
    assert [tuple(r) for r in held.collect()] == [(2, "raw", "none")]
    assert "PartitionFilters: [isnotnull(status" in executed_plan(results)
    docs = spark.range(1, 5).withColumnRenamed("id", "doc_id")
    assert sorted(r.doc_id for r in documents.pending_docs(docs, results, held).collect()) == [3, 4]
    verdict = spark.createDataFrame([(1, "Yes")], "doc_id long, verdict_text string")
    for run in ("a", "a", "b"):
        sinks.write_verdicts(verdict, str(tmp_path / "v"), run)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    files_in = spark.createDataFrame([(f"p{k}.json", '[{"name": "a"}, {"name": "b"}]') for k in range(30)], "file_name string, value string")
    sinks.write_combined(records.combine_records(files_in), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 60


def test_stream_works_on_new_documents_only(spark, tmp_path):
    configure(spark)
    arriving, outcomes = tmp_path / "arriving", work_folder(spark, "outcomes")
    schema = "doc_id long, response string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(arriving))

    def ingest_all(checkpoint):
        stream = spark.readStream.schema(schema).parquet(str(arriving))
        ingest.ingest_answers(stream, outcomes, str(tmp_path / checkpoint)).awaitTermination()
        return {(r.doc_id, r.status, r.json, r.raw) for r in ingest.read_outcomes(spark, outcomes).collect()}

    arrive([(1, "[1]"), (2, "none"), (1, "[9]"), (1, "[1]")])  # of differing answers the first in text order counts
    first = {(1, "ok", "[1]", None), (2, "raw", None, "none")}
    assert ingest_all("c1") == first
    arrive([(2, "[2]"), (3, "x {'a': 1,}")])
    both = first | {(3, "ok", '{"a":1}', None)}
    assert ingest_all("c1") == both
    # A new checkpoint reads every file again but finds all outcomes present.
    assert ingest_all("c2") == both
    assert ingest.read_outcomes(spark, outcomes).count() == 3


def test_a_batch_without_its_commit_is_repeated_alike(spark, tmp_path):
    configure(spark)
    outcomes = work_folder(spark, "outcomes")
    spark.createDataFrame([(k, f"[{k}]") for k in range(50)], "doc_id long, response string").write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("doc_id long, response string").parquet(str(tmp_path / "in"))
        ingest.ingest_answers(stream, outcomes, str(tmp_path / "c"), buckets=4).awaitTermination()
        return sorted((r.doc_id, r.json, r.batch) for r in ingest.read_outcomes(spark, outcomes).collect())

    first = run()
    (tmp_path / "c" / "commits" / "0").unlink()
    for crc in (tmp_path / "c" / "commits").glob(".0.crc"):
        crc.unlink()
    assert run() == first and len(first) == 50


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    outcomes = work_folder(spark, "outcomes")
    ingest.create_outcomes(spark.createDataFrame([], "doc_id long, response string"), outcomes)
    plan = executed_plan(ingest.known_ids(spark, outcomes, [3, 5], ["b"]))
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stream_of_files(spark, tmp_path):
    answers = tmp_path / "answers"
    answers.mkdir()
    (answers / "p1.v2.txt").write_text("Result:\n[1]\nend")
    (answers / "p2.txt").write_text("none")
    outcomes = work_folder(spark, "outcomes")
    for _ in range(2):
        stream = ingest.stream_answer_files(spark, str(answers), files_per_batch=1)
        ingest.ingest_answers(stream, outcomes, str(tmp_path / "c")).awaitTermination()
    rows = ingest.read_outcomes(spark, outcomes).collect()
    assert {(r.doc_id, r.status, r.json, r.raw) for r in rows} == {("p1", "ok", "[1]", None), ("p2", "raw", None, "none")}
    assert {r.batch[-2:] for r in rows} == {"-0", "-1"}


def test_stream_of_pdfs(spark, folder, tmp_path):
    stream = ingest.stream_pdfs(spark, str(folder))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert [(r.doc_id, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("a", PDF)]


def test_many_files_are_written_by_many_tasks(spark, monkeypatch):
    """A small table that becomes one file for each row is not written by one task."""
    made = {}
    monkeypatch.setattr(queries, "work_folder", lambda session, purpose: made.setdefault(purpose, work_folder(session, purpose)))
    queries.scan_folders(spark, "/root/testdata/sf0.001")
    queries.record_folder(spark, "/root/testdata/sf0.001")
    for purpose, pattern in (("pdfs", "*.pdf"), ("nations", "*/*.PDF"), ("records", "*.json")):
        tasks = {re.match(r"part-(\d+)", f.name)[1] for f in Path(made[purpose]).glob(pattern)}
        assert len(tasks) == 4, purpose


@pytest.mark.parametrize("wrong", ["position + 1", "2 * position", "10 - position"])
def test_scan_folders_sees_wrong_positions(spark, monkeypatch, wrong):
    scan = files.scan_pdfs_recursive
    monkeypatch.setattr(files, "scan_pdfs_recursive", lambda *a: scan(*a).withColumn("position", F.expr(wrong)))
    found = queries.scan_folders(spark, "/root/testdata/sf0.001")
    assert found.where("scan = 'recursive' and not good").count() > 0
