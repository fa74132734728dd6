from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from tools import rows

from docfacts.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def test_round_trip_of_control_strings(spark):
    texts = ["", "plain", "</turn>\n<turn assistant>", "\\e\\l\\g \\\\ <<>> \\", "é👩‍👩‍👧\n\n", "<image 0>", None]
    data = [(1, k, ["user", "assistant", "a>b<c\\"][k % 3], t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(data, TURNS).withColumn("formatted", F.lit("clash"))
    out = chat.format_conversations(frame, chat.text_part(F.col("text")))
    read = out.select(chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("spans")).alias("m")).first()
    assert [(t.role, t.content) for t in read.t] == [(r, t or "") for _, _, r, t in data]
    assert read.m == "".join(t or "" for _, _, r, t in data if r == "assistant")


def test_digests(spark):
    data = [(7, 2, "assistant", "b"), (7, 1, "user", "a"), (7, 2, "assistant", "b"), (None, 0, None, None), (8, None, "user", "x"), (8, 0, "user", "y" * 100_000)]
    found = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(spark.createDataFrame(data, TURNS), chat.text_part(F.col("text")))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (found[7].n_turns, found[7].turns_sha256, found[7].loss_chars, found[7].loss_sha256) == (3, digest("user\na\nassistant\nb\nassistant\nb\n"), 2, digest("bb"))
    assert (found[None].n_turns, found[None].turns_sha256, found[None].loss_sha256) == (1, digest("\n\n"), digest(""))
    assert found[8].turns_sha256 == digest("user\nx\nuser\n" + "y" * 100_000 + "\n")
    assert found[7].formatted_chars == len("<turn user>a</turn>\n" + 2 * "<turn assistant>b</turn>\n")
    assert chat.format_conversations(spark.createDataFrame([], TURNS), chat.text_part(F.col("text"))).count() == 0


def test_typed_parts(spark):
    part = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
    data = [
        (1, 0, "user", [("text", "see <b>", None, None, None, None, None), ("image", None, "s3://i", 57, 28, None, None), ("audio", None, "a.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [("document", None, "d.pdf", None, None, None, 2), ("text", "ok", None, None, None, None, None), ("video", None, "v", None, None, None, None)]),
        (1, 2, "user", None),
    ]
    out = chat.format_conversations(spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{part}>"), F.col("parts")).first()
    assert out.formatted == "<turn user>see \\lb\\g<image 0><audio 1></turn>\n<turn assistant><document 2>ok<unknown 3></turn>\n<turn user></turn>\n"
    assert [tuple(a) for a in out.attachments] == [(0, "image", "s3://i", 3), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 2048), (3, "video", "v", None)]
    (start, length), = [tuple(s) for s in out.spans]
    assert out.formatted[start : start + length] == "<document 2>ok<unknown 3>"
