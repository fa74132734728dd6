r"""Formatting conversations with typed content parts, by DataFrame functions only.

A turn's content is a list of parts. A visitor, one expression for each kind of part, turns
the list into text: text parts are escaped, image, audio and document parts become placeholders
``<image 0>`` numbered in order, whose references and token counts go to a list of attachments.

Turns are written ``<turn ROLE>TEXT</turn>`` and a line feed. Inside roles and texts ``\``, ``<`` and ``>``
are written ``\e``, ``\l`` and ``\g``. A raw ``<`` or ``>`` is therefore always a control string, and plain
replacement (``\e`` last) gives the text back.

Defined cases: a null text is empty, a null role is empty, a null part list is empty, a part of
unknown kind is an error of the row and leaves a ``<unknown n>`` placeholder; turns are ordered by
turn, then role, then text (nulls first), repeated rows are repeated turns; a null ``conv_id`` is a
conversation of its own; other columns are ignored; an empty table gives an empty result. One conversation
becomes one row, since it is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TRAINED_ROLE = "assistant"
#: Token counts of attachments: pixels of a square patch's side, audio tokens a second, tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 1024

PART = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"

_OPEN, _SHUT, _END = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    for raw, written in (("\\", "\\e"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for raw, written in (("<", "\\l"), (">", "\\g"), ("\\", "\\e")):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A content list with one text part."""
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long"))]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *nothing)).cast(f"array<{PART}>")


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for; null for text."""
    sides = [F.ceil(F.coalesce(part[side], F.lit(0)) / PATCH) for side in ("width", "height")]
    return (
        F.when(part["kind"] == "image", sides[0] * sides[1])
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .cast("long")
    )


def visited(parts: Column, first: Column) -> Column:
    """The parts as one text: text escaped, other parts as placeholders numbered from ``first``."""
    start = F.struct(F.lit("").alias("text"), first.cast("long").alias("next"))

    def visit(done: Column, part: Column) -> Column:
        kind = F.when(part["kind"].isin("image", "audio", "document"), part["kind"]).otherwise("unknown")
        is_text = F.coalesce(part["kind"], F.lit("unknown")) == "text"
        seen = F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind, F.lit(" "), done["next"].cast("string"), F.lit(">")))
        return F.struct(F.concat(done["text"], seen).alias("text"), (done["next"] + F.when(is_text, 0).otherwise(1)).cast("long").alias("next"))

    return F.aggregate(parts, start, visit, lambda done: done["text"])


def format_conversations(turns: DataFrame, parts: Column, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row for each conversation: its text, the spans under the loss mask, its attachments.

    ``spans`` are code-point offsets (start from 0, length) of the trained role's contents in
    ``formatted``; ``attachments`` list the placeholders in order with their expanded token counts.
    """
    counted = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    grouped = counted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    # Numbers of the placeholders run through the conversation; most conversations hold none.
    others = F.transform("turns", lambda t: F.size(F.filter(t["parts"], lambda p: F.coalesce(p["kind"], F.lit("unknown")) != "text")))
    before = F.transform(others, lambda n, i: F.aggregate(F.slice(others, 1, i), F.lit(0), lambda a, b: a + b))
    starts = F.when(F.aggregate(others, F.lit(0), lambda a, b: a + b) > 0, before).otherwise(F.transform(others, lambda n: F.lit(0)))
    shown = grouped.select(
        "conv_id",
        F.transform(
            F.arrays_zip(F.col("turns").alias("turn"), starts.alias("start")),
            lambda t: F.struct(t["turn"]["role"].alias("role"), visited(t["turn"]["parts"], t["start"]).alias("content")),
        ).alias("shown"),
        F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), lambda p: F.coalesce(p["kind"], F.lit("unknown")) != "text").alias("attached"),
    )
    return shown.select("conv_id", F.inline(F.array(F.struct("shown", "attached")))).select(
        "conv_id",
        F.array_join(F.transform("shown", lambda t: F.concat(_head(t), t["content"], F.lit(_END))), "").alias("formatted"),
        _spans(F.col("shown"), trained_role).alias("spans"),
        F.transform(
            "attached", lambda p, i: F.struct(i.alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))
        ).alias("attachments"),
    )


def _head(turn: Column) -> Column:
    return F.concat(F.lit(_OPEN), escape(turn["role"]), F.lit(_SHUT))


def _spans(shown: Column, trained_role: str) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def add(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(_head(turn))
        size = F.length(turn["content"])
        span = F.array(F.struct(begin.cast("long").alias("start"), size.cast("long").alias("length")))
        spans = F.when(turn["role"] == trained_role, F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct((begin + size + len(_END)).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(shown, start, add, lambda done: done["spans"])


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of ``role, content``; placeholders stay as they are."""
    blocks = F.filter(F.split(formatted, _OPEN), lambda b: b != "")

    def read(block: Column) -> Column:
        body = F.substring_index(block, _END, 1)
        role = F.substring_index(body, _SHUT, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("content"))

    return F.transform(blocks, read)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    cut = F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted text finds: turns, loss text, lengths."""
    read = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
