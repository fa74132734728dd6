"""Request tables for an outside model service: prompts and documents as content blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docfacts.operators.documents import document_kind

# Labels of the ordered parts of an evaluation request.
EVALUATION_FIELDS = ["Evaluation Instruction", "Question", "Image", "Answer", "Ground Truth"]

SOURCE_TYPE = "struct<type:string,media_type:string,data:string>"


def base64_line(content: Column) -> Column:
    """Base64 without the line breaks Spark adds."""
    return F.translate(F.base64(content), "\r\n", "")


def text_block(text: Column) -> Column:
    return F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast(SOURCE_TYPE).alias("source")
    )


def document_block(content: Column, kind: Column) -> Column:
    """PDF bytes become a document block, images an image block."""
    is_pdf = kind == "pdf"
    source = F.struct(
        F.lit("base64").alias("type"),
        F.when(is_pdf, F.lit("application/pdf")).otherwise(kind).alias("media_type"),
        base64_line(content).alias("data"),
    )
    return F.struct(
        F.when(is_pdf, F.lit("document")).otherwise(F.lit("image")).alias("type"),
        F.lit(None).cast("string").alias("text"),
        source.alias("source"),
    )


def extraction_requests(
    documents: DataFrame, prompt: str, doc_id: str = "doc_id", content: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """Requests (prompt block, document block) as JSON, and the unsupported documents."""
    kinds = documents.withColumn("kind", document_kind(F.col(content)))
    blocks = F.array(text_block(F.lit(prompt)), document_block(F.col(content), F.col("kind")))
    requests = kinds.where(F.col("kind") != "unsupported").select(doc_id, "kind", F.to_json(blocks).alias("content"))
    rejected = kinds.where(F.col("kind") == "unsupported").select(doc_id, F.lit("unsupported").alias("reason"))
    return requests, rejected


def _evaluation_fields(instruction: str, question: str, document: Column, answer: Column, truth: Column | None) -> Column:
    values = [text_block(F.lit(instruction)), text_block(F.lit(question)), document, text_block(answer)]
    if truth is not None:
        values.append(text_block(truth))
    fields = [F.struct(F.lit(f).alias("field"), v.alias("block")) for f, v in zip(EVALUATION_FIELDS, values)]
    return F.to_json(F.array(*fields))


def evaluation_requests(
    paired: DataFrame,
    instruction: str,
    question: str,
    doc_id: str = "doc_id",
    content: str = "content",
    answer: str = "answer",
    ground_truth: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Judge requests (instruction, question, document, answer and, if given, ground truth, in that order), and the unsupported documents."""
    kinds = paired.withColumn("kind", document_kind(F.col(content)))
    truth = F.col(ground_truth) if ground_truth is not None else None
    fields = _evaluation_fields(instruction, question, document_block(F.col(content), F.col("kind")), F.col(answer), truth)
    requests = kinds.where(F.col("kind") != "unsupported").select(doc_id, fields.alias("fields"))
    rejected = kinds.where(F.col("kind") == "unsupported").select(doc_id, F.lit("unsupported").alias("reason"))
    return requests, rejected


def all_requests(
    documents: DataFrame, answers: DataFrame, truths: DataFrame, prompt: str, instruction: str, doc_id: str = "doc_id", content: str = "content"
) -> DataFrame:
    """Extraction, judge and training requests of all documents, contents read and joined once.

    ``answers`` has ``doc_id, answer``; ``truths`` has ``doc_id, truth, list_no, n_lists``: a training request holds one piece of the
    ground truth and says which. These two are joined first, by id. A document of unsupported kind gives the same
    rows with a ``reason`` and no body. Result: ``doc_id, request, list_no, n_lists, body, reason``.
    """
    turn = F.row_number().over(Window.partitionBy(doc_id).orderBy("answer"))
    numbered = answers.select(doc_id, "answer").withColumn("_first", turn == 1)
    wanted = numbered.join(truths.select(doc_id, "truth", "list_no", "n_lists"), doc_id, "left")
    kind = document_kind(F.col(content))
    joined = documents.select(doc_id, content, kind.alias("_kind")).join(wanted, doc_id, "left")
    supported = F.col("_kind") != "unsupported"
    block = joined.withColumn("_block", F.when(supported, document_block(F.col(content), F.col("_kind"))))
    first_piece = F.coalesce(F.col("list_no"), F.lit(0)) == 0
    no_piece = F.lit(None).cast("int")

    def request(name: str, when: Column, body: Column, *piece: Column) -> Column:
        reason = F.when(~supported, F.lit("unsupported"))
        fields = (F.lit(name).alias("request"), piece[0].alias("list_no"), piece[1].alias("n_lists"), F.when(supported, body).alias("body"), reason.alias("reason"))
        return F.when(when, F.struct(*fields))

    judge = _evaluation_fields(instruction, prompt, F.col("_block"), F.col("answer"), None)
    train = _evaluation_fields(instruction, prompt, F.col("_block"), F.col("answer"), F.col("truth"))
    rows = F.array(
        request("extract", F.coalesce(F.col("_first"), F.lit(True)) & first_piece, F.to_json(F.array(text_block(F.lit(prompt)), F.col("_block"))), no_piece, no_piece),
        request("judge", F.col("answer").isNotNull() & first_piece, judge, no_piece, no_piece),
        request("train", F.col("answer").isNotNull() & F.col("truth").isNotNull(), train, F.col("list_no"), F.col("n_lists")),
    )
    return block.select(doc_id, F.inline(F.filter(rows, lambda r: r.isNotNull())))
