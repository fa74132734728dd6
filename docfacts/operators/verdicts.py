"""Judge verdict texts to answers, scores and batch feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Question 9 asks whether something was missed, so "no" is the good answer.
GOOD_IF_NO = (9,)


def verdict_answers(verdicts: DataFrame, doc_id: str = "doc_id", text: str = "verdict_text") -> DataFrame:
    """One row per non-blank line: question number by position, ``yes``, ``no`` or null."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: F.length(F.trim(line)) > 0)
    answer = F.nullif(F.lower(F.regexp_extract("line", r"(?i)\b(yes|no)\b", 1)), F.lit(""))
    return verdicts.select(doc_id, F.posexplode(lines).alias("_pos", "line")).select(
        doc_id, (F.col("_pos") + 1).alias("question_no"), answer.alias("answer")
    )


def verdict_scores(
    verdicts: DataFrame, doc_id: str = "doc_id", text: str = "verdict_text", good_if_no: Sequence[int] = GOOD_IF_NO
) -> DataFrame:
    """Per line number: answers, yes, no, unclear and the share of good answers among the clear ones."""
    good = F.when(F.col("question_no").isin(*good_if_no), F.col("answer") == "no").otherwise(F.col("answer") == "yes")
    return (
        verdict_answers(verdicts, doc_id, text)
        .groupBy("question_no")
        .agg(
            F.count(F.lit(1)).alias("n_answers"),
            F.count_if(F.col("answer") == "yes").alias("n_yes"),
            F.count_if(F.col("answer") == "no").alias("n_no"),
            F.count_if(F.col("answer").isNull()).alias("n_unclear"),
            F.try_divide(F.count_if(good), F.count("answer")).alias("good_rate"),
        )
    )


def batch_feedback(
    batches: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id", text: str = "verdict_text"
) -> DataFrame:
    """All verdict texts of each batch, in batch order; several verdicts of one document in text order."""
    return (
        batches.join(verdicts.select(doc_id, text), doc_id)
        .groupBy("epoch", "batch")
        .agg(
            F.count(F.lit(1)).alias("n_verdicts"),
            F.sort_array(F.collect_list(F.struct("position", text))).alias("_texts"),
        )
        .select("epoch", "batch", "n_verdicts", F.array_join(F.col(f"_texts.{text}"), "\n\n").alias("feedback"))
    )
