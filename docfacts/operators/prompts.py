"""Prompt versions: similarity of successive prompts and reading a run's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docfacts.functions.text import prompt_terms
from docfacts.operators.grouping import previous_in_group

# The first line of a step of a run's log, and a step.
LOG_BEGIN = r"Training step \d+\. Epoch \d+:"
LOG_STEP = (
    r"(?s)Training step (\d+)\. Epoch (\d+):[^\n\[]*\[([\d:]+)[^,\n]*,\s*([\d.]+)s/it\][^\n]*\n"
    r"(.*?)\n?TF-IDF Cosine Similarity: (-?[\d.]+)"
)


def prompt_similarity(
    history: DataFrame,
    run_id: str = "run_id",
    version: str = "version",
    prompt: str = "prompt",
    block: int = 256,
) -> DataFrame:
    """TF-IDF cosine of each prompt with the one before it in the same run.

    The two prompts are the whole corpus, so a term in both has idf 1 and a term in one
    ln(3/2) + 1. The texts are shuffled by run and version range (``block`` versions), plus one
    text for each range that the next range starts from; terms are counted and compared in the same stage.
    """
    steps = previous_in_group(history, run_id, version, prompt, block).where(F.col("previous").isNotNull())
    keys = [run_id, "_block", version]
    both = F.array(
        F.struct(F.col("previous").alias("t"), F.lit(True).alias("old")),
        F.struct(F.col(prompt).alias("t"), F.lit(False).alias("old")),
    )
    terms = steps.select(*keys, F.inline(both)).select(*keys, "old", F.explode_outer(F.expr(prompt_terms("t"))).alias("term"))
    counts = terms.groupBy(*keys, "term").agg(
        F.count_if(F.col("old") & F.col("term").isNotNull()).alias("a"),
        F.count_if(~F.col("old") & F.col("term").isNotNull()).alias("b"),
    )
    idf = F.when((F.col("a") > 0) & (F.col("b") > 0), F.lit(1.0)).otherwise(F.log(F.lit(1.5)) + F.lit(1.0))
    weighted = counts.select(*keys, (F.col("a") * idf).alias("x"), (F.col("b") * idf).alias("y"))
    sums = weighted.groupBy(*keys).agg(
        F.sum(F.col("x") * F.col("y")).alias("dot"),
        F.sum(F.col("x") * F.col("x")).alias("xx"),
        F.sum(F.col("y") * F.col("y")).alias("yy"),
    )
    cosine = F.when((F.col("xx") == 0) | (F.col("yy") == 0), F.lit(0.0)).otherwise(
        F.col("dot") / (F.sqrt("xx") * F.sqrt("yy"))
    )
    return sums.select(run_id, version, cosine.alias("similarity"))


def _seconds(clock: str):
    """``h:mm:ss`` or ``mm:ss`` to seconds."""
    parts = F.transform(F.split(F.col(clock), ":"), lambda p: p.cast("int"))
    return F.aggregate(parts, F.lit(0), lambda total, p: total * 60 + p)


def parse_prompt_log(logs: DataFrame, log_id: str = "log_id", text: str = "value") -> DataFrame:
    """One row per step of a run's log: numbers printed by the bar, new prompt, similarity."""
    groups = ["step", "epoch", "clock", "seconds_per_step", "prompt", "similarity"]
    steps = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(LOG_STEP), F.lit(0))).alias("_pos", "_step")
    parts = [F.regexp_extract("_step", LOG_STEP, i + 1).alias(g) for i, g in enumerate(groups)]
    return (
        logs.select(log_id, steps)
        .select(log_id, (F.col("_pos") + 1).alias("version"), *parts)
        .select(
            log_id,
            "version",
            F.col("epoch").cast("int").alias("epoch"),
            F.col("step").cast("int").alias("step"),
            _seconds("clock").alias("elapsed_s"),
            F.col("seconds_per_step").cast("double").alias("seconds_per_step"),
            F.btrim("prompt", F.lit("\n")).alias("prompt"),
            F.col("similarity").cast("double").alias("similarity"),
        )
    )
