"""Text statistics and token budgets per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docfacts.functions.numbers import fixed_decimals
from docfacts.functions.text import (
    count_words,
    normalize_text,
    round_half_even,
    tokens_from_chars,
    tokens_from_words,
)

# Page sizes in inches.
PAGE_SIZES = {"letter": (8.5, 11.0), "a4": (8.27, 11.69)}

# Columns of the statistics file.
CSV_COLUMNS = [
    "file", "pages", "characters", "words", "tokens_word_est", "tokens_char_est", "tokens_tiktoken",
    "engine", "image_mp", "image_tokens", "total_tokens_word_est", "total_tokens_char_est",
    "total_tokens_tiktoken",
]


def text_stats(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    pages: Column | None = None,
    engine: Column | None = None,
    exact_tokens: Column | None = None,
) -> DataFrame:
    """Characters, words and token estimates of each readable document.

    Narrow: the texts stay where they are read and only numbers leave the scan. Rows
    without text are failures and left out. ``exact_tokens`` is a count by a tokenizer,
    over the normalised text column ``norm``; without it the exact count is null.
    """
    null_int = F.lit(None).cast("int")
    return (
        documents.where(F.col(text).isNotNull())
        .withColumn("norm", F.expr(normalize_text(text)))
        .withColumn("characters", F.length("norm").cast("bigint"))
        .withColumn("words", F.expr(count_words("norm")).cast("bigint"))
        .select(
            F.col(doc_id).alias("doc_id"),
            (pages if pages is not None else null_int).alias("pages"),
            "characters",
            "words",
            F.expr(tokens_from_words("words")).alias("tokens_word_est"),
            F.expr(tokens_from_chars("characters")).alias("tokens_char_est"),
            (exact_tokens if exact_tokens is not None else null_int).cast("bigint").alias("tokens_tiktoken"),
            (engine if engine is not None else F.lit(None).cast("string")).alias("engine"),
        )
    )


def text_failures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents left out of the statistics because no extraction gave a text."""
    return documents.where(F.col(text).isNull()).select(F.col(doc_id), F.lit("no_text").alias("reason"))


def default_page_size(size: str = "letter", width: float | None = None, height: float | None = None) -> tuple[float, float]:
    """Both overrides together win; otherwise the named size, letter if unknown."""
    if width is not None and height is not None:
        return width, height
    return PAGE_SIZES.get(size, PAGE_SIZES["letter"])


def image_megapixels(
    documents: DataFrame,
    page_geometry: DataFrame,
    dpi: int = 150,
    default_size: str = "letter",
    default_width: float | None = None,
    default_height: float | None = None,
    doc_id: str = "doc_id",
    pages: str = "pages",
) -> DataFrame:
    """Adds ``image_mp`` and ``pages_used``: from page sizes, else default size times page count.

    The page sums are formed before the join, so a document with very many pages sends
    one row per map task.
    """
    width, height = default_page_size(default_size, default_width, default_height)
    page_pixels = (F.col("width_in") * F.lit(dpi)) * (F.col("height_in") * F.lit(dpi))
    measured = page_geometry.groupBy(F.col("doc_id").alias(doc_id)).agg(
        F.sum(page_pixels / F.lit(1e6)).alias("_mp"), F.count(F.lit(1)).alias("_pages")
    )
    assumed_pages = F.greatest(F.coalesce(F.col(pages), F.lit(1)), F.lit(1)).cast("bigint")
    default_mp = (width * dpi) * (height * dpi) / 1e6
    return (
        documents.join(measured, doc_id, "left")
        .withColumn("image_mp", F.coalesce(F.col("_mp"), F.lit(default_mp) * assumed_pages))
        .withColumn("pages_used", F.coalesce(F.col("_pages"), assumed_pages))
        .drop("_mp", "_pages")
    )


def token_budget(
    stats: DataFrame, image_divisor: float | None = None, image_tokens_per_mp: float | None = None
) -> DataFrame:
    """Adds image tokens and text + image totals; a divisor goes before a rate.

    Expects ``image_mp`` (null where images are not estimated).
    """
    if image_divisor is not None:
        image = F.expr(round_half_even(f"image_mp * 1e6D / {float(image_divisor)!r}D"))
    elif image_tokens_per_mp is not None:
        image = F.expr(round_half_even(f"image_mp * {float(image_tokens_per_mp)!r}D"))
    else:
        image = F.lit(None).cast("bigint")
    budget = stats.withColumn("image_tokens", image)
    for source in ("word_est", "char_est", "tiktoken"):
        budget = budget.withColumn(f"total_tokens_{source}", F.col(f"tokens_{source}") + F.col("image_tokens"))
    return budget


def without_images(stats: DataFrame) -> DataFrame:
    """The budget columns of a run without image estimation: all null."""
    return token_budget(stats.withColumn("image_mp", F.lit(None).cast("double")))


def token_report(budget: DataFrame, file: str = "doc_id") -> DataFrame:
    """One tab-separated line per document; unknown optional parts are left out."""

    def part(label: str, column: Column) -> Column:
        return F.concat(F.lit(f"{label}="), column.cast("string"))

    line = F.concat_ws(
        "\t",
        F.col(file).cast("string"),
        part("pages", F.col("pages")),
        part("chars", F.col("characters")),
        part("words", F.col("words")),
        part("tokens(word-est)", F.col("tokens_word_est")),
        part("tokens(char-est)", F.col("tokens_char_est")),
        part("tokens(tiktoken)", F.coalesce(F.col("tokens_tiktoken").cast("string"), F.lit("-"))),
        part("engine", F.col("engine")),
        part("image_mp", F.expr(fixed_decimals("image_mp", 2))),
        part("image_tokens", F.col("image_tokens")),
        part("total_tokens(word-est)", F.col("total_tokens_word_est")),
        part("total_tokens(char-est)", F.col("total_tokens_char_est")),
        part("total_tokens(tiktoken)", F.col("total_tokens_tiktoken")),
    )
    return budget.select(F.col(file), line.alias("line"))


def token_budget_csv(budget: DataFrame, file: str = "doc_id") -> DataFrame:
    """The 13 text columns of the statistics file; unknown values are empty."""
    shown = budget.withColumn("file", F.col(file)).withColumn("image_mp", F.expr(fixed_decimals("image_mp", 4)))
    return shown.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS])


def token_totals(budget: DataFrame) -> DataFrame:
    """Totals of all documents; text estimates are computed again from the summed counts."""
    sums = budget.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.coalesce(F.sum("characters"), F.lit(0)).alias("chars"),
        F.sum("tokens_tiktoken").alias("tokens_tiktoken"),
        F.sum("image_mp").alias("image_mp"),
        F.sum("image_tokens").alias("image_tokens"),
    )
    totals = sums.withColumn("tokens_word_est", F.expr(tokens_from_words("words"))).withColumn(
        "tokens_char_est", F.expr(tokens_from_chars("chars"))
    )
    for source in ("word_est", "char_est", "tiktoken"):
        totals = totals.withColumn(f"total_tokens_{source}", F.col(f"tokens_{source}") + F.col("image_tokens"))
    return totals


def token_total_line(totals: DataFrame) -> DataFrame:
    """The totals as one tab-separated line; unknown optional parts are left out."""
    # The labels and their order.
    labels = [
        ("files", "files"), ("words", "words"), ("chars", "chars"), ("tokens(word-est)", "tokens_word_est"),
        ("tokens(char-est)", "tokens_char_est"), ("tokens(tiktoken)", "tokens_tiktoken"), ("image_mp", "image_mp"),
        ("image_tokens", "image_tokens"), ("total_tokens(word-est)", "total_tokens_word_est"),
        ("total_tokens(char-est)", "total_tokens_char_est"), ("total_tokens(tiktoken)", "total_tokens_tiktoken"),
    ]
    shown = totals.withColumn("image_mp", F.expr(fixed_decimals("image_mp", 2))).withColumn(
        "tokens_tiktoken", F.coalesce(F.col("tokens_tiktoken").cast("string"), F.lit("-"))
    )
    parts = [F.concat(F.lit(f"{label}="), F.col(column).cast("string")) for label, column in labels]
    return shown.select(F.concat_ws("\t", F.lit("TOTAL"), *parts).alias("line"))
