"""From documents to packed training sequences: five stages, each a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docfacts.llm.common import small_batches, table, written
from docfacts.llm.jaccard import without_near_copies
from docfacts.llm.mixing import mixed_documents
from docfacts.llm.packing import pack
from docfacts.llm.queries import VOCABULARY
from docfacts.llm.suffix_dedup import without_repeats
from docfacts.llm.tokenizer import special_path
from docfacts.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    A null or empty text is scored by the constant alone and stays; equal rows go or stay together; an empty table stays empty.
    """
    small_batches(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Texts without words and rows with a null id stay, all of them; rows of one id are judged by their own texts, and repeated rows leave one.
    """
    small_batches(spark)
    return without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that came before in a smaller document are cut out of the texts.

    No row goes. Null texts, texts under 50 bytes and rows with a null id keep what they have; rows of one id do not cut each other.
    """
    small_batches(spark)
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Texts without words weigh nothing and are taken once; a null source is a source of its own; of equal rows some may be taken once more
    than others.
    """
    small_batches(spark)
    return mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    A null or empty text is its end mark alone; repeated rows are packed each for itself; an empty table has no pieces.
    """
    small_batches(spark)
    return pack(docs, special_path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: A trained classifier and a tokenizer have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
