"""Choosing, classifying and pairing documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docfacts.operators.grouping import with_position

# Leading bytes of the supported file kinds, in the order they are tested.
SIGNATURES = {"jpeg": "FFD8FF", "png": "89504E47", "pdf": "255044462D"}


def file_name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def id_before_first_dot(file_name: Column) -> Column:
    return F.substring_index(file_name, ".", 1)


def flat_pdfs(paths: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Files directly in ``folder`` whose name ends with ``.pdf`` in lower case, with ``doc_id``."""
    name = file_name_of(F.col(path))
    in_folder = F.col(path) == F.concat(F.lit(folder.rstrip("/") + "/"), name)
    return paths.where(in_folder & F.endswith(name, F.lit(".pdf"))).select(
        F.col(path).alias("path"), id_before_first_dot(name).alias("doc_id")
    )


def all_pdfs(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct ``.pdf`` paths at any depth, suffix in any case."""
    is_pdf = F.endswith(F.lower(F.col(path)), F.lit(".pdf"))
    return paths.where(is_pdf).select(F.col(path).alias("path")).distinct()


def sorted_pdfs(paths: DataFrame, path: str = "path") -> DataFrame:
    """The paths of :func:`all_pdfs` with their ``position`` in text order."""
    return with_position(all_pdfs(paths, path), ["path"])


def both_scans(paths: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """The rows of :func:`flat_pdfs` and :func:`all_pdfs` from one pass, told apart by ``scan`` (flat, recursive)."""
    counted = paths.where(F.endswith(F.lower(F.col(path)), F.lit(".pdf"))).groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("_n"))
    name = file_name_of(F.col("path"))
    is_flat = (F.col("path") == F.concat(F.lit(folder.rstrip("/") + "/"), name)) & F.endswith(name, F.lit(".pdf"))
    flat = F.struct(F.lit("flat").alias("scan"), id_before_first_dot(name).alias("doc_id"))
    deep = F.struct(F.lit("recursive").alias("scan"), F.lit(None).cast("string").alias("doc_id"))
    rows = F.concat(F.array_repeat(flat, F.when(is_flat, F.col("_n")).otherwise(0).cast("int")), F.array(deep))
    return counted.select("path", F.inline(rows)).select("scan", "path", "doc_id")


def pending_docs(documents: DataFrame, results: DataFrame, quarantined: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents that have neither a result nor a quarantined answer.

    The finished ids are made distinct first (partly before the shuffle), so repeated
    answers of one document stay small. The done side grows with the data, so the join
    strategy is left to the measured size at run time.
    """
    done = results.select(doc_id).union(quarantined.select(doc_id)).distinct()
    return documents.join(done, doc_id, "left_anti")


def stem_of(path: Column) -> Column:
    """Path without the last extension of its file name."""
    return F.regexp_replace(path, r"(?s)(?<=[^/.])\.[^./]*\z", "")


def pair_outputs(outputs: DataFrame, pdfs: DataFrame, path: str = "path") -> DataFrame:
    """Record files with ``pdf_path``, the PDF of the same stem; null where there is none.

    Both sides have one row per path, so no stem is heavy.
    """
    left = outputs.withColumn("_stem", stem_of(F.col(path)))
    right = pdfs.where(F.endswith(F.col(path), F.lit(".pdf"))).select(
        stem_of(F.col(path)).alias("_stem"), F.col(path).alias("pdf_path")
    )
    return left.join(right, "_stem", "left").drop("_stem")


def document_kind(content: Column) -> Column:
    """``jpeg``, ``png`` or ``pdf`` by leading bytes, otherwise ``unsupported``."""
    kind = None
    for name, signature in SIGNATURES.items():
        test = F.hex(F.substring(content, 1, len(signature) // 2)) == signature
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.otherwise("unsupported")


def classify_docs(documents: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``kind``, and ``is_pdf``."""
    return documents.withColumn("kind", document_kind(F.col(content))).withColumn("is_pdf", F.col("kind") == "pdf")


def pick_text(
    documents: DataFrame,
    engines: Sequence[str] = ("pypdf", "pdfminer", "pdftotext"),
    engine: str = "auto",
    text_prefix: str = "text_",
    pages_prefix: str = "pages_",
) -> DataFrame:
    """Adds ``text``, ``pages`` and ``engine`` of the first extraction that worked.

    Null text means the extraction failed, an empty text is a success. A named ``engine``
    is the only one asked. Rows where all failed keep nulls.
    """
    asked = list(engines) if engine == "auto" else [engine]
    unknown = [e for e in asked if e not in engines]
    if unknown:
        raise ValueError(f"Unknown engine: {unknown[0]}")
    choices = [
        F.when(
            F.col(f"{text_prefix}{e}").isNotNull(),
            F.struct(
                F.col(f"{text_prefix}{e}").alias("text"),
                F.col(f"{pages_prefix}{e}").alias("pages"),
                F.lit(e).alias("engine"),
            ),
        )
        for e in asked
    ]
    spent = [f"{p}{e}" for e in engines for p in (text_prefix, pages_prefix)]
    return (
        documents.withColumn("_pick", F.coalesce(*choices))
        .drop(*spent)
        .withColumn("text", F.col("_pick.text"))
        .withColumn("pages", F.col("_pick.pages"))
        .withColumn("engine", F.col("_pick.engine"))
        .drop("_pick")
    )
