"""Readers: document folders, record files, tables with missing-value words, run logs."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from docfacts.operators.documents import id_before_first_dot
from docfacts.operators.grouping import with_position
from docfacts.operators.prompts import LOG_BEGIN, parse_prompt_log
from docfacts.sources.records_of_lines import marked_lines, quoted_cells, records_of_lines

# Cell texts that mean "missing" in a table file.
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def scan_pdfs(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """PDF files directly in a folder (suffix in lower case) with ``doc_id``; bytes only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    columns = ["path", "length"] + (["content"] if content else [])
    return files.select(id_before_first_dot(F.col("_metadata.file_name")).alias("doc_id"), *columns)


def scan_pdfs_recursive(spark: SparkSession, targets: Sequence[str]) -> DataFrame:
    """Distinct PDF paths of files and folders at any depth, suffix in any case, with their ``position`` in the order of paths."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .option("recursiveFileLookup", "true")
        .load(list(targets))
    )
    return with_position(files.select("path").distinct(), ["path"])


def read_record_files(spark: SparkSession, folder: str) -> DataFrame:
    """``*.json`` files of a folder, one row each: ``file_name``, ``path``, ``value``."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"), "value"
    )


def missing_words_to_null(df: DataFrame, words: Sequence[str] = tuple(NULL_WORDS)) -> DataFrame:
    """Text cells that only say "missing" become null."""
    text = {name for name, kind in df.dtypes if kind == "string"}

    def cell(name: str) -> Column:
        quoted = F.col(f"`{name}`")
        return F.when(~quoted.isin(list(words)), quoted).alias(name) if name in text else quoted

    return df.select(*[cell(c) for c in df.columns])


def typed_columns(df: DataFrame) -> DataFrame:
    """Text columns that hold only whole numbers, numbers or true/false (and nulls) get that type.

    Which type fits is decided over all rows in one aggregation; the narrowest wins.
    """
    text = [name for name, kind in df.dtypes if kind == "string"]
    if not text:
        return df
    kinds = {"bigint": r"[+-]?\d{1,18}", "double": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", "boolean": r"(?i:true|false)"}
    fits = [
        (F.count(F.when(~F.rlike(F.col(f"`{c}`"), F.lit(rf"\A{pattern}\z")), 1)) + F.when(F.count(F.col(f"`{c}`")) == 0, 1).otherwise(0)).alias(f"{i} {kind}")
        for i, c in enumerate(text)
        for kind, pattern in kinds.items()
    ]
    misses = df.agg(*fits).first()
    chosen = {c: next((kind for kind in kinds if misses[f"{i} {kind}"] == 0), None) for i, c in enumerate(text)}
    return df.select(*[F.col(f"`{c}`").cast(chosen[c]).alias(c) if chosen.get(c) else F.col(f"`{c}`") for c in df.columns])


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False, infer: bool = False
) -> DataFrame:
    """CSV with header; missing-value words become null.

    Columns are text unless a schema is given or ``infer`` asks for the types that all rows fit. With a schema,
    cells are read as text and cast, so that a missing-value word in a number column is null rather than an error.
    ``multi_line`` reads cells with line breaks in one task a file; :func:`read_split_table` reads them in many.
    """
    raw = (
        spark.read.option("header", "true").option("multiLine", str(multi_line).lower()).option("quote", '"').option("escape", '"')
        .csv(path)
    )
    return _typed(raw, schema, infer)


def _typed(raw: DataFrame, schema: StructType | str | None, infer: bool) -> DataFrame:
    clean = missing_words_to_null(raw)
    if schema is None:
        return typed_columns(clean) if infer else clean
    fields = schema.fields if isinstance(schema, StructType) else StructType.fromDDL(schema).fields
    return clean.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def read_split_table(spark: SparkSession, path: str, schema: StructType | str | None = None, infer: bool = False) -> DataFrame:
    """The same table as :func:`read_table` with ``multi_line``, but every file is read in its byte ranges.

    Which line ends lie inside a cell follows from the number of quotes before them, counted for each range and carried over the ranges before it.
    Quotes must stand around whole cells and be doubled inside, as :func:`docfacts.sources.sinks.write_csv` writes them. The names
    are those of the first file; every file has a header.
    """
    records = records_of_lines(spark, path, quoted_cells, states=2)
    first = records.where("block = 0 and seq = 0").orderBy("file").select("text").first()
    names = next(csv.reader([first["text"].rstrip("\r")]), []) if first else []
    if not names:
        return _typed(spark.createDataFrame([], "value string"), schema, infer)
    body = records.where("not (block = 0 and seq = 0)").select(F.regexp_replace("text", "\r\\z", "").alias("text")).where("text <> ''")
    parsed = body.select(F.from_csv("text", _ddl(names), {"quote": '"', "escape": '"', "multiLine": "true"}).alias("row"))
    return _typed(parsed.select("row.*"), schema, infer)


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def read_prompt_logs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs as prompt history rows, each file one log; a log of any size is read in its byte ranges.

    A step reaches from its first line to that of the next; ``version`` counts the finished steps of a log.
    """
    steps = records_of_lines(spark, path, marked_lines(LOG_BEGIN))
    named = steps.select(F.struct("file", "block", "seq").alias("place"), "text")
    parsed = parse_prompt_log(named, "place", "text").select(F.substring_index("place.file", "/", -1).alias("log_id"), "place", "*")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = parsed.groupBy("place.file", "place.block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.struct("file", "block").alias("range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("place.file", "place.block").orderBy("place.seq")
    ranked = parsed.withColumn("rank", F.row_number().over(inside)).join(before, F.struct("place.file", "place.block") == F.col("range"))
    numbered = ranked.withColumn("version", (F.col("before") + F.col("rank")).cast("int"))
    return numbered.select("log_id", "version", "epoch", "step", "elapsed_s", "seconds_per_step", "prompt", "similarity")
