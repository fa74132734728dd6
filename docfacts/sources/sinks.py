"""Writers: result, quarantine and verdict tables, and CSV files with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that text formats can hold them."""
    nested = ("struct", "array", "map", "variant")
    return df.select(
        *[
            F.to_json(F.col(f"`{name}`")).alias(name) if kind.startswith(nested) else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, no index; quotes doubled; missing values empty. Folders are made as needed."""
    _plain(df).write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"').option(
        "nullValue", ""
    ).option("emptyValue", "").csv(path)


def _write_run(df: DataFrame, path: str, run_id: str, *by: str) -> None:
    """Write the partitions of one run; running it again replaces them, other runs stay."""
    df.withColumn("run", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", *by).parquet(path)


def write_outcomes(parsed: DataFrame, path: str, run_id: str, doc_id: str = "doc_id", text: str = "response") -> None:
    """Parsed answers, and the whole raw text of all others, as one table partitioned by run and status.

    One table instead of a file per document, and one pass, so each answer is parsed once. A repeated run with the
    same ``run_id`` replaces its own rows.
    """
    outcome = parsed.select(
        doc_id,
        F.to_json("json").alias("json"),
        F.when(F.col("status") != "ok", F.col(text)).alias("raw"),
        "status",
    )
    _write_run(outcome, path, run_id, "status")


def write_combined(combined: DataFrame, path: str) -> None:
    """The combined table sorted by paper and position, in files that follow one another."""
    combined.repartitionByRange("Paperid").sortWithinPartitions("Paperid", "pos").write.mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """The parsed answers of :func:`write_outcomes`; reads only their partition."""
    return spark.read.parquet(path).where(F.col("status") == "ok").select(doc_id, "json")


def read_quarantine(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """The answers without a result, with reason and raw text; reads only their partitions."""
    return (
        spark.read.parquet(path).where(F.col("status") != "ok").select(doc_id, F.col("status").alias("reason"), "raw")
    )


def write_verdicts(verdicts: DataFrame, path: str, run_id: str) -> None:
    """Verdicts of one run; a repeated run replaces its own rows."""
    _write_run(verdicts.select("doc_id", "verdict_text"), path, run_id)
