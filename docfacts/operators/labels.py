"""Human labels: record lists per paper, training batches, agreement with extracted records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docfacts.functions.matching import matches_within
from docfacts.operators.grouping import bounded_lists, chains_within, spread_positions

# Label file column of each record field.
LABEL_COLUMNS = {
    "name": "HEAname",
    "nominal_composition": "nominal_compositions",
    "measured_composition": "measured_compositions",
    "lattice_constant": "RT_Lattice_Constant_A",
    "phases": "Phase",
    "alloy_condition": "Processing_Method",
    "doi": "Ref",
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any floating-point column becomes null."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(
        *[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]
    )


def label_records(labels: DataFrame, keep: Sequence[str] = ("Paperid",)) -> DataFrame:
    """Label columns under their record field names, NaN as null."""
    clean = nan_to_null(labels)
    return clean.select(*keep, *[F.col(source).alias(field) for field, source in LABEL_COLUMNS.items()])


def label_sets(
    records: DataFrame,
    order: str,
    folder: str = "",
    paper_id: str = "Paperid",
    list_size: int = 10_000,
) -> DataFrame:
    """Training set: document path and its label records, in the order of ``order`` (a whole number, unique per row).

    A paper with more than ``list_size`` records gives several rows: piece ``list_no`` (from 0) of ``n_lists``.
    """
    item = F.struct(*LABEL_COLUMNS)
    lists = bounded_lists(records, paper_id, order, item, list_size)
    path = F.concat(F.lit(folder), F.col(paper_id).cast("string"), F.lit(".pdf"))
    return lists.select(paper_id, path.alias("path"), "list_no", "n_lists", "n_items", F.col("items").alias("records"))


def mini_batches(
    items: DataFrame,
    item_id: str = "doc_id",
    epochs: int = 3,
    batch_size: int = 3,
    seed: int = 0,
    mix: Callable[[Column, Column], Column] | None = None,
    mix_range: int = 1 << 40,
    buckets: int = 1024,
) -> DataFrame:
    """Every item once per epoch, in seeded random order, cut into batches.

    ``mix(id, epoch)`` gives the shuffle key in ``[0, mix_range)``; by default a hash. The key
    range is cut into ``buckets`` parts that are ranked apart, so no task sorts a whole epoch.
    """
    ids = items.select(item_id).distinct()
    rows = ids.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), item_id)
    if mix is None:
        key = F.pmod(F.xxhash64(F.lit(seed), F.col("epoch"), F.col(item_id)), F.lit(mix_range))
    else:
        key = mix(F.col(item_id), F.col("epoch"))
    rows = rows.withColumn("_key", key.cast("bigint")).withColumn(
        "_bucket", F.floor(F.col("_key") * F.lit(buckets) / F.lit(mix_range)).cast("int")
    )
    placed = spread_positions(rows, "epoch", ["_key", item_id], "_bucket")
    return placed.select(
        "epoch",
        F.floor(F.col("position") / F.lit(batch_size)).cast("bigint").alias("batch"),
        (F.col("position") % F.lit(batch_size)).cast("int").alias("position"),
        item_id,
    )


def reconcile_details(
    predictions: DataFrame, labels: DataFrame, paper_id: str = "paper_id", decimals: int = 3
) -> DataFrame:
    """Per paper, material and lattice constant: how many rows are predicted, labelled and matched.

    Lattice constants agree when they are equal at ``decimals``, the precision they are
    reported with. Both tables are counted together, so copies of one record add up before
    the shuffle and no pairs are formed.
    """
    keys = [F.col(paper_id), F.col("name"), F.rint(F.col("lattice_constant") * F.lit(10.0**decimals)).cast("bigint").alias("lattice_key")]
    sides = predictions.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("l")).unionAll(
        labels.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("l"))
    )
    return (
        sides.groupBy(paper_id, "name", "lattice_key")
        .agg(F.sum("p").alias("n_pred"), F.sum("l").alias("n_label"))
        .withColumn("n_match", F.least("n_pred", "n_label"))
    )


def label_reconcile(
    predictions: DataFrame, labels: DataFrame, paper_id: str = "paper_id", decimals: int = 3
) -> DataFrame:
    """Per paper: does the number of materials and do the lattice constants agree with the labels?"""
    return _agreement(reconcile_details(predictions, labels, paper_id, decimals), paper_id)


def _agreement(details: DataFrame, paper_id: str) -> DataFrame:
    return (
        details.groupBy(paper_id)
        .agg(
            F.sum("n_pred").alias("n_pred"),
            F.sum("n_label").alias("n_label"),
            F.sum("n_match").alias("n_match"),
        )
        .withColumn("n_missed", F.col("n_label") - F.col("n_match"))
        .withColumn("n_extra", F.col("n_pred") - F.col("n_match"))
        .withColumn("same_count", F.col("n_pred") == F.col("n_label"))
        .withColumn("same_lattice", (F.col("n_match") == F.col("n_label")) & (F.col("n_match") == F.col("n_pred")))
        .withColumn("verdict", F.when(F.col("same_count") & F.col("same_lattice"), "match").otherwise("no match"))
    )


#: Half a unit of the third decimal, in which lattice constants are reported.
TOLERANCE = 5e-4


def reconcile_chains(predictions: DataFrame, labels: DataFrame, paper_id: str = "paper_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Per paper, material and chain of lattice constants: how many rows are predicted, labelled and matched.

    A predicted and a labelled constant match when they differ by ``tolerance`` at most, and each row is used once; of all such matchings the
    largest counts. Constants farther apart from their neighbours than the tolerance cannot meet, so a material's
    constants are cut there into chains (``low`` to ``high``), and each is matched by one sweep. Copies of a constant are added up before the
    shuffle, and no pairs are formed. Rows without a (finite) constant match one another, as in :func:`reconcile_details`.
    """
    value = F.col("lattice_constant").cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value + F.lit(0.0)).alias("v")
    keys = [F.col(paper_id).alias("paper"), F.col("name"), finite]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = predictions.select(*keys, one.alias("p"), none.alias("l")).unionAll(labels.select(*keys, none.alias("p"), one.alias("l")))
    counted = sides.groupBy("paper", "name", "v").agg(F.sum("p").alias("p"), F.sum("l").alias("l"))
    named = counted.withColumn("_key", F.to_json(F.struct("paper", "name"), {"ignoreNullFields": "false"}))
    chains = chains_within(named.where("v is not null"), "_key", "v", tolerance)
    gathered = chains.groupBy("paper", "name", "chain").agg(
        F.max("v").alias("high"), F.sum("p").alias("n_pred"), F.sum("l").alias("n_label"), F.sort_array(F.collect_list(F.struct("v", "p", "l"))).alias("_entries")
    )
    matched = gathered.select(
        F.col("paper").alias(paper_id), "name", F.col("chain").alias("low"), "high", "n_pred", "n_label", F.expr(matches_within("_entries", tolerance)).alias("n_match")
    )
    bare = counted.where("v is null").select(
        F.col("paper").alias(paper_id), "name", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.col("p").alias("n_pred"), F.col("l").alias("n_label"), F.least("p", "l").alias("n_match"),
    )
    return matched.unionAll(bare)


def label_reconcile_within(predictions: DataFrame, labels: DataFrame, paper_id: str = "paper_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Per paper: does the number of materials and do the lattice constants agree with the labels, up to a tolerance?"""
    return _agreement(reconcile_chains(predictions, labels, paper_id, tolerance), paper_id)
