"""Parsed JSON to typed record rows, and the combined table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docfacts.functions.jsontext import NON_FINITE_KEY, json_kind, strict_json
from docfacts.operators.grouping import with_position
from docfacts.session import written

# The record fields and their order.
TEXT_FIELDS = ["name", "nominal_composition", "measured_composition", "phases", "alloy_condition", "doi"]
FIELDS = [
    "name", "nominal_composition", "measured_composition", "lattice_constant",
    "phases", "alloy_condition", "doi",
]
NOT_FOUND = "Not found"
HIGH_CONFIDENCE = 90


def record_columns(record: Column, placeholder: str | None = None) -> list[Column]:
    """Typed columns of one record; fields of an unexpected type become null."""

    def text(field: str) -> Column:
        value = F.try_variant_get(record, f"$.{field}", "string")
        return F.nullif(value, F.lit(placeholder)) if placeholder is not None else value

    columns = []
    for field in FIELDS:
        if field == "lattice_constant":
            marked = F.try_variant_get(record, f"$.lattice_constant['{NON_FINITE_KEY}']", "double")
            columns.append(F.coalesce(F.try_variant_get(record, "$.lattice_constant", "double"), marked).alias(field))
            columns.append(text(field).alias("lattice_text"))
        else:
            columns.append(text(field).alias(field))
    for field in FIELDS:
        columns.append(F.try_variant_get(record, f"$.confidence_scores.{field}", "int").alias(f"conf_{field}"))
    return columns


def explode_records(parsed: DataFrame, keep: Sequence[str], json: str = "json", accept_object: bool = False) -> DataFrame:
    """One row per array entry: the kept columns, ``pos`` and ``record`` (VARIANT)."""
    entries = F.when(F.expr(f"{json_kind(json)} = 'array'"), F.col(json).try_cast("array<variant>"))
    if accept_object:
        entries = F.when(F.expr(f"{json_kind(json)} = 'object'"), F.array(F.col(json))).otherwise(entries)
    return parsed.select(*keep, F.posexplode(entries).alias("pos", "record"))


def flatten_records(
    parsed: DataFrame,
    doc_id: str = "doc_id",
    json: str = "json",
    accept_object: bool = False,
    placeholder: str | None = None,
) -> DataFrame:
    """Typed rows of all records; ``placeholder`` (such as "Not found") reads as null if given."""
    rows = explode_records(parsed, [doc_id], json, accept_object)
    return rows.select(doc_id, "pos", *record_columns(F.col("record"), placeholder))


def paper_id_of(file_name: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name, r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")


def parse_record_files(files: DataFrame, file_name: str = "file_name", value: str = "value") -> DataFrame:
    """Adds ``json``, ``Paperid`` and ``issue`` (bad_json, not_a_list or null)."""
    issue = f"case when _json is null then 'bad_json' when {json_kind('_json')} <> 'array' then 'not_a_list' end"
    # One row in, one row out: the generator keeps a later filter from repeating the parse.
    return (
        files.select("*", F.inline(F.array(F.struct(F.expr(strict_json(value)).alias("_json")))))
        .withColumns({"json": F.col("_json"), "Paperid": paper_id_of(F.col(file_name)), "issue": F.expr(issue)})
        .drop("_json")
    )


def combine_records(files: DataFrame, file_name: str = "file_name", value: str = "value") -> DataFrame:
    """All records of all list files in one table.

    In no order; :func:`sorted_records` numbers the rows, :func:`docfacts.sources.sinks.write_combined` writes them sorted.
    """
    rows = explode_records(parse_record_files(files, file_name, value), ["Paperid"])
    return rows.select("Paperid", "pos", *record_columns(F.col("record")))


def sorted_records(files: DataFrame, file_name: str = "file_name", value: str = "value") -> DataFrame:
    """The combined table with ``position``, the place by ``Paperid`` and place in the file. Each file is parsed once."""
    return with_position(combine_records(files, file_name, value), ["Paperid", "pos"])


def file_issues(files: DataFrame, file_name: str = "file_name", value: str = "value") -> DataFrame:
    """Files left out of the combined table, with reason and whole content."""
    return (
        parse_record_files(files, file_name, value)
        .where(F.col("issue").isNotNull())
        .select(file_name, F.col("issue").alias("reason"), F.col(value).alias("raw"))
    )


def combine_all_keys(files: DataFrame, file_name: str = "file_name", value: str = "value") -> DataFrame:
    """The combined table with every key that any record has, in long form: ``Paperid, pos, key, value``.

    One row for each key of each record, so there is no limit to the keys and nothing to look up
    first. Values are text (nested ones JSON text), null where the record has null.
    """
    rows = explode_records(parse_record_files(files, file_name, value), ["Paperid"])
    fields = F.explode(F.col("record").try_cast("map<string,variant>")).alias("key", "_value")
    return rows.select("Paperid", "pos", fields).select("Paperid", "pos", "key", F.try_variant_get("_value", "$", "string").alias("value"))


def record_keys(files: DataFrame, file_name: str = "file_name", value: str = "value") -> DataFrame:
    """The distinct keys used in any record."""
    return combine_all_keys(files, file_name, value).select("key").distinct()


def combine_with_keys(
    files: DataFrame, keys: Sequence[str], file_name: str = "file_name", value: str = "value"
) -> DataFrame:
    """Combined table with one text column per given key, gaps null (nested values as JSON text)."""
    rows = explode_records(parse_record_files(files, file_name, value), ["Paperid"])
    fields = F.col("record").try_cast("map<string,variant>")
    columns = [
        F.try_variant_get(F.try_element_at(F.col("_fields"), F.lit(k)), "$", "string").alias(k) for k in keys
    ]
    return rows.withColumn("_fields", fields).select("Paperid", "pos", *columns)


#: What a value's type widens to: the first of these that holds all types of a key.
_WIDENED = [({"bigint"}, "bigint"), ({"bigint", "double"}, "double"), ({"boolean"}, "boolean")]


def merged_schema(records: DataFrame, record: str = "record") -> list[tuple[str, str]]:
    """Every key of any record with the type that holds all its values, in order of first appearance: one pass, one row a key.

    Whole numbers widen to numbers; texts, nested values (as JSON text) and keys whose types do not fit together are text; a key
    that is null everywhere is text too. ``records`` has ``Paperid`` and ``pos``.
    """
    fields = records.select("Paperid", "pos", F.explode(F.col(record).try_cast("map<string,variant>")).alias("key", "_value"))
    scalar = F.schema_of_variant("_value")
    kind = (
        F.when(scalar == "BIGINT", "bigint")
        .when(scalar.startswith("DECIMAL") | scalar.isin("DOUBLE", "FLOAT"), "double")
        .when(scalar == "BOOLEAN", "boolean")
        .when(scalar != "VOID", "string")
    )
    keys = fields.groupBy("key").agg(F.collect_set(kind).alias("kinds"), F.min(F.struct("Paperid", "pos")).alias("first"))
    rows = sorted(keys.collect(), key=lambda r: ((r["first"]["Paperid"] or "", r["first"]["pos"]), r["key"]))  # the columns of the result
    return [(r["key"], next((wide for held, wide in _WIDENED if r["kinds"] and set(r["kinds"]) <= held), "string")) for r in rows]


def _path_of(key: str) -> str | None:
    """A path to a key inside a variant; null for a key that no path can name."""
    quote = next((q for q in "\"'" if q not in key), None)
    return f"$[{quote}{key}{quote}]" if quote and "\\" not in key and key else None


def _column_names(keys: Sequence[str], taken: Sequence[str]) -> list[str]:
    """Names that differ in more than case: a key that repeats one gets a number."""
    used, names = {t.lower() for t in taken}, []
    for key in keys:
        name, n = key, 2
        while name.lower() in used:
            name, n = f"{key}_{n}", n + 1
        used.add(name.lower())
        names.append(name)
    return names


def combine_wide(files: DataFrame, file_name: str = "file_name", value: str = "value") -> DataFrame:
    """The combined table with a typed column for every key that any record has: ``Paperid, pos`` and the union of all keys.

    Each file is parsed once; the records go to a table in the shared folder, from which one pass merges the schema and one projection reads the
    columns. Gaps are null. A key that differs from another only in case, or from ``Paperid`` and ``pos``, gets a number after it.
    """
    rows = written(explode_records(parse_record_files(files, file_name, value), ["Paperid"]), "records")
    schema = merged_schema(rows)
    names = _column_names([key for key, _ in schema], ["Paperid", "pos"])
    lookup = F.col("record").try_cast("map<string,variant>")

    def column(key: str, kind: str) -> Column:
        path = _path_of(key)
        if path is not None:
            return F.try_variant_get("record", path, kind)
        return F.try_variant_get(F.try_element_at(lookup, F.lit(key)), "$", kind)

    return rows.select("Paperid", "pos", *[column(key, kind).alias(name) for (key, kind), name in zip(schema, names)])


def confidence_profile(records: DataFrame, threshold: int = HIGH_CONFIDENCE) -> DataFrame:
    """Per field: records, scored records, high-confidence records and their share."""
    counts = [F.count(F.lit(1)).alias("n")]
    for f in FIELDS:
        counts.append(F.count(f"conf_{f}").alias(f"s_{f}"))
        counts.append(F.count_if(F.col(f"conf_{f}") >= threshold).alias(f"h_{f}"))
    per_field = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"s_{f}").alias("n_scored"), F.col(f"h_{f}").alias("n_high"))
          for f in FIELDS]
    )
    return (
        records.agg(*counts)
        .select("n", F.inline(per_field))
        .select(
            "field", F.col("n").alias("n_records"), "n_scored", "n_high",
            F.try_divide(F.col("n_high"), F.col("n")).alias("high_share"),
        )
    )
