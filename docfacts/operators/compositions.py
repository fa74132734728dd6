"""Composition columns: parse, normalise, compare, judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docfacts.functions import composition as C
from docfacts.functions.strict_composition import parse_strict

L1_LIMIT = 0.15
COSINE_LIMIT = 0.95
EPS = 1e-8


def find_column(df: DataFrame, *spellings: str) -> str | None:
    """The column whose lower-cased name is the first matching spelling."""
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[s] for s in spellings if s in by_lower), None)


def parse_and_normalize(
    df: DataFrame, column: str, prefix: str, assume_weight_if_ambiguous: bool = False, strict: bool = False
) -> DataFrame:
    """Adds ``<prefix>_parsed``, ``<prefix>_unit`` and ``<prefix>_fractions``.

    With ``assume_weight_if_ambiguous`` amounts without a unit that add up to about 100 are weight percent. With ``strict`` a text
    that is not understood as a whole gives no composition, and ``<prefix>_problems`` lists what was not understood.
    """
    parse = parse_strict if strict else C.parse_composition
    parsed = df.withColumn("_parsed", F.expr(parse(f"`{column}`")))
    if strict:
        parsed = parsed.withColumn(f"{prefix}_problems", F.col("_parsed.problems"))
    return parsed.withColumns(
        {
            f"{prefix}_parsed": F.col("_parsed.amounts"),
            f"{prefix}_unit": F.col("_parsed.unit"),
            f"{prefix}_fractions": F.expr(
                C.normalize_composition("_parsed.amounts", "_parsed.unit", assume_weight_if_ambiguous)
            ),
        }
    ).drop("_parsed")


def compare_compositions(
    df: DataFrame, l1_limit: float = L1_LIMIT, cosine_limit: float = COSINE_LIMIT
) -> DataFrame:
    """Adds the four distances and ``consistency_check``.

    Expects ``nominal_fractions``, ``name_fractions`` and ``measured_fractions``. A missing
    nominal composition counts as empty. A row fails only if both sides are off.
    """
    compared = df.withColumn("_nominal", F.expr(f"coalesce(nominal_fractions, {C.EMPTY})")).withColumns(
        {
            "_name": F.expr(C.distances("_nominal", "name_fractions")),
            "_meas": F.expr(C.distances("_nominal", "measured_fractions")),
        }
    )

    def off(side: str) -> Column:
        return F.coalesce((F.col(f"{side}.l1") > l1_limit) | (F.col(f"{side}.cosine") < cosine_limit), F.lit(False))

    verdict = (
        F.when(F.col("name_fractions").isNull() & F.col("measured_fractions").isNull(), "unknown")
        .when(off("_name") & off("_meas"), "inconsistent: name,measured")
        .otherwise("OK")
    )
    return compared.withColumns(
        {
            "l1_nom_vs_name": F.col("_name.l1"),
            "l1_nom_vs_measured": F.col("_meas.l1"),
            "cos_nom_vs_name": F.col("_name.cosine"),
            "cos_nom_vs_measured": F.col("_meas.cosine"),
            "consistency_check": verdict,
        }
    ).drop("_nominal", "_name", "_meas")


def check_compositions(
    df: DataFrame,
    l1_limit: float = L1_LIMIT,
    cosine_limit: float = COSINE_LIMIT,
    eps: float = EPS,
    decimals: int = 1,
    as_json: bool = True,
    strict: bool = False,
) -> DataFrame:
    """The whole check: input columns kept, parsed and judged columns appended.

    One narrow stage without a shuffle. The name and measured columns are optional, the
    nominal one is required; names match in any case, with blank or underscore.
    ``as_json=False`` keeps the compositions as maps. ``strict`` reads the nominal and the measured composition as a whole or not at all, and
    appends ``nominal_problems`` and ``measured_problems``.
    """
    nominal = find_column(df, "nominal composition", "nominal_composition")
    if nominal is None:
        raise KeyError("nominal composition")
    name = find_column(df, "name")
    measured = find_column(df, "measured composition", "measured_composition")
    null_text = F.lit(None).cast("string")
    parse = parse_strict if strict else C.parse_composition
    work = df.withColumns(
        {
            "_name_text": F.col(f"`{name}`") if name else null_text,
            "_measured_text": F.col(f"`{measured}`") if measured else null_text,
            "_nominal_text": F.col(f"`{nominal}`"),
        }
    )
    # The two parsed columns and the name are worked on side by side, in few projections.
    work = work.withColumns(
        {
            "_nominal": F.expr(parse("_nominal_text")),
            "_measured": F.expr(parse("_measured_text")),
            "name_fractions": F.expr(C.infer_from_name("_name_text")),
            "_order": F.expr(C.element_order("_name_text")),
        }
    ).withColumns(
        {
            "nominal_fractions": F.expr(C.normalize_composition("_nominal.amounts", "_nominal.unit")),
            "measured_fractions": F.expr(C.normalize_composition("_measured.amounts", "_measured.unit")),
            "_nominal_amounts": F.col("_nominal.amounts"),
            "_measured_amounts": F.col("_measured.amounts"),
            **{f"_{side}_problems": F.col(f"_{side}.problems") for side in ("nominal", "measured") if strict},
        }
    )
    problems = [F.col(f"_{side}_problems").alias(f"{side}_problems") for side in ("nominal", "measured") if strict]
    judged = compare_compositions(work, l1_limit, cosine_limit)

    def shown(column: str, name: str) -> Column:
        return F.expr(C.sorted_json(column) if as_json else column).alias(name)

    return judged.select(
        *[F.col(f"`{c}`") for c in df.columns],
        shown("_nominal_amounts", "nominal_parsed"),
        shown("nominal_fractions", "nominal_molar_fractions"),
        shown("name_fractions", "name_inferred_equal_molar"),
        shown("_measured_amounts", "measured_parsed"),
        shown("measured_fractions", "measured_molar_fractions"),
        "l1_nom_vs_name",
        "l1_nom_vs_measured",
        "cos_nom_vs_name",
        "cos_nom_vs_measured",
        "consistency_check",
        F.expr(C.name_without_zero("_name_text", "nominal_fractions", "_order", eps)).alias("name_without_zero"),
        F.expr(C.ratio_string("nominal_fractions", "_order", eps, decimals)).alias("cleanned composition"),
        *problems,
    )


def consistency_summary(checked: DataFrame) -> DataFrame:
    """How many rows are OK, inconsistent and unknown."""
    check = F.col("consistency_check")
    return checked.agg(
        F.count_if(check == "OK").alias("n_ok"),
        F.count_if(F.startswith(check, F.lit("inconsistent"))).alias("n_inconsistent"),
        F.count_if(check == "unknown").alias("n_unknown"),
    )
