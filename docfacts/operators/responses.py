"""Model answers to JSON values, with a status for what does not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docfacts.functions.jsontext import (
    FENCE_CLOSE,
    FENCE_OPEN,
    bracket_candidates,
    fenced_candidates,
    first_between,
    json_kind,
    light_fix,
    strict_json,
)
from docfacts.functions.sql import fresh, let
from docfacts.functions.text import strip


def parse_v1(responses: DataFrame, text: str = "response") -> DataFrame:
    """First pattern that matches decides: json fence, then ``[..]``, then ``{..}``.

    Adds ``status`` (ok, dropped_not_list, invalid, raw), ``branch`` and ``json`` (VARIANT, only if ok).
    """
    branches = {
        "fence": first_between(text, FENCE_OPEN, FENCE_CLOSE, keep=False),
        "list": first_between(text, "[", "]", keep=True),
        "object": first_between(text, "{", "}", keep=True),
    }
    tried = [
        let(chunk, lambda c: f"if({c} is not null, named_struct('branch', '{branch}', 'chunk', {c}), null)")
        for branch, chunk in branches.items()
    ]
    status = (
        "case when branch is null then 'raw' when _json is null then 'invalid'"
        f" when branch = 'object' or {json_kind('_json')} = 'array' then 'ok' else 'dropped_not_list' end"
    )
    return (
        responses.withColumn("_found", F.expr(f"coalesce({', '.join(tried)})"))
        .withColumns({"branch": F.col("_found.branch"), "_json": F.expr(strict_json(strip("_found.chunk")))})
        .withColumn("status", F.expr(status))
        .withColumn("json", F.expr("if(status = 'ok', _json, null)"))
        .drop("_found", "_json")
    )


def _candidates(text: str, max_items: int | None) -> str:
    found = f"concat({fenced_candidates(text)}, {bracket_candidates(text, max_items)})"
    return f"if({text} is null, array(), {found})"


def json_candidates(responses: DataFrame, text: str = "response", max_items: int | None = None) -> DataFrame:
    """Adds ``candidates``: fenced blocks, other blocks, balanced arrays, balanced objects.

    ``max_items`` limits the balanced chunks of each bracket type; by default all are taken.
    """
    return responses.withColumn("candidates", F.expr(_candidates(text, max_items)))


def candidate_rows(
    responses: DataFrame, doc_id: str = "doc_id", text: str = "response", max_items: int | None = None
) -> DataFrame:
    """One row per candidate with its number from 1."""
    # The outer form adds no filter that would search every text a second time.
    found = F.posexplode_outer(F.expr(_candidates(text, max_items))).alias("_pos", "candidate")
    return (
        responses.select(doc_id, found)
        .where(F.col("_pos").isNotNull())
        .select(doc_id, (F.col("_pos") + 1).alias("candidate_no"), "candidate")
    )


def _first_success(candidates: str, tried_before: str, non_finite: bool = False) -> str:
    """The first candidate that parses, strict or else repaired, with its number; null if none does.

    A fold: once something is found, later candidates are not looked at.
    """
    hit = "struct<candidate_no:int,repaired:boolean,json:variant>"
    a, x, c, i = fresh(), fresh(), fresh(), fresh()

    def outcome(value: str, repaired: str) -> str:
        return f"cast(named_struct('candidate_no', {x}.i + 1 + {tried_before}, 'repaired', {repaired}, 'json', {value}) as {hit})"

    def strict_or_fixed(v: str) -> str:
        fixed = let(strict_json(light_fix(f"{x}.c"), non_finite), lambda w: f"if({w} is not null, {outcome(w, 'true')}, null)")
        return f"if({v} is not null, {outcome(v, 'false')}, {fixed})"

    numbered = f"transform({candidates}, ({c}, {i}) -> named_struct('c', {c}, 'i', {i}))"
    attempt = let(strict_json(f"{x}.c", non_finite), strict_or_fixed)
    return f"aggregate({numbered}, cast(null as {hit}), ({a}, {x}) -> if({a} is not null, {a}, {attempt}))"


def parse_v2(responses: DataFrame, text: str = "response", max_items: int | None = None, non_finite: bool = False) -> DataFrame:
    """First candidate that parses, as it is or after a light repair, wins.

    Adds ``status`` (ok, raw), ``candidate_no``, ``repaired`` and ``json`` (VARIANT). The bracket
    scan runs only for answers whose fenced blocks gave nothing. With ``non_finite`` bare ``NaN`` and ``Infinity`` are taken as
    numbers; they appear as objects like ``{"$numberDouble": "NaN"}``, which typed columns read as doubles.
    """

    def then_scan(hit: str) -> str:
        scanned = let(bracket_candidates(text, max_items), lambda c: _first_success(c, "size(_fenced)", non_finite))
        return f"if({hit} is not null or {text} is null, {hit}, {scanned})"

    found = let(_first_success("_fenced", "0", non_finite), then_scan)
    # One row in, one row out: the generator keeps a later filter from repeating the parse.
    return (
        responses.withColumn("_fenced", F.expr(fenced_candidates(text)))
        .select("*", F.inline(F.array(F.struct(F.expr(found).alias("_hit")))))
        .withColumns(
            {
                "status": F.expr("if(_hit is not null, 'ok', 'raw')"),
                "candidate_no": F.col("_hit.candidate_no"),
                "repaired": F.col("_hit.repaired"),
                "json": F.col("_hit.json"),
            }
        )
        .drop("_fenced", "_hit")
    )


def quarantine(parsed: DataFrame, doc_id: str = "doc_id", text: str = "response") -> DataFrame:
    """Rows whose answer gave no JSON, with the whole raw text and the reason."""
    return parsed.where(F.col("status") != "ok").select(
        F.col(doc_id), F.col("status").alias("reason"), F.col(text).alias("raw")
    )
