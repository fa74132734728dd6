"""Finding and parsing JSON inside free text."""

from __future__ import annotations

from docfacts.functions.sql import each, fresh, let, literal
from docfacts.functions.text import SPACE, strip

# What counts as a fenced block.
FENCE_OPEN = "```json"
FENCE_CLOSE = "```"
JSON_FENCE = r"(?is)```json\s*(.*?)```"
OTHER_FENCE = r"(?s)```(?!json)(?:[a-zA-Z0-9_+-]*)\s*(.*?)```"

# Repairs of almost-JSON in order, pattern and replacement.
_WS = rf"[{SPACE}]*"
REPAIRS = [
    (rf",({_WS}[}}\]])", "$1"),
    (rf"([{{\[,]){_WS}'([^'\\]*?)'{_WS}:", '$1 "$2":'),
    (rf":{_WS}'([^'\\]*?)'({_WS}[,}}\]])", ': "$1"$2'),
]

NO_TEXTS = "cast(array() as array<string>)"


# The number words that JSON lacks but some writers use; a minus sign only before Infinity.
NON_FINITE = r"(?<![A-Za-z0-9_.$+-])(NaN|-?Infinity)(?![A-Za-z0-9_.$])"
NON_FINITE_KEY = "$numberDouble"


def marked_non_finite(text: str) -> str:
    """``NaN``, ``Infinity`` and ``-Infinity`` as values become objects like ``{"$numberDouble": "NaN"}``; inside of strings nothing changes.

    The text is cut into strings and what lies between them, so a string that holds these words is kept apart from the number.
    """
    pieces = literal(r'''"(?:[^"\\]|\\.)*+"?|[^"]++''')
    marked = literal('{"' + NON_FINITE_KEY.replace("$", "\\$") + '":"$1"}')

    def rewrite(t: str) -> str:
        each_piece = each(
            f"regexp_extract_all({t}, {pieces}, 0)", lambda p: f"if(startswith({p}, '\"'), {p}, regexp_replace({p}, {literal(NON_FINITE)}, {marked}))"
        )
        return f"if(contains({t}, 'NaN') or contains({t}, 'Infinity'), array_join({each_piece}, ''), {t})"

    return let(text, rewrite)


def strict_json(text: str, non_finite: bool = False) -> str:
    """VARIANT of a text that is one JSON value and nothing else, otherwise null.

    With ``non_finite`` the numbers ``NaN`` and ``Infinity`` are taken, see :func:`marked_non_finite`.

    ``try_parse_json`` accepts text after the value, so the text is parsed as the first of exactly
    two array entries. The second is the text's own digest, which no text holds.
    """

    def whole(t: str) -> str:
        def probe(mark: str) -> str:
            parsed = f"try_cast(try_parse_json(concat('[', {t}, ',\"', {mark}, '\"]')) as array<variant>)"
            return let(
                parsed,
                lambda a: f"if(size({a}) = 2 and try_variant_get(get({a}, 1), '$', 'string') = {mark}, get({a}, 0), null)",
            )

        return let(f"md5(cast({t} as binary))", probe)

    return let(marked_non_finite(text) if non_finite else text, whole)


def json_kind(value: str) -> str:
    """``array``, ``object``, ``string``, ``number``, ``boolean`` or ``null``.

    Arrays and objects are told by casts; only scalars have their schema looked up, which is short.
    """
    scalar = let(
        f"schema_of_variant({value})",
        lambda s: f"case when {s} = 'STRING' then 'string' when {s} = 'BOOLEAN' then 'boolean' when {s} = 'VOID' then 'null'"
        f" when {s} is not null then 'number' end",
    )
    return (
        f"case when try_cast({value} as array<variant>) is not null then 'array'"
        f" when try_cast({value} as map<string,variant>) is not null then 'object' else {scalar} end"
    )


def json_size(value: str) -> str:
    """Number of array entries or object keys; null for scalars."""
    return (
        f"coalesce(nullif(size(try_cast({value} as array<variant>)), -1),"
        f" nullif(size(map_keys(try_cast({value} as map<string,variant>))), -1))"
    )


def first_between(text: str, opener: str, closer: str, keep: bool) -> str:
    """Shortest text from the first ``opener`` to the next ``closer``; null if there is none."""
    skip = len(opener)
    o, c = literal(opener), literal(closer)

    def cut(start: str) -> str:
        end = f"locate({c}, {text}, {start} + {skip})"
        inner = f"substr({text}, {start} + {skip}, {end} - {start} - {skip})"
        return f"if({start} > 0 and {end} > 0, {f'concat({o}, {inner}, {c})' if keep else inner}, null)"

    return let(f"locate({o}, {text})", cut)


def balanced_chunks(text: str, opener: str, closer: str, max_items: int | None = None) -> str:
    """The balanced chunks of one bracket type in order, at most ``max_items`` if given.

    The text is cut into runs and single marks, and one fold follows them: outside of a chunk only an opener
    counts; inside, brackets in quotes do not, and a backslash in quotes covers the character after it. A
    chunk that stays open ends the search.
    """
    o, c = literal(opener), literal(closer)
    marks = rf"""\\"'\{opener}\{closer}"""
    pieces = literal(rf"""[{marks}]|[^{marks}]++""")
    a, t, r = fresh(), fresh(), fresh()
    start = (
        "named_struct('at', 0, 'depth', 0, 'quote', '', 'covered', false, 'start', 0,"
        " 'found', cast(array() as array<struct<start:int,length:int>>))"
    )

    def state(depth: str = f"{a}.depth", quote: str = f"{a}.quote", covered: str = "false", begin: str = f"{a}.start", found: str = f"{a}.found") -> str:
        return (
            f"named_struct('at', {a}.at + length({t}), 'depth', {depth}, 'quote', {quote}, 'covered', {covered},"
            f" 'start', {begin}, 'found', {found})"
        )

    closed = f"array_append({a}.found, named_struct('start', {a}.start, 'length', {a}.at + 1 - {a}.start))"
    step = (
        f"case when {a}.depth = 0 then if({t} = {o}, {state(depth='1', begin=f'{a}.at')}, {state()})"
        f" when {a}.covered then {state()}"
        f" when {a}.quote <> '' then {state(quote=f'if({t} = {a}.quote, {literal(str())}, {a}.quote)', covered=f'{t} = {literal(chr(92))}')}"
        f" when {t} in ('\"', {literal(chr(39))}) then {state(quote=t)}"
        f" when {t} = {o} then {state(depth=f'{a}.depth + 1')}"
        f" when {t} = {c} and {a}.depth = 1 then {state(depth='0', found=closed)}"
        f" when {t} = {c} then {state(depth=f'{a}.depth - 1')} else {state()} end"
    )

    def spans(v: str) -> str:
        return f"aggregate(regexp_extract_all({v}, {pieces}, 0), {start}, ({a}, {t}) -> {step}, {r} -> {r}.found)"

    def cut(v: str) -> str:
        some = spans(v) if max_items is None else f"slice({spans(v)}, 1, {max_items})"
        chunks = each(some, lambda s: f"substr({v}, {s}.start + 1, {s}.length)")
        return f"if(contains({v}, {o}) and contains({v}, {c}), {chunks}, {NO_TEXTS})"

    return let(text, cut)


def fenced_candidates(text: str) -> str:
    """Contents of json fences in any case, then of other fences."""
    found = (
        f"concat(regexp_extract_all({text}, {literal(JSON_FENCE)}, 1),"
        f" regexp_extract_all({text}, {literal(OTHER_FENCE)}, 1))"
    )
    return f"if(contains({text}, {literal(FENCE_CLOSE)}), {each(found, strip)}, {NO_TEXTS})"


def bracket_candidates(text: str, max_items: int | None = None) -> str:
    """Balanced arrays, then balanced objects; ``max_items`` limits each of the two."""
    return f"concat({balanced_chunks(text, '[', ']', max_items)}, {balanced_chunks(text, '{', '}', max_items)})"


def light_fix(text: str) -> str:
    """Drop trailing commas, then turn single-quoted keys and values into double-quoted ones."""
    for pattern, replacement in REPAIRS:
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(replacement)})"
    return text
