"""Strict reading of compositions: everything in a text is understood, or it is reported and nothing is read.

The usual reading (:mod:`docfacts.functions.composition`) takes what looks like a composition and passes over the rest. Here a text is cut
into tokens (element, number, unit, sign, other) and one fold follows them, so a unit may stand apart from its number, and words, unknown
symbols, negative amounts, brackets and units without a number are named as problems.
"""

from __future__ import annotations

from docfacts.functions.composition import _sum_by_key, clean_text
from docfacts.functions.sql import each, fresh, let, literal

# The symbols of the chemical elements, by atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn "
    "Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk "
    "Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

UNIT = r"(?<![A-Za-z])(?i:at|wt|mol)[.]? ?%"
NUMBER = r"(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"
SYMBOL = r"[A-Z][a-z]?(?![a-z])"
TOKEN = rf"{UNIT}|-(?=[.0-9]){NUMBER}|{NUMBER}|{SYMBOL}|\p{{L}}+|[^\s]"
RATIO = rf"\A{SYMBOL}(?: ?: ?{SYMBOL})+ ?= ?{NUMBER}(?: ?: ?{NUMBER})+\z"

#: Tokens followed before their lists are put aside.
_CHUNK = 256
_TEXTS = "cast(array() as array<string>)"
_NONE = "cast(null as string)"
_RESULT = "struct<amounts:map<string,double>,unit:string,problems:array<string>>"


def _kind(token: str) -> str:
    """``unit``, ``number``, ``element``, the sign itself, or ``other``."""
    return (
        f"case when {token} in ('=', ':', '%') then {token} when {token} in ('-', '/', '+') then 'gap'"
        f" when array_contains(array({', '.join(literal(s) for s in SYMBOLS)}), {token}) then 'element'"
        f" when rlike({token}, {literal(rf'\A{NUMBER}\z')}) then 'number' when rlike({token}, {literal(rf'\A{UNIT}\z')}) then 'unit' else 'other' end"
    )


def _read(tokens: str, text: str) -> str:
    """The fold over ``struct<t, kind>`` tokens. An element waits for its number; a unit, or a bare percent sign, must follow a number."""
    a, x, r = fresh(), fresh(), fresh()
    fields = ["waiting", "equal", "before", "ks", "vs", "bare", "unit", "problems"]

    def state(**new: str) -> str:
        return "named_struct(" + ", ".join(f"'{f}', {new.get(f, f'{a}.{f}')}" for f in fields) + ")"

    def report(token: str = f"{x}.t", **new: str) -> str:
        return state(problems=f"array_append({a}.problems, {token})", before="'other'", **new)

    # An element without a number counts once, unless an equals sign promised one.
    settled = {
        "ks": f"if({a}.waiting is null, {a}.ks, array_append({a}.ks, {a}.waiting))",
        "vs": f"if({a}.waiting is null, {a}.vs, array_append({a}.vs, 1D))",
        "bare": f"if({a}.waiting is null, {a}.bare, array_append({a}.bare, {a}.waiting))",
        "problems": f"if({a}.equal, array_append({a}.problems, concat({a}.waiting, '=')), {a}.problems)",
    }
    read_unit = f"if(rlike({x}.t, '(?i)wt'), 'wt', 'at')"
    step = (
        f"case {x}.kind"
        f" when 'element' then {state(**settled, waiting=f'{x}.t', equal='false', before=literal('element'))}"
        f" when 'number' then if({a}.waiting is null, {report()}, "
        + state(waiting=_NONE, equal="false", before="'number'", ks=f"array_append({a}.ks, {a}.waiting)", vs=f"array_append({a}.vs, try_cast({x}.t as double))")
        + ")"
        f" when 'unit' then if({a}.before <> 'number' or {a}.unit <> {read_unit}, {report()}, {state(unit=read_unit, before=literal('unit'))})"
        f" when '%' then if({a}.before = 'number', {state(before=literal('unit'))}, {report()})"
        f" when 'gap' then if({a}.equal, {report()}, {state(before=literal('gap'))})"
        f" when 'other' then {report()}"
        f" else if({a}.waiting is null or {a}.equal, {report()}, {state(equal='true', before=literal('='))}) end"
    )
    start = (
        f"named_struct('waiting', {_NONE}, 'equal', false, 'before', '', 'ks', {_TEXTS}, 'vs', cast(array() as array<double>),"
        f" 'bare', {_TEXTS}, 'unit', {_NONE}, 'problems', {_TEXTS})"
    )

    def finish(s: str) -> str:
        # With a unit every element needs a number of its own; signs without any element are a problem as a whole.
        nothing = f"if(size({s}.ks) = 0 and size({s}.problems) = 0, array({text}), {_TEXTS})"
        problems = f"concat({s}.problems, if({s}.unit is not null, {s}.bare, {nothing}))"

        def build(p: str) -> str:
            amounts = f"if(size({p}) = 0, {_sum_by_key(f'{s}.ks', f'{s}.vs')}, null)"
            return f"cast(named_struct('amounts', {amounts}, 'unit', if(size({p}) = 0, {s}.unit, null), 'problems', {p}) as {_RESULT})"

        return let(problems, build)

    # Lists grow by copying, so they are kept for one chunk of tokens at a time; long texts stay linear.
    lists = ["ks", "vs", "bare", "problems"]
    o, c, i, q = fresh(), fresh(), fresh(), fresh()

    def after_chunk(f: str) -> str:
        kept = "named_struct(" + ", ".join(f"'{name}', {f}.{name}" for name in lists) + ")"
        onward = "named_struct(" + ", ".join(f"'{name}', {f'{o}.s.{name}' if name in lists else f'{f}.{name}'}" for name in fields) + ")"
        return f"named_struct('s', {onward}, 'parts', array_append({o}.parts, {kept}))"

    def whole(f: str) -> str:
        gathered = {name: f"flatten(transform({f}.parts, {q} -> {q}.{name}))" for name in lists}
        return "named_struct(" + ", ".join(f"'{name}', {gathered.get(name, f'{f}.s.{name}')}" for name in fields) + ")"

    kinds = "struct<ks:array<string>,vs:array<double>,bare:array<string>,problems:array<string>>"
    inner = f"aggregate({c}, {o}.s, ({a}, {x}) -> {step}, {r} -> {r})"

    def chunked(t: str) -> str:
        chunks = f"transform(sequence(0, (size({t}) - 1) div {_CHUNK}), {i} -> slice({t}, {i} * {_CHUNK} + 1, {_CHUNK}))"
        outer = f"named_struct('s', {start}, 'parts', cast(array() as array<{kinds}>))"
        return f"aggregate({chunks}, {outer}, ({o}, {c}) -> {let(inner, after_chunk)}, {r} -> {r})"

    last = "named_struct(" + ", ".join(f"'{name}', {settled.get(name, f'{a}.{name}')}" for name in fields) + ")"
    folded = let(let(tokens, chunked), whole)
    return let(folded, lambda s: let(last.replace(f"{a}.", f"{s}."), finish))


def _ratio(text: str) -> str:
    """``Al:Nb=1:2``: as many elements as numbers, known and none twice, else the whole text is a problem."""
    left, right = f"substring_index({text}, '=', 1)", f"substring_index({text}, '=', -1)"
    names = f"regexp_extract_all({left}, {literal(SYMBOL)}, 0)"
    numbers = each(f"regexp_extract_all({right}, {literal(NUMBER)}, 0)", lambda n: f"try_cast({n} as double)")

    def build(p: str) -> str:
        known = f"size(array_except({p}.k, array({', '.join(literal(s) for s in SYMBOLS)}))) = 0"
        good = f"size({p}.k) = size({p}.v) and size(array_distinct({p}.k)) = size({p}.k) and {known}"
        return (
            f"cast(if({good}, named_struct('amounts', map_from_arrays({p}.k, {p}.v), 'unit', {_NONE}, 'problems', {_TEXTS}),"
            f" named_struct('amounts', null, 'unit', {_NONE}, 'problems', array({text}))) as {_RESULT})"
        )

    return let(f"named_struct('k', {names}, 'v', {numbers})", build)


def parse_strict(text: str) -> str:
    """``struct<amounts, unit, problems>``; null for a null or blank text.

    ``amounts`` is null when there are problems, so nothing is guessed. Understood are elements with or without numbers (``Al0.5NbTi``), pairs
    with units glued or apart, with ``%`` (``Al 20 at.%``, ``Al=20 wt%``), and ratios (``Al:Nb=1:2``). Without a unit none is assumed.
    """

    def any_form(t: str) -> str:
        tokens = each(f"regexp_extract_all({t}, {literal(TOKEN)}, 0)", lambda k: f"named_struct('t', {k}, 'kind', {_kind(k)})")
        return f"case when {t} is null or length({t}) = 0 then null when rlike({t}, {literal(RATIO)}) then {_ratio(t)} else {_read(tokens, t)} end"

    return let(clean_text(text), any_form)
