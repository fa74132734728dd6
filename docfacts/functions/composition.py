"""Chemical compositions as ``map<string, double>`` of element to amount."""

from __future__ import annotations

from docfacts.functions.numbers import compensated_sum, double_text, fixed_decimals
from docfacts.functions.sql import each, each_value, fresh, let, literal, only
from docfacts.functions.text import SPACE, strip

# Standard atomic weights in g/mol of the elements that weight percent is converted for.
ATOMIC_WEIGHTS = {
    "H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06,
    "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867, "V": 50.942,
    "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546,
    "Zn": 65.38, "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Y": 88.906,
    "Zr": 91.224, "Nb": 92.906, "Mo": 95.95, "Ru": 101.07, "Rh": 102.91, "Pd": 106.42,
    "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71, "Sb": 121.76, "Te": 127.60,
    "La": 138.91, "Ce": 140.12, "Hf": 178.49, "Ta": 180.95, "W": 183.84, "Re": 186.21,
    "Os": 190.23, "Ir": 192.22, "Pt": 195.08, "Au": 196.97, "Hg": 200.59, "Pb": 207.2,
}

# Element symbol, amount as written in a formula, and amounts in lists.
ELEMENT = r"[A-Z][a-z]?"
FORMULA_TERM = r"([A-Z][a-z]?)(-?\d*\.?\d*(?:e[+-]?\d+)?)"
RATIO_NUMBER = r"-?\d*\.?\d+(?:e[+-]?\d+)?"
# "El 20at%" or "El = 20at%" as whole blank-separated words.
PAIR = r"(?<![^ ])([A-Z][a-z]?) (?:= )?(-?\d*\.?\d+(?:[eE][+-]?\d+)?)([a-zA-Z%]*+)(?![^ ])"

WEIGHTS = "map(" + ", ".join(f"'{element}', {weight}D" for element, weight in ATOMIC_WEIGHTS.items()) + ")"
EMPTY = "cast(map() as map<string,double>)"
NO_ORDER = "cast(array() as array<string>)"


def clean_text(text: str) -> str:
    """Separators to blanks, full-width signs and long dashes to ASCII, blanks collapsed."""
    ascii_signs = f"translate({text}, ',;|＝：–—', '   =:--')"
    cleaned = strip(f"regexp_replace({ascii_signs}, {literal(f'[{SPACE}]+')}, ' ')")
    # Most compositions are plain formulas with nothing to clean.
    return f"if(rlike({text}, {literal(r'\A[A-Za-z0-9.]*+\z')}), {text}, {cleaned})"


def _find_all(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({text}, {literal(pattern)}, {group})"


def _numbers(texts: str) -> str:
    return each(texts, lambda n: f"try_cast({n} as double)")


def _numbers_or_one(texts: str) -> str:
    # A failed cast costs an exception inside Spark, and most amounts left out are empty texts.
    return each(texts, lambda n: f"if({n} = '', 1D, coalesce(try_cast({n} as double), 1D))")


def _sum_by_key(keys: str, values: str) -> str:
    """Map of key to summed value; repeats are merged only if there are any.

    Sorted by key and position, equal keys lie together and add up in the order written, in
    one pass. That holds for long texts, too.
    """
    k, i, a, p, r = fresh(), fresh(), fresh(), fresh(), fresh()
    entries = f"sort_array(transform({keys}, ({k}, {i}) -> named_struct('k', {k}, 'i', {i}, 'v', {values}[{i}])))"
    start = f"named_struct('ks', {NO_ORDER}, 'vs', cast(array() as array<double>), 'k', cast(null as string), 's', 0D)"
    same = f"named_struct('ks', {a}.ks, 'vs', {a}.vs, 'k', {a}.k, 's', {a}.s + {p}.v)"
    done = f"concat({{0}}.ks, array({{0}}.k)), 'vs', concat({{0}}.vs, array({{0}}.s))"
    following = f"named_struct('ks', {done.format(a)}, 'k', {p}.k, 's', 0D + {p}.v)"
    first = f"named_struct('ks', {a}.ks, 'vs', {a}.vs, 'k', {p}.k, 's', 0D + {p}.v)"
    merged = (
        f"aggregate({entries}, {start},"
        f" ({a}, {p}) -> case when {a}.k is null then {first} when {a}.k = {p}.k then {same} else {following} end,"
        f" {r} -> map_from_arrays(concat({r}.ks, array({r}.k)), concat({r}.vs, array({r}.s))))"
    )
    return f"if(size(array_distinct({keys})) = size({keys}), map_from_arrays({keys}, {values}), {merged})"


def parse_formula(text: str) -> str:
    """``Al0.25NbTi`` to a map; a missing or unreadable amount is 1, repeats are summed."""

    def amounts(t: str) -> str:
        found = (
            f"named_struct('k', {_find_all(t, FORMULA_TERM, 1)},"
            f" 'v', {_numbers_or_one(_find_all(t, FORMULA_TERM, 2))})"
        )
        return let(found, lambda p: f"if(size({p}.k) > 0, {_sum_by_key(f'{p}.k', f'{p}.v')}, null)")

    return let(f"translate({text}, '%', ' ')", amounts)


def parse_ratio_form(text: str) -> str:
    """``Al:Nb:Ti=1:1:2`` to a map; null unless both sides have the same number of entries."""

    def last_wins(p: str) -> str:
        def last_value(key: str) -> str:
            return f"{p}.v[size({p}.k) - cast(array_position(reverse({p}.k), {key}) as int)]"

        return let(
            f"array_distinct({p}.k)",
            lambda distinct: f"if(size({distinct}) = size({p}.k), map_from_arrays({p}.k, {p}.v),"
            f" map_from_arrays({distinct}, {each(distinct, last_value)}))",
        )

    left = clean_text(f"substring_index({text}, '=', 1)")
    right = clean_text(f"substr({text}, instr({text}, '=') + 1)")
    found = f"named_struct('k', {_find_all(left, ELEMENT, 0)}, 'v', {_numbers(_find_all(right, RATIO_NUMBER, 0))})"
    parts = let(found, lambda p: f"if(size({p}.k) > 0 and size({p}.k) = size({p}.v), {last_wins(p)}, null)")
    return f"if(contains({text}, '='), {parts}, null)"


def parse_pairs(text: str) -> str:
    """``Al 20at.% Nb 80at.%`` to ``struct<amounts, unit>``; null if there is no pair.

    The unit counts only when glued to the number; the first unit seen holds for the row.
    """
    glued = f"regexp_replace({text}, {literal('(at|wt)[.] ?%')}, '$1%')"
    words = f"regexp_replace({glued}, {literal(f'[,{SPACE}]+')}, ' ')"

    def build(p: str) -> str:
        stated = only(f"{p}.u", lambda u: f"contains({u}, 'wt') or contains({u}, 'at')")
        unit = let(
            f"get({stated}, 0)",
            lambda first: f"case when contains({first}, 'wt') then 'wt' when {first} is not null then 'at' end",
        )
        amounts = _sum_by_key(f"{p}.k", f"{p}.v")
        return f"if(size({p}.k) > 0, named_struct('amounts', {amounts}, 'unit', {unit}), null)"

    def find(w: str) -> str:
        units = each(_find_all(w, PAIR, 3), lambda u: f"lower({u})")
        found = f"named_struct('k', {_find_all(w, PAIR, 1)}, 'v', {_numbers(_find_all(w, PAIR, 2))}, 'u', {units})"
        return let(found, build)

    # A pair needs two words, so the search is skipped for texts without any separator.
    return f"if(rlike({text}, {literal(f'[,{SPACE}]')}), {let(words, find)}, null)"


def parse_composition(text: str) -> str:
    """Any spelling to ``struct<amounts, unit>``: ratio form, then pairs, then formula."""

    def with_unit(unit: str):
        return lambda m: f"if({m} is not null, named_struct('amounts', {m}, 'unit', {unit.format(m=m)}), null)"

    # Amounts of a formula that add up to 100 are read as atomic percent.
    is_percent = f"abs({compensated_sum('map_values({m})')} - 100D) < 1e-3D"

    def any_form(t: str) -> str:
        ratio = let(parse_ratio_form(t), with_unit("cast(null as string)"))
        formula = let(parse_formula(t), with_unit(f"if({is_percent}, 'at', null)"))
        return f"if(length({t}) > 0, coalesce({ratio}, {parse_pairs(t)}, {formula}), null)"

    return let(clean_text(text), any_form)


def composition_total(amounts: str) -> str:
    return compensated_sum(f"map_values({amounts})")


def weight_to_mole(amounts: str) -> str:
    """Weight shares divided by atomic weight; an unknown element keeps its value."""
    k, w = fresh(), fresh()
    return f"transform_values({amounts}, ({k}, {w}) -> {w} / coalesce(try_element_at({WEIGHTS}, {k}), 1D))"


def _shares(amounts: str, usable: str) -> str:
    """Values divided by their total where the condition on ``{total}`` holds."""
    return let(
        composition_total(amounts),
        lambda total: f"if({usable.format(total=total)}, {each_value(amounts, lambda v: f'{v} / {total}')}, null)",
    )


def normalize_composition(amounts: str, unit: str, assume_weight_if_ambiguous: bool = False) -> str:
    """Amounts to mole fractions that add up to 1; null where the total does not allow it."""
    by_weight = f"{unit} <=> 'wt'"
    if assume_weight_if_ambiguous:
        by_weight += f" or ({unit} is null and abs({composition_total(amounts)} - 100D) < 1e-1D)"
    usable = f"({{total}} > 0D and not isnan({{total}})) or ({unit} <=> 'at' and {{total}} <> 0D)"
    from_weight = let(weight_to_mole(amounts), lambda moles: _shares(moles, "not ({total} <= 0D)"))
    return f"if({amounts} is null, null, if({by_weight}, {from_weight}, {_shares(amounts, usable)}))"


def infer_from_name(name: str) -> str:
    """Mole fractions read from an alloy name such as ``AlNbTi0.5MoV``."""

    def fractions(m: str) -> str:
        v = fresh()
        # All amounts about 1 count as exactly 1.
        equal = f"forall(map_values({m}), {v} -> abs({v} - 1D) <= 1e-9D)"
        amounts = f"if({equal}, {each_value(m, lambda _: '1D')}, {m})"
        return let(amounts, lambda a: _shares(a, "not ({total} <= 0D)"))

    return let(parse_formula(clean_text(name)), fractions)


def element_order(name: str) -> str:
    """Element symbols of a name in order, repeats kept; empty for null."""
    return f"coalesce({_find_all(name, ELEMENT, 0)}, {NO_ORDER})"


def distances(a: str, b: str) -> str:
    """``struct<l1, cosine>`` of two compositions on the union of their elements; null if one is null.

    Missing elements count as 0. The cosine is 0 when one side has no length.
    """
    k, x, y = fresh(), fresh(), fresh()
    # Sorted by element, so that sums do not depend on the order of writing.
    both = (
        f"sort_array(map_entries(map_zip_with({a}, {b}, ({k}, {x}, {y}) ->"
        f" named_struct('x', coalesce({x}, 0D), 'y', coalesce({y}, 0D)))))"
    )

    def measure(p: str) -> str:
        def dot(first: str, second: str) -> str:
            return compensated_sum(each(p, lambda e: f"{e}.value.{first} * {e}.value.{second}"))

        lengths = f"named_struct('d', {dot('x', 'y')}, 'n', sqrt({dot('x', 'x')}), 'm', sqrt({dot('y', 'y')}))"
        cosine = let(lengths, lambda s: f"if({s}.n = 0D or {s}.m = 0D, 0D, {s}.d / ({s}.n * {s}.m))")
        l1 = compensated_sum(each(p, lambda e: f"abs({e}.value.x - {e}.value.y)"))
        return f"named_struct('l1', {l1}, 'cosine', {cosine})"

    return f"if({a} is null or {b} is null, null, {let(both, measure)})"


def drop_zero(fractions: str, eps: float = 1e-8) -> str:
    k, v = fresh(), fresh()
    return f"map_filter({fractions}, ({k}, {v}) -> {v} > {eps!r}D and not isnan({v}))"


def ratio_string(fractions: str, order: str = NO_ORDER, eps: float = 1e-8, decimals: int = 1) -> str:
    """``A1.0B1.5``: scaled so that the smallest kept fraction is 1, in the order of the name."""

    def text(kept: str) -> str:
        named = only(order, lambda e: f"map_contains_key({kept}, {e})")
        elements = f"concat({named}, sort_array(array_except(map_keys({kept}), {order})))"

        def parts(base: str) -> str:
            return each(
                elements, lambda e: f"concat({e}, {fixed_decimals(f'try_element_at({kept}, {e}) / {base}', decimals)})"
            )

        joined = let(f"array_min(map_values({kept}))", lambda base: f"array_join({parts(base)}, '')")
        return f"if(size({kept}) > 0, {joined}, null)"

    return let(drop_zero(fractions, eps), text)


def name_without_zero(name: str, fractions: str, order: str, eps: float = 1e-8) -> str:
    """The name without elements of about zero fraction."""
    kept = only(order, lambda e: f"try_element_at({fractions}, {e}) > {eps!r}D")
    return f"if({fractions} is not null and size({order}) > 0, array_join({kept}, ''), coalesce({name}, ''))"


def sorted_json(amounts: str) -> str:
    """JSON object text with sorted keys, one blank after separators."""
    entries = each(
        f"sort_array(map_entries({amounts}))",
        lambda e: f"concat('\"', {e}.key, '\": ', {double_text(f'{e}.value')})",
    )
    return f"concat('{{', array_join({entries}, ', '), '}}')"
