"""Number helpers whose results agree with IEEE doubles as Python prints and sums them."""

from __future__ import annotations

from docfacts.functions.sql import fresh, let


def fixed_decimals(value: str, decimals: int) -> str:
    """Text with a fixed number of decimals, ties to even on the exact binary value."""
    pattern = "0." + "0" * decimals if decimals > 0 else "0"
    return f"format_number({value}, '{pattern}')"


def compensated_sum(values: str) -> str:
    """Sum of an array of doubles with an error term carried along.

    Sums of a few fractions are compared with thresholds, so the last bit counts.
    """
    a, x, r = fresh(), fresh(), fresh()
    lost = f"if(abs({a}.s) >= abs({x}), ({a}.s - ({a}.s + {x})) + {x}, ({x} - ({a}.s + {x})) + {a}.s)"
    return (
        f"aggregate({values}, named_struct('s', 0D, 'c', 0D),"
        f" ({a}, {x}) -> named_struct('s', {a}.s + {x}, 'c', {a}.c + {lost}),"
        f" {r} -> if(abs({r}.c) < double('infinity'), {r}.s + {r}.c, {r}.s))"
    )


def double_text(value: str) -> str:
    """Text of a double: plain between 1e-4 and 1e16, otherwise like ``1e-05``."""

    def scientific(java: str) -> str:
        mantissa = f"regexp_replace(substring_index({java}, 'E', 1), '[.]0$', '')"
        exponent = f"try_cast(substring_index({java}, 'E', -1) as int)"
        sign = f"if({exponent} < 0, 'e-', 'e+')"
        return f"concat({mantissa}, {sign}, lpad(abs({exponent}), greatest(2, length(abs({exponent}))), '0'))"

    plain = f"format_number({value}, '0.0{'#' * 24}')"
    return (
        f"case when {value} = 0D or (abs({value}) >= 1e-3D and abs({value}) < 1e7D) then cast({value} as string)"
        f" when abs({value}) >= 1e-4D and abs({value}) < 1e16D then {plain}"
        f" when isnan({value}) then 'NaN'"
        f" when abs({value}) = double('infinity') then if({value} > 0D, 'Infinity', '-Infinity')"
        f" else {let(f'cast({value} as string)', scientific)} end"
    )
