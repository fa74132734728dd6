"""Text clean-up, word counts and token estimates."""

from __future__ import annotations

from docfacts.functions.sql import literal

# Unicode-aware classes: Java's \w and \s are ASCII only, so they are spelled out.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

# The characters Python's str.strip() removes.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in SPACE_CHARS) + "'"


def strip(text: str) -> str:
    """Remove Unicode white space at both ends."""
    return f"btrim({text}, {_SPACE_SQL})"


def normalize_text(text: str) -> str:
    """Join words split over a line end, turn white-space runs into one blank, trim."""
    # The regex runs only on the few texts that have a hyphen at a line end.
    line_end = literal(rf"([{WORD}])-\n([{WORD}])")
    joined = f"if(contains({text}, '-\\n'), regexp_replace({text}, {line_end}, '$1$2'), {text})"
    runs = literal(rf"[{SPACE}]{{2,}}+|[\t\r\n]")
    return strip(f"regexp_replace({joined}, {runs}, ' ')")


def count_words(text: str) -> str:
    """Number of words; apostrophes and hyphens inside a word do not split it."""
    return f"regexp_count({text}, {literal(rf'''[{WORD}][{WORD}'-]*+''')})"


def round_half_even(value: str) -> str:
    """Whole number nearest to a double, ties to the even one."""
    return f"cast(rint({value}) as bigint)"


def tokens_from_words(words: str) -> str:
    """About four tokens for three words; 0 for an empty text."""
    return f"if({words} > 0, {round_half_even(f'{words} / 0.75D')}, 0L)"


def tokens_from_chars(chars: str) -> str:
    """About one token for four characters; 0 for an empty text."""
    return f"if({chars} > 0, {round_half_even(f'{chars} / 4D')}, 0L)"


def prompt_terms(text: str) -> str:
    """Lower-case terms of two or more word characters, repeats kept."""
    return f"regexp_extract_all(lower({text}), {literal(f'[{WORD}]{{2,}}+')}, 0)"
