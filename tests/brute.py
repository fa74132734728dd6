"""Textbook formulas in plain Python, to check the Spark expressions against."""

from __future__ import annotations

import json
import math
import re
from collections import Counter


def l1(a: dict, b: dict) -> float:
    return sum(abs(a.get(e, 0.0) - b.get(e, 0.0)) for e in sorted(a.keys() | b.keys()))


def cosine(a: dict, b: dict) -> float:
    elements = sorted(a.keys() | b.keys())
    length = [math.sqrt(sum(d.get(e, 0.0) ** 2 for e in elements)) for d in (a, b)]
    return sum(a.get(e, 0.0) * b.get(e, 0.0) for e in elements) / (length[0] * length[1]) if all(length) else 0.0


def strictly(text: str):
    """``(True, value)`` of a JSON text; NaN and the like do not count."""

    def refuse(word):
        raise ValueError(word)

    try:
        return True, json.loads(text, parse_constant=refuse)
    except ValueError:
        return False, None


def similarity(old: str, new: str) -> float:
    """Cosine of the TF-IDF vectors over a corpus of the two texts."""
    a, b = (Counter(re.findall(r"\w\w+", t.lower())) for t in (old, new))

    def weight(term: str) -> float:
        return math.log(3 / (1 + (term in a) + (term in b))) + 1

    terms = a.keys() | b.keys()
    dot = sum(a[t] * b[t] * weight(t) ** 2 for t in terms)
    size = [math.sqrt(sum((c[t] * weight(t)) ** 2 for t in terms)) for c in (a, b)]
    return dot / (size[0] * size[1]) if all(size) else 0.0
