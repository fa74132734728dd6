"""Token counts at every prefix of a text, by dynamic programming over prefixes.

For a vocabulary with word ends, the count at a prefix is the count at the last part
boundary before it plus the count of the cut part read as a word of its own. The first is a
running sum over the text (one addition for each part), the second a table over the prefixes of
one part. That table is itself a recurrence: the encoding of ``w[:k]`` ends with the one token
``t`` that may follow the last token of the encoding of ``w[:k - len(t)]``, so
``count[k] = count[k - len(t)] + 1``. Two tokens may stand side by side when merging their
symbols from scratch gives the same two tokens.

The table is kept for the steps of the splitting pattern (letters, a digit, signs of any script), over their bytes, and shared by all
words that begin alike: a new word adds entries only from where it leaves the words before. The count of a text is the last entry of its
table, and a budget is answered by reading entries; nothing is encoded again.

Only where a budget falls inside a part of more than ``LONG_PART`` characters there is no table of that part. A bounded beginning of it is
cut into steps. In short steps the prefixes are read one at a time by the library, from a step a little before; in a long
step the recurrence runs over its bytes. It stops once as many prefixes as the
longest token has bytes are all at the budget: every longer one comes from one of these and is over it. So the work
follows the budget, not the length of the part.

Defined cases: a null text counts as empty (0 bytes, 0 tokens, never over a limit); a null or
repeated ``doc_id`` is passed through, one result row for each input row; other columns are
ignored; an empty table gives an empty result. Special strings inside a text count as the
library counts them by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docfacts.llm.common import CACHES, slices, thrifty
from docfacts.llm.tokenizer import KEPT_WORDS, LONGEST_KEPT, Encoder, encoder

LIMIT = 2048
#: Steps of up to so many characters are read by the library.
SHORT = 64
#: Characters at the start of a long step that may be read otherwise when cut (as "'r" and "'re").
UNSTEADY = 4
#: Prefixes that a worker keeps counts of, and bytes of the longest step whose prefixes are kept; longer steps are read in a window.
KEPT_PREFIXES, LONG_STEP = 1_000_000, 96
#: Characters of the longest part whose every prefix is looked up where a budget falls inside it.
LONG_PART = 256
_NEVER = float("inf")
#: Letters of a token's end by which its possible lengths are looked up, and the lengths below that.
TAIL = 3
SHORTEST = (*range(TAIL - 1, 0, -1),)


class PrefixCounts:
    """Count tables of texts for one vocabulary."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self._merges = _Merges(path) if self.encoder.tokenizer else None
        self._tabled = _PartCounts(self.encoder, self._merges) if self.encoder.by_words else None

    def sums(self, parts: list[str]) -> np.ndarray:
        """The exact token count up to each part end, from 0."""
        counts = np.zeros(len(parts) + 1, np.int64)
        if self._tabled is None:
            np.cumsum(self.encoder.counts(parts), out=counts[1:])
        else:
            self._tabled.age()
            np.cumsum(np.fromiter(map(self._tabled.__getitem__, parts), np.int64, len(parts)), out=counts[1:])
        return counts

    @staticmethod
    def ends(parts: list[str]) -> np.ndarray:
        """Character positions of the part ends, from 0."""
        ends = np.zeros(len(parts) + 1, np.int64)
        ends[1:] = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        return ends

    def part(self, part: str) -> np.ndarray:
        """The count of every prefix of one part."""
        read = self._tabled.count if self._tabled is not None else self._count
        return np.fromiter((read(part[:k]) for k in range(len(part) + 1)), np.int64, len(part) + 1)

    def _count(self, text: str) -> int:
        return len(self.encoder.library(text))

    def every_prefix(self, text: str) -> np.ndarray:
        """``counts[k]``: the tokens of ``text[:k]``."""
        parts = self.encoder.parts(text)
        counts = self.sums(parts)
        out, at = np.zeros(len(text) + 1, np.int64), 0
        for i, part in enumerate(parts):
            out[at : at + len(part) + 1] = counts[i] + self.part(part)
            at += len(part) + 1
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most characters of ``text`` whose tokens fit in ``budget``."""
        parts = self.encoder.parts(text)
        return self._longest(parts, self.sums(parts), budget)

    def _longest(self, parts: list[str], counts: np.ndarray, budget: int) -> int:
        last = int(np.searchsorted(counts, budget, side="right")) - 1
        start = int(self.ends(parts[: last + 1])[last]) + (1 if last else 0)
        if last == len(parts):
            return start - 1 if last else 0
        left = budget - int(counts[last])
        if self._tabled is not None and len(parts[last]) <= LONG_PART:
            return start + int(np.flatnonzero(self.part(parts[last]) <= left)[-1])
        fits = self._fitting if self._merges else self._fitting_piece
        return start + fits(parts[last], left)

    def _fitting_piece(self, text: str, budget: int) -> int:
        """The most characters that fit, for pieces of whole characters: a prefix without its last piece is a shorter prefix."""
        low, high = 0, min(budget + 1, len(text))
        while high < len(text) and self._count(text[:high]) <= budget:
            low, high = high, min(2 * high, len(text))
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._count(text[:middle]) <= budget else (low, middle)
        best, k = low, low + 1
        while k <= len(text) and k - best <= self.encoder.longest:
            best = k if self._count(text[:k]) <= budget else best
            k += 1
        return best

    def _fitting(self, part: str, budget: int) -> int:
        """The most characters of a part that fit, from a beginning of it that is doubled until the answer lies inside."""
        size = 4 * (budget + SHORT + 1)
        while True:
            found = self._fitting_within(part[:size], budget, size >= len(part))
            if found is not None:
                return found
            size *= 2

    def _fitting_within(self, text: str, budget: int, whole: bool) -> int | None:
        """The most characters that fit; None if more of the part than ``text`` is needed to tell."""
        starts, ends, before, inside = _steps(self.encoder.tokenizer.encode(text, add_special_tokens=False), len(text))
        # The end of the text may turn a cut step and the one before it into others; all earlier ones are settled.
        upto = next((i for i in range(2, len(starts)) if before[i - 2] > budget), len(starts))
        open_end = not whole and upto > len(starts) - 3
        if open_end and (not starts or ends[-1] - starts[-1] <= SHORT):
            return None
        for i in range(min(upto, len(starts)) - 1, -1, -1):
            back = max(i - 2, 0)
            while back and not (not inside[back] and self._merges.apart(text[starts[back] - 1], text[starts[back]])):
                back -= 1
            origin, counted = (starts[back], before[back]) if back else (0, 0)
            fits = lambda k: counted + self._count(text[origin:k]) <= budget  # noqa: B023, E731
            after = starts[i + 1] if i + 1 < len(starts) else len(text)
            if after > ends[i] and fits(after):  # dropped blanks
                return None if open_end and i == len(starts) - 1 else after
            low = starts[i]
            lead = self._merges.normal(text[low])[1:] if inside[i] else ""
            if ends[i] - low > SHORT and (not inside[i] or len(lead) == 1 and self._merges.apart(text[low], text[low + 1 : low + 2])):
                best, over, between = self._merges.reach(text[low : ends[i]], budget - before[i], lead)
                if open_end and i == len(starts) - 1 and over is None:
                    return None
                for k in reversed(between):
                    if k > max(best, UNSTEADY) and fits(low + k):
                        return low + k
                if best > UNSTEADY:
                    return low + best
                upper = low + UNSTEADY
            else:
                upper = ends[i]
            for k in range(upper, low, -1):
                if fits(k):
                    return k
        return starts[0] if starts else len(text)


def _steps(encoding, length: int) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Starts and ends of the steps of the splitting pattern in characters, the tokens before each, and whether it starts
    inside a character (a dotted capital I becomes a letter and a mark)."""
    starts, ends, before, inside, word = [], [], [], [], object()
    for i, (w, (a, b)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if w is None or w != word:
            inside.append(bool(ends) and a < max(ends[-2:]))
            starts.append(max(a, starts[-1]) if starts else a)
            ends.append(b)
            before.append(i)
        ends[-1] = max(ends[-1], b)
        word = w
    return starts, [min(e, s) for e, s in zip(ends, [*starts[1:], length])], before, inside


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Merges:
    """The recurrence over prefixes of one word, for byte-level merges with or without an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocabulary = model["vocab"].keys()
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.longest = max(map(len, self.vocabulary))
        self.beside = lru_cache(maxsize=1 << 18)(self._beside)
        self.joins = lru_cache(maxsize=1 << 16)(self._joins)
        self.edges = lru_cache(maxsize=1 << 16)(self._edges)
        normalizer = encoder(path).tokenizer.normalizer
        self.normal = lru_cache(maxsize=1 << 14)(normalizer.normalize_str) if normalizer else str
        self.letters = _byte_letters()
        self.sizes, self.closed_sizes = self._sizes_by_tail(False), self._sizes_by_tail(True)
        self.table: dict[str, tuple[str, int, int]] = {"": ("", 0, 0)}

    def apart(self, before: str, char: str) -> bool:
        """Whether normalising leaves ``char`` apart from what comes before it."""
        return char.isascii() or not unicodedata.combining(char) and self.normal(before + char) == self.normal(before) + self.normal(char)

    def reach(self, step: str, budget: int, lead: str = "") -> tuple[int, int | None, list[int]]:
        """How many characters of one step of the pattern fit, by the recurrence over its bytes.

        ``lead`` is what the step holds of its first character, if not all of it. Only prefixes that end where normalising may be cut are read; the others beyond the result are returned for the library.
        The second value says where all that follows is over the budget, None if the end of the step came first.
        """
        word, last, inside, best, over = "", [""], [0], 0, 0
        between: list[int] = []
        at = 0
        while at < len(step):
            upto = at + 1
            while upto < len(step) and not self.apart(step[at:upto], step[upto]):
                upto += 1
            for byte in (lead if lead and not at else self.normal(step[at:upto])).encode():
                word = (word + self.letters[byte])[-self.longest :]
                last, inside = last[-len(word) :], inside[-len(word) :]
                token, count = self._step(word, len(word), "", last, inside)
                closed = self._step(word, len(word), self.end, last, inside)[1] if self.end else count
                last.append(token)
                inside.append(count)
                over = over + 1 if count >= budget else 0
            between += range(at + 1, upto)
            at = upto
            if closed <= budget:
                best, between = at, []
            if over > self.longest:
                return best, at, between
        return best, None, between

    def _beside(self, left: str, right: str) -> bool:
        """Whether merging both tokens' symbols from scratch leaves the two tokens.

        Merges happen in the order of their ranks, so the symbols at the border are known at any rank: the edges of the two tokens' own
        merge trees. The border holds unless an edge pair is merged before one of them goes into its own token.
        """
        ours, theirs = self.edges(left), self.edges(right)
        if ours is None or theirs is None:
            return False
        (_, last), (first, _) = ours, theirs
        rank, i, j = self.rank, 0, 0
        while True:
            (x, x_gone), (y, y_gone) = last[i], first[j]
            merged = rank.get((x, y))
            gone = x_gone if x_gone < y_gone else y_gone
            # Of equal pairs the left one is merged first: one that takes the left edge comes before the border, one that takes the right edge after it.
            if merged is not None and (merged < gone or merged == gone and x_gone > gone):
                return False
            if gone == _NEVER:
                return True
            i, j = i + (x_gone == gone), j + (y_gone == gone)

    def _edges(self, token: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The first and the last symbol of a token while it is merged, each with the rank at which it goes into a larger one. None for a token that merges do not make."""
        symbols = _symbols(token, self.end)
        first, last, at = [], [], -1
        while len(symbols) > 1:
            ranked = min(((self.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.rank), default=None)
            if ranked is None:
                return None
            merged, i = ranked
            if merged < at:
                raise ValueError(f"{token!r} is merged before its parts")
            at = merged
            if i == 0:
                first.append((symbols[0], merged))
            if i == len(symbols) - 2:
                last.append((symbols[-1], merged))
            symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
        return [*first, (token, _NEVER)], [*last, (token, _NEVER)]

    def _joins(self, token: str) -> bool:
        """Whether the merges make the token of its symbols."""
        return self.edges(token) is not None

    def closed(self, step: str) -> int:
        """The tokens of one step, given as the letters of its bytes: the last entry of its table."""
        found = self.table.get(step)
        if found is None:
            found = self._widen(step) if len(step) <= LONG_STEP else self._windowed(step)
        return found[2]

    def _widen(self, step: str) -> tuple[str, int, int]:
        """Entries for the prefixes of ``step`` that no word before had: last token and count of the prefix left open, count of it as a word."""
        table, known = self.table, len(step) - 1
        while step[:known] not in table:
            known -= 1
        for k in range(known + 1, len(step) + 1):
            prefix = step[:k]
            tail = prefix[-TAIL:]
            token, count = self._last(prefix, prefix, self.sizes.get(tail, SHORTEST))
            closed = self._last(prefix, prefix + self.end, self.closed_sizes.get(tail, SHORTEST))[1] if self.end else count
            table[prefix] = entry = (token, count, closed)
        return entry

    def _last(self, prefix: str, word: str, sizes: tuple[int, ...]) -> tuple[str, int]:
        """The last token of ``word``, which is the prefix or the prefix with its end mark, and its count."""
        vocabulary, k = self.vocabulary, len(prefix)
        for size in sizes:
            if size < k:
                token = word[k - size :]
                if token in vocabulary:
                    before = self.table[prefix[: k - size]]
                    if self.beside(before[0], token):
                        return token, before[1] + 1
            elif size == k and word in vocabulary and self.joins(word):
                return word, 1
        raise ValueError(f"no token ends {prefix!r}")

    def _sizes_by_tail(self, closed: bool) -> dict[str, tuple[int, ...]]:
        """For the last letters of a prefix the lengths that its last token may have, longest first."""
        found: dict[str, set[int]] = {}
        for token in self.vocabulary:
            body = token
            if self.end and token.endswith(self.end) and len(token) > len(self.end):
                if not closed:
                    continue
                body = token[: -len(self.end)]
            elif closed:
                continue
            if len(body) >= TAIL:
                found.setdefault(body[-TAIL:], set()).add(len(body))
        return {tail: (*sorted(sizes | set(SHORTEST), reverse=True),) for tail, sizes in found.items()}

    def _windowed(self, step: str) -> tuple[str, int, int]:
        """The same for a long step: only as many entries as the longest token has bytes are held."""
        word, last, inside, closed = "", [""], [0], 0
        for letter in step:
            word = (word + letter)[-self.longest :]
            last, inside = last[-len(word) :], inside[-len(word) :]
            token, count = self._step(word, len(word), "", last, inside)
            last.append(token)
            inside.append(count)
        if self.end:
            closed = self._step(word, len(word), self.end, last[:-1], inside[:-1])[1]
        return last[-1], inside[-1], closed if self.end else inside[-1]

    def age(self) -> None:
        """Call between texts: a full table is begun anew."""
        if len(self.table) > KEPT_PREFIXES:
            self.table = {"": ("", 0, 0)}

    def _step(self, word: str, k: int, end: str, last: list[str], inside: list[int]) -> tuple[str | None, int]:
        for start in range(max(0, k - self.longest), k):
            token = word[start:k] + end
            if token in self.vocabulary and (self.beside(last[start], token) if last[start] else self.joins(token)):
                return token, inside[start] + 1
        return None, 0


class _PartCounts(dict):
    """The counts of blank-free parts, summed from the tables of their steps; two generations of at most ``KEPT_WORDS`` are held."""

    def __init__(self, encoder: Encoder, merges: _Merges):
        super().__init__({"": 0})
        self._tokenizer, self._merges, self._folds = encoder.tokenizer, merges, encoder.packed.folds
        specials = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self._spelt = {ord(c): "".join(merges.letters[b] for b in c.encode()) for c in map(chr, range(128, 256))}
        self._before: dict[str, int] = {}

    def __missing__(self, part: str) -> int:
        found = self._before.get(part)
        if found is None:
            found = self.count(part)
        if len(part) <= LONGEST_KEPT:
            self[part] = found
        return found

    def count(self, part: str) -> int:
        word = part[:-1] if part[-1:] in (",", ".") else part
        if self._folds and word.isalpha() and (word.isascii() or max(word) < "\u0100"):
            # Letters and one mark are two steps, and these letters have plain lower cases.
            return self._merges.closed(word.lower().translate(self._spelt)) + (self._merges.closed(part[-1]) if word != part else 0)
        if self._special is None:
            return self._plain(part)
        between = self._special.split(part)
        return sum(map(self._plain, between)) + len(between) - 1

    def _plain(self, text: str) -> int:
        normalizer = self._tokenizer.normalizer
        normal = normalizer.normalize_str(text) if normalizer is not None else text
        return sum(self._merges.closed(step) for step, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(normal)) if normal else 0

    def age(self) -> None:
        """Call between texts: a full generation becomes the older one."""
        self._merges.age()
        if len(self) > KEPT_WORDS:
            self._before = dict(self)
            self.clear()
            self[""] = 0


def _symbols(token: str, end: str) -> list[str]:
    if end and token.endswith(end) and len(token) > len(end):
        body = list(token[: -len(end)])
        return [*body[:-1], body[-1] + end]
    return list(token)


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


CACHES.append(prefix_counts.cache_clear)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """For each document its bytes, its tokens, whether they exceed ``limit``, and how many characters fit in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = prefix_counts(path)
        for batch in slices(batches, "text"):
            tokens, fits = [], []
            for text in batch.column("text").to_pylist():
                parts = tables.encoder.parts(text or "")
                counts = tables.sums(parts)
                tokens.append(int(counts[-1]))
                fits.append(tables._longest(parts, counts, limit) if counts[-1] > limit else len(text or ""))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                    pa.array(fits, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    return documents.select("doc_id", "text").mapInArrow(thrifty(count, keeps_caches=True), schema)


def prefix_tables(documents: DataFrame, path: str) -> DataFrame:
    """For each document the character positions of its part ends and the token count of the text up to each."""

    def tables_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = prefix_counts(path)
        for batch in slices(batches, "text"):
            parts = [tables.encoder.parts(t or "") for t in batch.column("text").to_pylist()]
            found = [(tables.ends(p), tables.sums(p)) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([x[i].tolist() for x in found], pa.list_(pa.int64())) for i in (0, 1))],
                ["doc_id", "ends", "counts"],
            )

    return documents.select("doc_id", "text").mapInArrow(thrifty(tables_of, keeps_caches=True), "doc_id long, ends array<long>, counts array<long>")
