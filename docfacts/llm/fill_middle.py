"""Fill-in-the-middle texts: a document is cut in three and its middle moved to the end, behind sentinels.

Cuts are drawn in code points, texts are bytes. What lies between the two is a sparse index of exceptions: only the multibyte
characters are recorded, by their place and by the bytes that they and all before them have in excess of one. One
``searchsorted`` over it turns any cuts from code points to bytes or back, for all texts of a batch at once; where a text is
plain ASCII a cut is the same number on both sides, and nothing is recorded.

Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle). The draws come from a digest of
seed and id, so reruns agree and no row depends on another: the work is narrow, with no shuffle.

Defined cases: a null text counts as empty; an empty text and one that holds a sentinel stay plain; a null id is drawn like an empty
one; repeated rows come out alike; other columns are ignored; an empty table gives an empty result. A single text is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docfacts.llm.common import joined_bytes, slices, thrifty

#: Marks before the prefix, the suffix and the middle. No mark may end with what another begins with.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of a hundred documents, those that are cut, and of a hundred cut ones, those with the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
_DRAWS = ["h1", "h2", "h3", "h4"]


class ExceptionIndex:
    """Where the characters of UTF-8 bytes are longer than one byte."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        first = data[self.at_byte]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        #: Bytes in excess of one for each character, before each recorded one and at the end.
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.at_char = self.at_byte - self.before[:-1]

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before the byte ``cuts``, which lie between characters."""
        return cuts - self.before[np.searchsorted(self.at_byte, cuts, side="left")]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before the ``cuts`` in code points."""
        return cuts + self.before[np.searchsorted(self.at_char, cuts, side="left")]


def _texts(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def fill_in_middle(
    documents: DataFrame,
    seed: int = SEED,
    cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """The texts in their new order: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` is the number of code points; the two lengths are null for plain texts. Four draws are the first groups of eight hex digits of
    ``sha256("<seed>:<doc_id>")``: two cuts, whether to cut, and which form.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(h) for k, h in enumerate(_DRAWS)]
    marks = [s.encode() for s in sentinels]
    prefix_mark, suffix_mark, middle_mark = marks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = joined_bytes(batch.column("text"))
            index = ExceptionIndex(data)
            starts = index.chars(offsets)
            n = np.diff(starts)
            one, two, whether, which = (batch.column(h).to_numpy() for h in _DRAWS)
            low, high = np.sort([one % (n + 1), two % (n + 1)], axis=0)
            ends = [offsets[:-1], index.bytes(starts[:-1] + low), index.bytes(starts[:-1] + high), offsets[1:]]
            raw = data.tobytes()
            forms, outputs = [], []
            for a, b, c, d, chosen, suffix_first in zip(*ends, whether % 100 < cut_percent, which % 100 < suffix_first_percent):
                text = raw[a:d]
                if not chosen or not text or any(mark in text for mark in marks):
                    forms.append("plain")
                    outputs.append(text)
                elif suffix_first:
                    forms.append("spm")
                    outputs.append(b"".join((suffix_mark, raw[c:d], prefix_mark, raw[a:b], middle_mark, raw[b:c])))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((prefix_mark, raw[a:b], suffix_mark, raw[c:d], middle_mark, raw[b:c])))
            plain = np.array([form == "plain" for form in forms], bool)
            columns = [batch.column("doc_id"), pa.array(n), pa.array(forms, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), _texts(outputs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return documents.select("doc_id", "text", *draws).mapInArrow(thrifty(cut), schema)


def restored(outputs: DataFrame, *keep: str, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The texts in their old order, from ``form`` and ``output`` alone.

    Columns: those to ``keep``, then ``restored`` and, in code points, ``cut_low`` and ``cut_high`` (null for plain texts).
    """
    prefix_mark, suffix_mark, middle_mark = (s.encode() for s in sentinels)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            data, offsets = joined_bytes(batch.column("output"))
            raw = data.tobytes()
            forms = batch.column("form").to_pylist()
            texts, cuts = [], np.zeros((2, len(forms)), np.int64)
            for k, form in enumerate(forms):
                a, d = int(offsets[k]), int(offsets[k + 1])
                if form == "plain":
                    texts.append(raw[a:d])
                    continue
                first, second = (suffix_mark, prefix_mark) if form == "spm" else (prefix_mark, suffix_mark)
                b = raw.index(second, a, d)
                c = raw.index(middle_mark, b, d)
                one, two, middle = raw[a + len(first) : b], raw[b + len(second) : c], raw[c + len(middle_mark) : d]
                prefix, suffix = (two, one) if form == "spm" else (one, two)
                texts.append(prefix + middle + suffix)
                cuts[:, k] = len(prefix), len(prefix) + len(middle)
            whole = _texts(texts)
            again, begins = joined_bytes(whole)
            index = ExceptionIndex(again)
            low, high = (index.chars(begins[:-1] + cut) - index.chars(begins[:-1]) for cut in cuts)
            plain = np.array([form == "plain" for form in forms], bool)
            columns = [*(batch.column(c) for c in keep), whole, pa.array(low, mask=plain), pa.array(high, mask=plain)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "restored", "cut_low", "cut_high"])

    schema = "".join(f"`{c}` {outputs.schema[c].dataType.simpleString()}, " for c in keep) + "restored string, cut_low long, cut_high long"
    wanted = list(dict.fromkeys([*keep, "form", "output"]))
    return outputs.select(*wanted).mapInArrow(thrifty(join), schema)


def digests(documents: DataFrame) -> DataFrame:
    """Digests of the outputs and of what is rebuilt from them: one row for each document row."""
    done = fill_in_middle(documents)
    back = restored(done, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )
