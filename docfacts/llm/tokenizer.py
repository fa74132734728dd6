"""Token ids of many texts from one vocabulary file, with a bounded cache of the words between blanks."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np

from docfacts.llm.common import CACHES

KEPT_WORDS = 450_000
LONGEST_KEPT = 48


def special_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Parts(dict):
    """The ids of blank-free parts as bytes. A part that is not held is encoded when it is asked for.

    Two generations of at most ``KEPT_WORDS`` each are held, so memory is bounded whatever the corpus.
    """

    def __init__(self, encode, folds: bool):
        super().__init__({"": b""})
        self._encode, self.folds, self._before = encode, folds, {}

    def __missing__(self, part: str) -> bytes:
        ids = self._before.get(part)
        if ids is None:
            word = part[:-1] if part[-1] in ",." else part
            lowered = word.lower()
            if self.folds and (word != part or lowered != part) and word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                # Letters and one mark are two steps of the splitting pattern, and these letters have plain lower cases.
                ids = self[lowered] + (self[part[-1]] if word != part else b"")
            else:
                ids = self._encode(part)
        if len(part) <= LONGEST_KEPT:
            self[part] = ids
        return ids

    def age(self) -> None:
        """Call between batches: a full generation becomes the older one."""
        if len(self) > KEPT_WORDS:
            self._before = dict(self)
            self.clear()
            self[""] = b""


class Encoder:
    """Encodes texts exactly as the library does, without special tokens at either end.

    A vocabulary whose pre-tokenizer drops white space and never looks beyond it gives the
    same ids for a text as for its blank-separated parts one after another. Such parts are
    encoded once and kept. Any other vocabulary encodes whole texts.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda text: model.encode(text, num_threads=1)
            self.by_words, size = False, model.get_piece_size()
            self.tokenizer, self.longest = None, max(len(model.id_to_piece(i)) for i in range(size))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.tokenizer = tokenizer
            self.library = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            with open(path, encoding="utf-8") as file:
                self.by_words = _drops_blanks(json.load(file))
            size = tokenizer.get_vocab_size()
        self.kind, self._code = (np.dtype("<u2"), "H") if size < 65_536 else (np.dtype("<u4"), "I")
        self.packed = Parts(self._packed, self.tokenizer is not None and _folds_case(self.tokenizer))

    def _packed(self, part: str) -> bytes:
        return array(self._code, self.library(part)).tobytes()

    def parts(self, text: str) -> list[str]:
        """A text cut at blanks and line feeds; joining the parts' ids gives the text's ids."""
        return text.replace("\n", " ").split(" ") if self.by_words else [text]

    def ids(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.frombuffer(self._packed(text), self.kind)
        self.packed.age()
        return np.frombuffer(b"".join(map(self.packed.__getitem__, self.parts(text))), self.kind)

    def counts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part."""
        if not self.by_words:
            return np.array([len(self.library(p)) for p in parts], np.int64)
        self.packed.age()
        sizes = np.fromiter(map(len, map(self.packed.__getitem__, parts)), np.int64, len(parts))
        return sizes // self.kind.itemsize


def _folds_case(tokenizer) -> bool:
    """Whether the vocabulary reads plain Latin letters in lower case, and a mark after letters as a step of its own."""
    letters = "".join(chr(c) for c in range(0x41, 0x100) if chr(c).isalpha())
    normalizer, splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
    if normalizer is None or splitter is None or normalizer.normalize_str(letters) != normalizer.normalize_str(letters.lower()):
        return False
    return all(len(splitter.pre_tokenize_str(f"ab{mark}")) == 2 for mark in ",.")


def _drops_blanks(spec: dict) -> bool:
    """Whether the vocabulary splits by a pattern that keeps only its matches, none of which holds a blank."""
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    split = steps[0] if steps else {}
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and spec.get("post_processor") is None
        and bool(spec["model"].get("end_of_word_suffix"))
        and r"[^\s" in split["pattern"].get("Regex", "")
        and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens", []))
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file; Spark reuses its workers."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


CACHES.append(encoder.cache_clear)
