"""Quality rules, lines first, by DataFrame functions only.

Base counts describe the whole text. Then each line with a word is judged: it fails as
punctuation (no letter, too many symbols, or an exclamation mark for every second word), as navigation
(list separators between few words), as boilerplate (a phrase of web page furniture), or
because the same line came before. Failed lines are removed, and a document that loses
more than ``MOST_LOST`` percent of its line characters is rejected.

All is one projection of the row: no shuffle. Windows of words are compared by 64-bit hashes.

Defined cases: a null text has no words and no lines (counts 0, base failed, not kept); a document whose
lines are all blank loses nothing; repeated rows are judged each for itself; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED = 30
MOST_LOST = 30
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»·›>]"
# Phrases of web page furniture in English, German, French and Spanish.
PHRASES = (
    "cookie policy", "accept cookies", "privacy policy", "terms of service", "terms of use", "all rights reserved", "enable javascript", "click here",
    "skip to content", "back to top", "share this", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "hier klicken", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "conditions d’utilisation", "accepter les cookies", "cliquez ici", "retour en haut",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aceptar cookies", "haga clic aquí", "volver arriba",
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _window_hashes(words: Column) -> Column:
    """A hash for each window; each word is hashed once, and a window is the hash of its words' hashes."""
    some = F.size(words) >= WINDOW
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(1)))
    each = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.transform(F.array(each), lambda hashes: F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))))[0]
    return F.when(some, windows).otherwise(F.array().cast("array<long>"))


def line_fails(line: Column, phrases: Sequence[str] = PHRASES) -> Column:
    """Whether a line with a word fails for its own sake. ``phrases`` are in lower case."""
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    punctuation = ~F.rlike(line, F.lit(r"\p{L}")) | (10 * symbols > F.length(line)) | (2 * F.regexp_count(line, F.lit("!")) > words)
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = (separators >= 2) & (3 * separators >= words)
    def furnished(lowered: Column) -> Column:
        found = F.lit(False)
        for phrase in phrases:
            found = found | F.contains(lowered, F.lit(phrase))
        return found

    # A lambda binds the lowered line, which would else be made again for each phrase.
    boilerplate = F.exists(F.array(F.lower(line)), furnished)
    return punctuation | navigation | boilerplate


def clean_documents(documents: DataFrame, *carried: str, phrases: Sequence[str] = PHRASES, most_lost: int = MOST_LOST) -> DataFrame:
    """The base counts, the verdicts and the cleaned text of each document; ``carried`` columns go along.

    ``phrases`` mark boilerplate lines, and a document that loses more than ``most_lost`` percent of its line characters is rejected.
    """
    split = documents.select(
        *carried,
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        _words(F.coalesce("text", F.lit(""))).alias("words"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    hashed = split.select(
        *carried,
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        "lines",
        F.array_distinct("lines").alias("first_lines"),
        _window_hashes(F.col("words")).alias("hashes"),
    )
    # Only texts in which a window comes again are sorted.
    numbered = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    kept_lines = F.filter("first_lines", lambda line: ~line_fails(line, phrases))
    paired = hashed.select(
        *carried,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size("first_lines")).cast("long").alias("n_dup_lines"),
        F.length(F.array_join("lines", "")).cast("long").alias("line_chars"),
        kept_lines.alias("kept_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(numbered)).alias("pairs"),
    )
    again = F.filter(
        "pairs",
        lambda p, i: (F.coalesce(F.get("pairs", i - 1)["h"] == p["h"], F.lit(False))) | (F.coalesce(F.get("pairs", i + 1)["h"] == p["h"], F.lit(False))),
    )
    start = F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda p: p["i"])),
        start,
        lambda done, at: F.struct((done["covered"] + F.least(F.lit(WINDOW), at - done["last"])).alias("covered"), at.alias("last")),
        lambda done: done["covered"],
    )
    counted = paired.select(
        *carried,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "line_chars",
        F.length(F.array_join("kept_lines", "")).cast("long").alias("kept_chars"),
        "kept_lines",
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    too_much = 100 * (F.col("line_chars") - F.col("kept_chars")) > most_lost * F.col("line_chars")
    return counted.select(
        "*",
        failed.alias("base_failed"),
        (~failed & ~too_much).alias("kept"),
        F.array_join("kept_lines", "\n").alias("cleaned_text"),
    ).drop("kept_lines")


def quality(documents: DataFrame) -> DataFrame:
    return clean_documents(documents).drop("cleaned_text")
