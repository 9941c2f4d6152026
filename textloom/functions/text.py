"""Text expressions: tokens, n-grams, cleaning, extracts and chunks.

Everything is built from Spark SQL functions, so it stays in the JVM next to the
scan. Patterns use possessive quantifiers on groups: they match what the plain quantifiers
match here, and the matcher loops instead of recursing, so one odd document
(say, a megabyte of base64) cannot overflow a task's stack. A repeated class of characters
is a loop either way, and Java's plain quantifier is its faster one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from textloom.functions.arrays import let

# A word: letters may be joined by a dot, an apostrophe or a middle dot, digits by
# those marks, a comma or a semicolon, as in Unicode word segmentation (UAX 29);
# letters, digits and underscores that touch belong together.
# The letters a to z are letters anyway; named first, they need no look at Unicode's tables.
WORD_PATTERN = (
    r"(?:[a-z\p{L}\p{M}]+(?:[.'‘’·][a-z\p{L}\p{M}]+)*+"
    r"|\p{Nd}+(?:[.,;'‘’]\p{Nd}+)*+"
    r"|_+)++"
)
NON_SPACE_PATTERN = r"[^ \t\n\r\f\x0b]++"

# Sizes and lengths the results depend on.
MIN_WORD_LENGTH = 3
CHUNK_WORDS = 100
WINDOW_TOKENS = 16000
WINDOW_OVERLAP = 200
MIDDLE_FROM, MIDDLE_TO = 0.2, 0.8
MIDDLE_CHARS, MIDDLE_FALLBACK_CHARS = 1500, 1000
MIDPOINT_MIN_CHARS, MIDPOINT_CHARS, MIDPOINT_FALLBACK_CHARS = 2000, 1000, 500


def portable(pattern: str) -> str:
    """The same pattern without possessive quantifiers, for engines that lack them."""
    return pattern.replace("++", "+").replace("*+", "*")


def words(text: Column) -> Column:
    """Lower-case words of a text in order, punctuation dropped; null gives no words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """Tokens between white space, unchanged; the unit of overlapping windows."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NON_SPACE_PATTERN), F.lit(0))


def token_ok(word: Column) -> Column:
    """A word worth counting: no digit, no ASCII apostrophe, three characters or more."""
    return (F.length(word) >= MIN_WORD_LENGTH) & ~word.rlike("[0-9']")


def word_ngrams(toks: Column, n: int = 2) -> Column:
    """All runs of ``n`` neighbouring words, joined by one space."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return F.when(
        F.size(toks) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(toks) - (n - 1)),
            lambda i: F.array_join(F.slice(toks, i, n), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def kept_bigrams(toks: Column, keep) -> Column:
    """Bigrams of neighbouring words that both pass ``keep``.

    Neighbours are taken before filtering, so no bigram bridges a dropped word.
    """

    def pairs(flags: Column) -> Column:
        second = F.filter(
            F.sequence(F.lit(1), F.size(toks) - 1),
            lambda i: F.get(flags, i - 1) & F.get(flags, i),
        )
        return F.transform(second, lambda i: F.concat_ws(" ", F.get(toks, i - 1), F.get(toks, i)))

    return F.when(F.size(toks) >= 2, let(F.transform(toks, keep), pairs)).otherwise(
        F.array().cast("array<string>")
    )


def line_text(text: Column, mode: str = "newline") -> Column:
    """Line ends as ``\\n`` (``newline``), or lines joined by one space (``space``).

    Joining keeps no trailing space for a final line end.
    """
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    if mode == "newline":
        return unix
    if mode == "space":
        return F.regexp_replace(F.regexp_replace(unix, r"\n\z", ""), "\n", " ")
    raise ValueError(f"unknown line mode {mode!r}: use 'newline' or 'space'")


def doc_key(file_name: Column, strip_ext: bool = False) -> Column:
    """File base name, optionally without its extension."""
    base = F.regexp_replace(file_name, r"^.*/", "")
    return F.regexp_replace(base, r"\.[A-Za-z0-9]+$", "") if strip_ext else base


def clean_text(text: Column) -> Column:
    """ASCII letters and digits only, lower case, free-standing numbers dropped.

    Characters outside ASCII are removed without transliteration. Null gives ``""``.
    """
    ascii_only = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", ""))
    spaced = F.regexp_replace(ascii_only, r"[^a-z0-9]", " ")
    no_numbers = F.regexp_replace(spaced, r"\b[0-9]+\b", " ")
    return F.trim(F.regexp_replace(no_numbers, r" +", " "))


def middle_extract(text: Column, sep: str = "\n\n") -> Column:
    """Opening of the middle paragraphs, or of the text when there are none."""

    def pick(paragraphs: Column) -> Column:
        first = F.greatest(F.lit(1), (F.size(paragraphs) * F.lit(MIDDLE_FROM)).cast("int"))
        count = (F.size(paragraphs) * F.lit(MIDDLE_TO)).cast("int") - first
        middle = F.array_join(F.slice(paragraphs, first + 1, F.greatest(count, F.lit(0))), sep)
        return F.when(count > 0, F.substring(middle, 1, MIDDLE_CHARS)).otherwise(
            F.substring(text, 1, MIDDLE_FALLBACK_CHARS)
        )

    return let(F.split(text, re.escape(sep), -1), pick)


def midpoint_extract(text: Column) -> Column:
    """A passage from the middle of a long text, or the opening of a short one."""
    middle = F.substring(text, F.floor(F.length(text) / 2).cast("int") + 1, F.lit(MIDPOINT_CHARS))
    return F.concat(
        F.when(F.length(text) > MIDPOINT_MIN_CHARS, middle).otherwise(
            F.substring(text, 1, MIDPOINT_FALLBACK_CHARS)
        ),
        F.lit("..."),
    )


def fixed_chunks(text: Column, size: int = CHUNK_WORDS) -> Column:
    """Consecutive chunks of ``size`` words of an already cleaned text."""
    if size < 1:
        raise ValueError("size must be at least 1")
    return let(spaced_tokens(text), lambda t: _windows(t, size, size))


def overlapping_chunks(
    text: Column,
    max_tokens: int = WINDOW_TOKENS,
    overlap: int = WINDOW_OVERLAP,
    drop_contained_tail: bool = False,
) -> Column:
    """The text itself when short enough, else overlapping windows of tokens.

    A window starts every ``max_tokens - overlap`` tokens. The last one may lie wholly
    inside the one before; ``drop_contained_tail`` leaves it out.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be at least 0 and below max_tokens")
    step = max_tokens - overlap

    def split(toks: Column) -> Column:
        windows = _windows(toks, max_tokens, step, overlap if drop_contained_tail else 0)
        return F.when(F.size(toks) <= max_tokens, F.array(text)).otherwise(windows)

    return let(spaced_tokens(text), split)


def _windows(toks: Column, width: int, step: int, spare: int = 0) -> Column:
    last = F.size(toks) - 1 - spare
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda start: F.array_join(F.slice(toks, start + 1, width), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences: runs up to a full stop, exclamation or question mark, or a line end."""
    return F.filter(
        F.transform(
            F.regexp_extract_all(
                F.coalesce(text, F.lit("")), F.lit(SENTENCE_PATTERN), F.lit(0)
            ),
            lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\f\x0b]+", " ")),
        ),
        lambda s: s != "",
    )


# A full stop ends a sentence only before white space or the end, so that figures
# and abbreviations with inner dots stay whole.
SENTENCE_PATTERN = r"[^\n.!?]++(?:[.!?]++[^ \t\n\r\f\x0b.!?][^\n.!?]*+)*+[.!?]*+"
