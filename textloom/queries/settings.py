"""Settings both the queries and their SQL use."""

from __future__ import annotations

from textloom.operators.terms import CUSTOM_STOP_WORDS

# Frequent function words of the four languages of the given documents.
FUNCTION_WORDS = (
    "and", "are", "for", "from", "have", "that", "the", "this", "was", "with",
    "avec", "dans", "des", "les", "par", "pour", "que", "qui", "sur", "une",
    "aber", "auf", "das", "der", "die", "ein", "mit", "nicht", "und", "von",
    "como", "con", "del", "los", "las", "más", "para", "por", "una", "sin",
)
STOP_WORDS = tuple(dict.fromkeys(CUSTOM_STOP_WORDS + FUNCTION_WORDS))

SCORE_DIGITS = 9
SIMILARITY_DIGITS = 6

PAIR_THRESHOLD = 0.2
# The columns of the wide similarity table; its rows are all documents.
WIDE_IDS = tuple(range(10))
