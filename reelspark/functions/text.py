"""Column expressions over transcript text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..params import FILLERS, STOPWORDS, TRANSITIONS

_WORD = "^[a-záéíóúñü]+$"


def literal_array(values) -> Column:
    return F.array(*map(F.lit, values))


def strip(c) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c) -> Column:
    """Lower-case runs of word characters that are letters of the Spanish alphabet only."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(_WORD))


def content_richness(c) -> Column:
    """Characters of distinct content words, lowered by repetition and by the share of stop words."""
    w = words(c)
    content = F.filter(w, lambda x: ~F.array_contains(literal_array(FILLERS), x) & (F.length(x) > 2))
    stop = F.size(F.filter(w, lambda x: F.array_contains(literal_array(STOPWORDS), x)))
    chars = F.aggregate(content, F.lit(0), lambda a, x: a + F.length(x))
    distinct = F.size(F.array_distinct(content)) / F.size(content)
    rich = chars * F.greatest(distinct, F.lit(0.3)) * F.greatest(F.lit(0.3), 1.0 - stop / F.size(w))
    return F.when((F.size(w) == 0) | (F.size(content) == 0) | F.size(content).isNull(), 0.0).otherwise(rich)


def content_tokens(c) -> Column:
    """Words without stop words, longer than two letters."""
    return F.filter(words(c), lambda x: ~F.array_contains(literal_array(STOPWORDS), x) & (F.length(x) > 2))


def has_transition(c) -> Column:
    low = F.lower(c)
    found = low.contains(TRANSITIONS[0])
    for phrase in TRANSITIONS[1:]:
        found = found | low.contains(phrase)
    return F.coalesce(found, F.lit(False))


def clock(seconds) -> Column:
    """HH:MM:SS,mmm with the milliseconds cut off."""
    whole = F.floor(seconds)
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60, F.floor((seconds % 1) * 1000)
    )


def tidy(c, places: int = 4) -> Column:
    """Rounded to `places`, after the noise of the last binary digits is rounded away: ties go up whatever the order of a sum."""
    return F.round(F.round(c, 10), places)
