"""Timing expressions: how long words take to say, and what a stretch of speech counts as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words a second and the shortest stretch of speech, in seconds.
RATE, SHORTEST = 3.25, 0.35


def speech_seconds(n_words: Column, rate: float = RATE) -> Column:
    return F.when(n_words == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(SHORTEST), n_words / F.lit(rate)))


def is_backchannel(seconds: Column, n_words: Column) -> Column:
    """Short enough to be a listener's sign: at most 3 s and 3 words."""
    return (seconds <= 3.0) & (n_words <= 3)


def is_formal(seconds: Column, n_words: Column) -> Column:
    """Long enough to be a turn: at least 1 s, or more than 3 words."""
    return (seconds >= 1.0) | (n_words > 3)


def takeover(n_segments: Column, first: Column, last: Column, n_words: Column) -> Column:
    """1 if a set of speech segments takes the floor: none doesn't; a span under 1 s does with more than 3 words; a longer one does."""
    return F.when(F.coalesce(n_segments, F.lit(0)) == 0, 0).when(last - first < 1.0, (n_words > 3).cast("int")).otherwise(1).cast("bigint")


def sem(c: Column) -> Column:
    """Standard error of the mean; null under two values."""
    return F.when(F.count(c) > 1, F.stddev_samp(c) / F.sqrt(F.count(c)))
