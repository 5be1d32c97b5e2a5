"""Randomness without state: the same key always draws the same number, in any order and on any executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*key: Column) -> Column:
    """0 to 2**32 - 1, from the first eight hex digits of the md5 of the key's parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("bigint")


def chance(p: float, *key: Column) -> Column:
    """True with probability ``p``."""
    return draw(*key) < F.lit(int(p * 2**32))


def digest_split(key: Column, parts: int = 10) -> Column:
    """sha1 of a key, as a number, modulo ``parts``."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.conv(F.sha1(key).substr(i, F.lit(1)), 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % parts).cast("bigint")


def bucket_name(remainder: Column) -> Column:
    return F.when(remainder == 0, "test").when(remainder == 1, "val").otherwise("train")
