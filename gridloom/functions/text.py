"""Text functions of the formula language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left(s: Column, n: int) -> Column:
    return F.substring(s, 1, max(0, n))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(max(0, n)))


def mid(s: Column, start: int, n: int) -> Column:
    return F.substring(s, max(1, start), max(0, n))


def trim(s: Column) -> Column:
    """Inner runs of white space become one space."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def find(needle: str, s: Column, start: int = 1) -> Column:
    """1-based position, null if missing."""
    return F.nullif(F.locate(needle, s, start), F.lit(0))


def search(needle: str, s: Column, start: int = 1) -> Column:
    """As ``find``, whatever the case; no wildcards."""
    return F.nullif(F.locate(needle.lower(), F.lower(s), start), F.lit(0))


def concatenate(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def is_blank(x: Column) -> Column:
    return x.isNull() | (x.cast("string") == "")


def if_error(x: Column, otherwise: Column) -> Column:
    return F.coalesce(x, otherwise)
