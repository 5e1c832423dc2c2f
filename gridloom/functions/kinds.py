"""Type tests and conversions of the formula language on typed cells.

A cell is ``v_num``, ``v_text`` and ``v_bool``, of which one is set at most;
a cell with none is blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import to_number


def is_number(num: Column) -> Column:
    return num.isNotNull()


def is_text(text: Column) -> Column:
    return text.isNotNull()


def is_non_text(text: Column) -> Column:
    """Blank cells are no text either."""
    return text.isNull()


def is_logical(flag: Column) -> Column:
    return flag.isNotNull()


def is_error(*parts: Column) -> Column:
    """Nothing is set: errors arrive as null."""
    return F.coalesce(*[p.cast("string") for p in parts]).isNull()


def n(num: Column, flag: Column) -> Column:
    """``N``: numbers as they are, true as 1, all else 0."""
    return F.coalesce(num, flag.cast("double"), F.lit(0.0))


def t(text: Column) -> Column:
    """``T``: texts as they are, all else empty."""
    return F.coalesce(text, F.lit(""))


def value(num: Column, text: Column) -> Column:
    """``VALUE``: a number, or a text's numeric prefix."""
    return F.coalesce(num, to_number(F.coalesce(text, F.lit(""))))


def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def first_true(*cases: tuple[Column, Column]) -> Column:
    """``IFS``: the value of the first condition that holds, else null."""
    out = None
    for condition, result in cases:
        out = F.when(condition, result) if out is None else out.when(condition, result)
    return out
