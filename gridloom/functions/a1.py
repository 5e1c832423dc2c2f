"""A1 references and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns up to XFD.
MOST_COLUMNS = 16384


def _clean(ref: Column) -> Column:
    return F.upper(F.replace(ref, F.lit("$"), F.lit("")))


def column_number(ref: Column) -> Column:
    """Letters of a reference as a 1-based column; dollar signs and case don't matter."""
    letters = F.regexp_extract(_clean(ref), "^([A-Z]{1,3})", 1)
    digits = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), F.ascii)
    return F.when(letters != "", F.aggregate(digits, F.lit(0), lambda a, c: a * 26 + c - 64))


def row_number(ref: Column) -> Column:
    digits = F.regexp_extract(_clean(ref), "^[A-Z]{1,3}([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("int"))


def column_letters(col: Column) -> Column:
    """1 -> A, 27 -> AA, 703 -> AAA."""
    letter = lambda n: F.char((n % 26).cast("int") + 65)
    one, two, three = col - 1, F.floor((col - 27) / 26), F.floor((col - 703) / 676)
    return F.concat(F.when(col > 702, letter(three)).otherwise(""), F.when(col > 26, letter(two)).otherwise(""), letter(one))


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def rectangle(text: Column) -> Column:
    """``B2:D7`` or ``C3`` as a struct of four 1-based, inclusive bounds, ends in any order."""
    first, last = F.element_at(F.split(text, ":"), 1), F.element_at(F.split(text, ":"), -1)
    r1, r2, c1, c2 = row_number(first), row_number(last), column_number(first), column_number(last)
    return F.struct(F.least(r1, r2).alias("top"), F.least(c1, c2).alias("left"), F.greatest(r1, r2).alias("bottom"), F.greatest(c1, c2).alias("right"))


def rectangles(sqref: Column) -> Column:
    """A space-separated list of ranges."""
    return F.transform(F.split(F.trim(sqref), r"\s+"), rectangle)


def inside(rects: Column, row: Column, col: Column) -> Column:
    return F.exists(rects, lambda r: row.between(r["top"], r["bottom"]) & col.between(r["left"], r["right"]))


def sheet_of(ref: Column) -> Column:
    """Sheet of a qualified reference, quotes resolved; null without one."""
    quoted = F.regexp_extract(ref, r"^'((?:[^']|'')*)'!", 1)
    plain = F.regexp_extract(ref, r"^([^'!]+)!", 1)
    return F.when(quoted != "", F.replace(quoted, F.lit("''"), F.lit("'"))).when(plain != "", plain)


def range_of(ref: Column) -> Column:
    return F.regexp_replace(ref, r"^(?:'(?:[^']|'')*'|[^'!]+)!", "")


def column_pixels(width: Column, digit: int = 8) -> Column:
    return F.floor(((256 * width + F.lit(128 / digit)) / 256) * digit)


def row_pixels(height: Column) -> Column:
    return F.floor(height + 0.5)


def twips_to_points(x: Column) -> Column:
    return x / 20.0


def half_points_to_points(x: Column) -> Column:
    return x / 2.0


def emu_to_points(x: Column) -> Column:
    return x / 12700.0
