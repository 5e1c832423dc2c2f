"""Numbering styles, names and small classifications of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman digits, media types of file extensions, alignments of paragraphs.
ROMAN = (
    (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), 1),
    (("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), 10),
    (("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), 100),
    (("", "M", "MM", "MMM"), 1000),
)
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp", "mp4": "video/mp4", "mp3": "audio/mpeg"}
ALIGNMENTS = {"start": "left", "left": "left", "end": "right", "right": "right", "center": "center", "both": "justify", "distribute": "justify"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def roman(n: Column) -> Column:
    """1 to 3999; others as digits."""
    parts = [F.element_at(F.array(*map(F.lit, digits)), F.least(F.lit(len(digits)), (F.floor(n / unit) % 10 + 1)).cast("int")) for digits, unit in reversed(ROMAN)]
    return F.when(n.between(1, 3999), F.concat(*parts)).otherwise(n.cast("string"))


def letters(n: Column, repeat: bool = True) -> Column:
    """a, b, ... z, then aa, bb, ... (``repeat``) or aa, ab, ..."""
    if repeat:
        return F.repeat(F.char((n - 1) % 26 + 97), (F.floor((n - 1) / 26) + 1).cast("int"))
    from .a1 import column_letters

    return F.lower(column_letters(n))


def media_type(path: Column) -> Column:
    return F.coalesce(_map(MEDIA_TYPES)[F.lower(F.element_at(F.split(path, r"\."), -1))], F.lit("application/octet-stream"))


def alignment(x: Column) -> Column:
    return F.coalesce(_map(ALIGNMENTS)[F.lower(x)], F.lit("left"))


def field_kind(code: Column) -> Column:
    """First word of a field's code, upper case."""
    return F.upper(F.element_at(F.split(F.trim(code), r"\s+"), 1))


def toggle(present: Column, value: Column) -> Column:
    """Null if missing; false for 0, false or off."""
    return F.when(present, ~F.coalesce(F.lower(value), F.lit("1")).isin("0", "false", "off"))


def thinned(index: Column, n: Column, most: int = 8) -> Column:
    """Whether an axis label is shown: every ceil(n / most)-th."""
    return index % F.greatest(F.lit(1), F.ceil(n / most)) == 0


def truncated(label: Column, rotated: bool = False) -> Column:
    """A category's label: its first 12 characters, 10 on dense axes."""
    return F.substring(F.coalesce(label.cast("string"), F.lit("")), 1, 10 if rotated else 12)


def relative_path(folder: Column, target: Column) -> Column:
    """A relationship's target inside its package; ``..`` steps up, a leading slash starts at the root."""
    joined = F.when(F.startswith(target, F.lit("/")), F.substring(target, 2, 1 << 20)).otherwise(F.concat_ws("/", folder, target))
    steps = F.filter(F.split(joined, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(folded, "/")


def placeholders(pattern: Column, counters: list[Column]) -> Column:
    """``%1.%2`` with every level's counter."""
    return reduce(lambda p, ic: F.replace(p, F.lit(f"%{ic[0] + 1}"), ic[1].cast("string")), enumerate(counters), pattern)
