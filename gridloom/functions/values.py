"""Values of the formula language: a number, a text, a flag or nothing, their coercions and comparisons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number_text, to_number


@dataclass
class Value:
    """Columns of which one is set at most."""

    num: Column
    text: Column
    flag: Column

    @classmethod
    def of(cls, num: Column | None = None, text: Column | None = None, flag: Column | None = None) -> Value:
        null = lambda c, kind: (c if c is not None else F.lit(None)).cast(kind)
        return cls(null(num, "double"), null(text, "string"), null(flag, "boolean"))

    def number(self) -> Column:
        """``toNum``: flags are 1 and 0, texts their numeric prefix or 0, nothing 0."""
        return F.coalesce(self.num, self.flag.cast("double"), F.when(self.text.isNotNull(), to_number(self.text)), F.lit(0.0))

    def string(self) -> Column:
        """``toStr``: flags in capitals, nothing is empty."""
        return F.coalesce(number_text(self.num), F.upper(self.flag.cast("string")), self.text, F.lit(""))

    def truth(self) -> Column:
        """``toBool``: numbers but 0, texts but the empty one and FALSE; nothing is false."""
        return F.coalesce(self.flag, self.num != 0, (self.text != "") & (F.upper(self.text) != "FALSE"), F.lit(False))

    def numeric(self) -> Column:
        """Whether the value compares as a number: all but texts without a numeric prefix."""
        return self.text.isNull() | self.text.rlike(r"^\s*[+-]?(\d|\.\d)")


_COMPARE = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def _plain(v: Value) -> Column:
    return F.coalesce(number_text(v.num), v.flag.cast("string"), v.text, F.lit(""))


def compare(a: Value, operator: str, b: Value) -> Column:
    """Numbers first; texts, case-sensitive, where one side is a text that is no number."""
    how = _COMPARE[operator]
    return F.when(a.numeric() & b.numeric(), how(a.number(), b.number())).otherwise(how(_plain(a), _plain(b)))


def compared(a: Value, operator: Column, b: Value) -> Column:
    """:func:`compare` by an operator that is data; null for one that isn't known. Each side is put into text in one place, however many operators there are."""
    sign = lambda x, y: F.when(x < y, -1).when(x == y, 0).otherwise(1)
    texts = F.transform(F.array(F.struct(_plain(a).alias("a"), _plain(b).alias("b"))), lambda p: sign(p["a"], p["b"]))
    order = F.when(a.numeric() & b.numeric(), sign(a.number(), b.number())).otherwise(F.get(texts, F.lit(0)))
    meant = {"=": [0], "<>": [-1, 1], "<": [-1], ">": [1], "<=": [-1, 0], ">=": [0, 1]}
    signs = F.create_map(*[x for name, held in meant.items() for x in (F.lit(name), F.array(*map(F.lit, held)))])
    return F.array_contains(F.try_element_at(signs, operator), order)
