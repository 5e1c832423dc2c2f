"""Guide formulas of shapes: an operator and up to three arguments in prefix form, as Column expressions.

A formula is one operator, so reading it is one split; guides that name earlier
guides become expressions over their columns, in the order in which they stand.
Angles are in 60,000ths of a degree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = math.pi / (180 * 60_000)

_OPERATORS = {
    "val": lambda x: x,
    "*/": lambda x, y, z: F.try_divide(x * y, z),
    "+-": lambda x, y, z: x + y - z,
    "+/": lambda x, y, z: F.try_divide(x + y, z),
    "?:": lambda x, y, z: F.when(x > 0, y).otherwise(z),
    "abs": F.abs,
    "min": F.least,
    "max": F.greatest,
    "pin": lambda low, x, high: F.when(x < low, low).when(x > high, high).otherwise(x),
    "sqrt": lambda x: F.sqrt(F.greatest(x, F.lit(0.0))),
    "mod": lambda x, y, z: F.sqrt(x * x + y * y + z * z),
    "sin": lambda x, a: x * F.sin(a * UNIT),
    "cos": lambda x, a: x * F.cos(a * UNIT),
    "tan": lambda x, a: x * F.tan(a * UNIT),
    "at2": lambda x, y: F.atan2(y, x) / UNIT,
    "cat2": lambda x, y, z: x * F.cos(F.atan2(z, y)),
    "sat2": lambda x, y, z: x * F.sin(F.atan2(z, y)),
}

#: Arguments of the operators that have fewer than three.
ARGUMENTS = {"val": 1, "abs": 1, "sqrt": 1, "min": 2, "max": 2, "sin": 2, "cos": 2, "tan": 2, "at2": 2}


def built_in(width: Column, height: Column) -> dict[str, Column]:
    """Names that every shape has: sides, centres, fractions of its sides, parts of the circle."""
    short, long, full = F.least(width, height), F.greatest(width, height), 360 * 60_000
    names = {"w": width, "h": height, "l": F.lit(0.0), "t": F.lit(0.0), "r": width, "b": height, "hc": width / 2, "vc": height / 2, "ss": short, "ls": long}
    for side, c, parts in (("w", width, (2, 3, 4, 5, 6, 8, 10, 12, 16, 32)), ("h", height, (2, 3, 4, 5, 6, 8, 10, 12, 16, 32)), ("ss", short, (2, 4, 6, 8, 16, 32)), ("ls", long, (2, 4, 6, 8, 16, 32))):
        names |= {f"{side}d{n}": c / n for n in parts}
    return names | {f"{k if k > 1 else ''}cd{n}".replace("cd1", "cd"): F.lit(full * k / n) for k, n in ((1, 1), (1, 2), (1, 4), (1, 8), (3, 4), (3, 8), (5, 8), (7, 8))}


def formula(text: str, names: dict[str, Column]) -> Column:
    operator, *args = text.split()
    if operator not in _OPERATORS:
        raise ValueError(f"unknown operator in {text!r}")
    known = [names[a] if a in names else F.lit(float(a)) for a in args]
    return _OPERATORS[operator](*known)


def guides(shapes: DataFrame, width: str, height: str, formulas: list[tuple[str, str]]) -> DataFrame:
    """A column for each named formula; later ones may use earlier ones."""
    names = built_in(F.col(width), F.col(height))
    for name, text in formulas:
        shapes = shapes.withColumn(name, formula(text, names))
        names[name] = F.col(name)
    return shapes
