"""Predicates: comparisons of rules and the criteria mini-language of COUNTIF and its kin."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "equal": lambda x, a, b: x == a,
    "notEqual": lambda x, a, b: x != a,
    "greaterThan": lambda x, a, b: x > a,
    "greaterThanOrEqual": lambda x, a, b: x >= a,
    "lessThan": lambda x, a, b: x < a,
    "lessThanOrEqual": lambda x, a, b: x <= a,
    "between": lambda x, a, b: (x >= F.least(a, b)) & (x <= F.greatest(a, b)),
    "notBetween": lambda x, a, b: (x < F.least(a, b)) | (x > F.greatest(a, b)),
}


def number_rule(x: Column, operator: str, *args: float) -> Column:
    """A missing argument counts as 0."""
    a, b = (*[F.lit(float(v)) for v in args], F.lit(0.0), F.lit(0.0))[:2]
    return F.coalesce(_COMPARE[operator](x, a, b), F.lit(False))


def text_rule(x: Column, operator: str, arg: str, second: str = "") -> Column:
    s, a, b = F.lower(F.coalesce(x, F.lit(""))), F.lit(arg.lower()), F.lit(second.lower())
    return {
        "equal": s == a,
        "notEqual": s != a,
        "containsText": F.contains(s, a),
        "notContains": ~F.contains(s, a),
        "beginsWith": F.startswith(s, a),
        "endsWith": F.endswith(s, a),
        "between": (s >= a) & (s <= b),
        "notBetween": (s < a) | (s > b),
    }[operator]


def matches(x: Column, criteria: str, numeric: bool) -> Column:
    """``>5``, ``<>x`` or a plain value; case-sensitive, no wildcards. Numbers compare only with numbers."""
    operator, value = re.fullmatch(r"(<=|>=|<>|<|>|=)?(.*)", criteria, re.S).groups()
    number = float(value) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", value.strip()) else None
    text = F.coalesce(x.cast("string"), F.lit(""))
    a, b = (x, F.lit(number)) if numeric and number is not None else (text, F.lit(value))
    found = {"<=": a <= b, ">=": a >= b, "<>": a != b, "<": a < b, ">": a > b}.get(operator, a == b)
    return F.coalesce(found, F.lit(operator == "<>"))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))
