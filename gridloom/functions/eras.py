"""Japanese calendar: era names, era years, weekdays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First day, letter, short and long name of the eras, latest first; names of the weekdays from Sunday on.
ERAS = (
    ("2019-05-01", "R", "令", "令和"),
    ("1989-01-08", "H", "平", "平成"),
    ("1926-12-25", "S", "昭", "昭和"),
    ("1912-07-30", "T", "大", "大正"),
    ("1868-01-25", "M", "明", "明治"),
)
WEEKDAYS = ("日", "月", "火", "水", "木", "金", "土")


def _by_era(day: Column, values: list, before) -> Column:
    """The value of the era that a day falls into; ``before`` for days before the first."""
    out = F
    for (start, *_), v in zip(ERAS, values, strict=True):
        out = out.when(day >= F.lit(start).cast("date"), v)
    return out.otherwise(before)


def era_name(day: Column, length: int = 3) -> Column:
    """1: letter, 2: short name, 3: long name; days before the first era keep its name."""
    names = [F.lit(e[length]) for e in ERAS]
    return _by_era(day, names, names[-1])


def era_year(day: Column) -> Column:
    """Year of the era from 1; the plain year before the first era."""
    return _by_era(day, [F.year(day) - int(e[0][:4]) + 1 for e in ERAS], F.year(day))


def weekday_name(day: Column, long: bool = False) -> Column:
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(day))
    return F.concat(name, F.lit("曜日")) if long else name
