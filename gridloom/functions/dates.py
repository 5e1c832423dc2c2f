"""Serial days from 1899-12-30."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1899-12-30"


def serial(date: Column) -> Column:
    return F.datediff(date.cast("date"), F.lit(EPOCH).cast("date"))


def from_serial(n: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(n).cast("int"))


def today(as_of: Column | None = None) -> Column:
    """Serial of the calendar day of ``as_of``, else of now."""
    return serial(as_of if as_of is not None else F.current_timestamp()).cast("double")


def now(as_of: Column | None = None) -> Column:
    """Serial with the time of the day."""
    at = as_of if as_of is not None else F.current_timestamp()
    return serial(at) + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)) / 86400


def volatile(formula: Column, num: Column, as_of: Column | None = None) -> Column:
    """The number of a cell; where its whole formula is TODAY() or NOW(), that of ``as_of``."""
    plain = F.regexp_replace(F.upper(F.regexp_replace(F.trim(formula), "^=", "")), r"\s+", "")
    return F.when(plain == "TODAY()", today(as_of)).when(plain == "NOW()", now(as_of)).otherwise(num)


def date(year: Column, month: Column, day: Column) -> Column:
    """Serial of a date; months and days beyond their range roll over."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    return serial(F.date_add(first, day - 1))


def weekday(n: Column, kind: int = 1) -> Column:
    """1: Sunday is 1; 2: Monday is 1; 3: Monday is 0."""
    day = from_serial(n)
    return {1: F.dayofweek(day), 2: F.weekday(day) + 1, 3: F.weekday(day)}[kind]
