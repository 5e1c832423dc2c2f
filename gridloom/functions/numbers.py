"""Arithmetic as a spreadsheet does it: no error on division by zero, halves away toward +infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Numeric prefix of a text, 0 if there is none."""
    prefix = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.when(prefix != "", prefix.cast("double")), F.lit(0.0))


def divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scaled(x: Column, digits: int, how) -> Column:
    p = F.lit(float(10**digits)) if digits >= 0 else F.lit(1.0 / 10**-digits)
    return how(x * p) / p


def round_half_up(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, lambda y: F.floor(y + 0.5))


def round_down(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, lambda y: F.when(y >= 0, F.floor(y)).otherwise(F.ceil(y)))


def round_up(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, lambda y: F.when(y >= 0, F.ceil(y)).otherwise(F.floor(y)))


def ceiling(x: Column, step: Column) -> Column:
    return F.when(step == 0, 0.0).otherwise(F.ceil(F.try_divide(x, step)) * step)


def floor(x: Column, step: Column) -> Column:
    return F.when(step == 0, 0.0).otherwise(F.floor(F.try_divide(x, step)) * step)


def modulo(a: Column, b: Column) -> Column:
    """Sign of the divisor; null for a divisor of 0."""
    return F.when(b != 0, a - F.floor(F.try_divide(a, b)) * b)


def square_root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def natural_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def number_text(x: Column) -> Column:
    """The shortest digits that give the number back, plain from 1e-7 to 1e21 and with an exponent beyond; a negative zero keeps its sign."""
    shown = F.abs(x.cast("double")).cast("string")  # such as 12.5, 1.25E-9
    mantissa, exponent = F.substring_index(shown, "E", 1), F.coalesce(F.regexp_extract(shown, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    raw = F.concat(whole, F.substring_index(mantissa, ".", -1))
    digits = F.regexp_replace(raw, r"^0+|0+$", "")
    n, k = F.length(whole) + exponent - F.length(F.regexp_extract(raw, r"^0*", 0)), F.length(digits)  # 0.digits times 10 to the n
    rest = F.when(k > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    plain = (
        F.when(k == 0, "0")
        .when((k <= n) & (n <= 21), F.rpad(digits, n, "0"))
        .when((n > 0) & (n <= 21), F.concat(F.substr(digits, F.lit(1), n), F.lit("."), F.substr(digits, n + 1)))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), digits))
        .otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), rest, F.lit("e"), F.when(n > 0, "+").otherwise("-"), F.abs(n - 1).cast("string")))
    )
    odd = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), "Infinity")
    return F.when(x.isNotNull(), F.concat(F.when((x < 0) | (x.cast("double").cast("string") == "-0.0"), "-").otherwise(""), F.coalesce(odd, plain)))
