"""Exact order statistics without sorting everything in one place.

An approximate quantile brackets the wanted value, a count says how many lie
below the bracket, and only the bracket is narrowed further or sorted. The
driver sees counts and single values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that may be sorted to take one of them.
BRACKET = 100_000


def kth_smallest(df: DataFrame, value: Column, k: int):
    """The value with ``k`` values before it in ascending order, in its own type; nulls don't count."""
    values = df.select(value.alias("v")).where(F.col("v").isNotNull())
    total, low, high, below = values.count(), None, None, 0
    if not 0 <= k < total:
        return None
    inside = total
    while inside > BRACKET:
        at = (k - below) / inside
        step = 2e-3
        part = values if low is None else values.where(F.col("v").between(low, high))
        new_low, new_high = part.agg(F.percentile_approx("v", [max(0.0, at - step), min(1.0, at + step)], 10_000)).collect()[0][0]
        less, upto = values.agg(F.count_if(F.col("v") < new_low), F.count_if(F.col("v") <= new_high)).collect()[0]
        if not less <= k < upto or (new_low, new_high) == (low, high):
            break
        low, high, below, inside = new_low, new_high, less, upto - less
        if low == high:
            return low
    part = values if low is None else values.where(F.col("v").between(low, high))
    # What can't be narrowed has few distinct values: they are counted before they are put in order.
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("v"))
    return part.groupBy("v").agg(F.count("*").alias("n")).withColumn("upto", upto).where(F.col("upto") > k - below).agg(F.min("v")).collect()[0][0]


def nearest_percentile(df: DataFrame, value: Column, percent: float) -> float | None:
    """The value at index ``floor(percent/100 * (n - 1) + 0.5)`` of the sorted values."""
    n = df.where(value.isNotNull()).count()
    return kth_smallest(df, value, int(percent / 100 * (n - 1) + 0.5)) if n else None


def linear_percent(low: Column, high: Column, percent: float) -> Column:
    return low + (high - low) * (percent / 100)


def top_threshold(df: DataFrame, value: Column, rank: int, percent: bool = False, bottom: bool = False) -> float | None:
    """Value that the first ``rank`` (or percent of all) reach; ties with it belong to them."""
    n = df.where(value.isNotNull()).count()
    if not n:
        return None
    rank = max(1, int(n * rank / 100)) if percent else rank
    return kth_smallest(df, value, min(n - 1, rank - 1) if bottom else max(0, n - rank))
