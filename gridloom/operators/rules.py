"""Conditional formats: thresholds, matches and their resolution by priority.

Thresholds are aggregates of a block's values; they come back to the cells as
literals (one block) or by a join on the block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bar_ratio(x: Column, low: Column, high: Column) -> Column:
    """Share of the range, clamped; an empty range gives 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))))


def icon_index(x: Column, thresholds: list[Column], reverse: bool = False) -> Column:
    """The highest threshold that the value reaches, 0-based."""
    reached = reduce(lambda acc, t: F.when(x >= t[1], t[0]).otherwise(acc), list(enumerate(thresholds))[1:], F.lit(0))
    return F.lit(len(thresholds) - 1) - reached if reverse else reached


def icon(x: Column, thresholds: list[Column], sets: list[tuple[str, int]] | None, default_set: str, reverse: bool = False) -> Column:
    """``set:index`` of a value's icon; ``sets`` are custom icons by threshold, and ``NoIcons`` shows none."""
    at = icon_index(x, thresholds, reverse)
    if not sets:
        return F.concat_ws(":", F.lit(default_set), at.cast("string"))
    chosen = F.element_at(F.array(*[F.lit(None if s == "NoIcons" else f"{s}:{i}").cast("string") for s, i in sets]), at + 1)
    return F.when(x.isNotNull(), chosen)


def with_extensions(rules_: DataFrame, extensions: DataFrame, by: list[str]) -> DataFrame:
    """Plain rules with what their extension says (``gradient``), and extension rules of their own after them."""
    said = extensions.select(*by, F.col("id").alias("ext_id"), "gradient")
    joined = rules_.join(said, [*by, "ext_id"], "left").withColumn("source", F.lit("plain"))
    own = extensions.join(rules_.select(*by, F.col("ext_id").alias("id")), [*by, "id"], "left_anti").withColumn("source", F.lit("extension"))
    return joined.unionByName(own.drop("id"), allowMissingColumns=True)


def block_stats(df: DataFrame, block: list[str], value: Column) -> DataFrame:
    return df.groupBy(*block).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def resolve(cell: list[Column], rules: list[tuple[int, Column, bool, dict[str, str]]], properties: list[str]) -> list[Column]:
    """First match per property by ascending priority.

    A rule is (priority, matched, stops, properties that it sets). A matching rule
    that stops hides all later ones.
    """
    ordered = sorted(rules, key=lambda r: r[0])
    out = []
    for name in properties:
        value, stopped = F.lit(None).cast("string"), F.lit(False)
        for _, matched, stops, sets in ordered:
            if name in sets:
                value = F.coalesce(value, F.when(matched & ~stopped, F.lit(sets[name])))
            if stops:
                stopped = stopped | matched
        out.append(value.alias(name))
    return [*cell, *out]


def duplicates(df: DataFrame, value: str, block: list[str]) -> DataFrame:
    """``is_duplicate`` of each row; values are counted before they meet the rows again."""
    counts = df.groupBy(*block, value).agg(F.count("*").alias("__n"))
    return df.join(counts, [*block, value], "left").withColumn("is_duplicate", F.coalesce(F.col("__n") > 1, F.lit(False))).drop("__n")
