"""Lookups inside packages: relationships, names, themes, shape groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import relative_path

#: Theme slots of spreadsheets: the first two pairs are swapped against the theme's order.
THEME_ORDER = (1, 0, 3, 2)


def targets(references: DataFrame, relations: DataFrame, by: list[str], rid: str, folder: str) -> DataFrame:
    """``part``: the path that a relationship id leads to."""
    found = relations.select(*by, F.col("id").alias(rid), F.col("target").alias("__target"))
    return references.join(found, [*by, rid], "left").withColumn("part", F.when(F.col("__target").isNotNull(), relative_path(F.col(folder), F.col("__target")))).drop("__target")


def names_of_sheet(names: DataFrame, sheets: DataFrame, by: list[str]) -> DataFrame:
    """Defined names that a sheet sees: global and its own; of equal names the later holds."""
    seen = sheets.join(names, by).where(F.col("local_sheet").isNull() | (F.col("local_sheet") == F.col("sheet_idx")))
    return seen.groupBy(*by, "sheet_idx", F.lower("name").alias("name")).agg(F.max_by("formula", "ord").alias("formula"))


def theme_color(slots: Column, index: Column) -> Column:
    """Colour of a spreadsheet's theme index."""
    mapped = F.when(index < 4, F.element_at(F.array(*map(F.lit, THEME_ORDER)), F.least(index, F.lit(3)) + 1)).otherwise(index)
    return F.try_element_at(slots, mapped + 1)


def in_group(x: Column, child_offset: Column, child_size: Column, offset: Column, size: Column) -> Column:
    """A coordinate of a group's child in the group's own space."""
    return offset + F.coalesce(F.try_divide((x - child_offset) * size, child_size), F.lit(0.0))


def absolute_positions(shapes: DataFrame, groups: DataFrame) -> DataFrame:
    """Shapes' ``x`` and ``w`` moved up the tree of groups, one join a level of nesting, until no shape is in a group.

    ``groups``: ``group, parent, off, ext, ch_off, ch_ext``. Groups that hold each
    other are no tree and an error.
    """
    deepest = groups.count()
    for level in range(deepest + 1):
        if shapes.where(F.col("group").isNotNull()).isEmpty():
            break
        if level == deepest and not groups.join(shapes, "group", "left_semi").isEmpty():
            raise ValueError("groups hold each other")
        up = shapes.join(groups, "group", "left")
        inside = F.col("off").isNotNull()
        shapes = up.select(
            "shape",
            F.when(inside, in_group(F.col("x"), F.col("ch_off"), F.col("ch_ext"), F.col("off"), F.col("ext"))).otherwise(F.col("x")).alias("x"),
            F.when(inside, F.coalesce(F.try_divide(F.col("w") * F.col("ext"), F.col("ch_ext")), F.lit(0.0))).otherwise(F.col("w")).alias("w"),
            F.col("parent").alias("group"),
        )
    return shapes.drop("group")
