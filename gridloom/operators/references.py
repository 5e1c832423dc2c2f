"""References of formulas that stand for many cells: each is a join of the sheet with itself.

Cells are ``row, col`` and values, told apart by the columns of their ``sheet``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import in_rectangles

#: Cells of a range that the formula language reads, row by row.
MOST_CELLS = 4096


def relative(cells: DataFrame, sheet: list[str], value: str, row_step: int, col_step: int, name: str) -> DataFrame:
    """``name``: the value of the cell at an offset; null where there is none."""
    other = cells.select(*sheet, (F.col("row") - row_step).alias("row"), (F.col("col") - col_step).alias("col"), F.col(value).alias(name))
    return cells.join(other, [*sheet, "row", "col"], "left")


def absolute(cells: DataFrame, sheet: list[str], value: str, row: int, col: int, name: str) -> DataFrame:
    """``name``: the value of one cell of each sheet."""
    fixed = cells.where((F.col("row") == row) & (F.col("col") == col)).select(*sheet, F.col(value).alias(name))
    return cells.join(fixed, sheet, "left")


def running_range(cells: DataFrame, sheet: list[str], axis: str, first: int, last: int, amount: Column) -> DataFrame:
    """``amount``, an aggregate, over the cells of the same column (``axis`` row) or row that lie ``first`` to ``last`` steps on."""
    other = "col" if axis == "row" else "row"
    return cells.withColumn("amount", amount.over(Window.partitionBy(*sheet, other).orderBy(axis).rangeBetween(first, last)))


def relative_range(cells: DataFrame, sheet: list[str], value: str, box: tuple[int, int, int, int], amounts: dict[str, Column]) -> DataFrame:
    """Aggregates of ``value`` over the rectangle (top, left, bottom, right) around each cell, by a range join."""
    top, left, bottom, right = box
    asked = cells.select(*sheet, F.col("row").alias("at_row"), F.col("col").alias("at_col"), (F.col("row") + top).alias("top"), (F.col("col") + left).alias("left"), (F.col("row") + bottom).alias("bottom"), (F.col("col") + right).alias("right"))
    met = in_rectangles(cells.select(*sheet, "row", "col", value), asked, sheet)
    found = met.groupBy(*sheet, "at_row", "at_col").agg(*[c.alias(n) for n, c in amounts.items()])
    return cells.join(found.withColumnsRenamed({"at_row": "row", "at_col": "col"}), [*sheet, "row", "col"], "left")


def row_major(cells: DataFrame, sheet: list[str], first: tuple[int, int], last: tuple[int, int], most: int | None = MOST_CELLS) -> DataFrame:
    """Cells of a range with their ``position`` in it, row by row; those from ``most`` on are left out (none, if it is null)."""
    (r1, c1), (r2, c2) = first, last
    top, left, width = min(r1, r2), min(c1, c2), abs(c1 - c2) + 1
    inside = cells.where(F.col("row").between(top, max(r1, r2)) & F.col("col").between(left, left + width - 1))
    placed = inside.withColumn("position", (F.col("row") - top) * width + F.col("col") - left)
    return placed if most is None else placed.where(F.col("position") < most)
