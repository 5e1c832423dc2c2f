"""Rules whose formulas refer to cells relative to their block: the offsets are data, so one plan serves all rules of all books.

A formula is written for the first cell of its block (the anchor); for another
cell its relative rows and columns move along. Comparisons of two operands (a
reference, a number or a text in quotes) are read by one pattern and evaluated;
other formulas give their shifted references (``targets``) for the caller's own
expression, and no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from ..functions.values import Value, compared
from .grid import in_any

_REFERENCE = r"\$?[A-Za-z]{1,3}\$?[0-9]+"
_OPERAND = rf'({_REFERENCE}|"[^"]*"|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)'
_FIXED = r"^\$[A-Za-z]{1,3}\$[0-9]+$"
COMPARISON = rf"^\s*=?\s*{_OPERAND}\s*(<=|>=|<>|=|<|>)\s*{_OPERAND}\s*$"


def target(reference: Column, row: Column, col: Column, anchor_row: Column, anchor_col: Column) -> Column:
    """Cell (``row, col``) that a reference of the anchor's formula means for the cell at ``row, col``; null outside the sheet."""
    return _at(_moves(reference, anchor_row, anchor_col), row, col)


def _moves(reference: Column, anchor_row: Column, anchor_col: Column) -> Column:
    """What a reference means, apart from the cell: a row and a column, and how many times (once or not at all) the cell's own are added."""
    rows, cols = F.when(reference.rlike(r"\$[0-9]"), 0).otherwise(1), F.when(reference.rlike(r"^\$"), 0).otherwise(1)
    row, col = a1.row_number(reference) - rows * anchor_row, a1.column_number(reference) - cols * anchor_col
    return F.when(row.isNotNull() & col.isNotNull(), F.struct(row.alias("row"), rows.alias("rows"), col.alias("col"), cols.alias("cols")))


def _at(moves: Column, row: Column, col: Column) -> Column:
    at_row, at_col = moves["row"] + moves["rows"] * row, moves["col"] + moves["cols"] * col
    return F.when((at_row >= 1) & at_col.between(1, a1.MOST_COLUMNS), F.struct(at_row.alias("row"), at_col.alias("col")))


def blocks(rules: DataFrame) -> DataFrame:
    """Rules by rectangle (``top, left, bottom, right``) with the anchor of their block, the corner of its first rectangle."""
    placed = rules.withColumn("__boxes", a1.rectangles(F.col("sqref")))
    anchor = F.get("__boxes", F.lit(0))
    return placed.select(*rules.columns, anchor["top"].alias("anchor_row"), anchor["left"].alias("anchor_col"), F.inline("__boxes"))


def covered(cells: DataFrame, rules: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Cells (``row, col``) with the rules whose block they are in, once a rule; of the rules all columns but their ``sqref``."""
    return in_any(cells.select(*by, "row", "col"), blocks(rules).drop("sqref"), by, key)


def targets(cells: DataFrame, rules: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Every reference of every rule's formula for every cell of its block: ``ref`` as it is written, ``at`` the cell that it means."""
    found = covered(cells, rules, by, key).withColumn("ref", F.explode(F.array_distinct(F.regexp_extract_all("formula", F.lit(f"({_REFERENCE})"), 1))))
    return found.withColumn("at", target(F.col("ref"), F.col("row"), F.col("col"), F.col("anchor_row"), F.col("anchor_col")))


def matches(cells: DataFrame, rules: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Cells whose rule's comparison holds: ``by, key``, ``priority, stop_if_true`` and ``row, col``.

    ``cells``: ``row, col, v_num, v_text, v_bool``; ``rules``: ``key``, ``sqref, formula, priority, stop_if_true``. A cell that
    isn't there is nothing (0 or an empty text). Operands that are the same cell for a
    whole block are looked up once a rule, all others by one equi-join a side.
    """
    read = lambda i: F.regexp_extract("formula", COMPARISON, i)
    known = rules.withColumns({"__left": read(1), "__op": read(2), "__right": read(3)}).where("__op <> ''").drop("formula")
    values = cells.select(*by, F.col("row").alias("__r"), F.col("col").alias("__c"), F.struct("v_num", "v_text", "v_bool").alias("__v"))
    for side in ("__left", "__right"):
        operand = F.col(side)
        fixed = F.when(operand.rlike(_FIXED), F.struct(a1.row_number(operand).alias("row"), a1.column_number(operand).alias("col")))
        known = _looked_up(known.withColumns({"__at": fixed, f"{side}_is": _written(operand)}), values, by, f"{side}_is")
    boxes = blocks(known).drop("sqref")
    for side in ("__left", "__right"):
        operand = F.col(side)
        boxes = boxes.withColumn(side, F.when(operand.rlike(rf"^{_REFERENCE}$") & ~operand.rlike(_FIXED), _moves(operand, F.col("anchor_row"), F.col("anchor_col"))))
    found = in_any(cells.select(*by, "row", "col"), boxes.drop("anchor_row", "anchor_col"), by, key)
    for side in ("__left", "__right"):
        found = _looked_up(found.withColumn("__at", _at(F.col(side), F.col("row"), F.col("col"))).drop(side), values, by, f"{side}_is")
    left, right = (Value(*(F.col(f"{side}_is")[c] for c in ("v_num", "v_text", "v_bool"))) for side in ("__left", "__right"))
    return found.where(compared(left, F.col("__op"), right)).select(*by, *key, "priority", "stop_if_true", "row", "col")


def _written(operand: Column) -> Column:
    """An operand that is a number or a text in quotes, as the value of a cell."""
    text = F.when(operand.startswith('"'), F.regexp_replace(operand, '^"|"$', ""))
    return F.struct(operand.try_cast("double").alias("v_num"), text.alias("v_text"), F.lit(None).cast("boolean").alias("v_bool"))


def _looked_up(rows: DataFrame, values: DataFrame, by: list[str], name: str) -> DataFrame:
    """``name`` becomes the value of the cell ``__at`` of each row's sheet, where there is one; rows without one ask for cells above the sheet, which are spread and not there.

    Cells are never broadcast, however small Spark takes the packages to be that they come from; all lookups share one shuffle of them.
    """
    nowhere = -1 - F.pmod(F.xxhash64(*[c for c in ("row", "col") if c in rows.columns] or [F.lit(0)]), F.lit(1009)).cast("int")
    asks = rows.withColumns({"__r": F.coalesce("__at.row", nowhere), "__c": F.coalesce("__at.col", F.lit(0))}).drop("__at")
    return asks.join(values.hint("merge"), [*by, "__r", "__c"], "left").withColumn(name, F.coalesce("__v", name)).drop("__r", "__c", "__v")


def applied(matched: DataFrame, by: list[str]) -> DataFrame:
    """Matches that count: those of a cell up to the first, by priority, that stops; ``at`` is their place among them."""
    cell = Window.partitionBy(*by, "row", "col").orderBy("priority")  # one order for both, so rows are sorted once
    stop = F.min(F.when(F.col("stop_if_true"), F.col("priority"))).over(cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = matched.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("priority") <= F.col("__stop"))).drop("__stop")
    return kept.withColumn("at", F.row_number().over(cell))
