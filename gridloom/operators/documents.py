"""Documents and decks: text extraction, search, structure, list counters, margins, pages.

State runs within one document; documents are independent and split the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined_text(parts: DataFrame, document: list[str], order: list[str], text: Column, between: str = "\n") -> DataFrame:
    """Texts of a document in order."""
    held = F.array_sort(F.collect_list(F.struct(*order, text.alias("__text"))))
    return parts.groupBy(*document).agg(F.array_join(F.transform(held, lambda p: p["__text"]), between).alias("text"))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a text as ``ord, line``."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("ord", "line"))


def list_counters(items: DataFrame, document: list[str], order: str, level: str, start: int | Column = 1, deepest: int | None = None) -> DataFrame:
    """``counter`` of each list item: levels count on their own, from ``start`` (a column for starts of levels), and restart after a shallower item.

    Levels are 0 to ``deepest`` - 1; the items' own deepest is looked up if it isn't given.
    """
    if deepest is None:
        deepest = (items.agg(F.max(level)).collect()[0][0] or 0) + 1
    start = start if isinstance(start, Column) else F.lit(start)
    w = Window.partitionBy(*document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # How many shallower items an item has had: the group in which its level counts.
    groups = F.coalesce(*[F.when(F.col(level) == i, F.count_if(F.col(level) < i).over(w)) for i in range(deepest)], F.lit(0))
    grouped = items.withColumn("__group", groups)
    inner = Window.partitionBy(*document, level, "__group").orderBy(order)
    return grouped.withColumn("counter", start + F.row_number().over(inner) - 1).drop("__group")


def auto_numbers(items: DataFrame, document: list[str], order: str, level: str, numbered: Column) -> DataFrame:
    """``number`` of automatically numbered paragraphs; any other paragraph clears all levels."""
    w = Window.partitionBy(*document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = items.withColumn("__island", F.count_if(~numbered).over(w)).withColumn("__numbered", numbered)
    inner = Window.partitionBy(*document, "__island", "__numbered", level).orderBy(order)
    return marked.withColumn("number", F.when(F.col("__numbered"), F.row_number().over(inner))).drop("__island", "__numbered")


def margin_gaps(items: DataFrame, document: list[str], order: str, before: Column, after: Column, style: Column | None = None, contextual: Column | None = None) -> DataFrame:
    """``gap`` above a paragraph: the larger of the last one's space after and its own space before.

    Between paragraphs of one ``style``, those that are ``contextual`` give no space.
    """
    w = Window.partitionBy(*document).orderBy(order)
    above, below = F.coalesce(F.lag(after).over(w), F.lit(0)), before
    if contextual is not None:
        alike = style.eqNullSafe(F.lag(style).over(w)) & (F.row_number().over(w) > 1)
        above = F.when(alike & F.coalesce(F.lag(contextual).over(w), F.lit(False)), 0).otherwise(above)
        below = F.when(alike & contextual, 0).otherwise(below)
    return items.withColumn("gap", F.greatest(above, below))


def pages(items: DataFrame, document: list[str], order: str, breaks: Column) -> DataFrame:
    """``page`` by explicit breaks; a break opens the page that it stands on."""
    w = Window.partitionBy(*document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("page", F.count_if(breaks).over(w) + 1)


def table_extent(cells: DataFrame, table: list[str], row: str, width: Column, height: Column, fixed: Column, room: float) -> DataFrame:
    """``width`` and ``height`` of tables: columns' widths added up and shrunk to ``room``, rows as high as ``fixed`` says or their highest cell, 10 at least."""
    columns = cells.groupBy(*table, "tcol").agg(F.max(width).alias("w")).groupBy(*table).agg(F.least(F.sum("w"), F.lit(float(room))).alias("width"))
    rows = cells.groupBy(*table, row).agg(F.coalesce(F.max(fixed), F.greatest(F.lit(10.0), F.max(height))).alias("h"))
    return columns.join(rows.groupBy(*table).agg(F.sum("h").alias("height")), table)


def header_kind(page: Column, has_first: bool, has_even: bool) -> Column:
    """Header of a 1-based page: first, even or default."""
    return F.when((page == 1) & F.lit(has_first), "first").when((page % 2 == 0) & F.lit(has_even), "even").otherwise("default")


def field_results(runs: DataFrame, document: list[str], order: str, kind: str, text: str) -> DataFrame:
    """Complex fields ``begin``, code, ``separate``, result, ``end``: ``part`` of each run (code, result or body) and its ``field``."""
    w = Window.partitionBy(*document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    begun, parted, ended = (F.count_if(F.col(kind) == k).over(w) for k in ("begin", "separate", "end"))
    marked = runs.withColumn("field", begun).withColumn("__open", begun - ended).withColumn("__result", parted - ended)
    part = F.when(F.col("__open") <= 0, "body").when(F.col("__result") >= F.col("__open"), "result").otherwise("code")
    return marked.withColumn("part", part).where(F.col(kind) == "text").drop("__open", "__result")


def table_matrices(runs: DataFrame, document: list[str], table: str = "tbl") -> DataFrame:
    """Tables as arrays of rows of cell texts; a cell's paragraphs are joined by line feeds."""
    paragraphs_ = joined_text(runs.where(F.col(table).isNotNull()), [*document, table, "trow", "tcol", "part"], ["run"], F.coalesce("text", F.lit("")), "")
    cells = joined_text(paragraphs_, [*document, table, "trow", "tcol"], ["part"], F.col("text"))
    rows = cells.groupBy(*document, table, "trow").agg(F.transform(F.array_sort(F.collect_list(F.struct("tcol", "text"))), lambda c: c["text"]).alias("cells"))
    return rows.groupBy(*document, table).agg(F.transform(F.array_sort(F.collect_list(F.struct("trow", "cells"))), lambda r: r["cells"]).alias("rows"))
