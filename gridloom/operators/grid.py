"""Sheets as sparse cells: ``(row, col, v_num, v_text, formula)`` rows and the queries on them.

Any table becomes a sheet with ``as_cells``. Rectangles are joined by range,
offsets are running sums within a sheet, and every operator takes the columns
that tell sheets apart, so work is split by sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.a1 import a1, column_letters
from .joins import as_of

#: Rows and columns of a tile in range joins.
TILE = 256


def as_cells(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """A cell for each row and column; the row's ``key`` stays in place of a row number, so nothing is sorted."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    number = lambda c: kinds[c] in ("double", "float", "integer", "long", "short", "decimal")
    cells = F.array(*[
        F.struct(F.lit(i + 1).alias("col"), (F.col(c).cast("double") if number(c) else F.lit(None).cast("double")).alias("v_num"), (F.lit(None).cast("string") if number(c) else F.col(c).cast("string")).alias("v_text"))
        for i, c in enumerate(columns)
    ])
    return df.select(*key, F.inline(cells))


def numbered(df: DataFrame, order: list[str], sheet: list[str]) -> DataFrame:
    """``row``: 1-based position in the sheet. A sheet has 1,048,576 rows at most by its format, which bounds a window."""
    return df.withColumn("row", F.row_number().over(Window.partitionBy(*sheet).orderBy(*order)))


def first_rows(df: DataFrame, order: list[str], last: int) -> DataFrame:
    """Rows 1 to ``last`` of a table as a sheet, numbered: partitions hand on no more than that many rows each."""
    return df.orderBy(*order).limit(last).withColumn("row", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def cell_range(cells: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Cells between two (row, col) corners, given in any order."""
    (r1, c1), (r2, c2) = first, last
    return cells.where(F.col("row").between(min(r1, r2), max(r1, r2)) & F.col("col").between(min(c1, c2), max(c1, c2))).withColumn("ref", a1(F.col("row"), F.col("col")))


def dimensions(cells: DataFrame, sheet: list[str]) -> DataFrame:
    extent = cells.groupBy(*sheet).agg(F.coalesce(F.max("row"), F.lit(0)).alias("max_row"), F.coalesce(F.max("col"), F.lit(0)).alias("max_col"))
    return extent.withColumn("max_col_letter", column_letters(F.col("max_col")))


def contains(text: Column, query: str) -> Column:
    """Case-insensitive substring; the empty query matches all."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(query.lower()))


def tsv(cells: DataFrame, top: int, left: int, bottom: int, right: int, sheet: list[str]) -> DataFrame:
    """A rectangle as tab-separated lines; missing cells are empty."""
    inside = cells.where(F.col("row").between(top, bottom) & F.col("col").between(left, right))
    lines = inside.groupBy(*sheet, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("by"))
    line = F.array_join(F.transform(F.sequence(F.lit(left), F.lit(right)), lambda c: F.coalesce(F.element_at("by", c), F.lit(""))), "\t")
    sheets = lines.groupBy(*sheet).agg(F.map_from_entries(F.collect_list(F.struct("row", line.alias("line")))).alias("lines"))
    empty = "\t" * (right - left)
    return sheets.select(*sheet, F.array_join(F.transform(F.sequence(F.lit(top), F.lit(bottom)), lambda r: F.coalesce(F.element_at("lines", r), F.lit(empty))), "\n").alias("tsv"))


def selection(mode: str, anchor: tuple[int, int], active: tuple[int, int], extent: tuple[int, int]) -> tuple[int, int, int, int]:
    """Rectangle (top, left, bottom, right) of a selection of ``cells``, whole ``rows``, whole ``cols`` or ``all`` of a sheet with ``extent`` rows and columns."""
    (r1, c1), (r2, c2), (rows, cols) = anchor, active, extent
    top, bottom = (1, rows) if mode in ("cols", "all") else (min(r1, r2), max(r1, r2))
    left, right = (1, cols) if mode in ("rows", "all") else (min(c1, c2), max(c1, c2))
    return top, left, bottom, right


def _tiles(first: str, last: str) -> Column:
    return F.sequence(F.floor(F.col(first) / TILE), F.floor(F.col(last) / TILE))


def in_rectangles(cells: DataFrame, rectangles: DataFrame, sheet: list[str], how: str = "inner") -> DataFrame:
    """Cells with the rectangles ``(top, left, bottom, right)`` of their sheet that hold them: an equi-join on tiles of ``TILE`` rows and columns, then the exact bounds."""
    tiled = rectangles.withColumn("__tr", F.explode(_tiles("top", "bottom"))).withColumn("__tc", F.explode(_tiles("left", "right")))
    placed = cells.withColumn("__tr", F.floor(F.col("row") / TILE)).withColumn("__tc", F.floor(F.col("col") / TILE)).alias("cell")
    same = [F.col(f"cell.{n}") == F.col(f"box.{n}") for n in (*sheet, "__tr", "__tc")]
    inside = F.col("cell.row").between(F.col("box.top"), F.col("box.bottom")) & F.col("cell.col").between(F.col("box.left"), F.col("box.right"))
    found = placed.join(tiled.alias("box"), [*same, inside], how)
    return found.select(*[F.col(f"cell.`{n}`") for n in cells.columns], *[F.col(f"box.`{n}`") for n in rectangles.columns if n not in sheet])


def in_any(cells: DataFrame, rectangles: DataFrame, sheet: list[str], key: list[str]) -> DataFrame:
    """Cells with each ``key`` of their sheet that has them in one of its rectangles, once a key; cells that are there twice count once.

    A key comes to a tile once, with all its rectangles there, and cells are told
    apart in the order in which they meet it: what the join makes needs no second look.
    Neither side is broadcast: sizes guessed from packed files tell nothing of the cells in them.
    """
    box, tile = ["top", "left", "bottom", "right"], [*sheet, "__tr", "__tc"]
    own = [c for c in rectangles.columns if c not in (*sheet, *key, *box)]
    tiled = rectangles.withColumn("__tr", F.explode(_tiles("top", "bottom"))).withColumn("__tc", F.explode(_tiles("left", "right")))
    held = tiled.groupBy(*tile, *key).agg(F.any_value(F.struct(*own)).alias("__own"), F.collect_set(F.struct(*box)).alias("__boxes"))
    placed = cells.withColumn("__tr", F.floor(F.col("row") / TILE)).withColumn("__tc", F.floor(F.col("col") / TILE))
    again = F.row_number().over(Window.partitionBy(*tile, "row", "col").orderBy("row"))
    found = placed.repartition(*tile).withColumn("__again", again).where("__again = 1").drop("__again").join(held.hint("merge"), tile)
    inside = F.exists("__boxes", lambda b: F.col("row").between(b["top"], b["bottom"]) & F.col("col").between(b["left"], b["right"]))
    return found.where(inside).select(*cells.columns, *key, *[F.col("__own")[c].alias(c) for c in own])


def merge_cover(cells: DataFrame, merges: DataFrame, sheet: list[str]) -> DataFrame:
    """``cover``: anchor, covered or plain, by the merged rectangles of the cells' sheet."""
    found = in_rectangles(cells, merges.select(*sheet, "top", "left", "bottom", "right"), sheet, "left")
    anchor = (F.col("row") == F.col("top")) & (F.col("col") == F.col("left"))
    return found.withColumn("cover", F.when(anchor, "anchor").when(~anchor, "covered").otherwise("plain")).drop("top", "left", "bottom", "right")


def offsets(sizes: DataFrame, order: list[str], size: Column, sheet: list[str]) -> DataFrame:
    """``offset``: where an item starts, the sum of the sizes before it."""
    before = Window.partitionBy(*sheet).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def hit_test(placed: DataFrame, size: str, points: DataFrame, sheet: list[str]) -> DataFrame:
    """The item of its sheet that each point ``(x)`` falls into: the last one that starts at or before it, if it reaches so far."""
    items = placed.where(F.col(size) > 0)
    found = as_of(points, items, sheet, "x", "offset", [c for c in placed.columns if c not in sheet])
    return found.where(F.col("x") < F.col("offset") + F.col(size))


def islands(rows: DataFrame, sheet: list[str], order: list[str], value: Column) -> DataFrame:
    """``island``: runs of equal neighbours, numbered from 1."""
    w = Window.partitionBy(*sheet).orderBy(*order)
    changed = rows.withColumn("__new", F.when(value.eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    return changed.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
