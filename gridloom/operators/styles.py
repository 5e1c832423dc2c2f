"""Layered lookups: defaults, inheritance chains, table bands, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lookup(rows: DataFrame, dimension: DataFrame, on: str, key: str, values: dict[str, Column]) -> DataFrame:
    """Left join of a dimension with a default for each looked-up value; Spark picks the join by size."""
    found = rows.join(dimension.withColumnRenamed(key, "__key"), F.col(on) == F.col("__key"), "left")
    return found.withColumns({n: F.coalesce(F.col(n), default) for n, default in values.items()}).drop("__key")


def with_format(cells: DataFrame, formats: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``values`` of the format that each cell's ``style_index`` names; where there is no such format, those of format 0."""
    own = formats.select(*by, "style_index", *[F.col(v).alias(f"__own_{v}") for v in values], F.lit(True).alias("__there"))
    zero = formats.where("style_index = 0").select(*by, *[F.col(v).alias(f"__zero_{v}") for v in values])
    joined = cells.join(own, [*by, "style_index"], "left").join(zero, by, "left")
    return joined.select(*cells.columns, *[F.when(F.col("__there"), F.col(f"__own_{v}")).otherwise(F.col(f"__zero_{v}")).alias(v) for v in values])


def resolve_chain(spark: SparkSession, styles: DataFrame, style: str, parent: str, properties: list[str]) -> DataFrame:
    """Each style's own or nearest inherited properties, by a recursive query; a chain ends where a style comes again.

    Chains beyond ``spark.sql.cteRecursionLevelLimit`` are an error, never cut.
    """
    own = styles.select(F.col(style).alias("style"), F.col(parent).alias("parent"), *properties)
    cols = ", ".join(f"s.{p}" for p in properties)
    nearest = ", ".join(f"min_by({p}, depth) filter (where {p} is not null) as {p}" for p in properties)
    return spark.sql(f"""
        with recursive chain as (
          select style as leaf, style, parent, 0 as depth, array(style) as seen, {", ".join(properties)} from {{own}}
          union all
          select c.leaf, s.style, s.parent, c.depth + 1, array_append(c.seen, s.style), {cols}
          from chain c join {{own}} s on c.parent = s.style where not array_contains(c.seen, s.style))
        select leaf as {style}, cast(max(depth) as int) as depth, {nearest} from chain group by leaf""", own=own)


def first_set(*layers: tuple[str, Column]) -> tuple[Column, Column]:
    """The first layer that is set, and its name."""
    return F.coalesce(*[c for _, c in layers]), F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in layers])


def inherit_edges(cells: DataFrame, own: str, neighbour: str, row_step: int, col_step: int, sheet: list[str]) -> DataFrame:
    """Cells with an unset edge take the facing edge of their sheet's neighbour at an offset; the grid is sparse, so it is a join."""
    other = cells.select(*sheet, (F.col("row") + row_step).alias("row"), (F.col("col") + col_step).alias("col"), F.col(neighbour).alias("__edge"))
    return cells.join(other, [*sheet, "row", "col"], "left").withColumn(own, F.coalesce(own, "__edge")).drop("__edge")


def table_band(row: Column, first: int, last: int, header: int, totals: int) -> Column:
    """Part of a table that a row belongs to: header, totals, band1 or band2."""
    data = row - first - header
    return F.when(row < first + header, "header").when(row > last - totals, "totals").when(data % 2 == 1, "band2").otherwise("band1")


def table_cell(own: Column, whole: Column, band: Column, row_end: Column, col_end: Column) -> Column:
    """A property of a deck's table cell: its own, else of the first or last column, of the first or last row, of its band, of the whole table."""
    return F.coalesce(own, col_end, row_end, band, whole)


def table_parts(row: Column, col: Column, rows: Column, cols: Column, flags: dict[str, bool]) -> dict[str, Column]:
    """Which parts of a table style a cell (0-based) is in, by the parts that are switched on: ``firstRow``, ``lastRow``, ``firstCol``, ``lastCol``, ``bandRow``."""
    on = lambda n: F.lit(flags.get(n, False))
    ends = F.when(on("firstRow") & (row == 0), "firstRow").when(on("lastRow") & (row == rows - 1), "lastRow")
    sides = F.when(on("firstCol") & (col == 0), "firstCol").when(on("lastCol") & (col == cols - 1), "lastCol")
    band = F.when(on("bandRow") & ends.isNull(), F.when((row - F.lit(int(flags.get("firstRow", False)))) % 2 == 0, "band1H").otherwise("band2H"))
    return {"ends": ends, "sides": sides, "band": band}


def merged_font(own: Column, rule: Column, table_bold: Column, names: tuple[str, ...] = ("bold", "italic", "underline", "strike")) -> list[Column]:
    """Toggles of a cell's font, a rule's and a table part's add up: each is set if any layer sets it."""
    set_ = lambda c: F.coalesce(c, F.lit(False))
    return [(set_(own[n]) | set_(rule[n]) | (set_(table_bold) if n == "bold" else F.lit(False))).alias(n) for n in names]


def dxf_fill(foreground: Column, background: Column) -> Column:
    """A differential fill with a background alone shows it as its foreground."""
    return F.coalesce(foreground, background)


def merged_border(merges: DataFrame, cells: DataFrame, sheet: list[str]) -> DataFrame:
    """``right`` and ``bottom`` edges of merged rectangles: of the cell at that end, then of the far corner, then of the anchor.

    ``merges``: ``sheet, top, left, bottom, right``; ``cells``: ``sheet, row, col, right_edge, bottom_edge``.
    Three equi-joins by position; a rectangle of one cell keeps its own edges.
    """
    def at(row: str, col: str, tag: str) -> DataFrame:
        return cells.select(*sheet, F.col("row").alias(row), F.col("col").alias(col), F.col("right_edge").alias(f"__r_{tag}"), F.col("bottom_edge").alias(f"__b_{tag}"))

    found = merges
    for row, col, tag in (("top", "right", "end"), ("bottom", "left", "foot"), ("bottom", "right", "corner"), ("top", "left", "anchor")):
        found = found.join(at(row, col, tag), [*sheet, row, col], "left")
    return found.select(
        *merges.columns,
        F.coalesce("__r_end", "__r_corner", "__r_anchor").alias("right_edge"),
        F.coalesce("__b_foot", "__b_corner", "__b_anchor").alias("bottom_edge"),
    )
