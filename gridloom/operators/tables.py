"""Tables inside office files: where cells with spans lie, and what a table's style lays over its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1, table_styles
from .grid import in_rectangles


def placed(cells: DataFrame, by: list[str]) -> DataFrame:
    """Deck cells with their rectangle of the grid (0-based, ``top, left, bottom, right``), position and size; cells under another's span are left out.

    Spans that reach beyond the table end with it. A cell that says that it is
    merged is no cell of its own, nor is one that lies in a rectangle that began
    before it in reading order. A table's sizes and spans are gathered once, a row a
    table, and joined to its cells.
    """
    merged = F.col("h_merge") | F.col("v_merge")
    box = F.struct(
        F.col("row").alias("top"), F.col("col").alias("left"),
        (F.least(F.col("row") + F.greatest("row_span", F.lit(1)), F.col("rows")) - 1).alias("bottom"), (F.least(F.col("col") + F.greatest("grid_span", F.lit(1)), F.greatest("cols", F.col("col") + 1)) - 1).alias("right"),
    )
    held = cells.withColumn("__box", box)
    wide = ~merged & ((F.col("__box.bottom") > F.col("row")) | (F.col("__box.right") > F.col("col")))
    whole = held.groupBy(*by).agg(
        F.collect_list(F.when(wide, F.col("__box"))).alias("__wide"), F.map_from_entries(F.collect_set(F.struct("row", "height"))).alias("__heights"),
        F.map_from_entries(F.collect_set(F.struct("col", "width"))).alias("__widths"),
    )
    inside = lambda w: F.col("row").between(w["top"], w["bottom"]) & F.col("col").between(w["left"], w["right"]) & (F.struct(w["top"], w["left"]) < F.struct("row", "col"))
    shown = held.where(~merged).join(whole, by).where(~F.exists("__wide", inside))
    ahead = lambda sizes, n: F.aggregate(F.map_values(F.map_filter(sizes, lambda k, _: k < n)), F.lit(0).cast("long"), lambda a, x: a + x)
    x, y = ahead("__widths", F.col("__box.left")), ahead("__heights", F.col("__box.top"))
    right, bottom = ahead("__widths", F.col("__box.right") + 1), ahead("__heights", F.col("__box.bottom") + 1)
    return shown.select(*cells.columns, "__box.*", x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def word_placed(cells: DataFrame, by: list[str]) -> DataFrame:
    """Document cells with their rectangle: ``span`` columns each, and ``merge`` (restart, continue or null) down the rows.

    A cell goes on with the one above when it says so and the row above has a
    cell of the merge at the same grid column; otherwise it begins one.
    """
    before = Window.partitionBy(*by, "row").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    flat = cells.withColumn("left", (F.coalesce("skipped", F.lit(0)) + F.coalesce(F.sum("span").over(before), F.lit(0))).cast("int"))
    down = Window.partitionBy(*by, "left").orderBy("row")
    joins = (F.col("merge") == "continue") & (F.lag("row").over(down) == F.col("row") - 1) & F.lag("merge").over(down).isNotNull()
    numbered = flat.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(down))
    whole = Window.partitionBy(*by, "left", "__run")
    sized = numbered.withColumn("bottom", F.max("row").over(whole)).where("__new = 1")
    return sized.withColumn("top", F.col("row")).withColumn("right", F.col("left") + F.col("span") - 1).drop("__new", "__run")


def cell_fills(cells: DataFrame, themes: DataFrame, own_styles: DataFrame) -> DataFrame:
    """``fill`` of placed deck cells: their own, else of the last or first column, the last or first row, the band, the whole table.

    Styles are the deck's own, else those of the built-in catalogue in the colours
    of the deck's theme; with a style that neither has, the first row is in the first accent.
    """
    spark = cells.sparkSession
    first = themes.where("error is null and kind = 'color' and value is not null")
    theme = first.groupBy("file_path", "part").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("theme")).groupBy("file_path").agg(F.min_by("theme", "part").alias("theme"))
    used = cells.where("style is not null").select("file_path", "style").distinct()
    mine = own_styles.where("error is null").select("file_path", "style", "part", "slot", "rgb", "change", "percent")
    built_in = spark.createDataFrame(table_styles.catalogue(), table_styles.CATALOGUE).select("style", "part", "slot", F.lit(None).cast("string").alias("rgb"), "change", "percent")
    named = mine.unionByName(used.join(mine.select("file_path", "style").distinct(), ["file_path", "style"], "left_anti").join(built_in, "style"))
    plain = F.coalesce(F.concat(F.lit("#"), F.upper("rgb")), table_styles.themed(F.col("theme"), F.col("slot")))
    # a row a part, by an aggregate: its colour is a column that the changes below can use many times
    colored = named.join(theme, "file_path", "left").groupBy("file_path", "style", "part").agg(F.first(plain).alias("plain"), F.first("change").alias("change"), F.first("percent").alias("percent"))
    colored = colored.withColumn("color", table_styles.changed(F.col("plain"), F.col("change"), F.col("percent")))
    parts = colored.groupBy("file_path", "style").agg(F.map_from_entries(F.collect_list(F.struct("part", "color"))).alias("parts"))
    joined = cells.join(parts, ["file_path", "style"], "left").join(theme, "file_path", "left")
    part = lambda n: F.try_element_at("parts", F.lit(n))
    header = F.col("first_row") & (F.col("row") == 0)
    band = (F.col("row") - F.col("first_row").cast("int")) % 2 == 0
    layers = [
        F.concat(F.lit("#"), F.upper("own_rgb")), F.when(F.col("own_slot").isNotNull(), table_styles.themed(F.col("theme"), F.col("own_slot"))),
        F.when(F.col("last_col") & (F.col("col") == F.col("cols") - 1), part("lastCol")), F.when(F.col("first_col") & (F.col("col") == 0), part("firstCol")),
        F.when(F.col("last_row") & (F.col("row") == F.col("rows") - 1), part("lastRow")), F.when(header, part("firstRow")),
        F.when(F.col("band_row") & ~header, F.when(band, part("band1H")).otherwise(part("band2H"))), part("wholeTbl"),
        F.when(F.col("parts").isNull() & header, F.concat(F.lit("#"), F.try_element_at("theme", F.lit("accent1")))),
    ]
    return joined.withColumn("fill", F.coalesce(*layers)).drop("parts", "theme")


def overlay(cells: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """What the tables of a sheet lay over its cells: ``part`` (header, totals, band1, band2), ends and edges. Where tables overlap, the later one holds.

    ``tables``: ``ord, ref, style, header_rows, totals_rows, row_stripes, first_column, last_column``; tables without a style lay nothing.
    Cells by position are joined to rectangles; cells without a table are kept with nulls.
    """
    area = F.split("ref", ":")
    corner = lambda i: F.get(area, F.when(F.size(area) > i, i).otherwise(0))
    boxes = tables.where(F.col("style").isNotNull() & (F.col("style") != "")).select(
        *by, F.col("ord").alias("__ord"), F.col("name").alias("table"), F.col("style").alias("table_style"), "header_rows", "totals_rows", "row_stripes", "first_column", "last_column",
        a1.row_number(corner(0)).alias("top"), a1.column_number(corner(0)).alias("left"), a1.row_number(corner(1)).alias("bottom"), a1.column_number(corner(1)).alias("right"),
    )
    found = in_rectangles(cells, boxes, by, "left")
    latest = Window.partitionBy(*by, "row", "col").orderBy(F.col("__ord").desc_nulls_last())
    found = found.withColumn("__at", F.row_number().over(latest)).where("__at = 1")
    data = F.col("row") - F.col("top") - F.col("header_rows")
    inside = F.col("top").isNotNull()
    header, totals = (F.col("header_rows") > 0) & (data < 0), (F.col("totals_rows") > 0) & (F.col("row") > F.col("bottom") - F.col("totals_rows"))
    part = F.when(header, "header").when(totals, "totals").when(F.col("row_stripes") & (data % 2 == 1), "band2").otherwise("band1")
    at = lambda flag, edge: F.when(inside, F.col(flag) & (F.col("col") == F.col(edge)))
    return found.select(
        *cells.columns, "table", "table_style", F.when(inside, part).alias("part"), at("first_column", "left").alias("is_first_col"), at("last_column", "right").alias("is_last_col"),
        F.when(inside, F.col("row") == F.col("top")).alias("is_top"), F.when(inside, F.col("row") == F.col("bottom")).alias("is_bottom"),
    )


def accent_slot(style: Column) -> Column:
    """Theme slot of a built-in style of spreadsheets: styles go round in sevens, the first of each without an accent; null then, and for other names."""
    number = F.regexp_extract(style, r"^TableStyle\D*(\d+)", 1).try_cast("int")
    slot = (number - 1) % 7
    return F.when((number > 0) & (slot > 0), F.concat(F.lit("accent"), slot.cast("string")))


def style_formats(overlaid: DataFrame, styles: DataFrame) -> DataFrame:
    """``dxf_id`` of the part of a workbook's own table style that a cell is in, else of the whole table."""
    element = F.create_map(*[F.lit(x) for x in ("header", "headerRow", "totals", "totalRow", "band1", "firstRowStripe", "band2", "secondRowStripe")])
    named = styles.where("error is null").groupBy("file_path", F.col("name").alias("table_style")).agg(F.map_from_entries(F.collect_list(F.struct("element", "dxf_id"))).alias("__elements"))
    joined = overlaid.join(named, ["file_path", "table_style"], "left")
    return joined.withColumn("dxf_id", F.coalesce(F.try_element_at("__elements", F.element_at(element, F.col("part"))), F.try_element_at("__elements", F.lit("wholeTable")))).drop("__elements")
