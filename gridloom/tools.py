"""The query tools on office files, over one file or a folder of millions: each returns a table with ``file_path``.

Sheets are named, or given by their 0-based index; searches are case-insensitive
substrings. A file that can't be read gives no rows here; ``unreadable`` lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.a1 import column_number, row_number
from .functions.numbers import number_text
from .operators import documents, grid
from .sources import presentations, spreadsheets, wordprocessing


def _fine(df: DataFrame) -> DataFrame:
    return df.where("error is null").drop("error")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, error`` of the packages that can't be opened."""
    kinds = (spreadsheets.sheets, wordprocessing.runs, presentations.slides)
    found = [f(spark, path).where("error is not null").select("file_path", "error") for f in kinds]
    return found[0].union(found[1]).union(found[2])


def shown() -> Column:
    """A cell's value as text."""
    return F.coalesce(number_text(F.col("v_num")), "v_text", F.col("v_bool").cast("string"), "v_err", F.lit(""))


def _matches(hits: DataFrame) -> DataFrame:
    """``match_count``: hits of the same file, which one task has read already; no file is read twice."""
    return hits.withColumn("match_count", F.count("*").over(Window.partitionBy("file_path")))


def _sheet_cells(spark: SparkSession, path: str, sheet: str | None) -> DataFrame:
    cells = spreadsheets.cells(spark, path)
    chosen = cells if sheet is None else cells.where(spreadsheets.is_sheet(sheet))
    return chosen.withColumn("value", shown())


def xlsx_parse(spark: SparkSession, path: str) -> DataFrame:
    return _fine(spreadsheets.sheets(spark, path))


def xlsx_get_sheet_names(spark: SparkSession, path: str) -> DataFrame:
    return xlsx_parse(spark, path).select("file_path", "sheet_idx", "name")


def xlsx_missing_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """Files that lack a sheet, with the ``available`` ones in order."""
    sheets = xlsx_parse(spark, path)
    held = F.array_sort(F.collect_list(F.struct("sheet_idx", "name")))
    found = sheets.groupBy("file_path").agg(F.transform(held, lambda s: s["name"]).alias("available"), F.bool_or(spreadsheets.is_sheet(sheet, "name")).alias("__there"))
    return found.where(~F.col("__there")).drop("__there")


def xlsx_get_sheet_dimensions(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """``max_row, max_col, max_col_letter``; zeros for a sheet without cells."""
    chosen = spreadsheets.resolve_sheet(xlsx_parse(spark, path), sheet).select("file_path", "sheet_idx", F.col("name").alias("sheet"))
    cells = spreadsheets.cells(spark, path).select("file_path", "sheet_idx", "row", "col")
    return grid.dimensions(chosen.join(cells, ["file_path", "sheet_idx"], "left"), ["file_path", "sheet"])


def xlsx_get_cell_range(spark: SparkSession, path: str, sheet: str, area: str) -> DataFrame:
    """Cells of a range such as ``A1:C10``, corners in any order."""
    first, last = area.split(":")[0], area.split(":")[-1]
    ends = tuple(spark.range(1).select(row_number(F.lit(first)), column_number(F.lit(first)), row_number(F.lit(last)), column_number(F.lit(last))).first())
    if None in ends:
        raise ValueError(f"no range: {area}")
    found = grid.cell_range(_sheet_cells(spark, path, sheet), ends[:2], ends[2:])
    return found.select("file_path", "sheet", "row", "col", "ref", "v_type", "value", "formula")


def xlsx_get_formulas(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    return spreadsheets.formulas(_sheet_cells(spark, path, sheet)).select("file_path", "sheet", "ref", "formula", "value")


def xlsx_search_cells(spark: SparkSession, path: str, query: str, sheet: str | None = None) -> DataFrame:
    """Cells whose value or formula holds the query, on one sheet or all."""
    cells = _sheet_cells(spark, path, sheet)
    hits = cells.where(grid.contains(F.col("value"), query) | grid.contains(F.col("formula"), query))
    return _matches(hits.select("file_path", "sheet", "ref", "value", "formula"))


def _paragraph_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each paragraph of a document's body and of its tables' cells; hidden runs are left out."""
    runs = _fine(wordprocessing.runs(spark, path))
    keys = ["file_path", "block", "tbl", "trow", "tcol", "part"]
    seen = F.when((F.col("kind") == "text") & ~F.coalesce("vanish", F.lit(False)), F.col("text"))
    held = F.array_sort(F.collect_list(F.struct("run", F.coalesce(seen, F.lit("")).alias("text"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(held, lambda r: r["text"]), "").alias("text"), F.first("style").alias("style"))


def docx_extract_text(spark: SparkSession, path: str) -> DataFrame:
    """``text``: a line for each paragraph and table row; a row's cells are parted by tabs."""
    parts = _paragraph_texts(spark, path)
    cells = documents.joined_text(parts.where("tbl is not null"), ["file_path", "block", "trow", "tcol"], ["part"], F.col("text"), "")
    rows = documents.joined_text(cells, ["file_path", "block", "trow"], ["tcol"], F.col("text"), "\t")
    lines = parts.where("tbl is null").select("file_path", "block", F.lit(0).alias("trow"), "text").unionByName(rows)
    return documents.joined_text(lines, ["file_path"], ["block", "trow"], F.concat("text", F.lit("\n")), "")


def docx_get_structure(spark: SparkSession, path: str) -> DataFrame:
    """Body blocks in order: paragraphs with style and text, tables with the rows and the first row's cells."""
    parts = _paragraph_texts(spark, path)
    tables = parts.where("tbl is not null").groupBy("file_path", "block").agg((F.max("trow") + 1).alias("rows"), F.count_distinct(F.when(F.col("trow") == 0, F.col("tcol"))).cast("int").alias("cols"))
    return parts.where("tbl is null").select("file_path", "block", F.lit("paragraph").alias("type"), "style", F.trim("text").alias("text")).unionByName(tables.withColumn("type", F.lit("table")), allowMissingColumns=True)


def docx_get_tables(spark: SparkSession, path: str) -> DataFrame:
    return documents.table_matrices(_fine(wordprocessing.runs(spark, path)), ["file_path"])


def docx_search_text(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Paragraphs (``block``) and table cells (``block, trow, tcol``) that hold the query."""
    parts = _paragraph_texts(spark, path)
    cells = documents.joined_text(parts.where("tbl is not null"), ["file_path", "block", "trow", "tcol"], ["part"], F.col("text"))
    texts = parts.where("tbl is null").select("file_path", "block", F.lit("paragraph").alias("type"), "text").unionByName(cells.withColumn("type", F.lit("cell")), allowMissingColumns=True)
    return _matches(texts.where(grid.contains(F.col("text"), query)))


def _shape_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each shape or table of a slide; a table's cells are parted by tabs, its rows by line feeds."""
    parts = _fine(presentations.paragraphs(spark, path))
    shape = ["file_path", "slide", "shape"]
    plain = documents.joined_text(parts.where("trow is null"), shape, ["ord"], F.col("text"))
    cells = documents.joined_text(parts.where("trow is not null"), [*shape, "trow", "tcol"], ["ord"], F.col("text"), "")
    rows = documents.joined_text(documents.joined_text(cells, [*shape, "trow"], ["tcol"], F.col("text"), "\t"), shape, ["trow"], F.col("text"))
    about = parts.groupBy(*shape).agg(F.first("name").alias("name"), F.first("placeholder").alias("placeholder"))
    return plain.withColumn("type", F.lit("shape")).unionByName(rows.withColumn("type", F.lit("table"))).join(about, shape)


def pptx_get_slides(spark: SparkSession, path: str) -> DataFrame:
    """Every slide with its title, null without one, and ``slide_count``."""
    slides = _fine(presentations.slides(spark, path)).select("file_path", "slide")
    titles = presentations.titles(_fine(presentations.paragraphs(spark, path)))
    return slides.join(titles, ["file_path", "slide"], "left").withColumn("slide_count", F.count("*").over(Window.partitionBy("file_path")))


def pptx_extract_text(spark: SparkSession, path: str, slide_index: int | None = None) -> DataFrame:
    """``text``: all slides below headings, or one slide's text."""
    texts = _shape_texts(spark, path)
    if slide_index is not None:
        return documents.joined_text(texts.where(F.col("slide") == slide_index), ["file_path", "slide"], ["shape"], F.col("text"))
    slides = documents.joined_text(texts, ["file_path", "slide"], ["shape"], F.col("text"))
    headed = F.concat(F.lit("=== Slide "), (F.col("slide") + 1).cast("string"), F.lit(" ===\n"), F.col("text"))
    return documents.joined_text(slides, ["file_path"], ["slide"], headed, "\n\n")


def pptx_get_slide_structure(spark: SparkSession, path: str, slide_index: int) -> DataFrame:
    """Shapes of a slide in their order, with place and size in English metric units."""
    slides = _fine(presentations.slides(spark, path)).where(F.col("slide") == slide_index)
    found = slides.join(_fine(presentations.elements(spark, path)), ["file_path", "part"])
    return found.select("file_path", "slide", "shape", "kind", "name", "placeholder", "x", "y", "w", "h")


def pptx_search_text(spark: SparkSession, path: str, query: str) -> DataFrame:
    hits = _shape_texts(spark, path).where(grid.contains(F.col("text"), query))
    return _matches(hits.select("file_path", "slide", (F.col("slide") + 1).alias("slide_number"), "type", "name", "placeholder", F.trim("text").alias("text")))
