"""Spreadsheets: typed cells, and the tables that they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.a1 import column_number, row_number
from ..operators.grid import in_rectangles
from .packages import FRAME, Package, below, child, frame, local, read_packages, shape_tree
from .sheet_parts import STRINGS, WORKBOOK, listed, of_kind, sheet_parts, strings

def sheets(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``file_path, error, sheet_idx, name, part``."""
    return read_packages(spark, path, "*.xlsx", listed, "sheet_idx int, name string, part string")


def shared_strings(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return read_packages(spark, path, "*.xlsx", strings, "idx int, text string")


def _string_runs(package: Package):
    for i, item in enumerate(package.elements(STRINGS, "si")):
        for k, run in enumerate(e for e in item if local(e) in ("r", "t")):
            props, text = child(run, "rPr"), run if local(run) == "t" else child(run, "t")
            font = next((e for e in props if local(e) in ("rFont", "name")), None) if props is not None else None
            size = child(props, "sz") if props is not None else None
            yield i, k, text.text or "" if text is not None else "", *(_toggles(props)), font.get("val") if font is not None else None, float(size.get("val")) if size is not None else None, *_color(child(props, "color") if props is not None else None)


def string_runs(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Runs of shared strings with their fonts; a plain string is one run."""
    return read_packages(spark, path, "*.xlsx", _string_runs, f"idx int, run int, text string, bold boolean, italic boolean, underline boolean, strike boolean, font string, size double, {COLOR}")


#: Columns of a colour: as it stands, or a theme's or the palette's, and lighter or darker by a tint.
COLOR = "rgb string, theme int, indexed int, tint double"


def _color(e) -> tuple:
    if e is None:
        return (None,) * 4
    whole = lambda n: int(e.get(n)) if e.get(n) else None
    return e.get("rgb"), whole("theme"), whole("indexed"), float(e.get("tint")) if e.get("tint") else None


def _toggles(font) -> list[bool | None]:
    return [None if font is None or (e := child(font, n)) is None else (e.get("val") or "1") not in ("0", "false", "none") for n in ("b", "i", "u", "strike")]


def _formats(package: Package):
    root = package.xml("xl/styles.xml")
    if root is None:
        return
    codes = {int(f.get("numFmtId")): f.get("formatCode") for f in below(root, "numFmt")}
    xfs = child(root, "cellXfs")
    for i, xf in enumerate(xfs if xfs is not None else ()):
        n = int(xf.get("numFmtId") or 0)
        yield i, n, codes.get(n)


def number_formats(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``style_index, num_fmt_id, format_code`` (null for built-in ids)."""
    return read_packages(spark, path, "*.xlsx", _formats, "style_index int, num_fmt_id int, format_code string")


def cells(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``file_path, sheet_idx, sheet, row, col, ref, v_type, v_num, v_text, v_bool, v_err, style_index, formula`` of all sheets.

    A file's shared strings are looked up where the file is read, so cells don't
    move; a missing string is empty.
    """
    return typed(sheet_parts(spark, path, ("cell",)))


def typed(parts: DataFrame) -> DataFrame:
    """Cells of tagged rows, with their values by type."""
    raw = parts.where("kind = 'cell' and error is null and ref is not null")
    number = F.expr("try_cast(raw as double)")
    kind = (
        F.when(F.col("t") == "inlineStr", "text")
        .when(F.col("raw").isNull(), "empty")
        .when(F.col("t").isin("s", "str"), "text")
        .when(F.col("t") == "b", "bool")
        .when(F.col("t") == "e", "error")
        .when(number.isNotNull(), "number")
        .otherwise("text")
    )
    text = F.when(F.col("t").isin("inlineStr", "s"), F.col("held")).otherwise(F.col("raw"))
    return raw.withColumn("v_type", kind).select(
        "file_path", "sheet_idx", "sheet", row_number(F.col("ref")).alias("row"), column_number(F.col("ref")).alias("col"), "ref", "v_type",
        F.when(F.col("v_type") == "number", number).alias("v_num"),
        F.when(F.col("v_type") == "text", text).alias("v_text"),
        F.when(F.col("v_type") == "bool", F.col("raw") == "1").alias("v_bool"),
        F.when(F.col("v_type") == "error", F.col("raw")).alias("v_err"),
        "style_index", "formula",
    )


def merges(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return of_kind(sheet_parts(spark, path, ("merge",)), "merge")


def _names(package: Package):
    root = package.xml(WORKBOOK)
    for n in below(root, "definedName") if root is not None else ():
        sheet = n.get("localSheetId")
        yield n.get("name"), int(sheet) if sheet is not None else None, n.text


def defined_names(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return read_packages(spark, path, "*.xlsx", _names, "name string, local_sheet int, formula string")


def dimensions(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Sizes and visibility of rows and columns: ``sheet_idx, axis, index, size, hidden``."""
    return of_kind(sheet_parts(spark, path, ("dim",)), "dim")


def visible(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """Cells that are in no hidden row or column."""
    gone = dims.where("hidden")
    for axis in ("row", "col"):
        hidden = gone.where(F.col("axis") == axis).select("file_path", "sheet_idx", F.col("index").alias(axis))
        cells = cells.join(hidden, ["file_path", "sheet_idx", axis], "left_anti")
    return cells


def format_rules(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return of_kind(sheet_parts(spark, path, ("rule",)), "rule")


def hyperlinks(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """First cell of each link and its target."""
    return of_kind(sheet_parts(spark, path, ("link",)), "link")


def _tables(package: Package):
    for i, _, part in listed(package):
        for n, target in enumerate(package.relations(part).values() if part else ()):
            root = package.xml(target) if "/tables/" in target else None
            if root is not None:
                style = child(root, "tableStyleInfo")
                on = lambda a: style is not None and style.get(a) in ("1", "true")  # noqa: B023, E731
                yield (
                    i, root.get("displayName") or root.get("name"), root.get("ref"), int(root.get("headerRowCount") or 1), int(root.get("totalsRowCount") or 0),
                    style.get("name") if style is not None else None, on("showRowStripes"), [c.get("name") for c in below(root, "tableColumn")], n, on("showFirstColumn"), on("showLastColumn"),
                    [int(c.get("dataDxfId")) if c.get("dataDxfId") else None for c in below(root, "tableColumn")],
                )


def tables(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Tables of the sheets; ``ord`` is their order in the sheet, of which the later holds where two overlap."""
    return read_packages(spark, path, "*.xlsx", _tables, "sheet_idx int, name string, ref string, header_rows int, totals_rows int, style string, row_stripes boolean, columns array<string>, ord int, first_column boolean, last_column boolean, data_dxf_ids array<int>")


def _table_styles(package: Package):
    root = package.xml("xl/styles.xml")
    for style in below(root, "tableStyle") if root is not None else ():
        for e in below(style, "tableStyleElement"):
            yield style.get("name"), e.get("type"), int(e.get("dxfId")) if e.get("dxfId") else None


def table_styles(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Elements of the table styles that a workbook defines, and their differential formats."""
    return read_packages(spark, path, "*.xlsx", _table_styles, "name string, element string, dxf_id int")


def resolve_sheet(sheets_: DataFrame, identifier: str) -> DataFrame:
    """The sheet of a 0-based index if the identifier is a number, else of the name."""
    return sheets_.where(is_sheet(identifier, "name"))


def is_sheet(identifier: str, name: str = "sheet") -> Column:
    return F.col("sheet_idx") == int(identifier) if identifier.isdigit() else F.col(name) == identifier


def formulas(cells_: DataFrame) -> DataFrame:
    return cells_.where(F.col("formula").isNotNull())


def _fonts(package: Package):
    root = package.xml("xl/styles.xml")
    if root is None:
        return
    plain, rules = child(root, "fonts"), child(root, "dxfs")
    for differs, held in ((False, plain if plain is not None else ()), (True, [child(d, "font") for d in rules] if rules is not None else ())):
        for i, font in enumerate(held):
            if font is not None:
                name, size, color = (child(font, n) for n in ("name", "sz", "color"))
                yield differs, i, name.get("val") if name is not None else None, float(size.get("val")) if size is not None else None, *_toggles(font), *_color(color)


def fonts(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Fonts of cell formats and of rules (``differential``); toggles honour their values and are null where they are missing."""
    return read_packages(spark, path, "*.xlsx", _fonts, f"differential boolean, font_id int, name string, size double, bold boolean, italic boolean, underline boolean, strike boolean, {COLOR}")


def _default_font(package: Package):
    root = package.xml("xl/styles.xml")
    base = child(root, "cellStyleXfs") if root is not None else None
    fonts_, at = (child(root, "fonts") if root is not None else None), int(base[0].get("fontId") or 0) if base is not None and len(base) else 0
    if fonts_ is not None and at < len(fonts_):
        name, size = child(fonts_[at], "name"), child(fonts_[at], "sz")
        yield at, name.get("val") if name is not None else None, float(size.get("val")) if size is not None else None


def default_font(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Font of the Normal style, which column widths count in."""
    return read_packages(spark, path, "*.xlsx", _default_font, "font_id int, name string, size double")


def _cell_formats(package: Package):
    root = package.xml("xl/styles.xml")
    xfs = child(root, "cellXfs") if root is not None else None
    for i, xf in enumerate(xfs if xfs is not None else ()):
        align = child(xf, "alignment")
        ids = [int(xf.get(n) or 0) for n in ("numFmtId", "fontId", "fillId", "borderId")]
        yield i, *ids, align.get("horizontal") if align is not None else None, align is not None and align.get("wrapText") in ("1", "true")


def cell_formats(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return read_packages(spark, path, "*.xlsx", _cell_formats, "style_index int, num_fmt_id int, font_id int, fill_id int, border_id int, horizontal string, wrap boolean")


def _fills(package: Package):
    root = package.xml("xl/styles.xml")
    for differs, holder in ((False, child(root, "fills")), (True, child(root, "dxfs"))) if root is not None else ():
        for i, fill in enumerate(holder if holder is not None else ()):
            pattern = next(below(fill, "patternFill"), None)
            if pattern is not None:
                front, back = child(pattern, "fgColor"), child(pattern, "bgColor")
                yield differs, i, pattern.get("patternType"), front.get("rgb") if front is not None else None, back.get("rgb") if back is not None else None


def fills(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Pattern fills of cell formats, and of rules (``differential``)."""
    return read_packages(spark, path, "*.xlsx", _fills, "differential boolean, fill_id int, pattern string, foreground string, background string")


def _gradients(package: Package):
    root = package.xml("xl/styles.xml")
    held = child(root, "fills") if root is not None else None
    for i, fill in enumerate(held if held is not None else ()):
        gradient = child(fill, "gradientFill")
        stops = [(float(s.get("position") or 0), _color(child(s, "color"))) for s in gradient] if gradient is not None else []
        for k, (at, color) in enumerate(sorted(stops, key=lambda s: s[0])):
            yield i, gradient.get("type") or "linear", float(gradient.get("degree") or 0), k, at, *color


def gradient_stops(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Stops of gradient fills in the order of their positions."""
    return read_packages(spark, path, "*.xlsx", _gradients, f"fill_id int, kind string, degree double, ord int, position double, {COLOR}")


def _borders(package: Package):
    root = package.xml("xl/styles.xml")
    holder = child(root, "borders") if root is not None else None
    for i, border in enumerate(holder if holder is not None else ()):
        for edge in border:
            color = child(edge, "color")
            if edge.get("style"):
                yield i, local(edge), edge.get("style"), *_color(color)


def borders(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """A row for each edge that has a style."""
    return read_packages(spark, path, "*.xlsx", _borders, f"border_id int, edge string, style string, {COLOR}")


def _rule_edges(package: Package):
    for i, dxf in enumerate(_rules_of_styles(package)):
        for edge in (e for b in dxf if local(b) == "border" for e in b):
            if edge.get("style"):
                yield i, local(edge), edge.get("style"), *_color(child(edge, "color"))


def _rules_of_styles(package: Package):
    root = package.xml("xl/styles.xml")
    held = child(root, "dxfs") if root is not None else None
    return (e for e in held if local(e) == "dxf") if held is not None else ()


def rule_borders(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """A row for each edge that a differential format draws."""
    return read_packages(spark, path, "*.xlsx", _rule_edges, f"dxf_id int, edge string, style string, {COLOR}")


def rule_formats(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Number formats of differential formats."""
    rows = lambda package: ((i, int(f.get("numFmtId") or 0), f.get("formatCode")) for i, dxf in enumerate(_rules_of_styles(package)) for f in dxf if local(f) == "numFmt")
    return read_packages(spark, path, "*.xlsx", rows, "dxf_id int, num_fmt_id int, format_code string")


def _related(package: Package, kind: str):
    """(sheet, sheet's part, part) of the parts that sheets refer to, by a piece of their path."""
    for i, _, part in listed(package):
        for target in package.relations(part).values() if part else ():
            if kind in target and target in package.names:
                yield i, part, target


def _comments(package: Package):
    for i, _, target in _related(package, "comments"):
        authors = [a.text for a in package.elements(target, "author")]
        for c in package.elements(target, "comment"):
            author = int(c.get("authorId") or 0)
            yield i, c.get("ref"), authors[author] if author < len(authors) else None, "".join(t.text or "" for t in below(c, "t"))


def comments(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return read_packages(spark, path, "*.xlsx", _comments, "sheet_idx int, ref string, author string, text string")


def _anchors(package: Package):
    for i, _, part in _related(package, "/drawings/drawing"):
        targets = package.relations(part)
        for k, anchor in enumerate(e for e in package.xml(part) if local(e).endswith("Anchor")):
            ends = [[int(x.text) if (x := child(end, n)) is not None else None for n in ("row", "col")] if (end := child(anchor, tag)) is not None else [None, None] for tag in ("from", "to")]
            held = next((e for e in anchor if local(e) in ("pic", "graphicFrame", "sp", "grpSp", "cxnSp")), None)
            if held is not None:
                name = next((e.get("name") for e in below(held, "cNvPr")), None)
                rid = next((v for e in held.iter() for a, v in e.attrib.items() if a.endswith(("}embed", "}id"))), None)
                yield i, k, local(held), name, *ends[0], *ends[1], targets.get(rid)


def anchors(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Pictures, charts, shapes and groups with the 0-based cells of their corners and the part that they show."""
    return read_packages(spark, path, "*.xlsx", _anchors, "sheet_idx int, ord int, kind string, name string, from_row int, from_col int, to_row int, to_col int, target string")


def sparklines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``values_ref`` may name another sheet; its numbers are a range join into ``cells``."""
    return of_kind(sheet_parts(spark, path, ("sparkline",)), "sparkline")


def _drawn(package: Package):
    for i, _, part in _related(package, "/drawings/drawing"):
        for k, anchor in enumerate(e for e in package.xml(part) if local(e).endswith("Anchor")):
            for at, group, e in shape_tree(anchor):
                name = next((c.get("name") for c in below(e, "cNvPr")), None)
                yield i, k, at, group, local(e), name, *frame(e)


def drawn_shapes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Shapes of drawings with what groups hold; ``anchor`` is the ordinal of :func:`anchors`."""
    return read_packages(spark, path, "*.xlsx", _drawn, f"sheet_idx int, anchor int, shape int, group int, kind string, name string, {FRAME}")


def corners(reference: Column) -> Column:
    """``sheet, top, left, bottom, right`` of a reference such as ``'A sheet'!$B$2:C9``; a null sheet is the reference's own."""
    area = F.element_at(F.split(reference, "!"), -1)
    first, last = F.substring_index(area, ":", 1), F.substring_index(area, ":", -1)
    named = F.when(F.contains(reference, F.lit("!")), F.replace(F.regexp_replace(F.regexp_extract(reference, "^(.*)!", 1), "^'|'$", ""), F.lit("''"), F.lit("'")))
    rows, cols = (row_number(first), row_number(last)), (column_number(first), column_number(last))
    return F.struct(named.alias("sheet"), F.least(*rows).alias("top"), F.least(*cols).alias("left"), F.greatest(*rows).alias("bottom"), F.greatest(*cols).alias("right"))


def sparkline_values(lines: DataFrame, sheets_: DataFrame, cells_: DataFrame) -> DataFrame:
    """``file_path, sheet_idx, ref, row, col, v_num`` of every sparkline's values, by a range join into the sheet that it names."""
    at = lines.where("error is null and values_ref is not null").select("file_path", "sheet_idx", F.col("ref").alias("line"), corners(F.col("values_ref")).alias("at"))
    names = sheets_.where("error is null").select("file_path", F.col("sheet_idx").alias("of"), F.col("name").alias("named"))
    joined = at.join(names, "file_path").where(F.when(F.col("at.sheet").isNull(), F.col("of") == F.col("sheet_idx")).otherwise(F.col("named") == F.col("at.sheet")))
    boxes = joined.select("file_path", F.col("of"), F.col("sheet_idx").alias("line_sheet"), "line", "at.top", "at.left", "at.bottom", "at.right")
    values = cells_.select("file_path", F.col("sheet_idx").alias("of"), "row", "col", "v_num")
    return in_rectangles(values, boxes, ["file_path", "of"]).select("file_path", F.col("line_sheet").alias("sheet_idx"), F.col("line").alias("ref"), "row", "col", "v_num")


def filter_headers(cells_: DataFrame, views_: DataFrame) -> DataFrame:
    """Cells of the first row of their sheet's filter range: those with a filter button."""
    at = views_.where("error is null and filter_ref is not null").select("file_path", "sheet_idx", corners(F.col("filter_ref")).alias("at"))
    boxes = at.select("file_path", "sheet_idx", "at.top", "at.left", F.col("at.top").alias("bottom"), "at.right")
    return in_rectangles(cells_, boxes, ["file_path", "sheet_idx"]).select(*cells_.columns)


def hide_zeros(cells_: DataFrame, views_: DataFrame, text: str) -> DataFrame:
    """Where a sheet doesn't show zeros, cells whose formatted ``text`` is 0, of either sign, are empty."""
    shown = views_.where("error is null").select("file_path", "sheet_idx", F.col("show_zeros").alias("__zeros"))
    joined = cells_.join(shown, ["file_path", "sheet_idx"], "left")
    return joined.withColumn(text, F.when(~F.coalesce("__zeros", F.lit(True)) & F.col(text).isin("0", "-0"), "").otherwise(F.col(text))).drop("__zeros")


def extension_rules(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Rules of the extension blocks: ``id`` joins those that a plain rule refers to, the others stand for themselves."""
    return of_kind(sheet_parts(spark, path, ("extension",)), "extension")


def views(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Frozen rows and columns, shown zeros and grid lines, the filter's range."""
    return of_kind(sheet_parts(spark, path, ("view",)), "view")


def _pivot_items(package: Package):
    for part in sorted(n for n in package.names if "/pivotCacheDefinition" in n and n.endswith(".xml")):
        for f, field in enumerate(below(package.xml(part), "cacheField")):
            items = child(field, "sharedItems")
            for k, item in enumerate(items if items is not None else ()):
                yield part, f, field.get("name"), k, item.get("v")


def pivot_items(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Shared values of pivot caches; slicers refer to them by position."""
    return read_packages(spark, path, "*.xlsx", _pivot_items, "part string, field_idx int, field string, pos int, value string")


def _slicer_items(package: Package):
    for part in sorted(n for n in package.names if "/slicerCache" in n and n.endswith(".xml")):
        root = package.xml(part)
        for k, item in enumerate(below(root, "i")):
            yield part, root.get("name"), root.get("sourceName"), k, int(item.get("x") or 0), item.get("s") in ("1", "true")


def slicer_items(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return read_packages(spark, path, "*.xlsx", _slicer_items, "part string, name string, field string, ord int, pos int, selected boolean")


def named_slicer_items(slicers: DataFrame, pivots: DataFrame) -> DataFrame:
    """Slicer items with their field's values."""
    values = pivots.where("error is null").select("file_path", "field", "pos", F.col("value").alias("text"))
    return slicers.where("error is null").join(values, ["file_path", "field", "pos"], "left")
