"""Tables of presentations: cells with their spans, the styles that a deck defines, and the parts that are switched on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .packages import Package, attribute, below, child, local, read_packages
from .presentations import slide_parts

#: Parts of a table that ``tblPr`` can switch on, as named in this table's columns.
FLAGS = {"firstRow": "first_row", "lastRow": "last_row", "firstCol": "first_col", "lastCol": "last_col", "bandRow": "band_row"}
CELLS = "slide int, shape int, row int, col int, rows int, cols int, grid_span int, row_span int, h_merge boolean, v_merge boolean, width long, height long, own_slot string, own_rgb string, text string, style string, " + ", ".join(f"{n} boolean" for n in FLAGS.values())
_YES = ("1", "true")


def _color(holder) -> tuple[str | None, str | None]:
    """Theme slot and colour of a solid fill; of one of them at most."""
    fill = child(holder, "solidFill") if holder is not None else None
    color = next((e for e in fill if local(e) in ("srgbClr", "schemeClr")), None) if fill is not None else None
    value = attribute(color, "val") if color is not None else None
    return (value, None) if color is not None and local(color) == "schemeClr" else (None, value)


def _cells(package: Package):
    for n, part in slide_parts(package):
        slide = package.xml(part) if part else None
        for k, shape in enumerate(e for e in slide.iter() if local(e) in ("sp", "graphicFrame")) if slide is not None else ():
            for table in below(shape, "tbl"):
                props, grid = child(table, "tblPr"), child(table, "tblGrid")
                widths = [int(attribute(c, "w") or 0) for c in grid if local(c) == "gridCol"] if grid is not None else []
                named = next(below(props, "tableStyleId"), None) if props is not None else None
                flags = [props is not None and attribute(props, f) in _YES for f in FLAGS]
                rows = [e for e in table if local(e) == "tr"]
                for r, row in enumerate(rows):
                    for c, cell in enumerate(e for e in row if local(e) == "tc"):
                        text = "\n".join("".join(t.text or "" for t in below(p, "t")) for p in below(cell, "p"))
                        spans = [int(attribute(cell, a) or 1) for a in ("gridSpan", "rowSpan")]
                        merged = [attribute(cell, a) in _YES for a in ("hMerge", "vMerge")]
                        yield n, k, r, c, len(rows), len(widths), *spans, *merged, widths[c] if c < len(widths) else 0, int(attribute(row, "h") or 0), *_color(child(cell, "tcPr")), text, named.text if named is not None else None, *flags


def cells(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Cells as they stand in their row; merged ones are there too."""
    return read_packages(spark, path, "*.pptx", _cells, CELLS)


def _styles(package: Package):
    root = package.xml("ppt/tableStyles.xml")
    for style in below(root, "tblStyle") if root is not None else ():
        for part in style:
            fill = next(below(part, "fill"), None)
            slot, rgb = _color(fill)
            if slot or rgb:
                change = next((c for s in below(fill, "schemeClr") for c in s), None)
                yield attribute(style, "styleId"), local(part), slot, rgb, local(change) if change is not None else None, int(attribute(change, "val") or 0) // 1000 if change is not None else None


def styles(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Fills of the parts of a deck's own table styles."""
    return read_packages(spark, path, "*.pptx", _styles, "style string, part string, slot string, rgb string, change string, percent int")
