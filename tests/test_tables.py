"""Spans, overlays and styles of tables, against sequential readers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gridloom.functions import table_styles
from gridloom.operators import tables
from gridloom.sources import deck_tables, spreadsheets, wordprocessing

from .test_sources import package

DECK = "slide int, row int, col int, rows int, cols int, grid_span int, row_span int, h_merge boolean, v_merge boolean, width long, height long, text string"


def occupied(cells, rows, cols):
    """Rectangles in reading order; a cell that is taken already is none."""
    taken, out = set(), []
    for r, c, gs, rs, merged in cells:
        if merged or (r, c) in taken:
            continue
        bottom, right = min(r + rs, rows) - 1, min(c + gs, cols) - 1
        taken |= {(i, j) for i in range(r, bottom + 1) for j in range(c, right + 1)}
        out.append((r, c, bottom, right))
    return sorted(out)


def test_spans_hold_their_grid(spark):
    rng, rows, want = random.Random(8), [], {}
    for slide in range(40):
        n, m = rng.randint(1, 6), rng.randint(1, 5)
        cells = []
        covered = set()
        for r in range(n):
            for c in range(m):
                gs, rs = (1, 1) if (r, c) in covered else (rng.choice([1, 1, 2, 9]), rng.choice([1, 1, 1, 3]))
                area = {(i, j) for i in range(r, min(n, r + rs)) for j in range(c, min(m, c + gs))}
                if area & covered and (r, c) not in covered:
                    gs = rs = 1
                    area = {(r, c)}
                covered |= area
                cells.append((r, c, gs, rs, False))
        rows += [(slide, r, c, n, m, gs, rs, False, False, 10 + c, 5 + r, "") for r, c, gs, rs, _ in cells]
        want[slide] = occupied(cells, n, m)
    got = tables.placed(spark.createDataFrame(rows, DECK), ["slide"]).collect()
    for slide, boxes in want.items():
        mine = [r for r in got if r.slide == slide]
        assert sorted((r.top, r.left, r.bottom, r.right) for r in mine) == boxes
        for r in mine:
            assert (r.x, r.w) == (sum(10 + c for c in range(r.left)), sum(10 + c for c in range(r.left, r.right + 1)))
            assert (r.y, r.h) == (sum(5 + i for i in range(r.top)), sum(5 + i for i in range(r.top, r.bottom + 1)))


def test_merges_down_a_document_table(spark):
    w = lambda *cells: "<w:tr>" + "".join(f"<w:tc><w:tcPr>{p}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>" for t, p in cells) + "</w:tr>"
    more, begin, two = "<w:vMerge/>", '<w:vMerge w:val="restart"/>', '<w:gridSpan w:val="2"/>'
    body = w(("a", begin), ("b", two)) + w(("", more), ("c", begin), ("d", "")) + w(("", more), ("", more), ("e", more)) + w(("f", begin), ("g", two + begin)) + w(("h", ""), ("", two + more))
    files = spark.createDataFrame([("x.docx", bytearray(package({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>'})))], "path string, content binary")
    got = tables.word_placed(wordprocessing.table_cells(spark, files), ["file_path", "tbl"]).collect()
    assert sorted((r.text, r.top, r.left, r.bottom, r.right) for r in got) == [("a", 0, 0, 2, 0), ("b", 0, 1, 0, 2), ("c", 1, 1, 2, 1), ("d", 1, 2, 1, 2), ("e", 2, 2, 2, 2), ("f", 3, 0, 3, 0), ("g", 3, 1, 4, 2), ("h", 4, 0, 4, 0)]


def test_the_later_table_holds(spark):
    cells = spark.createDataFrame([("b", 0, r, c) for r in range(1, 9) for c in range(1, 6)], "file_path string, sheet_idx int, row int, col int")
    rows = [("b", 0, 1, "late", "B3:E8", "TableStyleMedium9", 1, 1, True, True, False), ("b", 0, 0, "early", "A1:C4", "TableStyleLight1", 1, 0, True, False, True), ("b", 0, 2, "none", "A1:E8", "", 1, 0, True, False, False), ("b", 0, 3, "cell", "A8", "S", 0, 0, False, False, False)]
    boxes = spark.createDataFrame(rows, "file_path string, sheet_idx int, ord int, name string, ref string, style string, header_rows int, totals_rows int, row_stripes boolean, first_column boolean, last_column boolean")
    for order in (F.col("ord"), F.col("ord").desc()):
        got = {(r.row, r.col): (r.table, r.part, r.is_first_col, r.is_last_col, r.is_top, r.is_bottom) for r in tables.overlay(cells, boxes.orderBy(order), ["file_path", "sheet_idx"]).collect()}
        assert len(got) == 40
        assert got[1, 1] == ("early", "header", False, False, True, False) and got[2, 3] == ("early", "band1", False, True, False, False) and got[3, 1] == ("early", "band2", False, False, False, False)
        assert got[3, 2] == ("late", "header", True, False, True, False) and got[4, 3][:2] == ("late", "band1") and got[5, 5][:2] == ("late", "band2") and got[8, 5] == ("late", "totals", False, False, False, True)
        assert got[8, 1][:2] == ("cell", "band1") and got[1, 5] == (None,) * 6
    slots = spark.createDataFrame([("TableStyleMedium9",), ("TableStyleLight1",), ("TableStyleDark7",), ("Own",), (None,)], "s string").select(tables.accent_slot(F.col("s")).alias("a")).collect()
    assert [r.a for r in slots] == ["accent1", None, "accent6", None, None]


def test_own_styles_of_a_book(spark):
    styles = '<styleSheet><tableStyles><tableStyle name="S"><tableStyleElement type="wholeTable" dxfId="3"/><tableStyleElement type="headerRow" dxfId="1"/></tableStyle></tableStyles></styleSheet>'
    files = spark.createDataFrame([("b", bytearray(package({"xl/styles.xml": styles})))], "path string, content binary")
    cells = spark.createDataFrame([("b", "S", "header"), ("b", "S", "band2"), ("b", "T", "header"), ("b", None, None)], "file_path string, table_style string, part string")
    got = tables.style_formats(cells, spreadsheets.table_styles(spark, files)).collect()
    assert sorted((str(r.table_style), str(r.part), r.dxf_id) for r in got) == [("None", "None", None), ("S", "band2", 3), ("S", "header", 1), ("T", "header", None)]


def test_catalogue():
    rows = list(table_styles.catalogue())
    assert len({r[0] for r in rows}) == 74 and len({r[:1] + r[3:4] for r in rows}) == len(rows)
    assert ("{5C22544A-7EE6-4342-B048-85BDC9FD1C3A}", "Medium Style 2", 1, "band1H", "accent1", "tint", 40) in rows
    assert ("{91EBBBCC-DAD2-459C-BE2E-F6DE35CF9A28}", "Dark Style 2", 3, "firstRow", "accent4", None, None) in rows


def test_styles_of_a_deck_come_before_built_in_ones(spark):
    own = '<a:tblStyleLst xmlns:a="a"><a:tblStyle styleId="{X}"><a:wholeTbl><a:tcStyle><a:fill><a:solidFill><a:schemeClr val="accent2"><a:shade val="50000"/></a:schemeClr></a:solidFill></a:fill></a:tcStyle></a:wholeTbl><a:band1H><a:tcStyle/></a:band1H></a:tblStyle></a:tblStyleLst>'
    files = spark.createDataFrame([("d.pptx", bytearray(package({"ppt/tableStyles.xml": own})))], "path string, content binary")
    themes = spark.createDataFrame([("d.pptx", None, "t1", "color", "accent2", "204060"), ("d.pptx", None, "t1", "color", "accent1", "0A0B0C"), ("d.pptx", None, "t2", "color", "accent2", "FFFFFF")], "file_path string, error string, part string, kind string, slot string, value string")
    flags = {"first_row": True, "last_row": False, "first_col": False, "last_col": False, "band_row": True}
    rows = [("d.pptx", s, r, 0, 3, 1, None, rgb) for s, r, rgb in (("{X}", 0, None), ("{X}", 1, "abcdef"), ("{none}", 0, None), ("{none}", 1, None), (None, 0, None))]
    cells = spark.createDataFrame(rows, "file_path string, style string, row int, col int, rows int, cols int, own_slot string, own_rgb string").withColumns({n: F.lit(v) for n, v in flags.items()})
    got = sorted((str(r.style), r.row, r.fill) for r in tables.cell_fills(cells, themes, deck_tables.styles(spark, files)).collect())
    assert got == [("None", 0, "#0A0B0C"), ("{X}", 0, "#102030"), ("{X}", 1, "#ABCDEF"), ("{none}", 0, "#0A0B0C"), ("{none}", 1, None)]
