"""The query tools on packages made of literal XML."""

from __future__ import annotations

import pytest

from gridloom import tools

from .test_parts import plain
from .test_sources import DECK, DOCUMENT, WORKBOOK, package


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tools")
    for name, content in (("book.xlsx", WORKBOOK), ("text.docx", DOCUMENT), ("deck.pptx", DECK)):
        (root / name).write_bytes(package(content))
    (root / "bad.xlsx").write_bytes(b"PK")
    return str(root)


def test_sheets(spark, folder):
    assert plain(tools.xlsx_get_sheet_names(spark, folder).orderBy("sheet_idx"), "sheet_idx", "name") == [(0, "One"), (1, "42")]
    assert plain(tools.xlsx_get_sheet_dimensions(spark, folder, "One"), "max_row", "max_col", "max_col_letter") == [(1, 27, "AA")]
    assert plain(tools.xlsx_get_sheet_dimensions(spark, folder, "1"), "max_row", "max_col") == [(7, 2)]
    assert tools.xlsx_get_sheet_dimensions(spark, folder, "9").count() == 0


def test_cells(spark, folder):
    found = tools.xlsx_get_cell_range(spark, folder, "0", "F1:D1").orderBy("col")
    assert plain(found, "ref", "v_type", "value", "formula") == [("D1", "number", "1.5", "A1*2"), ("E1", "bool", "true", None), ("F1", "error", "#N/A", None)]
    assert plain(tools.xlsx_get_formulas(spark, folder, "One"), "ref", "formula", "value") == [("D1", "A1*2", "1.5")]
    assert sorted(plain(tools.xlsx_search_cells(spark, folder, "TEXT"), "sheet", "ref", "match_count")) == [("One", "B1", 1)]
    assert sorted(plain(tools.xlsx_search_cells(spark, folder, "7"), "sheet", "ref")) == [("42", "B7")]
    assert tools.xlsx_search_cells(spark, folder, "7", "One").count() == 0
    with pytest.raises(ValueError, match="no range"):
        tools.xlsx_get_cell_range(spark, folder, "0", "x")


def test_documents(spark, folder):
    assert plain(tools.docx_extract_text(spark, folder), "text") == [("Hello new\n\n5\n\na\t\n",)]
    structure = plain(tools.docx_get_structure(spark, folder).orderBy("block"), "block", "type", "style", "text", "rows", "cols")
    assert structure == [(0, "paragraph", "H1", "Hello new", None, None), (1, "paragraph", None, "", None, None), (2, "paragraph", None, "5\n", None, None), (3, "table", None, None, 1, 2)]
    assert plain(tools.docx_get_tables(spark, folder), "rows") == [([["a", ""]],)]
    assert plain(tools.docx_search_text(spark, folder, "NEW"), "block", "type", "match_count") == [(0, "paragraph", 1)]
    assert plain(tools.docx_search_text(spark, folder, "a"), "block", "trow", "tcol") == [(3, 0, 0)]


def test_decks(spark, folder):
    assert plain(tools.pptx_get_slides(spark, folder).orderBy("slide"), "slide", "title", "slide_count") == [(0, None, 2), (1, "Title", 2)]
    assert plain(tools.pptx_extract_text(spark, folder), "text") == [("=== Slide 1 ===\nfirst\n2\n\n=== Slide 2 ===\n Title \ncell",)]
    assert plain(tools.pptx_extract_text(spark, folder, 0), "text") == [("first\n2",)]
    assert tools.pptx_get_slide_structure(spark, folder, 0).count() == 0  # no shape tree
    assert plain(tools.pptx_search_text(spark, folder, "CELL"), "slide_number", "type", "match_count") == [(2, "table", 1)]
