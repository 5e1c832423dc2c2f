"""Placeholders and groups that the made decks don't have."""

from __future__ import annotations

import pytest

from gridloom.operators import slides
from gridloom.sources import presentations, spreadsheets

from .test_sources import package

BOX = "x long, y long, w long, h long, ch_x long, ch_y long, ch_w long, ch_h long, rot double, flip_h boolean, flip_v boolean"


def test_a_body_without_index_is_no_title(spark):
    place = lambda ph, x: f'<p:sp><p:nvSpPr><p:nvPr><p:ph {ph}/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="0"/><a:ext cx="1" cy="1"/></a:xfrm></p:spPr></p:sp>'
    tree = lambda kind, inner: f'<p:{kind} xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:{kind}>'
    rel = lambda t: f'<Relationships><Relationship Id="r" Target="{t}"/></Relationships>'
    deck = package({
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="http://x/relationships"><p:sldIdLst><p:sldId r:id="r"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rel("slides/slide1.xml"),
        "ppt/slides/slide1.xml": tree("sld", "<p:sp><p:nvSpPr><p:nvPr><p:ph/></p:nvPr></p:nvSpPr></p:sp>"), "ppt/slides/_rels/slide1.xml.rels": rel("../slideLayouts/slideLayout1.xml"),
        "ppt/slideLayouts/slideLayout1.xml": tree("sldLayout", place('type="title"', 11) + place('type="body"', 99)),
    })
    files = spark.createDataFrame([("d", bytearray(deck))], "path string, content binary")
    got = presentations.inherited_positions(presentations.slides(spark, files), presentations.elements(spark, files)).collect()
    assert [(r.placeholder, r.idx, r.x) for r in got] == [("body", None, 99)]


def test_deep_groups_and_rings(spark):
    groups = spark.createDataFrame([("f", i, i - 1 if i else None, 10, 0, 100, 100, 0, 0, 100, 100, 0.0, False, False) for i in range(60)], f"file_path string, group int, parent int, {BOX}")
    shapes = spark.createDataFrame([("f", 1, 59, 5, 5, 10, 10, 15.0, True, False), ("f", 2, None, 1, 2, 3, 4, 0.0, False, False), ("g", 3, None, 1, 1, 1, 1, 0.0, False, False), ("f", 4, 7, None, None, None, None, None, None, None)], "file_path string, shape int, group int, x long, y long, w long, h long, rot double, flip_h boolean, flip_v boolean")
    got = {r["shape"]: (r.x, r.y, r.w, r.rot, r.flip_h) for r in slides.absolute_boxes(shapes, groups, ["file_path"]).collect()}
    assert got == {1: (605, 5, 10, 15.0, True), 2: (1, 2, 3, 0.0, False), 3: (1, 1, 1, 0.0, False), 4: (80, 0, 0, 0.0, False)}
    ring = spark.createDataFrame([("f", 1, 2, 0, 0, 1, 1, 0, 0, 1, 1, 0.0, False, False), ("f", 2, 1, 0, 0, 1, 1, 0, 0, 1, 1, 0.0, False, False)], f"file_path string, group int, parent int, {BOX}")
    with pytest.raises(Exception, match="hold each other"):
        slides.absolute_boxes(shapes.where("shape = 1").selectExpr("file_path", "shape", "1 as group", "x", "y", "w", "h", "rot", "flip_h", "flip_v"), ring, ["file_path"]).collect()


def test_groups_in_drawings(spark):
    rel = lambda *t: "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{x}"/>' for i, x in enumerate(t)) + "</Relationships>"
    xfrm = lambda x, inner="": f'<a:xfrm><a:off x="{x}" y="0"/><a:ext cx="20" cy="20"/>{inner}</a:xfrm>'
    drawing = f'<xdr:wsDr xmlns:xdr="x" xmlns:a="a"><xdr:twoCellAnchor><xdr:grpSp><xdr:grpSpPr>{xfrm(100, """<a:chOff x="0" y="0"/><a:chExt cx="10" cy="10"/>""")}</xdr:grpSpPr><xdr:sp><xdr:nvSpPr><xdr:cNvPr name="in"/></xdr:nvSpPr><xdr:spPr>{xfrm(3)}</xdr:spPr></xdr:sp></xdr:grpSp></xdr:twoCellAnchor></xdr:wsDr>'
    book = package({"xl/workbook.xml": '<workbook xmlns:r="http://x/relationships"><sheets><sheet name="s" r:id="r0"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rel("worksheets/sheet1.xml"), "xl/worksheets/sheet1.xml": "<worksheet/>", "xl/worksheets/_rels/sheet1.xml.rels": rel("../drawings/drawing1.xml"), "xl/drawings/drawing1.xml": drawing})
    files = spark.createDataFrame([("b", bytearray(book))], "path string, content binary")
    shapes = spreadsheets.drawn_shapes(spark, files).where("error is null")
    groups = shapes.where("kind = 'grpSp'").selectExpr("file_path", "sheet_idx", "anchor", "shape as group", "group as parent", *slides.BOX, "ch_x", "ch_y", "ch_w", "ch_h")
    got = slides.absolute_boxes(shapes, groups, ["file_path", "sheet_idx", "anchor"]).collect()
    assert sorted((r["shape"], r.kind, r["group"], r.x, r.w) for r in got) == [(0, "grpSp", None, 100, 20), (1, "sp", 0, 106, 40)]
