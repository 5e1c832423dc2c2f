"""Side parts of packages: themes, media, drawings, numbering, sections, shapes."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from gridloom.sources import parts, presentations, spreadsheets, wordprocessing

from .test_sources import REL, package, relations

PNG = parts.PNG + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\x08"
THEME = '<a:theme xmlns:a="a"><a:clrScheme><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1><a:accent1><a:srgbClr val="156082"/></a:accent1></a:clrScheme><a:fontScheme><a:majorFont><a:latin typeface="Head"/></a:majorFont><a:minorFont/></a:fontScheme></a:theme>'
BOOK = {
    "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": relations({"r1": "worksheets/sheet1.xml"}),
    "xl/worksheets/sheet1.xml": '<worksheet><sheetViews><sheetView showZeros="0"><pane ySplit="2" xSplit="1" state="frozen"/></sheetView></sheetViews><autoFilter ref="A1:C9"/><extLst><sparklineGroup type="column"><sparkline><f>One!A1:A3</f><sqref>D1</sqref></sparkline></sparklineGroup></extLst></worksheet>',
    "xl/worksheets/_rels/sheet1.xml.rels": relations({"c": "../comments1.xml", "d": "../drawings/drawing1.xml"}),
    "xl/comments1.xml": '<comments><authors><author>me</author></authors><commentList><comment ref="B2" authorId="0"><text><r><t>a </t></r><r><t>note</t></r></text></comment></commentList></comments>',
    "xl/drawings/drawing1.xml": f'<x:wsDr xmlns:x="x" xmlns:r="{REL}"><x:twoCellAnchor><x:from><x:col>1</x:col><x:row>2</x:row></x:from><x:to><x:col>3</x:col><x:row>4</x:row></x:to><x:pic><x:cNvPr name="P"/><x:blip r:embed="i"/></x:pic></x:twoCellAnchor><x:oneCellAnchor><x:from><x:col>0</x:col><x:row>0</x:row></x:from><x:sp><x:cNvPr name="S"/></x:sp></x:oneCellAnchor></x:wsDr>',
    "xl/drawings/_rels/drawing1.xml.rels": relations({"i": "../media/image1.png"}),
    "xl/media/image1.png": PNG,
    "xl/media/other.mp4": b"xyz",
    "xl/theme/theme1.xml": THEME,
    "xl/styles.xml": '<styleSheet><fonts><font><b val="0"/><i/><sz val="11"/><name val="F"/><color theme="1"/></font></fonts><fills><fill><patternFill patternType="solid"><fgColor rgb="FF112233"/></patternFill></fill></fills>'
    '<borders><border><left style="thin"><color rgb="FF000000"/></left><right/></border></borders><cellXfs><xf numFmtId="14" fontId="0" borderId="0"><alignment horizontal="center" wrapText="1"/></xf></cellXfs><dxfs><dxf><fill><patternFill><bgColor rgb="FFAABBCC"/></patternFill></fill></dxf></dxfs></styleSheet>',
    "xl/pivotCache/pivotCacheDefinition1.xml": '<pivotCacheDefinition><cacheFields><cacheField name="City"><sharedItems><s v="Rome"/><s v="Oslo"/></sharedItems></cacheField></cacheFields></pivotCacheDefinition>',
    "xl/slicerCaches/slicerCache1.xml": '<slicerCacheDefinition name="Slicer_City" sourceName="City"><data><tabular><items><i x="1" s="1"/><i x="7"/></items></tabular></data></slicerCacheDefinition>',
}
TEXT = {
    "word/document.xml": f'<w:document xmlns:w="w" xmlns:r="{REL}"><w:body><w:p><w:r><w:drawing><w:inline><w:extent cx="127000" cy="25400"/><w:docPr name="D"/><w:blip r:embed="i"/></w:inline></w:drawing></w:r></w:p>'
    '<w:sectPr><w:headerReference w:type="first" r:id="h"/><w:footerReference r:id="f"/><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:left="720"/><w:titlePg/></w:sectPr></w:body></w:document>',
    "word/_rels/document.xml.rels": relations({"i": "media/image1.png", "h": "header1.xml"}),
    "word/header1.xml": '<w:hdr xmlns:w="w"><w:p><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:hdr>',
    "word/numbering.xml": '<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="4"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"/></w:abstractNum><w:num w:numId="9"><w:abstractNumId w:val="4"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>',
    "word/settings.xml": '<w:settings xmlns:w="w"><w:evenAndOddHeaders/></w:settings>',
    "word/media/image1.png": PNG,
}
_SHAPE = '<p:sp><p:nvSpPr><p:cNvPr name="{0}"/><p:nvPr><p:ph type="{1}" idx="{2}"/></p:nvPr></p:nvSpPr><p:spPr>{3}</p:spPr></p:sp>'
_BOX = '<a:xfrm><a:off x="{0}" y="2"/><a:ext cx="3" cy="4"/></a:xfrm>'
DECK = {
    "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": relations({"a": "slides/slide1.xml"}),
    "ppt/slides/_rels/slide1.xml.rels": relations({"l": "../slideLayouts/slideLayout1.xml"}),
    "ppt/slideLayouts/_rels/slideLayout1.xml.rels": relations({"m": "../slideMasters/slideMaster1.xml"}),
    "ppt/slides/slide1.xml": '<s xmlns:p="p" xmlns:a="a"><p:spTree>' + _SHAPE.format("own", "title", 0, _BOX.format(1)) + _SHAPE.format("by idx", "body", 7, "") + _SHAPE.format("by type", "dt", 99, "") + _SHAPE.format("by master", "ftr", 98, "") + _SHAPE.format("none", "pic", 97, "")
    + '<p:grpSp><p:nvGrpSpPr><p:cNvPr name="G"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="10" y="0"/><a:ext cx="20" cy="20"/><a:chOff x="0" y="0"/><a:chExt cx="40" cy="40"/></a:xfrm></p:grpSpPr><p:pic><p:nvPicPr><p:cNvPr name="in"/></p:nvPicPr></p:pic></p:grpSp></p:spTree></s>',
    "ppt/slideLayouts/slideLayout1.xml": '<s xmlns:p="p" xmlns:a="a"><p:spTree>' + _SHAPE.format("l7", "body", 7, _BOX.format(70)) + _SHAPE.format("ld", "dt", 3, _BOX.format(30)) + "</p:spTree></s>",
    "ppt/slideMasters/slideMaster1.xml": '<s xmlns:p="p" xmlns:a="a"><p:spTree>' + _SHAPE.format("mf", "ftr", 1, _BOX.format(900)) + "</p:spTree></s>",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("parts")
    for name, content in (("book.xlsx", BOOK), ("text.docx", TEXT), ("deck.pptx", DECK)):
        (root / name).write_bytes(package(content))
    return str(root)


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_any_package(spark, folder):
    theme = parts.themes(spark, folder)
    assert set(plain(theme.where("value is not null"), "kind", "ord", "slot", "value")) == {("color", 0, "dk1", "000000"), ("color", 4, "accent1", "156082"), ("font", 0, "majorFont", "Head")}
    assert sorted(plain(parts.media(spark, folder), "part", "n_bytes", "width", "height", "type")) == [("word/media/image1.png", 25, 640, 480, "image/png"), ("xl/media/image1.png", 25, 640, 480, "image/png"), ("xl/media/other.mp4", 3, None, None, "video/mp4")]
    assert [bytes(r[0]) for r in plain(parts.content(spark, folder, ["xl/media/other.mp4"]), "content")] == [b"xyz"]
    assert ("xl/worksheets/sheet1.xml", "c", "xl/comments1.xml") in plain(parts.relations(spark, folder), "part", "id", "target")


def test_styles_of_books(spark, folder):
    assert plain(spreadsheets.fonts(spark, folder), "name", "size", "bold", "italic", "underline", "theme") == [("F", 11.0, False, True, None, 1)]
    assert plain(spreadsheets.cell_formats(spark, folder), "num_fmt_id", "font_id", "horizontal", "wrap") == [(14, 0, "center", True)]
    assert plain(spreadsheets.fills(spark, folder), "differential", "foreground", "background") == [(False, "FF112233", None), (True, None, "FFAABBCC")]
    assert plain(spreadsheets.borders(spark, folder), "edge", "style", "rgb") == [("left", "thin", "FF000000")]


def test_side_parts_of_sheets(spark, folder):
    assert plain(spreadsheets.comments(spark, folder), "ref", "author", "text") == [("B2", "me", "a note")]
    assert plain(spreadsheets.anchors(spark, folder).orderBy("ord"), "kind", "name", "from_row", "from_col", "to_row", "target") == [("pic", "P", 2, 1, 4, "xl/media/image1.png"), ("sp", "S", 0, 0, None, None)]
    assert plain(spreadsheets.sparklines(spark, folder), "kind", "gaps", "values_ref", "ref") == [("column", "gap", "One!A1:A3", "D1")]
    assert plain(spreadsheets.views(spark, folder), "frozen_rows", "frozen_cols", "show_zeros", "grid_lines", "filter_ref") == [(2, 1, False, True, "A1:C9")]
    named = spreadsheets.named_slicer_items(spreadsheets.slicer_items(spark, folder), spreadsheets.pivot_items(spark, folder))
    assert set(plain(named, "pos", "text", "selected")) == {(1, "Oslo", True), (7, None, False)}


def test_documents(spark, folder):
    assert set(plain(wordprocessing.numbering(spark, folder), "list_id", "level", "format", "pattern", "start")) == {(9, 0, "upperRoman", "%1.", 3), (9, 1, "decimal", None, 5)}
    assert plain(wordprocessing.sections(spark, folder), "width", "height", "top", "bottom", "left", "starts_on", "own_first") == [(612.0, 792.0, 72.0, None, 36.0, "nextPage", True)]
    assert plain(wordprocessing.headers(spark, folder), "kind", "pages", "text") == [("header", "first", "Top\nSecond"), ("footer", "default", None)]
    assert plain(wordprocessing.even_headers(spark, folder), "even") == [(True,)]
    assert plain(wordprocessing.drawings(spark, folder), "kind", "name", "width", "height", "target") == [("inline", "D", 10.0, 2.0, "word/media/image1.png")]


def test_decks(spark, folder):
    slides, elements = presentations.slides(spark, folder), presentations.elements(spark, folder)
    assert plain(slides, "slide", "layout", "master") == [(0, "ppt/slideLayouts/slideLayout1.xml", "ppt/slideMasters/slideMaster1.xml")]
    inside = elements.where("name in ('G', 'in')").orderBy("shape")
    assert plain(inside, "kind", F.col("group").isNotNull(), "ch_w") == [("grpSp", False, 40), ("pic", True, None)]
    assert set(plain(presentations.inherited_positions(slides, elements), "placeholder", "x", "w")) == {("title", 1, 3), ("body", 70, 3), ("dt", 30, 3), ("ftr", 900, 3), ("pic", None, None)}
