"""Packages built with ``zipfile`` and literal XML."""

from __future__ import annotations

import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.operators import documents, packages
from gridloom.sources import charts, presentations, spreadsheets, wordprocessing
from gridloom.sources import sheet_parts
from gridloom.sources.packages import Package, PackageError
from gridloom.streaming import arrivals

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def relations(targets: dict[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in targets.items()) + "</Relationships>"


WORKBOOK = {
    "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="One" r:id="rId1"/><sheet name="42" r:id="rId2"/></sheets><definedNames><definedName name="a">One!$A$1</definedName><definedName name="b" localSheetId="1">x</definedName></definedNames></workbook>',
    "xl/_rels/workbook.xml.rels": relations({"rId1": "worksheets/sheet1.xml", "rId2": "/xl/worksheets/sheet2.xml", "rId9": "../../../etc/passwd"}),
    "xl/sharedStrings.xml": "<sst><si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si></sst>",
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="0.000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>77</v></c><c r="D1" s="1"><v>1.5</v><f>A1*2</f></c><c r="E1" t="b"><v>1</v></c><c r="F1" t="e"><v>#N/A</v></c><c r="G1" t="inlineStr"><is><t>in</t></is></c><c r="AA1" t="str"><v>s</v></c><c r="H1"/><c r="I1"><v>abc</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>',
    "xl/worksheets/_rels/sheet2.xml.rels": '<Relationships><Relationship Id="rId1" Target="https://x.test/" TargetMode="External"/><Relationship Id="t" Target="../tables/table1.xml"/></Relationships>',
    "xl/tables/table1.xml": '<table name="T" ref="A1:B3" totalsRowCount="1"><tableColumns><tableColumn name="k"/><tableColumn name="v"/></tableColumns><tableStyleInfo name="S" showRowStripes="1"/></table>',
    "xl/charts/chart1.xml": '<c:chartSpace xmlns:c="c"><c:plotArea><c:barChart><c:barDir val="bar"/><c:grouping val="stacked"/><c:ser><c:order val="1"/><c:tx><c:pt idx="0"><c:v>S</c:v></c:pt></c:tx><c:cat><c:ptCount val="3"/><c:pt idx="0"><c:v>x</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>1.5</c:v></c:pt><c:pt idx="1"><c:v>n/a</c:v></c:pt></c:val></c:ser></c:barChart></c:plotArea></c:chartSpace>',
    "xl/worksheets/sheet2.xml": f'<worksheet xmlns:r="{REL}"><cols><col min="2" max="3" width="9" hidden="1"/></cols><conditionalFormatting sqref="A1:A9 C1"><cfRule type="top10" priority="2" rank="3" bottom="1" dxfId="0"/><cfRule type="colorScale" priority="1"><colorScale><cfvo type="min"/><cfvo type="num" val="5"/><color rgb="FFFF0000"/><color rgb="FF00FF00"/></colorScale></cfRule></conditionalFormatting><hyperlinks><hyperlink ref="B7:C8" r:id="rId1"/></hyperlinks><sheetData><row r="7"><c r="B7"><v>7</v></c></row></sheetData></worksheet>',
}
DOCUMENT = {
    "word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Hello </w:t></w:r><w:ins><w:r><w:rPr><w:b/></w:rPr><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p>'
    '<w:sdt><w:sdtContent><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:rPr><w:vanish/><w:b w:val="0"/></w:rPr><w:t>hidden</w:t></w:r></w:p></w:sdtContent></w:sdt>'
    '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>5</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:br w:type="page"/></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>",
    "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:type="paragraph" w:styleId="Base"><w:rPr><w:b w:val="0"/><w:sz w:val="21"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="H1"><w:basedOn w:val="Base"/><w:rPr><w:b/></w:rPr></w:style></w:styles>',
}
DECK = {
    "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": relations({"a": "slides/slide1.xml", "b": "slides/slide2.xml"}),
    "ppt/slides/slide1.xml": '<s xmlns:p="p" xmlns:a="a"><p:sp><p:cNvPr name="T"/><p:ph type="ctrTitle"/><a:p><a:r><a:t> Title </a:t></a:r></a:p></p:sp><p:graphicFrame><a:tr><a:tc><a:p><a:r><a:t>cell</a:t></a:r></a:p></a:tc></a:tr></p:graphicFrame></s>',
    "ppt/slides/slide2.xml": '<s xmlns:p="p" xmlns:a="a"><p:sp><p:ph/><a:p><a:pPr lvl="1"><a:buAutoNum/></a:pPr><a:r><a:t>first</a:t></a:r><a:br/><a:fld><a:t>2</a:t></a:fld></a:p></p:sp></s>',
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packages")
    (root / "book.xlsx").write_bytes(package(WORKBOOK))
    (root / "bad.xlsx").write_bytes(b"PK but not a package")
    (root / "none.xlsx").write_bytes(package({"x": "y"}))
    (root / "entity.xlsx").write_bytes(package({"xl/workbook.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a/>'}))
    (root / "text.docx").write_bytes(package(DOCUMENT))
    (root / "deck.pptx").write_bytes(package(DECK))
    return str(root)


def test_cells(spark, folder):
    got = {(r.sheet_idx, r.ref): r for r in spreadsheets.cells(spark, folder).collect()}
    show = {k: (r.v_type, r.v_num, r.v_text, r.v_bool, r.v_err) for k, r in got.items()}
    assert show == {
        (0, "A1"): ("text", None, "plain", None, None), (0, "B1"): ("text", None, "rich text", None, None), (0, "C1"): ("text", None, "", None, None), (0, "D1"): ("number", 1.5, None, None, None),
        (0, "E1"): ("bool", None, None, True, None), (0, "F1"): ("error", None, None, None, "#N/A"), (0, "G1"): ("text", None, "in", None, None), (0, "AA1"): ("text", None, "s", None, None),
        (0, "H1"): ("empty", None, None, None, None), (0, "I1"): ("text", None, "abc", None, None), (1, "B7"): ("number", 7.0, None, None, None),
    }
    assert (got[0, "AA1"].row, got[0, "AA1"].col, got[0, "D1"].formula, got[0, "D1"].style_index) == (1, 27, "A1*2", 1)


def test_workbook_tables(spark, folder):
    sheets = spreadsheets.sheets(spark, folder)
    assert [(r.sheet_idx, r.name, r.part) for r in sheets.where("error is null").orderBy("sheet_idx").collect()] == [(0, "One", "xl/worksheets/sheet1.xml"), (1, "42", "xl/worksheets/sheet2.xml")]
    assert {r.file_path.rpartition("/")[2] for r in sheets.where("error is not null").collect()} == {"bad.xlsx", "none.xlsx", "entity.xlsx"}
    assert spreadsheets.merges(spark, folder).where("error is null").collect()[0].ref == "A1:B2"
    assert {(r.style_index, r.num_fmt_id, r.format_code) for r in spreadsheets.number_formats(spark, folder).where("error is null").collect()} == {(0, 0, None), (1, 164, "0.000")}
    assert {(r.name, r.local_sheet, r.formula) for r in spreadsheets.defined_names(spark, folder).where("error is null").collect()} == {("a", None, "One!$A$1"), ("b", 1, "x")}


def test_side_tables(spark, folder):
    fine = lambda df: df.where("error is null")
    dims = fine(spreadsheets.dimensions(spark, folder))
    assert {(r.sheet_idx, r.axis, r["index"], r["size"], r.hidden) for r in dims.collect()} == {(1, "col", 2, 9.0, True), (1, "col", 3, 9.0, True)}
    cells = spreadsheets.cells(spark, folder)
    assert spreadsheets.visible(cells, dims).count() == cells.count() - 1 and spreadsheets.formulas(cells).count() == 1
    rules = {r.type: r for r in fine(spreadsheets.format_rules(spark, folder)).collect()}
    assert (rules["top10"].rank, rules["top10"].bottom, rules["top10"].sqref) == (3, True, "A1:A9 C1")
    assert (rules["colorScale"].stop_types, rules["colorScale"].stop_values, rules["colorScale"].colors) == (["min", "num"], [None, "5"], ["FFFF0000", "FF00FF00"])
    assert [(r.sheet_idx, r.ref, r.target) for r in fine(spreadsheets.hyperlinks(spark, folder)).collect()] == [(1, "B7", "https://x.test/")]
    table = fine(spreadsheets.tables(spark, folder)).collect()[0]
    assert (table.name, table.ref, table.header_rows, table.totals_rows, table.style, table.row_stripes, table["columns"]) == ("T", "A1:B3", 1, 1, "S", True, ["k", "v"])
    sheets = spreadsheets.sheets(spark, folder)
    assert [spreadsheets.resolve_sheet(sheets, i).count() for i in ("0", "One", "42", "no")] == [1, 1, 0, 0]
    points = charts.with_categories(fine(charts.points(spark, folder))).orderBy("idx").collect()
    assert [(r.idx, r.category, r.value, r.series_name, r.display_order, r.grouping) for r in points] == [(0, "x", 1.5, "S", 1, "stacked"), (1, "2", None, "S", 1, "stacked"), (2, "3", None, "S", 1, "stacked")]
    runs = wordprocessing.runs(spark, folder)
    assert documents.table_matrices(runs, ["file_path"]).collect()[0].rows == [["a", ""]]


def test_document(spark, folder):
    runs = wordprocessing.runs(spark, folder)
    text = documents.joined_text(runs.where("kind = 'text' and tbl is null and coalesce(vanish, false) = false"), ["block"], ["run"], F.col("text"), "")
    assert {r.block: r.text for r in text.collect()} == {0: "Hello new", 2: "5\n"}
    by = {(r.block, r.run): r for r in runs.collect()}
    assert by[0, 0].style == "H1" and by[0, 1].bold is True and (by[1, 0].list_id, by[1, 0].level, by[1, 0].bold, by[1, 0].vanish) == (3, 1, False, True)
    assert [(r.tbl, r.trow, r.tcol, r.text) for r in runs.where("tbl is not null").orderBy("tcol").collect()] == [(0, 0, 0, "a"), (0, 0, 1, "")]
    parts = documents.field_results(runs.where("block = 2"), ["file_path"], "run", "kind", "text").collect()
    assert [(r.part, r.text) for r in parts] == [("result", "5"), ("body", "\n")]
    assert by[2, 5].page_break is True
    styles = {r.style: r for r in wordprocessing.styles(spark, folder).collect()}
    assert (styles["Base"].bold, styles["Base"].size, styles["H1"].bold, styles["H1"].based_on) == (False, 10.5, True, "Base")


def test_deck(spark, folder):
    texts = presentations.paragraphs(spark, folder)
    got = {(r.slide, r.shape, r.ord, r.text, r.level, r.auto_number, r.trow) for r in texts.collect()}
    assert got == {(0, 0, 0, "first\n2", 1, True, None), (1, 0, 0, " Title ", 0, False, None), (1, 1, 0, "cell", 0, False, 0)}
    assert {r.slide: r.title for r in presentations.titles(texts).collect()} == {0: None, 1: "Title"}


def test_entries_are_capped():
    with pytest.raises(PackageError):
        Package(package({"a": "x" * 5000}), most=1000).read("a")


def test_arrivals(spark, folder, tmp_path):
    seen = []
    query = arrivals.on_new_packages(spark, folder, str(tmp_path / "checkpoint"), lambda cells, n: seen.append(cells.count()))
    query.awaitTermination()
    assert seen == [11]


def test_relations_and_themes(spark):
    refs = spark.createDataFrame([("r1", "xl/worksheets"), ("r2", "xl"), ("r3", "xl")], "rid string, folder string").withColumn("f", F.lit(1))
    rels = spark.createDataFrame([(1, "r1", "../media/a.png"), (1, "r2", "/ppt/./b.xml")], "f int, id string, target string")
    assert {r.rid: r.part for r in packages.targets(refs, rels, ["f"], "rid", "folder").collect()} == {"r1": "xl/media/a.png", "r2": "ppt/b.xml", "r3": None}
    slots = F.array(*[F.lit(c) for c in ("dk1", "lt1", "dk2", "lt2", "a1", "a2")])
    got = spark.range(7).select(packages.theme_color(slots, F.col("id").cast("int")).alias("c")).collect()
    assert [r.c for r in got] == ["lt1", "dk1", "lt2", "dk2", "a1", "a2", None]


def test_a_large_sheet_is_streamed(spark, monkeypatch):
    from gridloom.sources import packages as source

    rows = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in range(1, 3001))
    book = dict(WORKBOOK) | {"xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"}
    assert [e.get("r") for e in Package(package(book)).elements("xl/worksheets/sheet1.xml", "row")][-1] == "3000"
    monkeypatch.setattr(source, "HELD", 1000)
    broken = book | {"xl/worksheets/sheet2.xml": "<worksheet><sheetData><row>"}
    early = dict(book) | {"xl/worksheets/sheet1.xml": "<worksheet><sheetData><row>"}
    files = spark.createDataFrame([(n, bytearray(package(b))) for n, b in (("fine", book), ("late", broken), ("early", early))], "path string, content binary")
    found = spreadsheets.read_packages(spark, files, "*", lambda p: sheet_parts.tagged(p, ("cell",)), sheet_parts.TAGGED)
    counts = {(r.file_path, r.broken): r["count"] for r in found.groupBy("file_path", F.col("error").isNotNull().alias("broken")).count().collect()}
    assert counts == {("fine", False): 3001, ("late", False): 3000, ("late", True): 1, ("early", True): 1}
    with pytest.raises(PackageError, match="entities"):
        list(Package(package({"a": "<!DOCTYPE a [<!ENTITY b 'c'>]><a><row/></a>"})).elements("a", "row"))
    with pytest.raises(PackageError, match="large"):
        list(Package(package({"a": "<a>" + "<row/>" * 100_000 + "</a>"}), most=1000).elements("a", "row"))


def test_any_fault_is_one_row(spark):
    book = dict(WORKBOOK) | {"xl/worksheets/sheet2.xml": '<worksheet><cols><col min="x"/></cols></worksheet>'}
    files = spark.createDataFrame([("odd", bytearray(package(book)))], "path string, content binary")
    assert [r.error is not None for r in spreadsheets.dimensions(spark, files).collect()] == [True]


def test_what_nobody_asked_for_is_gone_as_it_ends(spark):
    """Views of a sheet and the blocks of a body don't hold what has been read before them."""
    book = {"s.xml": "<worksheet><sheetData>" + "<row><c><v>1</v></c></row>" * 60_000 + '</sheetData><autoFilter ref="A1:B2"/></worksheet>'}
    body = {wordprocessing.BODY: '<document xmlns:w="w"><body>' + "<p><r><t>x</t></r></p>" * 60_000 + "</body></document>"}
    for parts, read in ((book, lambda p: p.elements("s.xml", {"sheetViews", "autoFilter"})), (body, wordprocessing._runs)):
        held = Package(package(parts))
        tracemalloc.start()
        n = sum(1 for _ in read(held))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n in (1, 60_000) and most < 4 << 20


def test_blocks_of_a_body_as_they_are_read(spark):
    text = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = text(0) + f"<w:sdt><w:sdtPr>{text('no')}</w:sdtPr><w:sdtContent>{text(1)}<w:sdt><w:sdtContent>{text(2)}</w:sdtContent><w:sdtContent>{text('no')}</w:sdtContent></w:sdt></w:sdtContent></w:sdt>" + f"<w:del>{text('no')}</w:del><w:ins>{text(3)}</w:ins>"
    body += f"<w:tbl><w:tr><w:tc>{text(4)}<w:tbl><w:tr><w:tc>{text('no')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl><w:p><w:pPr><w:sectPr><w:sectPrChange><w:sectPr/></w:sectPrChange></w:sectPr></w:pPr></w:p><w:sectPr/>"
    read = lambda xml: Package(package({wordprocessing.BODY: xml}))
    held = read(f'<w:document xmlns:w="w"><w:background>{text("no")}</w:background><w:body>{body}</w:body><w:body>{text("no")}</w:body></w:document>')
    assert [(r[0], r[1], r[10]) for r in wordprocessing._runs(held)] == [(0, None, "0"), (1, None, "1"), (2, None, "2"), (3, None, "3"), (4, 0, "4"), (5, None, "")]
    assert [r[6] for r in wordprocessing._table_cells(held)] == ["4\nno"]
    assert len(list(wordprocessing._sections(held))) == 3
    for broken in ('<w:document xmlns:w="w"/>', "<w:document>"):
        with pytest.raises(Exception):
            list(wordprocessing._runs(read(broken)))
