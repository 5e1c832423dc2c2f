"""Packages made of the test tables, for queries that read them: a workbook and a document a nation, a deck a region.

Each package is written by the task that holds its rows.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections import Counter
from collections.abc import Iterable
from itertools import chain
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
FILES = "path string, content binary"


def package(parts: dict[str, str | bytes | Iterable[str]]) -> bytes:
    """A package of parts; one that is given in pieces is compressed as they come, and never whole."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            if isinstance(body, (str, bytes)):
                z.writestr(name, body)
            else:
                with z.open(name, "w", force_zip64=True) as f:
                    for piece in body:
                        f.write(piece.encode())
    return out.getvalue()


def relations(*targets: tuple[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="{t}"' + (' TargetMode="External"' if "://" in t else "") + "/>" for i, t in targets) + "</Relationships>"


THEME = '<a:theme xmlns:a="a"><a:themeElements><a:clrScheme name="s"><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1><a:lt1><a:srgbClr val="FFFFFF"/></a:lt1><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme><a:fontScheme><a:majorFont><a:latin typeface="Head"/></a:majorFont><a:minorFont><a:latin typeface="Text"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
STYLES = (
    '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="0.000"/></numFmts>'
    '<fonts><font><sz val="11"/><name val="Calibri"/></font><font><b/><i val="0"/><color theme="4" tint="-0.25"/><sz val="9.5"/><name val="Mono"/></font></fonts>'
    '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFFF00"/></patternFill></fill><fill><gradientFill degree="90"><stop position="1"><color rgb="FF00FF00"/></stop><stop position="0"><color theme="1"/></stop></gradientFill></fill></fills>'
    '<borders><border/><border><left style="thin"><color rgb="FF112233"/></left><bottom style="double"><color indexed="10"/></bottom></border></borders>'
    '<cellStyleXfs><xf numFmtId="0" fontId="1"/></cellStyleXfs><cellXfs><xf numFmtId="0" fontId="0"/><xf numFmtId="164" fontId="1" fillId="1" borderId="1"><alignment horizontal="right" wrapText="1"/></xf></cellXfs>'
    '<dxfs><dxf><font><b/></font><fill><patternFill><bgColor rgb="FFFF0000"/></patternFill></fill></dxf></dxfs></styleSheet>'
)


def _workbook(nation: int, rows: list[tuple[int, str, str, float]]) -> bytes:
    last, at = len(rows) + 1, {}

    def shared(text: str, rich: bool = False) -> int:
        return at.setdefault((text,) if rich else text, len(at))

    def strings():
        yield "<sst>"
        for held in at:
            rich = isinstance(held, tuple)
            yield f"<si><r><rPr><b/></rPr><t>{escape(held[0][:3])}</t></r><r><t>{escape(held[0][3:])}</t></r><rPh><t>no</t></rPh></si>" if rich else f"<si><t>{escape(held)}</t></si>"
        yield "</sst>"

    def lines():
        for r, (key, name, segment, balance) in enumerate(rows, 2):
            cells = f'<c r="A{r}"><v>{key}</v></c><c r="B{r}" t="s"><v>{shared(name)}</v></c><c r="C{r}" t="s"><v>{shared(segment, key % 2 == 1)}</v></c><c r="D{r}" s="1"><v>{balance!r}</v></c><c r="E{r}"><f>D{r}*2</f><v>{balance * 2!r}</v></c>'
            cells += f'<c r="F{r}" t="b"><v>{int(balance >= 0)}</v></c>' if key % 3 == 0 else ""
            cells += f'<c r="G{r}" t="e"><v>#N/A</v></c>' if key % 5 == 0 else ""
            cells += f'<c r="H{r}" t="inlineStr"><is><t>in {key}</t></is></c>' if key % 7 == 0 else ""
            yield f'<row r="{r}"{" hidden=\"1\" ht=\"20\"" if key % 4 == 0 else ""}>{cells}</row>'

    notes = (f'<comment ref="B{r}" authorId="{key % 2}"><text><r><t>note </t></r><r><t>{key}</t></r></text></comment>' for r, (key, *_) in enumerate(rows, 2) if key % 6 == 0)
    head = "".join(f'<c r="{c}1" t="s"><v>{shared(x)}</v></c>' for c, x in zip("ABCDE", ("key", "name", "segment", "balance", "twice"), strict=True))
    segments = sorted(Counter(x[2] for x in rows).items())
    counted = "".join(f'<row r="{i}"><c r="A{i}" t="str"><v>{escape(s)}</v></c><c r="B{i}"><v>{n}</v></c><c r="C{i}"><v>{0 if n % 2 else n}</v></c></row>' for i, (s, n) in enumerate(segments, 1))
    return package({
        "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="customers" r:id="r1"/><sheet name="segments" r:id="r2"/></sheets><definedNames><definedName name="balances">customers!$D$2:$D${last}</definedName><definedName name="Balances" localSheetId="1">segments!$B$1</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": relations(("r1", "worksheets/sheet1.xml"), ("r2", "/xl/worksheets/sheet2.xml"), ("r9", "../../../etc/passwd")),
        "xl/worksheets/sheet1.xml": chain([f'<worksheet xmlns:r="{REL}"><sheetViews><sheetView showGridLines="0"><pane ySplit="1" state="frozen"/></sheetView></sheetViews><cols><col min="1" max="1" width="9"/><col min="7" max="8" hidden="1"/></cols><sheetData><row r="1">{head}</row>'], lines(), [f'</sheetData>'
        f'<autoFilter ref="A1:E{last}"/><mergeCells><mergeCell ref="A{last + 2}:C{last + 3}"/></mergeCells>'
        f'<conditionalFormatting sqref="D2:D{last} F2:F{last}"><cfRule type="top10" priority="2" rank="3" dxfId="0"/><cfRule type="colorScale" priority="1"><colorScale><cfvo type="min"/><cfvo type="max"/><color rgb="FFFF0000"/><color rgb="FF00FF00"/></colorScale></cfRule></conditionalFormatting>'
        f'<hyperlinks><hyperlink ref="B2:C2" r:id="x"/></hyperlinks></worksheet>']),
        "xl/worksheets/_rels/sheet1.xml.rels": relations(("x", f"https://nation.test/{nation}"), ("t", "../tables/table1.xml"), ("c", "../comments1.xml")),
        "xl/worksheets/sheet2.xml": f'<worksheet><sheetViews><sheetView showZeros="0"/></sheetViews><sheetData>{counted}</sheetData><extLst><ext><sparklineGroups><sparklineGroup type="column"><sparklines><sparkline><f>customers!D2:D{last}</f><sqref>D1</sqref></sparkline></sparklines></sparklineGroup></sparklineGroups></ext></extLst></worksheet>',
        "xl/tables/table1.xml": f'<table name="T{nation}" ref="A1:E{last}" totalsRowCount="0"><tableColumns><tableColumn name="key"/><tableColumn name="name"/></tableColumns><tableStyleInfo name="S" showRowStripes="1"/></table>',
        "xl/comments1.xml": chain(["<comments><authors><author>even</author><author>odd</author></authors><commentList>"], notes, ["</commentList></comments>"]),
        "xl/sharedStrings.xml": strings(), "xl/styles.xml": STYLES, "xl/theme/theme1.xml": THEME,
        "xl/media/image1.png": b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 16 + nation, 9),
    })


def _document(nation: str, rows: list[tuple[int, str, str]]) -> bytes:
    text = lambda t: f"<w:r><w:t>{escape(t)}</w:t></w:r>"
    items = (f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{key % 3}"/><w:numId w:val="1"/></w:numPr></w:pPr>{text(name[:4])}<w:ins>{text(name[4:])}</w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r></w:p>' for key, name, _ in rows)
    cells = "".join(f"<w:tr><w:tc><w:p>{text(s)}</w:p></w:tc><w:tc><w:p>{text(str(n))}</w:p></w:tc></w:tr>" for s, n in sorted(Counter(x[2] for x in rows).items()))
    return package({
        "word/document.xml": chain([f'<w:document xmlns:w="w" xmlns:r="{REL}"><w:body><w:p><w:pPr><w:pStyle w:val="Head"/></w:pPr>{text(nation)}</w:p>'], items, [f'<w:sdt><w:sdtContent><w:tbl>{cells}</w:tbl></w:sdtContent></w:sdt><w:sectPr><w:headerReference w:type="first" r:id="h"/><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:bottom="720" w:left="1000" w:right="1000"/><w:titlePg/></w:sectPr></w:body></w:document>']),
        "word/_rels/document.xml.rels": relations(("h", "header1.xml")),
        "word/header1.xml": f'<w:hdr xmlns:w="w"><w:p>{text("about " + nation)}</w:p></w:hdr>',
        "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:type="paragraph" w:styleId="Base"><w:rPr><w:sz w:val="21"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Head"><w:basedOn w:val="Base"/><w:rPr><w:b/></w:rPr></w:style></w:styles>',
        "word/numbering.xml": '<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="4"/><w:numFmt w:val="lowerLetter"/></w:lvl><w:lvl w:ilvl="2"><w:numFmt w:val="lowerRoman"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="2"><w:startOverride w:val="7"/></w:lvlOverride></w:num></w:numbering>',
    })


def _deck(region: int, rows: list[tuple[int, str]]) -> bytes:
    """A slide a nation, on a layout with a shape of its own; the presentation lists them by falling key. Even nations, even regions' layouts and the master have backgrounds."""
    back = lambda color: f'<p:bg><p:bgPr><a:solidFill><a:srgbClr val="{color}"/></a:solidFill></p:bgPr></p:bg>'
    frame = lambda x: f'<p:spPr><a:xfrm><a:off x="{x}" y="3"/><a:ext cx="500" cy="60"/></a:xfrm></p:spPr>'
    place = lambda kind, x: f'<p:sp><p:nvSpPr><p:cNvPr name="{kind}"/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>{frame(x)}</p:sp>'
    parts = {"ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst>' + "".join(f'<p:sldId r:id="s{k}"/>' for k, _ in sorted(rows, reverse=True)) + "</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": relations(*[(f"s{k}", f"slides/slide{k}.xml") for k, _ in rows])}
    logo = f'<p:sp><p:nvSpPr><p:cNvPr name="Logo"/></p:nvSpPr>{frame(1)}</p:sp>'
    parts["ppt/slideLayouts/slideLayout1.xml"] = f'<p:sldLayout xmlns:p="p" xmlns:a="a"><p:cSld>{back("BBBBBB") if region % 2 == 0 else ""}<p:spTree>{logo}{place("title", 11)}</p:spTree></p:cSld></p:sldLayout>'
    parts["ppt/slideLayouts/_rels/slideLayout1.xml.rels"] = relations(("m", "../slideMasters/slideMaster1.xml"))
    parts["ppt/slideMasters/slideMaster1.xml"] = f'<p:sldMaster xmlns:p="p" xmlns:a="a"><p:cSld>{back("AAAAAA")}<p:spTree>{place("title", 21)}{place("body", 22)}</p:spTree></p:cSld></p:sldMaster>'
    for k, name in rows:
        parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = relations(("l", "../slideLayouts/slideLayout1.xml"))
        parts[f"ppt/slides/slide{k}.xml"] = (
            f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld>{back("CCCCCC") if k % 2 == 0 else ""}<p:spTree><p:sp><p:nvSpPr><p:cNvPr name="Title"/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(name)}</a:t></a:r></a:p></p:txBody></p:sp>'
            f'<p:sp><p:nvSpPr><p:cNvPr name="Body"/><p:nvPr><p:ph idx="1"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{k * 100}" y="7"/><a:ext cx="900" cy="80"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>key</a:t></a:r></a:p><a:p><a:pPr lvl="1"><a:buAutoNum type="arabicPeriod"/></a:pPr><a:r><a:t>{k}</a:t></a:r></a:p></p:txBody></p:sp>'
            f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr name="Table"/></p:nvGraphicFramePr><a:tbl><a:tr><a:tc><a:p><a:r><a:t>square</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>{k * k}</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>'
        )
    return package(parts)


#: Built-in styles of the made tables: in the first accent with bands, and shades of the second.
TABLE_STYLES = ("{5C22544A-7EE6-4342-B048-85BDC9FD1C3A}", "{37CE84F3-28C3-443E-9E96-99CF82512B78}")


def _table_deck(region: int, nations: list[int]) -> bytes:
    """A slide a nation with a table of four rows and three columns, whose spans, switches and fills follow from the nation's key, and a theme that follows from the region's."""
    accents = (40 + region * 10, 100 + region * 20, 200), (200 - region * 9, 50 + region * 11, 70)
    theme = '<a:theme xmlns:a="a"><a:themeElements><a:clrScheme><a:dk1><a:srgbClr val="101010"/></a:dk1><a:lt1><a:srgbClr val="FEFEFE"/></a:lt1>' + "".join(f'<a:accent{i}><a:srgbClr val="{r:02X}{g:02X}{b:02X}"/></a:accent{i}>' for i, (r, g, b) in enumerate(accents, 1)) + "</a:clrScheme></a:themeElements></a:theme>"
    parts = {"ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst>' + "".join(f'<p:sldId r:id="s{k}"/>' for k in nations) + "</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": relations(*[(f"s{k}", f"slides/slide{k}.xml") for k in nations]), "ppt/theme/theme1.xml": theme}
    for k in nations:
        span = {(0, 0): ' gridSpan="3"' * (k % 2 == 0), (1, 0): ' rowSpan="2"' * (k % 3 == 0), (3, 1): ' gridSpan="2" rowSpan="5"' * (k % 5 == 0)}
        gone = {(0, 1): ' hMerge="1"' * (k % 2 == 0), (0, 2): ' hMerge="1"' * (k % 2 == 0), (2, 0): ' vMerge="1"' * (k % 3 == 0), (3, 2): ' hMerge="1"' * (k % 5 == 0)}
        cell = lambda r, c: f'<a:tc{span.get((r, c), "")}{gone.get((r, c), "")}><a:txBody><a:p><a:r><a:t>{k * 100 + r * 10 + c}</a:t></a:r></a:p></a:txBody>' + (f'<a:tcPr><a:solidFill><a:srgbClr val="AB{k:02X}CD"/></a:solidFill></a:tcPr>' if (r, c) == (2, 2) and k % 6 == 0 else "") + "</a:tc>"  # noqa: B023, E731
        rows = "".join(f'<a:tr h="{10 * (r + 1)}">' + "".join(cell(r, c) for c in range(3)) + "</a:tr>" for r in range(4))
        on = f' firstRow="{int(k % 4 != 1)}" bandRow="{int(k % 4 != 2)}" firstCol="{int(k % 4 == 3)}" lastRow="{int(k % 7 == 0)}"'
        parts[f"ppt/slides/slide{k}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:graphicFrame><a:tbl><a:tblPr{on}><a:tableStyleId>{TABLE_STYLES[region % 2]}</a:tableStyleId></a:tblPr><a:tblGrid>' + "".join(f'<a:gridCol w="{100 * c + k}"/>' for c in (1, 2, 3)) + f"</a:tblGrid>{rows}</a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>"
    return package(parts)


def table_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``r<key>.pptx`` of each region: tables with spans and styles."""

    return _by_region(spark, sf_dir, _table_deck)


def _deck_of(slides: dict[int, str], more: dict[str, str]) -> bytes:
    """A deck of slides by falling key, each on the one layout of the one master that ``more`` has."""
    keys = sorted(slides, reverse=True)
    parts = {"ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst>' + "".join(f'<p:sldId r:id="s{k}"/>' for k in keys) + "</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": relations(*[(f"s{k}", f"slides/slide{k}.xml") for k in keys])}
    parts["ppt/slideLayouts/_rels/slideLayout1.xml.rels"] = relations(("m", "../slideMasters/slideMaster1.xml"))
    for k, tree in slides.items():
        parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = relations(("l", "../slideLayouts/slideLayout1.xml"))
        parts[f"ppt/slides/slide{k}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>'
    return package(parts | more)


def _text_deck(region: int, nations: list[int]) -> bytes:
    """Placeholders with and without index and type, whose texts inherit from the layout, the master and its text styles."""
    place = lambda ph, level="", x=None: f'<p:sp><p:nvSpPr><p:nvPr><p:ph {ph}/></p:nvPr></p:nvSpPr><p:spPr>{"" if x is None else f"""<a:xfrm><a:off x="{x}" y="3"/><a:ext cx="500" cy="60"/></a:xfrm>"""}</p:spPr><p:txBody><a:bodyPr/><a:lstStyle>{level}</a:lstStyle></p:txBody></p:sp>'
    level = lambda more="", run="", inner="": f"<a:lvl1pPr {more}><a:defRPr {run}>{inner}</a:defRPr></a:lvl1pPr>"
    paint = lambda kind, value: f'<a:solidFill><a:{kind} val="{value}"/></a:solidFill>'
    layout = place('type="title"', level('algn="ctr"'), 11) + place('idx="1"', level("", f'b="1" sz="{2000 + 100 * region}"'), 12) + place('type="ftr" idx="11"', level("", 'sz="900"'), 13) + place('type="dt"', level("", "", paint("srgbClr", "112233")), 14)
    master = place('type="title"', level("", 'sz="4400"'), 21) + place('type="body"', level('algn="r"', "", paint("schemeClr", f"accent{region % 3 + 1}")), 22)
    styles = f'<p:txStyles><p:titleStyle>{level("", "i=" + chr(34) + "1" + chr(34))}</p:titleStyle><p:bodyStyle>{level("", "sz=" + chr(34) + "1800" + chr(34))}</p:bodyStyle><p:otherStyle>{level("", f"sz={chr(34)}{1000 + 100 * region}{chr(34)}")}</p:otherStyle></p:txStyles>'

    def shape(n: int, ph: str, k: int) -> str:
        own = f' sz="{(k + 10) * 100}"' if k % 3 == 0 else ""
        return f'<p:sp><p:nvSpPr><p:nvPr><p:ph {ph}/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:rPr{own}/><a:t>{k}-{n}</a:t></a:r></a:p></p:txBody></p:sp>'

    slides = {k: "".join(shape(n, ph, k) for n, ph in enumerate(('type="title"', 'idx="1"', "", 'type="ftr"', 'type="sldNum" idx="11"', 'type="dt"'))) for k in nations}
    return _deck_of(slides, {
        "ppt/slideLayouts/slideLayout1.xml": f'<p:sldLayout xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{layout}</p:spTree></p:cSld></p:sldLayout>',
        "ppt/slideMasters/slideMaster1.xml": f'<p:sldMaster xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{master}</p:spTree></p:cSld>{styles}</p:sldMaster>',
    })


def _group_deck(region: int, nations: list[int]) -> bytes:
    """Shapes in a group, and in a group within it, that is moved, scaled, turned and mirrored by the nation's key; and a shape outside."""
    frame = lambda tag, at, size, inner=None, more="": f'<p:{tag}><a:xfrm{more}><a:off x="{at[0]}" y="{at[1]}"/><a:ext cx="{size[0]}" cy="{size[1]}"/>' + ("" if inner is None else '<a:chOff x="{}" y="{}"/><a:chExt cx="{}" cy="{}"/>'.format(*inner)) + f"</a:xfrm></p:{tag}>"
    slides = {}
    for k in nations:
        a, b, free = frame("spPr", (20, 10), (40, 20)), frame("spPr", (20, 15), (10, 6), None, ' rot="1800000"'), frame("spPr", (k, 1), (7, 8))
        inner = frame("grpSpPr", (100, 50), (80, 40), (10, 10, 40, 20), f' flipV="{int(k % 3 == 0)}"')
        outer = frame("grpSpPr", (k * 10, 6), (400, 200), (0, 0, 200, 100), f' rot="{k % 4 * 5400000}" flipH="{int(k % 2)}"')
        slides[k] = f"<p:grpSp>{outer}<p:sp>{a}</p:sp><p:grpSp>{inner}<p:sp>{b}</p:sp></p:grpSp></p:grpSp><p:sp>{free}</p:sp>"
    empty = '<p:{0} xmlns:p="p"><p:cSld><p:spTree/></p:cSld></p:{0}>'
    return _deck_of(slides, {"ppt/slideLayouts/slideLayout1.xml": empty.format("sldLayout"), "ppt/slideMasters/slideMaster1.xml": empty.format("sldMaster")})


def _shape_deck(region: int, nations: list[int]) -> bytes:
    """A custom shape a nation: a corner that a guide cuts, an arc, a curve, and a second outline in the shape's own size."""
    slides = {}
    for k in nations:
        pt = lambda *xy: "".join(f'<a:pt x="{x}" y="{y}"/>' for x, y in xy)
        first = f'<a:path w="200" h="100"><a:moveTo>{pt((k, 0))}</a:moveTo><a:lnTo>{pt(("cut", 50))}</a:lnTo><a:arcTo wR="20" hR="10" stAng="cd4" swAng="cd2"/><a:arcTo wR="k" hR="k" stAng="0" swAng="5400000"/><a:cubicBezTo>{pt((1, 1), (2, 2), (150, "k"))}</a:cubicBezTo><a:close/></a:path>'
        second = f'<a:path><a:moveTo>{pt(("l", "vc"))}</a:moveTo><a:lnTo>{pt(("r", "b"))}</a:lnTo></a:path>'
        guides = f'<a:avLst><a:gd name="k" fmla="val {k}"/></a:avLst><a:gdLst><a:gd name="half" fmla="*/ w 1 2"/><a:gd name="cut" fmla="+- half 0 k"/></a:gdLst>'
        slides[k] = f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{100 + 2 * k}" cy="60"/></a:xfrm><a:custGeom>{guides}<a:pathLst>{first}{second}</a:pathLst></a:custGeom></p:spPr></p:sp>'
    empty = '<p:{0} xmlns:p="p"><p:cSld><p:spTree/></p:cSld></p:{0}>'
    return _deck_of(slides, {"ppt/slideLayouts/slideLayout1.xml": empty.format("sldLayout"), "ppt/slideMasters/slideMaster1.xml": empty.format("sldMaster")})


def shape_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``r<key>.pptx`` of each region: custom shapes."""
    return _by_region(spark, sf_dir, _shape_deck)


def _by_region(spark: SparkSession, sf_dir: str, write) -> DataFrame:
    def make(frame: pd.DataFrame) -> pd.DataFrame:
        region = int(frame["n_regionkey"].iloc[0])
        return pd.DataFrame({"path": [f"r{region}.pptx"], "content": [write(region, sorted(frame["n_nationkey"].tolist()))]})

    return table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(make, FILES)


def text_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``r<key>.pptx`` of each region: inherited texts."""
    return _by_region(spark, sf_dir, _text_deck)


def group_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``r<key>.pptx`` of each region: grouped shapes."""
    return _by_region(spark, sf_dir, _group_deck)


def _table_book(rows: list[tuple[int, float]]) -> bytes:
    """Keys, balances and doubles under a table of them all, over which a second one with its own header and totals lies from the third row on."""
    last = len(rows) + 1
    lines = (f'<row r="{r}"><c r="A{r}"><v>{k}</v></c><c r="B{r}"><v>{b!r}</v></c><c r="C{r}"><v>{b * 2!r}</v></c></row>' for r, (k, b) in enumerate(rows, 2))
    named = lambda ref, more, style, on: f'<table displayName="{style}" ref="{ref}"{more}><tableStyleInfo name="{style}" {on}/></table>'
    return package({
        "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations(("r1", "worksheets/sheet1.xml")),
        "xl/worksheets/sheet1.xml": chain(['<worksheet><sheetData><row r="1"><c r="A1" t="str"><v>key</v></c></row>'], lines, ["</sheetData></worksheet>"]), "xl/worksheets/_rels/sheet1.xml.rels": relations(("a", "../tables/table1.xml"), ("b", "../tables/table2.xml")),
        "xl/tables/table1.xml": named(f"A1:C{last}", "", "Wide", 'showRowStripes="1" showLastColumn="1"'), "xl/tables/table2.xml": named(f"B3:C{last - 1}", ' totalsRowCount="1"', "TableStyleMedium12", 'showFirstColumn="1"'),
        "xl/styles.xml": '<styleSheet><tableStyles><tableStyle name="Wide"><tableStyleElement type="wholeTable" dxfId="4"/><tableStyleElement type="headerRow" dxfId="2"/><tableStyleElement type="secondRowStripe" dxfId="7"/></tableStyle></tableStyles></styleSheet>',
    })


def _chart_book(region: int, nations: list[int]) -> bytes:
    """A chart of a region's nations: bars of their keys and of doubles, and a line, in another order than they stand, with labels of every kind."""
    def cache(tag: str, values: list, kind: str = "num") -> str:
        points = "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in enumerate(values) if v is not None)
        return f'<c:{tag}><c:{kind}Ref><c:{kind}Cache><c:ptCount val="{len(values)}"/>{points}</c:{kind}Cache></c:{kind}Ref></c:{tag}>'

    names = cache("cat", [f"N{k}" for k in nations], "str")
    series = lambda order, name, values, more="": f'<c:ser><c:order val="{order}"/>{cache("tx", [name], "str")}{more}{names}{cache("val", values)}</c:ser>'
    own = '<c:dLbl><c:idx val="0"/><c:delete val="1"/></c:dLbl><c:dLbl><c:idx val="1"/><c:tx><c:rich><a:p><a:r><a:t>p</a:t></a:r><a:fld type="CELLRANGE"><a:t>x</a:t></a:fld><a:r><a:t>s</a:t></a:r></a:p></c:rich></c:tx><c:dLblPos val="t"/></c:dLbl>'
    cells = '<c:extLst><c:ext><c15:datalabelsRange><c15:dlblRangeCache>' + "".join(f'<c:pt idx="{i}"><c:v>c{k}</c:v></c:pt>' for i, k in enumerate(nations)) + "</c15:dlblRangeCache></c15:datalabelsRange></c:ext></c:extLst>"
    first = series(2, "keys", nations, f'<c:dLbls>{own}<c:dLblPos val="ctr"/><c:showVal val="1"/><c:showCatName val="1"/></c:dLbls>{cells}')
    second = series(0, "twice", [None if k % 4 == 0 else -2 * k for k in nations], '<c:dLbls><c:numFmt formatCode="#,##0.0;[Red](#,##0.0)"/><c:showVal val="1"/><c:showSerName val="1"/></c:dLbls>')
    chart = f'<c:chartSpace xmlns:c="c" xmlns:a="a" xmlns:c15="c15"><c:chart><c:plotArea><c:barChart><c:barDir val="col"/><c:grouping val="stacked"/>{first}{second}</c:barChart><c:lineChart>{series(1, "line", [k / 8 for k in nations])}</c:lineChart></c:plotArea></c:chart></c:chartSpace>'
    return package({"xl/workbook.xml": "<workbook><sheets/></workbook>", "xl/charts/chart1.xml": chart})


def chart_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``r<key>.pptx`` of each region, with a chart part as both kinds of packages have it."""
    return _by_region(spark, sf_dir, _chart_book)


def _rule_book(rows: list[tuple[int, float]]) -> bytes:
    """Keys, balances and thresholds under four rules of relative, mixed and fixed references; the block of the second has two ranges."""
    last = len(rows) + 1
    lines = (f'<row r="{r}"><c r="A{r}"><v>{k}</v></c><c r="B{r}"><v>{b!r}</v></c><c r="C{r}"><v>{k * 10}</v></c></row>' for r, (k, b) in enumerate(rows, 2))
    rule = lambda sqref, formula, priority, more="": f'<conditionalFormatting sqref="{sqref}"><cfRule type="expression" priority="{priority}" dxfId="{priority}"{more}><formula>{escape(formula)}</formula></cfRule></conditionalFormatting>'
    found = rule(f"A2:A{last}", "$B2>0", 3) + rule(f"B2:B{last} C3:C{last}", "B2>C2", 2, ' stopIfTrue="1"') + rule(f"B2:C{last}", "$C$1<=C2", 1) + rule(f"A2:C{last}", "A3<>A2", 4)
    return package({
        "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations(("r1", "worksheets/sheet1.xml")),
        "xl/worksheets/sheet1.xml": chain(['<worksheet><sheetData><row r="1"><c r="C1"><v>500</v></c></row>'], lines, [f"</sheetData>{found}</worksheet>"]),
        "xl/styles.xml": "<styleSheet><dxfs><dxf/>" + "".join(f'<dxf><numFmt numFmtId="{170 + i}" formatCode="[Red]0.{"0" * i}"/><border><bottom style="thin"><color rgb="FF{len(rows):06X}"/></bottom><top/></border></dxf>' for i in (1, 2, 3)) + "<dxf/></dxfs></styleSheet>",
    })


def rule_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n<key>.xlsx`` of each nation's customers under rules with references."""
    return _by_nation(spark, sf_dir, _rule_book)


def _by_nation(spark: SparkSession, sf_dir: str, write) -> DataFrame:
    def make(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c_custkey")
        return pd.DataFrame({"path": [f"n{int(frame['c_nationkey'].iloc[0])}.xlsx"], "content": [write(list(zip(frame["c_custkey"].tolist(), frame["c_acctbal"].astype(float).tolist(), strict=True)))]})

    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(make, FILES)


def table_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n<key>.xlsx`` of each nation's customers under two tables."""
    return _by_nation(spark, sf_dir, _table_book)


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n<key>.xlsx`` of each nation's customers, and one file that is no package."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        frame, nation = frame.sort_values("c_custkey"), int(frame["c_nationkey"].iloc[0])
        rows = list(zip(frame["c_custkey"].tolist(), frame["c_name"], frame["c_mktsegment"], frame["c_acctbal"].astype(float).tolist(), strict=True))
        return pd.DataFrame({"path": [f"n{nation}.xlsx"], "content": [_workbook(nation, rows)]})

    made = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment", "c_acctbal").groupBy("c_nationkey").applyInPandas(make, FILES)
    return made.union(spark.createDataFrame([("broken.xlsx", bytearray(b"PK no package"))], FILES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n<key>.docx`` of each nation's customers."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        frame, nation = frame.sort_values("c_custkey"), int(frame["c_nationkey"].iloc[0])
        return pd.DataFrame({"path": [f"n{nation}.docx"], "content": [_document(frame["n_name"].iloc[0], list(zip(frame["c_custkey"].tolist(), frame["c_name"], frame["c_mktsegment"], strict=True)))]})

    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_nationkey", "n_name", "c_custkey", "c_name", "c_mktsegment").groupBy("c_nationkey").applyInPandas(make, FILES)


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``r<key>.pptx`` of each region's nations."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [f"r{int(frame['n_regionkey'].iloc[0])}.pptx"], "content": [_deck(int(frame["n_regionkey"].iloc[0]), list(zip(frame["n_nationkey"].tolist(), frame["n_name"], strict=True)))]})

    return table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(make, FILES)
