"""Word-processor documents: paragraphs, runs, table cells and styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .packages import Package, PackageError, attribute, below, child, local, read_packages

BODY = "word/document.xml"
#: What the blocks of a body are looked for in; deletions have none.
_OPENED = {"sdt": "sdtContent", "ins": True, "hyperlink": True, "smartTag": True, "fldSimple": True, "del": None}


def _run_text(run) -> str:
    out = []
    for e in run:
        kind = local(e)
        out.append((e.text or "") if kind == "t" else "\t" if kind == "tab" else "\n" if kind in ("br", "cr") else "")
    return "".join(out)


def _inner(element):
    """Children, with content controls and insertions opened and deletions left out."""
    for e in element:
        kind = local(e)
        if kind == "sdt":
            content = child(e, "sdtContent")
            yield from _inner(content) if content is not None else ()
        elif kind in ("ins", "hyperlink", "smartTag", "fldSimple"):
            yield from _inner(e)
        elif kind != "del":
            yield e


def _blocks(package: Package):
    """Blocks of the body as they are read, with content controls and insertions opened and deletions left out; memory follows the largest block."""
    if BODY not in package.names:
        raise PackageError("no document")
    return package.contents(BODY, "body", _OPENED)


def _on(element, name: str) -> bool | None:
    """A toggle: missing, or its value."""
    e = child(element, name) if element is not None else None
    return None if e is None else (attribute(e, "val") or "1") not in ("0", "false", "off")


def _paragraph(p):
    props = child(p, "pPr")
    style = child(props, "pStyle") if props is not None else None
    number = child(props, "numPr") if props is not None else None
    level, list_ = (child(number, n) if number is not None else None for n in ("ilvl", "numId"))
    value = lambda e: attribute(e, "val") if e is not None else None
    return value(style), int(value(list_)) if list_ is not None else None, int(value(level) or 0) if number is not None else None


def _runs(package: Package):
    table = -1
    for n, block in enumerate(_blocks(package)):
        if local(block) == "p":
            yield from _paragraph_runs(block, n, None, None, None, 0)
        elif local(block) == "tbl":
            table += 1
            for r, row in enumerate(e for e in _inner(block) if local(e) == "tr"):
                for c, cell in enumerate(e for e in _inner(row) if local(e) == "tc"):
                    for k, p in enumerate(e for e in _inner(cell) if local(e) == "p"):
                        yield from _paragraph_runs(p, n, table, r, c, k)


def _paragraph_runs(p, block, table, row, col, part):
    style, list_, level = _paragraph(p)
    found = False
    for i, r in enumerate(e for e in _inner(p) if local(e) == "r"):
        found = True
        props, field = child(r, "rPr"), child(r, "fldChar")
        code = child(r, "instrText")
        kind = attribute(field, "fldCharType") if field is not None else "code" if code is not None else "text"
        yield block, table, row, col, part, i, style, list_, level, kind, _run_text(r) if code is None else code.text, _on(props, "b"), _on(props, "vanish"), any(attribute(b, "type") == "page" for b in below(r, "br"))
    if not found:
        yield block, table, row, col, part, 0, style, list_, level, "text", "", None, None, False


RUNS = "block int, tbl int, trow int, tcol int, part int, run int, style string, list_id int, level int, kind string, text string, bold boolean, vanish boolean, page_break boolean"


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A row a run: ``block`` is the body ordinal, ``tbl``, ``trow``, ``tcol`` and ``part`` place it in a table."""
    return read_packages(spark, path, "*.docx", _runs, RUNS)


def _table_cells(package: Package):
    for n, table in enumerate(b for b in _blocks(package) if local(b) == "tbl"):
        for r, row in enumerate(e for e in _inner(table) if local(e) == "tr"):
            outer = child(row, "trPr")
            skip = child(outer, "gridBefore") if outer is not None else None
            for c, cell in enumerate(e for e in _inner(row) if local(e) == "tc"):
                props = child(cell, "tcPr")
                span, merge = (child(props, n) if props is not None else None for n in ("gridSpan", "vMerge"))
                text = "\n".join("".join(t.text or "" for t in below(p, "t")) for p in below(cell, "p"))
                yield n, r, c, int(attribute(skip, "val")) if skip is not None else 0, int(attribute(span, "val") or 1) if span is not None else 1, (attribute(merge, "val") or "continue") if merge is not None else None, text


def table_cells(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Cells of a body's tables with their spans; a merge without a value goes on with the cell above."""
    return read_packages(spark, path, "*.docx", _table_cells, "tbl int, row int, ord int, skipped int, span int, merge string, text string")


def _styles(package: Package):
    root = package.xml("word/styles.xml")
    for s in below(root, "style") if root is not None else ():
        based, props, para = child(s, "basedOn"), child(s, "rPr"), child(s, "pPr")
        size, spacing = (child(props, "sz") if props is not None else None), (child(para, "spacing") if para is not None else None)
        yield (
            attribute(s, "styleId"), attribute(s, "type"), attribute(based, "val") if based is not None else None, _on(props, "b"), _on(props, "i"),
            float(attribute(size, "val")) / 2 if size is not None else None, float(attribute(spacing, "after")) / 20 if spacing is not None and attribute(spacing, "after") else None,
        )


def styles(spark: SparkSession, path: str) -> DataFrame:
    return read_packages(spark, path, "*.docx", _styles, "style string, type string, based_on string, bold boolean, italic boolean, size double, space_after double")


def _numbering(package: Package):
    root = package.xml("word/numbering.xml")
    if root is None:
        return
    shared = {attribute(a, "abstractNumId"): list(below(a, "lvl")) for a in root if local(a) == "abstractNum"}
    value = lambda e, name: attribute(child(e, name), "val") if child(e, name) is not None else None
    for num in (e for e in root if local(e) == "num"):
        starts = {attribute(o, "ilvl"): value(o, "startOverride") for o in below(num, "lvlOverride")}
        for level in shared.get(value(num, "abstractNumId"), ()):
            at = attribute(level, "ilvl")
            yield int(attribute(num, "numId")), int(at), value(level, "numFmt") or "decimal", value(level, "lvlText"), int(starts.get(at) or value(level, "start") or 1)


def numbering(spark: SparkSession, path: str) -> DataFrame:
    """Levels of each list, start overrides applied."""
    return read_packages(spark, path, "*.docx", _numbering, "list_id int, level int, format string, pattern string, start int")


def _section_marks(package: Package):
    return (s for e in package.elements(BODY, "sectPr") for s in below(e, "sectPr"))


def _sections(package: Package):
    for k, section in enumerate(_section_marks(package)):
        size, margins = child(section, "pgSz"), child(section, "pgMar")
        points = lambda e, name: int(attribute(e, name)) / 20 if e is not None and attribute(e, name) else None
        kind = child(section, "type")
        yield k, points(size, "w"), points(size, "h"), *(points(margins, n) for n in ("top", "bottom", "left", "right")), attribute(kind, "val") if kind is not None else "nextPage", child(section, "titlePg") is not None


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Page sizes and margins in points."""
    return read_packages(spark, path, "*.docx", _sections, "section int, width double, height double, top double, bottom double, left double, right double, starts_on string, own_first boolean")


def _headers(package: Package):
    targets = package.relations(BODY)
    for k, section in enumerate(_section_marks(package)):
        for e in section:
            if local(e) in ("headerReference", "footerReference"):
                part = targets.get(next((v for a, v in e.attrib.items() if a.endswith("}id")), None))
                held = package.xml(part) if part else None
                text = "\n".join("".join(_run_text(r) for r in _inner(p) if local(r) == "r") for p in below(held, "p")) if held is not None else None
                yield k, local(e).removesuffix("Reference"), attribute(e, "type") or "default", part, text


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers and footers of the sections: ``section, kind, pages, part, text``."""
    return read_packages(spark, path, "*.docx", _headers, "section int, kind string, pages string, part string, text string")


def even_headers(spark: SparkSession, path: str) -> DataFrame:
    """Whether even pages have headers of their own."""
    def read(package: Package):
        root = package.xml("word/settings.xml")
        yield (bool(_on(root, "evenAndOddHeaders")),)

    return read_packages(spark, path, "*.docx", read, "even boolean")


def _tab_stops(package: Package):
    for n, block in enumerate(_blocks(package) if BODY in package.names else ()):
        props = child(block, "pPr")
        stops = [(int(attribute(t, "pos") or 0) / 20, attribute(t, "val"), attribute(t, "leader")) for t in below(props, "tab")] if props is not None else []
        for k, stop in enumerate(sorted(stops, key=lambda s: s[0])):
            yield n, k, *stop


def tab_stops(spark: SparkSession, path: str) -> DataFrame:
    """Tab stops of paragraphs by position, in points."""
    return read_packages(spark, path, "*.docx", _tab_stops, "block int, ord int, position double, kind string, leader string")


def _drawings(package: Package):
    targets = package.relations(BODY)
    for n, block in enumerate(_blocks(package) if BODY in package.names else ()):
        for held in (e for e in block.iter() if local(e) in ("inline", "anchor")):
            extent, name = child(held, "extent"), next((e.get("name") for e in below(held, "docPr")), None)
            rid = next((v for e in below(held, "blip") for a, v in e.attrib.items() if a.endswith("}embed")), None)
            size = [int(extent.get(a)) / 12700 if extent is not None else None for a in ("cx", "cy")]
            yield n, local(held), name, *size, targets.get(rid), int(held.get("relativeHeight") or 0), held.get("behindDoc") in ("1", "true")


def drawings(spark: SparkSession, path: str) -> DataFrame:
    """Inline and anchored drawings, sizes in points; ``z`` orders those that overlap."""
    return read_packages(spark, path, "*.docx", _drawings, "block int, kind string, name string, width double, height double, target string, z long, behind boolean")
