"""Everything that a workbook's sheets hold, from one pass over each sheet's part.

A sheet is streamed element by element; rows of cells, merges, sizes, rules,
links, views and sparklines come out as they end, each tagged with its kind, so
memory follows the largest element and not the sheet. ``read_once`` writes the
tagged rows by kind, and every table of the sheets is then a scan of one kind.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packages import Package, PackageError, below, child, local, read_packages

WORKBOOK, STRINGS = "xl/workbook.xml", "xl/sharedStrings.xml"
#: A tagged row: cells use the plain columns, other kinds a reference and a body of their own columns.
TAGGED = "kind string, sheet_idx int, sheet string, ref string, t string, raw string, held string, style_index int, formula string, body string"
#: Columns of the kinds' bodies.
BODIES = {
    "merge": "", "dim": "axis string, index int, size double, hidden boolean", "link": "target string",
    "rule": "cf_idx int, rule_idx int, sqref string, type string, priority int, operator string, formulas array<string>, dxf_id int, stop_if_true boolean, rank int, percent boolean, bottom boolean, stop_types array<string>, stop_values array<string>, colors array<string>",
    "extension": "id string, sqref string, type string, priority int, formulas array<string>, gradient boolean, icon_sets array<string>, icon_ids array<int>",
    "view": "frozen_rows int, frozen_cols int, show_zeros boolean, grid_lines boolean, filter_ref string", "sparkline": "line_group int, kind string, gaps string, values_ref string",
}
KINDS = ("cell", *BODIES)
#: Elements that a kind is made of.
_MADE_OF = {"cell": {"row"}, "dim": {"row", "col"}, "merge": {"mergeCell"}, "rule": {"conditionalFormatting"}, "extension": {"conditionalFormatting"}, "link": {"hyperlink"}, "view": {"sheetViews", "autoFilter"}, "sparkline": {"sparklineGroup"}}
_YES = ("1", "true")


def listed(package: Package) -> Iterator[tuple[int, str, str | None]]:
    """Index, name and part of each sheet."""
    root = package.xml(WORKBOOK)
    if root is None:
        raise PackageError("no workbook")
    relations = package.relations(WORKBOOK)
    for i, s in enumerate(below(root, "sheet")):
        yield i, s.get("name"), relations.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None))


def strings(package: Package) -> Iterator[tuple[int, str]]:
    """Shared strings, one after the other; what is only a reading aid is left out."""
    for i, item in enumerate(package.elements(STRINGS, "si")):
        phonetic = {id(t) for r in below(item, "rPh") for t in below(r, "t")}
        yield i, "".join(t.text or "" for t in below(item, "t") if id(t) not in phonetic)


def _whole(value: str | None) -> int | None:
    return int(value) if value else None


def _cells(row, texts: dict[int, str]):
    for c in (c for c in row if local(c) == "c"):
        value, formula, inline = child(c, "v"), child(c, "f"), child(c, "is")
        raw, kind, text = value.text if value is not None else None, c.get("t"), None
        if kind == "s" and raw is not None:
            text = texts.get(int(raw), "") if raw.isdigit() else ""
        elif inline is not None:
            text = "".join(t.text or "" for t in below(inline, "t"))
        yield c.get("r"), kind, raw, text, int(c.get("s") or 0), formula.text if formula is not None else None


def _rule(block, b: int, r: int, rule) -> dict:
    stops = [(v.get("type"), v.get("val")) for v in below(rule, "cfvo")]
    return {
        "cf_idx": b, "rule_idx": r, "sqref": block.get("sqref"), "type": rule.get("type"), "priority": int(rule.get("priority") or 0), "operator": rule.get("operator"), "formulas": [f.text for f in rule if local(f) == "formula"],
        "dxf_id": _whole(rule.get("dxfId")), "stop_if_true": rule.get("stopIfTrue") in _YES, "rank": _whole(rule.get("rank")), "percent": rule.get("percent") in _YES, "bottom": rule.get("bottom") in _YES,
        "stop_types": [t for t, _ in stops], "stop_values": [v for _, v in stops], "colors": [c.get("rgb") for c in below(rule, "color")],
    }


def _extension(sqref: str | None, rule) -> dict:
    icons, bar = [(c.get("iconSet"), int(c.get("iconId") or 0)) for c in below(rule, "cfIcon")], next(below(rule, "dataBar"), None)
    return {
        "id": rule.get("id"), "sqref": sqref, "type": rule.get("type"), "priority": int(rule.get("priority") or 0), "formulas": [f.text for f in below(rule, "f")],
        "gradient": bar.get("gradient") not in ("0", "false") if bar is not None else None, "icon_sets": [s for s, _ in icons], "icon_ids": [k for _, k in icons],
    }


def _view(views, filtered: str | None) -> dict:
    view, pane = (next(below(views, n), None) if views is not None else None for n in ("sheetView", "pane"))
    frozen = [int(float(pane.get(n) or 0)) if pane is not None and pane.get("state") in ("frozen", "frozenSplit") else 0 for n in ("ySplit", "xSplit")]
    shown = [view is None or view.get(n) not in ("0", "false") for n in ("showZeros", "showGridLines")]
    return {"frozen_rows": frozen[0], "frozen_cols": frozen[1], "show_zeros": shown[0], "grid_lines": shown[1], "filter_ref": filtered}


def tagged(package: Package, kinds: tuple[str, ...] = KINDS, only: int | None = None) -> Iterator[tuple]:
    """Tagged rows of all sheets, or of the sheet of index ``only``; each sheet's part is opened once."""
    texts = dict(strings(package)) if "cell" in kinds else {}
    names = set().union(*(_MADE_OF[k] for k in kinds))
    for i, name, part in listed(package):
        if part is None or part not in package.names or only not in (None, i):
            continue

        def row(kind: str, ref: str | None = None, body: dict | None = None, i=i, name=name):
            return (kind, i, name, ref, None, None, None, None, None, json.dumps(body) if body is not None else None)

        links = package.relations(part, external=True) if "link" in kinds else {}
        blocks = groups = 0
        views, filtered = None, None
        for e in package.elements(part, names):
            what = local(e)
            if what == "row":
                if "dim" in kinds and (e.get("ht") or e.get("hidden")):
                    yield row("dim", None, {"axis": "row", "index": int(e.get("r")), "size": float(e.get("ht")) if e.get("ht") else None, "hidden": e.get("hidden") in _YES})
                if "cell" in kinds:
                    for ref, *rest in _cells(e, texts):
                        yield ("cell", i, name, ref, *rest, None)
            elif what == "col":
                for n in range(int(e.get("min")), int(e.get("max")) + 1):
                    yield row("dim", None, {"axis": "col", "index": n, "size": float(e.get("width")) if e.get("width") else None, "hidden": e.get("hidden") in _YES})
            elif what == "mergeCell":
                yield row("merge", e.get("ref"))
            elif what == "hyperlink":
                target = links.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), None), e.get("location"))
                yield row("link", e.get("ref").split(":")[0], {"target": target})
            elif what == "conditionalFormatting":
                place = child(e, "sqref")
                rules = [r for r in e if local(r) == "cfRule"]
                if place is not None and "extension" in kinds:
                    yield from (row("extension", None, _extension(place.text, r)) for r in rules)
                if "rule" in kinds:
                    yield from (row("rule", None, _rule(e, blocks, n, r)) for n, r in enumerate(rules))
                blocks += 1
            elif what == "sparklineGroup":
                for line in below(e, "sparkline"):
                    values, place = child(line, "f"), child(line, "sqref")
                    body = {"line_group": groups, "kind": e.get("type") or "line", "gaps": e.get("displayEmptyCellsAs") or "gap", "values_ref": values.text if values is not None else None}
                    yield row("sparkline", place.text if place is not None else None, body)
                groups += 1
            elif what == "sheetViews":
                views = e
            else:
                filtered = e.get("ref")
        if "view" in kinds:
            yield row("view", None, _view(views, filtered))


def sheet_parts(spark: SparkSession, path: str | DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Tagged rows of the sheets of all workbooks, of the kinds that are asked for."""
    return read_packages(spark, path, "*.xlsx", lambda package: tagged(package, kinds), TAGGED)


def read_once(spark: SparkSession, path: str | DataFrame, folder: str) -> DataFrame:
    """Writes the tagged rows to ``folder``, a directory for each kind, and reads them back: files are opened once for all tables."""
    sheet_parts(spark, path).withColumn("kind", F.coalesce("kind", F.lit("error"))).write.partitionBy("kind").parquet(folder)
    return spark.read.schema(f"file_path string, error string, {TAGGED}").parquet(folder)


def of_kind(parts: DataFrame, kind: str) -> DataFrame:
    """The table of one kind, with the errors of broken files."""
    held = parts.where((F.col("kind") == kind) | F.col("error").isNotNull())
    body = BODIES[kind]
    own = [] if kind in ("dim", "rule", "extension", "view") else ["ref"]
    if not body:
        return held.select("file_path", "error", "sheet_idx", *own)
    fields = F.from_json("body", body)
    names = [c.strip().split(" ")[0] for c in body.split(", ")]
    return held.select("file_path", "error", "sheet_idx", *own, *[fields[n].alias(n) for n in names])
