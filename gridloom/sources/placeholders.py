"""What placeholders of layouts and masters hand down to the text of slides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .packages import Package, attribute, below, child, local, read_packages

#: Text styles of a master, and the placeholder types that each is for; the rest takes the last.
TEXT_STYLES = {"titleStyle": ("title", "ctrTitle"), "bodyStyle": ("body", "subTitle", "obj", ""), "otherStyle": ()}
#: Where a property may be set for the first level of a text.
_SPACES = {"spcBef": "space_before", "spcAft": "space_after", "lnSpc": "line_spacing"}
_YES = ("1", "true")


def family(kind: str) -> str:
    return next((n for n, kinds in TEXT_STYLES.items() if kind in kinds), "otherStyle")


def _level(level) -> dict[str, str]:
    """Properties of a first level: alignment, spaces, and its runs' size, toggles and colour."""
    out = {}
    if level is None:
        return out
    if attribute(level, "algn"):
        out["align"] = attribute(level, "algn")
    for tag, name in _SPACES.items():
        value = next((attribute(v, "val") for v in child(level, tag) or ()), None) if child(level, tag) is not None else None
        if value is not None:
            out[name] = value
    run = child(level, "defRPr")
    if run is not None:
        if attribute(run, "sz"):
            out["size"] = repr(int(attribute(run, "sz")) / 100)
        out |= {n: str(attribute(run, a) in _YES).lower() for n, a in (("bold", "b"), ("italic", "i")) if attribute(run, a) is not None}
        fill = child(run, "solidFill")
        color = next((e for e in fill if local(e) in ("srgbClr", "schemeClr")), None) if fill is not None else None
        if color is not None:
            out["color"] = attribute(color, "val")
    return out


def _props(package: Package):
    for part in sorted(n for n in package.names if n.startswith("ppt/slide") and n.endswith(".xml")):
        root = package.xml(part)
        for k, shape in enumerate(e for e in root.iter() if local(e) in ("sp", "graphicFrame")):
            place, body = next(below(shape, "ph"), None), child(shape, "txBody")
            if place is None:
                continue
            found = {}
            if body is not None:
                styles, box = child(body, "lstStyle"), child(body, "bodyPr")
                found = _level(child(styles, "lvl1pPr")) if styles is not None else {}
                if box is not None and attribute(box, "anchor"):
                    found["anchor"] = attribute(box, "anchor")
            idx = attribute(place, "idx")
            yield from ((part, k, attribute(place, "type") or "", int(idx) if idx else None, n, v) for n, v in (found or {None: None}).items())
        for style in (e for t in below(root, "txStyles") for e in t):
            yield from ((part, None, local(style), None, n, v) for n, v in _level(child(style, "lvl1pPr")).items())


def text_properties(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """A row a property of each placeholder of slides, layouts and masters (a row with nulls for one without any), and of the masters' text styles, which have no ``shape``."""
    return read_packages(spark, path, "*.pptx", _props, "part string, shape int, type string, idx int, property string, value string")
