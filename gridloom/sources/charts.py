"""Cached points of charts in spreadsheets and presentations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import formatted
from .packages import Package, attribute, below, child, local, read_packages


def _cache(series, name: str) -> dict[int, str]:
    holder = child(series, name)
    return {int(p.get("idx")): child(p, "v").text for p in below(holder, "pt") if child(p, "v") is not None} if holder is not None else {}


def _count(series, *names: str) -> int:
    counts = [int(attribute(c, "val") or 0) for n in names if child(series, n) is not None for c in below(child(series, n), "ptCount")]
    return max(counts, default=0)


def _points(package: Package):
    for part in sorted(n for n in package.names if "/charts/chart" in n and n.endswith(".xml")):
        root = package.xml(part)
        yield from _extended(part, root)
        for plot in (e for area in below(root, "plotArea") for e in area if local(e).endswith("Chart")):
            grouping, direction = child(plot, "grouping"), child(plot, "barDir")
            for k, series in enumerate(e for e in plot if local(e) == "ser"):
                order = child(series, "order")
                names = _cache(series, "tx")
                labels = _cache(series, "cat") or _cache(series, "xVal")
                values = _cache(series, "val") or _cache(series, "yVal")
                for i in range(max(_count(series, "cat", "val", "xVal", "yVal"), max(values, default=-1) + 1)):
                    try:
                        value = float(values[i])
                    except (KeyError, TypeError, ValueError):
                        value = None
                    yield (
                        part, local(plot), attribute(direction, "val") if direction is not None else None, attribute(grouping, "val") if grouping is not None else None,
                        k, int(attribute(order, "val")) if order is not None else k, names.get(0), i, labels.get(i), value,
                    )


def _extended(part: str, root):
    """Points of the extended kinds, whose data stand apart from their series."""
    data = {d.get("id"): d for d in below(root, "data")}
    for k, series in enumerate(below(root, "series")):
        if not series.get("layoutId"):
            continue
        ref = child(series, "dataId")
        held = data.get(attribute(ref, "val")) if ref is not None else None
        dims = {d.get("type"): {int(p.get("idx")): p.text for p in below(d, "pt")} for d in held if local(d) in ("strDim", "numDim")} if held is not None else {}
        name = next((t.text for t in below(series, "v")), None)
        values = dims.get("val") or dims.get("size") or {}
        for i in range(max([*values, *dims.get("cat", {})], default=-1) + 1):
            try:
                value = float(values[i])
            except (KeyError, TypeError, ValueError):
                value = None
            yield part, series.get("layoutId"), None, None, k, k, name, i, dims.get("cat", {}).get(i), value


#: Stands for a field of the cells' range in an override's text, until the point's cached text takes its place.
CELL_RANGE = "\ue000"


def _rich(holder) -> str:
    """Text of an override: runs and fields, paragraphs by line feeds."""
    piece = lambda e: CELL_RANGE if local(e) == "fld" and e.get("type") == "CELLRANGE" else "".join(t.text or "" for t in e if local(t) == "t")
    return "\n".join("".join(piece(e) for e in p if local(e) in ("r", "fld")) for p in below(holder, "p"))


def _labels(package: Package):
    for part in sorted(n for n in package.names if "/charts/chart" in n and n.endswith(".xml")):
        for plot in (e for area in below(package.xml(part), "plotArea") for e in area if local(e).endswith("Chart")):
            for k, series in enumerate(e for e in plot if local(e) == "ser"):
                for cache in below(series, "dlblRangeCache"):
                    for p in below(cache, "pt"):
                        value = child(p, "v")
                        yield part, local(plot), k, "cache", int(p.get("idx")), (value.text or "") if value is not None else "", None, None, None, None, None
                labels = child(series, "dLbls")
                if labels is None:
                    continue
                said = lambda e, n: attribute(child(e, n), "val") if child(e, n) is not None else None
                form = child(labels, "numFmt")
                yield part, local(plot), k, "default", None, None, *(said(labels, n) in ("1", "true") for n in ("showVal", "showCatName", "showSerName")), form.get("formatCode") if form is not None else None, said(labels, "dLblPos")
                for own in (e for e in labels if local(e) == "dLbl"):
                    rich = next(below(own, "rich"), None)
                    gone = said(own, "delete") in ("1", "true")
                    if gone or rich is not None:
                        yield part, local(plot), k, "override", int(said(own, "idx")), "" if gone else _rich(rich), None, None, None, None, said(own, "dLblPos")


def labels(spark: SparkSession, path: str | DataFrame, glob: str = "*.{xlsx,pptx}") -> DataFrame:
    """What a series says of its labels (``what`` default), the texts of single points (override, empty if deleted), and those of cells (cache)."""
    return read_packages(spark, path, glob, _labels, "part string, kind string, series int, what string, idx int, text string, show_value boolean, show_category boolean, show_name boolean, format_code string, position string")


def data_labels(points_: DataFrame, labels_: DataFrame) -> DataFrame:
    """Points with a ``label`` and its ``position``: the override's text (with the point's cell text in it), else category, series name and value as the series shows them.

    A point without a value, a deleted or an empty label is left out. Codes of
    numbers are compiled once each.
    """
    series = ["file_path", "part", "kind", "series"]
    found = labels_.where("error is null")
    default = found.where("what = 'default'").select(*series, "show_value", "show_category", "show_name", "format_code", F.col("position").alias("__position"))
    own = found.where("what = 'override'").select(*series, "idx", F.col("text").alias("__own"), F.col("position").alias("__own_position"))
    cache = found.where("what = 'cache'").select(*series, "idx", F.col("text").alias("__cell"))
    joined = points_.where("error is null and value is not null").join(default, series, "left").join(own, [*series, "idx"], "left").join(cache, [*series, "idx"], "left")
    valued = formatted(joined.withColumn("__none", F.lit(None).cast("string")), "format_code", "value", "__none")
    shown = lambda flag, text: F.when(F.col(flag), F.nullif(text, F.lit("")))
    composed = F.concat_ws(" ", shown("show_category", F.col("category")), shown("show_name", F.col("series_name")), shown("show_value", F.col("shown")))
    label = F.when(F.col("__own").isNotNull(), F.replace("__own", F.lit(CELL_RANGE), F.coalesce("__cell", F.lit("")))).otherwise(composed)
    out = valued.withColumn("label", label).withColumn("position", F.coalesce("__own_position", "__position", F.lit("r"))).where("label <> ''")
    return out.select(*points_.columns, "label", "position")


def in_order(points_: DataFrame) -> DataFrame:
    """``place`` (from 1) of each series among its chart's, by the order that it gives, then as it stands: that of legends and stacks."""
    listed = points_.where("error is null").groupBy("file_path", "part", "kind", "series").agg(F.first("display_order").alias("__order"))
    placed = listed.withColumn("place", F.row_number().over(Window.partitionBy("file_path", "part").orderBy("__order", "kind", "series"))).drop("__order")
    return points_.where("error is null").join(placed, ["file_path", "part", "kind", "series"])


def _axes(package: Package):
    for part in sorted(n for n in package.names if "/charts/chart" in n and n.endswith(".xml")):
        root = package.xml(part)
        chart = next(below(root, "chart"), root)
        yield part, "chart", None, _title(chart), None, None, None, None, False
        for axis in (e for area in below(root, "plotArea") for e in area if local(e) in ("catAx", "valAx", "dateAx", "serAx")):
            scaling, form = child(axis, "scaling"), child(axis, "numFmt")
            number = lambda holder, n: float(attribute(child(holder, n), "val")) if holder is not None and child(holder, n) is not None else None
            gone = child(axis, "delete")
            yield part, local(axis), attribute(child(axis, "axId"), "val") if child(axis, "axId") is not None else None, _title(axis), attribute(form, "formatCode") if form is not None else None, number(scaling, "min"), number(scaling, "max"), number(axis, "majorUnit"), gone is not None and (attribute(gone, "val") or "1") in ("1", "true")


def _title(holder) -> str | None:
    title = child(holder, "title")
    return "".join(t.text or "" for e in ("t", "v") for t in below(title, e)) or None if title is not None else None


def axes(spark: SparkSession, path: str | DataFrame, glob: str = "*.{xlsx,pptx}") -> DataFrame:
    """Titles, number formats, bounds and steps of each chart (``kind`` chart) and its axes."""
    return read_packages(spark, path, glob, _axes, "part string, kind string, id string, title string, format_code string, low double, high double, step double, deleted boolean")


def points(spark: SparkSession, path: str | DataFrame, glob: str = "*.{xlsx,pptx}") -> DataFrame:
    """A row for each series and point index, padded to the series' point count; missing values are null."""
    return read_packages(spark, path, glob, _points, "part string, kind string, direction string, grouping string, series int, display_order int, series_name string, idx int, category string, value double")


def with_categories(points_: DataFrame) -> DataFrame:
    """``category``: the series' own, else that of the chart's first series, else 1, 2, ..."""
    first = points_.where("series = 0").groupBy("file_path", "part", "idx").agg(F.max("category").alias("__first"))
    return points_.join(first, ["file_path", "part", "idx"], "left").withColumn("category", F.coalesce("category", "__first", (F.col("idx") + 1).cast("string"))).drop("__first")
