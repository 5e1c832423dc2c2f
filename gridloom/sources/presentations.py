"""Presentations: text of shapes and tables, slide by slide in presentation order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.slides import BOX, absolute_boxes
from .packages import FRAME, Package, PackageError, attribute, below, child, frame, local, read_packages, shape_tree

DECK = "ppt/presentation.xml"


def slide_parts(package: Package) -> Iterator[tuple[int, str | None]]:
    """Slides in presentation order, and their parts."""
    root = package.xml(DECK)
    if root is None:
        raise PackageError("no presentation")
    relations = package.relations(DECK)
    for n, s in enumerate(below(root, "sldId")):
        yield n, relations.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None))


def _texts(package: Package, only: int | None = None):
    for n, part in slide_parts(package):
        slide = package.xml(part) if part and only in (None, n) else None
        if slide is None:
            continue
        shapes = (e for e in slide.iter() if local(e) in ("sp", "graphicFrame"))
        for k, shape in enumerate(shapes):
            place = next(below(shape, "ph"), None)
            kind = (attribute(place, "type") or "body") if place is not None else None
            name = next((attribute(e, "name") for e in below(shape, "cNvPr")), None)
            rows = list(below(shape, "tr"))
            if rows:
                for r, row in enumerate(rows):
                    for c, cell in enumerate(e for e in row if local(e) == "tc"):
                        yield from _paragraphs(cell, n, k, name, kind, r, c)
            else:
                yield from _paragraphs(shape, n, k, name, kind, None, None)


def _paragraphs(element, slide, shape, name, kind, row, col):
    for i, p in enumerate(below(element, "p")):
        props = child(p, "pPr")
        auto = child(props, "buAutoNum") is not None if props is not None else False
        text = "".join((child(r, "t").text or "") if child(r, "t") is not None else "\n" if local(r) == "br" else "" for r in p if local(r) in ("r", "fld", "br"))
        yield slide, shape, name, kind, row, col, i, int(attribute(props, "lvl") or 0) if props is not None else 0, auto, text


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``slide, shape, name, placeholder, trow, tcol, ord, level, auto_number, text``."""
    return read_packages(spark, path, "*.pptx", _texts, "slide int, shape int, name string, placeholder string, trow int, tcol int, ord int, level int, auto_number boolean, text string")


def _runs(package: Package):
    for n, part in slide_parts(package):
        slide = package.xml(part) if part else None
        for k, shape in enumerate(e for e in slide.iter() if local(e) in ("sp", "graphicFrame")) if slide is not None else ():
            for i, p in enumerate(below(shape, "p")):
                props = child(p, "pPr")
                bullet = next((e for e in props if local(e) in ("buNone", "buChar", "buAutoNum", "buBlip")), None) if props is not None else None
                mark = None if bullet is None else attribute(bullet, "char") or attribute(bullet, "type")
                for j, r in enumerate(e for e in p if local(e) in ("r", "fld", "br")):
                    own = child(r, "rPr")
                    size, color = (attribute(own, "sz"), next(below(own, "srgbClr"), None)) if own is not None else (None, None)
                    toggle = lambda a: None if own is None or attribute(own, a) is None else attribute(own, a) in ("1", "true")  # noqa: B023, E731
                    yield n, k, i, j, local(r), attribute(r, "type"), (child(r, "t").text or "") if child(r, "t") is not None else "\n", local(bullet) if bullet is not None else None, mark, toggle("b"), toggle("i"), int(size) / 100 if size else None, attribute(color, "val") if color is not None else None, attribute(props, "algn") if props is not None else None


def runs(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """A row a run of a slide's shapes with its paragraph's bullet; ``field`` is a field's type, such as ``slidenum``."""
    return read_packages(spark, path, "*.pptx", _runs, "slide int, shape int, paragraph int, run int, kind string, field string, text string, bullet string, mark string, bold boolean, italic boolean, size double, color string, align string")


def field_text(runs_: DataFrame) -> DataFrame:
    """``text`` of slide-number fields is the slide's 1-based number."""
    return runs_.withColumn("text", F.when(F.col("field") == "slidenum", (F.col("slide") + 1).cast("string")).otherwise(F.col("text")))


def titles(texts: DataFrame) -> DataFrame:
    """First title with a text on each slide; null without one."""
    title = F.col("placeholder").isin("title", "ctrTitle", "centeredTitle") & (F.trim("text") != "")
    return texts.groupBy("file_path", "slide").agg(F.min_by(F.when(title, F.trim("text")), F.when(title, F.struct("shape", "ord"))).alias("title"))


def _slides(package: Package):
    for n, part in slide_parts(package):
        layout = next((t for t in package.relations(part).values() if "/slideLayouts/" in t), None) if part else None
        master = next((t for t in package.relations(layout).values() if "/slideMasters/" in t), None) if layout else None
        yield n, part, layout, master


def slides(spark: SparkSession, path: str) -> DataFrame:
    """Slides in order with their layout and master."""
    return read_packages(spark, path, "*.pptx", _slides, "slide int, part string, layout string, master string")


def _elements(package: Package):
    for part in sorted(n for n in package.names if n.startswith("ppt/slide") and n.endswith(".xml")):
        root, targets = package.xml(part), package.relations(part)
        for tree in below(root, "spTree"):
            for at, group, e in shape_tree(tree):
                own = next((c for c in e if local(c) in ("nvSpPr", "nvPicPr", "nvCxnSpPr", "nvGraphicFramePr", "nvGrpSpPr")), None)
                name = next((attribute(c, "name") for c in below(own, "cNvPr")), None) if own is not None else None
                place = next(below(own, "ph"), None) if own is not None else None
                rid = next((v for b in below(e, "blip") for a, v in b.attrib.items() if a.endswith("}embed")), None) if local(e) == "pic" else None
                kind = (attribute(place, "type") or "body") if place is not None else None
                yield part, at, group, local(e), name, kind, int(attribute(place, "idx")) if place is not None and attribute(place, "idx") else None, *frame(e), targets.get(rid)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Shapes, pictures, connectors, frames and groups of slides, layouts and masters; lengths in English metric units."""
    return read_packages(
        spark, path, "*.pptx", _elements,
        f"part string, shape int, group int, kind string, name string, placeholder string, idx int, {FRAME}, target string",
    )


def _styles(package: Package):
    for part in sorted(n for n in package.names if n.startswith("ppt/slide") and n.endswith(".xml")):
        for tree in below(package.xml(part), "spTree"):
            for at, _, e in shape_tree(tree):
                props = child(e, "spPr")
                if props is None:
                    continue
                geometry, line = child(props, "prstGeom"), child(props, "ln")
                yield part, at, attribute(geometry, "prst") if geometry is not None else "custom" if child(props, "custGeom") is not None else None, *_paint(props), *_paint(line), int(attribute(line, "w")) / 12700 if line is not None and attribute(line, "w") else None, next(below(props, "outerShdw"), None) is not None


def _paint(holder) -> tuple[str | None, str | None]:
    """Kind of a fill and its first colour."""
    fill = next((e for e in holder if local(e) in ("noFill", "solidFill", "gradFill", "blipFill", "pattFill")), None) if holder is not None else None
    color = next((e for e in fill.iter() if local(e) in ("srgbClr", "schemeClr")), None) if fill is not None else None
    return local(fill).removesuffix("Fill") if fill is not None else None, attribute(color, "val") if color is not None else None


def shape_styles(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Geometry, fill, line (width in points) and shadow of shapes."""
    return read_packages(spark, path, "*.pptx", _styles, "part string, shape int, geometry string, fill string, fill_color string, line string, line_color string, line_width double, shadow boolean")


def _paths(package: Package):
    for part in sorted(n for n in package.names if n.startswith("ppt/slide") and n.endswith(".xml")):
        for tree in below(package.xml(part), "spTree"):
            for at, _, e in shape_tree(tree):
                props = child(e, "spPr")
                custom = child(props, "custGeom") if props is not None else None
                if custom is None:
                    continue
                for name in ("avLst", "gdLst"):
                    held = child(custom, name)
                    yield from ((part, at, "guide", None, k, attribute(g, "name"), (attribute(g, "fmla") or "").split(), None, None) for k, g in enumerate(held if held is not None else ()))
                paths = child(custom, "pathLst")
                for p, path in enumerate(paths if paths is not None else ()):
                    size = [int(attribute(path, a)) if attribute(path, a) else None for a in "wh"]
                    for k, c in enumerate(path):
                        args = [attribute(c, a) or "0" for a in ("wR", "hR", "stAng", "swAng")] if local(c) == "arcTo" else [attribute(q, a) for q in c for a in ("x", "y")]
                        yield part, at, "command", p, k, local(c), args, *size


def shape_paths(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Custom geometry: guides (``name`` and the words of their formula) and path commands (``name`` and the numbers or guides that they name), in order."""
    return read_packages(spark, path, "*.pptx", _paths, "part string, shape int, kind string, path int, ord int, name string, args array<string>, path_w long, path_h long")


def drawn(slides_: DataFrame, elements_: DataFrame) -> DataFrame:
    """Shapes of each slide in the order that they are drawn: the layout's without placeholders first, then the slide's."""
    found = elements_.where("error is null").drop("error")
    own = slides_.where("error is null").select("file_path", "slide", "part").withColumn("source", F.lit(1)).join(found, ["file_path", "part"])
    layout = slides_.where("error is null and layout is not null").select("file_path", "slide", F.col("layout").alias("part")).withColumn("source", F.lit(0)).join(found.where("placeholder is null"), ["file_path", "part"])
    z = F.row_number().over(Window.partitionBy("file_path", "slide").orderBy("source", "shape")) - 1
    return layout.unionByName(own).withColumn("z", z)


def _backgrounds(package: Package):
    for part in sorted(n for n in package.names if n.startswith("ppt/slide") and n.endswith(".xml")):
        held = next(below(package.xml(part), "bg"), None)
        props = next((e for e in held if local(e) in ("bgPr", "bgRef")), None) if held is not None else None
        if props is not None:
            yield part, *(_paint(props) if local(props) == "bgPr" else ("reference", next((attribute(c, "val") for c in props), None)))


def backgrounds(spark: SparkSession, path: str) -> DataFrame:
    """Fills of the slides, layouts and masters that have a background."""
    return read_packages(spark, path, "*.pptx", _backgrounds, "part string, fill string, color string")


def slide_backgrounds(slides_: DataFrame, backgrounds_: DataFrame) -> DataFrame:
    """``fill, color, source`` of each slide: its own background, else the layout's, else the master's."""
    out = slides_.where("error is null")
    held = backgrounds_.where("error is null")
    for source, part in (("slide", "part"), ("layout", "layout"), ("master", "master")):
        found = held.select("file_path", F.col("part").alias(part), F.struct("fill", "color", F.lit(source).alias("source")).alias(f"__{source}"))
        out = out.join(found, ["file_path", part], "left")
    first = F.coalesce("__slide", "__layout", "__master")
    return out.select("file_path", "slide", first["fill"].alias("fill"), first["color"].alias("color"), first["source"].alias("source"))


def _diagrams(package: Package):
    for part in sorted(n for n in package.names if n.startswith("ppt/diagrams/drawing") and n.endswith(".xml")):
        digits = "".join(c for c in part.rpartition("/")[2] if c.isdigit())
        for k, shape in enumerate(below(package.xml(part), "sp")):
            yield int(digits or 0), k, "\n".join("".join(t.text or "" for t in below(p, "t")) for p in below(shape, "p"))


def diagram_shapes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Texts of the drawn form of diagrams; ``number`` pairs it with the data part of that number."""
    return read_packages(spark, path, "*.pptx", _diagrams, "number int, shape int, text string")


def inherited_positions(slides_: DataFrame, elements_: DataFrame) -> DataFrame:
    """Positions of the slides' placeholders: their own, else the layout's by index, else by type, else the master's by type. One without an index looks up none."""
    box = ("x", "y", "w", "h")
    places = elements_.where("error is null and placeholder is not null")
    own = slides_.where("error is null").join(places, ["file_path", "part"])

    def layer(tag: str, by: str):
        held = places.where(F.col("x").isNotNull() & F.col(by).isNotNull()).groupBy("file_path", "part", by).agg(F.min_by(F.struct(*box), "shape").alias(tag))
        return held.withColumnRenamed("part", "layout" if tag != "__master" else "master")

    found = own.join(layer("__idx", "idx"), ["file_path", "layout", "idx"], "left").join(layer("__type", "placeholder"), ["file_path", "layout", "placeholder"], "left").join(layer("__master", "placeholder"), ["file_path", "master", "placeholder"], "left")
    first = F.coalesce(F.when(F.col("x").isNotNull(), F.struct(*box)), "__idx", "__type", "__master")
    return found.select("file_path", "slide", "shape", "placeholder", "idx", *[first[b].alias(b) for b in box])


def absolute_elements(elements_: DataFrame) -> DataFrame:
    """Elements with their place on the slide, moved out of the groups that hold them."""
    found = elements_.where("error is null")
    groups = found.where("kind = 'grpSp'").select("file_path", "part", F.col("shape").alias("group"), F.col("group").alias("parent"), *BOX, "ch_x", "ch_y", "ch_w", "ch_h")
    return absolute_boxes(found, groups, ["file_path", "part"])
