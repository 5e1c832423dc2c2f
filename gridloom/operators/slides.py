"""Slides: inherited properties of placeholders, and shapes in groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.placeholders import TEXT_STYLES

PROPERTIES = ("size", "bold", "italic", "color", "align", "anchor", "space_before", "space_after", "line_spacing")


def inherited_text(slides: DataFrame, properties: DataFrame) -> DataFrame:
    """What each placeholder of a slide has, a column for each of ``PROPERTIES`` (texts, null where nothing sets it).

    Layers from the nearest on: the placeholder itself, the layout's of its index,
    the layout's of its type, for a body the layout's without a type, the master's of
    its type, for a body the master's without one, the master's text style. Each
    layer is a key that the placeholder looks up; one join finds them all, and one
    aggregation takes the nearest layer for every property. A placeholder without
    an index looks up none.
    """
    found = properties.where("error is null")
    asked = slides.where("error is null").join(found.where("shape is not null").select("file_path", "part", "shape", "type", "idx").distinct(), ["file_path", "part"])
    body = F.col("type").isin("", "body")
    style = F.lit("otherStyle")
    for name, kinds in TEXT_STYLES.items():
        if kinds:
            style = F.when(F.col("type").isin(*kinds), name).otherwise(style)
    kind = F.when(body, "body").otherwise(F.col("type"))
    text = lambda c: c.cast("string")
    keys = [
        (F.col("part"), "shape", text(F.col("shape"))), (F.col("layout"), "idx", text(F.col("idx"))), (F.col("layout"), "type", kind), (F.col("layout"), "type", F.when(body, "")),
        (F.col("master"), "type", kind), (F.col("master"), "type", F.when(body, "")), (F.col("master"), "style", style),
    ]
    looked = asked.select("file_path", "slide", "shape", "type", "idx", F.inline(F.array(*[F.struct(F.lit(rank).alias("rank"), p.alias("part"), F.lit(by).alias("by"), k.alias("key")) for rank, (p, by, k) in enumerate(keys)])))
    place = F.array(*[F.struct(F.lit(by).alias("by"), c.alias("key")) for by, c in (("shape", text(F.col("shape"))), ("idx", F.when(F.col("shape").isNotNull(), text(F.col("idx")))), ("type", F.when(F.col("shape").isNotNull(), F.col("type"))), ("style", F.when(F.col("shape").isNull(), F.col("type"))))])
    held = found.where("property is not null").select("file_path", "part", F.col("shape").alias("at"), "property", "value", F.inline(place)).where("key is not null")
    joined = looked.join(held, ["file_path", "part", "by", "key"], "left")
    nearest = F.struct("rank", F.coalesce("at", F.lit(0)))
    take = [F.min_by(F.when(F.col("property") == p, F.col("value")), F.when(F.col("property") == p, nearest)).alias(p) for p in PROPERTIES]
    return joined.groupBy("file_path", "slide", "shape", "type", "idx").agg(*take)


def effective_runs(runs: DataFrame, inherited: DataFrame) -> DataFrame:
    """Runs with their own size, bold, italic, colour and alignment, else what their placeholder inherits."""
    down = inherited.select("file_path", "slide", "shape", F.col("size").cast("double").alias("__size"), F.col("bold").cast("boolean").alias("__bold"), F.col("italic").cast("boolean").alias("__italic"), F.col("color").alias("__color"), F.col("align").alias("__align"))
    joined = runs.join(down, ["file_path", "slide", "shape"], "left")
    return joined.withColumns({n: F.coalesce(n, f"__{n}") for n in ("size", "bold", "italic", "color", "align")}).drop("__size", "__bold", "__italic", "__color", "__align")


#: Place of a shape or group; a group's own space is ``ch_x, ch_y, ch_w, ch_h``.
BOX = ("x", "y", "w", "h", "rot", "flip_h", "flip_v")


def _up(s: Column, g: Column) -> Column:
    """A box, by its centre, moved from a group's own space to the space around the group: mirrored, scaled, moved and turned about the group's centre."""
    sx, sy = (F.when(g[f"ch_{n}"] != 0, g[n] / g[f"ch_{n}"]).otherwise(1.0) for n in ("w", "h"))
    cx, cy = F.when(g["flip_h"], 2 * g["ch_x"] + g["ch_w"] - s["cx"]).otherwise(s["cx"]), F.when(g["flip_v"], 2 * g["ch_y"] + g["ch_h"] - s["cy"]).otherwise(s["cy"])
    mx, my = g["x"] + g["w"] / 2, g["y"] + g["h"] / 2
    dx, dy = (cx - g["ch_x"]) * sx + g["x"] - mx, (cy - g["ch_y"]) * sy + g["y"] - my
    cos, sin = F.cos(F.radians(g["rot"])), F.sin(F.radians(g["rot"]))
    turned = F.when(g["flip_h"] != g["flip_v"], -s["rot"]).otherwise(s["rot"])
    return F.struct(
        g["parent"].alias("group"), (mx + dx * cos - dy * sin).alias("cx"), (my + dx * sin + dy * cos).alias("cy"), (s["w"] * sx).alias("w"), (s["h"] * sy).alias("h"),
        (g["rot"] + turned).alias("rot"), (s["flip_h"] != g["flip_h"]).alias("flip_h"), (s["flip_v"] != g["flip_v"]).alias("flip_v"),
    )


def absolute_boxes(shapes: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Shapes with ``BOX`` in the space of their slide, whatever groups they are in.

    ``shapes``: ``group`` (null outside) and ``BOX``; ``groups``: ``group, parent, ch_x, ch_y, ch_w, ch_h`` and ``BOX``. A part's
    groups are gathered into one map, a row a part, and each shape's maps are
    composed by one fold along it: one join, whatever the depth. Groups that hold
    each other are an error. Lengths are rounded once, at the end.
    """
    double = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    of = F.struct(F.col("parent").cast("long").alias("parent"), *[flag(c) if c.startswith("flip") else double(c) for c in (*BOX, "ch_x", "ch_y", "ch_w", "ch_h")])
    maps = groups.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("group").cast("long").alias("group"), of.alias("of")))).alias("__groups"))
    half = lambda at, size: (F.coalesce(F.col(at), F.lit(0)) + F.coalesce(F.col(size), F.lit(0)) / 2).cast("double")
    start = F.struct(F.col("group").cast("long").alias("group"), half("x", "w").alias("cx"), half("y", "h").alias("cy"), double("w"), double("h"), double("rot"), flag("flip_h"), flag("flip_v"))

    def step(s: Column, _: Column) -> Column:
        return F.when(F.try_element_at("__groups", s["group"]).isNull(), s).otherwise(_up(s, F.try_element_at("__groups", s["group"])))

    levels = F.when(F.col("group").isNull() | F.col("__groups").isNull(), F.array()).otherwise(F.sequence(F.lit(1), F.size("__groups")))
    moved = shapes.join(maps, by, "left").withColumn("__at", F.aggregate(levels.cast("array<int>"), start, step))
    ring = F.try_element_at("__groups", F.col("__at.group")).isNotNull()
    at = lambda c: F.when(ring, F.raise_error(F.lit("groups hold each other")).cast("double")).otherwise(F.col(f"__at.{c}"))
    out = {"x": F.round(at("cx") - F.col("__at.w") / 2).cast("long"), "y": F.round(at("cy") - F.col("__at.h") / 2).cast("long"), "w": F.round("__at.w").cast("long"), "h": F.round("__at.h").cast("long")}
    out |= {c: F.col(f"__at.{c}") for c in ("rot", "flip_h", "flip_v")}
    return moved.select(*[out.get(c, F.col(c)).alias(c) for c in shapes.columns])
