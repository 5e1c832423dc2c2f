"""Points of custom shapes: guides evaluated shape by shape as data, path commands as ordered rows with a running pen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guides


def guide_values(shapes: DataFrame, formulas: DataFrame, by: list[str]) -> DataFrame:
    """``values``: all guides of a shape by name, with the names that every shape has.

    ``shapes``: ``w, h``; ``formulas``: ``ord, name, args`` (operator and arguments). A shape's formulas are one ordered array,
    folded along a map of the values so far; an unknown name or operator gives null.
    """
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    known = F.map_from_arrays(F.array(*map(F.lit, guides.built_in(w, h))), F.array(*[c.cast("double") for c in guides.built_in(w, h).values()]))
    listed = formulas.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "name", "args"))).alias("__formulas"))

    def step(values: Column, g: Column) -> Column:
        arg = lambda i: resolved(values, F.get(g["args"], F.lit(i)))
        out = F.lit(None).cast("double")
        for operator, how in guides._OPERATORS.items():
            out = F.when(F.get(g["args"], F.lit(0)) == operator, how(*[arg(i + 1) for i in range(guides.ARGUMENTS.get(operator, 3))])).otherwise(out)
        return F.map_concat(F.map_filter(values, lambda k, _: k != g["name"]), F.create_map(g["name"], out))

    joined = shapes.withColumn("__known", known).join(listed, by, "left")
    folded = F.aggregate(F.coalesce("__formulas", F.array().cast(dict(listed.dtypes)["__formulas"])), F.col("__known"), step)
    return joined.withColumn("values", folded).drop("__known", "__formulas")


def resolved(values: Column, word: Column) -> Column:
    """A number, or the value of a guide's name."""
    return F.coalesce(F.try_element_at(values, word), word.try_cast("double"))


def path_points(shapes: DataFrame, paths: DataFrame, by: list[str]) -> DataFrame:
    """Where the pen is after each command: ``x, y`` in shares of the path's size (``path_w, path_h``, else the shape's).

    Arcs go on from the pen, so they are shifts: a pen is the last point that a
    command names plus the shifts since. ``close`` goes back to where its outline began.
    """
    valued = guide_values(shapes, paths.where("kind = 'guide'"), by).select(*by, "values", F.col("w").alias("__w"), F.col("h").alias("__h"))
    commands = paths.where("kind = 'command'").join(valued, by)
    number = lambda i: resolved(F.col("values"), F.get("args", i))
    last = lambda n: number(F.size("args") - n)
    arc, close = F.col("name") == "arcTo", F.col("name") == "close"
    start, sweep = (number(F.lit(i)) * guides.UNIT for i in (2, 3))
    turn = {"x": number(F.lit(0)) * (F.cos(start + sweep) - F.cos(start)), "y": number(F.lit(1)) * (F.sin(start + sweep) - F.sin(start))}
    named = commands.withColumns({f"__{a}": F.when(~arc & ~close, last(2 if a == "x" else 1)) for a in "xy"} | {f"__d{a}": F.when(arc, turn[a]).otherwise(0.0) for a in "xy"})
    along = Window.partitionBy(*by, "path").orderBy("ord")
    outline = named.withColumn("__outline", F.count_if(F.col("name") == "moveTo").over(along))
    begun = Window.partitionBy(*by, "path", "__outline").orderBy("ord")
    outline = outline.withColumns({f"__{a}": F.when(close, F.first(f"__{a}").over(begun)).otherwise(F.col(f"__{a}")) for a in "xy"}).withColumn("__leg", F.count("__x").over(along))
    leg = Window.partitionBy(*by, "path", "__leg").orderBy("ord")
    size = {"x": F.coalesce("path_w", "__w"), "y": F.coalesce("path_h", "__h")}
    pen = {a: (F.coalesce(F.first(f"__{a}").over(leg), F.lit(0.0)) + F.sum(f"__d{a}").over(leg)) / F.greatest(size[a], F.lit(1)) for a in "xy"}
    return outline.select(*by, "path", "ord", "name", pen["x"].alias("x"), pen["y"].alias("y"))
