"""Chart arithmetic: stacks, shares, waterfalls, axes, error bars, sparklines.

Inputs are aggregated points, a row a category and series; windows run within a
category, a chart or a sparkline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stacked(points: DataFrame, category: list[str], series: list[Column], value: Column, signed: bool = False) -> DataFrame:
    """``base`` and ``stop`` of each series in its category's stack; sizes are absolute unless ``signed``."""
    size = F.coalesce(value if signed else F.abs(value), F.lit(0.0))
    upto = Window.partitionBy(*category).orderBy(*series).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(size).over(upto)
    return points.withColumn("base", stop - size).withColumn("stop", stop)


def percent_stacked(points: DataFrame, category: list[str], value: Column) -> DataFrame:
    total = F.sum(F.abs(F.coalesce(value, F.lit(0.0)))).over(Window.partitionBy(*category))
    return points.withColumn("percent", F.coalesce(F.try_divide(F.abs(value), total) * 100, F.lit(0.0)))


def waterfall(points: DataFrame, chart: list[str], order: str, value: Column, subtotal: Column) -> DataFrame:
    """``bar_start`` and ``bar_end``: steps run on from the last subtotal, subtotals start at 0. The first bar is one."""
    w = Window.partitionBy(*chart).orderBy(order)
    first = F.row_number().over(w) == 1
    marked = points.withColumn("__sub", F.when(subtotal | first, 1).otherwise(0))
    marked = marked.withColumn("__group", F.sum("__sub").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    running = F.sum(value).over(Window.partitionBy(*chart, "__group").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__end", running)
    start = F.when(F.col("__sub") == 1, F.least(F.lit(0.0), value)).otherwise(F.least(F.col("__end"), F.col("__end") - value))
    stop = F.when(F.col("__sub") == 1, F.greatest(F.lit(0.0), value)).otherwise(F.greatest(F.col("__end"), F.col("__end") - value))
    return marked.withColumn("bar_start", start).withColumn("bar_end", stop).withColumn("is_subtotal", F.col("__sub") == 1).drop("__sub", "__group", "__end")


def share(points: DataFrame, chart: list[str], value: Column) -> DataFrame:
    return points.withColumn("share", F.coalesce(F.try_divide(F.abs(value), F.sum(F.abs(value)).over(Window.partitionBy(*chart))), F.lit(0.0)))


def pie_angles(points: DataFrame, chart: list[str], order: list[str], value: Column) -> DataFrame:
    """``start`` and ``stop`` of each slice in radians, clockwise from the top; a chart's slices go round once."""
    shared = share(points, chart, value)
    upto = Window.partitionBy(*chart).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum("share").over(upto) * 2 * F.pi() - F.pi() / 2
    return shared.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("share") * 2 * F.pi())


def combined(plots: DataFrame, chart: list[str], order: str) -> DataFrame:
    """A row a chart of several plots: ``kind``, the first plot's; ``grouping``, that of the first plot that is no line; whether lines are ``mixed`` with others."""
    line = F.col("kind") == "lineChart"
    return plots.groupBy(*chart).agg(
        F.min_by("kind", order).alias("kind"), F.coalesce(F.min_by(F.when(~line, F.coalesce("grouping", F.lit("clustered"))), F.when(~line, F.col(order))), F.lit("clustered")).alias("grouping"),
        (F.bool_or(line) & F.bool_or(~line)).alias("mixed"),
    )


def custom_errors(points: DataFrame, value: Column, plus: Column, minus: Column) -> DataFrame:
    """``low`` and ``high`` ends of error bars whose lengths are given; a missing length is none."""
    return points.withColumn("low", value - F.coalesce(minus, F.lit(0.0))).withColumn("high", value + F.coalesce(plus, F.lit(0.0)))


def sparkline_axis(points: DataFrame, line: list[str], group: list[str], value: str, low: Column, high: Column, kinds: tuple[Column, Column]) -> DataFrame:
    """``axis_low`` and ``axis_high`` of each line: its own extent, its ``group``'s, or ``custom`` ends where they are given; 0 and 1 without a number."""
    out = points
    for name, f, kind, fixed, empty in (("axis_low", F.min, kinds[0], low, 0.0), ("axis_high", F.max, kinds[1], high, 1.0)):
        own, whole = (F.coalesce(f(value).over(Window.partitionBy(*by)), F.lit(empty)) for by in (line, group))
        out = out.withColumn(name, F.when((kind == "custom") & fixed.isNotNull(), fixed).when(kind == "group", whole).otherwise(own))
    return out


def nice_step(span: Column, steps: int = 5) -> Column:
    """1, 2, 5 or 10 times a power of ten."""
    raw = span / float(steps)
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / power
    return F.when(span <= 0, 1.0).otherwise(power * F.when(part < 1.5, 1.0).when(part < 3.5, 2.0).when(part < 7.5, 5.0).otherwise(10.0))


def axis_max(high: Column, step: Column) -> Column:
    """Next multiple of the step; one more if the data touches it."""
    top = F.ceil(high / step - 1e-9) * step
    return F.when(F.abs(top - high) < 1e-9 * step, top + step).otherwise(top)


def axis_min(low: Column, step: Column) -> Column:
    bottom = F.floor(low / step + 1e-9) * step
    return F.when(low >= 0, 0.0).when(F.abs(bottom - low) < 1e-9 * step, bottom - step).otherwise(bottom)


def error_amount(kind: str, value: Column, amount: float = 1.0, over: Window | None = None) -> Column:
    """Length of an error bar: fixed, percentage, stdDev or stdErr (population)."""
    if kind == "fixedVal":
        return F.lit(float(amount))
    if kind == "percentage":
        return F.abs(value) * (amount / 100)
    deviation = F.stddev_pop(value).over(over)
    return deviation * amount if kind == "stdDev" else deviation / F.sqrt(F.count(value).over(over)) * amount


def padded(points: DataFrame, chart: list[str], index: str, value: str, n: int) -> DataFrame:
    """Points 0 to n - 1 of every chart; those that are missing are null."""
    every = points.select(*chart).distinct().withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return every.join(points.select(*chart, index, value), [*chart, index], "left")


def sparkline(points: DataFrame, line: list[str], order: list[str], value: str) -> DataFrame:
    """``low``, ``high``, ``y`` (0 to 1) and ``flag``: low over high over last over first over negative."""
    w = Window.partitionBy(*line)
    known = F.col(value).isNotNull()
    position = F.when(known, F.struct(*order))
    low, high = F.min(value).over(w), F.max(value).over(w)
    flag = (
        F.when(~known, None)
        .when(F.col(value) == low, "low")
        .when(F.col(value) == high, "high")
        .when(F.struct(*order) == F.max(position).over(w), "last")
        .when(F.struct(*order) == F.min(position).over(w), "first")
        .when(F.col(value) < 0, "negative")
    )
    y = F.when(high == low, 0.5).otherwise(F.try_divide(F.col(value) - low, high - low))
    return points.withColumn("low", low).withColumn("high", high).withColumn("y", y).withColumn("flag", flag)


def gap_segments(points: DataFrame, line: list[str], order: list[str], value: str) -> DataFrame:
    """``segment``: pieces of a line between missing points; ``zeroed``: missing points as 0."""
    w = Window.partitionBy(*line).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("segment", F.count_if(F.col(value).isNull()).over(w)).withColumn("zeroed", F.coalesce(F.col(value), F.lit(0.0)))


def chart_kind(kind: Column, direction: Column, grouping: Column) -> Column:
    """One name for a chart's type, direction and grouping."""
    stacked = F.when(grouping == "stacked", "stacked").when(grouping == "percentStacked", "percent").otherwise("plain")
    bar = F.concat(F.when(direction == "bar", "bar-").otherwise("column-"), stacked)
    return F.when(kind == "barChart", bar).when(kind.isin("lineChart", "areaChart"), F.concat(F.replace(kind, F.lit("Chart"), F.lit("-")), stacked)).otherwise(F.replace(kind, F.lit("Chart"), F.lit("")))


def radar(points: DataFrame, chart: list[str], index: str, value: str) -> DataFrame:
    """``angle`` (radians, clockwise from the top) and ``radius`` (share of the largest value)."""
    w = Window.partitionBy(*chart)
    angle = 2 * F.pi() * F.try_divide(F.col(index), F.count("*").over(w)) - F.pi() / 2
    return points.withColumn("angle", angle).withColumn("radius", F.coalesce(F.try_divide(F.col(value), F.max(value).over(w)), F.lit(0.0)))


def scatter_x(text: Column, index: Column) -> Column:
    """A point's x: its text as a number, or its position."""
    return F.coalesce(text.try_cast("double"), (index + 1).cast("double"))


def ticks(low: Column, high: Column, step: Column) -> Column:
    """Axis values from low to high."""
    n = F.floor((high - low) / step + 1e-9).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: low + i * step)
