"""Colour arithmetic on ``#RRGGBB`` texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(color: Column, i: int) -> Column:
    return F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("int")


def from_channels(channels: list[Column]) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int")))), 2, "0") for c in channels])


def interpolate(a: Column, b: Column, t: Column) -> Column:
    """Channel by channel, halves up."""
    return from_channels([F.floor(channel(a, i) + (channel(b, i) - channel(a, i)) * t + 0.5) for i in range(3)])


def blended(front: Column, back: Column, share: Column) -> Column:
    """``front`` over ``back`` with a share of coverage, clamped."""
    return interpolate(back, front, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def stripe(accent: Column) -> Column:
    """Colour of a table's stripes: a fifth of the accent on white; without an accent, a light grey."""
    return F.when(F.length(accent) >= 7, blended(accent, F.lit("#FFFFFF"), F.lit(0.2))).otherwise("#F2F2F2")


def series_color(accents: Column, index: Column) -> Column:
    """A series without a colour takes one of the six accents in turn."""
    return F.try_element_at(accents, (index % 6 + 1).cast("int"))


def scale_color(x: Column, stops: list[tuple[Column, str]]) -> Column:
    """Piecewise linear colour of a value between sorted (value, colour) stops, clamped at the ends."""
    pieces = []
    for (v1, c1), (v2, c2) in zip(stops, stops[1:]):
        t = F.coalesce(F.try_divide(x - v1, v2 - v1), F.lit(0.0))
        pieces.append((x <= v2, interpolate(F.lit(c1), F.lit(c2), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))))
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pieces), F.lit(stops[-1][1].upper()))


def tint(color: Column, amount: float) -> Column:
    """Lightness in HLS moved toward white (positive) or black (negative)."""
    return relight(color, lambda light: light * (1.0 + amount) if amount < 0 else light * (1.0 - amount) + amount)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def relight(color: Column, change: Callable[[Column], Column]) -> Column:
    """The colour with another lightness, its hue and saturation as they are."""
    channels = F.struct(*[(channel(color, i) / 255.0).alias(n) for i, n in enumerate("rgb")])

    def ends(c: Column) -> Column:
        high, low = F.greatest(c.r, c.g, c.b), F.least(c.r, c.g, c.b)
        return F.struct(c.r.alias("r"), c.g.alias("g"), c.b.alias("b"), high.alias("high"), ((high + low) / 2).alias("light"), (high - low).alias("span"))

    def cone(c: Column) -> Column:
        saturation = F.when(c.span == 0, 0.0).when(c.light <= 0.5, F.try_divide(c.span, c.light * 2)).otherwise(F.try_divide(c.span, 2.0 - c.light * 2))
        sixth = F.when(c.span == 0, 0.0).when(c.high == c.r, F.try_divide(c.g - c.b, c.span)).when(c.high == c.g, 2.0 + F.try_divide(c.b - c.r, c.span)).otherwise(4.0 + F.try_divide(c.r - c.g, c.span))
        return F.struct(saturation.alias("s"), F.pmod(F.coalesce(sixth, F.lit(0.0)) / 6.0, F.lit(1.0)).alias("hue"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), change(c.light))).alias("new"))

    def bounds(c: Column) -> Column:
        m2 = F.when(c.new <= 0.5, c.new * (1.0 + c.s)).otherwise(c.new + c.s - c.new * c.s)
        return F.struct(c.hue.alias("hue"), m2.alias("m2"), (2.0 * c.new - m2).alias("m1"))

    def shown(c: Column) -> Column:
        def part(h: Column) -> Column:
            return F.when(h < 1 / 6, c.m1 + (c.m2 - c.m1) * h * 6.0).when(h < 0.5, c.m2).when(h < 2 / 3, c.m1 + (c.m2 - c.m1) * (2 / 3 - h) * 6.0).otherwise(c.m1)

        return from_channels([F.floor(_let(F.pmod(c.hue + d, F.lit(1.0)), part) * 255.0 + 0.5) for d in (1 / 3, 0.0, -1 / 3)])

    return _let(channels, lambda c: _let(ends(c), lambda e: _let(cone(e), lambda k: _let(bounds(k), shown))))


def light_modulated(color: Column, share: Column) -> Column:
    """``lumMod``: lightness times a share."""
    return relight(color, lambda light: light * share)


def light_offset(color: Column, share: Column) -> Column:
    """``lumOff``: lightness plus a share."""
    return relight(color, lambda light: light + share)


def shaded(color: Column, share: Column) -> Column:
    """``shade``: each channel times a share; 1 changes nothing, 0 is black."""
    return from_channels([F.floor(channel(color, i) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) + 0.5) for i in range(3)])


def linear_tinted(color: Column, share: Column) -> Column:
    """``tint``: a step of ``share`` toward white in linear light."""

    def linear(c: Column) -> Column:
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    def moved(x: Column) -> Column:
        to = x + (1.0 - x) * share
        return _let(to, lambda t: F.when(t <= 0.0031308, t * 12.92).otherwise(1.055 * F.pow(t, F.lit(1 / 2.4)) - 0.055))

    return from_channels([F.floor(_let(linear(channel(color, i)), moved) * 255.0 + 0.5) for i in range(3)])


#: Changes by the names that colour definitions give them.
CHANGES = {"lumMod": light_modulated, "lumOff": light_offset, "shade": shaded, "tint": linear_tinted}


def changed(color: Column, steps: list[tuple[str, float]]) -> Column:
    """Changes applied in the order in which they stand; ``alpha`` is appended as two more digits, other names are left out."""
    opacity = 1.0
    for name, share in steps:
        if name == "alpha":
            opacity = share
        elif name in CHANGES:
            color = CHANGES[name](color, F.lit(share))
    shown = round(max(0.0, min(1.0, opacity)) * 255)
    return color if shown == 255 else F.concat(color, F.lit(f"{shown:02X}"))
