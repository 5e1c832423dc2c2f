"""Queries over made decks: inherited texts and positions, shapes in groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, slides
from ..sources import placeholders, presentations
from . import made
from .registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_SLIDES = "s as (select n_nationkey as k, n_regionkey as g, 'r' || n_regionkey || '.pptx' as file_path, (row_number() over (partition by n_regionkey order by n_nationkey desc) - 1)::int as slide from nation)"


@_r.query(f"""
with {_SLIDES}, v(shape, inherited, bold, italic, align) as (values (0, 44.0, null, true, 'ctr'), (1, null, true, null, 'r'), (2, null, true, null, 'r'), (3, 9.0, null, null, null), (4, 9.0, null, null, null), (5, null, null, null, null))
select file_path, slide, shape::int as shape, k || '-' || shape as text, (case when k % 3 = 0 then k + 10 when inherited is not null then inherited when shape = 5 then 10 + g else 20 + g end)::double as size, bold, italic,
  case when shape in (1, 2) then 'accent' || g % 3 + 1 when shape = 5 then '112233' end as color, align from s, v
""")
def office_inherited_texts(spark, sf_dir):
    """Size, toggles, colour and alignment of runs: their own, or what the placeholder inherits."""
    decks = made.text_decks(spark, sf_dir)
    down = slides.inherited_text(presentations.slides(spark, decks), placeholders.text_properties(spark, decks))
    return slides.effective_runs(presentations.runs(spark, decks).where("error is null"), down).select("file_path", "slide", "shape", "text", "size", "bold", "italic", "color", "align")


@_r.query(f"""
with {_SLIDES} select file_path, slide, shape::int as shape, idx::int as idx, x::bigint as x from s, (values (0, null, 11), (1, 1, 12), (2, null, 12), (3, null, 13), (4, 11, 13), (5, null, 14)) v(shape, idx, x)
""")
def office_placeholder_positions(spark, sf_dir):
    """Places of placeholders with and without an index."""
    decks = made.text_decks(spark, sf_dir)
    return presentations.inherited_positions(presentations.slides(spark, decks), presentations.elements(spark, decks)).select("file_path", "slide", "shape", "idx", "x")


def _up(source: str, to: str, x: str, y: str, w: str, h: str, inner: tuple, rot: str, flip_h: str, flip_v: str) -> str:
    """SQL of one group around the boxes of ``source``."""
    cx, cy, cw, ch = inner
    return f"""{to}_f as (select *, ({rot})::double as gr, {flip_h} as gh, {flip_v} as gv, case when {flip_h} then 2 * {cx} + {cw} - cx else cx end as fx, case when {flip_v} then 2 * {cy} + {ch} - cy else cy end as fy from {source}),
{to}_d as (select *, (fx - {cx}) * {w} / {cw}::double - {w} / 2.0 as dx, (fy - {cy}) * {h} / {ch}::double - {h} / 2.0 as dy from {to}_f),
{to} as (select k, file_path, slide, shape, {x} + {w} / 2.0 + dx * cos(radians(gr)) - dy * sin(radians(gr)) as cx, {y} + {h} / 2.0 + dx * sin(radians(gr)) + dy * cos(radians(gr)) as cy, w * {w} / {cw}::double as w, h * {h} / {ch}::double as h,
  gr + case when gh <> gv then -rot else rot end as rot, flip_h <> gh as flip_h, flip_v <> gv as flip_v from {to}_d)"""


@_r.query(f"""
with {_SLIDES},
inner_b as (select k, file_path, slide, 3 as shape, 25.0 as cx, 18.0 as cy, 10.0 as w, 6.0 as h, 30.0 as rot, false as flip_h, false as flip_v from s),
{_up("inner_b", "b", "100", "50", "80", "40", ("10", "10", "40", "20"), "0", "false", "(k % 3 = 0)")},
both_ as (select k, file_path, slide, 1 as shape, 40.0 as cx, 20.0 as cy, 40.0 as w, 20.0 as h, 0.0 as rot, false as flip_h, false as flip_v from s union all select * from b),
{_up("both_", "moved", "(k * 10)", "6", "400", "200", ("0", "0", "200", "100"), "k % 4 * 90", "(k % 2 = 1)", "false")},
every as (select * from moved union all select k, file_path, slide, 4, k + 3.5, 5.0, 7.0, 8.0, 0.0, false, false from s)
select file_path, slide, shape::int as shape, round(cx - w / 2)::bigint as x, round(cy - h / 2)::bigint as y, round(w)::bigint as w, round(h)::bigint as h, rot::double as rot, flip_h, flip_v from every
""")
def office_group_positions(spark, sf_dir):
    """Places, sizes, turns and mirrors of shapes in groups within groups."""
    decks = made.group_decks(spark, sf_dir)
    placed = presentations.absolute_elements(presentations.elements(spark, decks)).where("kind = 'sp'")
    return placed.join(presentations.slides(spark, decks).where("error is null").select("file_path", "part", "slide"), ["file_path", "part"]).select("file_path", "slide", "shape", "x", "y", "w", "h", "rot", "flip_h", "flip_v")


@_r.query(f"""
with {_SLIDES}, v as (select *, (50 + k)::double - k as cut from s),
p as (select file_path, slide, 0 as path, ord, case ord when 0 then k when 1 then cut when 2 then cut when 3 then cut - k when 4 then 150 else k end / 200.0 as x, case ord when 0 then 0 when 1 then 50 when 2 then 30 when 3 then 30 + k when 4 then k else 0 end / 100.0 as y from v, range(6) t(ord)
  union all select file_path, slide, 1, ord, ord::double, case ord when 0 then 0.5 else 1 end from v, range(2) t(ord))
select file_path, slide, path::int as path, ord::int as ord, round(x, 9)::double as x, round(y, 9)::double as y from p
""")
def office_shape_points(spark, sf_dir):
    """Points of custom shapes, in shares of their size."""
    decks = made.shape_decks(spark, sf_dir)
    shapes = presentations.elements(spark, decks).where("error is null").select("file_path", "part", "shape", "w", "h")
    points = geometry.path_points(shapes, presentations.shape_paths(spark, decks).where("error is null"), ["file_path", "part", "shape"])
    listed = presentations.slides(spark, decks).where("error is null").select("file_path", "part", "slide")
    return points.join(listed, ["file_path", "part"]).select("file_path", "slide", "path", "ord", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
