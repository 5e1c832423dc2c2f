"""Queries over tables inside made packages: spans, styles, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats
from ..operators import anchored, tables
from ..sources import deck_tables, parts, spreadsheets
from . import made
from .registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

#: Cells of the made tables with what is above each of them: a rectangle, or a cell that another covers.
_SPANS = """
k as (select n_nationkey as k, n_regionkey as g, 'r' || n_regionkey || '.pptx' as file_path, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as slide from nation),
cells as (select *, r::int as "row", c::int as col from k, range(4) t(r), range(3) u(c)),
own as (select *, case when "row" = 1 and col = 0 and k % 3 = 0 then 2 else "row" end as bottom, case when "row" = 0 and col = 0 and k % 2 = 0 or "row" = 3 and col = 1 and k % 5 = 0 then 2 else col end as "right" from cells
  where not ("row" = 0 and col > 0 and k % 2 = 0) and not ("row" = 2 and col = 0 and k % 3 = 0) and not ("row" = 3 and col = 2 and k % 5 = 0))
"""


def _placed(spark, sf_dir, files):
    return tables.placed(deck_tables.cells(spark, files).where("error is null"), ["file_path", "slide", "shape"])


@_r.query(f"""
with {_SPANS}
select file_path, slide, (k * 100 + "row" * 10 + col)::varchar as text, "row" as top, col as "left", bottom::int as bottom, "right"::int as "right", (50 * col * (col + 1) + k * col)::bigint as x, (5 * "row" * ("row" + 1))::bigint as y,
  (50 * ("right" + 1) * ("right" + 2) + k * ("right" + 1) - 50 * col * (col + 1) - k * col)::bigint as w, (5 * (bottom + 1) * (bottom + 2) - 5 * "row" * ("row" + 1))::bigint as h from own
""")
def office_table_spans(spark, sf_dir):
    """Rectangles and places of the cells of decks' tables."""
    return _placed(spark, sf_dir, made.table_decks(spark, sf_dir)).select("file_path", "slide", "text", "top", "left", "bottom", "right", "x", "y", "w", "h")


def _tint(c: str, share: float) -> str:
    linear = f"(case when {c} / 255.0::double <= 0.04045 then {c} / 255.0::double / 12.92 else pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) end)"
    to = f"({linear} + (1.0 - {linear}) * {share}::double)"
    return f"floor((case when {to} <= 0.0031308 then {to} * 12.92 else 1.055 * pow({to}, 1 / 2.4::double) - 0.055 end) * 255.0 + 0.5)"


def _color(r: str, g: str, b: str) -> str:
    return "'#' || " + " || ".join(f"lpad(printf('%X', ({c})::bigint), 2, '0')" for c in (r, g, b))


_A1, _A2 = ("(40 + g * 10)", "(100 + g * 20)", "200"), ("(200 - g * 9)", "(50 + g * 11)", "70")
_shade = lambda share: _color(*[f"floor({c} * {share}::double + 0.5)" for c in _A2])


@_r.query(f"""
with {_SPANS},
flags as (select *, k % 4 != 1 as first_row, k % 4 != 2 as band_row, k % 4 = 3 as first_col, k % 7 = 0 as last_row, g % 2 = 0 as light from own)
select file_path, slide, "row" as top, col as "left", case when "row" = 2 and col = 2 and k % 6 = 0 then '#AB' || lpad(printf('%X', k), 2, '0') || 'CD'
  when first_col and col = 0 then case when light then {_color(*_A1)} else {_shade(0.6)} end
  when last_row and "row" = 3 then case when light then {_color(*_A1)} else {_shade(0.6)} end
  when first_row and "row" = 0 then case when light then {_color(*_A1)} else '#101010' end
  when band_row and not (first_row and "row" = 0) and ("row" - first_row::int) % 2 = 0 then case when light then {_color(*[_tint(c, 0.4) for c in _A1])} else {_shade(0.4)} end
  else case when light then {_color(*[_tint(c, 0.2) for c in _A1])} else {_shade(0.2)} end end as fill
from flags
""")
def office_table_fills(spark, sf_dir):
    """Fills of the cells of decks' tables: built-in styles in each deck's own theme."""
    files = made.table_decks(spark, sf_dir)
    return tables.cell_fills(_placed(spark, sf_dir, files), parts.themes(spark, files), deck_tables.styles(spark, files)).select("file_path", "slide", "top", "left", "fill")


@_r.query("""
with c as (select *, 'n' || c_nationkey || '.xlsx' as file_path, (row_number() over (partition by c_nationkey order by c_custkey) + 1)::int as r, (count(*) over (partition by c_nationkey) + 1)::int as last from customer),
cells as (select file_path, last, r as "row", col::int as col from c, range(1, 4) t(col) union all select distinct file_path, last, 1, 1 from c),
placed as (select *, col >= 2 and "row" between least(3, last - 1) and greatest(3, last - 1) as second from cells),
named as (select *, least(3, last - 1) as top2, greatest(3, last - 1) as bottom2 from placed)
select file_path, "row", col, case when second then 'TableStyleMedium12' else 'Wide' end as "table",
  case when second then case when "row" = top2 then 'header' when "row" = bottom2 then 'totals' else 'band1' end when "row" = 1 then 'header' when "row" % 2 = 1 then 'band2' else 'band1' end as part,
  case when second then col = 2 else false end as is_first_col, case when second then false else col = 3 end as is_last_col, case when second then 'accent4' end as accent,
  case when second then null when "row" = 1 then 2 when "row" % 2 = 1 then 7 else 4 end::int as dxf_id
from named
""")
def office_table_overlay(spark, sf_dir):
    """Cells of books under two tables that overlap, with the formats of a style of the books' own."""
    files = made.table_books(spark, sf_dir)
    laid = tables.overlay(spreadsheets.cells(spark, files).select("file_path", "sheet_idx", "row", "col"), spreadsheets.tables(spark, files).where("error is null"), ["file_path", "sheet_idx"])
    named = tables.style_formats(laid, spreadsheets.table_styles(spark, files)).withColumn("accent", tables.accent_slot(F.col("table_style")))
    return named.select("file_path", "row", "col", "table", "part", "is_first_col", "is_last_col", "accent", "dxf_id")


_MATCHED = """with c as (select *, 'n' || c_nationkey || '.xlsx' as file_path, (row_number() over (partition by c_nationkey order by c_custkey) + 1)::int as r from customer),
cells as (select file_path, r as "row", col::int as col, case col when 1 then c_custkey::double when 2 then c_acctbal else c_custkey * 10.0 end as v from c, range(1, 4) t(col) union all select distinct file_path, 1, 3, 500.0 from c),
near as (select c.*, coalesce(b.v, 0) as b, coalesce(nxt.v, 0) as nxt, coalesce(down.v, 0) as down, coalesce(one.v, 0) as one from cells c left join cells b on b.file_path = c.file_path and b."row" = c."row" and b.col = 2
  left join cells nxt on nxt.file_path = c.file_path and nxt."row" = c."row" and nxt.col = c.col + 1 left join cells down on down.file_path = c.file_path and down."row" = c."row" + 1 and down.col = c.col
  left join cells one on one.file_path = c.file_path and one."row" = c."row" and one.col = c.col + 1),
matched as (
  select file_path, "row", col, 3 as priority, false as stops from near where col = 1 and "row" > 1 and b > 0
  union all select file_path, "row", col, 2, true from near where (col = 2 and "row" > 1 or col = 3 and "row" > 2) and v > nxt
  union all select file_path, "row", col, 1, false from near where col in (2, 3) and "row" > 1 and 500 <= one
  union all select file_path, "row", col, 4, false from near where "row" > 1 and down <> v),"""


@_r.query(f"""
{_MATCHED}
kept as (select *, min(case when stops then priority end) over (partition by file_path, "row", col) as stop from matched)
select file_path, "row", col, priority, (row_number() over (partition by file_path, "row", col order by priority))::int as at from kept where stop is null or priority <= stop
""")
def office_anchored_rules(spark, sf_dir):
    """Rules of books whose references move with the cell."""
    files = made.rule_books(spark, sf_dir)
    return _applied(spark, files, _rules(spark, files), ["cf_idx", "rule_idx", "dxf_id"]).select("file_path", "row", "col", "priority", "at")


def _rules(spark, files):
    rules = spreadsheets.format_rules(spark, files).where("error is null and type = 'expression'").withColumn("formula", F.get("formulas", F.lit(0)))
    return rules.select("file_path", "sheet_idx", "cf_idx", "rule_idx", "dxf_id", "sqref", "formula", "priority", "stop_if_true")


def _applied(spark, files, rules, key):
    by = ["file_path", "sheet_idx"]
    return anchored.applied(anchored.matches(spreadsheets.cells(spark, files), rules, by, key), by)


@_r.query(f"""
{_MATCHED}
kept as (select *, min(case when stops then priority end) over (partition by file_path, "row", col) as stop from matched),
first_ as (select file_path, "row", col, min(priority) as p from kept where (stop is null or priority <= stop) and priority < 4 group by all)
select c.file_path, c."row", c.col, case f.p when 1 then printf('%.1f', round(c.v::varchar::decimal(38,12), 1)) when 2 then printf('%.2f', round(c.v::varchar::decimal(38,12), 2)) when 3 then printf('%.3f', round(c.v::varchar::decimal(38,12), 3)) else regexp_replace(c.v::varchar, '\\.0$', '') end as shown,
  case when f.p is not null then 'FF' || lpad(printf('%X', count(*) filter (where c.col = 1) over (partition by c.file_path)), 6, '0') end as bottom
from cells c left join first_ f on f.file_path = c.file_path and f."row" = c."row" and f.col = c.col
""")
def office_rule_formats(spark, sf_dir):
    """Cells as the number format of the first rule that has one shows them, and the edge that it draws."""
    files = made.rule_books(spark, sf_dir)
    codes = spreadsheets.rule_formats(spark, files).where("error is null").select("file_path", "dxf_id", "format_code")
    edges = spreadsheets.rule_borders(spark, files).where("error is null and edge = 'bottom'").select("file_path", "dxf_id", F.col("rgb").alias("line"))
    at = ["file_path", "sheet_idx", "row", "col"]
    rules = _rules(spark, files).join(codes, ["file_path", "dxf_id"], "left").join(edges, ["file_path", "dxf_id"], "left")  # few rows; cells of a rule are many
    said = _applied(spark, files, rules, ["cf_idx", "rule_idx", "format_code", "line"]).where("format_code is not null")
    first = said.groupBy(*at).agg(F.min_by("format_code", "priority").alias("code"), F.min_by("line", "priority").alias("bottom"))
    cells = spreadsheets.cells(spark, files).select(*at, "v_num", "v_text").join(first.hint("merge"), at, "left")
    return formats.formatted(cells, "code", "v_num", "v_text", codes.select(F.col("format_code").alias("code"))).select("file_path", "row", "col", "shown", "bottom")
