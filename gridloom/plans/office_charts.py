"""Queries over charts in made packages."""

from __future__ import annotations

from ..sources import charts
from . import made
from .registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_POINTS = """n as (select n_nationkey as k, 'r' || n_regionkey || '.pptx' as file_path, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as idx from nation),
p as (select file_path, k, idx, s as series_name, case s when 'keys' then k when 'twice' then case when k % 4 <> 0 then -2 * k end else k / 8.0 end::double as value, place, case s when 'line' then 'lineChart' else 'barChart' end as kind
  from n, (values ('keys', 3), ('twice', 1), ('line', 2)) v(s, place))"""


@_r.query(f"with {_POINTS} select file_path, kind, series_name, place::int as place, idx, 'N' || k as category, value from p")
def office_chart_points(spark, sf_dir):
    """Points of charts with the place of their series by its own order."""
    return charts.in_order(charts.points(spark, made.chart_books(spark, sf_dir))).select("file_path", "kind", "series_name", "place", "idx", "category", "value")


@_r.query(f"""
with {_POINTS}
select file_path, series_name, idx, case when series_name = 'keys' and idx = 1 then 'pc' || k || 's' when series_name = 'keys' then 'N' || k || ' ' || k else 'twice (' || printf('%.1f', 2.0 * k) || ')' end as label,
  case when series_name = 'keys' then case when idx = 1 then 't' else 'ctr' end else 'r' end as position
from p where value is not null and (series_name = 'keys' and idx > 0 or series_name = 'twice')
""")
def office_chart_labels(spark, sf_dir):
    """Labels of points: composed, overridden with the text of cells, deleted."""
    books = made.chart_books(spark, sf_dir)
    return charts.data_labels(charts.points(spark, books), charts.labels(spark, books)).select("file_path", "series_name", "idx", "label", "position")
