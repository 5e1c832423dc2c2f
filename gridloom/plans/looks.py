"""Queries on how things look: colours, fonts, borders, eras, types, shape guides, headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import a1, colors, eras, guides, kinds
from ..operators import documents, grid, styles
from .registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_BASE = "select p_partkey, p_size, p_size * 5 as r, 255 - p_size * 3 as g, 96 as b from part"


def _base_color():
    size = F.col("p_size")
    return colors.from_channels([size * 5, 255 - size * 3, F.lit(96)])


def _hex(value: str) -> str:
    return f"lpad(printf('%X', greatest(0, least(255, floor(({value}) * 255.0 + 0.5)))::bigint), 2, '0')"


def _lit_sql(name: str, light: str) -> str:
    """SQL of one re-lighted colour of ``hls``."""
    def part(h: str) -> str:
        h = f"(({h}) - floor({h}))"
        return f"case when {h} < 1.0/6 then m1 + (m2 - m1) * {h} * 6.0 when {h} < 0.5 then m2 when {h} < 2.0/3 then m1 + (m2 - m1) * (2.0/3 - {h}) * 6.0 else m1 end"

    channels = " || ".join(_hex(part(f"h + ({d})::double")) for d in ("1.0::double/3", "0.0", "-1.0::double/3"))
    return f"""{name} as (select p_partkey, '#' || {channels} as {name} from (select *, 2.0 * n - m2 as m1 from
      (select *, case when n <= 0.5 then n * (1.0 + s) else n + s - n * s end as m2 from (select *, greatest(0.0::double, least(1.0::double, {light})) as n from hls))))"""


_HLS = f"""
base as (select p_partkey, r / 255.0::double as r, g / 255.0::double as g, b / 255.0::double as b from ({_BASE})),
ends as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from base),
hls as (select p_partkey, (hi + lo) / 2 as l, case when hi = lo then 0.0 when (hi + lo) / 2 <= 0.5 then (hi - lo) / (hi + lo) else (hi - lo) / (2.0 - hi - lo) end as s,
  case when hi = lo then 0.0 when hi = r then ((g - b) / (hi - lo)) / 6.0 when hi = g then (2.0 + (b - r) / (hi - lo)) / 6.0 else (4.0 + (r - g) / (hi - lo)) / 6.0 end as h0, h0 - floor(h0) as h from ends)"""


@_r.query(f"""
with {_HLS}, {_lit_sql("lighter", "l * (1.0::double - 0.4::double) + 0.4::double")}, {_lit_sql("darker", "l * (1.0::double - 0.25::double)")}, {_lit_sql("modulated", "l * 0.75::double")}, {_lit_sql("offset_", "l + 0.2::double")}
select * from lighter join darker using (p_partkey) join modulated using (p_partkey) join offset_ using (p_partkey)
""")
def color_tint(spark, sf_dir):
    """Theme tints, and lightness scaled or moved."""
    c = F.col("color")
    return table(spark, sf_dir, "part").select("p_partkey", _base_color().alias("color")).select(
        "p_partkey", colors.tint(c, 0.4).alias("lighter"), colors.tint(c, -0.25).alias("darker"), colors.changed(c, [("lumMod", 0.75)]).alias("modulated"), colors.changed(c, [("lumOff", 0.2)]).alias("offset_"),
    )


def _linear(c: str) -> str:
    return f"(case when {c} / 255.0::double <= 0.04045 then {c} / 255.0::double / 12.92 else pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) end)"


def _tinted(c: str) -> str:
    to = f"({_linear(c)} + (1.0 - {_linear(c)}) * 0.6::double)"
    return _hex(f"case when {to} <= 0.0031308 then {to} * 12.92 else 1.055 * pow({to}, 1 / 2.4::double) - 0.055 end")


@_r.query(f"""
select p_partkey, {" || ".join(["'#'", *(f"lpad(printf('%X', floor({c} * 0.5 + 0.5)::bigint), 2, '0')" for c in "rgb")])} as shaded, {" || ".join(["'#'", *(_tinted(c) for c in "rgb"), "'80'"])} as tinted from ({_BASE})
""")
def color_changes(spark, sf_dir):
    """Shade, and a tint in linear light with half the opacity."""
    c = F.col("color")
    return table(spark, sf_dir, "part").select("p_partkey", _base_color().alias("color")).select(
        "p_partkey", colors.changed(c, [("shade", 0.5)]).alias("shaded"), colors.changed(c, [("tint", 0.6), ("alpha", 0.5)]).alias("tinted"),
    )


@_r.query("""
with d as (select o_orderkey, (o_orderdate::date - ((o_orderkey % 135) * 365)::int) as day from orders),
e as (select *, case when day >= date '2019-05-01' then 'R' when day >= date '1989-01-08' then 'H' when day >= date '1926-12-25' then 'S' when day >= date '1912-07-30' then 'T' else 'M' end as era from d)
select o_orderkey, era, case era when 'R' then '令和' when 'H' then '平成' when 'S' then '昭和' when 'T' then '大正' else '明治' end as long_name,
  (year(day) - case when day < date '1868-01-25' then 0 else case era when 'R' then 2018 when 'H' then 1988 when 'S' then 1925 when 'T' then 1911 else 1867 end end)::int as era_year,
  (['日', '月', '火', '水', '木', '金', '土'])[dayofweek(day) + 1] || '曜日' as weekday from e
""")
def fmt_eras(spark, sf_dir):
    day = F.date_sub(F.col("o_orderdate").cast("date"), ((F.col("o_orderkey") % 135) * 365).cast("int"))
    t = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))
    d = F.col("day")
    return t.select("o_orderkey", eras.era_name(d, 1).alias("era"), eras.era_name(d).alias("long_name"), eras.era_year(d).alias("era_year"), eras.weekday_name(d, True).alias("weekday"))


@_r.query(r"""
with c as (select c_custkey, unnest([1, 2, 3, 4, 5]) as col, unnest([c_acctbal, null, null, null, null]) as num, unnest([null, c_name, null, null, (c_custkey % 7) || 'abc']) as txt, unnest([null, null, c_acctbal > 0, null, null]) as flag from customer)
select c_custkey, col, num is not null as is_number, txt is not null as is_text, txt is null as is_non_text, flag is not null as is_logical, num is null and txt is null and flag is null as is_error,
  coalesce(num, flag::int::double, 0) as n, coalesce(txt, '') as t, coalesce(num, case when col = 5 then (c_custkey % 7)::double end, 0) as value from c
""")
def fx_types(spark, sf_dir):
    """Type tests and conversions on cells of every type."""
    num, txt, flag = F.col("num"), F.col("txt"), F.col("flag")
    cell = lambda i, n=None, t=None, b=None: F.struct(F.lit(i).alias("col"), (n if n is not None else F.lit(None)).cast("double").alias("num"), (t if t is not None else F.lit(None)).cast("string").alias("txt"), (b if b is not None else F.lit(None)).cast("boolean").alias("flag"))
    rows = F.array(cell(1, n=F.col("c_acctbal")), cell(2, t=F.col("c_name")), cell(3, b=F.col("c_acctbal") > 0), cell(4), cell(5, t=F.concat((F.col("c_custkey") % 7).cast("string"), F.lit("abc"))))
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(rows)).select(
        "c_custkey", "col", kinds.is_number(num).alias("is_number"), kinds.is_text(txt).alias("is_text"), kinds.is_non_text(txt).alias("is_non_text"), kinds.is_logical(flag).alias("is_logical"), kinds.is_error(num, txt, flag).alias("is_error"),
        kinds.n(num, flag).alias("n"), kinds.t(txt).alias("t"), kinds.value(num, txt).alias("value"),
    )


@_r.query("""
select c_custkey, round(pow(c_acctbal / 1000, 3), 4) as cubed, case when c_acctbal > 0 then round(log10(c_acctbal), 6) end as log_, round(exp(c_acctbal / 10000), 6) as exp_, abs(c_acctbal) as abs_,
  case when c_acctbal > 5000 then 'high' when c_acctbal > 0 then 'some' end as ifs from customer
""")
def fx_power(spark, sf_dir):
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(kinds.power(x / 1000, F.lit(3.0)), 4).alias("cubed"), F.round(kinds.log10(x), 6).alias("log_"), F.round(F.exp(x / 10000), 6).alias("exp_"), F.abs(x).alias("abs_"),
        kinds.first_true((x > 5000, F.lit("high")), (x > 0, F.lit("some"))).alias("ifs"),
    )


#: Guides of a rectangle with round corners, its text box, and a point on an ellipse.
_GUIDES = [("a", "pin 0 16667 50000"), ("x1", "*/ ss a 100000"), ("x2", "+- r 0 x1"), ("il", "*/ x1 29289 100000"), ("bigger", "?: il x2 x1"), ("half", "+/ w h 2"), ("diagonal", "mod w h 0"), ("up", "sin hd2 2700000"), ("angle", "at2 w h"), ("onto", "cat2 wd2 w h")]


@_r.query("""
with s as (select p_partkey, p_size::double as w, p_retailprice as h from part), g as (select *, least(w, h) * 16667.0 / 100000 as x1 from s)
select p_partkey, round(x1, 6) as x1, round(w - x1, 6) as x2, round(x1 * 29289 / 100000, 6) as il, round(case when x1 > 0 then w - x1 else x1 end, 6) as bigger, round((w + h) / 2, 6) as half, round(sqrt(w * w + h * h), 6) as diagonal,
  round(h / 2 * sin(pi() / 4), 6) as up, round(atan2(h, w) * 180 * 60000 / pi(), 4) as angle, round(w / 2 * cos(atan2(h, w)), 6) as onto from g
""")
def shape_guides(spark, sf_dir):
    """Guide formulas of a shape as large as the part."""
    shapes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), F.col("p_retailprice").alias("h"))
    found = guides.guides(shapes, "w", "h", _GUIDES)
    return found.select("p_partkey", *[F.round(n, 4 if n == "angle" else 6).alias(n) for n, _ in _GUIDES if n != "a"])


_MERGES = [(1, 1, 1, 3), (2, 2, 4, 2), (2, 3, 5, 5), (6, 1, 6, 1)]


@_r.query("""
with c as (select n_regionkey::int + 1 as col, (row_number() over (partition by n_regionkey order by n_nationkey))::int as "row", case when n_nationkey % 3 = 0 then 'thick' end as r, case when n_nationkey % 2 = 0 then 'thin' end as b from nation),
m(top, lft, bottom, rgt) as (values (1, 1, 1, 3), (2, 2, 4, 2), (2, 3, 5, 5), (6, 1, 6, 1))
select top, lft as "left", bottom, rgt as "right", coalesce(e.r, k.r, a.r) as right_edge, coalesce(f.b, k.b, a.b) as bottom_edge from m left join c e on e."row" = top and e.col = rgt left join c f on f."row" = bottom and f.col = lft
  left join c k on k."row" = bottom and k.col = rgt left join c a on a."row" = top and a.col = lft
""")
def border_merged(spark, sf_dir):
    """Outer edges of merged rectangles."""
    from pyspark.sql import Window

    cells = table(spark, sf_dir, "nation").select(
        F.lit(1).alias("sheet"), (F.col("n_regionkey") + 1).alias("col"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("row"),
        F.when(F.col("n_nationkey") % 3 == 0, "thick").alias("right_edge"), F.when(F.col("n_nationkey") % 2 == 0, "thin").alias("bottom_edge"),
    )
    merges = spark.createDataFrame([(1, *m) for m in _MERGES], "sheet int, top int, left int, bottom int, right int")
    return styles.merged_border(merges, cells, ["sheet"]).drop("sheet")


@_r.query("""
select p_partkey, coalesce(p_size > 25, false) or p_retailprice < 950 or p_size = 1 as bold, p_size % 3 = 0 as italic, p_retailprice < 930 as underline, p_size % 5 = 0 or p_retailprice < 920 as strike,
  case when p_size % 4 = 0 then '#112233' when p_size % 2 = 0 then '#445566' end as fill from part
""")
def font_effective(spark, sf_dir):
    """Font toggles of the cell, a rule and a table header; a rule's fill."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    own = {"bold": size > 25, "italic": size % 3 == 0, "underline": F.lit(None).cast("boolean"), "strike": size % 5 == 0}
    rule = {"bold": price < 950, "italic": F.lit(False), "underline": price < 930, "strike": price < 920}
    fill = styles.dxf_fill(F.when(size % 4 == 0, "#112233"), F.when(size % 2 == 0, "#445566"))
    return table(spark, sf_dir, "part").select("p_partkey", *styles.merged_font(own, rule, size == 1), fill.alias("fill"))


@_r.query("select n_nationkey, to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::varchar as row_json from nation")
def json_rows(spark, sf_dir):
    """Rows of the model as JSON."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("row_json"))


@_r.query("""
with g as (select row_number() over (order by s_suppkey) as r, s_acctbal, s_nationkey from supplier), c as (select r, 1 as col, s_acctbal as v from g union all select r, 2, s_nationkey::double from g)
select count(*) as n, round(sum(v), 2) as total, min(v) as low, max(v) as high from c where (r between 1 and 6 and col = 1) or (r between 4 and 9 and col between 1 and 2)
""")
def range_union(spark, sf_dir):
    """Numbers of several ranges; a cell in two of them counts once."""
    cells = grid.as_cells(grid.first_rows(table(spark, sf_dir, "supplier"), ["s_suppkey"], 9), ["row"], ["s_acctbal", "s_nationkey"])
    found = cells.where(a1.inside(a1.rectangles(F.lit("A1:A6 A4:B9")), F.col("row"), F.col("col")))
    return found.agg(F.count("v_num").alias("n"), F.round(F.sum("v_num"), 2).alias("total"), F.min("v_num").alias("low"), F.max("v_num").alias("high"))


@_r.query("""
select conv_id, turn, case when turn = 0 then 'first' when turn % 2 = 1 then 'even' else 'default' end as header, 'page ' || (turn + 1) as footer from conversations
""")
def header_choice(spark, sf_dir):
    """Header of each page, and its number in the footer."""
    page = F.col("turn") + 1
    footer = F.replace(F.lit("page {n}"), F.lit("{n}"), page.cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", documents.header_kind(page, True, True).alias("header"), footer.alias("footer"))
