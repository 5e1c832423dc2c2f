"""Queries on formula values, references, formats and the looks that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import a1, colors, dates, formats, labels, numbers
from ..functions.criteria import text_rule
from ..functions.values import Value, compare
from ..operators import charts, documents, grid, packages, references, rules, styles
from ..sources.charts import with_categories
from .registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_MIXED = """with c as (select c_custkey, case c_custkey % 5 when 0 then c_acctbal end as num, case c_custkey % 5 when 1 then (c_custkey % 9) || 'abc' when 2 then c_mktsegment end as txt, case c_custkey % 5 when 3 then c_acctbal > 0 end as flag from customer),
v as (select *, txt is null or c_custkey % 5 = 1 as numeric, coalesce(num, flag::int::double, case when c_custkey % 5 = 1 then (c_custkey % 9)::double end, 0) as n, coalesce(regexp_replace(num::varchar, '\\.0$', ''), flag::varchar, txt, '') as s from c)
"""


def _mixed(spark, sf_dir):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    text = F.when(k % 5 == 1, F.concat((k % 9).cast("string"), F.lit("abc"))).when(k % 5 == 2, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 5 == 0, bal).alias("num"), text.alias("txt"), F.when(k % 5 == 3, bal > 0).alias("flag"))


def _value():
    return Value.of(F.col("num"), F.col("txt"), F.col("flag"))


@_r.query(_MIXED + "select c_custkey, case when numeric then n < 4 else s < '4' end as less, case when numeric then n = 0 else s = '0' end as zero, case when numeric then n >= 1 else s >= 'true' end as over, s > 'F' as after, s = 'MACHINERY' as same from v")
def fx_compare(spark, sf_dir):
    """Comparisons of numbers, texts, flags and blanks with each kind of value."""
    a, number, text = _value(), lambda x: Value.of(num=F.lit(x)), lambda x: Value.of(text=F.lit(x))
    return _mixed(spark, sf_dir).select(
        "c_custkey", compare(a, "<", number(4.0)).alias("less"), compare(a, "=", Value.of()).alias("zero"),
        compare(a, ">=", Value.of(flag=F.lit(True))).alias("over"), compare(a, ">", text("F")).alias("after"), compare(a, "=", text("MACHINERY")).alias("same"),
    )


@_r.query(_MIXED + "select c_custkey, n as num_, coalesce(regexp_replace(num::varchar, '\\.0$', ''), upper(flag::varchar), txt, '') as str_, coalesce(flag, num <> 0, txt <> '', false) as bool_ from v")
def fx_coercions(spark, sf_dir):
    v = _value()
    return _mixed(spark, sf_dir).select("c_custkey", v.number().alias("num_"), v.string().alias("str_"), v.truth().alias("bool_"))


_GRID = """with o as (select o_custkey % 7 as sheet, o_totalprice as v, o_orderkey as k, row_number() over (partition by o_custkey % 7 order by o_orderkey) - 1 as i from orders),
g as (select sheet::int as sheet, (i // 3 + 1)::int as "row", (i % 3 + 1)::int as col, v from o)
"""


def _grid(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).cast("int").alias("sheet"), F.col("o_totalprice").alias("v"), "o_orderkey")
    i = F.col("row") - 1
    return grid.numbered(t, ["o_orderkey"], ["sheet"]).select("sheet", F.floor(i / 3 + 1).cast("int").alias("r"), (i % 3 + 1).cast("int").alias("col"), "v").withColumnRenamed("r", "row")


@_r.query(_GRID + 'select g.sheet, g."row", g.col, g.v, a.v as above, b.v as first_ from g left join g a on a.sheet = g.sheet and a."row" = g."row" - 1 and a.col = g.col + 1 left join g b on b.sheet = g.sheet and b."row" = 1 and b.col = 2')
def fx_references(spark, sf_dir):
    """A relative and a fixed reference of one formula in every cell."""
    cells = _grid(spark, sf_dir)
    return references.absolute(references.relative(cells, ["sheet"], "v", -1, 1, "above"), ["sheet"], "v", 1, 2, "first_")


@_r.query(_GRID + """select sheet, "row", col, v, round(sum(v) over w, 2) as column_, round(sum(v) over s, 2) + 0 as line, n, high from g join (
  select g.sheet, g."row", g.col, count(*) as n, max(m.v) as high from g join g m on m.sheet = g.sheet and m."row" between g."row" - 1 and g."row" + 2 and m.col between g.col - 1 and g.col group by all) using (sheet, "row", col)
  window w as (partition by sheet, col order by "row" range between 2 preceding and current row), s as (partition by sheet, "row" order by col range between unbounded preceding and 1 following)""")
def fx_relative_ranges(spark, sf_dir):
    """Ranges that move with their cell: part of a column, of a row, a rectangle."""
    cells, own = _grid(spark, sf_dir), ["sheet"]
    column = references.running_range(cells, own, "row", -2, 0, F.sum("v")).withColumn("column_", F.round("amount", 2))
    line = references.running_range(column, own, "col", -2, 1, F.sum("v")).withColumn("line", F.round("amount", 2)).drop("amount")
    return references.relative_range(line, own, "v", (-1, -1, 2, 0), {"n": F.count("*"), "high": F.max("v")})


@_r.query(_GRID + 'select sheet, "row", col, v, (("row" - 2) * 2 + col - 2)::int as position from g where "row" between 2 and 400 and col between 2 and 3 and ("row" - 2) * 2 + col - 2 < 500')
def fx_range_limit(spark, sf_dir):
    """A range row by row, its first 500 cells."""
    return references.row_major(_grid(spark, sf_dir), ["sheet"], (400, 3), (2, 2), most=500)


@_r.query("select o_orderkey, case o_orderkey % 3 when 0 then 45418.0 when 1 then 45418.75 else o_totalprice end::double as shown from orders")
def fx_volatile(spark, sf_dir):
    """TODAY and NOW at a given moment; other formulas keep their number."""
    k = F.col("o_orderkey") % 3
    formula = F.when(k == 0, " =Today( )").when(k == 1, "now()").otherwise("TODAY()+1")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.volatile(formula, F.col("o_totalprice"), F.lit("2024-05-06 18:00:00").cast("timestamp")).alias("shown"))


@_r.query(r"""
with o as (select o_orderkey, o_totalprice as num, o_orderpriority as txt, o_orderkey % 6 as k from orders)
select o_orderkey, case k when 0 then printf('%.2f', round(num::decimal(38,12), 2)) when 1 then format('{:,}', floor(num::decimal(38,12) + 0.5)::bigint) when 2 then '<' || txt || '>!' when 3 then '' when 4 then txt else regexp_replace(num::varchar, '\.0$', '') end as shown from o
""")
def fmt_effective(spark, sf_dir):
    """Format of the rule, else of the style, else of the built-in id; texts under the fourth section."""
    k = F.col("o_orderkey") % 6
    rule, style = F.when(k == 0, "0.00").when(k == 2, '0;-0;0;"<"@">"\\!'), F.when(k.isin(0, 2), "0%").when(k == 3, ";;;").when(k == 4, "0.0")
    number = k.isin(0, 1, 5)
    cells = table(spark, sf_dir, "orders").select("o_orderkey", F.when(number, F.col("o_totalprice")).alias("num"), F.when(~number, F.col("o_orderpriority")).alias("txt"), formats.effective(rule, style, F.when(k == 1, 3).otherwise(0)).alias("code"))
    return formats.formatted(cells, "code", "num", "txt").select("o_orderkey", "shown")


_DATE_SQL = {
    14: "m || '/' || d || '/' || y", 15: "d || '-' || strftime(t, '%b-%y')", 16: "d || '-' || strftime(t, '%b')", 17: "strftime(t, '%b-%y')", 18: "h12 || ':' || mm || ' ' || ampm", 19: "h12 || ':' || mm || ':' || ss || ' ' || ampm",
    20: "h || ':' || mm", 21: "h || ':' || mm || ':' || ss", 22: "m || '/' || d || '/' || y || ' ' || h || ':' || mm", 27: "'H' || (y - 1988) || '.' || m || '.' || d", 28: "'平成' || (y - 1988) || '年' || m || '月' || d || '日'", 30: "m || '/' || d || '/' || strftime(t, '%y')",
    31: "y || '年' || m || '月' || d || '日'", 52: "y || '年' || m || '月'", 53: "m || '月' || d || '日'",
}
#: Built-in ids that share a code.
_SAME = {29: 28, 50: 27, 51: 28, 54: 28, 55: 52, 56: 53, 57: 27, 58: 28}


@_r.query(f"""
with o as (select o_orderkey, o_orderdate::timestamp + (o_orderkey * 977 % 86400)::int * interval 1 second as t from orders),
p as (select o_orderkey, t, year(t) as y, month(t) as m, day(t) as d, hour(t) as h, case when hour(t) % 12 = 0 then 12 else hour(t) % 12 end as h12, strftime(t, '%M') as mm, strftime(t, '%S') as ss, case when hour(t) < 12 then 'AM' else 'PM' end as ampm from o)
select o_orderkey, {", ".join(f"{_DATE_SQL[_SAME.get(i, i)]} as f{i}" for i in sorted([*_DATE_SQL, *_SAME]))} from p
""")
def fmt_builtin_dates(spark, sf_dir):
    """All built-in date and time ids."""
    n = dates.serial(F.col("o_orderdate")) + (F.col("o_orderkey") * 977 % 86400) / 86400
    return table(spark, sf_dir, "orders").select("o_orderkey", *[formats.format_value(n, formats.BUILTIN[i]).alias(f"f{i}") for i in sorted([*_DATE_SQL, *_SAME])])


@_r.query(r"""
with c as (select c_custkey, c_acctbal as x, round(c_acctbal::decimal(38,12), 2) as r2, abs(c_acctbal) as a, floor(abs(c_acctbal)::decimal(38,12) + 0.5)::bigint as w from customer)
select c_custkey, w::varchar as f1, case when x < 0 then '-' else '' end || printf('%.2f', round(a::decimal(38,12), 2)) as f2, case when x < 0 then '-' else '' end || format('{:,}', w) as f3,
  case when x < 0 then '-' else '' end || format('{:,.2f}', round(a::decimal(38,12), 2)::double) as f4, case when x < 0 then '-' else '' end || floor(a::decimal(38,12) * 100 + 0.5)::bigint || '%' as f9,
  case when x < 0 then '-' else '' end || printf('%.2f', round(a::decimal(38,12) * 100, 2)) || '%' as f10, case when x < 0 then '(' || format('{:,}', w) || ')' else format('{:,}', w) end as f37,
  case when x < 0 then '(' || format('{:,.2f}', round(a::decimal(38,12), 2)::double) || ')' else format('{:,.2f}', round(a::decimal(38,12), 2)::double) end as f39 from c
""")
def fmt_builtin_numbers(spark, sf_dir):
    x = F.col("c_acctbal")
    found = [formats.builtin_value(x, i).alias(f"f{i}") for i in (2, 3, 4, 9, 10, 37, 39)]
    return table(spark, sf_dir, "customer").select("c_custkey", formats.builtin_value(F.abs(x), 1).alias("f1"), *found)


#: Codes with colours, conditions, currencies, padding, fill, quoted semicolons, empty sections.
_NUMBER_CODES = [
    "#,##0;[Red]-#,##0", "[$USD] #,##0.00", "[$€-407] 0.0", '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_)', '[Blue][>=1000]0.0"k+";0" low"', "[Green]0%;[Red](0%)",
    '"a;b" 0', "[Red]General", "00000", '#,##0\\ "pcs";;"none"', "0*-", "[Color 3]\\~0.0_x", "[$-409]#,##0.0", "0.00", None,
]


@_r.query(r"""
with c as (select c_custkey, c_acctbal as x, abs(c_acctbal)::varchar::decimal(38,12) as a, case when c_acctbal < 0 then '-' else '' end as s, c_custkey % 15 as k from customer),
d as (select *, case when floor(a + 0.5) > 0 then s else '' end as s0, case when floor(a * 10 + 0.5) > 0 then s else '' end as s1, format('{:,}', floor(a + 0.5)::bigint) as w, floor(a + 0.5)::bigint::varchar as p,
  format('{:,.2f}', round(a, 2)::double) as w2, printf('%.1f', round(a, 1)) as p1, printf('%.2f', round(a, 2)) as p2, format('{:,.1f}', round(a, 1)::double) as w1, regexp_replace(abs(x)::varchar, '\.0$', '') as g from c)
select c_custkey, case k when 0 then s || w when 1 then s || 'USD ' || w2 when 2 then s1 || '€ ' || p1 when 3 then case when x < 0 then '(' || w2 || ')' else w2 end when 4 then case when x < 0 then p || ' low' else p1 || 'k+' end
  when 5 then case when x < 0 then '(' || floor(a * 100 + 0.5)::bigint || '%)' else floor(a * 100 + 0.5)::bigint || '%' end when 6 then s0 || 'a;b ' || p when 7 then s || g when 8 then s0 || lpad(p, greatest(5, len(p))::int, '0')
  when 9 then case when x < 0 then '' else w || ' pcs' end when 10 then s0 || p when 11 then s1 || '~' || p1 when 12 then s1 || w1 when 13 then s || p2 else s || g end as shown from d
""")
def fmt_bracket_codes(spark, sf_dir):
    """A column of codes with brackets, each compiled once and joined to its cells."""
    code = F.element_at(F.array(*map(F.lit, _NUMBER_CODES)), (F.col("c_custkey") % len(_NUMBER_CODES) + 1).cast("int"))
    cells = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", code.alias("code"), F.lit(None).cast("string").alias("txt"))
    return formats.formatted(cells, "code", "c_acctbal", "txt").select("c_custkey", "shown")


#: Elapsed hours, minutes and seconds; minutes or months; halves of a day; bracketed colours and locales before dates.
_TIME_CODES = ["[h]:mm", "[mm]:ss", "[s]", "[hh]:mm:ss", '[Red]d" d" h:mm', "mm:ss", "[$-409]d-mmm-yyyy;@", "hh:mm:ss AM/PM", "m/d h:m", "[h]", "dddd, mmmm d", "yy.mm.dd"]


@_r.query(r"""
with o as (select o_orderkey, o_orderkey % 12 as k, o_orderkey % 5000 * 86400 + o_orderkey * 977 % 86400 as total from orders),
p as (select *, total // 86400 as days, total % 86400 as sec, date '1899-12-30' + (total // 86400)::int as day from o),
q as (select *, lpad((sec // 60 % 60)::varchar, 2, '0') as mm, lpad((sec % 60)::varchar, 2, '0') as ss, sec // 3600 as h, lpad((total // 3600)::varchar, greatest(2, len((total // 3600)::varchar))::int, '0') as hh from p)
select o_orderkey, case k when 0 then total // 3600 || ':' || mm when 1 then lpad((total // 60)::varchar, greatest(2, len((total // 60)::varchar))::int, '0') || ':' || ss when 2 then total::varchar when 3 then hh || ':' || mm || ':' || ss
  when 4 then day(day) || ' d ' || h || ':' || mm when 5 then mm || ':' || ss when 6 then strftime(day, '%-d-%b-%Y') when 7 then lpad((case when h % 12 = 0 then 12 else h % 12 end)::varchar, 2, '0') || ':' || mm || ':' || ss || case when h < 12 then ' AM' else ' PM' end
  when 8 then month(day) || '/' || day(day) || ' ' || h || ':' || sec // 60 % 60 when 9 then (total // 3600)::varchar when 10 then strftime(day, '%A, %B %-d') else strftime(day, '%y.%m.%d') end as shown from q
""")
def fmt_elapsed_codes(spark, sf_dir):
    """A column of time codes."""
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, _TIME_CODES)), (k % len(_TIME_CODES) + 1).cast("int"))
    cells = table(spark, sf_dir, "orders").select("o_orderkey", (k % 5000 + (k * 977 % 86400) / 86400).alias("serial"), code.alias("code"), F.lit(None).cast("string").alias("txt"))
    return formats.formatted(cells, "code", "serial", "txt").select("o_orderkey", "shown")


@_r.query(r"""
with c as (select c_custkey, c_acctbal as x, abs(c_acctbal) as a from customer)
select c_custkey, case when x < 0 then 'lost ' || printf('%.1f', round(a::decimal(38,12), 1)) when x > 0 then '$' || format('{:,.2f}', round(a::decimal(38,12), 2)::double) else '$0.00' end as money,
  case when x < 0 then '-' else '' end || printf('%.1f', round(a::decimal(38,12) * 100, 1)) || '%' as percent, case when x = floor(x) then x::bigint::varchar else regexp_replace(printf('%.6f', x), '\.?0+$', '') end as plain from c
""")
def chart_value_format(spark, sf_dir):
    """Values on a chart: a negative section, a leading minus, no code."""
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", formats.chart_value(x, '$#,##0.00;[Red]"lost "0.0').alias("money"), formats.chart_value(x, "0.0%").alias("percent"), formats.chart_value(x, None).alias("plain"))


@_r.query("""
with o as (select o_orderkey, o_orderdate::timestamp + (o_orderkey % 24)::int * interval 1 hour + interval 30 minute as t from orders)
select o_orderkey, strftime(t, '%Y-%m-%d') as iso, month(t) || '/' || day(t) as short, strftime(t, '%H:%M') as hours from o
""")
def chart_date_format(spark, sf_dir):
    """Dates on a chart's axis: numbers alone, minutes after hours."""
    n = dates.serial(F.col("o_orderdate")) + (F.col("o_orderkey") % 24) / 24 + F.lit(1800.5) / 86400
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.chart_value(n, "yyyy-mm-dd").alias("iso"), formats.chart_date(n, "[$-409]m/d").alias("short"), formats.chart_date(n, "hh:mm").alias("hours"))


@_r.query("""
with p as (select n_regionkey as chart, n_name, sum(c_acctbal) as v from customer join nation on c_nationkey = n_nationkey group by all),
s as (select *, abs(v) / sum(abs(v)) over (partition by chart) as share from p)
select chart, n_name, round(sum(share) over w * 2 * pi() - pi() / 2, 6) as stop, round((sum(share) over w - share) * 2 * pi() - pi() / 2, 6) as start from s window w as (partition by chart order by n_name)
""")
def chart_pie_angles(spark, sf_dir):
    points = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("chart"), "n_name").agg(F.sum("c_acctbal").alias("v"))
    return charts.pie_angles(points, ["chart"], ["n_name"], F.col("v")).select("chart", "n_name", F.round("stop", 6).alias("stop"), F.round("start", 6).alias("start"))


_PLOTS = """select p_partkey % 50 as chart, p_partkey as ord, case p_size % 3 when 0 then 'lineChart' when 1 then 'barChart' else 'areaChart' end as kind, case when p_size % 2 = 0 then 'stacked' end as grouping from part"""


@_r.query(f"""with p as ({_PLOTS})
select chart, arg_min(kind, ord) as kind, coalesce(arg_min(coalesce(grouping, 'clustered'), ord) filter (where kind <> 'lineChart'), 'clustered') as grouping, bool_or(kind = 'lineChart') and bool_or(kind <> 'lineChart') as mixed from p group by chart""")
def chart_combined(spark, sf_dir):
    """Kind and grouping of charts that mix lines with bars or areas."""
    size = F.col("p_size")
    plots = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("chart"), F.col("p_partkey").alias("ord"), F.when(size % 3 == 0, "lineChart").when(size % 3 == 1, "barChart").otherwise("areaChart").alias("kind"), F.when(size % 2 == 0, "stacked").alias("grouping"))
    return charts.combined(plots, ["chart"], "ord")


@_r.query("select p_partkey, p_retailprice - p_size as low, p_retailprice + case when p_size % 2 = 0 then p_size * 2 else 0 end as high from part")
def chart_custom_errors(spark, sf_dir):
    size = F.col("p_size")
    return charts.custom_errors(table(spark, sf_dir, "part"), F.col("p_retailprice"), F.when(size % 2 == 0, size * 2), size).select("p_partkey", "low", "high")


@_r.query("""
with p as (select user_id, event_type, hour(ts)::int as h, sum(value) as v from events group by all)
select user_id, event_type, h, case when user_id % 3 = 0 then 0.0 when user_id % 3 = 1 then min(v) over (partition by user_id) else min(v) over (partition by user_id, event_type) end as axis_low, case when user_id % 3 = 1 then max(v) over (partition by user_id) else max(v) over (partition by user_id, event_type) end as axis_high from p
""")
def sparkline_group_axis(spark, sf_dir):
    """Axes of a line's own extent, its group's (a user's lines), or with a given low end."""
    points = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.hour("ts").alias("h")).agg(F.sum("value").alias("v"))
    kind = lambda low: F.when(F.col("user_id") % 3 == 0, "custom" if low else "individual").when(F.col("user_id") % 3 == 1, "group").otherwise("individual")
    return charts.sparkline_axis(points, ["user_id", "event_type"], ["user_id"], "v", F.lit(0.0), F.lit(None).cast("double"), (kind(True), kind(False))).select("user_id", "event_type", "h", "axis_low", "axis_high")


_ACCENTS = ["#4472C4", "#ED7D31", "#A5A5A5", "#FFC000", "#5B9BD5", "#70AD47"]


@_r.query(f"""
with a as (select p_partkey, ({_ACCENTS!r})[p_size % 6 + 1] as color from part)
select p_partkey, color, '#' || lpad(printf('%X', floor(('0x' || color[2:3])::int * 0.2 + 255 * 0.8 + 0.5)::bigint), 2, '0') || lpad(printf('%X', floor(('0x' || color[4:5])::int * 0.2 + 255 * 0.8 + 0.5)::bigint), 2, '0') || lpad(printf('%X', floor(('0x' || color[6:7])::int * 0.2 + 255 * 0.8 + 0.5)::bigint), 2, '0') as stripe from a
""")
def color_series_stripe(spark, sf_dir):
    """Colours of series without one, and of a table's stripes."""
    color = colors.series_color(F.array(*map(F.lit, _ACCENTS)), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", color.alias("color")).withColumn("stripe", colors.stripe(F.col("color")))


@_r.query("""
with t as (select p_brand, p_partkey, p_size % 4 as col, (row_number() over (partition by p_brand order by p_partkey) - 1)::int as "row", count(*) over (partition by p_brand)::int as n from part)
select p_brand, p_partkey, case when "row" = 0 then 'firstRow' when "row" = n - 1 then 'lastRow' end as ends, case when col = 0 then 'firstCol' end as sides, case when "row" in (0, n - 1) then null when "row" % 2 = 1 then 'band1H' else 'band2H' end as band,
  case when p_partkey % 10 = 0 then 'own' when col = 0 then 'side' when "row" in (0, n - 1) then 'end' when "row" % 2 = 1 then 'band' else 'whole' end as fill from t
""")
def deck_table_parts(spark, sf_dir):
    """Parts of a table style that a cell is in, and the fill that wins."""
    t = grid.numbered(table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 4).alias("col")), ["p_partkey"], ["p_brand"])
    t = t.join(t.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand")
    found = styles.table_parts(F.col("row") - 1, F.col("col"), F.col("n"), F.lit(4), {"firstRow": True, "lastRow": True, "firstCol": True, "bandRow": True})
    fill = styles.table_cell(F.when(F.col("p_partkey") % 10 == 0, "own"), F.lit("whole"), F.when(found["band"] == "band1H", "band"), F.when(found["ends"].isNotNull(), "end"), F.when(found["sides"].isNotNull(), "side"))
    return t.select("p_brand", "p_partkey", *[c.alias(n) for n, c in found.items()], fill.alias("fill"))


@_r.query("""
with c as (select o_custkey as tbl, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 3 as trow, (row_number() over (partition by o_custkey order by o_orderkey) - 1) % 3 as tcol, o_orderkey % 90 + 40 as w, o_orderkey % 17 as h, case when o_orderkey % 11 = 0 then 30 end as fixed from orders),
k as (select tbl, least(sum(w), 200.0) as width from (select tbl, tcol, max(w) as w from c group by all) group by tbl), r as (select tbl, sum(h) as height from (select tbl, trow, coalesce(max(fixed), greatest(10.0, max(h))) as h from c group by all) group by tbl)
select k.tbl, k.width::double as width, r.height::double as height from k join r on r.tbl = k.tbl
""")
def doc_table_extent(spark, sf_dir):
    """Width and height of tables, a table for each customer's orders."""
    k = F.col("o_orderkey")
    t = grid.numbered(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tbl"), "o_orderkey"), ["o_orderkey"], ["tbl"]).withColumn("trow", F.floor((F.col("row") - 1) / 3)).withColumn("tcol", (F.col("row") - 1) % 3)
    found = documents.table_extent(t, ["tbl"], "trow", k % 90 + 40, (k % 17).cast("double"), F.when(k % 11 == 0, F.lit(30.0)), 200)
    return found.select("tbl", F.col("width").cast("double").alias("width"), "height")


@_r.query("""
with p as (select o_custkey, o_orderkey, o_orderpriority as style, (o_orderkey % 20)::int as b, (o_orderkey % 13)::int as a, o_orderkey % 3 = 0 as ctx from orders),
l as (select *, lag(style) over w as ps, lag(a) over w as pa, lag(ctx) over w as pc from p window w as (partition by o_custkey order by o_orderkey))
select o_custkey, o_orderkey, greatest(case when ps = style and pc then 0 else coalesce(pa, 0) end, case when ps = style and ctx then 0 else b end)::int as gap from l
""")
def doc_contextual_gaps(spark, sf_dir):
    """Space between paragraphs; none between contextual ones of a style."""
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    found = documents.margin_gaps(items, ["o_custkey"], "o_orderkey", (k % 20).cast("int"), (k % 13).cast("int"), F.col("o_orderpriority"), k % 3 == 0)
    return found.select("o_custkey", "o_orderkey", F.col("gap").cast("int").alias("gap"))


@_r.query("""
with x as (select n_regionkey as sheet, (n_nationkey // 5 + 1)::int as "row", n_nationkey from nation),
m as (select * from (values ('cells', 2, 1, 3, 2), ('rows', 2, 1, 3, 3), ('cols', 1, 1, 5, 2), ('all', 1, 1, 5, 3)) v(mode, "top", "left", bottom, "right"))
select mode, sheet, string_agg(case "right" - "left" + 1 when 2 then n_nationkey || chr(9) else n_nationkey || chr(9) || chr(9) || n_nationkey * 2 end, chr(10) order by "row") as tsv from x, m where "row" between "top" and bottom group by all
""")
def grid_selections(spark, sf_dir):
    """B3 to A2 copied as cells, rows, columns, all; column 2 is empty, column 3 is twice the first."""
    n = F.col("n_nationkey")
    cells = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("sheet"), F.floor(n / 5 + 1).cast("int").alias("row"), F.inline(F.array(F.struct(F.lit(1).alias("col"), n.cast("string").alias("text")), F.struct(F.lit(3).alias("col"), (n * 2).cast("string").alias("text")))))
    out = None
    for mode in ("cells", "rows", "cols", "all"):
        part = grid.tsv(cells, *grid.selection(mode, (3, 2), (2, 1), (5, 3)), ["sheet"]).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@_r.query("select p_partkey, case when p_size >= 40 then '3Flags:2' when p_size >= 20 then null else '3Signs:0' end as custom, '3Arrows:' || case when p_size >= 40 then 0 when p_size >= 20 then 1 else 2 end as plain from part")
def cf_custom_icons(spark, sf_dir):
    """Icons of other sets by threshold, one of them none; and a reversed set."""
    stops = [F.lit(0), F.lit(20), F.lit(40)]
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", rules.icon(size, stops, [("3Signs", 0), ("NoIcons", 0), ("3Flags", 2)], "3Arrows").alias("custom"), rules.icon(size, stops, None, "3Arrows", reverse=True).alias("plain"))


@_r.query("""
with r as (select n_regionkey as sheet, n_nationkey as priority, case when n_nationkey % 3 = 0 then 'g' || n_nationkey end as ext_id from nation), e as (select n_regionkey as sheet, 'g' || n_nationkey as id, n_nationkey % 2 = 0 as gradient from nation where n_nationkey % 2 = 0)
select r.sheet, r.priority, ext_id, gradient, 'plain' as source from r left join e on e.sheet = r.sheet and e.id = ext_id union all select sheet, null, null, gradient, 'extension' from e where not exists (select 1 from r where r.sheet = e.sheet and r.ext_id = e.id)
""")
def cf_extensions(spark, sf_dir):
    """Rules with what their extensions say, and rules that are extensions alone."""
    n = F.col("n_nationkey")
    name = F.concat(F.lit("g"), n.cast("string"))
    nations = table(spark, sf_dir, "nation")
    plain = nations.select(F.col("n_regionkey").alias("sheet"), n.alias("priority"), F.when(n % 3 == 0, name).alias("ext_id"))
    extra = nations.where(n % 2 == 0).select(F.col("n_regionkey").alias("sheet"), name.alias("id"), (n % 2 == 0).alias("gradient"))
    return rules.with_extensions(plain, extra, ["sheet"])


@_r.query("select p_partkey, lower(p_type) between 'e' and 'm' as inside, not lower(p_type) between 'e' and 'm' as outside, p_name[:12] as label, p_name[:10] as dense from part")
def cf_text_between(spark, sf_dir):
    """Texts between two others, whatever their case; labels of a chart's axis."""
    t = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text_rule(t, "between", "E", "M").alias("inside"), text_rule(t, "notBetween", "E", "M").alias("outside"), labels.truncated(F.col("p_name")).alias("label"), labels.truncated(F.col("p_name"), True).alias("dense"))


@_r.query("""
select c_custkey, not coalesce(c_acctbal > 0, false) as negated, c_mktsegment = 'MACHINERY' as exact_, -c_acctbal as minus, case when c_custkey % 7 = 0 then 0 else c_acctbal / (c_custkey % 7) end as quotient, c_custkey % 100 + 1 as row_, (c_custkey % 30 + 1)::int as col_ from customer
""")
def fx_operators(spark, sf_dir):
    """NOT, EXACT, unary minus, division by zero, ROW and COLUMN of a cell's reference."""
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    ref = a1.a1(k % 100 + 1, (k % 30 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (~Value.of(flag=x > 0).truth()).alias("negated"), (F.col("c_mktsegment") == "MACHINERY").alias("exact_"), F.negative(x).alias("minus"), numbers.divide(x, (k % 7).cast("double")).alias("quotient"),
        a1.row_number(ref).cast("long").alias("row_"), a1.column_number(ref).alias("col_"),
    )


@_r.query(r"""
select p_partkey, floor(p_retailprice + 0.5)::bigint as px, p_size / 20.0 as twips, p_size / 2.0 as half_points, p_size * 100 / 12700.0 as emu, case p_size % 4 when 0 then 'image/png' when 1 then 'image/jpeg' else 'application/octet-stream' end as media,
  case p_size % 3 when 0 then 'justify' when 1 then 'center' else 'left' end as align, 'PAGE' as field, case p_size % 3 when 0 then null when 1 then false else true end as flag, case when p_size % 2 = 0 then 'It''s ' || p_size end as sheet from part
""")
def fx_units(spark, sf_dir):
    """Pixels, points, media types, alignments, fields, toggles, sheets of references."""
    n = F.col("p_size")
    reference = F.when(n % 2 == 0, F.concat(F.lit("'It''s "), n.cast("string"), F.lit("'!$A$1:B2"))).otherwise("A1")
    return table(spark, sf_dir, "part").select(
        "p_partkey", a1.row_pixels(F.col("p_retailprice")).cast("long").alias("px"), a1.twips_to_points(n).alias("twips"), a1.half_points_to_points(n).alias("half_points"), a1.emu_to_points(n * 100).alias("emu"),
        labels.media_type(F.when(n % 4 == 0, "a/b.PNG").when(n % 4 == 1, "x.jpeg").otherwise("x")).alias("media"), labels.alignment(F.when(n % 3 == 0, "both").when(n % 3 == 1, "center").otherwise("odd")).alias("align"),
        labels.field_kind(F.lit("  page \\* MERGE")).alias("field"), labels.toggle(n % 3 > 0, F.when(n % 3 == 1, "off")).alias("flag"), a1.sheet_of(reference).alias("sheet"),
    )


@_r.query("""
with r as (select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1) % 6 as k, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 6 as f from orders)
select o_custkey, o_orderkey, (f + (k > 0)::int)::bigint as field, case k when 1 then 'code' when 3 then 'result' else 'body' end as part from r where k in (1, 3, 5)
""")
def doc_fields(spark, sf_dir):
    """Complex fields: begin, code, separate, result, end, and a text after each."""
    t = grid.numbered(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], ["o_custkey"]).withColumn("k", (F.col("row") - 1) % 6)
    kind = F.when(F.col("k") == 0, "begin").when(F.col("k") == 2, "separate").when(F.col("k") == 4, "end").otherwise("text")
    return documents.field_results(t.withColumn("kind", kind), ["o_custkey"], "row", "kind", "o_orderkey").select("o_custkey", "o_orderkey", F.col("field").cast("long").alias("field"), "part")


@_r.query("""
with p as (select p_brand as part, p_size % 3 as series, p_size as idx, case when p_size % 3 = 0 and p_size % 2 = 0 then 'c' || p_size when p_size % 5 = 0 then 'own' end as category from part group by all),
f as (select part, idx, max(category) as first_ from p where series = 0 group by all)
select p.part, p.series, p.idx, coalesce(p.category, f.first_, (p.idx + 1)::varchar) as category from p left join f on f.part = p.part and f.idx = p.idx
""")
def chart_categories(spark, sf_dir):
    """Categories of a series, else of the chart's first, else 1, 2, ..."""
    n = F.col("p_size")
    points = table(spark, sf_dir, "part").select(F.lit("f").alias("file_path"), F.col("p_brand").alias("part"), (n % 3).alias("series"), n.alias("idx"), F.when((n % 3 == 0) & (n % 2 == 0), F.concat(F.lit("c"), n.cast("string"))).when(n % 5 == 0, "own").alias("category")).distinct()
    return with_categories(points).select("part", "series", "idx", "category")


@_r.query("select p_partkey, ([1, 0, 3, 2, 4, 5, 6, 7, 8, 9])[p_size % 10 + 1]::varchar as color from part")
def lookup_theme_colors(spark, sf_dir):
    """Theme indices of spreadsheets: the first four slots are swapped in pairs."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", packages.theme_color(slots, F.col("p_size") % 10).alias("color"))


@_r.query("select c_custkey, c_nationkey as book, case c_custkey % 5 when 1 then 'bold' when 2 then null else 'plain' || c_nationkey end as font from customer")
def lookup_style_zero(spark, sf_dir):
    """A style that its book doesn't have is style 0; one without a font has none."""
    cells = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("book"), (F.col("c_custkey") % 5).cast("int").alias("style_index"))
    books = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("book"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("style_index"))
    formats_ = books.withColumn("font", F.when(F.col("style_index") == 0, F.concat(F.lit("plain"), F.col("book").cast("string"))).when(F.col("style_index") == 1, "bold"))
    return styles.with_format(cells, formats_, ["book"], ["font"]).select("c_custkey", "book", "font")
