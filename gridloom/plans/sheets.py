"""Grid, lookup and formula queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import a1, colors, dates, formats, numbers, text
from ..functions.criteria import all_of, any_of, matches
from ..operators import grid, styles
from .registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.query("""
with g as (select row_number() over (order by n_nationkey) as "row", * from nation),
c as (select "row", 1 as col, null::varchar as v_text, n_nationkey::double as v_num from g union all select "row", 2, n_name, null from g union all select "row", 3, null, n_regionkey::double from g)
select "row", col, v_text, v_num, chr(64 + col::int) || "row" as ref from c where "row" between 3 and 9 and col between 2 and 3
""")
def grid_range(spark, sf_dir):
    """Range C9:B3 of a sheet made from a table; corners in any order."""
    cells = grid.as_cells(grid.first_rows(table(spark, sf_dir, "nation"), ["n_nationkey"], 9), ["row"], ["n_nationkey", "n_name", "n_regionkey"])
    return grid.cell_range(cells, (9, 3), (3, 2)).select("row", "col", "v_text", "v_num", "ref")


@_r.query("""
select 'region' as sheet, count(*) as max_row, 2 as max_col, 'B' as max_col_letter from region
union all select 'nation', count(*), 3, 'C' from nation union all select 'supplier', count(*), 4, 'D' from supplier union all select 'customer', count(*), 5, 'E' from customer
""")
def grid_dimensions(spark, sf_dir):
    out = None
    for name, n in (("region", 2), ("nation", 3), ("supplier", 4), ("customer", 5)):
        t = table(spark, sf_dir, name)
        part = t.agg(F.count("*").alias("max_row"), F.lit(n).alias("max_col")).select(F.lit(name).alias("sheet"), "max_row", "max_col", a1.column_letters(F.col("max_col")).alias("max_col_letter"))
        out = part if out is None else out.unionByName(part)
    return out


@_r.query("""
with c as (select 'part' as sheet, p_partkey as id, unnest([p_name, p_brand, p_type]) as value, unnest([1, 2, 3]) as col from part
  union all select 'customer', c_custkey, unnest([c_name, c_mktsegment]), unnest([1, 2]) from customer)
select sheet, id, col, value, count(*) over (partition by sheet) as match_count from c where contains(lower(value), 'build') or contains(lower(value), '12')
""")
def grid_search(spark, sf_dir):
    """Case-insensitive search over two sheets, with the number of matches of each."""
    parts = table(spark, sf_dir, "part").select(F.lit("part").alias("sheet"), F.col("p_partkey").alias("id"), F.posexplode(F.array("p_name", "p_brand", "p_type")).alias("col", "value"))
    customers = table(spark, sf_dir, "customer").select(F.lit("customer").alias("sheet"), F.col("c_custkey").alias("id"), F.posexplode(F.array("c_name", "c_mktsegment")).alias("col", "value"))
    hits = parts.union(customers).where(grid.contains(F.col("value"), "BUILD") | grid.contains(F.col("value"), "12")).withColumn("col", F.col("col") + 1)
    counts = hits.groupBy("sheet").agg(F.count("*").alias("match_count"))
    return hits.join(counts, "sheet").select("sheet", "id", "col", "value", "match_count")


@_r.query("""select 'region' as sheet, string_agg(r_regionkey || chr(9) || r_name || chr(9), chr(10) order by r_regionkey) as tsv from region""")
def grid_tsv(spark, sf_dir):
    """A1:C5 as copied text; the third column is empty."""
    t = grid.first_rows(table(spark, sf_dir, "region"), ["r_regionkey"], 5)
    cells = t.select(F.lit("region").alias("sheet"), "row", F.posexplode(F.array(F.col("r_regionkey").cast("string"), "r_name")).alias("c", "text")).select("sheet", "row", (F.col("c") + 1).alias("col"), "text")
    return grid.tsv(cells, 1, 1, 5, 3, ["sheet"])


@_r.query("""
with c as (select o_custkey % 7 as sheet, row_number() over (partition by o_custkey % 7 order by o_orderkey) as "row", unnest([1, 2, 3]) as col, o_orderkey from orders),
m as (select * from (values (0, 2, 1, 3, 3), (1, 7, 2, 7, 3), (1, 10, 1, 14, 1), (3, 1, 2, 1048576, 2), (5, 200, 1, 700, 3)) v(sheet, "top", "left", bottom, "right"))
select c.sheet::int as sheet, c."row"::int as "row", c.col, o_orderkey, case when m."top" is null then 'plain' when c."row" = m."top" and c.col = m."left" then 'anchor' else 'covered' end as cover
from c left join m on m.sheet = c.sheet and c."row" between m."top" and m.bottom and c.col between m."left" and m."right"
""")
def grid_merge_cover(spark, sf_dir):
    """Cells of seven sheets under merged rectangles of some of them, a whole column among these."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).cast("int").alias("sheet"), "o_orderkey")
    cells = grid.numbered(orders, ["o_orderkey"], ["sheet"]).select("sheet", "row", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("col"), "o_orderkey")
    merges = spark.createDataFrame([(0, 2, 1, 3, 3), (1, 7, 2, 7, 3), (1, 10, 1, 14, 1), (3, 1, 2, 1048576, 2), (5, 200, 1, 700, 3)], "sheet int, top int, left int, bottom int, right int")
    return grid.merge_cover(cells, merges, ["sheet"]).select("sheet", "row", "col", "o_orderkey", "cover")


@_r.query("""
select p_brand, p_partkey, trunc(((256 * p_size + 128.0 / 8) / 256) * 8)::bigint as px,
  coalesce(sum(trunc(((256 * p_size + 128.0 / 8) / 256) * 8)::bigint) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as offset_px from part
""")
def grid_offsets(spark, sf_dir):
    """Where columns start, their widths being part sizes; a sheet for each brand."""
    sized = table(spark, sf_dir, "part").select("p_brand", "p_partkey", a1.column_pixels(F.col("p_size")).cast("long").alias("px"))
    return grid.offsets(sized, ["p_partkey"], F.col("px"), ["p_brand"]).withColumnRenamed("offset", "offset_px")


@_r.query("""
with o as (select p_brand, p_partkey, p_size, coalesce(sum(p_size) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0) as start from part)
select p_brand, p_partkey, x from o, (values (0), (40), (333), (777)) v(x) where x >= start and x < start + p_size
""")
def grid_hit_test(spark, sf_dir):
    """The column of each brand's sheet under four positions."""
    placed = grid.offsets(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_partkey"], F.col("p_size"), ["p_brand"])
    points = placed.select("p_brand").distinct().withColumn("x", F.explode(F.array(*map(F.lit, (0, 40, 333, 777))).cast("array<long>")))
    return grid.hit_test(placed, "p_size", points, ["p_brand"]).select("p_brand", "p_partkey", F.col("x").cast("int").alias("x"))


@_r.query("""
with w as (select *, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as new from events)
select event_id, user_id, event_type, sum(new) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)::bigint as island from w
""")
def grid_islands(spark, sf_dir):
    found = grid.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return found.select("event_id", "user_id", "event_type", "island")


@_r.query("""
with g as (select *, row_number() over (partition by s_nationkey order by s_suppkey) as "row", count(*) over (partition by s_nationkey) as n from supplier)
select s_suppkey, case when "row" = 1 then 'header' when "row" > n - 1 then 'totals' when ("row" - 2) % 2 = 1 then 'band2' else 'band1' end as band from g
""")
def table_banding(spark, sf_dir):
    w = Window.partitionBy("s_nationkey")
    rows = table(spark, sf_dir, "supplier").withColumn("row", F.row_number().over(w.orderBy("s_suppkey"))).withColumn("n", F.count("*").over(w))
    data = F.col("row") - 2
    band = F.when(F.col("row") == 1, "header").when(F.col("row") > F.col("n") - 1, "totals").when(data % 2 == 1, "band2").otherwise("band1")
    return rows.select("s_suppkey", band.alias("band"))


@_r.query("""
select l_returnflag, count(*) filter (where l_quantity > 25) as over_25, count(*) filter (where l_linestatus <> 'O') as not_open, round(coalesce(sum(l_extendedprice) filter (where l_quantity > 25), 0), 2) as sum_over_25,
  round(sum(l_extendedprice) filter (where l_linestatus = 'F') / nullif(count(*) filter (where l_linestatus = 'F'), 0), 2) as avg_f from lineitem group by l_returnflag
""")
def fx_countif_sumif_averageif(spark, sf_dir):
    over, other, closed = matches(F.col("l_quantity"), ">25", True), matches(F.col("l_linestatus"), "<>O", False), matches(F.col("l_linestatus"), "F", False)
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(over).alias("over_25"), F.count_if(other).alias("not_open"),
        F.round(F.coalesce(F.sum(F.when(over, x)), F.lit(0.0)), 2).alias("sum_over_25"),
        F.round(F.try_divide(F.sum(F.when(closed, x)), F.nullif(F.count_if(closed), F.lit(0))), 2).alias("avg_f"),
    )


@_r.query("""
select event_type, count(value) as n_count, count(*) filter (where props <> '') as n_counta, count(*) filter (where props is null or props = '') as n_blank, coalesce(max(value), 0) as n_max, coalesce(min(value), 0) as n_min from events group by event_type
""")
def fx_count_family(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("value").alias("n_count"), F.count_if(F.col("props") != "").alias("n_counta"), F.count_if(text.is_blank(F.col("props"))).alias("n_blank"),
        F.coalesce(F.max("value"), F.lit(0.0)).alias("n_max"), F.coalesce(F.min("value"), F.lit(0.0)).alias("n_min"),
    )


@_r.query("""
select c_custkey, floor(c_acctbal + 0.5)::bigint as r0, case when c_acctbal >= 0 then floor(c_acctbal) else ceil(c_acctbal) end::bigint as down, case when c_acctbal >= 0 then ceil(c_acctbal) else floor(c_acctbal) end::bigint as up,
  floor(c_acctbal)::bigint as int_, round(ceil(c_acctbal / 50.0) * 50, 4) + 0.0 as ceiling50, round(c_acctbal - floor(c_acctbal / 7.0) * 7, 4) as mod7, round(c_acctbal - floor(c_acctbal / -7.0) * -7, 4) as mod_7,
  case when c_acctbal >= 0 then round(sqrt(c_acctbal), 4) end as root, case when c_acctbal > 0 then round(ln(c_acctbal), 4) end as log_, sign(c_acctbal)::int as sign_ from customer
""")
def fx_math(spark, sf_dir):
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", numbers.round_half_up(x).cast("long").alias("r0"), numbers.round_down(x).cast("long").alias("down"), numbers.round_up(x).cast("long").alias("up"), F.floor(x).alias("int_"),
        (F.round(numbers.ceiling(x, F.lit(50.0)), 4) + 0.0).alias("ceiling50"), F.round(numbers.modulo(x, F.lit(7.0)), 4).alias("mod7"), F.round(numbers.modulo(x, F.lit(-7.0)), 4).alias("mod_7"),
        F.round(numbers.square_root(x), 4).alias("root"), F.round(numbers.natural_log(x), 4).alias("log_"), F.signum(x).cast("int").alias("sign_"),
    )


@_r.query(r"""
select p_partkey, length(p_name)::int as n, left(p_name, 4) as l4, right(p_name, 3) as r3, substr(p_type, 3, 5) as m, upper(p_brand) as u, nullif(instr(p_type, 'E'), 0)::int as found, nullif(instr(lower(p_type), 'e'), 0)::int as searched,
  trim(regexp_replace('  ' || p_name || '   ' || p_type, '\s+', ' ', 'g')) as trimmed, p_brand || '/' || p_size as joined from part
""")
def fx_text(spark, sf_dir):
    name, kind = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.char_length(name).alias("n"), text.left(name, 4).alias("l4"), text.right(name, 3).alias("r3"), text.mid(kind, 3, 5).alias("m"), F.upper("p_brand").alias("u"),
        text.find("E", kind).alias("found"), text.search("E", kind).alias("searched"), text.trim(F.concat(F.lit("  "), name, F.lit("   "), kind)).alias("trimmed"),
        text.concatenate(F.col("p_brand"), F.lit("/"), F.col("p_size")).alias("joined"),
    )


@_r.query("""
select o_orderkey, date_diff('day', date '1899-12-30', o_orderdate::date)::int as serial, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as d,
  (dayofweek(o_orderdate) + 1)::int as w1, isodow(o_orderdate)::int as w2, (isodow(o_orderdate) - 1)::int as w3,
  date_diff('day', date '1899-12-30', (make_date(year(o_orderdate), 1, 1) + to_months((month(o_orderdate) + 9)::int))::date + (day(o_orderdate) - 1)::int)::int as rolled from orders
""")
def fx_date(spark, sf_dir):
    d = F.col("o_orderdate")
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", dates.serial(d).alias("serial"))
    n, day = F.col("serial"), dates.from_serial(F.col("serial"))
    return t.select(
        "o_orderkey", "serial", F.year(day).alias("y"), F.month(day).alias("m"), F.day(day).alias("d"), dates.weekday(n, 1).alias("w1"), dates.weekday(n, 2).alias("w2"), dates.weekday(n, 3).alias("w3"),
        dates.date(F.year(day), F.month(day) + 10, F.day(day)).alias("rolled"),
    )


@_r.query("""
select o_orderkey, o_totalprice > 100000 and o_orderstatus = 'O' as both_, o_totalprice > 300000 or o_orderstatus = 'P' as any_, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' end as ifs, coalesce(case when o_orderstatus = 'P' then null else o_totalprice end, 0) as iferror from orders
""")
def fx_logic(spark, sf_dir):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", all_of(price > 100000, status == "O").alias("both_"), any_of(price > 300000, status == "P").alias("any_"),
        F.when(price > 200000, "high").when(price > 100000, "mid").alias("ifs"), text.if_error(F.when(status != "P", price), F.lit(0.0)).alias("iferror"),
    )


@_r.query("select o_orderkey, coalesce(c_name, '') as name, coalesce(c_mktsegment, 'none') as segment from orders left join customer on o_custkey % 2000 = c_custkey")
def lookup_shared_string(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 2000).alias("idx"))
    strings = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return styles.lookup(orders, strings, "idx", "c_custkey", {"name": F.lit(""), "segment": F.lit("none")}).select("o_orderkey", "name", "segment")


@_r.query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case l_returnflag when 'R' then 'bold' when 'A' then 'italic' else 'plain' end as font, coalesce(case l_returnflag when 'R' then 10 end, 0) as num_fmt from lineitem
""")
def lookup_style_default(spark, sf_dir):
    """Styles that are missing fall back to the defaults."""
    xfs = F.broadcast(spark.createDataFrame([("R", "bold", 10), ("A", "italic", None)], "flag string, font string, num_fmt int"))
    found = styles.lookup(table(spark, sf_dir, "lineitem"), xfs, "l_returnflag", "flag", {"font": F.lit("plain"), "num_fmt": F.lit(0)})
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "font", "num_fmt")


@_r.query("""
with items as (select p_brand, row_number() over (order by p_brand) - 1 as pos from (select distinct p_brand from part))
select pos::int as pos, p_brand as name, pos % 3 <> 1 as selected from items where pos < 8
""")
def lookup_slicer_items(spark, sf_dir):
    """Items of a slicer's cache name their field's values by position."""
    field = table(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_brand")).alias("values"))  # brands are a fixed short list
    values = field.select(F.posexplode("values").alias("pos", "name"))
    cache = spark.createDataFrame([(i, i % 3 != 1) for i in range(8)], "pos int, selected boolean")
    return cache.join(values, "pos").select("pos", "name", "selected")


@_r.query("""
with g as (select row_number() over (order by s_suppkey) as r, * from supplier)
select unnest([1, 2, 3, 4, 5, 6]) as pos, unnest(v) as value from (select [max(s_acctbal) filter (where r = 2), null, max(s_acctbal) filter (where r = 3), null, max(s_acctbal) filter (where r = 4), null] as v from g)
""")
def range_values_row_major(spark, sf_dir):
    """Values of a 3 by 2 range in row-major order; texts are null."""
    cells = grid.as_cells(grid.first_rows(table(spark, sf_dir, "supplier"), ["s_suppkey"], 4).where("row between 2 and 4"), ["row"], ["s_acctbal", "s_name"])
    every = spark.range(6).select((F.col("id").cast("int") + 1).alias("pos"), (F.floor(F.col("id") / 2) + 2).alias("row"), (F.col("id") % 2 + 1).alias("col"))
    return every.join(cells, ["row", "col"], "left").select("pos", F.col("v_num").alias("value"))


@_r.query("""
select p_partkey, case when p_retailprice < 930 then '#FF0000' when p_type like '%A%' and p_size > 25 then '#00FF00' when p_size % 2 = 1 then '#EEEEEE' end as fill, case when p_retailprice < 930 then 'rule' when p_type like '%A%' and p_size > 25 then 'own' when p_size % 2 = 1 then 'band' end as layer from part
""")
def cell_effective_style(spark, sf_dir):
    """Fill of the first layer that has one: rule, own style, table band."""
    layers = [("rule", F.when(F.col("p_retailprice") < 930, "#FF0000")), ("own", F.when(F.contains("p_type", F.lit("A")) & (F.col("p_size") > 25), "#00FF00")), ("band", F.when(F.col("p_size") % 2 == 1, "#EEEEEE"))]
    fill, layer = styles.first_set(*layers)
    return table(spark, sf_dir, "part").select("p_partkey", fill.alias("fill"), layer.alias("layer"))


@_r.query("""
with c as (select c_mktsegment as sheet, c_nationkey::int as col, (row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey))::int as "row", c_custkey, case when c_custkey % 3 = 0 then 'thick' end as top_, case when c_custkey % 2 = 0 then 'thin' end as bottom_ from customer)
select c.sheet, c."row", c.col, c.c_custkey, coalesce(c.top_, a.bottom_) as top_, c.bottom_ from c left join c a on a.sheet = c.sheet and a.col = c.col and a."row" = c."row" - 1
""")
def border_neighbours(spark, sf_dir):
    """A sheet for each market segment, a column for each nation."""
    cells = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("sheet"), F.col("c_nationkey").cast("int").alias("col"), F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey")).alias("row"), "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, "thick").alias("top_"), F.when(F.col("c_custkey") % 2 == 0, "thin").alias("bottom_"),
    )
    return styles.inherit_edges(cells, "top_", "bottom_", 1, 0, ["sheet"]).select("sheet", "row", "col", "c_custkey", "top_", "bottom_")


@_r.query("""
with recursive s as (select 'n' || n_nationkey as style, case when n_nationkey = 24 then 'n23' when n_nationkey = 23 then 'n24' when n_nationkey > 0 then 'n' || (n_nationkey - 1) end as parent, case when n_nationkey % 4 = 0 then n_nationkey % 8 = 0 end as bold, case when n_nationkey % 9 = 0 then n_nationkey + 0.5 end as size from nation),
c as (select style as leaf, style, parent, 0 as depth, [style] as seen, bold, size from s union all select c.leaf, s.style, s.parent, depth + 1, list_append(seen, s.style), s.bold, s.size from c join s on c.parent = s.style where not list_contains(seen, s.style))
select leaf as style, max(depth)::int as depth, arg_min(bold, depth) filter (where bold is not null) as bold, arg_min(size, depth) filter (where size is not null)::double as size from c group by leaf
""")
def style_chain_recursive(spark, sf_dir):
    """Nearest set property along ``basedOn``: a chain of 23 styles, and two that are based on each other."""
    n = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    chain = table(spark, sf_dir, "nation").select(
        name(n).alias("style"), F.when(n == 24, "n23").when(n == 23, "n24").when(n > 0, name(n - 1)).alias("parent"),
        F.when(n % 4 == 0, n % 8 == 0).alias("bold"), F.when(n % 9 == 0, n + 0.5).cast("double").alias("size"),
    )
    return styles.resolve_chain(spark, chain, "style", "parent", ["bold", "size"])


@_r.query("""
select n_nationkey, coalesce(a.r_name, b.r_name, c.r_name, 'none') as source from nation left join region a on a.r_regionkey * 2 = n_nationkey % 10
  left join region b on b.r_regionkey = 1 and n_nationkey % 4 = 1 left join region c on c.r_regionkey in (1, 2) and n_nationkey % 4 = c.r_regionkey
""")
def placeholder_coalesce(spark, sf_dir):
    """A nation's region by number, else by kind, else by another layer's kind."""
    region, k = table(spark, sf_dir, "region"), F.col("r_regionkey")
    asked = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 10).alias("idx"), (F.col("n_nationkey") % 4).alias("kind"))
    layers = [region.select((k * 2).alias("idx"), F.col("r_name").alias("by_idx")), region.where(k == 1).select(k.alias("kind"), F.col("r_name").alias("by_type")), region.where(k.isin(1, 2)).select(k.alias("kind"), F.col("r_name").alias("by_master"))]
    joined = asked.join(layers[0], "idx", "left").join(layers[1], "kind", "left").join(layers[2], "kind", "left")
    first, _ = styles.first_set(("idx", F.col("by_idx")), ("type", F.col("by_type")), ("master", F.col("by_master")))
    return joined.select("n_nationkey", F.coalesce(first, F.lit("none")).alias("source"))


@_r.query(r"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, printf('%.2f', round(l_extendedprice::decimal(38,12), 2)) as f2, regexp_replace(printf('%d', floor(l_extendedprice + 0.5)::bigint), '^(\d+)(\d{3})$', '\1,\2') as f3,
  printf('%d', floor(l_discount * 100 + 0.5)::bigint) || '%' as f9, month(l_shipdate) || '/' || day(l_shipdate) || '/' || year(l_shipdate) as f14, strftime(l_shipdate, '%-d-%b-%y') as f15 from lineitem
""")
def fmt_builtin_ids(spark, sf_dir):
    """Built-in number and date formats."""
    x, day = F.col("l_extendedprice"), dates.serial(F.col("l_shipdate"))
    f = lambda v, i: formats.format_value(v, formats.BUILTIN[i])
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", f(x, 2).alias("f2"), f(x, 3).alias("f3"), f(F.col("l_discount"), 9).alias("f9"), f(day, 14).alias("f14"), f(day, 15).alias("f15"),
    )


@_r.query("""
select p_partkey, '#' || lpad(printf('%X', cast(floor(255 + (0 - 255) * (p_size / 50.0) + 0.5) as bigint)), 2, '0') || lpad(printf('%X', cast(floor(0 + 255 * (p_size / 50.0) + 0.5) as bigint)), 2, '0') || '80' as mixed from part
""")
def color_interpolate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", colors.interpolate(F.lit("#FF0080"), F.lit("#00FF80"), F.col("p_size") / 50.0).alias("mixed"))
