"""Chart and sparkline queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import charts
from .registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_BY_YEAR = "select year(l_shipdate)::int as y, l_returnflag as s, round(sum(l_extendedprice), 2) as v from lineitem group by all"


def _by_year(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("s")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))


@_r.query(f"""
with p as ({_BY_YEAR}), w as (select *, sum(abs(v)) over (partition by y order by s rows between unbounded preceding and current row) as stop from p)
select y, s, v, round(stop - abs(v), 1) as base, round(stop, 1) as stop from w
""")
def chart_stacked_bar(spark, sf_dir):
    found = charts.stacked(_by_year(spark, sf_dir), ["y"], [F.col("s")], F.col("v"))
    return found.select("y", "s", "v", F.round("base", 1).alias("base"), F.round("stop", 1).alias("stop"))


@_r.query(f"""with p as ({_BY_YEAR}) select y, s, round(abs(v) / sum(abs(v)) over (partition by y) * 100, 6) as percent from p""")
def chart_percent_stacked(spark, sf_dir):
    return charts.percent_stacked(_by_year(spark, sf_dir), ["y"], F.col("v")).select("y", "s", F.round("percent", 6).alias("percent"))


@_r.query("""
with p as (select year(o_orderdate)::int as y, o_orderpriority as s, count(*)::double as v from orders group by all),
w as (select *, sum(v) over (partition by y order by s desc rows between unbounded preceding and current row) as stop from p) select y, s, stop - v as base, stop from w
""")
def chart_area_stack(spark, sf_dir):
    """The last series lies at the bottom."""
    points = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("s")).agg(F.count("*").cast("double").alias("v"))
    return charts.stacked(points, ["y"], [F.col("s").desc()], F.col("v"), signed=True).select("y", "s", "base", "stop")


@_r.query("""
with p as (select month(o_orderdate)::int as m, year(o_orderdate)::int as y, count(*)::double as v from orders group by all),
s as (select *, m % 3 = 0 or row_number() over (partition by y order by m) = 1 as sub from p),
g as (select *, sum(sub::int) over (partition by y order by m rows between unbounded preceding and current row) as grp from s),
e as (select *, sum(v) over (partition by y, grp order by m rows between unbounded preceding and current row) as stop from g)
select y, m, v, sub as is_subtotal, case when sub then least(0, v) else least(stop, stop - v) end as bar_start, case when sub then greatest(0, v) else greatest(stop, stop - v) end as bar_end from e
""")
def chart_waterfall(spark, sf_dir):
    """Orders by month; quarter ends are subtotals."""
    points = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").cast("double").alias("v"))
    return charts.waterfall(points, ["y"], "m", F.col("v"), F.col("m") % 3 == 0).select("y", "m", "v", "is_subtotal", "bar_start", "bar_end")


@_r.query("""
with p as (select o_orderstatus as s, sum(o_totalprice) as v from orders group by all), w as (select s, v / sum(v) over () as share from p)
select s, round(share, 6) as share, share * 2 * pi() > 0.15 as labelled from w
""")
def chart_pie_share(spark, sf_dir):
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.sum("o_totalprice").alias("v"))
    found = charts.share(points.withColumn("chart", F.lit(1)), ["chart"], F.col("v"))
    return found.select("s", F.round("share", 6).alias("share"), (F.col("share") * 2 * F.pi() > 0.15).alias("labelled"))


@_r.query("""
with p as (select p_brand, p_size::int as s, avg(p_retailprice) as v from part group by all), d as (select p_brand, stddev_pop(v) as sd, count(*) as n from p group by p_brand)
select p_brand, s, round(v + sd, 6) as sd_high, round(v - sd, 6) as sd_low, round(v + sd / sqrt(n), 6) as se_high, round(v + abs(v) * 0.05, 6) as pct_high, round(v + 10, 6) as fixed_high from p join d using (p_brand)
""")
def chart_error_bars(spark, sf_dir):
    points = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("s")).agg(F.avg("p_retailprice").alias("v"))
    over, v = Window.partitionBy("p_brand"), F.col("v")
    amount = lambda kind, n=1.0: charts.error_amount(kind, v, n, over)
    return points.select(
        "p_brand", "s", F.round(v + amount("stdDev"), 6).alias("sd_high"), F.round(v - amount("stdDev"), 6).alias("sd_low"), F.round(v + amount("stdErr"), 6).alias("se_high"),
        F.round(v + amount("percentage", 5), 6).alias("pct_high"), F.round(v + amount("fixedVal", 10), 6).alias("fixed_high"),
    )


@_r.query("""
with p as (select p_brand, sum(p_retailprice) as hi from part group by p_brand), r as (select *, hi / 5 as raw, pow(10, floor(log10(hi / 5))) as pw from p),
s as (select *, pw * case when raw / pw < 1.5 then 1 when raw / pw < 3.5 then 2 when raw / pw < 7.5 then 5 else 10 end as step from r)
select p_brand, step, ceil(hi / step - 1e-9) * step + case when abs(ceil(hi / step - 1e-9) * step - hi) < 1e-9 * step then step else 0 end as axis_high, 0.0::double as axis_low from s
""")
def chart_axis_nice(spark, sf_dir):
    points = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("hi"))
    step = charts.nice_step(F.col("hi"))
    return points.select("p_brand", step.alias("step"), charts.axis_max(F.col("hi"), step).alias("axis_high"), charts.axis_min(F.lit(0.0), step).alias("axis_low"))


@_r.query("""
with p as (select user_id, event_type, hour(ts)::int as h, count(*) as n from events group by all), e as (select distinct user_id, event_type, unnest(range(24))::int as h from p)
select e.user_id, e.event_type, e.h, p.n from e left join p on p.user_id = e.user_id and p.event_type = e.event_type and p.h = e.h
""")
def chart_points_padded(spark, sf_dir):
    """Points of each user and event type by hour; hours without a point are null."""
    points = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    return charts.padded(points, ["user_id", "event_type"], "h", "n", 24)


@_r.query("""
with p as (select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name), r as (select *, row_number() over (order by n_name) - 1 as idx from p)
select n_name, case idx when 2 then 'custom' when 4 then null else concat_ws(' ', n_name, n, round(n * 100.0 / sum(n) over (), 1) || '%') end as label from r
""")
def chart_data_labels(spark, sf_dir):
    """Composed labels; one is overridden, one deleted."""
    counts = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    over_all, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("n_name")  # a row a nation
    points = counts.withColumn("idx", F.row_number().over(order) - 1).withColumn("share", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(over_all), 1))
    overrides = F.broadcast(spark.createDataFrame([(2, "custom", False), (4, None, True)], "idx int, override string, deleted boolean"))
    composed = F.concat_ws(" ", "n_name", F.col("n").cast("string"), F.concat(F.col("share").cast("string"), F.lit("%")))
    return points.join(overrides, "idx", "left").select("n_name", F.when(F.col("deleted"), None).otherwise(F.coalesce("override", composed)).alias("label"))


_DAILY = "select user_id, ts::date as d, round(sum(value - 100), 2) as v from events group by all"


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.round(F.sum(F.col("value") - 100), 2).alias("v"))


@_r.query(f"""
with p as ({_DAILY}), w as (select *, min(v) over u as low, max(v) over u as high, max(d) over u as last_d, min(d) over u as first_d from p window u as (partition by user_id))
select user_id, d, v, case when v = low then 'low' when v = high then 'high' when d = last_d then 'last' when d = first_d then 'first' when v < 0 then 'negative' end as flag from w
""")
def sparkline_flags(spark, sf_dir):
    return charts.sparkline(_daily(spark, sf_dir), ["user_id"], ["d"], "v").select("user_id", "d", "v", "flag")


@_r.query(f"""
with p as ({_DAILY}), w as (select *, min(v) over (partition by user_id) as low, max(v) over (partition by user_id) as high from p)
select user_id, d, round(case when high = low then 0.5 else (v - low) / (high - low) end, 6) as y, sign(v)::int as stem, case when low < 0 and high > 0 then round(-low / (high - low), 6) when high <= 0 then 1.0 else 0.0 end as baseline from w
""")
def sparkline_axis(spark, sf_dir):
    found = charts.sparkline(_daily(spark, sf_dir), ["user_id"], ["d"], "v")
    low, high = F.col("low"), F.col("high")
    baseline = F.when((low < 0) & (high > 0), F.round(F.try_divide(-low, high - low), 6)).when(high <= 0, 1.0).otherwise(0.0)
    return found.select("user_id", "d", F.round("y", 6).alias("y"), F.signum("v").cast("int").alias("stem"), baseline.alias("baseline"))


@_r.query(f"""
with p as ({_DAILY}), e as (select user_id, unnest(generate_series(min(d), max(d), interval 1 day))::date as d from p group by user_id), j as (select e.user_id, e.d, p.v from e left join p on p.user_id = e.user_id and p.d = e.d)
select user_id, d, v, count(*) filter (where v is null) over (partition by user_id order by d rows between unbounded preceding and current row) as segment, coalesce(v, 0) as zeroed from j
""")
def sparkline_gaps(spark, sf_dir):
    """A line's days from its first to its last."""
    points = _daily(spark, sf_dir)
    every = points.groupBy("user_id").agg(F.sequence(F.min("d"), F.max("d")).alias("d")).withColumn("d", F.explode("d"))
    return charts.gap_segments(every.join(points, ["user_id", "d"], "left"), ["user_id"], ["d"], "v").select("user_id", "d", "v", "segment", "zeroed")


@_r.query("""
with p as (select o_orderpriority as s, count(*)::double as v from orders group by all), r as (select *, row_number() over (order by s) - 1 as i, count(*) over () as n, max(v) over () as top from p)
select s, round(2 * pi() * i / n - pi() / 2, 6) as angle, round(v / top, 6) as radius from r
""")
def chart_radar(spark, sf_dir):
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("s")).agg(F.count("*").cast("double").alias("v"), F.lit(1).alias("chart"))
    placed = points.withColumn("i", F.row_number().over(Window.partitionBy("chart").orderBy("s")) - 1)  # a row a priority
    found = charts.radar(placed, ["chart"], "i", "v")
    return found.select("s", F.round("angle", 6).alias("angle"), F.round("radius", 6).alias("radius"))


@_r.query("""
select p_partkey, coalesce(try_cast(case when p_size % 5 = 0 then p_name else p_size::varchar end as double), p_partkey + 1)::double as x, p_retailprice as y from part
""")
def chart_scatter(spark, sf_dir):
    label = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", charts.scatter_x(label, F.col("p_partkey")).alias("x"), F.col("p_retailprice").alias("y"))


@_r.query("""
with p as (select p_brand, max(p_retailprice) as hi from part group by p_brand) select p_brand, unnest(range(0, (floor(hi / 200))::bigint + 1)) * 200.0::double as tick from p
""")
def chart_ticks(spark, sf_dir):
    points = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("hi"))
    return points.select("p_brand", F.explode(charts.ticks(F.lit(0.0), F.col("hi"), F.lit(200.0))).alias("tick"))


@_r.query("""
with p as (select distinct ts::date as d, user_id from events), r as (select user_id, d, row_number() over (partition by user_id order by d) - 1 as i, count(*) over (partition by user_id) as n from p)
select user_id, d, i % greatest(1, ceil(n / 8.0)::bigint) = 0 as shown, left(strftime(d, '%Y-%m-%d') || ' label', 12) as label from r
""")
def chart_label_thinning(spark, sf_dir):
    """Every ceil(n / 8)-th label is shown, cut to 12 characters."""
    from ..functions.labels import thinned

    w = Window.partitionBy("user_id")
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("d"), "user_id").distinct()
    placed = days.withColumn("i", F.row_number().over(w.orderBy("d")) - 1).withColumn("n", F.count("*").over(w))
    return placed.select("user_id", "d", thinned(F.col("i"), F.col("n")).alias("shown"), F.substring(F.concat(F.col("d").cast("string"), F.lit(" label")), 1, 12).alias("label"))


@_r.query("""
with o as (select o_orderkey, (['barChart', 'lineChart', 'areaChart', 'pieChart'])[o_orderkey % 4 + 1] as kind, case o_orderkey % 3 when 0 then 'bar' when 1 then 'col' end as direction, (['stacked', 'percentStacked', 'clustered', 'standard'])[o_orderkey // 4 % 4 + 1] as grouping_ from orders),
g as (select *, case grouping_ when 'stacked' then 'stacked' when 'percentStacked' then 'percent' else 'plain' end as how from o)
select o_orderkey, case kind when 'barChart' then case when direction = 'bar' then 'bar-' else 'column-' end || how when 'lineChart' then 'line-' || how when 'areaChart' then 'area-' || how else 'pie' end as name from g
""")
def chart_kinds(spark, sf_dir):
    """Names of charts by type, direction and grouping."""
    k = F.col("o_orderkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    kind, grouping = pick(["barChart", "lineChart", "areaChart", "pieChart"], k % 4), pick(["stacked", "percentStacked", "clustered", "standard"], F.floor(k / 4) % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", charts.chart_kind(kind, pick(["bar", "col", None], k % 3), grouping).alias("name"))
