"""Conditional-format queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colors
from ..functions.criteria import number_rule, text_rule
from ..operators import order_stats, rules
from .registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.query("""
with t as (select *, l_extendedprice as v from lineitem),
s as (select list_sort(list(v)) as a, min(v) as lo, max(v) as hi, count(*) as n from t)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, v, v >= a[greatest(1, n - 9)] as is_top10, round((v - lo) / (hi - lo), 6) as bar_ratio from t, s
""")
def cf_top_n_databar(spark, sf_dir):
    """Top 10 with ties, and the data bar of every value."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("v"))
    least = order_stats.top_threshold(t, F.col("v"), 10)
    low, high = t.agg(F.min("v"), F.max("v")).collect()[0]
    return t.withColumn("is_top10", F.col("v") >= F.lit(least)).withColumn("bar_ratio", F.round(rules.bar_ratio(F.col("v"), F.lit(low), F.lit(high)), 6))


@_r.query("""
with s as (select list_sort(list(p_retailprice)) as a, count(*) as n from part)
select p_partkey, p_retailprice, p_retailprice <= a[least(n, greatest(1, n * 10 // 100))] as is_bottom from part, s
""")
def cf_bottom_percent(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    most = order_stats.top_threshold(t, F.col("p_retailprice"), 10, percent=True, bottom=True)
    return t.withColumn("is_bottom", F.col("p_retailprice") <= F.lit(most))


@_r.query("""
with m as (select avg(c_acctbal) as mean from customer)
select c_custkey, c_acctbal, c_acctbal > mean as above, c_acctbal < mean as below from customer, m
""")
def cf_above_average(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return t.crossJoin(F.broadcast(t.agg(F.avg("c_acctbal").alias("mean")))).select("c_custkey", "c_acctbal", (F.col("c_acctbal") > F.col("mean")).alias("above"), (F.col("c_acctbal") < F.col("mean")).alias("below"))


def _sql_channel(lo: str, hi: str, t: str, shift: int) -> str:
    a, b = f"({lo} >> {shift} & 255)", f"({hi} >> {shift} & 255)"
    return f"lpad(printf('%X', cast(floor({a} + ({b} - {a}) * {t} + 0.5) as bigint)), 2, '0')"


def _sql_mix(lo: int, hi: int, t: str) -> str:
    return "'#' || " + " || ".join(_sql_channel(str(lo), str(hi), t, s) for s in (16, 8, 0))


@_r.query(f"""
with s as (select min(p_retailprice) as lo, max(p_retailprice) as hi, list_sort(list(p_retailprice)) as a, count(*) as n from part),
m as (select lo, hi, a[cast(floor(0.5 * (n - 1) + 0.5) as bigint) + 1] as mid from s)
select p_partkey, p_retailprice, case when p_retailprice <= mid then {_sql_mix(0xF8696B, 0xFFEB84, "greatest(0.0, least(1.0, (p_retailprice - lo) / (mid - lo)))")}
  when p_retailprice <= hi then {_sql_mix(0xFFEB84, 0x63BE7B, "greatest(0.0, least(1.0, (p_retailprice - mid) / (hi - mid)))")} else '#63BE7B' end as color
from part, m
""")
def cf_color_scale_3(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    mid = order_stats.nearest_percentile(t, F.col("p_retailprice"), 50)
    low, high = t.agg(F.min("p_retailprice"), F.max("p_retailprice")).collect()[0]
    stops = [(F.lit(low), "#F8696B"), (F.lit(mid), "#FFEB84"), (F.lit(high), "#63BE7B")]
    return t.withColumn("color", colors.scale_color(F.col("p_retailprice"), stops))


@_r.query("""
with s as (select list_sort(list(s_acctbal)) as a, count(*) as n from supplier),
q as (select a[cast(floor(0.33 * (n - 1) + 0.5) as bigint) + 1] as t1, a[cast(floor(0.67 * (n - 1) + 0.5) as bigint) + 1] as t2 from s)
select s_suppkey, s_acctbal, case when s_acctbal >= t2 then 2 when s_acctbal >= t1 then 1 else 0 end as icon from supplier, q
""")
def cf_icon_set_percentile(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    at = [F.lit(order_stats.nearest_percentile(t, F.col("s_acctbal"), p)) for p in (0, 33, 67)]
    return t.withColumn("icon", rules.icon_index(F.col("s_acctbal"), at))


@_r.query("""
select o_orderkey, o_totalprice, o_totalprice between 100000 and 200000 as in_range, o_totalprice < 100000 or o_totalprice > 200000 as out_range, o_totalprice >= 150000 as at_least from orders
""")
def cf_cell_is_numeric(spark, sf_dir):
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice",
        number_rule(x, "between", 200000, 100000).alias("in_range"), number_rule(x, "notBetween", 100000, 200000).alias("out_range"), number_rule(x, "greaterThanOrEqual", 150000).alias("at_least"),
    )


@_r.query("""
select o_orderkey, o_orderpriority, lower(o_orderpriority) = '1-urgent' as is_urgent, contains(lower(o_orderpriority), 'low') as has_low, starts_with(lower(o_orderpriority), '2') as starts_2, not contains(lower(o_orderpriority), 'e') as no_e from orders
""")
def cf_cell_is_text(spark, sf_dir):
    x = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority",
        text_rule(x, "equal", "1-URGENT").alias("is_urgent"), text_rule(x, "containsText", "LOW").alias("has_low"), text_rule(x, "beginsWith", "2").alias("starts_2"), text_rule(x, "notContains", "e").alias("no_e"),
    )


@_r.query("""
with m as (select *, o_totalprice > 250000 as r1, o_orderstatus = 'F' as r2, contains(o_orderpriority, '5') as r3 from orders)
select o_orderkey, case when r1 then '#FF0000' when r2 then '#00FF00' end as fill, case when r2 then 'bold' when r3 and not r2 then 'italic' end as font from m
""")
def cf_priority_first_match(spark, sf_dir):
    """Three rules: the first match of a property holds, and the second rule stops the third."""
    found = rules.resolve(
        [F.col("o_orderkey")],
        [
            (3, F.contains("o_orderpriority", F.lit("5")), False, {"font": "italic"}),
            (1, F.col("o_totalprice") > 250000, False, {"fill": "#FF0000"}),
            (2, F.col("o_orderstatus") == "F", True, {"fill": "#00FF00", "font": "bold"}),
        ],
        ["fill", "font"],
    )
    return table(spark, sf_dir, "orders").select(*found)


@_r.query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity * 2 > l_extendedprice / 1000 and l_returnflag <> 'N' as matched from lineitem")
def cf_expression_row(spark, sf_dir):
    """An expression over cells of the same row needs no join."""
    matched = (F.col("l_quantity") * 2 > F.col("l_extendedprice") / 1000) & (F.col("l_returnflag") != "N")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", matched.alias("matched"))


@_r.query("""
select c_custkey, c_mktsegment, c_nationkey, count(*) over (partition by c_nationkey, c_mktsegment) > 1 as is_duplicate from customer
""")
def cf_duplicate_values(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return rules.duplicates(t, "c_mktsegment", ["c_nationkey"]).select("c_custkey", "c_mktsegment", "c_nationkey", "is_duplicate")


@_r.query("""
with s as (select l_returnflag, min(l_quantity) as low, max(l_quantity) as high, avg(l_quantity) as mean from lineitem group by l_returnflag)
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, round((l.l_quantity - low) / (high - low), 6) as bar_ratio, l.l_quantity > mean as above
from lineitem l join s using (l_returnflag)
""")
def cf_block_bars(spark, sf_dir):
    """Blocks have their own thresholds, joined back by block; a flag has three values, so the thresholds go to the rows and no block gathers in a task."""
    t = table(spark, sf_dir, "lineitem")
    stats = rules.block_stats(t, ["l_returnflag"], F.col("l_quantity"))
    return t.join(F.broadcast(stats), "l_returnflag").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.round(rules.bar_ratio(F.col("l_quantity"), F.col("low"), F.col("high")), 6).alias("bar_ratio"), (F.col("l_quantity") > F.col("mean")).alias("above"),
    )
