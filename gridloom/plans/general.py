"""Spark-native additions: relational operations that spreadsheets and documents don't have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..streaming import events
from .registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.query("""
select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, grouping(l_returnflag)::int as g1, grouping(l_linestatus)::int as g2 from lineitem group by cube (l_returnflag, l_linestatus)
""")
def add_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"),
    )


@_r.query("""
with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) as view_id from events where event_type = 'view' group by all)
select p.event_id, p.user_id, v.view_id from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts
""")
def add_as_of(spark, sf_dir):
    """Each purchase with the user's latest view."""
    t = table(spark, sf_dir, "events")
    views = t.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    buys = t.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    return joins.as_of(buys, views, ["user_id"], "at", "ts", ["view_id"]).select("event_id", "user_id", "view_id")


@_r.query("select c_custkey from customer except select o_custkey from orders")
def add_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").select("o_custkey").distinct())


@_r.query("select s_nationkey as nation from supplier intersect select c_nationkey from customer")
def add_intersect(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(table(spark, sf_dir, "customer").select("c_nationkey"))


@_r.query("""
with w as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as s from w)
select user_id, min(ts)::timestamp as started, count(*) as n, round(sum(value), 2) as total from s group by user_id, s
""")
def add_sessions(spark, sf_dir):
    found = events.sessions(table(spark, sf_dir, "events"), "6 hours")
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n", F.round("total", 2).alias("total"))


@_r.query("select event_type, date_trunc('day', ts)::timestamp as started, count(*) as n, round(sum(value), 2) as total from events group by all")
def add_tumbling(spark, sf_dir):
    found = events.tumbling(table(spark, sf_dir, "events"), "1 day")
    return found.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("started"), "n", F.round("total", 2).alias("total"))


@_r.query("""
select n_name, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 1) as revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_shipdate < timestamp '1998-01-01' group by n_name
""")
def add_star_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz'1998-01-01 00:00:00'")
    joined = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"))


@_r.query("""
select o_orderpriority, count(distinct o_custkey) as customers, row_number() over (order by count(distinct o_custkey) desc, o_orderpriority)::int as position from orders group by o_orderpriority
""")
def add_ranked_groups(spark, sf_dir):
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("customers").desc(), "o_orderpriority")  # a row a priority
    return counts.withColumn("position", F.row_number().over(order))
