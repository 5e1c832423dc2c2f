"""Rules, grids and documents beyond the registered queries."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gridloom import plans
from gridloom.operators import documents, grid, order_stats, rules, styles


def test_icons(spark):
    t = [F.lit(x) for x in (0, 10, 20)]
    rows = spark.createDataFrame([(5,), (10,), (25,)], "v int")
    assert [tuple(r) for r in rows.select(rules.icon_index(F.col("v"), t), rules.icon_index(F.col("v"), t, reverse=True)).collect()] == [(0, 2), (1, 1), (2, 0)]


def test_bars_of_flat_data(spark):
    assert spark.range(1).select(rules.bar_ratio(F.lit(3.0), F.lit(3.0), F.lit(3.0))).collect()[0][0] == 0.0


def test_stop_hides_later_rules_only(spark):
    rows = spark.createDataFrame([(1,), (2,)], "v int")
    found = rules.resolve([F.col("v")], [(2, F.lit(True), False, {"a": "late", "b": "late"}), (1, F.col("v") == 1, True, {"a": "early"})], ["a", "b"])
    assert [tuple(r) for r in rows.select(*found).orderBy("v").collect()] == [(1, "early", None), (2, "late", "late")]


def test_list_counters_like_a_sequential_reader(spark):
    rng = random.Random(4)
    items = [(d, i, rng.randrange(4)) for d in range(5) for i in range(30)]
    want, store = {}, {}
    for d, i, level in items:
        counts = store.setdefault(d, [0] * 4)
        counts[level] += 1
        counts[level + 1 :] = [0] * (3 - level)
        want[d, i] = counts[level]
    df = spark.createDataFrame(items, "d int, i int, level int")
    assert {(r.d, r.i): r.counter for r in documents.list_counters(df, ["d"], "i", "level").collect()} == want
    levels = spark.createDataFrame([(1, i, x) for i, x in enumerate((0, 0, 1, 1, 0, 1))], "d int, i int, level int")
    assert [r.counter for r in documents.list_counters(levels, ["d"], "i", "level").orderBy("i").collect()] == [1, 2, 1, 2, 3, 1]
    assert [r.number for r in documents.auto_numbers(levels.where("i > 1"), ["d"], "i", "level", F.lit(True)).orderBy("i").collect()] == [1, 2, 1, 3]


def test_merge_cover_counts(spark):
    cells = spark.createDataFrame([(s, r, c) for s in (0, 1) for r in range(1, 6) for c in range(1, 6)], "s int, row int, col int")
    merges = spark.createDataFrame([(0, 2, 2, 3, 4)], "s int, top int, left int, bottom int, right int")
    found = {(r.s, r.cover): r["count"] for r in grid.merge_cover(cells, merges, ["s"]).groupBy("s", "cover").count().collect()}
    assert found == {(0, "anchor"): 1, (0, "covered"): 5, (0, "plain"): 19, (1, "plain"): 25}


def test_edges_stay_on_their_sheet(spark):
    cells = spark.createDataFrame([(0, 1, 1, None, "thin"), (0, 2, 1, None, None), (1, 2, 1, None, None)], "s int, row int, col int, top string, bottom string")
    got = {(r.s, r.row): r.top for r in styles.inherit_edges(cells, "top", "bottom", 1, 0, ["s"]).collect()}
    assert got == {(0, 1): None, (0, 2): "thin", (1, 2): None}


def test_order_statistics_are_exact(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "BRACKET", 20)
    big = spark.range(1000).select((F.lit(2**60) + F.col("id")).alias("v"))
    assert order_stats.kth_smallest(big, F.col("v"), 500) == 2**60 + 500
    few = spark.range(5000).select((F.col("id") % 3).alias("v"))
    assert [order_stats.kth_smallest(few, F.col("v"), k) for k in (0, 1666, 1667, 4999, 5000)] == [0, 0, 1, 2, None]


def test_margins_and_bands(spark):
    df = spark.createDataFrame([(1, 0, 0, 18), (1, 1, 12, 0)], "d int, i int, before int, after int")
    assert [r.gap for r in documents.margin_gaps(df, ["d"], "i", F.col("before"), F.col("after")).orderBy("i").collect()] == [0, 18]
    got = spark.range(1, 7).select(styles.table_band(F.col("id"), 1, 6, 1, 1).alias("b")).collect()
    assert [r.b for r in got] == ["header", "band1", "band2", "band1", "band2", "totals"]


def test_tsv_fills_gaps(spark):
    cells = spark.createDataFrame([("s", 1, 1, "a"), ("s", 3, 2, "b")], "sheet string, row int, col int, text string")
    assert grid.tsv(cells, 1, 1, 3, 2, ["sheet"]).collect()[0].tsv == "a\t\n\t\n\tb"


def test_rows_of_a_block_do_not_gather(spark, tmp_path):
    spark.range(300).selectExpr("id as l_orderkey", "1 as l_linenumber", "id as l_partkey", "id as l_suppkey", "1.0d as l_extendedprice", "cast(id as double) as l_quantity", "'N' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = plans.QUERIES["cf_block_bars"](spark, str(tmp_path))
        assert df.count() == 300 and "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
