"""Rules with references that the made books don't have."""

from __future__ import annotations

import pytest

from gridloom import plans
from gridloom.operators import anchored, grid

CELLS = "f string, row int, col int, v_num double, v_text string, v_bool boolean"
RULES = "f string, rule int, sqref string, formula string, priority int, stop_if_true boolean"


def test_operands_of_every_kind(spark):
    cells = spark.createDataFrame([("a", 1, 1, 5.0, None, None), ("a", 2, 1, None, "x", None), ("a", 3, 1, None, None, True), ("a", 2, 2, 5.0, None, None), ("b", 1, 1, 9.0, None, None)], CELLS)
    rules = spark.createDataFrame([
        ("a", 1, "A1:A9", "A1=5", 1, False), ("a", 2, "A1:A9", '=A1="x"', 2, False), ("a", 3, "A1:B9 A1:A2", "A$1 >= $B$2", 3, False), ("a", 4, "A1:A9", "SUM(A1)>1", 4, False), ("a", 5, "A1", "XFD1=0", 5, False), ("a", 6, "A2:A3", "A1=5", 6, False), ("a", 7, "A1:A3", "$A$3=1", 7, False),
    ], RULES)
    got = sorted((r.rule, r.row, r.col) for r in anchored.matches(cells, rules, ["f"], ["rule"]).collect())
    assert got == [(1, 1, 1), (2, 2, 1), (3, 1, 1), (3, 2, 1), (3, 3, 1), (5, 1, 1), (6, 2, 1), (7, 1, 1), (7, 2, 1), (7, 3, 1)]
    moved = {(r.rule, r.row, r.ref): r["at"] for r in anchored.targets(cells, rules.where("rule in (3, 4)"), ["f"], ["rule"]).collect()}
    assert tuple(moved[4, 3, "A1"]) == (3, 1) and tuple(moved[3, 2, "A$1"]) in {(1, 1), (1, 2)} and tuple(moved[3, 1, "$B$2"]) == (2, 2)


def test_a_rule_that_stops(spark):
    rows = [("a", 1, 2, False, 1, 1), ("a", 2, 1, True, 1, 1), ("a", 3, 3, False, 1, 2)]
    got = anchored.applied(spark.createDataFrame(rows, "f string, rule int, priority int, stop_if_true boolean, row int, col int"), ["f"]).collect()
    assert sorted((r.rule, r["at"]) for r in got) == [(2, 1), (3, 1)]


@pytest.fixture
def wide_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cells_of_rules_are_not_held(spark, wide_broadcasts):
    cells = spark.range(2000).selectExpr("'a' as f", "cast(id + 1 as int) as row", "1 as col", "cast(id as double) as v_num", "cast(null as string) as v_text", "cast(null as boolean) as v_bool")
    rules = spark.range(1).selectExpr("'a' as f", "1 as rule", "'A1:A1000 A900:A2000' as sqref", "'A1<A2' as formula", "1 as priority", "false as stop_if_true")
    got = anchored.matches(cells, rules, ["f"], ["rule"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortAggregate" not in plan
    assert sorted(r.row for r in got.collect()) == list(range(1, 2000))


def test_a_cell_meets_a_rule_once(spark):
    cells = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 300, 2), ("b", 1, 1), ("a", 9, 9)], "f string, row int, col int")
    boxes = spark.createDataFrame([("a", 1, 1, 1, 600, 3, 7), ("a", 1, 1, 1, 2, 2, 7), ("a", None, 250, 2, 300, 2, 8)], "f string, rule int, top int, left int, bottom int, right int, own int")
    got = grid.in_any(cells, boxes, ["f"], ["rule"]).collect()
    assert sorted((r.row, r.col, r.rule or 0, r.own) for r in got) == [(1, 1, 1, 7), (300, 2, 0, 8), (300, 2, 1, 7)]


@pytest.mark.parametrize(("formula", "rows"), [("A1=$B$1", [2]), ("A1<>$B$1", [1, 3, 4]), ("A1<$B$1", [1]), ('A1>"b"', [3, 4]), ('"b">=A1', [1, 2]), ("A1<=10", [1, 4])])
def test_every_operator(spark, formula, rows):
    cells = spark.createDataFrame([("a", 1, 1, 10.0, None, None), ("a", 2, 1, None, "b", None), ("a", 3, 1, None, "c", None), ("a", 4, 1, None, None, True), ("a", 1, 2, None, "b", None)], CELLS)
    rules = spark.createDataFrame([("a", 1, "A1:A4", formula, 1, False)], RULES)
    assert sorted(r.row for r in anchored.matches(cells, rules, ["f"], ["rule"]).collect()) == rows


def test_formats_of_rules_are_looked_up_once_a_rule(spark, wide_broadcasts):
    plan = plans.QUERIES["office_rule_formats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [min(") == 1  # the codes to compile come from the rules, not from all cells again
