"""Guides as data against guides in the plan, and outlines that close and go on."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import guides
from gridloom.operators import geometry

FORMULAS = [("a", "pin 0 16667 50000"), ("b", "*/ ss a 100000"), ("c", "+- r 0 b"), ("d", "?: c 1 2"), ("e", "mod w h 0"), ("f", "sin hd2 2700000"), ("g", "at2 w h"), ("i", "cat2 wd2 w h"), ("j", "abs -3"), ("k", "min 4 b"), ("m", "max 4 b"), ("n", "sqrt e"), ("o", "+/ w h 2"), ("p", "tan 5 cd8"), ("a", "val 7"), ("q", "*/ a 2 1")]


def test_guides_as_data(spark):
    shapes = spark.createDataFrame([(1, 300.0, 200.0), (2, 90.0, 400.0), (3, 5.0, 5.0)], "shape int, w double, h double")
    rows = [(s, i, n, f.split()) for s in (1, 2) for i, (n, f) in enumerate(FORMULAS)] + [(3, 0, "odd", ["what", "1"]), (3, 1, "lost", ["val", "nothing"])]
    got = {r["shape"]: r["values"] for r in geometry.guide_values(shapes, spark.createDataFrame(rows, "shape int, ord int, name string, args array<string>"), ["shape"]).collect()}
    plain = {r["shape"]: r for r in guides.guides(shapes, "w", "h", [(n if i < 14 else f"{n}2", f if i < 15 else "*/ a2 2 1") for i, (n, f) in enumerate(FORMULAS)]).collect()}
    for s in (1, 2):
        for name in "bcdefgijkmnop":
            assert abs(got[s][name] - plain[s][name]) < 1e-9, name
        assert got[s]["a"] == 7 and got[s]["q"] == 14
    assert got[3]["odd"] is None and got[3]["lost"] is None and got[3]["ssd2"] == 2.5


def test_pens_after_closing(spark):
    shapes = spark.createDataFrame([(1, 10.0, 10.0)], "shape int, w double, h double")
    commands = [("moveTo", ["1", "1"]), ("lnTo", ["5", "1"]), ("close", []), ("arcTo", ["2", "2", "0", "10800000"]), ("moveTo", ["7", "7"]), ("arcTo", ["1", "1", "0", "5400000"]), ("arcTo", ["1", "1", "5400000", "5400000"]), ("close", []), ("quadBezTo", ["0", "0", "9", "8"])]
    rows = [(1, "command", 0, i, n, a, 10, None) for i, (n, a) in enumerate(commands)]
    points = geometry.path_points(shapes, spark.createDataFrame(rows, "shape int, kind string, path int, ord int, name string, args array<string>, path_w long, path_h long"), ["shape"])
    got = [(round(r.x * 10, 6), round(r.y * 10, 6)) for r in points.orderBy(F.col("ord")).collect()]
    assert got == [(1, 1), (5, 1), (1, 1), (-3, 1), (7, 7), (6, 8), (5, 7), (7, 7), (9, 8)]
