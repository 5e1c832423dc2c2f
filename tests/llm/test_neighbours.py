from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import neighbours, queries

from ..oracle import compare

ROWS = "vec_id long, embedding array<float>, label int, rank int, score double, v string, ids int, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0, "v", 4, 5) for i, v in rows], ROWS)


def brute(rows, k=20):
    kept = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    length = len(min(kept)[1]) if kept else 0
    kept = [(i, v) for i, v in kept if len(v) == length]
    out = []
    for i, v in sorted(kept):
        if i % 20 == 0:
            found = set()
            for j, w in kept:
                if i != j:
                    s = 0.0
                    for a, b in zip(v, w):
                        s += a * b
                    found.add((-s, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return out


def answer(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 24))
    rows = [(k, (base[k % 30] + rng.standard_normal(24)).astype(np.float32).tolist()) for k in range(900)]
    rows += [(1000 + k, rows[7][1]) for k in range(300)]  # one vector that many share
    got = answer(neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == sorted(brute(rows))


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, 0.0, 2.0]) for _ in range(4)]) for k in range(1, 90)]
    rows += rows[:30]
    odd = [(None, [1.0] * 4), (100, None), (120, [0.0] * 4), (140, [1.0, None, 1.0, 1.0]), (160, [float("inf")] * 4), (180, [1.0] * 5), (200, [2.0**100, 0.0, 0.0, 1.0]), (201, [])]
    got = answer(neighbours.nearest(frame(spark, rows + odd), F.col("vec_id") % 20 == 0))
    assert got == sorted(brute(rows + odd))
    assert answer(neighbours.nearest(frame(spark, []), F.col("vec_id") % 20 == 0)) == []
    assert answer(neighbours.nearest(frame(spark, rows[:3] + [(20, [1.0, 0.0, 0.0, 0.0])]), F.col("vec_id") % 20 == 0)) == sorted(brute(rows[:3] + [(20, [1.0, 0.0, 0.0, 0.0])]))


def test_error_bounds_hold_and_choose_few():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal((50, 64))
    turn = neighbours.spin(64, neighbours.BITS, 1)
    assert np.allclose(turn.T @ turn, np.eye(64))
    block = neighbours.coded(x, turn)
    assert block["bits"].nbytes == 4000 * neighbours.BITS // 8
    guess, width = neighbours.estimates(q, block, turn)
    true = q @ x.T
    assert (np.abs(true - guess) > width).mean() < 1e-3
    top = np.partition(true, -20, axis=1)[:, -20]
    assert ((guess + width) >= top[:, None]).mean() < 0.25


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    compare(spark, queries.op12_nearest_neighbours, queries.ORACLE_SQL["op12_nearest_neighbours"], f"/root/testdata/{sf}")
