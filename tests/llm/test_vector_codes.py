from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from gridloom.llm import queries, vector_codes

from ..oracle import compare

ROWS = "vec_id long, embedding array<float>, label int, code string, part int, error long"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = next((len(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)) if v and len(v) % parts == 0), 0)
    kept = [r for r in kept if length and len(r[1]) == length]
    if not kept:
        return {}, ""
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    d = length // parts
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[whole[k][p * d : p * d + d] for k in order[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = {}
            for v in whole:
                part = v[p * d : p * d + d]
                mine.setdefault(best(part, book)[1], []).append(part)
            for n, held in mine.items():
                book[n] = [sum(c) // len(held) for c in zip(*held)]
    out = []
    for v in whole:
        near = [best(v[p * d : p * d + d], books[p]) for p in range(parts)]
        out.append(("".join(f"{n:02x}" for _, n in near), sum(x for x, _ in near)))
    labels = {}
    for (_, _, g), (_, e) in zip(kept, out):
        labels[g] = labels.get(g, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, c, e, labels[g]) for (i, _, g), (c, e) in zip(kept, out)), sha


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", 1, 2) for i, v, g in rows], ROWS)


def answer(df):
    got = df.collect()
    return sorted((r.vec_id, r.code, r.error, r.label_error) for r in got), {r.codebooks_sha256 for r in got}


@pytest.mark.parametrize("case", ["random", "tied", "few", "wide", "long"])
def test_equals_plain_rounds(spark, case):
    rng = random.Random(case)
    length, n = (8, 40) if case == "tied" else (40, 60) if case == "long" else (16, 9 if case == "few" else 60)
    draw = (lambda: rng.choice([-1.0, 0.0, 1.0])) if case == "tied" else (lambda: float(np.float32(rng.gauss(0, 1e30 if case == "wide" else 1))))
    rows = [(rng.randrange(10**6), [draw() for _ in range(length)], rng.choice([None, 1, 2])) for _ in range(n)]
    if case == "tied":
        rows = rows[:20] * 3
    want, sha = brute(rows)
    got, shas = answer(vector_codes.compress(frame(spark, rows)))
    assert shas == {sha}
    fit = [(i, c, e if e < 2**63 else None, g if g < 2**63 else None) for i, c, e, g in want]
    assert sorted(got, key=str) == sorted(fit, key=str)


def test_odd_rows(spark):
    rows = [(k, [float((k * j) % 7) / 3 for j in range(8)], k % 2) for k in range(20)]
    odd = [(3, None, 1), (4, [1.0] * 7 + [None], 1), (5, [float("nan")] * 8, 1), (6, [float("inf")] * 8, None), (7, [1.0] * 16, 0), (8, [], 0), (2, [1.0] * 8, None)]
    got, _ = answer(vector_codes.compress(frame(spark, rows + odd)))
    want, _ = brute(rows + odd)
    assert got == want and len(got) == 21
    assert vector_codes.compress(frame(spark, [])).collect() == []
    assert vector_codes.compress(frame(spark, odd[:4])).collect() == []


def test_bounds_hold_and_drop_most():
    rng = np.random.default_rng(1)
    entries = rng.integers(-4000, 4000, (16, 8))
    parts = entries[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))
    exact = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for s in (1, 2, 4):
        assert (vector_codes.lower_bounds(parts, entries, s) <= exact * (1 + 1e-9) + 1e-6).all()
    code, distance, tried = vector_codes.nearest(parts, entries)
    assert (code == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert tried < exact.size / 5


def test_heavy_and_light_labels(spark):
    rows = spark.range(3000).selectExpr("id as vec_id", "'aa' as code", "id as error", "case when id < 1000 then 7 when id < 2000 then null else id end as label")
    got = {r.vec_id: r.label_error for r in vector_codes.with_label_errors(rows, 3000).collect()}
    assert len(got) == 3000 and got[5] == sum(range(1000)) and got[1500] == sum(range(1000, 2000)) and got[2500] == 2500


def test_query(spark):
    compare(spark, queries.op11_vector_codes, queries.ORACLE_SQL["op11_vector_codes"], "/root/testdata/sf0.01")
