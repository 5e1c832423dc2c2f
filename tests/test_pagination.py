"""Pages against a reader that goes through a document block by block."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gridloom.operators import pagination

BLOCKS = "doc int, ord int, kind string, height double, before double, after double, keep_next boolean, break_before boolean, style string, contextual boolean"


def read(blocks, room):
    page, y, last, prev, held, out = 1, 0.0, 0.0, None, 0, []
    for i, (_, n, kind, h, before, after, keep, breaks, style, contextual) in enumerate(blocks):
        if kind == "break":
            page, y, last, prev, held = page + 1, 0.0, 0.0, None, 0
        elif kind == "table":
            if held and y + h > room:
                page, y, held = page + 1, 0.0, 0
            y, last, prev, held = y + h, 0.0, None, held + 1
        else:
            if breaks:
                page, y, last, prev, held = page + (held > 0), 0.0, 0.0, None, 0
            space = 0.0 if prev is not None and contextual and prev == style else before
            y -= min(last, space)
            nxt = blocks[i + 1] if keep and i + 1 < len(blocks) else None
            need = 0.0 if nxt is None or nxt[2] == "break" else nxt[3] if nxt[2] == "table" else nxt[3] + nxt[4] + nxt[5]
            if held and y > 0 and y + space + h + need > room:
                page, y, held = page + 1, 0.0, 0
            y, last, prev, held = y + space + h + after, after, style, held + 1
        out.append((n, page))
    return out


def test_equals_a_sequential_reader(spark):
    rng, rows = random.Random(3), []
    for doc in range(60):
        for n in range(rng.randint(0, 40)):
            kind = rng.choice(["paragraph"] * 6 + ["table", "break"])
            rows.append((doc, n, kind, float(rng.choice([5, 20, 40, 90, 300])), float(rng.choice([0, 5, 30])), float(rng.choice([0, 5, 30])), rng.random() < 0.2, kind == "paragraph" and rng.random() < 0.1, rng.choice("ab"), rng.random() < 0.3))
    got = pagination.paginate(spark.createDataFrame(rows, BLOCKS), ["doc"], "ord", F.lit(100)).collect()
    for doc in range(60):
        mine = [r for r in rows if r[0] == doc]
        assert sorted((r.ord, r.page) for r in got if r.doc == doc) == read(mine, 100), doc


def test_missing_values(spark):
    rows = [(1, 0, "paragraph", None, None, None, None, None, None, None), (1, 1, "break", None, None, None, None, None, None, None), (1, 2, "paragraph", 500.0, None, None, None, True, None, None)]
    assert [r.page for r in pagination.paginate(spark.createDataFrame(rows, BLOCKS), ["doc"], "ord", F.lit(100)).orderBy("ord").collect()] == [1, 2, 2]
    assert pagination.paginate(spark.createDataFrame([], BLOCKS), ["doc"], "ord", F.lit(100)).collect() == []
