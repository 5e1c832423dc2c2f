from __future__ import annotations

import duckdb
import pytest

from gridloom.llm import mixture, queries

from .conftest import DOCS, document

SF = "/root/testdata/sf0.001"


def fill(sizes: list[int], weights=(5, 2, 1), most=3.0):
    """Reshare the excess until no target is above its cap."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        share = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[10, 200, 3000, 7, 0, 50], [5, 5, 5], [1000, 1], [1], [0, 0]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(None if i == len(sizes) - 1 and i else f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in sorted(mixture.targets(df).collect(), key=lambda r: (r.source is None, r.source))]
    assert got == pytest.approx(fill(sizes))


def test_budgets_are_exact(spark, odd):
    rows = mixture.plan_mixture(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for mine in by.values():
        assert sum(r.taken for r in mine) == int(mine[0].target)
        assert sum(r.size for r in mine) == mine[0].source_size
    assert sorted(map(str, rows)) == sorted(map(str, mixture.plan_mixture(odd.repartition(3)).collect()))


def test_apply(spark, odd):
    docs = odd.dropDuplicates(["doc_id"])
    plan = mixture.plan_mixture(docs)
    mixed = mixture.apply_mixture(docs, plan)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.encode().split())
    for r in plan.select("source", "target").distinct().collect():
        assert words.get(r.source, 0) == int(r.target)


def test_apply_with_repeated_and_null_ids(spark, odd):
    rows = [document(None, f"w{i} " * (i + 1), source="a" if i % 2 else None) for i in range(12)]
    rows += [document(100, " ".join(f"v{k}" for k in range(i + 3)), source="b") for i in range(6)]
    rows += [document(101, "the same text each time", source=s) for s in ("a", "a", "b", "b", None, None)]
    docs = spark.createDataFrame(rows, DOCS).union(odd)
    plan = mixture.plan_mixture(docs)
    mixed = mixture.apply_mixture(docs, plan)
    assert mixed.columns == docs.columns
    words, times = {}, {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.encode().split())
    for r in plan.select("source", "target").distinct().collect():
        assert words.get(r.source, 0) == int(r.target)
    whole = {(r.doc_id, r.source, r.text) for r in docs.collect()}
    for r in mixed.collect():
        full = [t for d, s, t in whole if (d, s) == (r.doc_id, r.source) and t and t.split()[: len(r.text.split())] == r.text.split()]
        assert full, r
        times[r.doc_id, r.source, r.text] = times.get((r.doc_id, r.source, r.text), 0) + 1
    copies = {}
    for r in docs.collect():
        copies[r.doc_id, r.source, r.text] = copies.get((r.doc_id, r.source, r.text), 0) + 1
    assert all(n <= 3 * copies[k] for k, n in times.items() if k in copies)


def test_sql(spark):
    got = queries.op4_source_mixture(spark, SF).toPandas().sort_values("doc_id")
    duckdb.sql(f"create or replace view documents as from '{SF}/documents.parquet'")
    want = duckdb.sql(queries.OP4_SQL).df().sort_values("doc_id")
    assert got.values.tolist() == want[got.columns.tolist()].values.tolist()


def test_empty(spark, empty):
    assert mixture.plan_mixture(empty).count() == 0
