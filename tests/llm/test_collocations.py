from __future__ import annotations

import random
import re
from collections import Counter

from gridloom.llm import collocations, queries

from ..oracle import compare
from .conftest import DOCS, document


def brute(rows, least=10, covered=50, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        mine = f.setdefault(lang or "und", Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                mine.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, mine in f.items():
        cands = {p: a for p, a in mine.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if len(p) == 2 and any(100 * b >= covered * a for q, b in cands.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            s, k = min((1000000 * a * a // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def answer(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark, odd):
    rng = random.Random(4)
    rows = [document(k, "".join(rng.choice(["The ", "of ", "a\t", "b", "b ", "É x. ", "new york city ", "york, ", "\n"]) for _ in range(120)), rng.choice(["en", "fr", None, "und"])) for k in range(60)]
    rows += [rows[0]] * 20 + [document(99, "aa aa aa aa " * 30, "xx"), document(99, "p q p q p " * 30, "xx")]
    df = spark.createDataFrame(rows, DOCS).unionByName(odd)
    want = brute([(r.text, r.lang) for r in df.collect()])
    assert len(want) > 50
    assert answer(collocations.collocations(df)) == want
    assert answer(collocations.collocations(df, top=5)) == [w for w in want if w[1] <= 5]


def test_split_pivots_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([document(k, " ".join(rng.choice("abcdef") for _ in range(200))) for k in range(40)], DOCS)
    monkeypatch.setattr(collocations, "SPLIT", 100)
    assert answer(collocations.collocations(df)) == brute([(r.text, r.lang) for r in df.collect()])


def test_empty(spark, empty):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([document(1, None), document(2, "")], DOCS)).collect() == []


def test_scores_are_exact(spark):
    rows = [(10**15 - 3, 10**15 - 1, 10**15 - 2), (10, 10, 10), (7 * 10**12, 10**13 + 1, 10**13 + 9), (10, 3 * 10**14, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r[0] for r in df.select(collocations.score(df.a, df.l, df.r)).collect()]
    assert got == [1000000 * a * a // (x * y) for a, x, y in rows]


def test_query(spark):
    compare(spark, queries.op13_collocations, queries.ORACLE_SQL["op13_collocations"], "/root/testdata/sf0.01")
