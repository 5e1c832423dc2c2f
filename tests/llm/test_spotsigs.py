from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from gridloom.llm import spotsigs

from .conftest import DOCS, document

COMMON = ("the", "of", "and", "in", "to")


def text(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.3 else f"w{rng.randrange(500)}" for _ in range(n))


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_edited_and_next(spark, odd, parts):
    rng = random.Random(parts)
    docs = spark.createDataFrame([document(100 + 3 * i, text(rng, rng.randrange(0, 80))) for i in range(50)], DOCS).union(odd).repartition(parts)
    got = spotsigs.compare_edited(docs).collect()
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None}, reverse=True)
    first = {}
    for d, t in rows:
        first.setdefault(d, t)
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    nulls = {r.text or "" for r in docs.collect() if r.doc_id is None}
    for i, (d, t) in enumerate(rows):
        if d == 9:
            continue  # a repeated row is followed by its copy first
        followers = [rows[i + 1][1]] if i + 1 < len(rows) else nulls
        third = len(t) // 3
        edits = {t[: len(t) - third] + f[:third] for f in followers}
        r = by[d][0]
        hit = [e for e in edits if hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256]
        assert r.n_chars == len(t) and len(hit) == 1
        a, b = set(spotsigs.signatures(t).tolist()), set(spotsigs.signatures(hit[0]).tolist())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b))
        assert r.fingerprint == spotsigs.text_fingerprint(spotsigs.signatures(t))
        assert r.edited_fingerprint == spotsigs.text_fingerprint(spotsigs.signatures(hit[0]))
        if len(followers) == 1:
            n = set(spotsigs.signatures(rows[i + 1][1]).tolist())
            assert r.near_next == pytest.approx(len(a & n) / len(a | n))
    whole = {hashlib.sha256((t[: len(t) - len(t) // 3] + rows[0][1][: len(t) // 3]).encode()).hexdigest() for t in nulls}
    assert whole & {r.edited_sha256 for r in by[None]}  # the last is followed by the first


def test_signatures():
    a = spotsigs.signatures("The quick brown fox is on the lazy dog now")
    assert len(a) == 4 and (a == spotsigs.signatures("the QUICK, brown fox IS on the lazy dog now!")).all()
    assert len(spotsigs.signatures("")) == 1 and len(spotsigs.signatures("no7 anchor9 whatsoever3")) == 1
    assert spotsigs.likeness(a, a) == 1.0 and spotsigs.likeness(np.arange(10), np.arange(3), 0.5) == 0.0


def test_pairs_against_brute_force(spark, odd, empty):
    rng, rows = random.Random(7), []
    for i in range(80):
        words = text(rng, 120).split()
        rows.append(document(100 + 2 * i, " ".join(words)))
        words[rng.randrange(120)] = "w"
        rows.append(document(101 + 2 * i, " ".join(words)))
    docs = spark.createDataFrame(rows, DOCS).union(odd)
    sets = spotsigs.signature_sets(docs)
    got = {frozenset([(r.key_a, r.class_a), (r.key_b, r.class_b)]): r.likeness for r in spotsigs.near_pairs(sets).collect()}
    classes = {}
    for r in sets.collect():
        classes.setdefault(tuple(r.sigs), []).append(r.doc_id)
    named = {a: (hashlib.md5(",".join(map(str, a)).encode()).hexdigest(), min((x for x in ids if x is not None), default=None)) for a, ids in classes.items()}
    want = {}
    for a, b in combinations(named, 2):
        j = len(set(a) & set(b)) / len(set(a) | set(b))
        if j >= 0.8:
            want[frozenset([named[a], named[b]])] = j
    assert got == pytest.approx(want) and len(want) > 20
    assert any(None in ids and len(set(ids)) == 1 for ids in classes.values())
    assert spotsigs.near_pairs(spotsigs.signature_sets(empty)).count() == 0


def test_one_and_none(spark, empty):
    one = spotsigs.compare_edited(spark.createDataFrame([document(5, "the only one of its kind")], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.compare_edited(empty).count() == 0


def test_ids_of_other_types(spark):
    rows = [(f"d{i:03d}", f"the text of number {i} and no other") for i in range(50)] + [("", "the one with an empty id"), (None, "the one without")]
    for kind, name in (("string", str), ("double", lambda x: None if not x else float(x[1:]))):
        docs = spark.createDataFrame([(name(i) if i is not None else None, t) for i, t in rows], f"doc_id {kind}, text string").repartition(3)
        got = {r.doc_id: r.edited_sha256 for r in spotsigs.compare_edited(docs).collect()}
        ordered = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id if r.doc_id is not None else 0, ), reverse=True) if kind == "string" else []
        for a, b in zip(ordered, [*ordered[1:], ordered[0]] if ordered else []):
            third = len(a.text) // 3
            assert got[a.doc_id] == hashlib.sha256((a.text[: len(a.text) - third] + b.text[:third]).encode()).hexdigest()
        assert len(got) >= 50


def test_ids_of_one_prefix_are_dealt_over_many_tasks(spark):
    rows = spark.range(20_000).selectExpr("concat('document-', lpad(id, 8, '0')) as doc_id", "concat('the w', id, ' x') as text").union(spark.createDataFrame([(None, "no id"), ("document-00000007", "the same id")], "doc_id string, text string")).repartition(16)
    dealt, _ = spotsigs.followed(rows)
    sizes = sorted(r["count"] for r in dealt.groupBy("bucket").count().collect())
    assert len(sizes) >= 12 and sizes[-1] < 4 * 20_000 / len(sizes)
    got = {r.doc_id: r for r in spotsigs.compare_edited(rows).collect()}
    text = lambda i: f"the w{i} x"
    for i in (1, 5000, 12345, 19999):
        t, follower = text(i), text(i - 1)
        third = len(t) // 3
        assert got[f"document-{i:08}"].edited_sha256 == hashlib.sha256((t[: len(t) - third] + follower[:third]).encode()).hexdigest()
