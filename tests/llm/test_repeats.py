from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import repeats

from .conftest import DOCS, document, prose


def plain(rows, length):
    """By counting every byte string of the length."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("length", [400, 250])
def test_against_brute_force(spark, odd, length):
    rng = random.Random(length)
    shared = [prose(rng, n) for n in (60, 80, 100, 200)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(1, 150)), rng.choice(shared)[rng.randrange(40) :], prose(rng, 20), rng.choice(shared)]
        rows.append(document(100 + i, " ".join(parts[: rng.randrange(1, 5)])))
    rows += [document(200, "a" * 450), document(201, "b" * 399 + "a" * 401), document(202, "xyz" * 300), document(203, "é" * 250), document(204, rows[0][1])]
    docs = spark.createDataFrame(rows, DOCS).union(odd.where("doc_id is null or doc_id != 6")).repartition(5, "doc_id").cache()
    want = plain([(r.doc_id, r.text) for r in docs.collect()], length)
    assert got(repeats.find_repeats(docs, length)) == want
    assert any(r[2] for r in want)


def test_exactly_at_the_length(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(400))
    for cut, removed in ((0, 400), (1, 0)):
        rows = [document(1, "x" * 30 + passage + "y" * 50), document(2, "z" * 77 + passage[cut:] + "w" * 9)]
        docs = spark.createDataFrame(rows, DOCS).repartition(2, "doc_id").cache()
        assert [r[2] for r in got(repeats.find_repeats(docs))] == [removed, removed]


def test_names_travel():
    rng = np.random.default_rng(1)
    for values in ([], [5], [1, 2, 2**63, 2**63], list(range(0, 10**6, 999))):
        high = np.array(values, np.uint64)
        high, low, many, at = repeats.distinct(high, rng.integers(0, 3, len(high)).astype(np.uint64))
        rows = repeats.named(high, low, many, 3, 7)
        found = [repeats.names_of(x) for x in rows["blob"]]
        assert rows["slice"] == sorted(set(rows["slice"])) and set(rows["shard"]) <= {3}
        for i, want in enumerate((high, low, many)):
            assert np.concatenate([want[:0], *(f[i] for f in found)]).tolist() == want.tolist()
        assert sorted(set(at.tolist())) == list(range(len(high)))


def test_common_prefixes(spark):
    """Shorter repeats show in ``longest_repeat``: never more than the longest common string, and close to it."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = letters(360)
    rows = [document(1, letters(900) + passage + letters(300)), document(2, letters(70) + passage), document(3, letters(2000)), document(4, "tiny"), document(5, "tiny")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3, "doc_id").cache()
    found = {r.doc_id: (r.n_removed, r.longest_repeat) for r in repeats.find_repeats(docs).collect()}
    assert all(x[0] == 0 for x in found.values())
    assert found[3][1] == 0 and found[4][1] == found[5][1] == 4
    assert all(100 <= found[i][1] <= 360 for i in (1, 2))


def test_empty_and_short_lengths(spark, empty):
    assert repeats.find_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        repeats.window(50)
