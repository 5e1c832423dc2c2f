from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import ngram_model as model

from .conftest import DOCS, document, prose


def words(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def plain_score(text, before, pair, floor):
    """The model with exact sets of n-grams in place of the filter."""
    quantised = lambda n: float(model.level_count(model.level(np.array([n])))[0]) if n else 0.0
    out, last = 0.0, b"\n"
    for w in words(text):
        context = quantised(before[last])
        out += math.log10((min(quantised(pair[last, w]), context) + model.KAPPA * (quantised(before[w]) + 1) / floor) / (context + model.KAPPA))
        last = w
    return out


@pytest.mark.parametrize("chunk", [4_000_000, 300])
def test_scores_against_brute_force(spark, odd, monkeypatch, chunk):
    monkeypatch.setattr(model, "CHUNK", chunk)
    monkeypatch.setattr(model, "SLICE", 1 << 15)
    rng = random.Random(1)
    docs = spark.createDataFrame([document(100 + i, prose(rng, rng.randrange(60), 300)) for i in range(80)], DOCS).union(odd)
    docs = docs.selectExpr("*", "coalesce(doc_id % 7 = 2, false) as held_out").cache()
    got, rows = model.score(docs).collect(), docs.collect()
    training = [words(r.text) for r in rows if not r.held_out]
    c, pair = Counter(w for t in training for w in t), Counter(p for t in training for p in zip([b"\n", *t], t))
    n, v = sum(c.values()), len(c)
    want = sorted(((r.doc_id, r.held_out, len(words(r.text)), sum(c[w] > 0 for w in words(r.text)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r.text)), 4), plain_score(r.text, c, pair, n + v + 1)) for r in rows), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.score) for r in got), key=str)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    # Errors of the filter only raise counts, and seldom: most scores are the same, all are near.
    off = [abs(g[6] - w[6]) / g[2] for g, w in zip(got, want, strict=True)]
    assert all(g[6] < 0 for g in got) and max(off) < 0.5 and np.mean(off) < 0.04


def test_filter_has_every_level_and_few_others():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**48, 20_000, dtype=np.uint64)
    true = model.level(rng.zipf(1.6, len(values)).astype(np.int64).clip(1, 10**6))
    found = model.probed(model.filter_words(values, true), values)
    assert (found >= true).all() and (found == true).mean() > 0.95
    assert (model.probed(model.filter_words(values, true), rng.integers(0, 2**48, 20_000, dtype=np.uint64)) > 0).mean() < 0.08
    assert model.probed(model.filter_words(values[:0], true[:0]), values).max() == 0


def test_next_words_probabilities_add_up():
    texts = [words("a b c a b d a c")] * 20
    c, pair = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip([b"\n", *t], t))
    level = lambda n: model.level(np.array([n]))[0] if n else 0
    for before in c:
        p = [10 ** model.log10_probability(*np.array([[level(c[w])], [level(c[before])], [level(pair[before, w])]]), sum(c.values()) + len(c) + 1)[0] for w in c]
        assert 0.75 < sum(p) < 1.25  # within the quantisation of the counts


def test_counts_survive_packing():
    for n in (0, 1, 1000):
        v = np.unique(np.random.default_rng(n).integers(0, 2**48, n, dtype=np.uint64))
        c = np.arange(len(v)) + 1
        a, b = model.unpacked(model.packed(v, c))
        assert a.tolist() == v.tolist() and b.tolist() == c.tolist()


def test_empty(spark, empty):
    assert model.score(empty.selectExpr("*", "false as held_out")).count() == 0
    one = spark.createDataFrame([document(1, "a word")], DOCS).selectExpr("*", "true as held_out")
    row = model.score(one).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
