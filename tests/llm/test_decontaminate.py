from __future__ import annotations

import math
import random

import numpy as np
import pytest

from gridloom.llm import decontaminate
from gridloom.llm.wordhash import shingles, word_hashes

from .conftest import DOCS, document, prose

ITEMS = "item_id long, text string, extra string"


def plain_best(docs, items, least):
    """Every window of every document against every item."""
    hashed = [(i, shingles(word_hashes(t or ""), 5).tolist(), len(word_hashes(t or ""))) for i, t in items]
    hashed = [(i, h, n) for i, h, n in hashed if n]
    df = {}
    for _, h, _ in hashed:
        for x in set(h):
            df[x] = df.get(x, 0) + 1
    # A shingle that the item lacks weighs as if no item had it.
    weight = lambda x, h: 1 + math.log((1 + len(hashed)) / (1 + (df[x] if x in h else 0)))
    out = {}
    for d, t in docs:
        words = word_hashes(t or "")
        for i, h, n in hashed:
            size = min(n, len(words))
            for s in range(len(words) - size + 1 if len(words) else 0):
                w = shingles(words[s : s + size], min(5, n)).tolist()
                if not set(h) & set(w):
                    continue
                both = set(h) | set(w)
                sim = sum(weight(x, h) * min(h.count(x), w.count(x)) for x in both) / sum(weight(x, h) * max(h.count(x), w.count(x)) for x in both)
                sim = round(sim, 12)
                if sim >= least and sim > out.get((d, i), (0,))[0]:
                    out[d, i] = (sim, s, size)
    return out


@pytest.fixture
def leaky(spark, odd):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(12, 50), 3000)) for i in range(12)] + [(50, "three word item"), (51, ""), (52, None), (53, "Solo!")]
    rows = []
    for d in range(100, 140):
        parts = [prose(rng, rng.randrange(0, 60), 3000)]
        if d % 2:
            words = rng.choice(items[:12])[1].split()
            if d % 4 == 1:
                words[0] = "other"
            parts.append(" ".join(words).title() + ".")
        rows.append(document(d, " ".join([*parts, prose(rng, rng.randrange(0, 30), 3000)])))
    rows += [document(150, "here is the Three, word item; again"), document(151, "three word"), document(152, "solo")]
    return spark.createDataFrame(rows, DOCS).union(odd), spark.createDataFrame([(*x, "e") for x in items], ITEMS), items


def test_against_brute_force(spark, leaky):
    docs, items, plain_items = leaky
    docs = docs.where("doc_id is null or doc_id != 6")  # the long text would take the plain search minutes
    found = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in decontaminate.find_leaks(docs, items).collect()}
    want = plain_best([(r.doc_id, r.text) for r in docs.collect()], plain_items, 0.8)
    assert set(found) == set(want) and len(want) > 15
    for k, (sim, start, n) in found.items():
        assert sim == pytest.approx(want[k][0]) and (start, n) == want[k][1:]


def test_kept(spark, leaky, empty):
    docs, items, plain_items = leaky
    kept = decontaminate.without_leaks(docs, items)
    dirty = {r.doc_id for r in decontaminate.find_leaks(docs, items).collect()}
    assert 6 not in dirty and len(dirty) > 15
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in dirty)
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_blocks_of_items(spark, leaky, monkeypatch):
    docs, items, _ = leaky
    rows = lambda: sorted(tuple(r) for r in decontaminate.find_leaks(docs, items).collect())
    whole = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert len(decontaminate.blocks(items, "item_id", "text")) > 2
    assert rows() == whole


def benchmark(items):
    rows = []
    for i, t in items:
        h, n = np.unique(shingles(word_hashes(t), 5), return_counts=True)
        rows.append((i, len(word_hashes(t)), h.tolist(), n.tolist(), [1] * len(h)))
    return decontaminate.Benchmark(rows, len(rows))


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(3)
    block = benchmark([(i, prose(random.Random(i), 30, 3000)) for i in range(300)])
    asked = block.prints[rng.integers(0, 300, 200)].copy()
    for row in asked:
        for bit in rng.choice(128, rng.integers(0, 40), replace=False).tolist():
            row[bit // 64] ^= np.uint64(1 << (bit % 64))
    apart = np.bitwise_count(asked[:, None, :] ^ block.prints[None, :, :]).sum(axis=2)
    assert set(zip(*(x.tolist() for x in block.within(asked)))) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS))))
    assert decontaminate.packed(np.array([[1.0] + [-1.0] * 127])).tolist() == [[1 << 63, 0]]


def test_the_index_is_selective():
    """Of 20,000 random fingerprints, the blocks hold a small part for a window."""
    rng = np.random.default_rng(4)
    block = benchmark([(0, "some words of one item")])
    block.ids = list(range(20_000))
    block.index(rng.integers(0, 2**64, (20_000, 2), dtype=np.uint64))
    asked = rng.integers(0, 2**64, (20, 2), dtype=np.uint64).view(np.uint16).reshape(20, 8)
    met = sum(int((block.begins[b][(asked[:, b, None] ^ decontaminate._BALL).astype(int) + 1] - block.begins[b][asked[:, b, None] ^ decontaminate._BALL]).sum()) for b in range(8))
    assert met / (20 * 20_000) < 0.1


def test_recall_at_the_similarity():
    """Windows of just the similarity are within the radius."""
    rng, found, tried = random.Random(12), 0, 0
    for n in [12, 20, 40, 80] * 40:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        block = benchmark([(0, " ".join(words))])
        last = words  # words after the cut are others: the longest cut that stays at 0.8
        for cut in range(1, n):
            other = words[:-cut] + [f"x{rng.randrange(10**6)}" for _ in range(cut)]
            if block.similarity(0, shingles(word_hashes(" ".join(other)), 5).tolist()) < 0.8:
                break
            last = other
        if block.similarity(0, shingles(word_hashes(" ".join(last)), 5).tolist()) < 1:
            tried += 1
            found += bool(block.search("before " + " ".join(last) + " after it", 0.8))
    assert tried > 100 and found / tried >= 0.97


def test_a_shared_opening_costs_no_more_with_more_items():
    rng = random.Random(2)
    opening = [f"o{i}" for i in range(8)]
    made = []
    for count in (200, 2000):
        rows = []
        for k in range(count):
            words = decontaminate.word_hashes(" ".join(opening + [f"w{rng.randrange(10**6)}" for _ in range(20 + k % 5)]))
            h, n = np.unique(decontaminate.shingles(words, decontaminate.SHINGLE), return_counts=True)
            rows.append((k, len(words), h.tolist(), n.tolist(), [1] * len(h)))
        held = decontaminate.Benchmark(rows, count)
        made.append(max(len(x) for x in held.lengths_with.values()))
    assert made == [5, 5]  # steps of a hit on the opening: lengths, not items
