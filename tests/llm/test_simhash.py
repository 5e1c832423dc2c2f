from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from gridloom.llm import simhash
from gridloom.llm.components import components

from .conftest import DOCS, document, prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if sum(x >> bit & 1 for x in h) * 2 > len(h))


def plain_components(rows):
    """Least id reachable, by comparing everything with everything."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


def copies(rng):
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    for i in range(60):
        words = texts[i].split()
        for _ in range(rng.randrange(4)):
            changed = list(words)
            changed[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(changed))
    return texts


def test_against_brute_force(spark, odd):
    docs = spark.createDataFrame([document(100 + i, t) for i, t in enumerate(copies(random.Random(2)))], DOCS).union(odd)
    got = simhash.link(docs).collect()
    source = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [(d, plain_fingerprint(t)) for d, t in source]
    want = [(d, f, c) for (d, f), c in zip(prints, plain_components(prints))]
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert len({c for *_, c in want}) < len({f for _, f, _ in want})  # some link


def test_grid_finds_every_pair_in_range(spark):
    rng = random.Random(4)
    points = set()
    for _ in range(400):
        x = rng.getrandbits(64)
        points.add(x)
        for _ in range(rng.randrange(3)):
            y = x
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                y ^= 1 << bit
            points.add(y)
    points = sorted(points)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    for size in (1000, 10**8):  # another shape of the grid
        edges = simhash.grid_edges(spark.createDataFrame([(x, x) for x in signed], "label long, fp0 long"), simhash.exact_grid(size, 4))
        root = {r.node % 2**64: r.root for r in components(edges).collect()}
        want = plain_components(list(enumerate(points)))
        got = {}
        for i, p in enumerate(points):
            got.setdefault(root.get(p, p if p < 2**63 else p - 2**64), []).append(i)
        assert sorted(map(min, got.values())) == sorted(set(want)) and {min(g): len(g) for g in got.values()} == {c: want.count(c) for c in set(want)}


def test_large_cells():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 12, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 300).astype(np.uint64)) for b in base]))
    a, b = simhash.cell_stars(np.zeros(len(fps), np.int64), fps, fps[:, None], 4)
    assert len(a) <= len(fps)
    want = plain_components(list(enumerate(fps.tolist())))
    root = dict(zip(a.tolist(), b.tolist()))
    assert len({root.get(x, x) for x in fps.tolist()}) == len(set(want))


def test_embedding_bounds_the_distance():
    x = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    e = simhash.embed(x)
    axes = lambda v: [(v >> (2 * i) & 3).bit_count() for i in range(32)]
    for i in range(0, 200, 2):
        a, b = int(x[i]), int(x[i + 1])
        assert [int(e[i]) >> (2 * k) & 3 for k in range(32)] == axes(a)
        assert int(simhash.manhattan(e[i], e[i + 1])) == sum(abs(p - q) for p, q in zip(axes(a), axes(b))) <= (a ^ b).bit_count()


def test_near_copies_by_similarity(spark):
    """Copies with a Jaccard index of 0.85 or more are found; unrelated texts are left alone."""
    rng, rows, pairs = random.Random(8), [], []
    for i in range(120):
        words = prose(rng, 150, 10_000).split()
        rows.append(document(2 * i, " ".join(words)))
        if i % 2:
            for _ in range(rng.randrange(1, 3)):
                words[rng.randrange(150)] = "changed"
            rows.append(document(2 * i + 1, " ".join(words) + " " + words[0]))
            pairs.append((2 * i, 2 * i + 1))
    docs = spark.createDataFrame(rows, DOCS)
    linked = simhash.near_copies(docs)
    got = {r.doc_id: r.component_id for r in linked.collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= len(pairs) - 1
    assert all(got[2 * i] == 2 * i for i in range(120))
    kept = {r.doc_id for r in simhash.one_of_each(docs, linked).collect()}
    assert kept == {d for d, c in got.items() if d == c}


def test_one_of_each(spark, odd, empty):
    kept = simhash.one_of_each(odd, simhash.link(odd))
    assert kept.columns == odd.columns
    # 1 stands for all without words
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "6", "7", "8", "9", "None"])
    assert simhash.one_of_each(empty, simhash.near_copies(empty)).count() == 0


@pytest.mark.parametrize("group", [500, 3])
def test_near_copies_against_brute_force(spark, odd, monkeypatch, group):
    """Links are exact Jaccard indices: pairs of 0.6 to 0.78 stay apart, and so do their ends in a chain; blocks of a large group lose none."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng, rows, n = random.Random(11), [], 100
    for i in range(150):
        words = prose(rng, 200, 10_000).split()
        for changed in ((0, 2, 9) if i % 3 else (0, 2, 4)):  # places apart from each other: five shingles each
            copy = list(words)
            for k in range(changed):
                copy[10 + 20 * k] = f"x{n}"
            rows.append(document(n, " ".join(copy)))
            n += 1
    words = prose(rng, 200, 10_000).split()
    for i in range(40):  # one large group: neighbours are near, ends are not
        words[5 * i : 5 * i + 5] = [f"y{i}"] * 5
        rows.append(document(n + i, " ".join(words)))
    docs = spark.createDataFrame(rows, DOCS).union(odd)
    sets = [(r.doc_id, frozenset(simhash.shingle_hashes(r.text or "", 5).tolist())) for r in docs.collect()]
    root = list(range(len(sets)))
    between = 0
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            jaccard = len(a & b) / len(a | b) if a | b else 1.0
            between += 0.6 <= jaccard < 0.8
            if jaccard >= 0.8 and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    groups = {}
    for (d, _), r in zip(sets, root):
        groups.setdefault(r, []).append(d)
    want = sorted((str(d), str(min((x for x in groups[r] if x is not None), default=None))) for (d, _), r in zip(sets, root))
    assert between > 100
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_copies(docs).collect()) == want


def test_similar_sets():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        for _ in range(rng.integers(1, 30)):
            kept = base.copy()
            kept[rng.integers(0, 40, rng.integers(0, 6))] = rng.integers(0, 2**63, dtype=np.uint64)
            sets.append(np.unique(kept))
    sets = [np.array(x, np.uint64) for x in sorted({tuple(x.tolist()) for x in sets})]
    got, want = simhash.similar_sets(sets, 0.8), list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(np.intersect1d(a, b))
            if shared / (len(a) + len(b) - shared) >= 0.8:
                want = [min(want[i], want[j]) if r in (want[i], want[j]) else r for r in want]
    assert len(set(want)) == len(set(got.tolist())) == len(set(zip(want, got.tolist()))) < len(sets)
