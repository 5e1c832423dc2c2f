"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits a lane is embedded as the bit counts of its two-bit
segments, 32 axes a lane. The Manhattan distance of two embeddings is never more
than the Hamming distance of the fingerprints. A grid lays cells over choices of
axes; points that agree on all axes of a choice share its cell. In a cell, pairs
pass the Manhattan bound first and the exact Hamming distance after it.

``link`` has one lane and a small radius ``r``: the axes are dealt into groups,
two points within distance ``r`` agree on at least ``groups - r`` of them
entirely, and every choice of that many groups is a grid, so no pair in range is
missed. ``near_copies`` is stated by a similarity instead: four lanes, the radius
that the similarity's angle gives, and random choices of axes find candidates;
the shingle sets of what hangs together by them are compared, and only an exact
Jaccard index of the similarity or more links. Measured on random sets of 10 to
1000 shingles, the candidates have README's share of the pairs at just the
similarity. What hangs together by candidates is compared in blocks of about
``GROUP`` sets, two blocks a task, so a large group neither fills a task nor loses a link.

Equal fingerprints are one point, so copies cost nothing. A cell yields a
spanning star of each of its linked sets and no list of pairs; the components
come from the stars of all cells.

Defined results: a null or empty text, or one of white space, has fingerprint 0
and links like any other; fewer words than a shingle's make one shingle of all;
a null id never becomes a component's id unless all its ids are null; repeated
rows are copies of each other; an empty table gives an empty result; other
columns are ignored by ``link`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import map_columns, stage, texts
from .wordhash import mix

SEGMENTS = 32
#: Lanes of a fingerprint that stands for a similarity, and the chance that a pair at that similarity's mean distance shares a cell.
LANES, FOUND = 4, 0.999
_PAIRS = 0x5555555555555555
#: Points of a cell up to which pairs are compared at every distance at once, and links held before they are joined.
SMALL_CELL, LINKS = 256, 500_000
#: Sets of a block in which those of a large group are compared.
GROUP = 500


def shingle_hashes(text: str, size: int, seed: int = 42) -> np.ndarray:
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line, digest = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(stops[:-1] + 1).tolist()]
    ends = stops[min(size, len(words)) - 1 :].tolist()
    return np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, ends)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Bits set in over half of the hashes, a 64-bit number a lane; the first lane is of the hashes as they are."""
    if not len(hashes):
        return np.zeros(lanes, np.uint64)
    total = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 255 * 16):
        h = hashes[at : at + 255 * 16]
        wide = np.stack([h, *(mix(h + np.uint64(i)) for i in range(1, lanes))], axis=1)
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
        for i in range(0, len(h), 255):  # sums of 255 bits fit a byte
            total += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, size: int, lanes: int = 1, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp0, ...`` (a signed long a lane) for every row; with ``repeats``, a shingle counts as often as it occurs.

    Without, ``shingles`` (a hash of the set) comes with them.
    """
    names = [f"fp{i}" for i in range(lanes)]

    def work(batches):
        for b in batches:
            found, sets = [], []
            for t in texts(b["text"]):
                hashes = shingle_hashes(t, size)
                if not repeats:
                    hashes = np.unique(hashes)
                    sets.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                found.append(fingerprint(hashes, lanes))
            found = np.array(found, np.uint64).reshape(-1, lanes).view(np.int64)
            out = {"doc_id": b["doc_id"], "text_hash": b["text_hash"]} | {n: found[:, i] for i, n in enumerate(names)}
            yield out if repeats else out | {"shingles": np.array(sets, np.uint64).view(np.int64)}

    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return map_columns(asked, work, f"doc_id {kind}, text_hash long, " + ", ".join(f"{n} long" for n in (names if repeats else [*names, "shingles"])))


@dataclass
class Grid:
    """Choices of axes, each a mask a lane over the packed embedding, and the radius to verify."""

    lanes: int
    radius: int
    choices: list[tuple[int, ...]]
    #: Choices of the first round. What it links is one label after it, so large groups send no more edges in the second.
    first: int | None = None

    def rounds(self) -> list[list[tuple[int, ...]]]:
        return [r for r in (self.choices[: self.first], self.choices[len(self.choices) if self.first is None else self.first :]) if r]


def exact_grid(points: int, radius: int) -> Grid:
    """Every pair within ``radius`` bits: the fewest cells a point that keep chance neighbours below 64 a cell.

    A two-bit segment's count has 1.5 bits of entropy.
    """
    groups = next((g for g in range(radius + 1, SEGMENTS) if points / 2 ** (1.5 * SEGMENTS * (g - radius) / g) <= 64), SEGMENTS)
    masks = [0] * groups
    for axis in range(SEGMENTS):
        masks[axis % groups] |= 3 << (2 * axis)
    return Grid(1, radius, [(sum(masks[i] for i in c),) for c in combinations(range(groups), groups - radius)])


def similarity_grid(points: int, similarity: float, seed: int = 1) -> Grid:
    """Pairs of a Jaccard similarity: the share of differing bits is its angle's, and 2.5 deviations more are let in.

    Choices have 11 axes, more only where chance neighbours would exceed 256 a cell.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * LANES
    radius = round(bits * share + 2.5 * math.sqrt(bits * share * (1 - share)))
    axes = max(11, math.ceil(math.log2(max(points, 1) / 256 + 1) / 1.5))
    agree = ((1 - share) ** 2 + share**2 / 2) ** axes
    rng = np.random.default_rng(seed)
    choices = []
    for _ in range(math.ceil(math.log(1 - FOUND) / math.log(1 - agree))):
        masks = [0] * LANES
        for axis in rng.choice(SEGMENTS * LANES, axes, replace=False).tolist():
            masks[axis // SEGMENTS] |= 3 << (2 * (axis % SEGMENTS))
        choices.append(tuple(masks))
    return Grid(LANES, radius, choices, first=4)


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, packed two bits each."""
    pairs = np.uint64(_PAIRS)
    return (fp & pairs) + (fp >> np.uint64(1) & pairs)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed embeddings: differing axes count once, axes that differ by two once more."""
    x, pairs = a ^ b, np.uint64(_PAIRS)
    high = x >> np.uint64(1)
    return np.bitwise_count((x | high) & pairs) + np.bitwise_count(high & ~x & pairs)


def near(a, b, ea, eb, radius: int) -> np.ndarray:
    """Rows of ``a`` (a column a lane) within ``radius`` bits of ``b``'s, which may be one row."""
    found = np.flatnonzero(manhattan(ea, eb).sum(axis=1, dtype=np.int64) <= radius)
    other = b[found] if np.ndim(b) > 1 else b
    return found[np.bitwise_count(a[found] ^ other).sum(axis=1, dtype=np.int64) <= radius]


def cell_stars(cells: np.ndarray, ids: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, root's id) that connect what is linked inside each cell. Equal cells are adjacent; ``fps`` has a column a lane; rows of one id are linked already."""
    e = embed(fps)
    bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    sizes = np.diff(bounds)
    root = np.arange(len(fps))
    of = np.repeat(np.arange(len(sizes)), sizes)
    left, links = np.flatnonzero(sizes[of] <= SMALL_CELL), []
    for step in range(1, int(min(SMALL_CELL, sizes.max(initial=0)))):
        left = left[left + step < len(fps)]
        left = left[of[left + step] == of[left]]
        if not len(left):
            break
        hit = left[near(fps[left], fps[left + step], e[left], e[left + step], radius)]
        links.append((hit, hit + step))
        if sum(len(x) for x, _ in links) > LINKS:
            links = _union(root, links)
    _union(root, links)
    for k in np.flatnonzero(sizes > SMALL_CELL):
        _flood(root, np.arange(bounds[k], bounds[k + 1]), fps, e, radius)
    linked = np.flatnonzero(ids != ids[root])
    return ids[linked], ids[root[linked]]


def _union(root: np.ndarray, links: list) -> list:
    """Least index reachable over the links, in place; no links are left."""
    a = np.concatenate([np.empty(0, np.int64), *(x for x, _ in links)])
    b = np.concatenate([np.empty(0, np.int64), *(x for _, x in links)])
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root[:] = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return []


def _flood(root: np.ndarray, members: np.ndarray, fps: np.ndarray, e: np.ndarray, radius: int) -> None:
    """Breadth-first search in a large cell: what is found leaves the rest, so dense sets go fast."""
    rest = members
    while len(rest):
        start, rest = rest[0], rest[1:]
        front = [start]
        while front and len(rest):
            at = front.pop()
            hit = near(fps[rest], fps[at], e[rest], e[at], radius)
            if len(hit):
                root[rest[hit]] = start
                front += rest[hit].tolist()
                rest = np.delete(rest, hit)


def grid_edges(points: DataFrame, grid: Grid, chosen: list[tuple[int, ...]] | None = None) -> DataFrame:
    """``points(label, fp0, ...)``, distinct, to edges ``(a, b)`` between labels with the components of all pairs that the choices find."""
    names = [f"fp{i}" for i in range(grid.lanes)]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    choices = F.array(*[F.struct(F.lit(i).alias("i"), *[signed(m).alias(n) for m, n in zip(c, names)]) for i, c in enumerate(chosen or grid.choices)])
    # Only the hash of the cell travels: cells that share one are compared together, which adds no wrong pair.
    cells = F.transform(choices, lambda c: F.xxhash64(c["i"], *[c[n].bitwiseAND(F.col(f"packed_{n}")) for n in names]))
    packed = points.select("label", *names, *[_packed(n).alias(f"packed_{n}") for n in names])
    placed = packed.select(F.explode(cells).alias("cell"), "label", *names)

    def work(batches):
        cells, ids, fps = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, grid.lanes), np.uint64)
        for b in batches:
            cells, ids = np.r_[cells, b["cell"].to_numpy()], np.r_[ids, b["label"].to_numpy()]
            fps = np.vstack([fps, np.column_stack([b[n].to_numpy().view(np.uint64) for n in names])])
            if len(cells) < 50_000:
                continue
            whole = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
            if whole:
                yield _edges(cells[:whole], ids[:whole], fps[:whole], grid.radius)
                cells, ids, fps = cells[whole:], ids[whole:], fps[whole:]
        if len(cells):
            yield _edges(cells, ids, fps, grid.radius)

    return map_columns(placed.repartition("cell").sortWithinPartitions("cell"), work, "a long, b long", rows=20_000)


def _packed(name: str):
    """Bit counts of the two-bit segments, packed: low bit and high bit added field by field."""
    low, high = F.col(name).bitwiseAND(F.lit(_PAIRS)), F.shiftrightunsigned(name, 1).bitwiseAND(F.lit(_PAIRS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _edges(cells, ids, fps, radius):
    a, b = cell_stars(cells, ids, fps, radius)
    return {"a": a, "b": b}


def link(docs: DataFrame, radius: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents within ``radius`` of 64 bits: ``doc_id, text_hash, fp, component_id, first`` for every row.

    ``first``: whether it is its component's first document.
    """
    return _linked(fingerprints(docs, size, 1, True, id_col, text_col), lambda n: exact_grid(n, radius)).withColumnRenamed("fp0", "fp")


def near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose sets of shingles have a Jaccard index of ``similarity`` or more: ``doc_id, text_hash, component_id, first``."""
    prints, rooted = _candidates(fingerprints(docs, size, LANES, False, id_col, text_col), lambda n: similarity_grid(n, similarity))
    order = _order()
    sets = stage(prints.join(rooted.select("point", "root"), "point").groupBy("root", "shingles").agg(F.min(order).alias("least")), "sets")
    # Written first: the join's sides then come straight from shuffles, and Spark can split a hot group.
    several = stage(sets.groupBy("root").count().where("count > 1").select("root", F.ceil(F.col("count") / GROUP).cast("int").alias("blocks")), "several")
    asked = sets.join(several, "root").select("root", "shingles", "blocks", F.col("least.doc_id").alias("__id"), F.col("least.text_hash").alias("__hash"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    # Each block of a group meets each other block (and itself) in one task.
    own = F.pmod(F.xxhash64("shingles"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least(c, own).alias("low"), F.greatest(c, own).alias("high")))
    rows = rows.select("root", "shingles", "text", F.explode(met).alias("met")).select("root", "met.low", "met.high", "shingles", "text")

    def verify(batches):
        at, held = None, {}
        for b in batches:
            for *key, name, text in zip(*(b[n].to_pylist() for n in ("root", "low", "high", "shingles")), texts(b["text"]), strict=True):
                if key != at:
                    if held:
                        yield links(held)
                    at, held = key, {}
                if name not in held:
                    held[name] = np.unique(shingle_hashes(text, size))
        if held:
            yield links(held)

    def links(held):
        names = np.array(list(held), np.int64)
        heads = names[similar_sets(list(held.values()), similarity)]
        return {"a": names[heads != names], "b": heads[heads != names]}

    edges = map_columns(rows.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high"), verify, "a long, b long")
    heads = components(edges).select(F.col("node").alias("shingles"), F.col("root").alias("head"))
    linked = sets.join(heads, "shingles", "left").select("shingles", "least", F.coalesce("head", "shingles").alias("head"))
    linked = stage(linked, "linked")
    firsts = stage(linked.groupBy("head").agg(F.min("least").alias("__first")), "firsts")
    classes = linked.join(firsts, "head").select("shingles", "__first")
    return prints.join(classes, "shingles").select("doc_id", "text_hash", F.col("__first.doc_id").alias("component_id"), (order == F.col("__first")).alias("first"))


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of some distinct sets of hashes, the index of one set of its component by Jaccard indices of ``similarity`` or more.

    Breadth-first over posting lists: what is found leaves the rest, and the lists are made anew when the rest has halved.
    """
    sizes = np.array([len(x) for x in sets])
    stops = np.cumsum(sizes)
    kinds, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    root, rest = np.arange(len(sets)), np.ones(len(sets), bool)
    left, listed = len(sets), len(sets) * 2 + 1
    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start], front = False, [start]
        left -= 1
        while front and left:
            if left * 2 < listed:
                mine = np.flatnonzero(rest[owners])
                mine = mine[np.argsort(tokens[mine], kind="stable")]
                of, bounds, listed = owners[mine], np.searchsorted(tokens[mine], np.arange(len(kinds) + 1)), left
            at = front.pop()
            own = tokens[stops[at] - sizes[at] : stops[at]]
            long = bounds[own + 1] - bounds[own]
            near_ = of[np.repeat(bounds[own] - np.cumsum(long) + long, long) + np.arange(long.sum())]
            other, shared = np.unique(near_[rest[near_]], return_counts=True)
            hit = other[shared / (sizes[at] + sizes[other] - shared) >= similarity]
            rest[hit], root[hit] = False, start
            left -= len(hit)
            front += hit.tolist()
    return root


def _order():
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")


def _candidates(found: DataFrame, grid_for) -> tuple[DataFrame, DataFrame]:
    """The staged fingerprints with their ``point``, and ``point, least, root`` of all points: one root for all that hangs together."""
    names = [n for n in found.columns if n.startswith("fp")]
    point = F.col("fp0") if len(names) == 1 else F.xxhash64(*names)
    prints = stage(found.withColumn("point", point), "fingerprints")
    points = stage(prints.groupBy("point", *names).agg(F.min(_order()).alias("least")).withColumn("label", F.col("point")), "points")
    grid = grid_for(points.count())
    for chosen in grid.rounds():
        roots = components(grid_edges(points.select("label", *names), grid, chosen))
        joined = points.join(roots, points.label == roots.node, "left")
        points = stage(joined.select("point", *names, "least", F.coalesce("root", "label").alias("label")), "points")
    return prints, points.select("point", "least", F.col("label").alias("root"))


def _linked(found: DataFrame, grid_for) -> DataFrame:
    prints, rooted = _candidates(found, grid_for)
    names, order = [n for n in prints.columns if n.startswith("fp")], _order()
    firsts = stage(rooted.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    classes = rooted.join(firsts, "root").select("point", F.col("first").alias("__first"))
    return prints.join(classes, "point").select("doc_id", "text_hash", *names, F.col("__first.doc_id").alias("component_id"), (order == F.col("__first")).alias("first"))


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, linked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates that ``link`` or ``near_copies`` found: each group's first document stays, once."""
    names = docs.columns
    kept = linked.where("first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__text", F.xxhash64(text_col))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    return rows.dropDuplicates([id_col, "__text"]).select(*names)
