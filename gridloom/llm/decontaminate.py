"""Benchmark decontamination by item-sized SimHash windows.

Windows of a document that have as many words as a benchmark item get a SimHash of
their weighted shingles, ``BITS`` bits. A multi-index of the items' fingerprints
(``BLOCKS`` blocks of 16 bits; two fingerprints within ``RADIUS`` bits have a block
that differs in ``RADIUS // BLOCKS`` at most) yields every item within the radius,
and the exact weighted Jaccard index of the shingle bags verifies it. Windows that
can't reach the similarity are left out first: their shingles that any item has
weigh too little against the others.

A shingle weighs ``1 + ln((1 + items) / (1 + items that have it))``, counted over
the whole benchmark; one that the compared item lacks, as if no item had it.

A benchmark is the stated query set. It is cut by hash into blocks of about
``BLOCK_WORDS`` words, each made by one task and written to the shared folder;
workers hold one block at a time, and the documents are read once a block.

Defined results: null or empty texts and items match nothing; an item of fewer
words than a shingle is one shingle of all; a shorter document is one window;
null ids are kept; repeated rows each give their rows; an empty table or
benchmark gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import grouped, map_columns, read_whole, stage, stage_path, texts, write_whole
from .wordhash import mix, shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8, 19 of 128 bits differ on average, with a deviation of 4.
LANES, BLOCKS, RADIUS = 2, 8, 31
BITS = 64 * LANES
BLOCK_WORDS = 2_000_000

#: What a block's value may differ by.
_BALL = np.array([sum(1 << i for i in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), n)], np.uint16)


def bit_signs(hashes: np.ndarray) -> np.ndarray:
    """A row of plus or minus ones for each hash."""
    lanes = np.stack([mix(hashes + np.uint64(i)) for i in range(LANES)], axis=1)
    return np.unpackbits(lanes.astype(">u8").view(np.uint8).reshape(len(hashes), -1), axis=1).astype(np.float64) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of sums: a column a lane."""
    return np.packbits(sums > 1e-9, axis=1).view(">u8").astype(np.uint64).reshape(len(sums), LANES)


class Benchmark:
    """Shingles, weights and the multi-index of one block of items."""

    def __init__(self, rows: list[tuple], total: int):
        """``rows`` of (id, words, shingle hashes, how often each occurs, how many of all ``total`` items have it)."""
        self.ids = [r[0] for r in rows]
        self.lengths = [r[1] for r in rows]
        self.size = SHINGLE
        self.most = 1 + math.log(1 + total)
        self.bags = [dict(zip(r[2], r[3], strict=True)) for r in rows]
        self.weight = {h: 1 + math.log((1 + total) / (1 + n)) for r in rows for h, n in zip(r[2], r[4], strict=True)}
        #: Lengths of the items that have a shingle, each once: what a hit costs doesn't grow with the items that share it.
        self.lengths_with: dict[int, set[int]] = {}
        for n, b in zip(self.lengths, self.bags, strict=True):
            for h in b:
                self.lengths_with.setdefault(h, set()).add(n)
        #: Sizes of shingles (items shorter than one have their own), the shingles of each size in order, and their weights.
        gates: dict[int, list[int]] = {}
        for n, b in zip(self.lengths, self.bags, strict=True):
            gates.setdefault(min(n, self.size), []).extend(b)
        self.gates = {n: np.unique(np.array(h, np.uint64)) for n, h in gates.items()}
        self.gate_weights = {n: np.array([self.weight[h] for h in g.tolist()]) for n, g in self.gates.items()}
        sums = [(bit_signs(np.array(list(b), np.uint64)) * np.array([self.weight[h] * n for h, n in b.items()])[:, None]).sum(0) for b in self.bags]
        self.index(packed(np.array(sums).reshape(len(rows), BITS)))

    def index(self, prints: np.ndarray) -> None:
        """Items in the order of each block's value, and where a value begins."""
        self.prints = prints
        values = prints.view(np.uint16).reshape(len(prints), BLOCKS)
        self.order = np.argsort(values, axis=0, kind="stable")
        self.begins = [np.searchsorted(values[self.order[:, b], b], np.arange((1 << 16) + 1)).astype(np.int32) for b in range(BLOCKS)]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``prints``, item) that differ in ``RADIUS`` bits at most: all there are."""
        values, pairs = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), BLOCKS), []
        for b in range(BLOCKS):
            near = values[:, b, None] ^ _BALL
            first, n = self.begins[b][near], self.begins[b][near.astype(np.int32) + 1]
            n = n - first
            row, at = np.nonzero(n)
            first, n = first[row, at], n[row, at]
            item = self.order[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n), b]
            pairs.append(np.repeat(row, n) * len(self.ids) + item)
        found = np.unique(np.concatenate(pairs))
        row, item = found // len(self.ids), found % len(self.ids)
        close = np.bitwise_count(prints[row] ^ self.prints[item]).sum(axis=1) <= RADIUS
        return row[close], item[close]

    def similarity(self, k: int, window: list[int]) -> float:
        """Weighted Jaccard index of an item's bag and a window's."""
        a, b = self.bags[k], {}
        for h in window:
            b[h] = b.get(h, 0) + 1
        low = sum(self.weight[h] * min(a[h], n) for h, n in b.items() if h in a)
        high = sum(self.weight[h] * max(n, b.get(h, 0)) for h, n in a.items()) + self.most * sum(n for h, n in b.items() if h not in a)
        return round(low / high, 12)

    def search(self, text: str, least: float) -> dict[int, tuple[float, int, int]]:
        """Item -> (similarity, first word, words) of its best window, the first of several."""
        best: dict[int, tuple[float, int, int]] = {}
        if not self.ids or not text:
            return best
        words = word_hashes(text)
        for n, gate in self.gates.items():
            if not len(words):
                break
            h = shingles(words, n)
            at = np.minimum(np.searchsorted(gate, h), len(gate) - 1)
            hit = gate[at] == h
            if hit.any():
                self._windows(len(words), h, hit, np.where(hit, self.gate_weights[n][at], 0), n, least, best)
        return best

    def _windows(self, n_words: int, h, hit, weights, n: int, least: float, best: dict) -> None:
        """Windows of the length of each item hit that hold the hit and can reach the similarity."""
        starts: dict[int, set[int]] = {}
        for p in np.flatnonzero(hit).tolist():
            for item_words in self.lengths_with[int(h[p])]:
                length = min(item_words, n_words)
                first, last = max(0, p - max(0, length - n)), min(p, n_words - length)
                starts.setdefault(length, set()).update(range(first, last + 1))
        known, unknown = np.r_[0, np.cumsum(weights)], np.r_[0, np.cumsum(~hit)]
        for length, found in starts.items():
            first = np.array(sorted(found))
            in_window = max(1, length - n + 1)
            stop = np.minimum(first + in_window, len(h))
            first = first[(known[stop] - known[first]) * (1 - least) >= (unknown[stop] - unknown[first]) * self.most * least - 1e-9]
            # Running sums over each stretch of adjacent windows.
            for stretch in np.split(first, np.flatnonzero(np.diff(first) > in_window) + 1) if len(first) else ():
                a, b = int(stretch[0]), min(int(stretch[-1]) + in_window, len(h))
                signs = bit_signs(h[a:b]) * np.where(hit[a:b], weights[a:b], self.most)[:, None]
                sums = np.vstack([np.zeros(BITS), np.cumsum(signs, axis=0)])
                prints = packed(sums[np.minimum(stretch - a + in_window, b - a)] - sums[stretch - a])
                for row, k in zip(*(x.tolist() for x in self.within(prints))):
                    s = int(stretch[row])
                    if min(self.lengths[k], n_words) == length:
                        sim = self.similarity(k, h[s : s + in_window].tolist())
                        if sim >= least and (k not in best or (sim, -s) > (best[k][0], -best[k][1])):
                            best[k] = (sim, s, length)


_held: dict[str, Benchmark] = {}


def opened(path: str) -> Benchmark:
    """A worker holds one block at a time."""
    if path not in _held:
        _held.clear()
        _held[path] = pickle.loads(read_whole(path))
    return _held[path]


def blocks(items: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Where the written blocks of a benchmark are."""
    kind = items.schema[id_col].dataType.simpleString()

    def cut(batches):
        for b in batches:
            words = [word_hashes(t) for t in texts(b["text"])]
            bags = [np.unique(shingles(w, SHINGLE), return_counts=True) for w in words]
            yield {"item": b["item"], "n_words": [len(w) for w in words], "h": [x.view(np.int64) for x, _ in bags], "n": [c for _, c in bags]}

    rows = map_columns(items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), cut, f"item {kind}, n_words int, h array<long>, n array<int>")
    rows = stage(rows.where("n_words > 0").withColumn("row", F.monotonically_increasing_id()), "items")
    total, words = rows.agg(F.count("*"), F.sum("n_words")).collect()[0]
    count, root = 1 + (words or 0) // BLOCK_WORDS, stage_path(items.sparkSession, "benchmark")
    each = rows.select("row", F.explode(F.arrays_zip("h", "n")).alias("x")).select("row", "x.h", "x.n")
    having = each.groupBy("h").agg(F.count("*").alias("df"))
    bags = each.join(having, "h").groupBy("row").agg(F.collect_list(F.struct("h", "n", "df")).alias("bag"))  # an item's own shingles
    block = F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    made = rows.select("row", "item", "n_words").join(bags, "row").withColumn("block", block)

    def make(batches):
        for part, held in grouped(batches, "block"):
            found = [(item, n_words, [x["h"] % (1 << 64) for x in bag], [x["n"] for x in bag], [x["df"] for x in bag]) for item, n_words, bag in held]
            write_whole(f"{root}/{part}", pickle.dumps(Benchmark(found, total)))
            yield {"block": [part]}

    dealt = made.repartitionById(count, "block").sortWithinPartitions("block", "item", "row").select("block", "item", "n_words", "bag")
    return [f"{root}/{r[0]}" for r in map_columns(dealt, make, "block int").collect()]


def find_leaks(docs: DataFrame, items: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: the best window of each document and each item that it holds."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long"
    found = None
    for path in blocks(items, item_col, text_col):
        part = _search(asked, path, least, schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _search(docs: DataFrame, path: str, least: float, schema: str) -> DataFrame:
    def work(batches):
        held = opened(path)
        for b in batches:
            rows = [(d, held.ids[k], *hit) for d, t in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True) for k, hit in sorted(held.search(t, least).items())]
            yield {n: [r[i] for r in rows] for i, n in enumerate(("doc_id", "item_id", "similarity", "first_word", "n_words"))}

    return map_columns(docs, work, schema)


def without_leaks(docs: DataFrame, items: DataFrame, least: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows that hold an item; other rows and all columns stay as they are."""
    names = [f.name for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for path in blocks(items, item_col, text_col):

        def work(batches, path=path):
            held = opened(path)
            for b in batches:
                keep = np.flatnonzero([not held.search(t, least) for t in texts(b[text_col])])
                yield {n: b[n].take(pa.array(keep)) for n in names}

        docs = map_columns(docs, work, schema)
    return docs
