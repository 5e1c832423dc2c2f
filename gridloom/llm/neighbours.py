"""Nearest neighbours by inner product: randomly rotated one-bit codes and exact reranking.

Index. Equal vectors become one entry with its ids, so a vector that a third of
the rows share is searched once. Entries are put near each other by the cells of
a small k-means and packed into blocks. A block has its centre and radius; each
entry, relative to the centre, is rotated at random (after padding with zeros to
``BITS`` dimensions) and kept as the signs: packed bits, and two correction
scalars, the norm of the difference and its inner product with its own code.

Search. A task has a chunk of queries and goes through the blocks, the most
promising first. A block whose centre and radius say that it holds nothing
better than a query's current ``k``-th score is not read for that query (an
exact bound). Of the others, the packed bits and scalars estimate every inner
product, and the estimate's error bound says which vectors are scored exactly:
those whose upper bound reaches the ``k``-th score so far or the block's ``k``-th
lower bound. The bound is ``BOUND`` standard deviations of the rotation's error wide, so a
neighbour is missed with a chance below 10^-4 (normal tails).

Only the fit of the cells uses a sample (``SAMPLE`` vectors of lowest hash, a
bound); all rows are indexed, every query meets every block. Blocks are files of
the shared folder; a search task holds one block and one chunk of queries.

Scores are sums of products of doubles from the first component to the last,
the same for every pair wherever it is computed. Ties go to the smaller id.

Defined results: rows whose vector is null, zero or holds null or non-finite
components (beyond 32-bit floats too), whose id is null or whose length differs
from that of the smallest usable id's take no part; rows of equal id and vector
count once; rows of the query's own id are left out; fewer candidates than ``k``
give fewer neighbours; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Side, map_columns, stage, stage_path
from .vectors import common_length, matrix, spin, usable

K = 20
#: Signs of an entry; dimensions are padded to at least as many.
BITS = 256
BOUND = 4.0
#: The fit of the cells: vectors, cells, rounds.
SAMPLE, CELLS, ROUNDS = 8192, 128, 8
#: Entries of a block, queries of a chunk.
BLOCK, CHUNK = 4096, 512
#: Pairs that are scored at a time.
PAIRS = 1 << 18


def entries(kept: DataFrame, id_column: str, column: str, k: int) -> DataFrame:
    """Each different vector with its smallest ids: (v, ids). Only ``k`` and the query's own can be asked for, so ``k + 1`` ids tell all."""
    once = kept.select(F.col(column).alias("v"), F.col(id_column).alias("i")).dropDuplicates()
    first = once.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("i"))).where(F.col("at") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("i")).alias("ids"))


def cells(kept: DataFrame, column: str, count: int) -> np.ndarray:
    """Centres of a k-means over a bounded sample; a threshold of the hash keeps what tasks send in proportion to it."""
    h = F.xxhash64(column)
    share = min(1 << 30, (1 << 30) * 2 * SAMPLE // count + 1)
    rows = kept.select(column, h.alias("h")).where(F.pmod(h, F.lit(1 << 30)) < share).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).collect()
    if not rows:  # few different vectors, none below the threshold
        rows = kept.select(column).limit(1).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    centres = x[:CELLS].copy()
    for _ in range(ROUNDS):
        mine = cell_of(x, centres)
        for c in np.unique(mine):
            centres[c] = x[mine == c].mean(axis=0)
    return centres


def cell_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


def in_cells(df: DataFrame, centres: np.ndarray, column: str, other: str, kind: str) -> DataFrame:
    length = centres.shape[1]

    def work(batches):
        for b in batches:
            yield {"cell": cell_of(matrix(b["v"], length), centres), "v": b["v"], "x": b["x"]}

    return map_columns(df.select(F.col(column).alias("v"), F.col(other).alias("x")), work, f"cell int, v array<double>, x {kind}", rows=20_000)


def coded(x: np.ndarray, turn: np.ndarray) -> dict[str, np.ndarray]:
    """A block: centre, radius, packed signs and the two correction scalars of each row."""
    centre = x.mean(axis=0)
    rest = x - centre
    norm = np.sqrt((rest * rest).sum(axis=1))
    turned = rest @ turn.T
    bits = turned > 0
    along = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0]) / np.where(norm > 0, norm, 1)
    return {"centre": centre, "radius": norm.max() * (1 + 1e-9), "bits": np.packbits(bits, axis=1), "norm": norm, "along": np.where(norm > 0, along, 1.0)}


def estimates(q: np.ndarray, block: dict[str, np.ndarray], turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries and a block's entries, and the width of their error bounds."""
    bits = turn.shape[0]
    signs = np.unpackbits(block["bits"], axis=1, count=bits).astype(np.float32) * np.float32(2) - np.float32(1)
    length = np.sqrt((q * q).sum(axis=1))
    unit = (q / length[:, None]) @ turn.T
    told = (unit.astype(np.float32) @ signs.T) / np.float32(np.sqrt(bits))
    scale = block["norm"] / block["along"]
    beside = block["norm"] * np.sqrt(np.maximum(1 / block["along"] ** 2 - 1, 0)) * (BOUND / np.sqrt(bits - 1))
    size = np.abs(block["centre"]).max() * np.sqrt(len(block["centre"])) + block["norm"]
    guess = (q @ block["centre"])[:, None] + length[:, None] * (told * scale[None, :])
    return guess, length[:, None] * (beside + 1e-5 * size)[None, :]


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of a and ``j`` of b, summed in order; a and b are given by component."""
    out = np.zeros(len(i))
    for p, q in zip(a, b, strict=True):
        out += p[i] * q[j]
    return out


class Best:
    """The best ``k`` of each query of a chunk so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.own, self.k = ids, k
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = (ids != self.own[query]) & (score >= self.least[query])
        q = np.concatenate([self.query, query[keep]])
        s = np.concatenate([self.score, score[keep]])
        i = np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        again = np.zeros(len(q), bool)
        again[1:] = (q[1:] == q[:-1]) & (i[1:] == i[:-1]) & (s[1:] == s[:-1])
        q, s, i = q[~again], s[~again], i[~again]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.query, self.score, self.ids = q[top], s[top], i[top]
        full = rank[top] == self.k - 1
        self.least[self.query[full]] = self.score[full]


def search_chunk(ids: np.ndarray, q: np.ndarray, side: Side, parts: int, turn: np.ndarray, k: int) -> Best:
    best, length, by_component = Best(ids, k), np.sqrt((q * q).sum(axis=1)) * (1 + 1e-9), np.ascontiguousarray(q.T)

    def hopes(head):
        return q @ head["centres"].T + length[:, None] * (head["radii"] + 1e-12 * np.abs(head["centres"]).max())[None, :]

    promise = []
    for p in range(parts):
        head = side.load("heads", p)
        if head is not None and len(head["radii"]):
            promise.append((-float((hopes(head) / length[:, None]).max()), p))
    for _, p in sorted(promise):
        head = side.load("heads", p)
        hope = hopes(head)
        for at in np.argsort(-hope.max(axis=0), kind="stable").tolist():
            asking = np.flatnonzero(hope[:, at] >= best.least)
            if len(asking):
                search_block(best, asking, q, by_component, side, (p, at), turn)
    return best


def search_block(best: Best, asking: np.ndarray, q: np.ndarray, by_component: np.ndarray, side: Side, where: tuple[int, int], turn: np.ndarray) -> None:
    block = side.load(f"codes-{where[0]}", where[1])
    guess, width = estimates(q[asking], block, turn)
    n = guess.shape[1]
    least = best.least[asking]
    # an entry may be the query's own row, so the block vouches for its k-th best only with one more
    if n > best.k:
        low = guess - width
        least = np.maximum(least, np.partition(low, n - best.k - 1, axis=1)[:, n - best.k - 1])
    row, entry = np.nonzero(guess + width >= least[:, None])
    if not len(row):
        return
    held = side.load(f"vectors-{where[0]}", where[1])
    vectors, first = np.ascontiguousarray(held["v"].T), held["first"]
    for a in range(0, len(row), PAIRS):
        query, e = asking[row[a : a + PAIRS]], entry[a : a + PAIRS]
        score = products(by_component, vectors, query, e)
        keep = score >= best.least[query]
        query, e, score = query[keep], e[keep], score[keep]
        times = first[e + 1] - first[e]
        places = np.repeat(first[e] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        best.add(np.repeat(query, times), np.repeat(score, times), held["ids"][places])


def build(rows: DataFrame, centres: np.ndarray, k: int, id_column: str, column: str, parts: int) -> str:
    """Writes the index of all usable rows to the shared folder; its path."""
    length, root = centres.shape[1], stage_path(rows.sparkSession, "neighbours")
    turn = spin(length, max(BITS, length), 12)
    found = in_cells(entries(rows, id_column, column, k), centres, "v", "ids", "array<long>")
    # ranges of cells; a cell that is large is cut by a hash of the vector
    near = found.withColumn("h", F.xxhash64("v")).repartitionByRange(parts, "cell", "h").sortWithinPartitions("cell", "h")

    def work(batches):
        part, side, n = TaskContext.get().partitionId(), Side(root), 0
        centre, radii = [], []
        for b in batches:
            x, lists = matrix(b["v"], length), b["x"]
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            offsets, ids = offsets - offsets[0], np.asarray(lists.flatten(), dtype=np.int64)
            for a in range(0, len(x), BLOCK):
                block = coded(x[a : a + BLOCK], turn)
                first = offsets[a : a + len(block["norm"]) + 1]
                side.keep(f"codes-{part}", len(radii), **block)
                side.keep(f"vectors-{part}", len(radii), v=x[a : a + BLOCK], first=first - first[0], ids=ids[first[0] : first[-1]])
                centre.append(block["centre"])
                radii.append(block["radius"])
                n += len(block["norm"])
        if radii:
            side.keep("heads", part, centres=np.array(centre), radii=np.array(radii))
        yield {"entries": [n], "blocks": [len(radii)]}

    map_columns(near.drop("h"), work, "entries long, blocks long", rows=2 * BLOCK).agg(F.sum("entries")).collect()
    return root


def search(queries: DataFrame, root: str, centres: np.ndarray, index_parts: int, tasks: int, k: int, id_column: str, column: str) -> DataFrame:
    """The ``k`` nearest of each query: (query_id, rank, vec_id, score)."""
    length = centres.shape[1]
    turn = spin(length, max(BITS, length), 12)
    asked = in_cells(queries.select(id_column, column).dropDuplicates(), centres, column, id_column, "long")

    def work(batches):
        side = Side(root)
        for b in batches:
            ids, q = np.asarray(b["x"], dtype=np.int64), matrix(b["v"], length)
            for a in range(0, len(ids), CHUNK):
                best = search_chunk(ids[a : a + CHUNK], q[a : a + CHUNK], side, index_parts, turn, k)
                rank = np.arange(len(best.query)) - np.searchsorted(best.query, best.query) + 1
                yield {"query_id": best.own[best.query], "rank": rank, "vec_id": best.ids, "score": best.score}

    dealt = asked.withColumn("h", F.xxhash64("v", "x")).repartitionByRange(tasks, "cell", "h").sortWithinPartitions("cell", "h").drop("h")
    return map_columns(dealt, work, "query_id long, rank int, vec_id long, score double", rows=4 * CHUNK)


def nearest(rows: DataFrame, is_query, k: int = K, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each usable row for which the condition ``is_query`` holds, its ``k`` nearest usable rows of another id."""
    kept = usable(rows.select(id_column, column).where(F.col(id_column).isNotNull()), column, zero=False)
    kept = kept.withColumn(id_column, F.col(id_column).cast("long"))
    length = common_length(kept, column, id_column)
    if not length:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kept = kept.where(F.size(column) == length)
    asked = kept.where(is_query)
    count, questions = kept.count(), asked.count()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    centres = cells(kept, column, count)
    parts = max(1, min(4 * least, count // BLOCK), count // (16 * BLOCK))
    root = build(kept, centres, k, id_column, column, parts)
    tasks = max(1, min(2 * least, questions // 32), questions // CHUNK)
    return stage(search(asked, root, centres, parts, tasks, k, id_column, column), "nearest")
