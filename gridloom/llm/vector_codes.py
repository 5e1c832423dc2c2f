"""Vector code compression: each of a vector's parts becomes the index of the nearest entry of a codebook.

Codebooks are trained by rounds of assignment and integer means. The nearest
entry is found by segment-mean lower bounds: a part and an entry are cut into 1,
2, 4, ... segments; the means' squared distance, weighted by length, plus the
square of the difference of the residuals' norms is never above their squared
distance. From coarse to fine, entries whose bound (less a margin for rounding)
is above the exact distance to a first guess are dropped; only what is left gets
exact integer distances. Entries of equal distance: the lower index.

A round is one pass over the rows: tasks sum up their parts by entry, and one row
for each part and entry (``parts`` x ``entries``, fixed numbers) reaches the
driver, whatever the input. Labels with ``1 / HEAVY`` of the rows or more, fewer
than ``HEAVY`` by count, get their sums by a broadcast of that bounded table;
all others by a join.

Defined results: rows whose vector is null or holds null or non-finite
components go, (beyond 32-bit floats counts as not finite), also vectors whose length differs from
that of the smallest kept id's (null ids last) or is no multiple of ``parts``; fewer rows than ``entries``
make fewer entries; equal ids are ordered by their vectors; repeated rows count
each time; null labels are one label; an empty table gives no rows; other columns
are ignored. Components beyond 2 ** 17 are counted in Python's integers, so codes
stay exact; an error that passes 64 bits is null, and so is its label's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_columns, stage
from .vectors import common_length, matrix, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels with this part of the rows or more are heavy.
HEAVY = 512
#: Beyond this, sums of squares may not fit 64 bits.
WIDE = 2.0**17
MOST = (1 << 63) - 1


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: 64-bit integers, or Python's own where they could overflow."""
    whole = np.floor(vectors * SCALE)
    if not len(whole) or np.abs(vectors).max() <= WIDE:
        return whole.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(whole)


def outline(parts: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment means of rows, and the norm of what they leave."""
    cut = np.array_split(np.arange(parts.shape[1]), segments)
    wide = parts.astype(np.float64)
    means = np.stack([wide[:, at].mean(axis=1) for at in cut], axis=1)
    rest = wide - np.repeat(means, [len(at) for at in cut], axis=1)
    return means, np.sqrt((rest * rest).sum(axis=1))


def lower_bounds(parts: np.ndarray, entries: np.ndarray, segments: int) -> np.ndarray:
    """For each part and entry, at most their squared distance, but for rounding."""
    (a, ra), (b, rb) = outline(parts, segments), outline(entries, segments)
    lengths = np.array([len(at) for at in np.array_split(np.arange(parts.shape[1]), segments)], float)
    gaps = (ra[:, None] - rb[None, :]) ** 2
    for s in range(segments):
        gaps += lengths[s] * (a[:, s, None] - b[None, :, s]) ** 2
    return gaps


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each part's nearest entry, its squared distance, and how many exact distances were needed."""
    if parts.dtype == object or entries.dtype == object:
        every = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        code = every.argmin(axis=1)
        return code, every[np.arange(len(parts)), code], every.size
    rows = np.arange(len(parts))
    segments = [s for s in (1, 2, 4) if s < parts.shape[1]] or [1]
    bounds = lower_bounds(parts, entries, segments[0])
    guess = bounds.argmin(axis=1)
    most = ((parts - entries[guess]) ** 2).sum(axis=1)
    margin = 1e-9 * (most.astype(np.float64) + (parts.astype(np.float64) ** 2).sum(axis=1) + (entries.astype(np.float64) ** 2).sum(axis=1).max()) + 1e-6
    limit = most.astype(np.float64) + margin
    left_row, left_entry = np.nonzero(bounds <= limit[:, None])
    for s in segments[1:]:
        (a, ra), (b, rb) = outline(parts, s), outline(entries, s)
        lengths = np.array([len(at) for at in np.array_split(np.arange(parts.shape[1]), s)], float)
        fine = ((a[left_row] - b[left_entry]) ** 2 * lengths).sum(axis=1) + (ra[left_row] - rb[left_entry]) ** 2
        keep = fine <= limit[left_row]
        left_row, left_entry = left_row[keep], left_entry[keep]
    exact = ((parts[left_row] - entries[left_entry]) ** 2).sum(axis=1)
    order = np.lexsort((left_entry, exact, left_row))
    first = order[np.searchsorted(left_row[order], rows)]
    return left_entry[first], exact[first], len(exact)


def _entry_lists(books: list[list[list[int]]]) -> list[np.ndarray]:
    wide = any(abs(v) > WIDE * SCALE for book in books for entry in book for v in entry)
    return [np.array(book, dtype=object if wide else np.int64) for book in books]


def first_codebooks(kept: DataFrame, id_column: str, column: str, parts: int, entries: int) -> list[list[list[int]]]:
    """Parts of the vectors of the smallest ids: at most ``entries`` rows."""
    rows = kept.orderBy(F.col(id_column).isNull(), id_column, column).limit(entries).select(column).collect()
    if not rows:
        return []
    whole = integers(np.array([r[0] for r in rows], dtype=np.float64))
    return [block.tolist() for block in np.split(whole, parts, axis=1)]


def next_codebooks(kept: DataFrame, column: str, books: list[list[list[int]]], length: int) -> list[list[list[int]]]:
    """One round: assign, then the floor of each entry's mean; unused entries stay."""

    def work(batches):
        codebooks, sums, counts = _entry_lists(books), {}, {}
        for b in batches:
            for p, block in enumerate(np.split(integers(matrix(b["v"], length)), len(codebooks), axis=1)):
                code, _, _ = nearest(block, codebooks[p])
                for e in np.unique(code).tolist():
                    mine = block[code == e]
                    counts[p, e] = counts.get((p, e), 0) + len(mine)
                    sums[p, e] = [x + int(y) for x, y in zip(sums.get((p, e), [0] * mine.shape[1]), mine.sum(axis=0).tolist(), strict=True)]
        told = [(p, e, at, counts[p, e], *divmod(total, 10**15)) for p, e in sums for at, total in enumerate(sums[p, e])]
        if told:
            part, entry, at, n, high, low = map(list, zip(*told, strict=True))
            yield {"part": part, "entry": entry, "at": at, "n": n, "high": [str(x) for x in high], "low": low}

    told = map_columns(kept.select(F.col(column).alias("v")), work, "part int, entry int, at int, n long, high string, low long", rows=20_000)
    # sums in two pieces: exact for any number of rows; the upper one is small unless components are huge
    summed = told.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"))
    out = [[list(entry) for entry in book] for book in books]
    for r in summed.collect():
        out[r.part][r.entry][r.at] = (int(r.high) * 10**15 + r.low) // r.n
    return out


def train(kept: DataFrame, id_column: str, column: str, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    books = first_codebooks(kept, id_column, column, parts, entries)
    for _ in range(rounds if books else 0):
        books = next_codebooks(kept, column, books, length)
    return books


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def encode(rows: DataFrame, books: list[list[list[int]]], length: int, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """Code and squared error of each row: (id, label, code, error, tried), where ``tried`` counts the exact distances that the bounds left."""

    def work(batches):
        codebooks = _entry_lists(books)
        for b in batches:
            codes, total, tried = [], 0, 0
            for p, block in enumerate(np.split(integers(matrix(b["v"], length)), len(codebooks), axis=1)):
                code, distance, n = nearest(block, codebooks[p])
                codes.append(code.astype(np.uint8))
                total, tried = total + distance, tried + n
            error = pa.array([int(x) if x <= MOST else None for x in total.tolist()], pa.int64())
            flat = np.stack(codes, axis=1).tobytes().hex()
            step = 2 * len(codebooks)
            yield {"i": b["i"], "label": b["label"], "code": [flat[k : k + step] for k in range(0, len(flat), step)], "error": error, "tried": [tried] + [0] * (len(b["i"]) - 1)}

    kinds = dict(rows.dtypes)
    told = rows.select(F.col(id_column).alias("i"), F.col(label).alias("label"), F.col(column).alias("v"))
    return map_columns(told, work, f"i {kinds[id_column]}, label {kinds[label]}, code string, error long, tried long", rows=20_000).withColumnRenamed("i", id_column)


def with_label_errors(coded: DataFrame, count: int) -> DataFrame:
    """Each row with the sum of the errors of its label; ``coded`` is a written table of ``count`` rows."""
    sums = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("error").alias("known"))
    sums = stage(sums.select("label", (F.col("n") * HEAVY >= count).alias("heavy"), F.when((F.col("n") == F.col("known")) & (F.col("total") <= MOST), F.col("total").cast("long")).alias("label_error")), "label-errors")
    of = coded.withColumnRenamed("label", "own")
    same = F.col("own").eqNullSafe(F.col("label"))
    heavy = of.join(F.broadcast(sums.where("heavy")), same)
    light = of.join(F.broadcast(sums.where("heavy").select("label")), same, "left_anti").join(sums.where("not heavy"), same)
    return heavy.unionByName(light).drop("own", "heavy")


def compress(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all usable rows: (id, code, error, label, label_error, codebooks_sha256)."""
    kept = usable(rows.select(id_column, column, label), column)
    length = common_length(kept, column, id_column, parts)
    kept = kept.where(F.size(column) == length) if length else kept.where("false")
    books = train(kept, id_column, column, length, parts, entries, rounds)
    if not books:
        return kept.select(id_column, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), label, F.lit(0).cast("long").alias("label_error"), F.lit(digest([])).alias("codebooks_sha256"))
    coded = stage(encode(kept, books, length, id_column, column, label), "codes")
    named = with_label_errors(coded.drop("tried").withColumnRenamed(label, "label"), coded.count()).withColumnRenamed("label", label)
    return named.withColumn("codebooks_sha256", F.lit(digest(books)))
