"""Exact repeats of long byte strings, by merging shard Burrows-Wheeler transforms.

The texts are read as strings of phrases. A window of positions (``window``, 128
for 400 bytes) picks the position of its least ``GRAM``-byte hash; picked positions (anchors) and the
starts of texts cut a text into phrases, each ``GRAM`` bytes into the next. Equal
byte strings are cut alike inside, away from their first window.

Each input split is a shard. Its transform has, for every phrase suffix, the
phrase before it, and the suffixes' order. The shards' orders are merged by
iterative interleave refinement: round 0 interleaves the phrases themselves;
round j takes what round j - 1 says of the suffixes (their interval in the
interleave) and prepends the transform's symbol, so a pair (symbol, interval of
the suffix after it) is the next name, and pairs in order are the refined
interleave. Slices of the name space merge the shards' sorted names and answer
with the place of each interval that has more than one suffix. Intervals of one
suffix are closed and never looked at again; nothing is sorted anew but what is
still open. The round in which a suffix closes is its longest common prefix with
any other, in phrases, at most ``ROUNDS``.

A suffix whose common prefix spans ``length`` bytes is a repeated interval: all
its bytes go. What is left are the windows of ``length`` bytes at the ends of
repeated stretches. Any repeated string holds, a window from its start, a whole
phrase that repeats, so windows without one are out; the others, and those in
repeated intervals with the same phrase at that place, are interleaved once by
themselves. Copies are one name in a shard, so hot groups meet as one entry a shard.

Phrases are equal where 128 bits of XXH3 are, and places in the interleave are
exact from there on. Windows are equal where they have one place and 64 bits. A row that travels is one shard's names in
one slice; slices are of ``SLICE`` bytes of text, so there are never more rows
than names and no task's memory grows with the input.

Side files of the shards lie in the shared folder and are written whole; a
repeated task writes the same ones.

Defined results: a null text counts as empty; texts shorter than ``length`` lose
nothing; repeated rows are copies of each other and lose what they share; null
ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Side, dealt, file_count, grouped, map_columns, stage, stage_path, texts
from .wordhash import mix

LENGTH, GRAM = 400, 8
#: Phrases of a common prefix that are told apart: what ``LENGTH`` bytes and a phrase have, at 53 bytes on average.
ROUNDS = 9
#: Bytes of texts that are cut together; bytes of text that a slice of the names stands for; windows that are named together.
BLOCK, SLICE, CHUNK = 1 << 19, 16 << 20, 1 << 22
_INDEX_BITS, _PLACE_BITS, _CHUNK_BITS = 31, 40, 12
_digest = xxhash.xxh3_128_digest


def window(length: int) -> int:
    """The greatest power of two of which a string of ``length`` bytes holds three and a gram."""
    if length < 3 * 16 + GRAM:
        raise ValueError("the strings are too short for a window")
    return 1 << (((length - GRAM + 1) // 3).bit_length() - 1)


def cut(parts: list[bytes], width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts, and the start and stop of every phrase and its text's index."""
    data = b"".join(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    bounds = np.union1d(starts[sizes > 0], anchors(data, starts, sizes, width))
    text = np.searchsorted(stops, bounds, side="right")
    after = np.r_[bounds[1:], len(data)]
    return data, bounds, np.minimum(after + GRAM * (after < stops[text]), stops[text]), text


def anchors(data: bytes, starts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Positions that some window inside a text picks."""
    n = len(data) - GRAM + 1
    if n < window:
        return np.empty(0, np.int64)
    grams, width = np.frombuffer(data, np.uint8).astype(np.uint64), 1
    while width < GRAM:
        grams = grams[:-width] | grams[width:] << np.uint64(8 * width)
        width *= 2
    low = mix(grams) >> np.uint64(_INDEX_BITS) << np.uint64(_INDEX_BITS) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < window:  # a power of two
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    many = np.maximum(sizes - window - GRAM + 2, 0)
    windows = np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)
    picked = np.zeros(len(data), bool)
    picked[(low[windows] & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)] = True
    return np.flatnonzero(picked)


def digests(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    view = memoryview(data)
    both = np.frombuffer(b"".join([_digest(view[s:e]) for s, e in zip(starts.tolist(), stops.tolist())]), ">u8").astype(np.uint64)
    return both[::2], both[1::2]


def in_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    order = np.argsort(high, kind="stable")
    h, x = high[order], low[order]
    return np.lexsort((low, high)) if ((h[1:] == h[:-1]) & (x[1:] < x[:-1])).any() else order


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, whether each occurs more than once, and the place of every input pair among them."""
    order = in_order(high, low)
    h, x = high[order], low[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])]) if len(h) else np.empty(0, np.int64)
    counts, at = np.diff(np.r_[first, len(h)]), np.empty(len(h), np.int64)
    at[order] = np.repeat(np.arange(len(first)), counts)
    return h[first], x[first], counts > 1, at


def even_slice(high: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a digest."""
    return (high >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)


def place_slice(high: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a place in the interleave."""
    return high >> np.uint64(_PLACE_BITS)


NAMED = "slice int, shard long, blob binary"
ANSWERED = "shard long, slice int, blob binary"


def named(high, low, many, shard: int, slices: int, slice_of=even_slice) -> dict:
    """A shard's sorted names, a row for each slice that has some."""
    of = slice_of(high, slices)
    cuts = np.flatnonzero(of[1:] != of[:-1]) + 1 if len(of) else []
    rows = []
    for h, x, m in zip(np.split(high, cuts), np.split(low, cuts), np.split(many, cuts)) if len(high) else ():
        head = np.array([len(h)], np.uint64).tobytes()
        rows.append((int(slice_of(h[:1], slices)[0]), zstandard.compress(head + np.diff(h, prepend=np.uint64(0)).tobytes() + x.tobytes() + np.packbits(m).tobytes(), 1)))
    return {"slice": [r[0] for r in rows], "shard": [shard] * len(rows), "blob": [r[1] for r in rows]}


def names_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.uint64, 1)[0])
    high = np.cumsum(np.frombuffer(data, np.uint64, n, 8), dtype=np.uint64)
    return high, np.frombuffer(data, np.uint64, n, 8 + 8 * n), np.unpackbits(np.frombuffer(data, np.uint8, -1, 8 + 16 * n), count=n).astype(bool)


def interleave(names: DataFrame, slices: int, meeting: bool = True) -> DataFrame:
    """The shards' sorted names, merged slice by slice; each shard gets the places of its names that are not alone (or, unless ``meeting``, that any shard has marked)."""

    def merge(batches):
        for part, rows in grouped(batches, "slice"):
            held = [(shard, *names_of(blob)) for shard, blob in rows]
            high, low = np.concatenate([h for _, h, *_ in held]), np.concatenate([x for *_, x, _ in held])
            many = np.concatenate([m for *_, m in held])
            order = in_order(high, low)
            h, x = high[order], low[order]
            same = (h[1:] == h[:-1]) & (x[1:] == x[:-1])
            first = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[first, len(h)])
            told = np.maximum.reduceat(many[order], first) | (meeting & (sizes > 1))
            place = np.empty(len(h), np.uint32)
            many[order], place[order] = np.repeat(told, sizes), np.repeat(first, sizes)
            cuts = np.cumsum([len(v) for _, v, *_ in held])[:-1]
            blobs = [zstandard.compress(np.array([len(m)], np.uint64).tobytes() + np.packbits(m).tobytes() + p[m].tobytes(), 1) for m, p in zip(np.split(many, cuts), np.split(place, cuts))]
            yield {"shard": [s for s, *_ in held], "slice": [part] * len(held), "blob": blobs}

    return map_columns(dealt(names, "slice", slices, "slice").select("slice", "shard", "blob"), merge, ANSWERED)


def answered(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of a shard's names is not alone, and its place in the interleave if so."""
    flags, places = [np.empty(0, bool)], [np.empty(0, np.uint64)]
    for part, blob in rows:
        data = zstandard.decompress(blob)
        n = int(np.frombuffer(data, np.uint64, 1)[0])
        m = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 8), count=n).astype(bool)
        p = np.zeros(n, np.uint64)
        p[m] = np.frombuffer(data, np.uint32, -1, 8 + -(-n // 8)).astype(np.uint64) + (np.uint64(part) << np.uint64(_PLACE_BITS))
        flags.append(m)
        places.append(p)
    return np.concatenate(flags), np.concatenate(places)


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences, which pack well."""
    return np.diff(ascending, prepend=0).astype(np.uint32)


class Phrases:
    """A shard's phrases in order, and the common prefix of the suffix at each (in phrases)."""

    def __init__(self, start, size, count, prefix):
        self.start, self.stop, self.prefix = start, start + size, prefix
        self.to = np.cumsum(count)
        self.first = self.to - count
        #: Where the common prefix ends, in bytes of the text; its start if there is none.
        self.reach = np.where(prefix > 0, self.stop[np.arange(len(start)) + np.maximum(prefix, 1) - 1], start) if len(start) else start
        gain = np.r_[self.reach - start, 0]
        self.longest = np.where(count > 0, np.maximum.reduceat(gain, self.first), 0) if len(count) else count
        self.deepest = np.where(count > 0, np.maximum.reduceat(np.r_[prefix, 0], self.first), 0) if len(count) else count
        self.bytes = np.where(count > 0, np.r_[self.stop, 0][self.to - 1], 0)

    def live(self, rows: np.ndarray, length: int) -> np.ndarray:
        """Texts of ``rows`` that may lose bytes."""
        return rows[(self.deepest[rows] > 1) & (self.bytes[rows] >= length)]


def phrases_of(side: Side, shard: int) -> Phrases:
    held = side.load("phrases", shard)
    prefix = np.zeros(len(held["start"]), np.int64)
    for i in range(ROUNDS):
        found = side.load(f"open-{i}", shard)
        if found:
            prefix[np.cumsum(found["open"])] = i + 1
    return Phrases(held["start"].astype(np.int64), held["size"].astype(np.int64), held["count"].astype(np.int64), prefix)


def find_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_repeat, spans`` for every row.

    Spans are the byte ranges that repeats of ``length`` bytes cover. ``longest_repeat``
    is the longest common prefix of the text's phrase suffixes with any other
    suffix, in bytes of whole phrases, ``ROUNDS`` at most: shorter repeats show in it.
    The texts are read three times and must come in the same splits: say ``scan`` if
    ``docs`` comes straight from files, else it is written first.
    """
    spark, kind, width = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), window(length)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    docs = docs if scan else stage(docs, "texts")
    shards = file_count(docs)
    slices = 1 + (docs.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0) // SLICE
    side = Side(stage_path(spark, "repeats"))

    def parse(batches):
        shard, found = TaskContext.get().partitionId(), {k: [] for k in ("start", "size", "count", "high", "low")}

        def add(parts):
            data, start, stop, text = cut(parts, width)
            sizes = np.array([len(p) for p in parts])
            found["start"].append((start - (np.cumsum(sizes) - sizes)[text]).astype(np.uint32))
            found["size"].append((stop - start).astype(np.uint32))
            found["count"].append(np.bincount(text, minlength=len(parts)).astype(np.uint32))
            for k, v in zip(("high", "low"), digests(data, start, stop)):
                found[k].append(v)

        for b in batches:
            parts, size = [], 0
            for t in b["text"].to_pylist():
                parts.append(t.encode())
                size += len(parts[-1])
                if size >= BLOCK:
                    add(parts)
                    parts, size = [], 0
            if parts:
                add(parts)
        all_ = {k: np.concatenate(v) if v else np.empty(0, np.uint64 if k in ("high", "low") else np.uint32) for k, v in found.items()}
        high, low, many, at = distinct(all_.pop("high"), all_.pop("low"))
        side.keep("phrases", shard, **all_)
        side.keep("round-0", shard, suffix=steps(np.arange(len(at))), at=at.astype(np.uint32))
        yield named(high, low, many, shard, slices)

    def refine(i):
        def advance(batches):
            for shard, rows in grouped(batches, "shard"):
                many, place = answered(rows)
                held = side.load(f"round-{i}", shard)
                live = many[held["at"]]
                suffix, interval = np.cumsum(held["suffix"])[live].astype(np.int64), place[held["at"][live]]
                side.keep(f"open-{i}", shard, open=steps(suffix))
                if i == 0:
                    side.keep("symbols", shard, suffix=suffix.astype(np.uint32), symbol=interval)
                if i + 1 == ROUNDS:
                    continue
                symbols = side.load("symbols", shard)
                last = np.cumsum(side.load("phrases", shard)["count"].astype(np.int64)) - 1
                # Before an open suffix, an open suffix of the same text: its symbol is prepended.
                before = (suffix[1:] - suffix[:-1] == 1) & ~np.isin(suffix[:-1], last) if len(suffix) else np.empty(0, bool)
                at = suffix[:-1][before]
                high, low, many, of = distinct(symbols["symbol"][np.searchsorted(symbols["suffix"], at)], interval[1:][before])
                side.keep(f"round-{i + 1}", shard, suffix=steps(at), at=of.astype(np.uint32))
                yield named(high, low, many, shard, slices, place_slice)

        return advance

    names = map_columns(docs, parse, NAMED)
    for i in range(ROUNDS):
        answers = dealt(interleave(names, slices), "shard", shards, "shard", "slice").select("shard", "slice", "blob")
        names = map_columns(answers, refine(i), NAMED)
    names.agg(F.count("*")).collect()
    del names, answers

    def open_ends(batches):
        for b in batches:
            for shard in b["shard"].to_pylist():
                held, symbols = phrases_of(side, shard), side.load("symbols", shard)
                if symbols is None:
                    continue
                ends = np.zeros(len(held.start), bool)
                live = held.live(np.arange(len(held.to)), length)
                for some in np.split(live, np.flatnonzero(np.diff(np.cumsum(held.bytes[live]) // BLOCK)) + 1):
                    *_, at, undecided = _windows(held, some, length, width)
                    ends[at[undecided]] = True
                high, low, _, of = distinct(symbols["symbol"], np.zeros(len(symbols["symbol"]), np.uint64))
                marked = np.zeros(len(high), bool)
                marked[of[ends[symbols["suffix"]]]] = True
                side.keep("ends", shard, of=of.astype(np.uint32))
                yield named(high, low, marked, shard, slices, place_slice)

    def mark_ends(batches):
        for shard, rows in grouped(batches, "shard"):
            marked, _ = answered(rows)
            side.keep("marked", shard, suffix=side.load("symbols", shard)["suffix"][marked[side.load("ends", shard)["of"]]])
        yield {"n": []}

    numbers = spark.range(0, shards, 1, shards).select(F.col("id").alias("shard"))
    told_ends = dealt(interleave(map_columns(numbers, open_ends, NAMED), slices, meeting=False), "shard", shards, "shard", "slice")
    map_columns(told_ends.select("shard", "slice", "blob"), mark_ends, "n long").agg(F.count("*")).collect()

    def edges(batches):
        """(phrases, ids, texts, their numbers, which may lose bytes, those joined, their offsets, steps of what repeated intervals cover, windows to be told) of some texts."""
        shard, at = TaskContext.get().partitionId(), 0
        held, marked, symbols = phrases_of(side, shard), side.load("marked", shard), side.load("symbols", shard)
        asked, place = np.zeros(len(held.start), bool), np.zeros(len(held.start), np.uint64)
        if marked is not None:
            asked[marked["suffix"]] = True
            place[symbols["suffix"]] = symbols["symbol"]

        def found(ids, parts):
            nonlocal at
            rows = np.arange(at, at + len(parts))
            at += len(parts)
            if rows[-1] >= len(held.to) or (held.bytes[rows] != [len(p) for p in parts]).any():
                raise RuntimeError("the split has other texts than before")
            live = held.live(rows, length)
            return ids, parts, rows, live, b"".join([parts[i] for i in (live - rows[0]).tolist()]), *_windows(held, live, length, width, asked, place)[:4]

        for b in batches:
            ids, parts, size, n = b["doc_id"].to_pylist(), [], 0, 0
            for t in texts(b["text"]):
                parts.append(t.encode())
                size += len(parts[-1])
                if size >= BLOCK:
                    yield held, *found(ids[n : n + len(parts)], parts)
                    n += len(parts)
                    parts, size = [], 0
            if parts:
                yield held, *found(ids[n:], parts)

    def windows(batches):
        shard, chunk, waiting, n = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            high, low, many, at = distinct(*(np.concatenate(x) for x in zip(*waiting)))
            number = shard << _CHUNK_BITS | chunk
            side.keep("windows", number, at=at.astype(np.uint32))
            return named(high, low, many, number, slices)

        for *_, data, _, _, p, place in edges(batches):
            view = memoryview(data)
            waiting.append((np.array([xxhash.xxh3_64_intdigest(view[q : q + length]) for q in p.tolist()], np.uint64), place))
            n += len(p)
            if n >= CHUNK:
                yield flush()
                chunk, waiting, n = chunk + 1, [], 0
        if waiting:
            yield flush()

    def told(batches):
        for number, rows in grouped(batches, "shard"):
            many, _ = answered(rows)
            side.keep("told", number, many=np.packbits(many[side.load("windows", number)["at"]]))
        yield {"n": []}

    asked = dealt(interleave(map_columns(docs, windows, NAMED), slices), f"shiftright(shard, {_CHUNK_BITS})", shards, "shard", "slice")
    map_columns(asked.select("shard", "slice", "blob"), told, "n long").agg(F.count("*")).collect()

    def remove(batches):
        shard, chunk, flags = TaskContext.get().partitionId(), 0, np.empty(0, bool)
        for held, ids, parts, rows, live, _, offset, change, p, _ in edges(batches):
            taken = []
            while len(p) > sum(map(len, taken)):
                if not len(flags):
                    number = shard << _CHUNK_BITS | chunk
                    flags = np.unpackbits(side.load("told", number)["many"], count=len(side.load("windows", number)["at"])).astype(bool)
                    chunk += 1
                need = len(p) - sum(map(len, taken))
                taken.append(flags[:need])
                flags = flags[need:]
            hit = p[np.concatenate(taken)] if taken else p
            np.add.at(change, hit, 1)
            np.add.at(change, hit + length, -1)
            covered, where = np.cumsum(change)[:-1] > 0, dict(zip(live.tolist(), offset.tolist()))
            out = [_removed(part, covered[where[r] : where[r] + len(part)] if r in where else None) for r, part in zip(rows.tolist(), parts, strict=True)]
            yield {"doc_id": ids, "longest_repeat": held.longest[rows]} | {k: [x[i] for x in out] for i, k in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"))}

    return map_columns(docs, remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_repeat long, spans array<struct<start: long, stop: long>>")


def _windows(held: Phrases, live: np.ndarray, length: int, window: int, asked: np.ndarray | None = None, place: np.ndarray | None = None):
    """Of the texts ``live``, joined: their offsets, steps of what repeated intervals cover, windows that these don't decide or that have a phrase in ``asked``.

    And the ``place`` of each window's phrase, the texts' suffixes, and which of them begin such a phrase.
    """
    sizes = held.bytes[live]
    offset = np.cumsum(sizes) - sizes
    count = held.to[live] - held.first[live]
    at = np.arange(count.sum()) + np.repeat(held.first[live] - (np.cumsum(count) - count), count)
    shift, end = np.repeat(offset, count), np.repeat(sizes, count)
    start, reach, prefix = held.start[at], held.reach[at], held.prefix[at]

    def marks(low, high, which):
        """Steps of the positions from ``low`` to ``high`` - 1 inside the text."""
        low, high = np.maximum(low, 0)[which], np.clip(high, 0, end)[which]
        some, out = low < high, np.zeros(int(sizes.sum()) + 1, np.int32)
        np.add.at(out, (low + shift[which])[some], 1)
        np.add.at(out, (high + shift[which])[some], -1)
        return out

    within = lambda *ranges: np.cumsum(marks(*ranges))[:-1] > 0
    interval = reach - start >= length
    covered = marks(start, reach, interval)
    # The first anchor a window beyond a string's start begins a phrase inside it; an anchor before that, two.
    low, high, begins = np.r_[0, start[:-1]] - window + 2, start - window + 2, (prefix > 0) & (start > 0)
    open_ = within(low, high, begins) & within(start - window + 1, start + 1, prefix > 1)
    left = ~within(start, reach - length + 1, interval)
    if asked is not None:
        left |= within(low, high, begins & asked[at])
    valid = np.zeros(int(sizes.sum()) + 1, np.int32)
    np.add.at(valid, offset, 1)
    np.add.at(valid, offset + sizes - length + 1, -1)
    open_ &= left & (np.cumsum(valid)[:-1] > 0)
    before = np.r_[0, np.cumsum(open_)]
    low, high = np.minimum(np.maximum(low, 0), end) + shift, np.clip(high, 0, end) + shift
    many = np.where(begins, before[np.maximum(high, low)] - before[low], 0)  # each window has one phrase
    return offset, covered, np.flatnonzero(open_), None if place is None else np.repeat(place[at], many), at, many > 0


def _removed(part: bytes, gone: np.ndarray | None) -> tuple:
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)) if gone is not None and gone.any() else np.empty(0, np.int64)
    kept = np.frombuffer(part, np.uint8)[~gone].tobytes() if len(edges) else part
    spans = [{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)]
    return len(part), len(part) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans
