"""Language-model scoring with a log-frequency Bloom filter.

One- and two-word counts of the training documents are quantised, level
``1 + floor(log_BASE(count))``, and an n-gram is put into a Bloom filter once for
each level up to its own. A reader asks for level 1, 2, ... until a probe fails
and so gets the quantised count; errors only ever raise it. The probability of a
word after another is the Dirichlet-smoothed quotient of such counts.

Every n-gram of every training document is in the filter, ``BITS`` bits an entry,
so it grows with the corpus and can't be broadcast whole. It is cut by hash into
slices of ``SLICE`` bytes of text, and the probes are brought to the slices: a
chunk of documents sends its sorted distinct n-grams with their training counts,
a slice adds the counts up, builds its part of the filter, probes it, and answers
each chunk with levels (and with the exact counts of words, for the base score).
A second pass over the chunk's texts adds up the scores. No task's memory grows
with the input, and a row that travels is a chunk's n-grams in one slice.

Defined results: a null or empty text is its end token alone; rows with a null
``held_out`` are training rows; without training rows every count is 0; repeated
rows are counted and scored each; null ids are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Side, dealt, file_count, grouped, map_columns, stage, stage_path, texts
from .wordhash import mix

BASE, BITS, PROBES = 1.5, 8, 4
#: Weight of the lower order, in words.
KAPPA = 8.0
#: Tokens that are counted together; bytes of text that a slice stands for.
CHUNK, SLICE = 1_500_000, 8 << 20
#: The end token; no word is a line feed.
END = xxhash.xxh64_intdigest(b"\n")
REMEMBERED = 200_000
_CHUNK_BITS = 20
_G = np.uint64(0x9E3779B97F4A7C15)
#: n-grams of two words are kept by 48 bits, so that sorted differences fit 32 bits.
WIDTHS = {1: 64, 2: 48}
_LOW = np.uint64(64 - WIDTHS[2])


class _Words(dict):
    def __missing__(self, word):
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def tokens(text: str) -> np.ndarray:
    """Hashes of the words and the end token."""
    if len(_words) > REMEMBERED:
        _words.clear()
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def pairs(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(before * _G + hashes) >> _LOW


def run(batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of some texts, the token before each (the end token at a start), and their pairs."""
    all_ = np.concatenate(batch)
    before = np.empty_like(all_)
    before[1:], before[0] = all_[:-1], END  # each text ends in the end token
    return all_, before, pairs(all_, before)


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct values and their counts."""
    steps = np.diff(values, prepend=np.uint64(0))
    narrow = bool(len(values)) and int(steps[1:].max(initial=0)) < 1 << 32
    head = np.array([narrow, len(values), values[0] if len(values) else 0], np.uint64)
    body = steps[1:].astype(np.uint32) if narrow else values
    return zstandard.compress(head.tobytes() + body.tobytes() + counts.astype(np.uint64).tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    narrow, n, first = (int(x) for x in np.frombuffer(data, np.uint64, 3))
    if narrow:
        steps = np.frombuffer(data, np.uint32, n - 1, 24)
        values = np.concatenate([np.array([first], np.uint64), np.uint64(first) + np.cumsum(steps, dtype=np.uint64)])
        return values, np.frombuffer(data, np.uint64, n, 24 + 4 * (n - 1))
    return np.frombuffer(data, np.uint64, n, 24), np.frombuffer(data, np.uint64, n, 24 + 8 * n)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def level_count(levels: np.ndarray) -> np.ndarray:
    """Mean of the counts that share a level; 0 for none."""
    table = np.zeros(200)
    for i in range(1, 200):
        low, high = np.ceil(BASE ** (i - 1) - 1e-9), np.ceil(BASE**i - 1e-9) - 1
        table[i] = (low + max(low, high)) / 2
    return table[np.minimum(levels, 199)]


def slice_of(values: np.ndarray, width: int, slices: int) -> np.ndarray:
    bits = int(slices).bit_length() - 1
    return (values >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def probe(values: np.ndarray, levels, size) -> tuple[np.ndarray, np.ndarray]:
    """Of (value, level): the word of its slice, and its bits there."""
    h = mix(values * _G + levels)
    g, bits = mix(h + _G), np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << (g >> np.uint64(6 * i) & np.uint64(63))
    return (h % size).astype(np.int64), bits


def filter_words(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The 64-bit words of a slice of the filter; an entry's bits lie in one word."""
    size = max(1, -(-int(levels.sum()) * BITS // 64))
    words = np.zeros(size, np.uint64)
    for step in range(1, int(levels.max(initial=0)) + 1):
        place, bits = probe(values[levels >= step], np.uint64(step), np.uint64(size))
        np.bitwise_or.at(words, place, bits)
    return words


def probed(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Quantised counts, by probing one level after another."""
    out, open_, step = np.zeros(len(values), np.uint8), np.arange(len(values)), 1
    while len(open_):
        place, bits = probe(values[open_], np.uint64(step), np.uint64(len(words)))
        open_ = open_[words[place] & bits == bits]
        out[open_] = step
        step += 1
    return out


def log10_probability(levels: np.ndarray, context: np.ndarray, both: np.ndarray, floor: float) -> np.ndarray:
    """Of tokens, from the levels of the word, of the word before it and of the pair."""
    context = level_count(context)
    unigram = (level_count(levels) + 1) / floor
    return np.log10((np.minimum(level_count(both), context) + KAPPA * unigram) / (context + KAPPA))


def counted(values: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each is in training."""
    out, counts = np.unique(values), None
    known, n = np.unique(values[training], return_counts=True)
    counts = np.zeros(len(out), np.int64)
    counts[np.searchsorted(out, known)] = n
    return out, counts


def chunked(batches):
    """(number in the split, batches, tokens of each text) of whole batches of ``CHUNK`` tokens or more."""
    number, rows, held, size = 0, [], [], 0
    for b in batches:
        rows.append(b)
        for t in texts(b["text"]):
            held.append(tokens(t))
            size += len(held[-1])
        if size >= CHUNK:
            yield number, rows, held
            number, rows, held, size = number + 1, [], [], 0
    if held:
        yield number, rows, held


def tell(docs: DataFrame, slices: int) -> DataFrame:
    """``chunk, order, slice, blob, n, total`` of every chunk and slice: levels (and counts of words) of the chunk's n-grams; the slice's distinct n-grams and tokens in training."""

    def count(batches):
        shard = TaskContext.get().partitionId()
        for number, rows, held in chunked(batches):
            one, _, two = run(held)
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            training = np.repeat(np.concatenate([~np.array(b["held_out"].to_pylist(), bool) for b in rows]), lengths)
            for order, values in ((1, one), (2, two)):
                values, n = counted(values, training)
                cuts = np.searchsorted(slice_of(values, WIDTHS[order], slices), np.arange(1, slices))
                parts = [(i, v, c) for i, (v, c) in enumerate(zip(np.split(values, cuts), np.split(n, cuts))) if len(v)]
                yield {"order": [order] * len(parts), "slice": [p[0] for p in parts], "chunk": [shard << _CHUNK_BITS | number] * len(parts), "blob": [packed(v, c) for _, v, c in parts]}

    def answer(batches):
        for part, rows in grouped(batches, "part"):
            order = part % 2 + 1
            held = [(chunk, *unpacked(blob)) for chunk, blob in rows]
            values, n = merged([x[1:] for x in held])
            known = n > 0
            words = filter_words(values[known], level(n[known]))
            levels = probed(words, values)
            blobs = []
            for _, asked, _ in held:
                at = np.searchsorted(values, asked)
                blobs.append(zstandard.compress(levels[at].tobytes() + (n[at].tobytes() if order == 1 else b""), 1))
            many = len(held)
            yield {"chunk": [x[0] for x in held], "order": [order] * many, "slice": [part // 2] * many, "blob": blobs, "n": [int(known.sum())] * many, "total": [int(n.sum())] * many}

    blobs = map_columns(docs, count, "order int, slice int, chunk long, blob binary").withColumn("part", F.expr("2 * slice + order - 1"))
    asked = dealt(blobs, "part", 2 * slices, "part").select("part", "chunk", "blob")
    return map_columns(asked, answer, "chunk long, order int, slice int, blob binary, n long, total long")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_col: str = "held_out", scan: bool = False) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of all rows, by a model of those that aren't held out.

    The texts are read twice and must come in the same splits: say ``scan`` if
    ``docs`` comes straight from files, else it is written first.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out_col, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    docs = docs if scan else stage(docs, "texts")
    shards = file_count(docs)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    slices = 1 << int(size // SLICE).bit_length()
    told = stage(tell(docs, slices), "told")
    sums = told.where("order = 1").groupBy("slice").agg(F.first("n").alias("n"), F.first("total").alias("total")).agg(F.sum("n"), F.sum("total")).collect()[0]
    distinct, total = (int(x or 0) for x in sums)
    floor, side = total + distinct + 1.0, Side(stage_path(spark, "levels"))

    def keep(batches):
        for chunk, rows in grouped(batches, "chunk"):
            parts = {1: [], 2: []}
            for order, blob in rows:
                parts[order].append(zstandard.decompress(blob))
            one = [(np.frombuffer(x, np.uint8, len(x) // 9), np.frombuffer(x, np.int64, -1, len(x) // 9)) for x in parts[1]]
            side.keep("told", chunk, one=np.concatenate([x for x, _ in one]), counts=np.concatenate([x for _, x in one]), two=np.concatenate([np.frombuffer(x, np.uint8) for x in parts[2]]))
        yield {"n": []}

    kept = dealt(told.select("chunk", "order", "slice", "blob"), f"shiftright(chunk, {_CHUNK_BITS})", shards, "chunk", "order", "slice")
    map_columns(kept.select("chunk", "order", "blob"), keep, "n long").agg(F.count("*")).collect()

    def work(batches):
        shard = TaskContext.get().partitionId()
        for number, rows, held in chunked(batches):
            words, _, two = run(held)
            told_ = side.load("told", shard << _CHUNK_BITS | number)
            kinds, at = np.unique(words, return_inverse=True)
            kinds2, at2 = np.unique(two, return_inverse=True)
            if told_ is None or len(told_["one"]) != len(kinds) or len(told_["two"]) != len(kinds2):
                raise RuntimeError("the split has other texts than before")
            levels, counts = told_["one"], told_["counts"]
            logs = log10_probability(levels[at], levels[np.r_[at[-1], at[:-1]]], told_["two"][at2], floor)  # the chunk ends in an end token
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            starts = np.cumsum(lengths) - lengths
            each = lambda x: np.add.reduceat(x[at], starts)
            sums = {"n_tokens": lengths, "n_known": each((counts > 0).astype(np.int64)), "base_score": each(np.log10((counts + 1) / floor)), "score": np.add.reduceat(logs, starts)}
            first = 0
            for b in rows:
                some = slice(first, first + len(b["doc_id"]))
                first = some.stop
                yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "train_tokens": [total] * (some.stop - some.start)} | {k: v[some] for k, v in sums.items()}

    return map_columns(docs, work, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
