"""Phrase collocations by pivot partitioning, as in MG-FSM.

A phrase belongs to its pivot, its rarest word. Texts are cut at punctuation into
pieces and told apart word by word once; words below ``least`` occurrences can't
be in a phrase and cut the pieces further. Each occurrence of a word as a
pivot gives a fragment: the up to two words on either side that are next to
it without a gap and rarer than no pivot, all others being blanks that end it.
Equal fragments of a chunk travel as one row with a count, by pivot; a pivot of
more than ``SPLIT`` occurrences is dealt over several groups by its fragments'
hash. A group counts its phrases locally and emits those of its pivot only, so
each phrase is counted in one group, or in the few of a split pivot, whose
counts are added up.

Nothing that grows with the vocabulary is broadcast: a chunk's words travel to the
word counts and come back as numbers, ordered by frequency, which are the chunk's
alone. The phrases are joined with the counts of their parts; scores are exact
in decimals of 38 digits (counts up to 10 ** 15).

Everything is per language. A phrase that lies in a longer candidate with
``covered`` percent of its occurrences or more is dropped, be the longer one dropped or not.

Defined results: a null text is empty; a null language is ``und``; an empty
table gives no rows; repeated rows count each time, null ids too (ids play no
part); ties go to the phrase of lower bytes; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_columns, stage

LEAST, COVERED, TOP, MILLION = 10, 50, 2000, 1_000_000
#: Occurrences of a pivot in one group.
SPLIT = 1 << 20
#: Parts of a language that are ranked by themselves before what is left of them meets.
RANKERS = 64
#: Texts that make a chunk.
CHUNK_TEXTS = 6000
#: Fixed: capitals, what ends a piece, and the other gap between words. 0xFF is no byte of UTF-8.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10 + b" ")


def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The different words of some texts, and the texts as numbers of words; -1 ends a piece."""
    data = b"\xff".join([t.translate(FOLD) for t in texts]).replace(b"\xff", b" \xff ")
    held = np.frombuffer(b" " + data + b" ", np.uint8)
    solid = held != 32
    edge = np.diff(solid.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    listed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held[solid])]).dictionary_encode()
    codes, known = listed.indices.to_numpy(zero_copy_only=False), listed.dictionary
    end = known.index(pa.scalar(b"\xff", pa.large_binary())).as_py()
    if end >= 0:
        codes = np.where(codes == end, -1, codes - (codes > end))
        known = pa.concat_arrays([known[:end], known[end + 1 :]])
    return known.cast(pa.binary()).cast(pa.string()), codes.astype(np.int32)


def chunks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Texts as numbers: (chunk, lang, total, words, counts, codes), a row for each language of some thousand texts."""

    def work(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            texts, langs = b["text"].cast(pa.binary()), b["lang"].fill_null("und")
            for lang in langs.unique().to_pylist():
                mine = texts.filter(pa.compute.equal(langs, lang)).drop_null()
                known, codes = words(mine.to_pylist())
                counts = np.bincount(codes[codes >= 0], minlength=len(known))
                yield {"chunk": [f"{part}-{n}"], "lang": [lang], "total": [int(counts.sum())], "words": [known.to_pylist()], "counts": [counts], "codes": [zstandard.compress(codes.tobytes(), 1)]}
                n += 1

    told = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return map_columns(told, work, "chunk string, lang string, total long, words array<string>, counts array<long>, codes binary", rows=CHUNK_TEXTS)


def vocabulary(listed: DataFrame, least: int) -> DataFrame:
    """Words of ``least`` occurrences or more: (lang, word, f, id); ids rise as frequencies fall."""
    counted = listed.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    ordered = stage(counted, "word-counts").orderBy(F.col("f").desc(), "lang", "word")
    return stage(ordered.withColumn("id", F.monotonically_increasing_id()), "vocabulary")


def fragments_of(codes: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different fragments of a chunk and their counts: rows of (second left, left, pivot, right, second right), -1 a blank.

    A left neighbour equal to the pivot ends the fragment: what holds both belongs to the earlier one.
    """
    order = np.argsort(ids)
    local = np.full(int(max(codes.max(initial=-1), places.max(initial=-1))) + 2, -1, np.int64)
    local[places[order]] = np.arange(len(ids))
    s = np.concatenate([[-1, -1], local[codes], [-1, -1]])
    pivot, left, left2, right, right2 = s[2:-2], s[1:-3], s[:-4], s[3:-1], s[4:]
    left = np.where(left < pivot, left, -1)
    left2 = np.where((left >= 0) & (left2 < pivot), left2, -1)
    right = np.where(right <= pivot, right, -1)
    right2 = np.where((right >= 0) & (right2 <= pivot), right2, -1)
    use = (pivot >= 0) & ((left >= 0) | (right >= 0))
    columns = [c[use] for c in (left2, left, pivot, right, right2)]
    key, most = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        if most * (len(ids) + 1) >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            most = len(key) + 1
        key, most = key * (len(ids) + 1) + c + 1, most * (len(ids) + 1)
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    real = np.append(ids[order], -1)
    return np.stack([real[c[first]] for c in columns], axis=1), counts


def fragments(told: DataFrame, listed: DataFrame, vocab: DataFrame) -> DataFrame:
    """Fragments of all chunks: (l2, l1, p, r1, r2, n, groups), ``groups`` the number that a pivot is dealt over."""
    groups = (F.lit(1) + F.expr(f"f div {SPLIT}")).cast("int")
    numbered = listed.join(vocab, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("place", "id", groups.alias("groups"))).alias("known"))
    rows = told.select("chunk", "codes").join(numbered, "chunk")
    rows = rows.select("codes", F.col("known.place").alias("places"), F.col("known.id").alias("ids"), F.col("known.groups").alias("groups"))

    def work(batches):
        for b in batches:
            for k in range(len(b["codes"])):
                codes = np.frombuffer(zstandard.decompress(b["codes"][k].as_py()), np.int32)
                places, ids, over = (np.asarray(b[n][k].values) for n in ("places", "ids", "groups"))
                found, counts = fragments_of(codes, places, ids)
                order = np.argsort(ids)
                split = over[order][np.searchsorted(ids[order], found[:, 2])]
                for a in range(0, len(found), 100_000):
                    at = slice(a, a + 100_000)
                    yield {n: found[at, c] for c, n in enumerate(("l2", "l1", "p", "r1", "r2"))} | {"n": counts[at], "groups": split[at]}

    return map_columns(rows, work, "l2 long, l1 long, p long, r1 long, r2 long, n long, groups int")


def mined(pieces: DataFrame, least: int) -> DataFrame:
    """Phrases of ``least`` occurrences or more: (w1, w2, w3, a), w3 is -1 for two words."""
    routed = pieces.withColumn("part", F.when(F.col("groups") > 1, F.pmod(F.xxhash64("l2", "l1", "r1", "r2"), F.col("groups"))).otherwise(0)).repartition("p", "part")
    owned = F.array(*[
        F.when(F.least(*[F.col(c) for c in of]) >= 0, F.struct(*[(F.col(of[k]) if k < len(of) else F.lit(-1).cast("long")).alias(f"w{k + 1}") for k in range(3)]))
        for of in (("l1", "p"), ("p", "r1"), ("l2", "l1", "p"), ("l1", "p", "r1"), ("p", "r1", "r2"))
    ])
    each = routed.select("p", "part", "groups", "n", F.explode(F.filter(owned, lambda x: x.isNotNull())).alias("g"))
    local = each.groupBy("p", "part", "groups", "g.w1", "g.w2", "g.w3").agg(F.sum("n").alias("a")).where((F.col("groups") > 1) | (F.col("a") >= least))
    return local.groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def score(a, left, right):
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = [x.cast("decimal(19,0)") for x in (a, left, right)]
    top = (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(MILLION).cast("decimal(7,0)")
    under = wide[1] * wide[2]
    rest = top % under  # the remainder is exact; so is the division of what it leaves
    return ((top - rest) / under).cast("decimal(38,0)").cast("long")


def scored(phrases: DataFrame, vocab: DataFrame, covered: int) -> DataFrame:
    """Candidates that stay: (lang, w1, w2, w3, a, l, r, score), by the lowest-scoring cut."""
    count = vocab.select("id", "f")
    pairs, triples = phrases.where("w3 < 0").drop("w3"), phrases.where("w3 >= 0")
    tall = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = pairs.join(tall, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    two = two.join(count.select(F.col("id").alias("w1"), F.col("f").alias("l")), "w1").join(count.select(F.col("id").alias("w2"), F.col("f").alias("r")), "w2")
    two = two.select("w1", "w2", F.lit(-1).cast("long").alias("w3"), "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = (
        triples.join(count.select(F.col("id").alias("w1"), F.col("f").alias("f1")), "w1").join(count.select(F.col("id").alias("w3"), F.col("f").alias("f3")), "w3")
        .join(pairs.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    )
    cuts = [F.struct(score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "f1", "f23"), (2, "f12", "f3"))]
    three = three.withColumn("cut", F.least(*cuts)).select("w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score")
    return two.unionByName(three).join(vocab.select(F.col("id").alias("w1"), "lang"), "w1")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, top: int | None = TOP) -> DataFrame:
    """Phrases of two and three words that stick together, the ``top`` of each language, or all: (lang, rank, phrase, a, l, r, n, score)."""
    told = stage(chunks(docs, text, lang), "word-chunks", "zstd")
    listed = told.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select("chunk", "lang", F.col("pos").alias("place"), F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    vocab = vocabulary(listed, least)
    phrases = stage(mined(fragments(told, listed, vocab), least), "phrases")
    found = scored(phrases, vocab, covered)
    order = [F.col("score").desc(), F.col("a").desc()]
    if top is not None:  # ties stay until the phrases are spelt out
        for part in (["lang", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(RANKERS))], ["lang"]):
            found = found.withColumn("at", F.rank().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("at") <= top)
    found = stage(found.select("lang", "w1", "w2", "w3", "a", "l", "r", "score"), "scored-phrases")
    for w in ("w1", "w2", "w3"):
        found = found.join(vocab.select(F.col("id").alias(w), F.col("word").alias(f"{w}_word")), w, "left" if w == "w3" else "inner")
    spelt = found.withColumn("phrase", F.concat_ws(" ", "w1_word", "w2_word", "w3_word"))
    ranked = spelt.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")))
    ranked = (ranked if top is None else ranked.where(F.col("at") <= top)).withColumn("rank", F.col("at").cast("long"))
    sizes = told.groupBy("lang").agg(F.sum("total").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
