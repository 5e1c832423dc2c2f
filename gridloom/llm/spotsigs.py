"""Document fingerprints by SpotSigs.

A signature is a common word (the anchor) and the chain of the content words
that follow it. A document's signatures, hashed and sorted, are its fingerprint;
likeness is the Jaccard index of two. Near-duplicate search partitions documents
by the length of their set, so only neighbouring lengths meet, and a pair is
given up as soon as its length or its remaining signatures can't reach the
threshold.

Defined results: a null or empty text has the one signature 0, so such texts are
alike; a text without any anchor has one signature of all its words; null ids
come last in descending order, ids of any type as Spark orders them; rows of one
id are ordered by their text's hash;
a single document is followed by itself; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .shared import file_count, map_columns, stage, texts
from .wordhash import chain, mix, word_hashes

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
    "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sie", "und", "von", "zu",
    "au", "ce", "dans", "des", "du", "est", "et", "la", "le", "les", "ne", "par", "pour", "que", "qui", "un", "une",
    "de", "del", "el", "en", "es", "las", "los", "no", "por", "se", "su", "y",
)
CHAIN = 2
#: Range buckets of ids at most; each is sorted and streamed, so its size bounds no memory.
MOST_BUCKETS = 16_384
#: Ids in the sample of other ids than numbers, a range, from which its cuts are taken.
SAMPLED = 32
_LEAST_ID = -(1 << 63)
_anchors = np.sort(np.array([xxhash.xxh64_intdigest(w) | 1 for w in ANCHORS], np.uint64))


def signatures(text: str, length: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures."""
    words = word_hashes(text)
    if not len(words):
        return np.zeros(1, np.uint32)
    at = np.searchsorted(_anchors, words)
    common = _anchors[np.minimum(at, len(_anchors) - 1)] == words
    content = np.flatnonzero(~common)
    spots = np.flatnonzero(common)
    follow = np.searchsorted(content, spots)
    whole = follow + length <= len(content)
    spots, follow = spots[whole], follow[whole]
    if not len(spots):
        return np.array([int(mix(np.array([xxhash.xxh64_intdigest(words.tobytes())], np.uint64))[0]) >> 32], np.uint32)
    found = chain(words[spots], *[words[content[follow + i]] for i in range(length)])
    return np.unique((found >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard index of sorted distinct sets; 0 without a comparison if the lengths can't reach ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (len(a) + len(b) - both)
    return found if found >= least else 0.0


def text_fingerprint(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Rows dealt by id range and sorted so that each is followed by the next document in descending id.

    The first row of each range is also sent to the range before it (``halo``);
    that of the first range, to the last. Texts are shuffled once.
    """
    numeric = isinstance(docs.schema[id_col].dataType, NumericType)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID)) if numeric else F.col(id_col).cast("string")
    ids = docs.select(key.alias("k"), F.col(id_col).alias("id"))
    n = min(MOST_BUCKETS, file_count(docs))
    cuts = (ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10 * n + 100)).collect()[0][0] or []) if numeric else _text_cuts(ids, n)
    kind = "long" if numeric else "string"
    bounds = F.array(*[F.lit(c).cast(kind) for c in sorted(set(cuts))]).cast(f"array<{kind}>")
    bucket = lambda k: F.when(k.isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: c < k)))
    heads = ids.withColumn("bucket", bucket(F.col("k"))).groupBy("bucket").agg(F.max("id").alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("bucket"))  # a row for each range: at most MOST_BUCKETS
    whole = Window.partitionBy(F.lit(0))
    heads = heads.withColumn("before", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(whole)))
    heads = heads.select(F.col("bucket").alias("of"), "head", "before")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("k"))
    rows = rows.withColumn("bucket", bucket(F.col("k"))).join(F.broadcast(heads), F.col("bucket") == F.col("of"))
    to = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(F.struct(F.col("bucket"), F.lit(False).alias("halo")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("halo"))))
    rows = rows.withColumn("to", F.explode(F.coalesce(to, F.array(F.struct(F.col("bucket"), F.lit(False).alias("halo"))))))
    rows = rows.select("doc_id", "text", "to.bucket", "to.halo")
    dealt = rows.repartitionById(len(set(cuts)) + 1, F.col("bucket").cast("int"))
    return dealt.sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text")), docs.schema[id_col].dataType.simpleString()


def _text_cuts(ids: DataFrame, n: int) -> list[str]:
    """Quantiles of ids that are no numbers, by whole ids: of a hash sample of the different ids, each with the rows that have it, ``SAMPLED`` a range."""
    total = ids.agg(F.approx_count_distinct("k")).collect()[0][0] or 1
    share = min(1 << 30, (1 << 30) * SAMPLED * n // total + 1)
    found = ids.where(F.col("k").isNotNull() & (F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share)).groupBy("k").count().collect()
    held = sorted((r["k"].encode(), r["count"]) for r in found)
    rows, cuts, seen = sum(c for _, c in held), [], 0
    for k, c in held:
        if seen * n // max(1, rows) < (seen + c) * n // max(1, rows):
            cuts.append(k.decode())
        seen += c
    return cuts[:-1]


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of the text with its last third replaced from the next document, and their likeness."""
    rows, kind = followed(docs, id_col, text_col)
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        held = None  # bucket, id, text, signatures of the row that waits for its follower
        for b in batches:
            out = []
            for bucket, halo, doc_id, text in zip(b["bucket"].to_pylist(), b["halo"].to_pylist(), b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                if halo and not held:
                    continue  # the follower has been taken from another copy
                sigs = signatures(text)
                if held and held[0] == bucket:
                    out.append(_compare(*held[1:], text, sigs))
                held = None if halo else (bucket, doc_id, text, sigs)
            yield {n: [row[i] for row in out] for i, n in enumerate(names)}

    return map_columns(rows.select("bucket", "halo", "doc_id", "text"), work, schema)


def _compare(doc_id, text: str, sigs: np.ndarray, follower: str, follower_sigs: np.ndarray) -> tuple:
    third = len(text) // 3
    edited = text[: len(text) - third] + follower[:third]
    edited_sigs = signatures(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_fingerprint(sigs), text_fingerprint(edited_sigs), likeness(sigs, edited_sigs), likeness(sigs, follower_sigs)


def signature_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sigs`` (sorted, distinct)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "sigs": [signatures(t).astype(np.int64) for t in texts(b["text"])]}

    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, f"doc_id {kind}, sigs array<long>")


def near_pairs(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """``key_a, class_a, key_b, class_b, likeness`` of distinct signature sets with Jaccard at least ``least``.

    A key is the digest of a set, a class the least id that has it (null if none has an id).

    Sets are partitioned by the logarithm of their length (base 1/``least``), so a
    partner lies in the same partition or the next. There, the rarest signatures
    of each set (as many as must hold one in common) are the candidates' keys,
    lengths prune, and the Jaccard index decides. Equal sets are one class. Keys
    travel alone; sets are fetched for candidates. Skewed signatures are left to
    the skew handling of adaptive joins.
    """
    n = F.size("sigs")
    part = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / least)) + 1e-9)
    keyed = sets.withColumn("key", F.md5(F.concat_ws(",", F.col("sigs").cast("array<string>")).cast("binary")))
    classes = stage(keyed.groupBy("key").agg(F.min("doc_id").alias("class"), F.first("sigs").alias("sigs")).withColumn("n", n).withColumn("part", part), "classes")
    spread = classes.select("key", "n", "part", F.explode("sigs").alias("sig"))
    ranked = spread.join(spread.groupBy("sig").count(), "sig").groupBy("key", "n", "part").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("by"))  # a set's own signatures
    keep = (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int")
    rare = ranked.select("key", "n", "part", F.explode(F.slice("by", F.lit(1), keep)).alias("k")).select("key", "n", "part", "k.sig")
    left = rare.select(F.col("key").alias("key_a"), F.col("n").alias("n_a"), "sig", "part")
    right = rare.select(F.col("key").alias("key_b"), F.col("n").alias("n_b"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    earlier = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("key_a") < F.col("key_b")))
    pairs = left.join(right, ["sig", "part"]).where(earlier & (F.col("n_a") >= least * F.col("n_b"))).select("key_a", "key_b").distinct()
    for side in "ab":
        pairs = pairs.join(classes.select(*[F.col(c).alias(f"{c}_{side}") for c in ("key", "class", "sigs")]), f"key_{side}")
    both = F.size(F.array_intersect("sigs_a", "sigs_b"))
    jaccard = both / (F.size("sigs_a") + F.size("sigs_b") - both)
    return pairs.select("key_a", "class_a", "key_b", "class_b", jaccard.alias("likeness")).where(F.col("likeness") >= least)
