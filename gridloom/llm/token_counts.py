"""Token counts through a digest cache.

The cache is a Parquet table ``(tokenizer, digest, n_tokens)``: the SHA-256 of
the tokenizer file, the SHA-256 of the normalised content, the count. A run
joins its documents' digests to the stored counts, encodes each distinct miss
once, and appends the new counts.

Defined results: a null text counts as empty and has 0 tokens; an empty table
gives an empty result and leaves the cache as it was; repeated rows and equal
texts are encoded once and each row gets its count; rows with a null id are
kept; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import map_columns, stage, stage_path

CACHE = "tokenizer string, digest string, n_tokens long"


def content(text: str):
    """What the digest is of: runs of ASCII white space become one space, which no count depends on."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row; ``cache_path`` is read and appended to."""
    spark, version = docs.sparkSession, bpe.version_digest(tokenizer_path)
    by_piece = bpe.tokenizer(tokenizer_path).by_piece
    body = content(text_col) if by_piece else F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(body.cast("binary"), 256)
    asked = stage(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest")), "digests")

    append(spark, docs.select(body.alias("body")).withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)), tokenizer_path, version, cache_path)
    # Written first: the join's sides then come straight from shuffles, and Spark can split a hot digest.
    counts = stage(read_cache(spark, cache_path).where(F.col("tokenizer") == version).dropDuplicates(["digest"]), "counts")
    return asked.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def append(spark, bodies: DataFrame, tokenizer_path: str, version: str, cache_path: str) -> None:
    """Encode what the cache lacks. Digests alone are compared with it; only the texts of misses travel."""
    if has_cache(spark, cache_path):
        stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
        missing = stage(bodies.select("digest").distinct().join(stored, "digest", "left_anti"), "missing")
        if missing.isEmpty():
            return
        bodies = bodies.join(missing, "digest", "left_semi")
    distinct = bodies.dropDuplicates(["digest"])

    def encode(batches):
        for b in batches:
            n = bpe.tokenizer(tokenizer_path).counts(b["body"].to_pylist())
            yield {"tokenizer": [version] * len(n), "digest": b["digest"], "n_tokens": n}

    map_columns(distinct.select("digest", "body"), encode, CACHE).write.mode("append").parquet(cache_path)


def read_cache(spark, path: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(path)


def has_cache(spark, path: str) -> bool:
    try:
        spark.read.schema(CACHE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def new_cache(spark) -> str:
    return stage_path(spark, "token-cache")
