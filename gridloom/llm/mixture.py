"""Mixing sources to target weights by exact word budgets.

Each document gets a hash-random key, the MD5 of its id and its text's MD5. Sources are cut in key
order: distributed prefix sums of sizes (sums of key ranges first, then a window
within each range) say where a document lies in its source, and the budget says
how much of it is taken: whole epochs first, then the documents below the rest,
the one across the cut in part.

Defined results: a null text has size 0 and takes 0; null is a source of its
own, the last; rows with equal or null ids each count, and equal rows lie next to
each other; an empty table gives an empty result; other columns are ignored by
``plan_mixture`` and kept by ``apply_mixture``, where a row is known by its id,
source and text and its rank among rows that are equal in these.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a key range, about, and the hex digits of the key that name one at least.
RANGE_ROWS, RANGE_DIGITS = 100_000, 3


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``: shares of all sizes by weight, none above ``most`` times its size.

    Sources sorted by ``most * size / weight`` fill up in that order. After the
    first k are full, the level of the rest is (total - their caps) / (rest of
    the weights); the sources whose ratio is below the level at their turn are full.
    The table has a row a source and is summed up before it gets here.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    whole = Window.partitionBy(F.lit(0))
    by_ratio = whole.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    # The level rises while sources fill up and falls if one is taken for full that isn't.
    return ranked.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.max("level").over(whole))).select("source", "source_size", "target")


def plan_mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, text_hash`` for every row."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))
    sized = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"), key.alias("key"), F.xxhash64(text_col).alias("text_hash")),
        "sizes",
    )
    digits = max(RANGE_DIGITS, math.ceil(math.log(max(1, sized.count() / RANGE_ROWS), 16)))
    sized = sized.withColumn("key_range", F.substring("key", 1, digits))
    ranges = sized.groupBy("source", "key_range").agg(F.sum("size").alias("range_size"))
    below = Window.partitionBy("source").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(below), F.lit(0)))
    sources = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    same = F.col("ranges.source").eqNullSafe(F.col("sources.source"))
    cuts = ranges.alias("ranges").join(sources.alias("sources"), same).select("ranges.source", "key_range", "range_start", "source_size", "target")

    inside = Window.partitionBy("source", "key_range").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("docs")
    joined = placed.join(cuts.alias("cuts"), F.col("docs.source").eqNullSafe(F.col("cuts.source")) & (F.col("docs.key_range") == F.col("cuts.key_range")))
    budget = F.floor("target")
    epochs = F.expr("floor(target) div greatest(source_size, 1)")
    rest = budget - epochs * F.col("source_size") - F.col("range_start") - F.col("in_range")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return joined.select("doc_id", "docs.source", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_hash")


def apply_mixture(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: a row for each epoch of a document; the last may be cut to its first words, space-joined, if the budget ends there.

    ``docs`` has the rows of the plan; those of which nothing is taken go. Columns stay as they are.
    """
    names = docs.columns
    equal = Window.partitionBy("__id", "__source", "__hash")
    share = plan.where(F.col("taken") > 0).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    share = share.withColumn("__rank", F.row_number().over(equal.orderBy("__taken"))).alias("share")
    rows = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__hash": F.xxhash64(text_col)})
    rows = rows.withColumn("__rank", F.row_number().over(equal.orderBy(F.lit(0)))).alias("rows")  # equal texts: any order
    same = [F.col(f"rows.{n}").eqNullSafe(F.col(f"share.{n}")) for n in ("__id", "__source")]
    same += [F.col(f"rows.{n}") == F.col(f"share.{n}") for n in ("__hash", "__rank")]
    rows = rows.join(share, same).select(*[F.col(f"rows.`{n}`") for n in names], "__size", "__taken")
    epochs = F.ceil(F.col("__taken") / F.col("__size")).cast("int")
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(1), epochs)))
    left = F.col("__taken") - (F.col("__epoch") - 1) * F.col("__size")
    head = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")))
    return rows.withColumn(text_col, F.when(left < F.col("__size"), head).otherwise(F.col(text_col))).select(*names)
