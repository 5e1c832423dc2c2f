"""Joins that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before its time: union, then one window over the key."""
    a = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1))
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    last = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return last.select(*left.columns, *[F.col("__last")[v].alias(v) for v in values])


def salted(left: DataFrame, right: DataFrame, on: str, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join with a hot key: left rows are dealt over ``salts``, right rows are copied to each."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [on, "__salt"], how).drop("__salt")
