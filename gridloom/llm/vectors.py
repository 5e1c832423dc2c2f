"""What the operators over embeddings share: which rows take part, and blocks of vectors as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest 32-bit float; a component beyond it counts as not finite.
MOST = float(np.finfo(np.float32).max)


def usable(rows: DataFrame, column: str, zero: bool = True) -> DataFrame:
    """Rows whose vector is not null and holds finite components only; with ``zero`` false, not zeros alone either. Vectors become arrays of doubles."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > MOST))
    kept = rows.where(x.isNotNull() & ~bad)
    if not zero:
        kept = kept.where(F.exists(x, lambda c: c != 0))
    return kept.withColumn(column, x.cast("array<double>"))


def common_length(kept: DataFrame, column: str, id_column: str, parts: int = 1) -> int:
    """Length of the vector of smallest id whose length is a multiple of ``parts``, 0 without any."""
    of = kept.where((F.size(column) > 0) & (F.size(column) % parts == 0))
    first = of.select(F.min(F.struct(F.col(id_column).isNull(), id_column, F.size(column).alias("n"))).alias("x")).select("x.n").first()
    return first.n or 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    return np.asarray(column.flatten()).reshape(-1, length)


def spin(length: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` x ``length`` matrix with orthonormal columns: a random rotation after padding with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, length)))
    return q * np.sign(np.diag(r))
