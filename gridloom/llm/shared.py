"""Helpers that the operators of this subpackage share.

Written tables cut lineage: ``stage`` writes a DataFrame below the folder that
``spark.checkpoint.dir`` names (all executors see it) and reads it back, so a
lost executor costs at most the tasks of the running stage.
"""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch between JVM and Python; whole texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Splits of a small input at least; those of a large one are of ``spark.sql.files.maxPartitionBytes``.
LEAST_SPLITS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; own one only if the session names none and everything runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        path = context.getCheckpointDir()
        if not path:
            if not context.master.startswith("local["):
                raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
            path = context.getCheckpointDir()
    return path.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle(spark: SparkSession) -> None:
    """Settings that results or memory rest on, given fixed values once where the session has none.

    Batches are bounded by rows and bytes; a scan's splits follow from its files and not from which executors are up.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.files.minPartitionNum", LEAST_SPLITS)):
        if not spark.conf.get(key, None):
            spark.conf.set(key, str(value))


def map_columns(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str, rows: int = 0) -> DataFrame:
    """``mapInArrow`` where ``work`` sees and yields dicts of columns (Arrow arrays in, lists or arrays out); small rows can be put together ``rows`` at a time."""
    settle(df.sparkSession)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(n) for n in b.schema.names} for b in (_together(batches, rows) if rows else batches))
        for out in work(columns):
            yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= 4 * BATCH_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def texts(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def file_count(df: DataFrame) -> int:
    """Input splits of a scan: a number of tasks that grows with the input."""
    settle(df.sparkSession)
    return max(1, df.rdd.getNumPartitions())


def file_system(path: str):
    """Arrow's file system of a path in the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def write_whole(path: str, data: bytes) -> None:
    """A file that is there completely or not at all, however often the task runs."""
    store, at = file_system(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, at)


def read_whole(path: str) -> bytes | None:
    store, at = file_system(path)
    if not store.get_file_info(at).is_file:
        return None
    with store.open_input_stream(at) as f:
        return f.read()


class Side:
    """Arrays of a shard in the shared folder."""

    def __init__(self, root: str):
        self.root = root

    def keep(self, name: str, shard: int, **arrays: np.ndarray) -> None:
        out = io.BytesIO()
        np.savez(out, **arrays)
        write_whole(f"{self.root}/{name}/{shard}", zstandard.compress(out.getvalue(), 1))

    def load(self, name: str, shard: int) -> dict[str, np.ndarray] | None:
        data = read_whole(f"{self.root}/{name}/{shard}")
        return None if data is None else dict(np.load(io.BytesIO(zstandard.decompress(data))))


def dealt(rows: DataFrame, of: str, count: int, *order: str) -> DataFrame:
    """Rows of one ``of`` (0 to ``count`` - 1) together, in order; a task takes one after another."""
    parts = min(count, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 16))
    return rows.repartitionById(parts, F.expr(f"cast({of} * {parts} div {count} as int)")).sortWithinPartitions(*order)


def grouped(batches, key: str):
    """(key, its rows) of sorted batches, rows as tuples of the other columns."""
    at, held = None, []
    for b in batches:
        others = [b[n].to_pylist() for n in b if n != key]
        for k, *row in zip(b[key].to_pylist(), *others, strict=True):
            if k != at:
                if held:
                    yield at, held
                at, held = k, []
            held.append(row)
    if held:
        yield at, held
