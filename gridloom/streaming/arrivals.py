"""Office packages that arrive in a folder, as a stream of their cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import spreadsheets

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*.xlsx", a_time: int | None = None) -> DataFrame:
    """Files of a folder as a stream, ``a_time`` in each micro-batch at most."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", a_time) if a_time else reader).load(path)


def first_copies(files: DataFrame, within: str = "1 day") -> DataFrame:
    """Files whose content has not come before, however they are called; a copy counts as one if it comes ``within`` that time of the first.

    The state is a digest a file and ends with the watermark.
    """
    digested = files.withColumn("digest", F.sha2("content", 256))
    return digested.withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["digest"])


def on_new_packages(spark: SparkSession, path: str, checkpoint: str, work: Callable[[DataFrame, int], None]):
    """Call ``work(cells, batch)`` for the spreadsheets of each micro-batch."""
    files = arriving(spark, path)

    def batch(found: DataFrame, number: int) -> None:
        work(spreadsheets.cells(found.sparkSession, found), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
