"""Windows over an event stream; the same expressions work on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, late: str = "1 hour") -> DataFrame:
    """A Parquet folder as a stream; times without a zone become timestamps, which a watermark needs."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _time(events: DataFrame):
    """The time column; as it is if it is a timestamp, as any expression around it would lose its watermark."""
    return F.col("ts") if dict(events.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp")


def tumbling(events: DataFrame, width: str) -> DataFrame:
    w = F.window(_time(events), width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window(_time(events), width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window(_time(events), gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived and return the table that it wrote."""
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)
