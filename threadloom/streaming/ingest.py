"""Streaming forms of the ingest operators: bounded tails, deduplicated appends, running roll-ups.

All queries end by themselves (``availableNow``) or by a time limit, and resume from their
checkpoint; a restart neither repeats nor loses rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.sources.store import write_records


def tail(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_records(stream: DataFrame, root: str, checkpoint: str, minutes: float | None = None) -> None:
    """Append new records of a stream to the corpus; ids that it has, or that a batch repeats, are left out."""
    query = stream.writeStream.foreachBatch(lambda batch, _: write_records(batch, root) and None).option("checkpointLocation", checkpoint)
    if minutes is None:
        query.trigger(availableNow=True).start().awaitTermination()
    else:
        running = query.start()
        running.awaitTermination(int(minutes * 60))
        running.stop()


def deduplicated(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first row of each id within the watermark."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


def author_rollup(stream: DataFrame) -> DataFrame:
    """Running post count, first and last time of every author (update mode)."""
    return stream.groupBy("author_id").agg(F.count(F.lit(1)).alias("post_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def volume(stream: DataFrame, window: str = "1 hour", slide: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Rows per source in sliding windows; late rows count until the watermark passes."""
    return stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", window, slide), "source").agg(F.count(F.lit(1)).alias("n")).select("source", F.col("window.start").alias("start"), "n")
