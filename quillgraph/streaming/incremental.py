"""Streams: files indexed as they come, and event windows that tolerate late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, store
from ..sources import scan, walk


def symbol_stream(files: DataFrame) -> DataFrame:
    """Symbols and captures of a stream of files (path, content)."""
    return scan.extract(files.withColumn("lang", walk.language_of(F.col("path"))).where("lang IS NOT NULL"))


def upsert_by_path(target: store.Store, finish: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the symbols of a batch's files replace those files' symbols, ids going on from the highest.

    A batch that comes twice leaves the same rows but for ids; `finish` adds blob and embedding.  Edges
    of replaced symbols go with them.  What is written is the batch, and the ids that it replaces.
    """

    def sink(batch: DataFrame, _epoch: int) -> None:
        batch = batch.persist()
        try:
            top = target.top_id()
            new = finish(ranking.number_rows(scan.symbols_of(batch), ["path", "byte", "name"]).withColumn("id", F.col("id") + top))
            target.replace_paths(batch.select("path"), new)
        finally:
            batch.unpersist()

    return sink


def event_counts(events: DataFrame, width: str = "5 seconds", late: str | None = "10 minutes") -> DataFrame:
    """Per window and type: n and sum of value; rows later than `late` are dropped.  None leaves the watermark that the stream has."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's runs of events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def read_events(spark: SparkSession, folder: str, schema, glob: str = "events*.parquet") -> DataFrame:
    """The event table's files as a stream, with instants as timestamps."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
