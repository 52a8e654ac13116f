"""Feeds as streams: the registry's intake as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_feed(spark: SparkSession, path: str, schema: str, form: str = "json", per_trigger: int = 100) -> DataFrame:
    """Feed files as they arrive."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", per_trigger).load(path)


def new_entries(feed: DataFrame, keys: list[str], published: str, lookback: str = "30 days") -> DataFrame:
    """Each entry once.  The lookback is the watermark: entries older than it, seen from the newest, are late and dropped;
    undated entries count as dated at their arrival."""
    dated = feed.withColumn(published, F.coalesce(published, F.current_timestamp()))
    return dated.withWatermark(published, lookback).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events per tumbling (or sliding) window and key, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide or size), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key: events no further apart than ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def register(entries: DataFrame, registry_path: str, checkpoint: str, keys: list[str], then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append entries that the registry (Parquet) lacks; a batch that runs again adds nothing twice, because it is anti-joined
    to what is there."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            new = new.join(spark.read.parquet(registry_path).select(*keys), keys, "left_anti")
        except AnalysisException as error:  # the first batch: there is no registry yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        new.write.mode("append").parquet(registry_path)
        if then:
            then(new, number)

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
