"""Streams of usage: day totals with late data, and daily rows merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterglass.operators.reports import exact_sum
from meterglass.schema import MESSAGES, TOKENS


def read_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Messages from Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(MESSAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def daily_stream(messages: DataFrame, delay: str = "2 days") -> DataFrame:
    """Totals per UTC day; a day is final, and its state dropped, once the watermark has passed it."""
    timed = messages.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", delay)
    days = timed.groupBy(F.window("ts", "1 day"), "source").agg(
        exact_sum(*TOKENS).alias("tokens"), F.sum("cost").alias("cost"), F.count("*").alias("messages")
    )
    return days.select(F.col("window.start").cast("date").alias("date"), "source", "tokens", "cost", "messages")


def merge_stream(
    submissions: DataFrame, load: Callable[[], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Merge each batch into the stored rows: ``save(merge(load(), batch), batch_id)``.

    ``save`` must write the whole table under the batch's id and switch to it, so that a batch that is
    run again after a failure has the same effect as once.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        save(merge(load(), batch), batch_id)

    return submissions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
