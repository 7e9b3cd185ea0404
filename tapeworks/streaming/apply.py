"""Patterns on streams: application is row by row, so a streaming frame takes the same columns; only counts over time hold state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import apply as ops
from tapeworks.plans.pmatch import Matcher


def tagged(stream: DataFrame, text: str, m: Matcher) -> DataFrame:
    """A row for each tag that a row's text has: the row's columns, ``tag`` and ``n``."""
    return stream.withColumn("_tags", ops.tag_counts(m)(text)).select(*stream.columns, F.explode("_tags").alias("tag", "n"))


def counts_by_window(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n) for each window of event time; rows later than ``late`` behind the latest are left out, and so is their state."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), key, "n")


def run_once(spark: SparkSession, result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that the sources have now, written to a path and read back; the checkpoint makes a restart go on where it ended."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)
