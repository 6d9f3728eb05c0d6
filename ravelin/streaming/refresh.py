"""Rebuild an index whenever chunk files arrive (file-source Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def rebuild_on_arrival(spark: SparkSession, folder: str, schema: str, build: Callable[[DataFrame], None], checkpoint: str, once: bool = True):
    """Call build with all rows of a folder for each micro-batch of new JSON-lines files."""
    arrivals = spark.readStream.schema(schema).json(folder)
    query = arrivals.writeStream.foreachBatch(lambda batch, _: build(spark.read.schema(schema).json(folder))).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
