"""Transition counts over recordings that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handloom.operators import transitions
from handloom.runtime import scratch


def accumulate(stream: DataFrame, table: str, checkpoint: str, delta_t: int = 1, available_now: bool = True):
    """Start the query that adds the counts of each micro-batch of token rows to the Parquet table ``table``.

    A recording must arrive within one micro-batch, as files do: a track ends where its batch ends. A batch that is run
    again after a failure overwrites its own part, so nothing counts twice. Nothing intermediate outlives its batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            transitions.count_by_file(batch, delta_t).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def accumulated(spark: SparkSession, table: str, min_transitions: int = 0) -> DataFrame:
    """``(src, dst, n)`` of everything accumulated so far."""
    parts = spark.read.parquet(table)
    return parts.groupBy("src", "dst").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(min_transitions, 1))
