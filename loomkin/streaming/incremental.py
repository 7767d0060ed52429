"""Incremental contingency tables and group sizes over a stream (an extension; batch and stream give equal tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_marginal(stream: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Counts so far, for `update` or `complete` mode; state holds one row a cell."""
    return stream.groupBy(*attrs).agg(F.count("*").alias("n"))


def windowed_marginal(stream: DataFrame, attrs: Sequence[str], time: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling window; a watermark lets finished windows leave the state. A time without a zone is one of the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *attrs).agg(F.count("*").alias("n"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Runs over all that is there now, into an in-memory table (tests and reports)."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
