"""Enough tasks for a stage that computes much more than it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many tasks as the session has shuffle partitions, whatever its size; a stream stays as it is.

    For stages of milliseconds a row (pictures, alignments): against them moving the rows costs nothing, and neither few
    files nor a run of costly rows leaves cores idle.
    """
    return df if df.isStreaming else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
