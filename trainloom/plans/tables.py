"""Adapters from tables of a folder to the engine's own frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ticks a second of the event tables: their times are microseconds.
RATE = 1_000_000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes_from_events(events: DataFrame) -> DataFrame:
    """spike_idx, cluster_id, t, amplitude, template of an event table: one spike an event, a cluster a user.

    TIMESTAMP without zone is taken as UTC, by arithmetic that does not depend on the session's zone.
    """
    epoch = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select(F.col("event_id").alias("spike_idx"), F.col("user_id").alias("cluster_id"), epoch.alias("t"), F.col("value").alias("amplitude"), F.col("event_type").alias("template"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes_from_events(read(spark, sf_dir, "events"))


def span(trains: DataFrame) -> tuple[int, int]:
    """First tick and number of ticks of a recording that just holds all spikes; one row comes to the driver."""
    first, last = trains.agg(F.min("t"), F.max("t")).first()
    return (0, 0) if first is None else (first, last - first + 1)


def rebased(trains: DataFrame) -> tuple[DataFrame, int]:
    """trains with t from 0 on, and the recording's length."""
    first, total = span(trains)
    return trains.withColumn("t", F.col("t") - first), total
