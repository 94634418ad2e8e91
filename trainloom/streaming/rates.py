"""Event streams: tumbling rates, sessions, intervals with state, and the tail of an edit log."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", schema: str | StructType = EVENTS) -> DataFrame:
    """Events as they arrive in a folder; ts is taken as UTC."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    epoch = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return rows.withColumn("ts", F.timestamp_micros(epoch))


def tumbling_rates(events: DataFrame, width: str, late: str) -> DataFrame:
    """start, key, n, total of each window and event type; events later than `late` are dropped once a window is closed."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("event_type").alias("key"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """user_id, start, end, n of each run of a user's events without a pause of `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def intervals(events: DataFrame) -> DataFrame:
    """user_id, n, shortest: how many events of a user came by, and the least interval (microseconds) between them; state is one row a user.

    Within a batch events are put in order; one that is earlier than all seen before counts, its interval does not.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n, least = state.get if state.exists else (-1, 0, -1)
        times = sorted(t for b in batches for t in b["us"].tolist())
        for t in times:
            if last >= 0 and t >= last and (least < 0 or t - last < least):
                least = t - last
            last, n = max(last, t), n + 1
        state.update((last, n, least))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "shortest": [least]})

    rows = events.select("user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, shortest long", "last long, n long, least long", "update", "NoTimeout")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; only a local master may go without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='trainloom-')).rstrip('/')}/drained-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now and gives the table of its results, which is written: of mode complete the last batch's, else all batches'."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}"))
    query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    try:
        rows = spark.read.schema(StructType([*stream.schema.fields]).add("batch", "long")).parquet(f"{folder}/rows")
    except AnalysisException:  # no batch ran, as there was nothing to read
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        rows = rows.where(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0]))
    return rows.select(*stream.columns)


def log_tail(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of an edit log's Parquet files as they are appended."""
    return spark.readStream.schema(schema).parquet(folder)


def follow_log(stream: DataFrame, sink: str, checkpoint: str):
    """Appends every new record to a table, each batch once: a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
