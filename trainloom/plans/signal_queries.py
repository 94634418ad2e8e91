"""Queries of signals, models and streams, with oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainloom.operators import models, signal
from trainloom.plans.queries import query, rounded
from trainloom.plans.tables import read, rebased, spikes
from trainloom.streaming import rates

#: A trace of the tables: a time step an order, a channel a line.
TRACE = "tr AS (SELECT l_orderkey AS t, l_linenumber AS ch, sum(l_quantity) AS v, l_returnflag AS shank FROM lineitem GROUP BY 1, 2, 4)"


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("ch"), F.col("l_returnflag").alias("shank"))
    return rows.agg(F.sum("l_quantity").alias("v")).select("t", "ch", "shank", "v")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly totals of the event types as series (ch, t, v)."""
    rows = rebased(spikes(spark, sf_dir))[0]
    return rows.groupBy(F.col("template").alias("ch"), F.floor(F.col("t") / 3_600_000_000).alias("t")).agg(F.round(F.sum("amplitude"), 4).alias("v"))


DAILY = """hr AS (SELECT event_type AS ch, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000 AS t, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"""


@query(f"WITH {TRACE} SELECT t, ch, shank, round(v - median(v) OVER (PARTITION BY t), 9) + 0.0 AS v FROM tr")
def median_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.subtract_median(trace(spark, sf_dir), ["t"]))


@query(f"WITH {TRACE} SELECT t, ch, shank, round(v - median(v) OVER (PARTITION BY t, shank), 9) + 0.0 AS v FROM tr")
def median_removed_by_shank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.subtract_median(trace(spark, sf_dir), ["t", "shank"]))


@query(f"""WITH {DAILY}, w AS (SELECT *, max(v) OVER (PARTITION BY ch ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, max(v) OVER (PARTITION BY ch ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM hr)
    SELECT ch, t, v FROM w WHERE (b IS NULL OR v > b) AND (a IS NULL OR v >= a) AND v BETWEEN 10 AND 1000000""")
def picked_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.peaks(daily(spark, sf_dir), 3, 10.0, 1_000_000.0, ["ch"])


@query(f"WITH {DAILY}, c AS (SELECT *, (t * 24 // 720) AS col, row_number() OVER (PARTITION BY ch, t * 24 // 720 ORDER BY abs(v) DESC, t) AS k FROM hr WHERE t < 720) SELECT ch, col::INT AS col, v FROM c WHERE k = 1")
def pixel_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.pixel_columns(daily(spark, sf_dir), 0, 720, 24)


@query(f"""WITH {DAILY}, p AS (SELECT event_id AS spike_idx, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000 AS t FROM events WHERE event_type = 'purchase'),
    s AS (SELECT spike_idx, (hr.t - p.t + 2)::INT AS pos, ch, v FROM p JOIN hr ON hr.t BETWEEN p.t - 2 AND p.t + 3 WHERE p.t >= 2 AND p.t + 3 < 720) SELECT ch, pos, round(avg(v), 7) AS v FROM s GROUP BY 1, 2""")
def mean_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rebased(spikes(spark, sf_dir))[0].where("template = 'purchase'").select("spike_idx", F.floor(F.col("t") / 3_600_000_000).alias("t"))
    return rounded(signal.mean_snippet(signal.snippets(daily(spark, sf_dir), rows, 2, 3, 720)), 7)


@query()
def highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.filtered(daily(spark, sf_dir), signal.highpass(0.05, 1.0), 240, 100), 6)


@query()
def lttb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.lttb(daily(spark, sf_dir), "ch", 50)


@query()
def refractory_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rebased(spikes(spark, sf_dir))[0]
    found = rows.where("template <> 'view'").select(F.col("template").alias("unit"), "t", F.col("amplitude").alias("v"))
    taken = rows.where("template = 'view'").select(F.lit("click").alias("unit"), "t")
    return signal.refractory(found, taken, 600_000_000, 600_000_000)


@query("""WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, user_id, value FROM e WHERE n <= 10 OR floor(k * 10 / n) <> floor((k - 1) * 10 / n)""")
def spread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.spread(read(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", 10)


@query("""WITH p AS (SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400e6 AS x, value AS y FROM events)
    SELECT event_id FROM p WHERE CASE WHEN (0 > y) <> (100 > y) AND x < (30 - 0) * (y - 0) / (100 - 0) + 0 THEN 1 ELSE 0 END + CASE WHEN (100 > y) <> (0 > y) AND x < (10 - 30) * (y - 100) / (0 - 100) + 30 THEN 1 ELSE 0 END = 1""")
def lasso_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a triangle of day and value."""
    rows = rebased(spikes(spark, sf_dir))[0].withColumns({"x": F.col("t") / 86400e6, "y": F.col("amplitude")})
    return rows.where(signal.in_polygon(F.col("x"), F.col("y"), [(0.0, 0.0), (30.0, 100.0), (10.0, 0.0)])).select(F.col("spike_idx").alias("event_id"))


@query("""WITH t AS (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS total, min(epoch_us(ts)) AS a, count(*) AS n FROM events),
    e AS (SELECT event_id, epoch_us(ts) - a AS t FROM events, t)
    SELECT event_id FROM e WHERE (t >= 0 AND t < 86400000000) OR (t >= 864000000000 AND t < 950400000000)""")
def chunked_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rebased(spikes(spark, sf_dir))[0]
    return signal.in_chunks(rows, [(0, 86_400_000_000), (864_000_000_000, 950_400_000_000)]).select(F.col("spike_idx").alias("event_id"))


@query()
def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.isolation_by_group(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 6), 6)


@query()
def amplitude_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.mixture_by_group(read(spark, sf_dir, "events"), "user_id", "event_id", "value"), 6)


@query()
def kmeans_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.kmeans_by_group(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 6, 2), 6)


@query("""WITH i AS (SELECT unnest(range(1, 5)) AS i), v AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, i)
    SELECT x.i - 1 AS i, y.i - 1 AS j, round(covar_samp(x.v, y.v), 9) + 0.0 AS c FROM v x JOIN v y ON x.vec_id = y.vec_id GROUP BY 1, 2""")
def vector_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = models.covariance(read(spark, sf_dir, "embeddings"), "embedding", 4)
    return spark.createDataFrame([(i, j, round(float(c[i, j]), 9) + 0.0) for i in range(4) for j in range(4)], "i long, j long, c double")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS key, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def streaming_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates.drain(rates.tumbling_rates(rates.event_stream(spark, sf_dir), "1 day", "2 days"), "complete")
    return found.select(F.expr("cast(from_utc_timestamp(start, current_timezone()) as timestamp_ntz)").alias("start"), "key", "n", F.round("total", 6).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, count(*) AS n FROM r GROUP BY user_id, run""")
def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.drain(rates.sessions(rates.event_stream(spark, sf_dir), "6 hours", "2 days"), "complete").select("user_id", "n")


@query("""WITH i AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) SELECT user_id, count(*) AS n, coalesce(min(d), -1) AS shortest FROM i GROUP BY 1""")
def streaming_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.drain(rates.intervals(rates.event_stream(spark, sf_dir)), "update").groupBy("user_id").agg(F.max_by("n", "n").alias("n"), F.max_by("shortest", "n").alias("shortest"))
