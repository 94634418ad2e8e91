"""Queries of shapes, features and probes, with their oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainloom.operators import learn, probe, shape
from trainloom.plans.queries import RATE, RP, query, rounded
from trainloom.plans.tables import read, rebased, spikes

#: Templates of the tables: mean price by part of the month (sample) and line (channel) of each return flag.
TEMPLATES = "tp AS (SELECT l_returnflag AS template_id, (day(l_shipdate) - 1) AS s, l_linenumber AS ch, round(avg(l_extendedprice), 2) - 38000 AS v FROM lineitem GROUP BY 1, 2, 3)"


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("template_id"), (F.dayofmonth("l_shipdate") - 1).alias("s"), F.col("l_linenumber").alias("ch"))
    return rows.agg((F.round(F.avg("l_extendedprice"), 2) - 38000).alias("v"))


def channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, float(10 * (c % 2)), float(20 * c), c // 4) for c in range(8)], "ch int, x double, y double, shank int")


@query(f"WITH {TEMPLATES}, r AS (SELECT template_id, ch, max(v) - min(v) AS ptp FROM tp GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ptp DESC, ch) AS k FROM r) SELECT template_id, ch, round(ptp, 4) AS ptp FROM k WHERE k = 1")
def peak_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.peak_channels(templates(spark, sf_dir)), 4)


@query()
def template_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.template_shapes(templates(spark, sf_dir), channels(spark), 1000.0), 6)


@query("""WITH c AS (SELECT c AS ch, 10.0 * (c % 2) AS x, 20.0 * c AS y, c // 4 AS shank FROM range(8) r(c)),
    d AS (SELECT a.ch, b.ch AS other, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS dist FROM c a JOIN c b USING (shank)), k AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY dist, other) AS k FROM d)
    SELECT ch, other, round(dist, 9) AS dist FROM k WHERE k <= 3""")
def nearest_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.nearest_channels(channels(spark), 3))


@query("""WITH p AS (SELECT vec_id AS spike_idx, i - 1 AS ch, embedding[i]::DOUBLE AS pc FROM embeddings, range(1, 9) r(i)), w AS (SELECT spike_idx, greatest(pc, 0)**2 AS w, 20.0 * ch AS y FROM p)
    SELECT spike_idx, round(sum(w * y) / nullif(sum(w), 0), 7) AS depth FROM w GROUP BY 1""")
def weighted_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spike_idx"), F.posexplode(F.slice("embedding", 1, 8)).alias("ch", "pc")).withColumn("pc", F.col("pc").cast("double"))
    return rounded(shape.weighted_depth(rows, channels(spark)), 7)


@query("""WITH $SPIKES, b AS (SELECT *, least(floor(t / greatest(total / 6.0, 1.0)), 5)::BIGINT AS bin FROM s), m AS (SELECT cluster_id, bin, count(*) AS n, median(amplitude) AS md FROM b GROUP BY 1, 2),
    o AS (SELECT cluster_id, median(amplitude) AS w FROM s GROUP BY 1), f AS (SELECT cluster_id, bin, any_value(n) AS n, any_value(md) AS md, median(abs(amplitude - md)) AS mad FROM b JOIN m USING (cluster_id, bin) GROUP BY 1, 2)
    SELECT cluster_id, bin, n, CASE WHEN n >= 4 THEN round(md, 9) END AS median, CASE WHEN n >= 4 THEN round(mad, 9) END AS mad, CASE WHEN n >= 4 AND w <> 0 THEN round(md / w, 9) END AS relative FROM f JOIN o USING (cluster_id)""")
def amplitude_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    return rounded(learn.amplitude_by_time(trains, total, 6))


@query("""WITH $SPIKES, m AS (SELECT cluster_id, median(amplitude) AS md FROM s GROUP BY 1), f AS (SELECT cluster_id, any_value(md) AS md, greatest(1e-6, 1.4826 * median(abs(amplitude - md))) AS sc FROM s JOIN m USING (cluster_id) GROUP BY 1),
    w AS (SELECT *, t - lag(t) OVER o AS b, lead(t) OVER o - t AS a, (rank() OVER (PARTITION BY cluster_id ORDER BY amplitude) - 1 + 0.5 * count(*) OVER (PARTITION BY cluster_id, amplitude)) / count(*) OVER (PARTITION BY cluster_id) AS pct FROM s WINDOW o AS (PARTITION BY cluster_id ORDER BY t, spike_idx))
    SELECT cluster_id, spike_idx, round((amplitude - md) / sc, 7) + 0.0 AS amp_z, round(pct, 7) AS amp_pct, round(log10(1 + b / 1000.0), 7) AS log_isi_before, round(log10(1 + a / 1000.0), 7) AS log_isi_after, coalesce(b <= $RP, false) OR coalesce(a <= $RP, false) AS refractory FROM w JOIN f USING (cluster_id)""")
def spike_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.spike_features(rebased(spikes(spark, sf_dir))[0], RATE, RP), 7)


@query("""WITH $SPIKES, x AS (SELECT cluster_id, spike_idx, amplitude, ln(isi / 1000.0) AS x FROM i WHERE isi > 0), f AS (SELECT cluster_id, count(*) AS n, regr_slope(amplitude, x) AS slope, avg(x) AS mx FROM x GROUP BY 1)
    SELECT cluster_id, spike_idx, round(slope, 6) + 0.0 AS slope, round(amplitude - slope * (x - mx), 6) + 0.0 AS residual FROM x JOIN f USING (cluster_id) WHERE n >= 8 AND slope IS NOT NULL""")
def isi_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probe.isi_residuals(rebased(spikes(spark, sf_dir))[0], RATE), 6)


@query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS sd FROM orders GROUP BY 1, 2""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return rounded(learn.run_report(rows, ["status", "priority"], "o_totalprice"), 4)


#: Labelled rows, those of least hash, that the trees of boosted_labels are fitted to at most; every document is scored.
FIT_ROWS = 5000


@query()
def boosted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels learned from simple counts of each labelled document, and a score for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("n"), F.regexp_count("text", F.lit("[A-Z]")).cast("double").alias("upper"), F.regexp_count("text", F.lit("[#*$%&|<>!]")).cast("double").alias("marks"))
    rows = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").orderBy(F.xxhash64("doc_id")).limit(FIT_ROWS).toPandas()
    model = learn.boost(rows[["n", "upper", "marks"]].to_numpy(float), rows["quality"].to_numpy(float), rounds=30)
    return rounded(learn.score(docs, model, ["n", "upper", "marks"]).select("doc_id", "prediction"), 6)


@query("""WITH $SPIKES, w AS (SELECT *, t - 86400000000 AS u FROM s WHERE cluster_id = 3 AND t >= 86400000000 AND t < 864000000000)
    SELECT 'window' AS part, count(*) AS n_spikes, round(count(*) / 777600.0, 9) AS firing_rate FROM w UNION ALL SELECT 'whole', count(*), round(count(*) / (any_value(total) / 1e6), 9) FROM s WHERE cluster_id = 3""")
def probe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    return rounded(probe.run(trains, probe.parse("window 3 86400 864000"), total, RATE, RP).select("part", "n_spikes", "firing_rate"))


@query()
def matched_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a small filter over the hourly totals of two event types."""
    rows = rebased(spikes(spark, sf_dir))[0].withColumn("h", F.floor(F.col("t") / 3_600_000_000))
    total = lambda kind: F.sum(F.when(F.col("template") == kind, F.col("amplitude")).otherwise(0.0))
    trace = rows.groupBy(F.col("h").alias("t")).agg(F.array(total("click"), total("view")).alias("samples"))
    hours = spark.range(720).select(F.col("id").alias("t")).join(trace, "t", "left").select("t", F.coalesce("samples", F.array(F.lit(0.0), F.lit(0.0))).alias("samples"))
    return rounded(shape.matched_filter_scores(hours, np.array([[0.5, 0.1], [1.0, 0.2], [0.5, 0.1]]), [0, 1], 100), 6)
