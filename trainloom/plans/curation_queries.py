"""Queries of suggestions and of the edit log, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainloom.functions import distribution as ds
from trainloom.functions import trains as tr
from trainloom.operators import correlograms as co
from trainloom.operators import curation, suggest
from trainloom.plans.queries import CCG, ORACLE, RATE, RP, SHORT, by_type, query, rounded
from trainloom.plans.tables import read, rebased, spikes

def raw(name: str) -> str:
    """An oracle with hardly any rounding, for use in others."""
    return ORACLE[name].replace(", 9)", ", 14)").replace(", 7)", ", 14)")


COUNTS = """b AS (SELECT template, least(floor(t / greatest(total / 20.0, 1.0)), 19)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1, 2, total),
    h AS (SELECT c.template, k AS bin, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT template FROM s) c CROSS JOIN range(20) r(k) LEFT JOIN b ON b.template = c.template AND b.bin = k),
    o AS (SELECT template, bin, n, CASE WHEN n > 0.1 * max(n) OVER (PARTITION BY template) THEN 1 ELSE 0 END AS o FROM h),
    pc AS (SELECT x.template AS a, y.template AS b, CASE WHEN var_pop(x.n) > 0 AND var_pop(y.n) > 0 THEN least(1, greatest(0, -corr(x.n, y.n))) * (1 - sum(x.o * y.o) / greatest(1, least(sum(x.o), sum(y.o)))) ELSE 0 END AS complement FROM o x JOIN o y ON x.bin = y.bin AND x.template < y.template GROUP BY 1, 2)"""


@query(f"WITH $SPIKES, {COUNTS} SELECT a, b, round(complement, 9) + 0.0 AS complement FROM pc")
def presence_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    trains = trains.withColumn("cluster_id", F.col("template"))
    kinds = trains.select("cluster_id").distinct()
    pairs = kinds.toDF("a").join(kinds.toDF("b"), F.col("a") < F.col("b"))
    return rounded(suggest.presence_complement(tr.presence_counts(trains, total, 20), pairs, 20))


@query(f"""WITH $SPIKES, {CCG.replace("p AS (", "p AS (", 1)}, {COUNTS.replace("b AS (SELECT template, least", "bb AS (SELECT template, least", 1).replace("LEFT JOIN b ON b.template = c.template AND b.bin = k", "LEFT JOIN bb ON bb.template = c.template AND bb.bin = k")},
    m AS (SELECT template, count(*) AS n, avg(amplitude) AS m FROM s GROUP BY 1),
    dz AS (SELECT a, b, (avg(CASE WHEN bin BETWEEN 40 AND 47 OR bin BETWEEN 52 AND 59 THEN n END) - avg(CASE WHEN bin BETWEEN 48 AND 51 THEN n END)) / greatest(1e-6, stddev_pop(CASE WHEN bin BETWEEN 40 AND 47 OR bin BETWEEN 52 AND 59 THEN n END)) AS z FROM d GROUP BY 1, 2),
    ks AS ({ORACLE["ks_two_sample"].replace("round(ks, 9) AS ks", "ks")}),
    j AS (SELECT dz.a, dz.b, dz.z, ks.ks, least(1.0, abs(x.m - y.m) / greatest(abs(x.m), abs(y.m), 1e-6)) AS amp_delta, CASE WHEN pc.complement >= 0.3 THEN pc.complement ELSE 0 END AS complement, x.n AS n_a, y.n AS n_b
      FROM dz JOIN ks ON ks.a = dz.a AND ks.b = dz.b JOIN pc ON pc.a = dz.a AND pc.b = dz.b JOIN m x ON x.template = dz.a JOIN m y ON y.template = dz.b)
    SELECT a, b, round(least(1, greatest(0, 0.6 * (1 - exp(-greatest(z, 0) / 2)) + 0.3 * (1 - ks) + 0.1 * (1 - amp_delta) + 0.25 * complement)), 9) AS score, round(z, 9) + 0.0 AS dip_z, round(ks, 9) AS amp_ks, round(amp_delta, 9) AS amp_delta, round(complement, 9) AS complement, n_a, n_b
    FROM j WHERE amp_delta <= 0.5 ORDER BY score DESC, a, b LIMIT 8""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 8 pairs of event types."""
    total = rebased(spikes(spark, sf_dir))[1]
    return rounded(suggest.merge_candidates(by_type(spark, sf_dir)[0], total, SHORT, 100, 2, 30, 0.5, 0.0, 8))


SPLIT = f"""q AS ({raw("qc_core")}), mo AS ({raw("moments")}),
    sc AS (SELECT q.cluster_id, n_spikes, CASE WHEN n >= 8 THEN bimodality ELSE 0 END AS bimodality, refractory_contamination AS contamination, abs(drift_correlation) AS drift, amplitude_snr AS snr FROM q JOIN mo USING (cluster_id) WHERE n_spikes >= 30),
    sp AS (SELECT *, least(1, greatest(0, (0.6 * least(1, greatest(0, (bimodality - 0.4) / 0.4)) + 0.25 * least(1, greatest(0, 2 * contamination)) + 0.15 * least(1, greatest(0, (drift - 0.3) / 0.5))) * least(1, greatest(0, snr / (snr + 0.5))))) AS score FROM sc)"""


@query(f"WITH {SPLIT} SELECT cluster_id, n_spikes, round(bimodality, 7) AS bimodality, round(contamination, 7) AS contamination, round(drift, 7) AS drift, round(score, 7) AS score FROM sp")
def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    return rounded(suggest.split_scores(trains, total, RATE, RP, 30), 7)


@query(f"""WITH q AS ({raw("qc_core")}), a AS ({raw("amplitude_cutoff")}),
    p AS (SELECT cluster_id, least(1, greatest(0, 1 - refractory_contamination)) AS contamination_score, least(1, greatest(0, presence_ratio)) AS presence_score, least(1, greatest(0, 1 - longest_silent_gap)) AS coverage_score,
      CASE WHEN amplitude_snr <= 0 THEN 0 ELSE amplitude_snr / (amplitude_snr + 1) END AS snr_score, least(1, greatest(0, 1 - 2 * amplitude_cutoff)) AS completeness_score, least(1, greatest(0, 1 - abs(drift_correlation))) AS stability_score FROM q JOIN a USING (cluster_id))
    SELECT cluster_id, round(contamination_score, 9) AS contamination_score, round(presence_score, 9) AS presence_score, round(coverage_score, 9) AS coverage_score, round(snr_score, 9) AS snr_score, round(completeness_score, 9) AS completeness_score, round(stability_score, 9) AS stability_score,
      round(exp((ln(greatest(contamination_score, 1e-3)) + ln(greatest(presence_score, 1e-3)) + ln(greatest(coverage_score, 1e-3)) + ln(greatest(snr_score, 1e-3)) + ln(greatest(completeness_score, 1e-3)) + ln(greatest(stability_score, 1e-3))) / 6), 6) AS quality FROM p""")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    found = suggest.quality(tr.core_metrics(trains, total, RATE, RP), ds.amplitude_cutoff(trains, ["cluster_id"], "amplitude"))
    return rounded(found.withColumn("quality", F.round("quality", 6)))


@query(f"""WITH qu AS ({ORACLE["quality"].replace("/ 6), 6)", "/ 6), 15)")}), {SPLIT}, o AS (SELECT user_id AS cluster_id, avg(CASE WHEN value > 200 THEN 1.0 ELSE 0 END) AS outliers FROM events GROUP BY 1),
    j AS (SELECT qu.cluster_id, 1 - quality AS lq, coalesce(score, 0) AS sp, least(1, 10 * outliers) AS ou, CASE WHEN qu.cluster_id % 7 = 0 THEN 1.0 ELSE 0 END AS rv FROM qu JOIN o USING (cluster_id) LEFT JOIN sp USING (cluster_id))
    SELECT cluster_id, round(greatest(lq, sp, ou, rv), 5) AS score, array_to_string(list_filter([CASE WHEN lq >= 0.3 THEN 'low_quality' END, CASE WHEN sp >= 0.3 THEN 'split' END, CASE WHEN ou >= 0.3 THEN 'outliers' END, CASE WHEN rv >= 0.3 THEN 'review' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j""")
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    core = tr.core_metrics(trains, total, RATE, RP)
    own = suggest.quality(core, ds.amplitude_cutoff(trains, ["cluster_id"], "amplitude")).select("cluster_id", "quality")
    splits = suggest.split_scores(trains, total, RATE, RP, 30).select("cluster_id", F.col("score").alias("split"))
    far = trains.groupBy("cluster_id").agg(F.avg(F.when(F.col("amplitude") > 200, 1.0).otherwise(0.0)).alias("outliers"))
    tags = F.when(F.col("cluster_id") % 7 == 0, F.array(F.lit("review:again"))).otherwise(F.array(F.lit("src:auto")))
    rows = own.join(splits, "cluster_id", "left").join(far, "cluster_id").withColumns({"merge": F.lit(0.0), "tags": tags})
    return rounded(suggest.attention(rows).withColumn("reasons", F.array_join("reasons", ",")), 5)


MEANS = "m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), sim AS (SELECT x.label AS a, y.label AS b, sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)) AS similarity FROM m x JOIN m y ON x.i = y.i AND x.label <> y.label GROUP BY 1, 2)"


@query(f"WITH {MEANS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS k FROM sim WHERE similarity >= -0.2) SELECT a, b, round(similarity, 7) + 0.0 AS similarity FROM k WHERE k <= 3")
def similar_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest classes of each class of embeddings, by their mean vectors."""
    means = suggest.mean_vectors(read(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    return rounded(suggest.similar(means, -0.2, 3), 7)


@query()
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = suggest.mean_vectors(read(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    edges = [(r["a"], r["b"], r["similarity"]) for r in suggest.similar(means, -1.0, 3).where("a < b").collect()]  # three a class
    return spark.createDataFrame([(i, x) for i, g in enumerate(suggest.components(edges, -1.0)) for x in g] or [(0, 0)], "component int, label int")


@query("""SELECT CASE WHEN user_id IN (1, 2) THEN 5 WHEN user_id = 9 THEN 5 ELSE user_id END AS cluster_id, count(*) AS n FROM events GROUP BY 1""")
def merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of merges with an undone one; sizes after replay."""
    log = curation.Log()
    log.append("merge", sources=[1, 2], target=3)
    log.undo()
    log.append("merge", sources=[1, 2], target=4)
    log.append("merge", sources=[4, 9], target=5)
    log.undo()
    log.undo()
    log.append("merge", sources=[1, 2], target=5)
    log.append("merge", sources=[9], target=5)
    stored = curation.Log.read(log.table(spark))
    return curation.replay(spikes(spark, sf_dir).drop("template"), stored).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
    SELECT CASE WHEN user_id = 3 AND k IN (0, 2, 5) THEN 1000000 ELSE user_id END AS cluster_id, count(*) AS n FROM l GROUP BY 1""")
def split_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = curation.Log()
    log.append("split", target=1_000_000, picks=[(3, 0), (3, 2), (3, 5)])
    return curation.replay(spikes(spark, sf_dir).drop("template"), log).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS k FROM events WHERE user_id = 3 GROUP BY 1)
    SELECT CASE WHEN user_id = 3 AND k > 0 THEN 1000000 + k - 1 ELSE user_id END AS cluster_id, count(*) AS n FROM events LEFT JOIN n USING (event_type) GROUP BY 1""")
def split_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.split_by_template(spikes(spark, sf_dir), 3, 1_000_000).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT user_id AS cluster_id, CASE WHEN user_id = 3 THEN 'good' WHEN user_id = 4 THEN 'noise' ELSE 'unsorted' END AS label,
    CASE WHEN user_id = 3 THEN 'odd,src:human' WHEN user_id = 4 THEN 'review:b' WHEN user_id % 2 = 1 THEN 'review:a' ELSE '' END AS tags FROM events""")
def label_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label by hand drops review tags and adds its own; one by rules does not."""
    log = curation.Log()
    log.append("tag", target=3, tags=["review:x", "odd"])
    log.append("relabel", target=3, label="good")
    log.append("tag", target=4, tags=["review:b"])
    log.append("relabel", target=4, label="noise", actor="rules")
    base = spikes(spark, sf_dir).select("cluster_id").distinct().withColumn("label", F.lit("unsorted")).withColumn("tags", F.when(F.col("cluster_id") % 2 == 1, F.array(F.lit("review:a"))).otherwise(F.array().cast("array<string>")))
    return curation.labels(base, log).withColumn("tags", F.array_join("tags", ","))


@query("SELECT user_id AS id, event_id AS seq, event_type AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def latest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("outcome"))
    return curation.latest_outcomes(rows)


@query("""WITH e AS (SELECT o_orderkey AS key, floor(o_totalprice)::BIGINT AS bytes, epoch(o_orderdate)::BIGINT AS mtime, o_orderstatus <> 'P' AS live FROM orders),
    g AS (SELECT *, NOT live OR mtime < 820454400 AS gone FROM e),
    u AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE bytes END) OVER (ORDER BY mtime DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM g)
    SELECT key, bytes, mtime, gone OR upto > 100000000 AS evict FROM u""")
def cache_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").cast("long").alias("bytes"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"), (F.col("o_orderstatus") != "P").alias("live"))
    return curation.cache_evictions(rows, 100_000_000, 820_454_400)


@query("""SELECT event_id AS spike_idx, row_number() OVER (ORDER BY epoch_us(ts), user_id, event_id) - 1 AS place, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS local FROM events""")
def spike_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spikes(spark, sf_dir).select(F.col("spike_idx").alias("row"), "cluster_id", "t")
    return curation.numbered_spikes(rows).select(F.col("row").alias("spike_idx"), F.col("spike_idx").alias("place"), "local").withColumns({"place": F.col("place").cast("long"), "local": F.col("local").cast("long")})


@query(f"""WITH $SPIKES, m AS (SELECT CASE WHEN template IN ('click', 'view') THEN 'both' ELSE template END AS u, spike_idx, t, total FROM s),
    i AS (SELECT *, t - lag(t) OVER (PARTITION BY u ORDER BY t, spike_idx) AS d FROM m)
    SELECT u AS cluster_id, count(*) AS n_spikes, sum(CASE WHEN d < 60000000 THEN 1 ELSE 0 END)::BIGINT AS isi_violations, round(least(1.0, sum(CASE WHEN d < 60000000 THEN 1 ELSE 0 END) * any_value(total) / (2.0 * 60000000 * count(*) * count(*))), 9) AS refractory_contamination FROM i GROUP BY 1""".replace("i AS (SELECT *, t - lag(t) OVER (PARTITION BY u", "ii AS (SELECT *, t - lag(t) OVER (PARTITION BY u").replace("FROM i GROUP BY 1", "FROM ii GROUP BY 1"))
def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core metrics as they would be if two types were one."""
    trains, total = rebased(spikes(spark, sf_dir))
    merged = trains.withColumn("cluster_id", F.when(F.col("template").isin("click", "view"), "both").otherwise(F.col("template")))
    return rounded(tr.core_metrics(merged, total, RATE, 60_000_000).select("cluster_id", "n_spikes", "isi_violations", "refractory_contamination"))
