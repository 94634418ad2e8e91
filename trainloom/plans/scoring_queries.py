"""Queries of filters, rules and scores, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainloom.functions import trains as tr
from trainloom.operators import filters, rules, scoring
from trainloom.plans.queries import ORACLE, RATE, RP, query, rounded
from trainloom.plans.tables import read, rebased, spikes

#: Clusters of the oracles: the core metrics, with a label by the cluster's number.
CLUSTERS = ORACLE["qc_core"].replace("SELECT cluster_id, n AS n_spikes", "SELECT cluster_id, CASE cluster_id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'mua' ELSE 'unsorted' END AS label, n AS n_spikes")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    label = F.when(F.col("cluster_id") % 3 == 0, "good").when(F.col("cluster_id") % 3 == 1, "mua").otherwise("unsorted")
    return rounded(tr.core_metrics(trains, total, RATE, RP)).withColumn("label", label)


@query(f"SELECT cluster_id, n_spikes, presence_ratio, isi_violations, label FROM ({CLUSTERS}) WHERE (n_spikes >= 65 AND (presence_ratio > 0.7 OR NOT isi_violations = 0)) OR label = 'mua'")
def filter_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.visible(clusters(spark, sf_dir), '(n_spikes >= 65 && (presence_ratio > 0.7 or !(isi_violations == 0))) || label == "mua"')
    return found.select("cluster_id", "n_spikes", "presence_ratio", "isi_violations", "label")


@query(f"SELECT cluster_id, n_spikes FROM ({CLUSTERS}) WHERE n_spikes > 70 OR NOT (n_spikes > 60)")
def filter_errors_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose filter errs stay: beyond 60 spikes the unknown name is looked at only where n_spikes <= 70."""
    found = filters.visible(clusters(spark, sf_dir), "n_spikes > 70 or n_spikes <= 60 or (n_spikes > 60 and nothing_like_it == 1 and n_spikes < 0)")
    return found.where("n_spikes > 70 or n_spikes <= 60").select("cluster_id", "n_spikes")


@query(f"SELECT cluster_id, label FROM ({CLUSTERS}) WHERE contains(CAST(cluster_id AS VARCHAR), '7') ")
def filter_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.visible(clusters(spark, sf_dir), "7").select("cluster_id", "label")


#: Rules of the queries.
RULES = """
default = "unsorted"
[[rule]]
name = "contaminated"
metric = "refractory_contamination"
op = ">"
value = 0.5
label = "noise"
all = [{ metric = "isi_violations", op = ">=", value = 2 }]
[[rule]]
name = "drifting"
metric = "drift_correlation"
op = "|>"
value = 0.2
label = "mua"
[[rule]]
name = "present"
metric = "presence_ratio"
op = ">="
value = 0.7
label = "good"
"""
METRICS = ("n_spikes", "refractory_contamination", "isi_violations", "drift_correlation", "presence_ratio", "amplitude_snr")
DECIDED = f"""c AS ({CLUSTERS}), r AS (SELECT *, CASE WHEN refractory_contamination > 0.5 AND isi_violations >= 2 THEN 0 WHEN abs(drift_correlation) > 0.2 THEN 1 WHEN presence_ratio >= 0.7 THEN 2 END AS rule FROM c),
    d AS (SELECT *, CASE rule WHEN 0 THEN 'noise' WHEN 1 THEN 'mua' WHEN 2 THEN 'good' ELSE 'unsorted' END AS new_label FROM r)"""


@query(f"WITH {DECIDED} SELECT cluster_id, label, new_label, rule FROM d WHERE label <> new_label")
def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.changes(clusters(spark, sf_dir), *rules.parse_rules(RULES, METRICS))


@query(f"""WITH {DECIDED}, g AS (SELECT label, new_label, rule, cluster_id, cluster_id - row_number() OVER (PARTITION BY label, new_label, rule ORDER BY cluster_id) AS island FROM d),
    i AS (SELECT label, new_label, rule, island, min(cluster_id) AS a, max(cluster_id) AS b, count(*) AS k FROM g GROUP BY 1, 2, 3, 4)
    SELECT label, new_label, rule, sum(k)::BIGINT AS n, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ids FROM i GROUP BY 1, 2, 3""")
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(clusters(spark, sf_dir), *rules.parse_rules(RULES, METRICS))


@query(f"""WITH c AS ({CLUSTERS}), v AS (SELECT cluster_id, 'refractory_contamination' AS metric, '>' AS op, 0.5 AS threshold, refractory_contamination AS raw, refractory_contamination AS x FROM c
      UNION ALL SELECT cluster_id, 'isi_violations', '>=', 2.0, isi_violations, isi_violations FROM c UNION ALL SELECT cluster_id, 'drift_correlation', '|>', 0.2, drift_correlation, abs(drift_correlation) FROM c
      UNION ALL SELECT cluster_id, 'presence_ratio', '>=', 0.7, presence_ratio, presence_ratio FROM c),
    q AS (SELECT metric, list_sort(list(raw)) AS l FROM v GROUP BY 1),
    w AS (SELECT metric, l[floor((len(l) - 1) * 0.75 + 0.5)::INT + 1] - l[floor((len(l) - 1) * 0.25 + 0.5)::INT + 1] AS iqr FROM q)
    SELECT cluster_id, metric, op, threshold::DOUBLE AS threshold, round(abs(x - threshold) / greatest(iqr, 1e-30), 9) AS ratio FROM v JOIN w USING (metric) WHERE abs(x - threshold) / greatest(iqr, 1e-30) <= 0.1""")
def rule_near_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.near_threshold(clusters(spark, sf_dir), rules.parse_rules(RULES, METRICS)[0], 0.1))


#: Flags of the queries: code, metric, op, threshold.
FLAGS = [("RPV", "refractory_contamination", ">", 0.1), ("DRIFT", "drift_correlation", "|>", 0.1), ("PRES", "presence_ratio", "<", 0.8), ("SNR", "amplitude_snr", "<", 0.9)]
FLAGGED = f"""c AS ({CLUSTERS}), f AS (SELECT cluster_id, list_filter([CASE WHEN refractory_contamination > 0.1 THEN 'RPV' END, CASE WHEN abs(drift_correlation) > 0.1 THEN 'DRIFT' END, CASE WHEN presence_ratio < 0.8 THEN 'PRES' END, CASE WHEN amplitude_snr < 0.9 THEN 'SNR' END], lambda x: x IS NOT NULL) AS flags FROM c)"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).select("cluster_id", rules.flags(FLAGS).alias("flags"))


@query(f"WITH {FLAGGED} SELECT cluster_id, array_to_string(flags, ',') AS flags FROM f")
def metric_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).withColumn("flags", F.array_join("flags", ","))


@query(f"WITH {FLAGGED}, e AS (SELECT unnest(flags) AS flag FROM f) SELECT flag, count(*) AS n FROM e GROUP BY 1 HAVING 2 * count(*) > (SELECT count(*) FROM f)")
def flag_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.flag_modes(flagged(spark, sf_dir))


@query(f"""WITH {FLAGGED}, d AS (SELECT cluster_id, list_concat(list_transform(list_filter(flags, lambda x: x NOT IN ('PRES', 'SNR')), lambda x: '+' || x), list_transform(list_filter(['PRES', 'SNR'], lambda x: NOT list_contains(flags, x)), lambda x: '-' || x)) AS d FROM f)
    SELECT cluster_id, CASE WHEN len(d) = 0 THEN '=' ELSE array_to_string(d, ',') END AS delta FROM d""")
def flag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("cluster_id", rules.flag_delta(F.col("flags"), ["PRES", "SNR"]).alias("delta"))


#: Two clusterings of the events: by type, and by type with small values and some users apart.
TWO = """e AS (SELECT event_id, user_id, event_type AS truth, CASE WHEN value < 10 THEN 'low' WHEN user_id % 17 = 0 THEN 'odd' ELSE event_type END AS test FROM events),
    x AS (SELECT truth AS a, test AS b, count(*) AS n FROM e GROUP BY 1, 2)"""


def two(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = F.when(F.col("value") < 10, "low").when(F.col("user_id") % 17 == 0, "odd").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("truth"), test.alias("test"))


@query(f"WITH {TWO} SELECT a, b, n, sum(n) OVER (PARTITION BY a)::BIGINT AS size_a, sum(n) OVER (PARTITION BY b)::BIGINT AS size_b, round(n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n), 9) AS jaccard FROM x")
def contingency_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.overlaps(scoring.contingency(two(spark, sf_dir), "truth", "test")))


@query(f"""WITH {TWO}, r AS (SELECT user_id % 5 AS root, truth, test, count(*) AS n FROM e GROUP BY 1, 2, 3)
    SELECT root, truth, test, sum(n)::BIGINT AS n, grouping(root, truth, test)::BIGINT AS level FROM r GROUP BY GROUPING SETS ((root, truth, test), (root, truth), (root, test), (truth, test), (root), (truth), (test))""")
def contingency_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cube(two(spark, sf_dir).withColumn("root", F.col("user_id") % 5), "root", "truth", "test")


@query(f"""WITH {TWO}, s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS t FROM x), a AS (SELECT sum(n * (n - 1) / 2.0) AS sa FROM (SELECT sum(n) AS n FROM x GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2.0) AS sb FROM (SELECT sum(n) AS n FROM x GROUP BY b))
    SELECT round((s - sa * sb / (t * (t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0)), 9) AS ari FROM s, a, b""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.adjusted_rand(scoring.contingency(two(spark, sf_dir), "truth", "test")))


@query(f"""WITH {TWO}, j AS (SELECT a, b, n * 1.0 / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n) AS jac,
      CASE WHEN a IN ('click', 'view', 'purchase') THEN 'good' ELSE 'mua' END AS la, CASE WHEN b IN ('click', 'view', 'signup') THEN 'good' WHEN b IN ('purchase', 'error') THEN 'mua' ELSE 'unsorted' END AS lb FROM x),
    c AS (SELECT count(DISTINCT a) AS units_a, count(DISTINCT CASE WHEN lb <> 'unsorted' THEN b END) AS units_b, count(DISTINCT CASE WHEN jac >= 0.7 AND la = lb THEN a END) AS hits_a, count(DISTINCT CASE WHEN jac >= 0.7 AND la = lb THEN b END) AS hits_b FROM j)
    SELECT *, round(hits_a / units_a, 9) AS recall, round(hits_b / units_b, 9) AS "precision" FROM c""")
def unit_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame([("click", "good"), ("view", "good"), ("purchase", "good"), ("signup", "mua"), ("error", "mua")], "a string, l string")
    b = spark.createDataFrame([("click", "good"), ("view", "good"), ("signup", "good"), ("purchase", "mua"), ("error", "mua")], "b string, l string")
    return rounded(scoring.recovery(scoring.contingency(two(spark, sf_dir), "truth", "test"), a, b, 0.7, ["good", "mua"]))


@query(f"""WITH {TWO}, l(v) AS (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error'), ('low'), ('odd')),
    p AS (SELECT sum((SELECT avg(CASE WHEN truth = v THEN 1.0 ELSE 0 END) FROM e) * (SELECT avg(CASE WHEN test = v THEN 1.0 ELSE 0 END) FROM e)) AS expected FROM l),
    o AS (SELECT count(*) AS n, sum(CASE WHEN truth = test THEN 1 ELSE 0 END)::BIGINT AS n_agree FROM e)
    SELECT n, n_agree, round(expected, 9) AS expected, round(n_agree / n, 9) AS observed, round((n_agree / n - expected) / (1 - expected), 9) AS kappa FROM o, p""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.agreement(two(spark, sf_dir), "truth", "test", ["click", "view", "purchase", "signup", "error", "low", "odd"]))


@query(f"""WITH {TWO}, r AS (SELECT user_id % 40 AS a, CASE WHEN user_id % 40 < 20 THEN truth ELSE 'view' END AS b, count(*) AS n FROM e GROUP BY 1, 2),
    l AS (SELECT *, CASE WHEN b IN ('click', 'view') THEN 'good' WHEN b = 'purchase' THEN 'mua' ELSE 'noise' END AS label FROM r),
    s AS (SELECT a, sum(n) AS n, sum(CASE WHEN label = 'good' AND n >= 10 THEN 1 ELSE 0 END) AS ng, sum(CASE WHEN label = 'good' AND n >= 10 THEN n ELSE 0 END) AS g, coalesce(max(CASE WHEN label = 'good' AND n >= 10 THEN n END), 0) AS best,
      sum(CASE WHEN label = 'noise' OR label = 'good' AND n < 10 THEN n ELSE 0 END) AS x FROM l GROUP BY 1 HAVING sum(n) >= 10)
    SELECT a AS root, n::BIGINT AS n_spikes, CASE WHEN x = n THEN 'noise' WHEN best / n >= 0.9 THEN 'kept' WHEN g > 0 AND g / n < 0.5 AND g + x = n THEN 'cores' WHEN g / n >= 0.5 AND x / n >= 0.1 AND g + x = n THEN 'cleanup' ELSE 'other' END AS verdict, ng::BIGINT AS n_good, round(g / n, 9) AS good_share FROM s""")
def root_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = two(spark, sf_dir).withColumn("root", F.col("user_id") % 40).withColumn("truth", F.expr("CASE WHEN root < 20 THEN truth ELSE 'view' END"))
    labels = spark.createDataFrame([("click", "good"), ("view", "good"), ("purchase", "mua"), ("signup", "noise"), ("error", "noise")], "b string, label string")
    return rounded(scoring.root_verdicts(scoring.contingency(rows, "root", "truth"), labels, 10))


@query(f"""WITH {TWO}, c AS (SELECT coalesce(t.k, p.k) AS class, coalesce(t.n, 0) AS support, coalesce(p.n, 0) AS said FROM (SELECT truth AS k, count(*) AS n FROM e GROUP BY 1) t FULL JOIN (SELECT test AS k, count(*) AS n FROM e GROUP BY 1) p ON t.k = p.k),
    h AS (SELECT truth AS class, count(*) AS hit FROM e WHERE truth = test GROUP BY 1),
    r AS (SELECT class, support, CASE WHEN said > 0 THEN coalesce(hit, 0) / said ELSE 0 END AS p, CASE WHEN support > 0 THEN coalesce(hit, 0) / support ELSE 0 END AS r FROM c LEFT JOIN h USING (class))
    SELECT class, support, round(p, 9) AS "precision", round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM r""")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.classification(two(spark, sf_dir), "truth", "test"))


@query(f"""WITH c AS ({ORACLE["classification"]}) SELECT round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1 FROM c""")
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.classification_summary(scoring.classification(two(spark, sf_dir), "truth", "test")), 6)


@query("""WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS t, l_quantity * 1000 + l_discount * 1000 AS p FROM lineitem),
    k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY t) + (count(*) OVER (PARTITION BY g, t) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS rp FROM v)
    SELECT g AS flag, count(*) AS n, round(1 - sum((p - t)**2) / (var_pop(t) * count(*)), 7) AS r2, round(corr(rt, rp), 7) AS spearman, round(avg(p - t), 5) AS bias, round(sqrt(avg((p - t)**2)), 5) AS rmse FROM k GROUP BY 1""")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1000 + F.col("l_discount") * 1000).alias("p"))
    found = scoring.regression(rows, "t", "p", ["flag"])
    return found.select("flag", "n", F.round("r2", 7).alias("r2"), F.round("spearman", 7).alias("spearman"), F.round("bias", 5).alias("bias"), F.round("rmse", 5).alias("rmse"))


@query("SELECT event_type, round((SELECT count(*) FROM events) / (count(*) * (SELECT count(DISTINCT event_type) FROM events)), 9) AS weight FROM events GROUP BY 1")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.balanced_weights(read(spark, sf_dir, "events"), "event_type"))


@query("""SELECT event_id, round(cume_dist() OVER w, 9) AS pct, round((rank() OVER w - 1 + 0.5 * count(*) OVER (PARTITION BY event_type, value)) / count(*) OVER (PARTITION BY event_type), 9) AS mid FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)""")
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.percentile_ranks(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "pct", "mid"))


@query("""WITH r AS (SELECT o_custkey, o_orderstatus = 'F' AS hit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT o_custkey, bool_or(hit AND k = 1) AS top1, bool_or(hit) AS oracle FROM r GROUP BY 1""")
def root_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_hits(read(spark, sf_dir, "orders").withColumn("hit", F.col("o_orderstatus") == "F"), "o_custkey", "o_orderkey", "o_totalprice", "hit")


@query()
def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return scoring.assign_folds(sizes, "user_id", "n", 5)
