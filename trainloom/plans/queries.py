"""Queries of the engine's operators over the driver's tables, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainloom.functions import distribution as ds
from trainloom.functions import trains as tr
from trainloom.operators import correlograms as co
from trainloom.plans.tables import RATE, read, rebased, spikes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Refractory time of the queries: ten minutes, in ticks.
RP = 600_000_000
#: Spikes with times from 0 on, with the recording's length, for the oracles.
SPIKES = """raw AS (SELECT event_id AS spike_idx, user_id AS cluster_id, epoch_us(ts) AS t0, value AS amplitude, event_type AS template FROM events),
    rec AS (SELECT min(t0) AS a, max(t0) - min(t0) + 1 AS total FROM raw),
    s AS (SELECT spike_idx, cluster_id, t0 - a AS t, amplitude, template, total FROM raw, rec),
    i AS (SELECT *, t - lag(t) OVER (PARTITION BY cluster_id ORDER BY t, spike_idx) AS isi FROM s)"""


def query(sql: str = "") -> Callable:
    """Registers a query under its function's name, with its oracle."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("$SPIKES", SPIKES).replace("$RP", str(RP))
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on their order; to so many digits that means of cents are no ties."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("""WITH $SPIKES,
    g AS (SELECT cluster_id, total, count(*) AS n, min(t) AS first, max(t) AS last, sum(CASE WHEN isi < $RP THEN 1 ELSE 0 END) AS v, max(isi) AS gap,
                 count(DISTINCT least(floor(t / greatest(total / 50.0, 1.0)), 49)) AS occ, avg(amplitude) AS m, coalesce(stddev_samp(amplitude), 0) AS sd,
                 corr(t / 1e6, amplitude) AS c, covar_pop(t / 1e6, amplitude) AS cov, var_pop(t / 1e6) AS vs FROM i GROUP BY cluster_id, total)
    SELECT cluster_id, n AS n_spikes, round(n / (total / 1e6), 9) AS firing_rate, round(m, 9) AS mean_amplitude, round(sd, 9) AS std_amplitude,
           round(CASE WHEN sd > 0 THEN abs(m) / sd ELSE 0 END, 9) AS amplitude_snr, v::BIGINT AS isi_violations,
           round(CASE WHEN last > first THEN v / ((last - first) / 1e6) ELSE 0 END, 9) AS isi_violation_ratio,
           round(CASE WHEN n > 1 THEN v / (n - 1.0) ELSE 0 END, 9) AS isi_violation_fraction,
           round(least(1.0, v * total / (2.0 * $RP * n * n)), 9) AS refractory_contamination, round(occ / 50.0, 9) AS presence_ratio,
           round(greatest(first, total - last, coalesce(gap, 0)) / total, 9) AS longest_silent_gap,
           round(CASE WHEN n >= 3 THEN coalesce(c, 0) ELSE 0 END, 9) + 0.0 AS drift_correlation,
           round(CASE WHEN n >= 3 AND vs > 0 THEN cov / vs ELSE 0 END, 9) + 0.0 AS drift_slope FROM g""")
def qc_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    return rounded(tr.core_metrics(trains, total, RATE, RP))


@query("""WITH $SPIKES, b AS (SELECT cluster_id, least(floor(isi / (3600000000 / 20.0)), 19)::BIGINT AS bin, count(*) AS n FROM i WHERE isi >= 0 AND isi < 3600000000 GROUP BY 1, 2)
    SELECT c.cluster_id, k AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster_id FROM s) c CROSS JOIN range(20) r(k) LEFT JOIN b ON b.cluster_id = c.cluster_id AND b.bin = k""")
def isi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.isi_histogram(rebased(spikes(spark, sf_dir))[0], 0, 3_600_000_000, 20)


@query("""WITH $SPIKES, b AS (SELECT cluster_id, least(floor((isi - 60000000) / (86340000000 / 30.0)), 29)::BIGINT AS bin, count(*) AS n FROM i WHERE isi >= 60000000 AND isi < 86400000000 GROUP BY 1, 2)
    SELECT c.cluster_id, k AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster_id FROM s) c CROSS JOIN range(30) r(k) LEFT JOIN b ON b.cluster_id = c.cluster_id AND b.bin = k""")
def isi_histogram_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.isi_histogram(rebased(spikes(spark, sf_dir))[0], 60_000_000, 86_400_000_000, 30)


@query("""WITH $SPIKES, b AS (SELECT cluster_id, (t // 86400000000) AS bin, count(*) AS n FROM s WHERE t < 30 * 86400000000 GROUP BY 1, 2)
    SELECT c.cluster_id, k AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster_id FROM s) c CROSS JOIN range(30) r(k) LEFT JOIN b ON b.cluster_id = c.cluster_id AND b.bin = k""")
def rate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.rate_counts(rebased(spikes(spark, sf_dir))[0], 0, 86_400_000_000, 30)


@query("""WITH $SPIKES, b AS (SELECT cluster_id, least(floor(t / greatest(total / 20.0, 1.0)), 19)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT c.cluster_id, k AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster_id FROM s) c CROSS JOIN range(20) r(k) LEFT JOIN b ON b.cluster_id = c.cluster_id AND b.bin = k""")
def presence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    return tr.presence_counts(trains, total, 20)


@query("""WITH $SPIKES, b AS (SELECT cluster_id, t // greatest(total // 50, 1) AS bin, count(*) AS n FROM s GROUP BY 1, 2, total),
    g AS (SELECT cluster_id, sum(n) AS s1, sum(n * n) AS s2 FROM b WHERE bin < 50 GROUP BY 1)
    SELECT cluster_id, round(CASE WHEN s1 > 0 THEN sqrt(greatest(0, s2 / 50.0 - (s1 / 50.0) * (s1 / 50.0))) / (s1 / 50.0) ELSE 0 END, 9) AS presence_cv FROM g""")
def presence_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    return rounded(tr.presence_cv(trains, total, 50))


@query("""WITH $SPIKES, w AS (SELECT (k + 1) * 60000000 AS w FROM range(20) r(k)),
    v AS (SELECT cluster_id, w, count(*) AS n, sum(CASE WHEN isi < w THEN 1 ELSE 0 END) AS v, total FROM i, w GROUP BY cluster_id, w, total),
    c AS (SELECT cluster_id, w, least(1.0, v * total / (2.0 * w * n * n)) AS c FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY c, w DESC) AS k FROM c)
    SELECT cluster_id, round(c, 9) AS contamination, w AS "window" FROM r WHERE k = 1""")
def sliding_refractory(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    return rounded(tr.sliding_refractory(trains, total, [(k + 1) * 60_000_000 for k in range(20)]))


@query("""WITH $SPIKES, w AS (SELECT *, t // 432000000000 AS win FROM s), x AS (SELECT *, t - lag(t) OVER (PARTITION BY cluster_id, win ORDER BY t, spike_idx) AS d FROM w),
    g AS (SELECT cluster_id, win, total, count(*) AS n, sum(CASE WHEN d < $RP THEN 1 ELSE 0 END) AS v FROM x GROUP BY 1, 2, 3)
    SELECT cluster_id, win, ((win + 0.5) * 432000)::DOUBLE AS centre_s,
           CASE WHEN n < 5 THEN 'NaN'::DOUBLE ELSE round(least(1.0, v * least(432000000000, total - win * 432000000000) / (2.0 * $RP * n * n)), 9) END AS contamination FROM g""")
def tumbling_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    return rounded(tr.tumbling_contamination(trains, total, 432_000_000_000, RP, 5, RATE))


@query("""WITH $SPIKES, n AS (SELECT *, lead(t) OVER (PARTITION BY cluster_id ORDER BY t, spike_idx) - t AS nxt FROM i)
    SELECT cluster_id, spike_idx, t FROM n WHERE isi < $RP OR nxt < $RP""")
def isi_violators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.isi_violators(rebased(spikes(spark, sf_dir))[0], RP)


@query("""WITH $SPIKES, c AS (SELECT cluster_id, count(*) AS n, avg(amplitude) AS mean, coalesce(stddev_samp(amplitude), 0) AS std FROM s GROUP BY 1),
    d AS (SELECT cluster_id, n, mean, std, avg((amplitude - mean)**2) AS m2, avg((amplitude - mean)**3) AS m3, avg((amplitude - mean)**4) AS m4 FROM s JOIN c USING (cluster_id) GROUP BY 1, 2, 3, 4),
    g AS (SELECT *, CASE WHEN n >= 3 AND std > 0 THEN m3 / m2**1.5 ELSE 0 END AS g1, CASE WHEN n >= 4 AND std > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END AS g2 FROM d)
    SELECT cluster_id, n, round(mean, 9) AS mean, round(std, 9) AS std, round(g1, 9) AS skewness, round(g2, 9) AS kurtosis,
           round(CASE WHEN n >= 4 AND std > 0 THEN ((g1 * sqrt(n * (n - 1.0)) / (n - 2))**2 + 1) / (((n + 1) * g2 + 6) * (n - 1) / ((n - 2.0) * (n - 3)) + 3 * (n - 1.0)**2 / ((n - 2.0) * (n - 3))) ELSE 0 END, 9) AS bimodality FROM g""")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ds.moments(spikes(spark, sf_dir), ["cluster_id"], "amplitude"))


@query("""WITH $SPIKES SELECT cluster_id, round(quantile_cont(amplitude, 0.1), 9) AS q0, round(quantile_cont(amplitude, 0.5), 9) AS q1, round(quantile_cont(amplitude, 0.9), 9) AS q2 FROM s GROUP BY 1""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ds.quantiles(spikes(spark, sf_dir), ["cluster_id"], "amplitude", [0.1, 0.5, 0.9]))


@query("""WITH $SPIKES, m AS (SELECT cluster_id, median(amplitude) AS md FROM s GROUP BY 1)
    SELECT cluster_id, round(any_value(md), 9) AS median, round(greatest(1e-6, 1.4826 * median(abs(amplitude - md))), 9) AS scale FROM s JOIN m USING (cluster_id) GROUP BY 1""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ds.robust(spikes(spark, sf_dir), ["cluster_id"], "amplitude"))


@query("SELECT user_id AS cluster_id, round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0 END), 9) AS fraction_below FROM events GROUP BY 1")
def fraction_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ds.fraction_below(spikes(spark, sf_dir), ["cluster_id"], "amplitude", 20.0))


@query("""WITH v AS (SELECT event_type AS g, value AS v FROM events), p AS (SELECT x.g AS a, y.g AS b FROM (SELECT DISTINCT g FROM v) x JOIN (SELECT DISTINCT g FROM v) y ON x.g < y.g),
    n AS (SELECT g, count(*) AS n FROM v GROUP BY 1),
    u AS (SELECT a, b, v, 1 AS ka, 0 AS kb FROM p JOIN v ON v.g = a UNION ALL SELECT a, b, v, 0, 1 FROM p JOIN v ON v.g = b),
    c AS (SELECT a, b, v, sum(ka) AS ka, sum(kb) AS kb FROM u GROUP BY 1, 2, 3),
    f AS (SELECT a, b, abs(sum(ka) OVER w * 1.0 / na.n - sum(kb) OVER w * 1.0 / nb.n) AS gap, na.n AS n_a, nb.n AS n_b FROM c JOIN n na ON na.g = a JOIN n nb ON nb.g = b WINDOW w AS (PARTITION BY a, b ORDER BY v)),
    k AS (SELECT a, b, n_a, n_b, max(gap) AS ks, sqrt(n_a * n_b / (n_a + n_b * 1.0)) AS e FROM f GROUP BY 1, 2, 3, 4)
    SELECT a, b, n_a, n_b, round(ks, 9) AS ks, round(CASE WHEN ks <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum([(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * ((e + 0.12 + 0.11 / e) * ks)**2) for j in range(1, 101)]))) END, 9) AS p FROM k""")
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spikes(spark, sf_dir)
    kinds = rows.select("template").distinct()
    pairs = kinds.toDF("a").join(kinds.toDF("b"), F.col("a") < F.col("b"))
    found = ds.ks_distance(rows, "template", "amplitude", pairs)
    return rounded(found.withColumn("p", ds.ks_pvalue(F.col("ks"), F.col("n_a"), F.col("n_b"))))


@query("""WITH $SPIKES, e AS (SELECT cluster_id, min(amplitude) AS lo, max(amplitude) AS hi, count(*) AS n FROM s GROUP BY 1),
    b AS (SELECT cluster_id, least(floor((amplitude - lo) * 30 / (hi - lo)), 29)::INT AS bin, count(*) AS k FROM s JOIN e USING (cluster_id) WHERE n >= 8 AND hi - lo >= 1e-9 GROUP BY 1, 2),
    h AS (SELECT c.cluster_id, r.k AS bin, coalesce(b.k, 0) AS k FROM (SELECT DISTINCT cluster_id FROM b) c CROSS JOIN range(30) r(k) LEFT JOIN b ON b.cluster_id = c.cluster_id AND b.bin = r.k),
    g AS (SELECT cluster_id, bin, avg(k) OVER (PARTITION BY cluster_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS g FROM h),
    m AS (SELECT cluster_id, bin AS mode FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY g DESC, bin DESC) AS r FROM g) WHERE r = 1)
    SELECT e.cluster_id, round(coalesce(x.c, 0), 9) AS amplitude_cutoff FROM e LEFT JOIN (SELECT cluster_id, least(0.5, sum(CASE WHEN bin > 2 * mode THEN g ELSE 0 END) / sum(g)) AS c FROM g JOIN m USING (cluster_id) GROUP BY 1) x USING (cluster_id)""")
def amplitude_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ds.amplitude_cutoff(spikes(spark, sf_dir), ["cluster_id"], "amplitude"))


@query()
def hartigan_dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ds.dip(spikes(spark, sf_dir), "cluster_id", "amplitude"))


#: Lags of the queries' correlograms: two hours to each side within a user, ten minutes between event types, in 100 bins.
REACH, SHORT, BINS = 7_200_000_000, 600_000_000, 100
CCG = f"""p AS (SELECT x.template AS a, y.template AS b FROM (SELECT DISTINCT template FROM s) x JOIN (SELECT DISTINCT template FROM s) y ON x.template < y.template),
    c AS (SELECT a, b, least(((y.t - x.t + {SHORT}) * {BINS}) // {2 * SHORT}, {BINS - 1})::INT AS bin, count(*) AS n FROM p JOIN s x ON x.template = a JOIN s y ON y.template = b AND abs(y.t - x.t) <= {SHORT} GROUP BY 1, 2, 3),
    d AS (SELECT p.a, p.b, k::INT AS bin, coalesce(n, 0) AS n FROM p CROSS JOIN range({BINS}) r(k) LEFT JOIN c ON c.a = p.a AND c.b = p.b AND c.bin = r.k)"""


def by_type(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trains of the event types, and all pairs of types."""
    trains = rebased(spikes(spark, sf_dir))[0].withColumn("cluster_id", F.col("template"))
    kinds = trains.select("cluster_id").distinct()
    return trains, kinds.toDF("a").join(kinds.toDF("b"), F.col("a") < F.col("b"))


@query(f"WITH $SPIKES, {CCG} SELECT a, b, bin, n FROM d")
def cross_correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.cross_correlogram(*by_type(spark, sf_dir), SHORT, BINS)


@query(f"""WITH $SPIKES, {CCG}, e AS (SELECT a, b, avg(CASE WHEN bin BETWEEN 48 AND 51 THEN n END) AS c, avg(CASE WHEN bin BETWEEN 40 AND 47 OR bin BETWEEN 52 AND 59 THEN n END) AS m, stddev_pop(CASE WHEN bin BETWEEN 40 AND 47 OR bin BETWEEN 52 AND 59 THEN n END) AS d FROM d GROUP BY 1, 2)
    SELECT a, b, round((m - c) / greatest(d, 1e-6), 9) + 0.0 AS z, round(1 - exp(-greatest((m - c) / greatest(d, 1e-6), 0) / 2), 9) + 0.0 AS score, round(m, 9) AS shoulder_mean, round(greatest(d, 1e-6), 9) AS shoulder_std FROM e""")
def refractory_dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(co.refractory_dip(co.cross_correlogram(*by_type(spark, sf_dir), SHORT, BINS), ["a", "b"], BINS, 2, 8))


@query(f"""WITH $SPIKES, {CCG}, e AS (SELECT a, b, avg(CASE WHEN bin BETWEEN 48 AND 51 THEN n END) AS c1, avg(CASE WHEN bin BETWEEN 40 AND 47 OR bin BETWEEN 52 AND 59 THEN n END) AS m1, stddev_pop(CASE WHEN bin BETWEEN 40 AND 47 OR bin BETWEEN 52 AND 59 THEN n END) AS d1,
      avg(CASE WHEN bin BETWEEN 47 AND 52 THEN n END) AS c2, avg(CASE WHEN bin BETWEEN 35 AND 46 OR bin BETWEEN 53 AND 64 THEN n END) AS m2, stddev_pop(CASE WHEN bin BETWEEN 35 AND 46 OR bin BETWEEN 53 AND 64 THEN n END) AS d2 FROM d GROUP BY 1, 2)
    SELECT a, b, CASE WHEN m1 < 2 OR d1 <= 1e-5 THEN 'NaN'::DOUBLE ELSE round(least(99.0, greatest(-99.0, (c1 - m1) / d1)), 9) + 0.0 END AS dip_z,
           CASE WHEN m2 < 2 OR d2 <= 1e-5 THEN 'NaN'::DOUBLE ELSE round(least(99.0, greatest(0.0, (c2 - m2) / d2)), 9) + 0.0 END AS sync_z FROM e""")
def ccg_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(co.ccg_z(co.cross_correlogram(*by_type(spark, sf_dir), SHORT, BINS), ["a", "b"], BINS))


@query("""WITH $SPIKES, n AS (SELECT template, count(*) AS n, any_value(total) AS total FROM s GROUP BY 1)
    SELECT x.template AS a, y.template AS b, round(x.n * y.n * 12.0 / (x.total / 1e6), 9) AS baseline FROM n x JOIN n y ON x.template < y.template""")
def ccg_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains, total = rebased(spikes(spark, sf_dir))
    n = trains.groupBy("template").agg(F.count("*").alias("n"))
    pairs = n.toDF("a", "n_a").join(n.toDF("b", "n_b"), F.col("a") < F.col("b"))
    return rounded(pairs.select("a", "b", co.baseline(F.col("n_a"), F.col("n_b"), 12.0, total / RATE).alias("baseline")))

ACG = f"""c AS (SELECT x.cluster_id, least(((y.t - x.t + {REACH}) * {BINS}) // {2 * REACH}, {BINS - 1})::INT AS bin, count(*) AS n FROM s x JOIN s y ON x.cluster_id = y.cluster_id AND x.spike_idx <> y.spike_idx AND abs(y.t - x.t) <= {REACH} GROUP BY 1, 2),
    d AS (SELECT p.cluster_id, k::INT AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster_id FROM s) p CROSS JOIN range({BINS}) r(k) LEFT JOIN c ON c.cluster_id = p.cluster_id AND c.bin = r.k)"""


@query(f"WITH $SPIKES, {ACG} SELECT cluster_id, bin, n FROM d")
def auto_correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.auto_correlogram(rebased(spikes(spark, sf_dir))[0], REACH, BINS)


@query(f"""WITH $SPIKES, {ACG}, g AS (SELECT cluster_id, avg(CASE WHEN bin >= 50 AND (bin - 50) * 144000000::BIGINT >= 288000000 AND (bin - 50) * 144000000::BIGINT < 1440000000 THEN n END) AS x, avg(CASE WHEN bin >= 50 AND (bin - 50) * 144000000::BIGINT >= 4320000000 THEN n END) AS y FROM d GROUP BY 1)
    SELECT cluster_id, CASE WHEN y > 0 THEN round(x / y, 9) ELSE 'NaN'::DOUBLE END AS burst_index FROM g""")
def burst_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(co.burst_index(co.auto_correlogram(rebased(spikes(spark, sf_dir))[0], REACH, BINS), REACH, BINS, (288_000_000, 1_440_000_000), (4_320_000_000, 7_200_000_000)))


#: Band edges of the log bins, in ticks.
EDGES = (100_000_000, 300_000_000, 900_000_000, 2_700_000_000, 7_200_000_000)


@query(f"""WITH $SPIKES, {ACG}, e AS (SELECT i - 1 AS band, list_extract({list(EDGES)}, i) AS lo, list_extract({list(EDGES)}, i + 1) AS hi FROM range(1, {len(EDGES)}) t(i)),
    x AS (SELECT cluster_id, n, (bin - 50) * 144000000::BIGINT AS x FROM d WHERE bin >= 50)
    SELECT cluster_id, band::INT AS band, round(sum(n * greatest(0.0, least(x + 144000000, hi) - greatest(x, lo)) / 144000000.0) / any_value(hi - lo) * 1e9, 9) AS rate FROM x CROSS JOIN e GROUP BY 1, 2""")
def log_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = co.log_bins(co.auto_correlogram(rebased(spikes(spark, sf_dir))[0], REACH, BINS), REACH, BINS, list(EDGES))
    return rounded(found.withColumn("rate", F.col("rate") * 1e9))


@query("""WITH $SPIKES, b AS (SELECT cluster_id, (t // 86400000000) AS bin, count(*) AS n FROM s WHERE t < 30 * 86400000000 GROUP BY 1, 2),
    h AS (SELECT c.cluster_id, k AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster_id FROM s) c CROSS JOIN range(30) r(k) LEFT JOIN b ON b.cluster_id = c.cluster_id AND b.bin = k),
    m AS (SELECT cluster_id, avg(n) AS m, stddev_pop(n) AS d FROM h GROUP BY 1), p AS (SELECT cluster_id, bin // 5 AS part, avg(n) AS a FROM h GROUP BY 1, 2)
    SELECT cluster_id, string_agg(CASE WHEN d <= 1e-9 THEN 'b' WHEN (a - m) / d > 0.67 THEN 'd' WHEN (a - m) / d > 0 THEN 'c' WHEN (a - m) / d > -0.67 THEN 'b' ELSE 'a' END, '' ORDER BY part) AS word FROM p JOIN m USING (cluster_id) GROUP BY 1""")
def sax_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tr.rate_counts(rebased(spikes(spark, sf_dir))[0], 0, 86_400_000_000, 30)
    return co.sax(counts, "cluster_id", "bin", "n", 30, 6, 4)


@query("""WITH $SPIKES, f AS (SELECT template AS i, t, spike_idx AS p FROM s),
    k AS (SELECT x.i, y.i AS j, (y.t - x.t) // 60000000 AS k FROM f x JOIN f y ON (y.t > x.t OR y.t = x.t AND (y.i > x.i OR y.i = x.i AND y.p > x.p)) AND y.t - x.t < 780000000),
    a AS (SELECT i, j, k, count(*) AS n FROM k WHERE k <= 12 GROUP BY 1, 2, 3),
    z AS (SELECT i, j, k, max(n) AS n FROM (SELECT * FROM a WHERE k = 0 UNION ALL SELECT j, i, k, n FROM a WHERE k = 0) GROUP BY 1, 2, 3)
    SELECT i, j, k::INT AS k, n FROM z UNION ALL SELECT i, j, k::INT, n FROM a WHERE k > 0 UNION ALL SELECT j, i, -k::INT, n FROM a WHERE k > 0""")
def correlograms_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.correlograms(by_type(spark, sf_dir)[0], 60_000_000, 12)


PSTH = """e AS (SELECT spike_idx AS event_id, t FROM s WHERE template = 'purchase'), k AS (SELECT cluster_id, t AS u FROM s WHERE template = 'click'),
    p AS (SELECT event_id, cluster_id, u - t AS dt FROM e JOIN k ON u >= greatest(t - 60000000, 0) AND u < t + 120000000)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rebased(spikes(spark, sf_dir))[0]
    return co.psth(rows.where("template = 'purchase'").select(F.col("spike_idx").alias("event_id"), "t"), rows.where("template = 'click'"), 60_000_000, 120_000_000)


@query(f"WITH $SPIKES, {PSTH} SELECT * FROM p")
def psth_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir)


@query(f"""WITH $SPIKES, {PSTH}, c AS (SELECT least((dt + 60000000) // 6000000, 29)::INT AS bin, count(*) AS n FROM p GROUP BY 1)
    SELECT k::INT AS bin, coalesce(n, 0) AS n FROM range(30) r(k) LEFT JOIN c ON bin = k""")
def psth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.psth_histogram(raster(spark, sf_dir), 60_000_000, 120_000_000, 30)
