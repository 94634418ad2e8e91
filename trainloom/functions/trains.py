"""Interval and rate measures of spike trains: frames with cluster_id, t (whole ticks) and spike_idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ticks of a block: a cluster's train is cut in blocks, so that no task needs a whole train.
BLOCK = 86_400_000_000


def with_previous(trains: DataFrame, block: int = BLOCK) -> DataFrame:
    """trains with prev, the time of the cluster's spike before (null for the first), in order of t, then spike_idx.

    The window runs within a block of a cluster; the first spike of a block takes the last time of the cluster's
    block before, from one row a block. So one crowded cluster is dealt to as many tasks as it has blocks.
    """
    cut = trains.withColumn("_block", F.floor(F.col("t") / F.lit(block)))
    inside = Window.partitionBy("cluster_id", "_block").orderBy("t", "spike_idx")
    ends = cut.groupBy("cluster_id", "_block").agg(F.max("t").alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("cluster_id").orderBy("_block"))).drop("_end")
    out = cut.withColumn("prev", F.lag("t").over(inside)).join(before, ["cluster_id", "_block"])
    return out.withColumn("prev", F.coalesce("prev", "_before")).drop("_block", "_before")


def with_isi(trains: DataFrame, block: int = BLOCK) -> DataFrame:
    """trains with isi, the interval since the cluster's spike before."""
    return with_previous(trains, block).withColumn("isi", F.col("t") - F.col("prev")).drop("prev")


def hill(violations: Column, n: Column, total: Column, refractory: int) -> Column:
    """Contamination by refractory violations, linearised: v * T / (2 * r * n^2) within 0 to 1; 0 without spikes."""
    raw = violations * total / (F.lit(2.0 * refractory) * n * n)
    return F.when((n < 1) | F.lit(refractory <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def presence_bin(t: Column, total: int, bins: int) -> Column:
    """Bin of a time among equal bins of at least one tick; the last one is closed."""
    width = max(total / bins, 1.0)
    return F.least(F.floor(t / F.lit(width)), F.lit(bins - 1))


def core_metrics(trains: DataFrame, total: int, rate: float, refractory: int, bins: int = 50) -> DataFrame:
    """One row a cluster: counts, rates, amplitude moments, refractory violations, presence, gaps, drift; t starts at 0.

    One shuffle by cluster and block for the intervals, then partial sums a cluster.
    """
    seconds = F.col("t") / F.lit(rate)
    rows = with_isi(trains).withColumn("_bin", presence_bin(F.col("t"), total, bins)).withColumn("_s", seconds)
    violated = F.when(F.col("isi") < refractory, 1).otherwise(0) if refractory > 0 else F.lit(0)
    sums = rows.groupBy("cluster_id").agg(
        F.count("*").alias("n_spikes"),
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.sum(violated).alias("isi_violations"),
        F.max("isi").alias("gap"),
        F.count_distinct("_bin").alias("occupied"),
        F.avg("amplitude").alias("mean_amplitude"),
        F.coalesce(F.stddev_samp("amplitude"), F.lit(0.0)).alias("std_amplitude"),
        F.corr("_s", "amplitude").alias("corr"),
        F.covar_pop("_s", "amplitude").alias("cov"),
        F.var_pop("_s").alias("var_s"),
    )
    n, v = F.col("n_spikes"), F.col("isi_violations")
    lasted = (F.col("last") - F.col("first")) / F.lit(rate)
    return sums.select(
        "cluster_id",
        "n_spikes",
        (n / F.lit(max(total, 1) / rate)).alias("firing_rate"),
        "mean_amplitude",
        "std_amplitude",
        F.when(F.col("std_amplitude") > 0, F.abs("mean_amplitude") / F.col("std_amplitude")).otherwise(0.0).alias("amplitude_snr"),
        "isi_violations",
        F.when(lasted > 0, v / lasted).otherwise(0.0).alias("isi_violation_ratio"),
        F.when(n > 1, v / (n - 1)).otherwise(0.0).alias("isi_violation_fraction"),
        hill(v, n, F.lit(float(total)), refractory).alias("refractory_contamination"),
        (F.col("occupied") / F.lit(float(bins))).alias("presence_ratio"),
        (F.greatest("first", F.lit(total) - F.col("last"), F.coalesce("gap", F.lit(0))) / F.lit(float(max(total, 1)))).alias("longest_silent_gap"),
        F.when((n >= 3) & ~F.isnan("corr"), F.coalesce("corr", F.lit(0.0))).otherwise(0.0).alias("drift_correlation"),
        F.when((n >= 3) & (F.col("var_s") > 0), F.col("cov") / F.col("var_s")).otherwise(0.0).alias("drift_slope"),
    )


def dense(clusters: DataFrame, measured: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """measured for every id from 0 to the largest of clusters; ids without spikes get the defaults."""
    ids = clusters.agg(F.max("cluster_id").alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("cluster_id"))
    return ids.join(measured, "cluster_id", "left").fillna(defaults)


def isi_histogram(trains: DataFrame, low: int, high: int, bins: int) -> DataFrame:
    """cluster_id, bin, n of intervals in [low, high), empty bins too."""
    width = (high - low) / bins
    inside = with_isi(trains).where((F.col("isi") >= low) & (F.col("isi") < high))
    counted = inside.groupBy("cluster_id", F.least(F.floor((F.col("isi") - low) / F.lit(width)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return filled(trains.select("cluster_id").distinct(), counted, bins)


def time_histogram(trains: DataFrame, low: int, high: int, bins: int) -> DataFrame:
    """cluster_id, bin, n of times in [low, high), empty bins too."""
    width = (high - low) / bins
    inside = trains.where((F.col("t") >= low) & (F.col("t") < high))
    counted = inside.groupBy("cluster_id", F.least(F.floor((F.col("t") - low) / F.lit(width)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return filled(trains.select("cluster_id").distinct(), counted, bins)


def filled(ids: DataFrame, counted: DataFrame, bins: int) -> DataFrame:
    """counted (cluster_id, bin, n) with a 0 for every bin of every id that lacks one."""
    grid = ids.select("cluster_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counted, ["cluster_id", "bin"], "left").select("cluster_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def presence_counts(trains: DataFrame, total: int, bins: int) -> DataFrame:
    counted = trains.groupBy("cluster_id", presence_bin(F.col("t"), total, bins).alias("bin")).agg(F.count("*").alias("n"))
    return filled(trains.select("cluster_id").distinct(), counted, bins)


def presence_cv(trains: DataFrame, total: int, bins: int) -> DataFrame:
    """Population standard deviation over mean of the bins' counts; bins are whole ticks wide and what lies beyond the last is dropped."""
    width = max(total // bins, 1)
    counted = trains.withColumn("bin", F.floor(F.col("t") / F.lit(width))).where(F.col("bin") < bins).groupBy("cluster_id", "bin").agg(F.count("*").alias("n"))
    each = counted.groupBy("cluster_id").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    mean = F.col("s") / F.lit(float(bins))
    var = F.greatest(F.lit(0.0), F.col("q") / F.lit(float(bins)) - mean * mean)
    return each.select("cluster_id", F.when(mean > 0, F.sqrt(var) / mean).otherwise(0.0).alias("presence_cv"))


def sliding_refractory(trains: DataFrame, total: int, windows: list[int]) -> DataFrame:
    """cluster_id, contamination, window: the least contamination over refractory windows, the longest window on ties."""
    rows = with_isi(trains).groupBy("cluster_id").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("isi") < w, 1).otherwise(0)).alias(f"v{i}") for i, w in enumerate(windows)])
    tried = F.array(*[F.struct(hill(F.col(f"v{i}"), F.col("n"), F.lit(float(total)), w).alias("c"), F.lit(-w).alias("w")) for i, w in enumerate(windows)])
    best = F.array_min(tried)
    return rows.select("cluster_id", best["c"].alias("contamination"), (-best["w"]).alias("window"))


def tumbling_contamination(trains: DataFrame, total: int, width: int, refractory: int, least: int, rate: float) -> DataFrame:
    """Contamination inside each window of each cluster, from intervals inside the window; NaN where it has under `least` spikes."""
    cut = trains.withColumn("win", F.floor(F.col("t") / F.lit(width)))
    inside = Window.partitionBy("cluster_id", "win").orderBy("t", "spike_idx")
    isi = F.col("t") - F.lag("t").over(inside)
    sums = cut.withColumn("isi", isi).groupBy("cluster_id", "win").agg(F.count("*").alias("n"), F.sum(F.when(F.col("isi") < refractory, 1).otherwise(0)).alias("v"))
    lasts = F.least(F.lit(width), F.lit(total) - F.col("win") * width).cast("double")
    return sums.select("cluster_id", "win", ((F.col("win") + 0.5) * F.lit(width / rate)).alias("centre_s"), F.when(F.col("n") < least, F.lit(float("nan"))).otherwise(hill(F.col("v"), F.col("n"), lasts, refractory)).alias("contamination"))


def isi_violators(trains: DataFrame, refractory: int, block: int = BLOCK) -> DataFrame:
    """Both spikes of every interval under the refractory time, once each; the interval after is that before with time turned over."""
    before = with_previous(trains, block).withColumnRenamed("prev", "_prev")
    turned = before.withColumns({"t": -F.col("t"), "spike_idx": -F.col("spike_idx")})
    both = with_previous(turned, block).where((-F.col("t") - F.col("_prev") < refractory) | (F.col("t") - F.col("prev") < refractory))
    return both.select("cluster_id", (-F.col("spike_idx")).alias("spike_idx"), (-F.col("t")).alias("t"))


def rate_counts(trains: DataFrame, start: int, width: int, bins: int) -> DataFrame:
    """cluster_id, bin, n in fixed bins from start on."""
    return time_histogram(trains, start, start + width * bins, bins)
