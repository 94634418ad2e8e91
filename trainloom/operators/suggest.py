"""Ranked suggestions to merge or split clusters, similarity, and which clusters ask for attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainloom.functions import distribution, trains
from trainloom.operators import correlograms

#: Weight of complementary presence, and the least that counts.
DRIFT_WEIGHT, DRIFT_LEAST = 0.25, 0.3


def summaries(spikes: DataFrame, least: int) -> DataFrame:
    """cluster_id, n, mean_amp of clusters with enough spikes."""
    return spikes.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("amplitude").alias("mean_amp")).where(F.col("n") >= least)


def presence_complement(counts: DataFrame, pairs: DataFrame, bins: int) -> DataFrame:
    """a, b, complement: minus the correlation of two clusters' counts by bin, within 0 to 1, times the share of bins that are not both occupied.

    A bin is occupied above a tenth of the cluster's largest; the share is of the lesser number of occupied bins.
    """
    each = counts.groupBy("cluster_id").agg(F.array(*[F.sum(F.when(F.col("bin") == i, F.col("n")).otherwise(0)).cast("double") for i in range(bins)]).alias("v"))
    both = pairs.join(each.toDF("a", "x"), "a").join(each.toDF("b", "y"), "b")
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, z: s + z)
    both = both.withColumns({"mx": add(F.col("x")) / bins, "my": add(F.col("y")) / bins})
    cov = add(F.zip_with("x", "y", lambda p, q: (p - F.col("mx")) * (q - F.col("my"))))
    va, vb = add(F.transform("x", lambda p: (p - F.col("mx")) * (p - F.col("mx")))), add(F.transform("y", lambda q: (q - F.col("my")) * (q - F.col("my"))))
    ones = lambda v: F.transform(v, lambda p: F.when(p > 0.1 * F.array_max(v), 1.0).otherwise(0.0))
    both = both.withColumns({"cov": cov, "va": va, "vb": vb, "ox": ones(F.col("x")), "oy": ones(F.col("y"))})
    shared = add(F.zip_with("ox", "oy", lambda p, q: p * q)) / F.greatest(F.lit(1.0), F.least(add(F.col("ox")), add(F.col("oy"))))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.col("cov") / F.sqrt(F.col("va") * F.col("vb")))) * (1 - shared)
    return both.select("a", "b", F.when((F.col("va") > 0) & (F.col("vb") > 0), value).otherwise(0.0).alias("complement"))


def merge_candidates(spikes: DataFrame, total: int, reach: int, bins: int, centre: int, least: int, most_delta: float, least_score: float, top: int, rejected: DataFrame | None = None) -> DataFrame:
    """a, b, score, dip_z, amp_ks, amp_delta, complement, n_a, n_b of the `top` best pairs.

    Pairs of clusters with enough spikes and mean amplitudes near enough, less those rejected (a, b), score 0.6 of
    the refractory dip, 0.3 of the amplitudes' likeness, 0.1 of their means', and a quarter of the complement.
    """
    own = summaries(spikes, least)
    a, b = own.toDF("a", "n_a", "m_a"), own.toDF("b", "n_b", "m_b")
    big = F.greatest(F.abs("m_a"), F.abs("m_b"), F.lit(1e-6))
    # All pairs of clusters that pass the gates, as a score is wanted for each; spikes are joined by time only.
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("amp_delta", F.least(F.lit(1.0), F.abs(F.col("m_a") - F.col("m_b")) / big)).where(F.col("amp_delta") <= most_delta)
    if rejected is not None:
        both = rejected.select("a", "b").union(rejected.select("b", "a"))
        pairs = pairs.join(both, ["a", "b"], "left_anti")
    keys = pairs.select("a", "b")
    dips = correlograms.refractory_dip(correlograms.cross_correlogram(spikes, keys, reach, bins), ["a", "b"], bins, centre, max(4, 4 * centre)).select("a", "b", F.col("z").alias("dip_z"), F.col("score").alias("dip"))
    ks = distribution.ks_distance(spikes, "cluster_id", "amplitude", keys).select("a", "b", F.col("ks").alias("amp_ks"))
    complement = presence_complement(trains.presence_counts(spikes, total, 20), keys, 20)
    all_ = pairs.join(dips, ["a", "b"]).join(ks, ["a", "b"]).join(complement, ["a", "b"]).withColumn("complement", F.when(F.col("complement") >= DRIFT_LEAST, F.col("complement")).otherwise(0.0))
    score = 0.6 * F.col("dip") + 0.3 * (1 - F.col("amp_ks")) + 0.1 * (1 - F.col("amp_delta")) + DRIFT_WEIGHT * F.col("complement")
    out = all_.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).where(F.col("score") >= least_score)
    return out.orderBy(F.desc("score"), "a", "b").limit(top).select("a", "b", "score", "dip_z", "amp_ks", "amp_delta", "complement", "n_a", "n_b")


def split_scores(spikes: DataFrame, total: int, rate: float, refractory: int, least: int) -> DataFrame:
    """cluster_id, n_spikes, bimodality, contamination, drift, score by moments: 0.6 bimodality, 0.25 contamination, 0.15 drift, damped by a poor signal to noise ratio."""
    core = trains.core_metrics(spikes, total, rate, refractory).where(F.col("n_spikes") >= least)
    shape = distribution.moments(spikes, ["cluster_id"], "amplitude").select("cluster_id", F.when(F.col("n") >= 8, F.col("bimodality")).otherwise(0.0).alias("bimodality"))
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    out = core.join(shape, "cluster_id")
    drift = F.abs("drift_correlation")
    score = (0.6 * unit((F.col("bimodality") - 0.4) / 0.4) + 0.25 * unit(2 * F.col("refractory_contamination")) + 0.15 * unit((drift - 0.3) / 0.5)) * unit(F.col("amplitude_snr") / (F.col("amplitude_snr") + 0.5))
    return out.select("cluster_id", "n_spikes", "bimodality", F.col("refractory_contamination").alias("contamination"), drift.alias("drift"), unit(score).alias("score"))


def split_candidates(scores: DataFrame, least_score: float, top: int, rejected: DataFrame | None = None) -> DataFrame:
    found = scores.where(F.col("score") >= least_score)
    if rejected is not None:
        found = found.join(rejected, "cluster_id", "left_anti")
    return found.orderBy(F.desc("score"), "cluster_id").limit(top)


def cosine(x: Column, y: Column) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x) * dot(y, y)), F.lit(0.0))


def mean_vectors(vectors: DataFrame, group: str, column: str, width: int) -> DataFrame:
    """group, v: each group's mean vector, by one pass of partial sums."""
    return vectors.groupBy(group).agg(F.array(*[F.avg(F.get(column, i).cast("double")) for i in range(width)]).alias("v"))


def similar(templates: DataFrame, least: float, top: int) -> DataFrame:
    """a, b, similarity: for each template (id, v) its `top` most similar others of at least `least`, ties by id."""
    pairs = templates.toDF("a", "x").join(templates.toDF("b", "y"), F.col("a") != F.col("b")).select("a", "b", cosine(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= least)
    return pairs.withColumn("_k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("_k") <= top).drop("_k")


def components(edges: list[tuple[int, int, float]], least: float = 0.4, most: int = 4) -> list[list[int]]:
    """Groups of at most `most` clusters, by edges of at least `least`, strongest first; a union that would be too large is passed over.

    Greedy by strength, so on the driver; edges are top-k suggestions.
    """
    group: dict[int, frozenset] = {}
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        both = group.get(a, frozenset([a])) | group.get(b, frozenset([b]))
        if s >= least and len(both) <= most:
            group.update(dict.fromkeys(both, both))
    return sorted(sorted(g) for g in set(group.values()) if len(g) > 1)


def quality(core: DataFrame, cutoff: DataFrame) -> DataFrame:
    """cluster_id, the six scores, and quality: their geometric mean, each at least 0.001."""
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    out = core.join(cutoff, "cluster_id").select(
        "cluster_id",
        unit(1 - F.col("refractory_contamination")).alias("contamination_score"),
        unit(F.col("presence_ratio")).alias("presence_score"),
        unit(1 - F.col("longest_silent_gap")).alias("coverage_score"),
        F.when(F.col("amplitude_snr") <= 0, 0.0).otherwise(unit(F.col("amplitude_snr") / (F.col("amplitude_snr") + 1))).alias("snr_score"),
        unit(1 - 2 * F.col("amplitude_cutoff")).alias("completeness_score"),
        unit(1 - F.abs("drift_correlation")).alias("stability_score"),
    )
    logs = sum((F.log(F.greatest(F.col(c), F.lit(1e-3))) for c in out.columns[1:]), F.lit(0.0))
    return out.withColumn("quality", unit(F.exp(logs / 6)))


def attention(clusters: DataFrame) -> DataFrame:
    """cluster_id, score, reasons from quality, split, merge (best scores), outliers (share) and tags: the largest of 1 - quality, split, merge, ten times the outliers, and 1 for a review tag; reasons are those of at least 0.3."""
    parts = {"low_quality": 1 - F.col("quality"), "split": F.col("split"), "merge": F.col("merge"), "outliers": F.least(F.lit(1.0), 10 * F.col("outliers")), "review": F.when(F.exists("tags", lambda t: F.startswith(t, F.lit("review:"))), 1.0).otherwise(0.0)}
    parts = {k: F.coalesce(F.when(F.isnan(v), 0.0).otherwise(v), F.lit(0.0)) for k, v in parts.items()}
    reasons = F.array_compact(F.array(*[F.when(v >= 0.3, F.lit(k)) for k, v in parts.items()]))
    return clusters.select("cluster_id", F.greatest(*parts.values()).alias("score"), reasons.alias("reasons")).orderBy(F.desc("score"), "cluster_id")
