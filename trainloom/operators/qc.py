"""The quality table: every metric of every cluster as one row, and its files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainloom.functions import distribution, trains
from trainloom.operators import correlograms, models, shape, suggest

#: Columns of the table after cluster_id, in the order of its files (fixed names: rules and files go by them).
METRICS = (
    "n_spikes", "firing_rate", "mean_amplitude", "presence_ratio", "isi_violations", "isi_violation_ratio", "amplitude_cutoff", "amplitude_snr",
    "drift_correlation", "longest_silent_gap", "composite_quality", "isolation_distance_sq", "l_ratio", "nn_isolation", "d_prime", "silhouette",
    "trough_to_peak_ms", "half_width_ms", "peak_trough_ratio", "repolarisation_slope", "n_extrema", "x_um", "y_um", "footprint_decay_um",
    "footprint_r80_um", "n_active_channels", "propagation_ms_per_100um", "burst_index", "rp_estimate_ms", "rp_contamination", "amplitude_dip", "drift_slope",
)
ISOLATION = {"isolation_distance": "isolation_distance_sq", "l_ratio": "l_ratio", "nn_hit_rate": "nn_isolation", "d_prime": "d_prime", "silhouette": "silhouette"}
SHAPES = {x: x for x in ("trough_to_peak_ms", "half_width_ms", "peak_trough_ratio", "repolarisation_slope", "n_extrema", "x_um", "y_um", "propagation_ms_per_100um")} | {"decay_um": "footprint_decay_um", "r80_um": "footprint_r80_um", "n_active": "n_active_channels"}


def renamed(measured: DataFrame, names: dict[str, str], key: str = "cluster_id") -> DataFrame:
    return measured.select(F.col(key).alias("cluster_id"), *[F.col(a).cast("double").alias(b) for a, b in names.items()])


def table(spikes: DataFrame, total: int, rate: float, refractory: int, windows: list[int], reach: int, bins: int, peak: tuple[int, int], base: tuple[int, int], isolation: DataFrame | None = None, shapes: DataFrame | None = None, dip: bool = True) -> DataFrame:
    """cluster_id and METRICS of each cluster with spikes.

    Each measure is its own plan of partial sums by cluster; tables of a row a cluster are joined at the end. windows:
    refractory times to try. reach, bins, peak and base: of the autocorrelogram and its burst index. isolation and
    shapes are what `models.isolation_by_group` (cluster_id) and `shape.template_shapes` (template_id, the cluster)
    give. What has no source is NaN; so is the dip unless it is asked for.
    """
    core = trains.core_metrics(spikes, total, rate, refractory)
    cutoff = distribution.amplitude_cutoff(spikes, ["cluster_id"], "amplitude")
    found = [
        core,
        cutoff,
        suggest.quality(core, cutoff).select("cluster_id", F.col("quality").alias("composite_quality")),
        correlograms.burst_index(correlograms.auto_correlogram(spikes, reach, bins), reach, bins, peak, base),
        trains.sliding_refractory(spikes, total, windows).select("cluster_id", F.col("contamination").alias("rp_contamination"), (F.col("window") * F.lit(1000.0 / rate)).alias("rp_estimate_ms")),
    ]
    if dip:
        found.append(distribution.dip(spikes, "cluster_id", "amplitude").withColumnRenamed("dip", "amplitude_dip"))
    if isolation is not None:
        found.append(renamed(isolation, ISOLATION))
    if shapes is not None:
        found.append(renamed(shapes, SHAPES, "template_id"))
    out = reduce(lambda a, b: a.join(b, "cluster_id", "left"), found)
    nan = F.lit(float("nan"))
    whole = ("n_spikes", "isi_violations")
    value = lambda c: F.col(c).cast("long") if c in whole else F.coalesce(F.col(c), nan) if c in out.columns else nan
    return out.select("cluster_id", *[value(c).alias(c) for c in METRICS])


def isolations(vectors: DataFrame, group: str, order: str, column: str, dims: int) -> DataFrame:
    """Isolation measures of each group's feature vectors, for `table`."""
    return models.isolation_by_group(vectors.withColumnRenamed(group, "cluster_id"), "cluster_id", order, column, dims)


def shapes(templates: DataFrame, channels: DataFrame, rate: float) -> DataFrame:
    """Shapes of clusters' mean waveforms, for `table`."""
    return shape.template_shapes(templates, channels, rate)


def without_nan(qc: DataFrame) -> DataFrame:
    """NaN and infinities as null, as files have them."""
    wrong = lambda c: F.isnan(c) | F.abs(c).isin(float("inf"))
    return qc.select(*[F.when(~wrong(F.col(c)), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in qc.dtypes])


def write_tsv(qc: DataFrame, path: str) -> None:
    """A folder of tab-separated files with a header, in order of cluster_id; what is not known is empty."""
    without_nan(qc).orderBy("cluster_id").write.mode("overwrite").option("header", True).option("sep", "\t").option("emptyValue", "").option("nullValue", "").csv(path)


def write_json(qc: DataFrame, path: str) -> None:
    """A folder of JSON lines, in order of cluster_id, every metric in every line; what is not known is null."""
    without_nan(qc).orderBy("cluster_id").write.mode("overwrite").option("ignoreNullFields", False).json(path)
