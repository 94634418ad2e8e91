"""The quality table of all clusters, and its oracle from those of its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainloom.operators import qc
from trainloom.plans import curation_queries  # noqa: F401  (its oracle of the composite)
from trainloom.plans.queries import BINS, ORACLE, REACH, RP, query, rounded
from trainloom.plans.tables import RATE, rebased, spikes

PARTS = {"qc_core": "core", "amplitude_cutoff": "cutoff", "quality": "quality", "burst_index": "burst", "sliding_refractory": "rp"}
SOURCE = {"composite_quality": "round(quality.quality, 6)", "rp_contamination": "rp.contamination", "rp_estimate_ms": "round(rp.\"window\" / 1000.0, 9)"}
UNKNOWN = (*qc.ISOLATION.values(), *qc.SHAPES.values(), "amplitude_dip")
COLUMNS = ", ".join(f"{SOURCE[m]} AS {m}" if m in SOURCE else f"'NaN'::DOUBLE AS {m}" if m in UNKNOWN else f"burst.{m}" if m == "burst_index" else f"cutoff.{m}" if m == "amplitude_cutoff" else f"core.{m}" for m in qc.METRICS)


@query(f"SELECT core.cluster_id, {COLUMNS} FROM ({ORACLE['qc_core']}) core " + " ".join(f"JOIN ({ORACLE[k]}) {v} ON {v}.cluster_id = core.cluster_id" for k, v in PARTS.items() if v != "core"))
def qc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics that the event tables have a source for; the rest is NaN, as they have no features or waveforms."""
    trains, total = rebased(spikes(spark, sf_dir))
    found = qc.table(trains, total, RATE, RP, [(k + 1) * 60_000_000 for k in range(20)], REACH, BINS, (288_000_000, 1_440_000_000), (4_320_000_000, 7_200_000_000), dip=False)
    return rounded(found.withColumn("composite_quality", F.round("composite_quality", 6)))


@query()
def qc_isolation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of clusters of feature vectors: isolation and amplitude dips besides, of the embeddings' labels."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    trains = vectors.select(F.col("vec_id").alias("spike_idx"), F.col("label").cast("long").alias("cluster_id"), (F.col("vec_id") * 1000).alias("t"), F.get("embedding", 0).cast("double").alias("amplitude"))
    trains, total = rebased(trains)
    isolation = qc.isolations(vectors.select(F.col("label").cast("long").alias("cluster_id"), "vec_id", "embedding"), "cluster_id", "vec_id", "embedding", 8)
    return rounded(qc.table(trains, total, 1000.0, 2, [2, 5, 10], 100_000, 100, (2000, 10_000), (30_000, 50_000), isolation), 6)
