"""Curation of clusters as an append-only log of edits, and what the log makes of the spikes.

A log is a table of records (id, parent, kind, ...); the head is one of them, and the edits that hold are those
on the path from the root to the head. Undo moves the head to its parent, redo to its latest child. The log has a
row an edit, made by hand or by rules, and is small beside the spikes: the path is found on the driver; spikes are
relabelled by joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "id long, parent long, kind string, target long, sources array<long>, label string, tags array<string>, note string, picks array<struct<cluster_id: long, local: long>>, actor string, ts long, batch long"
EDITS = ("merge", "split", "relabel", "tag", "note")


def numbered_spikes(spikes: DataFrame) -> DataFrame:
    """spikes with spike_idx in order of time, cluster and original row, and local, their number within the cluster in that order.

    The global number needs one order of all rows: it is written once and kept.
    """
    order = ["t", "cluster_id", "row"]
    return spikes.withColumn("spike_idx", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("local", F.row_number().over(Window.partitionBy("cluster_id").orderBy("t", "row")) - 1)


def with_local(spikes: DataFrame) -> DataFrame:
    """spikes with local, their number within the cluster in order of t, then spike_idx."""
    return spikes.withColumn("local", F.row_number().over(Window.partitionBy("cluster_id").orderBy("t", "spike_idx")) - 1)


def merge(spikes: DataFrame, sources: list[int], target: int) -> DataFrame:
    """All spikes of sources get the target's id, which keeps its own."""
    return spikes.withColumn("cluster_id", F.when(F.col("cluster_id").isin([s for s in sources if s != target]), F.lit(target)).otherwise(F.col("cluster_id")))


def split(spikes: DataFrame, cluster: int, picked: DataFrame, new_id: int) -> DataFrame:
    """The spikes of a cluster whose local numbers are picked (local) get the new id; the id is taken even if none is."""
    chosen = picked.select(F.col("local").alias("local"), F.lit(True).alias("_in")).distinct()
    out = with_local(spikes).join(chosen, "local", "left")
    return out.withColumn("cluster_id", F.when((F.col("cluster_id") == cluster) & F.col("_in"), F.lit(new_id)).otherwise(F.col("cluster_id"))).drop("local", "_in")


def split_by_template(spikes: DataFrame, cluster: int, first_id: int) -> DataFrame:
    """A cluster's spikes by original template: those of the most common one stay, each other one's get a new id, by falling count."""
    inside = spikes.where(F.col("cluster_id") == cluster).groupBy("template").agg(F.count("*").alias("n"))
    ranked = inside.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "template")) - 1)  # a row a template
    ids = F.broadcast(ranked.where("k > 0").select("template", (F.lit(first_id) + F.col("k") - 1).alias("_new"), F.lit(cluster).alias("cluster_id")))
    return spikes.join(ids, ["template", "cluster_id"], "left").withColumn("cluster_id", F.coalesce("_new", "cluster_id")).drop("_new")


def add_spikes(spikes: DataFrame, extra: DataFrame) -> DataFrame:
    """spikes and extra ones; fails if an extra one has no cluster, a negative time or an index that is taken."""
    bad = extra.where("cluster_id is null or cluster_id < 0 or t is null or t < 0").limit(1).count()
    taken = extra.join(spikes, "spike_idx", "left_semi").limit(1).count()
    if bad or taken:
        raise ValueError("spikes to add need a cluster, a time from 0 on and an index of their own")
    return spikes.unionByName(extra, allowMissingColumns=True)


@dataclass
class Log:
    """The edit tree and its head."""

    records: list[dict] = field(default_factory=list)
    head: int = -1
    redo_to: dict[int, int] = field(default_factory=dict)

    def append(self, kind: str, actor: str = "human", ts: int = 0, **what) -> int:
        if kind not in EDITS:
            raise ValueError(kind)
        record = {"id": len(self.records), "parent": self.head, "kind": kind, "target": None, "sources": None, "label": None, "tags": None, "note": None, "picks": None, "actor": actor, "ts": ts, "batch": None} | what
        self.records.append(record)
        self.redo_to[self.head] = record["id"]
        self.head = record["id"]
        return self.head

    def undo(self) -> int:
        if self.head >= 0:
            self.head = self.records[self.head]["parent"]
        return self.head

    def redo(self) -> int:
        self.head = self.redo_to.get(self.head, self.head)
        return self.head

    def checkout(self, target: int) -> None:
        if not -1 <= target < len(self.records):
            raise ValueError(f"no record {target}")
        self.head = target

    def applied(self) -> list[dict]:
        """The edits from the root to the head."""
        out, at = [], self.head
        while at >= 0:
            out.append(self.records[at])
            at = self.records[at]["parent"]
        return out[::-1]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[c.split()[0]] for c in ("id", "parent", "kind", "target", "sources", "label", "tags", "note", "picks", "actor", "ts", "batch")) for r in self.records], LOG)

    @classmethod
    def read(cls, log: DataFrame, head: int | None = None) -> Log:
        """The log of a table of records, with the head at the last one unless given."""
        out = cls()
        for r in log.orderBy("id").collect():
            out.records.append(r.asDict(recursive=True))
            out.redo_to[r["parent"]] = r["id"]
        out.head = len(out.records) - 1 if head is None else head
        return out


def replay(spikes: DataFrame, log: Log) -> DataFrame:
    """spikes as the log's applied edits leave them; runs of merges are one relabelling."""
    remap: dict[int, int] = {}

    def flush(df: DataFrame) -> DataFrame:
        if not remap:
            return df
        pairs = [F.lit(x) for kv in sorted(remap.items()) for x in kv]
        remap.clear()
        return df.withColumn("cluster_id", F.coalesce(F.element_at(F.create_map(*pairs), F.col("cluster_id")), F.col("cluster_id")))

    for r in log.applied():
        if r["kind"] == "merge":
            for s in r["sources"]:
                if s != r["target"]:
                    remap.update({k: r["target"] for k, v in remap.items() if v == s} | {s: r["target"]})
        elif r["kind"] == "split":
            spikes = flush(spikes)
            picks = [(p["cluster_id"], p["local"]) if isinstance(p, dict) else tuple(p) for p in r["picks"] or []]
            chosen = spikes.sparkSession.createDataFrame(picks, "cluster_id long, local long") if picks else None
            if chosen is not None:
                spikes = split(spikes, picks[0][0], chosen, r["target"])
    return flush(spikes)


def labels(clusters: DataFrame, log: Log) -> DataFrame:
    """clusters (cluster_id, label, tags) with the log's labels and tags; a label by hand drops review:* tags and adds src:human."""
    by: dict[int, dict] = {}
    for r in log.applied():
        if r["kind"] in ("relabel", "tag"):
            own = by.setdefault(r["target"], {})
            if r["kind"] == "relabel":
                own["label"] = r["label"]
                own["human"] = r["actor"] == "human"
            else:
                own["tags"] = r["tags"]
    rows = [(k, v.get("label"), v.get("tags"), v.get("human", False)) for k, v in by.items()]
    edits = clusters.sparkSession.createDataFrame(rows, "cluster_id long, new_label string, new_tags array<string>, human boolean")
    tags = F.coalesce("new_tags", "tags", F.array().cast("array<string>"))
    reviewed = F.array_union(F.filter(tags, lambda t: ~F.startswith(t, F.lit("review:"))), F.array(F.lit("src:human")))
    out = clusters.join(F.broadcast(edits), "cluster_id", "left")
    return out.select("cluster_id", F.coalesce("new_label", "label").alias("label"), F.when(F.coalesce("human", F.lit(False)), reviewed).otherwise(tags).alias("tags"))


def latest_outcomes(proposals: DataFrame) -> DataFrame:
    """The last record (by seq) of each proposal id."""
    return proposals.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("_k = 1").drop("_k")


def fold_sizes(spikes: DataFrame, merges: list[tuple[list[int], int]]) -> DataFrame:
    """cluster_id, n after merges in their order."""
    return reduce(lambda df, m: merge(df, *m), merges, spikes).groupBy("cluster_id").agg(F.count("*").alias("n"))


def cache_evictions(entries: DataFrame, budget: int, oldest: int) -> DataFrame:
    """entries (key, bytes, mtime, live) with evict: orphans, those older than oldest, and, newest first, what the budget no longer holds.

    The running sum goes by day before it goes by entry, so no task has all entries.
    """
    keep = entries.withColumn("gone", ~F.col("live") | (F.col("mtime") < oldest)).withColumn("_b", F.when(F.col("gone"), 0).otherwise(F.col("bytes"))).withColumn("_day", F.floor(F.col("mtime") / 86_400))
    days = keep.groupBy("_day").agg(F.sum("_b").alias("_s"))
    newer = days.withColumn("_newer", F.coalesce(F.sum("_s").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.sum("_b").over(Window.partitionBy("_day").orderBy(F.desc("mtime"), "key").rowsBetween(Window.unboundedPreceding, 0))
    out = keep.join(newer, "_day").withColumn("_upto", inside + F.col("_newer"))
    return out.select("key", "bytes", "mtime", (F.col("gone") | (F.col("_upto") > budget)).alias("evict"))
