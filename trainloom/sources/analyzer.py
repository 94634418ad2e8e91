"""Analyzer folders of the binary kind: spikes, units with their metrics, and the raw recording."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainloom.sources import formats, readers

#: Spikes that a task reads at once.
CHUNK = 1_000_000


def record_spikes(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """spike_idx, t, unit_index of an array of records with sample_index and unit_index; a second segment raises an error."""
    head = formats.npy_header(path)
    names = head.dtype.names or ()
    if not {"sample_index", "unit_index"} <= set(names) or len(head.shape) != 1:
        raise ValueError(f"{path}: records of {names or head.dtype}, not of spikes")
    n, dtype, offset = head.shape[0], head.dtype, head.offset

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for start in own["id"].tolist():
                rows = np.fromfile(path, dtype, min(chunk, n - start * chunk), offset=offset + start * chunk * dtype.itemsize)
                if "segment_index" in names and (rows["segment_index"] != 0).any():
                    raise ValueError(f"{path}: several segments")
                yield pd.DataFrame({"spike_idx": start * chunk + np.arange(len(rows)), "t": rows["sample_index"].astype(np.int64), "unit_index": rows["unit_index"].astype(np.int64)})

    return spark.range(-(-n // chunk)).mapInPandas(of, "spike_idx long, t long, unit_index long")


def flat_spikes(spark: SparkSession, folder: str) -> DataFrame:
    """spike_idx, t, unit_index of two arrays of one length."""
    paths = {c: os.path.join(folder, f"{name}.npy") for c, name in (("t", "spike_times"), ("unit_index", "unit_indices"))}
    lengths = {formats.npy_header(p).shape[0] for p in paths.values()}
    if len(lengths) > 1:
        raise ValueError(f"{folder}: spike arrays of {sorted(lengths)} entries")
    t, unit = (readers.npy(spark, p).select(F.col("row").alias("spike_idx"), F.col("value").cast("long").alias(c)) for c, p in paths.items())
    return t.join(unit, "spike_idx")


def unit_names(folder: str) -> list | None:
    """Ids of the units in order, as they are stored; None if the folder has none."""
    if os.path.exists(path := os.path.join(folder, "unit_ids.npy")):
        return np.load(path).tolist()
    if os.path.exists(path := os.path.join(folder, "numpysorting_info.json")):
        with open(path) as f:
            return json.load(f).get("unit_ids")
    return None


def wide_metrics(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, name, value of a table with a unit in its first column and a metric in each other one, apart by tabs, semicolons or commas; cells without a number are left out."""
    with open(path) as f:
        head = f.readline().rstrip("\r\n")
    sep = next((c for c in "\t;," if c in head), ",")
    names = [x.strip() for x in head.split(sep)]
    columns = [f"c{i}" for i in range(len(names))]
    rows = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).schema(", ".join(f"{c} string" for c in columns)).csv(f"file://{os.path.abspath(path)}")
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(f"try_cast(trim({c}) as double)").alias("value")) for c, n in zip(columns[1:], names[1:], strict=True)]) if len(names) > 1 else F.array().cast("array<struct<name:string,value:double>>")
    return rows.select(F.expr("try_cast(trim(c0) as bigint)").alias("cluster_id"), F.explode(pairs).alias("m")).select("cluster_id", "m.name", "m.value").where("cluster_id is not null and value is not null")


def recording(root: str) -> dict | None:
    """path, rate, channels, dtype, offset of the raw file that the folder's description names, below whatever steps that leave channels and samples as they are."""
    for name in ("recording.json", "binary.json"):
        if not os.path.exists(path := os.path.join(root, name)):
            continue
        with open(path) as f:
            found = json.load(f)
        while isinstance(inner := found.get("kwargs", {}).get("recording") or found.get("kwargs", {}).get("parent_recording"), dict):
            found = inner
        own = found.get("kwargs", found)
        files = own.get("file_paths") or ([own["file_path"]] if own.get("file_path") else [])
        channels = own.get("num_channels") or own.get("num_chan")
        if len(files) != 1 or not channels or not own.get("sampling_frequency"):
            raise ValueError(f"{path}: needs one file, channels and a rate")
        return {"path": os.path.join(root, files[0]), "rate": float(own["sampling_frequency"]), "channels": int(channels), "dtype": str(np.dtype(own.get("dtype", "int16"))), "offset": int(own.get("file_offset") or 0)}
    return None


def open_analyzer(spark: SparkSession, root: str, labels: str | None = None) -> dict[str, DataFrame]:
    """spikes (spike_idx, t, cluster_id), clusters (cluster_id, name, label), metrics (cluster_id, name, value) and trace, where there are files.

    Units are named by their ids if all are whole numbers, else by their place, with the stored id as name. Labels are
    those of a curation document, by name: of `labels`, else of the folder's own.
    """
    folder = os.path.join(root, "sorting")
    records = os.path.join(folder, "spikes.npy")
    spikes = record_spikes(spark, records) if os.path.exists(records) else flat_spikes(spark, folder)
    names = unit_names(folder)
    if names is None:
        names = list(range((spikes.agg(F.max("unit_index")).first()[0] or -1) + 1))
    whole = all(isinstance(x, int) and x >= 0 for x in names)
    document, said = labels or os.path.join(root, "curation.json"), {}
    if os.path.exists(document):
        with open(document) as f:
            said = {u: x for u, x, _ in formats.curation(f.read())[0] if x is not None}
    rows = [(i, x if whole else i, str(x), said.get(str(x), "unsorted")) for i, x in enumerate(names)]
    units = spark.createDataFrame(rows, "unit_index long, cluster_id long, name string, label string")
    out = {"spikes": spikes.join(F.broadcast(units), "unit_index", "left").select("spike_idx", "t", "cluster_id"), "clusters": units.drop("unit_index")}  # a row a unit is broadcast
    if os.path.exists(path := os.path.join(root, "extensions", "quality_metrics", "metrics.csv")):
        out["metrics"] = wide_metrics(spark, path)
    if found := recording(root):
        readers.register(spark)
        out["trace"] = spark.read.format("flat_binary").option("path", found["path"]).option("channels", found["channels"]).option("dtype", found["dtype"]).option("offset", found["offset"]).load()
    return out


def detect_sorter(root: str, kind: str) -> str | None:
    """Name of the program that sorted a folder of a kind that `formats.detect` names, in lower case; None if nothing tells."""

    def noted(path: str, *keys: str) -> str | None:
        try:
            with open(path) as f:
                found = json.load(f)
            for k in keys:
                found = found[k]
            return found.lower()
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            return None

    for folder in (root, os.path.dirname(os.path.abspath(root))):
        if found := noted(os.path.join(folder, "spikeinterface_log.json"), "sorter_name"):
            return found
    has = lambda name: os.path.exists(os.path.join(root, name))
    if kind == "phy":
        return "kilosort4" if has("ops.npy") else "kilosort" if has("rez.mat") or has("cluster_KSLabel.tsv") else None
    if kind == "analyzer":
        return noted(os.path.join(root, "sorting", "annotations.json"), "__sorting_info__", "log", "sorter_name") or "spikeinterface"
    return {"rez": "kilosort", "nwb": "nwb", "nwb_zarr": "nwb"}.get(kind)
