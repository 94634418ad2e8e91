"""Data sources for binary recordings, and the frames of a phy folder.

Each source splits its file into row ranges, one a partition; a partition maps only its own bytes. Files must be
on storage that all executors see.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from trainloom.sources import formats

#: Rows of a partition, and of an Arrow batch.
ROWS, BATCH = 1 << 20, 1 << 16


class Rows(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


def ranges(n: int, step: int) -> list[Rows]:
    return [Rows(a, min(n, a + step)) for a in range(0, n, step)] or [Rows(0, 0)]


class NpyReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step, self.head = path, step, formats.npy_header(path)

    def partitions(self) -> list[Rows]:
        return ranges(self.head.shape[0] if self.head.shape else 1, self.step)

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        data = np.load(self.path, mmap_mode="r").reshape(self.head.shape[0] if self.head.shape else 1, -1)
        whole = data.dtype.kind in "iub"
        for a in range(part.start, part.end, BATCH):
            x = np.asarray(data[a : min(part.end, a + BATCH)])
            row = pa.array(np.arange(a, a + len(x)))
            if x.shape[1] == 1:
                yield pa.RecordBatch.from_arrays([row, pa.array(x[:, 0].astype(np.int64 if whole else np.float64))], ["row", "value"])
            else:
                flat = pa.array(x.reshape(-1).astype(np.int64 if whole else np.float64))
                yield pa.RecordBatch.from_arrays([row, pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)], ["row", "value"])


class NpyWriter(DataSourceWriter):
    """One column, value, in order of row: each task leaves a part, the commit joins them. For exports of a size that one file holds."""

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, dtype

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        found = sorted((r["row"], r["value"]) for r in rows)
        np.savez(f"{self.path}.part{number}.npz", row=np.array([x[0] for x in found], np.int64), value=np.array([x[1] for x in found], self.dtype))
        message = WriterCommitMessage()
        message.number = number
        return message

    def commit(self, messages: list) -> None:
        names = [f"{self.path}.part{m.number}.npz" for m in messages if m is not None]
        parts = [np.load(n) for n in names]
        row, value = np.concatenate([p["row"] for p in parts]), np.concatenate([p["value"] for p in parts])
        formats.save_npy(self.path, value[np.argsort(row, kind="stable")])
        for n in names:
            os.remove(n)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(name := f"{self.path}.part{m.number}.npz"):
                os.remove(name)


class NpySource(DataSource):
    """format("npy"): row, value (long, double or an array of them) of an array by its first axis; option rows: rows a partition, dtype: type written."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        head = formats.npy_header(self.options["path"])
        kind = "bigint" if head.dtype.kind in "iub" else "double"
        return f"row bigint, value {kind}" if int(np.prod(head.shape[1:])) == 1 else f"row bigint, value array<{kind}>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", ROWS)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], self.options.get("dtype", "uint32"))


class FlatReader(DataSourceReader):
    """Interleaved samples, time by time."""

    def __init__(self, path: str, channels: int, dtype: str, offset: int, step: int):
        self.path, self.channels, self.dtype, self.offset, self.step = path, channels, np.dtype(dtype), offset, step
        size = os.path.getsize(path) - offset
        if size % (channels * self.dtype.itemsize):
            raise ValueError(f"{path}: {size} bytes are no whole number of {channels} channels of {dtype}")
        self.n = size // (channels * self.dtype.itemsize)

    def partitions(self) -> list[Rows]:
        return ranges(self.n, self.step)

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        data = np.memmap(self.path, self.dtype, "r", self.offset, (self.n, self.channels)) if self.n else np.zeros((0, self.channels), self.dtype)
        for a in range(part.start, part.end, BATCH):
            yield samples(a, np.asarray(data[a : min(part.end, a + BATCH)]))


def samples(start: int, x: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(x))), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1).astype(np.float32)))], ["t", "samples"])


class FlatSource(DataSource):
    """format("flat_binary"): t, samples of a raw recording; options path, channels, dtype (int16, uint16, int32, float32), offset, rows. An .mda file brings its own shape."""

    @classmethod
    def name(cls) -> str:
        return "flat_binary"

    def schema(self) -> str:
        return "t bigint, samples array<float>"

    def reader(self, schema) -> FlatReader:
        path, step = self.options["path"], int(self.options.get("rows", ROWS))
        if path.endswith(".mda"):
            head = formats.mda_header(path)
            return FlatReader(path, head.shape[0], head.dtype.str, head.offset, step)
        dtype = self.options.get("dtype", "int16")
        if dtype not in ("int16", "uint16", "int32", "float32"):
            raise ValueError(f"no recording is {dtype}")
        return FlatReader(path, int(self.options["channels"]), dtype, int(self.options.get("offset", 0)), step)


class CompressedReader(DataSourceReader):
    def __init__(self, path: str):
        with open(path[: -len(".cbin")] + ".ch") as f:
            self.head = json.load(f)
        if self.head.get("dtype", "int16") != "int16" or self.head.get("do_spatial_diff") or self.head.get("algorithm", "zlib") != "zlib":
            raise ValueError(f"{path}: only int16, zlib and differences along time are read")
        self.path = path

    def partitions(self) -> list[Rows]:
        return ranges(len(self.head["chunk_bounds"]) - 1, 1)

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        for k in range(part.start, part.end):
            yield samples(self.head["chunk_bounds"][k], chunk(self.path, self.head, k))


def chunk(path: str, head: dict, k: int) -> np.ndarray:
    """Samples of a chunk: inflated, and summed along time as 16-bit numbers wrap."""
    rows = head["chunk_bounds"][k + 1] - head["chunk_bounds"][k]
    with open(path, "rb") as f:
        f.seek(head["chunk_offsets"][k])
        raw = zlib.decompress(f.read(head["chunk_offsets"][k + 1] - head["chunk_offsets"][k]))
    x = np.frombuffer(raw, "<i2")
    if len(x) != rows * head["n_channels"]:
        raise ValueError(f"{path}: chunk {k} has {len(x)} samples")
    x = x.reshape(head["n_channels"], rows).T if head.get("chunk_order", "C").upper() == "F" else x.reshape(rows, head["n_channels"])
    return np.cumsum(x, axis=0, dtype=np.int16) if head.get("do_time_diff", True) else x


def write_compressed(path: str, data: np.ndarray, rate: float, rows: int) -> None:
    """A .cbin of int16 samples (time by channel) and its .ch."""
    bounds, offsets = [0], [0]
    with open(path, "wb") as f:
        for a in range(0, len(data), rows):
            x = data[a : a + rows].astype("<i2")
            f.write(zlib.compress(np.concatenate([x[:1], np.diff(x, axis=0)]).astype("<i2").tobytes()))
            bounds.append(a + len(x))
            offsets.append(f.tell())
    head = {"version": "1.0", "algorithm": "zlib", "do_time_diff": True, "do_spatial_diff": False, "dtype": "int16", "chunk_order": "C", "n_channels": int(data.shape[1]), "sample_rate": rate, "chunk_bounds": bounds, "chunk_offsets": offsets}
    with open(path[: -len(".cbin")] + ".ch", "w") as f:
        json.dump(head, f)


class CompressedSource(DataSource):
    """format("mtscomp"): t, samples of a .cbin recording, a partition a chunk."""

    @classmethod
    def name(cls) -> str:
        return "mtscomp"

    def schema(self) -> str:
        return "t bigint, samples array<float>"

    def reader(self, schema) -> CompressedReader:
        return CompressedReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (NpySource, FlatSource, CompressedSource):
        spark.dataSource.register(source)


def npy(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("npy").option("path", path).load()


def open_phy(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """spikes (spike_idx, t, cluster_id and, where there are files, amplitude, template_id), clusters (cluster_id, label, tags, origin, parents, note, metrics) and trace.

    Spike arrays must be of one length. Labels come from cluster_group.tsv, else from a curation document, else
    from cluster_KSLabel.tsv.
    """
    path = lambda name: os.path.join(root, name)
    lengths = {}
    spikes = None
    for name, column in (("spike_times", "t"), ("spike_clusters", "cluster_id"), ("amplitudes", "amplitude"), ("spike_templates", "template_id")):
        if os.path.exists(path(f"{name}.npy")):
            lengths[name] = formats.npy_header(path(f"{name}.npy")).shape[0]
            own = npy(spark, path(f"{name}.npy")).select(F.col("row").alias("spike_idx"), F.col("value").alias(column))
            spikes = own if spikes is None else spikes.join(own, "spike_idx")
    if len(set(lengths.values())) > 1 or "spike_times" not in lengths or "spike_clusters" not in lengths:
        raise ValueError(f"{root}: spike arrays of {lengths}")
    labels = formats.group_labels(path("cluster_group.tsv"))
    if not labels and os.path.exists(path("curation.json")):
        with open(path("curation.json")) as f:
            labels = {int(u): x for u, x, _ in formats.curation(f.read())[0] if x is not None and u.isdigit()}
    labels = labels or formats.group_labels(path("cluster_KSLabel.tsv"))
    tags, notes = formats.tags(path("cluster_tags.tsv")), formats.annotations(path("cluster_annotations.tsv"))
    metrics: dict[int, dict[str, float]] = {}
    known = ("cluster_group.tsv", "cluster_KSLabel.tsv", "cluster_tags.tsv", "cluster_annotations.tsv")
    for name in sorted(os.listdir(root)):
        if name.startswith("cluster_") and name.endswith(".tsv") and name not in known:
            for k, v in (formats.metric(path(name)) or {}).items():
                metrics.setdefault(k, {})[name[8:-4]] = v
    last = spikes.agg(F.max("cluster_id")).first()[0]
    ids = range(max([-1 if last is None else last, *labels, *tags, *notes]) + 1)
    rows = [(i, labels.get(i, "unsorted"), tags.get(i, []), notes.get(i, {}).get("origin"), notes.get(i, {}).get("parents", []), notes.get(i, {}).get("note"), metrics.get(i, {})) for i in ids]
    out = {"spikes": spikes, "clusters": spark.createDataFrame(rows, "cluster_id long, label string, tags array<string>, origin string, parents array<long>, note string, metrics map<string, double>")}
    if os.path.exists(path("params.py")):
        with open(path("params.py")) as f:
            p = formats.params(f.read())
        data = p.get("dat_path")
        data = data[0] if isinstance(data, list) else data
        if data and os.path.exists(full := os.path.join(root, data)):
            source = spark.read.format("mtscomp" if full.endswith(".cbin") else "flat_binary").option("path", full)
            out["trace"] = source.option("channels", p.get("n_channels_dat", 1)).option("dtype", p.get("dtype", "int16")).option("offset", p.get("offset", 0)).load()
    return out


def save_phy(spikes: DataFrame, clusters: DataFrame, root: str) -> None:
    """spike_clusters.npy in order of spike_idx, and cluster_group.tsv and cluster_tags.tsv."""
    register(spikes.sparkSession)
    spikes.select(F.col("spike_idx").alias("row"), F.col("cluster_id").alias("value")).write.format("npy").option("path", os.path.join(root, "spike_clusters.npy")).mode("append").save()
    rows = clusters.orderBy("cluster_id").collect()  # a row a cluster
    for name, head, value in (("cluster_group.tsv", "group", lambda r: r["label"] if r["label"] != "unsorted" else ""), ("cluster_tags.tsv", "tags", lambda r: ",".join(r["tags"] or []))):
        target = os.path.join(root, name)
        with open(f"{target}.tmp", "w") as f:
            f.write(f"cluster_id\t{head}\n" + "".join(f"{r['cluster_id']}\t{value(r)}\n" for r in rows if value(r)))
        os.replace(f"{target}.tmp", target)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """time_s, label of a .csv, .tsv or .txt (seconds, label) or .npy file, in order of time."""
    if path.endswith(".npy"):
        return npy(spark, path).select(F.col("value").cast("double").alias("time_s"), F.lit(None).cast("string").alias("label")).orderBy("time_s")
    rows = spark.read.option("sep", "\t" if path.endswith(".tsv") else ",").schema("time_s string, label string").csv(path)
    return rows.select(F.expr("try_cast(trim(time_s) as double)").alias("time_s"), F.trim("label").alias("label")).where("time_s is not null").orderBy("time_s")


def event_samples(events: DataFrame, rate: float) -> DataFrame:
    """events with t, the sample that is nearest to its time, 0 at least."""
    return events.withColumn("t", F.greatest(F.lit(0), F.round(F.col("time_s") * F.lit(rate))).cast("long"))


def open_nwb(path: str):
    """Units of an NWB file; needs h5py, which is optional."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading NWB and rez.mat needs h5py") from e
    with h5py.File(path, "r") as f:
        ids, times, ends = f["units/id"][:], f["units/spike_times"][:], f["units/spike_times_index"][:]
    starts = np.concatenate([[0], ends[:-1]])
    return [(int(u), float(t)) for u, a, b in zip(ids, starts, ends, strict=True) for t in np.sort(times[a:b])]
