import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trainloom.sources import analyzer, formats, readers


@pytest.fixture
def phy(tmp_path):
    """Nine spikes of units 3, 8 and 11, not in order of time, and a recording of 12 samples of 3 channels that count down."""
    np.save(tmp_path / "spike_times.npy", np.array([7, 2, 25, 90, 31, 64, 58, 77, 40], np.int64))
    np.save(tmp_path / "spike_clusters.npy", np.array([3, 8, 3, 11, 8, 3, 8, 11, 3], np.uint32))
    (tmp_path / "cluster_group.tsv").write_text("cluster_id\tgroup\n8\tmua\n11\tgood\n")
    (tmp_path / "cluster_snr.tsv").write_text("cluster_id\tsnr\n3\t4.25\n8\t9\n")
    (tmp_path / "cluster_remark.tsv").write_text("cluster_id\tremark\n11\tlook again\n")
    (500 - 3 * np.arange(12)[:, None] - np.arange(3)).astype("<i2").tofile(tmp_path / "rec.dat")
    (tmp_path / "params.py").write_text("dat_path = 'rec.dat'\nn_channels_dat = 3\ndtype = 'int16'\noffset = 0\nsample_rate = 20000.  # Hz\nhp_filtered = False\n")
    return tmp_path


def test_phy_folder(spark, phy):
    assert formats.detect(str(phy)) == "phy"
    found = readers.open_phy(spark, str(phy))
    times = {r["cluster_id"]: sorted(r["t"]) for r in found["spikes"].groupBy("cluster_id").agg(F.collect_list("t").alias("t")).collect()}
    assert times == {3: [7, 25, 40, 64], 8: [2, 31, 58], 11: [77, 90]}
    rows = {r["cluster_id"]: r for r in found["clusters"].collect()}
    assert sorted(rows) == list(range(12)) and {k: r["label"] for k, r in rows.items() if r["label"] != "unsorted"} == {8: "mua", 11: "good"}
    assert rows[3]["metrics"] == {"snr": 4.25} and rows[11]["metrics"] == {}
    trace = {r["t"]: list(r["samples"]) for r in found["trace"].collect()}
    assert len(trace) == 12 and trace[5] == [485, 484, 483]


def test_phy_save_and_reopen(spark, phy):
    found = readers.open_phy(spark, str(phy))
    merged = found["spikes"].withColumn("cluster_id", F.when(F.col("cluster_id") == 3, 11).otherwise(F.col("cluster_id"))).repartition(3)
    readers.save_phy(merged, found["clusters"].withColumn("label", F.when(F.col("cluster_id") == 8, "noise").otherwise(F.col("label"))), str(phy))
    assert np.load(phy / "spike_clusters.npy").tolist() == [11, 8, 11, 11, 8, 11, 8, 11, 11]
    assert not list(phy.glob("*.part*"))
    labels = formats.group_labels(str(phy / "cluster_group.tsv"))
    assert labels[8] == "noise" and labels[11] == "good"


def test_lengths_must_agree(spark, phy):
    np.save(phy / "spike_clusters.npy", np.array([0, 1], np.uint32))
    with pytest.raises(ValueError):
        readers.open_phy(spark, str(phy))


def test_npy_of_rows(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(4, 3, 2)
    np.save(tmp_path / "x.npy", x)
    rows = readers.npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()
    assert [list(r["value"]) for r in rows] == x.reshape(4, 6).tolist()
    with pytest.raises(ValueError):
        formats.whole_numbers(str(tmp_path / "x.npy"))


def test_compressed_recording(spark, tmp_path):
    data = np.random.default_rng(1).integers(-32768, 32767, (250, 3)).astype(np.int16)
    readers.write_compressed(str(tmp_path / "a.cbin"), data, 30000.0, 100)
    readers.register(spark)
    rows = spark.read.format("mtscomp").option("path", str(tmp_path / "a.cbin")).load().orderBy("t").collect()
    assert (np.array([r["samples"] for r in rows]) == data).all()


def test_flat_binary_needs_whole_rows(spark, tmp_path):
    np.zeros(7, "<i2").tofile(tmp_path / "r.dat")
    readers.register(spark)
    with pytest.raises(Exception, match="whole number"):
        spark.read.format("flat_binary").option("path", str(tmp_path / "r.dat")).option("channels", 4).load().collect()


@pytest.mark.parametrize("wide", [False, True])
def test_mda(spark, tmp_path, wide):
    x = np.arange(12, dtype="<i2").reshape(4, 3)
    head = struct.pack("<iii", -4, 2, -2 if wide else 2) + struct.pack("<qq" if wide else "<ii", 3, 4)
    (tmp_path / "r.mda").write_bytes(head + x.tobytes())
    readers.register(spark)
    rows = spark.read.format("flat_binary").option("path", str(tmp_path / "r.mda")).load().orderBy("t").collect()
    assert [list(r["samples"]) for r in rows] == x.tolist()


def test_sidecars():
    meta = formats.spikeglx("; note\nimSampRate=30000.123\nnSavedChans=385\n")
    assert meta["sample_rate"] == 30000.123 and meta["n_channels"] == 385
    with pytest.raises(ValueError):
        formats.spikeglx("imSampRate=1\nnSavedChans=2\ndataType=float32")
    oebin = json.dumps({"continuous": [{"folder_name": "a/", "sample_rate": 30000, "num_channels": 64}]})
    assert formats.open_ephys(oebin) == [{"folder": "a", "sample_rate": 30000.0, "n_channels": 64}]
    places = json.dumps({"probes": [{"contact_positions": [[0, 0], [0, 20]], "device_channel_indices": [1, 0], "shank_ids": ["a", "b"]}]})
    assert formats.probe(places) == [{"channel": 1, "x": 0.0, "y": 0.0, "shank": 0}, {"channel": 0, "x": 0.0, "y": 20.0, "shank": 1}]


def test_notes_round_trip():
    for text in ("a\tb\nc\r\\d", "", "\\", "plain"):
        assert formats.unescape_note(formats.escape_note(text)) == text
    assert formats.unescape_note("x\\q\\") == "xq\\"


def test_curation_document():
    doc = {"manual_labels": [{"unit_id": 3, "labels": {"quality": ["good"], "tags": ["a"]}}, {"unit_id": "4", "quality": ["MUA"]}], "merges": [{"unit_ids": [1, 2]}]}
    assert formats.curation(json.dumps(doc)) == ([("3", "good", ["a"]), ("4", "mua", [])], [["1", "2"]])
    for bad in ([], {"splits": [1]}, {"merge_unit_groups": [[1]]}):
        with pytest.raises(ValueError):
            formats.curation(json.dumps(bad))


def test_events(spark, tmp_path):
    (tmp_path / "e.csv").write_text("time,label\n2.5,b\n0.1,a\n-1,c\n")
    rows = readers.event_samples(readers.read_events(spark, str(tmp_path / "e.csv")), 1000.0).collect()
    assert [(r["label"], r["t"]) for r in rows] == [("c", 0), ("a", 100), ("b", 2500)]


def test_detect(tmp_path):
    for bad in ("x", "y.dat"):
        (tmp_path / bad).mkdir() if bad == "x" else (tmp_path / bad).write_text("")
        with pytest.raises(ValueError):
            formats.detect(str(tmp_path / bad))
    (tmp_path / "x" / "sorting").mkdir()
    (tmp_path / "x" / "recording.json").write_text("{}")
    assert formats.detect(str(tmp_path / "x")) == "analyzer"


@pytest.fixture
def analyzer_folder(tmp_path):
    """Seven spikes of two units in one segment, metrics with a gap, and nine samples of two channels below a filter."""
    sorting = tmp_path / "sorting"
    sorting.mkdir()
    rows = np.array([(9, 0, 1), (4, 0, 0), (21, 0, 1), (33, 0, 1), (35, 0, 0), (50, 0, 0), (58, 0, 1)], [("sample_index", "<i8"), ("segment_index", "<i4"), ("unit_index", "<i2")])
    np.save(sorting / "spikes.npy", rows)
    np.save(sorting / "unit_ids.npy", np.array([12, 30]))
    (tmp_path / "extensions" / "quality_metrics").mkdir(parents=True)
    (tmp_path / "extensions" / "quality_metrics" / "metrics.csv").write_text("unit;snr;rate\n12;4.5;\n30;7;0.25\nx;1;1\n")
    (tmp_path / "recording.json").write_text(json.dumps({"class": "Filter", "kwargs": {"recording": {"class": "Binary", "kwargs": {"file_paths": ["raw.bin"], "sampling_frequency": 1000.0, "num_chan": 2, "dtype": "int16"}}}}))
    (np.arange(18).reshape(9, 2) - 4).astype("<i2").tofile(tmp_path / "raw.bin")
    return tmp_path


def test_analyzer_folder(spark, analyzer_folder):
    root = str(analyzer_folder)
    assert formats.detect(root) == "analyzer" and analyzer.detect_sorter(root, "analyzer") == "spikeinterface"
    found = analyzer.open_analyzer(spark, root)
    times = {r["cluster_id"]: sorted(r["t"]) for r in found["spikes"].groupBy("cluster_id").agg(F.collect_list("t").alias("t")).collect()}
    assert times == {12: [4, 35, 50], 30: [9, 21, 33, 58]}
    assert sorted(map(tuple, found["metrics"].collect())) == [(12, "snr", 4.5), (30, "rate", 0.25), (30, "snr", 7.0)]
    trace = {r["t"]: list(r["samples"]) for r in found["trace"].collect()}
    assert len(trace) == 9 and trace[2] == [0, 1]
    assert sorted(r["spike_idx"] for r in analyzer.record_spikes(spark, f"{root}/sorting/spikes.npy", 3).collect()) == list(range(7))
    (analyzer_folder / "sorting" / "annotations.json").write_text('{"__sorting_info__": {"log": {"sorter_name": "SpyKING"}}}')
    assert analyzer.detect_sorter(root, "analyzer") == "spyking"


def test_flat_analyzer_with_names(spark, tmp_path):
    sorting = tmp_path / "sorting"
    sorting.mkdir()
    np.save(sorting / "spike_times.npy", np.array([5, 1, 8], np.uint64))
    np.save(sorting / "unit_indices.npy", np.array([1, 0, 1], np.uint32))
    (sorting / "numpysorting_info.json").write_text('{"unit_ids": ["a", "007"]}')
    found = analyzer.open_analyzer(spark, str(tmp_path))
    assert sorted(map(tuple, found["clusters"].collect())) == [(0, "a", "unsorted"), (1, "007", "unsorted")]
    assert sorted(map(tuple, found["spikes"].collect())) == [(0, 5, 1), (1, 1, 0), (2, 8, 1)] and "trace" not in found
    bad = np.array([(1, 1, 0)], [("sample_index", "<i8"), ("segment_index", "<i4"), ("unit_index", "<i2")])
    np.save(sorting / "spikes.npy", bad)
    with pytest.raises(Exception, match="several segments"):
        analyzer.open_analyzer(spark, str(tmp_path))["spikes"].collect()
