import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trainloom.operators import learn, probe, qc, shape, suggest, tables
from trainloom.streaming import rates


def test_probe_grammar():
    assert probe.parse("acg 3 win=20 bin=0.5") == probe.Probe("acg", (3,), {"win": 20.0, "bin": 0.5})
    assert probe.parse("eval merge 1 2 3").ids == (1, 2, 3)
    for bad in ("", "acg", "acg x", "acg 1 win=0", "ccg 1 1", "acg 1 foo=2", "window 1 5 2", "split 1 by=pc", "eval merge 1", "nope 1"):
        with pytest.raises(ValueError):
            probe.parse(bad)
    assert probe.cluster_list("3 7, 10-12 7") == [3, 7, 10, 11, 12]
    with pytest.raises(ValueError):
        probe.cluster_list("5-3")


def test_probes_answer(spark):
    rows = [(i, i % 2, 10 * i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "spike_idx long, cluster_id long, t long, amplitude double")
    for text, n in (("acg 0 win=50 bin=10", 10), ("ccg 0 1 win=50 bin=10", 10), ("window 0 0.1 0.2", 2), ("eval merge 0 1", 3), ("split 0 by=amp", 2), ("split 0 by=time at=0.1", 2), ("compare 0 1", 2)):
        assert probe.run(df, probe.parse(text), 400, 1000.0, 2).count() == n, text


def test_landmarks_and_footprint():
    s = np.arange(40)
    wave = -np.exp(-((s - 10) ** 2) / 8) + 0.4 * np.exp(-((s - 18) ** 2) / 20)
    found = shape.landmarks(wave, 30000.0)
    assert not found["inverted"] and found["trough_to_peak_ms"] == pytest.approx(8 / 30, abs=0.05)
    assert 0.1 < found["half_width_ms"] < 0.25 and found["repolarisation_slope"] > 0
    assert shape.landmarks(-3 * wave, 30000.0)["inverted"] and shape.landmarks(np.ones(9), 1.0) is None
    places = np.array([[0.0, 20.0 * c] for c in range(5)])
    many = np.stack([wave * np.exp(-abs(c - 2)) for c in range(5)], axis=1)
    found = shape.footprint(many, places, 30000.0)
    assert found["peak_channel"] == 2 and found["y_um"] == pytest.approx(40) and found["decay_um"] == pytest.approx(20) and found["n_active"] == 3


def test_landmarks_of_a_trough_above_zero(spark):
    """A waveform that stays above 0 has no half width; its other landmarks stand."""
    found = shape.landmarks(np.array([10.0, 8.0, 8.0, 9.0, 10.0]), 1000.0)
    assert np.isnan(found["half_width_ms"]) and found["trough"] == 8 and not found["inverted"]
    assert found["trough_to_peak_ms"] == 3 and found["peak_trough_ratio"] == 1.25 and found["repolarisation_slope"] == pytest.approx(2 / 3)
    rows = spark.createDataFrame([("A", s, 0, float(v)) for s, v in enumerate((10, 8, 8, 9, 10))] + [("B", s, 0, float(v)) for s, v in enumerate((0, -8, 0, 1, 0))], "template_id string, s int, ch int, v double")
    places = spark.createDataFrame([(0, 0.0, 0.0)], "ch int, x double, y double")
    by = {r["template_id"]: r for r in shape.template_shapes(rows, places, 1000.0).collect()}
    assert set(by) == {"A", "B"} and by["A"]["half_width_ms"] is None and by["B"]["half_width_ms"] == pytest.approx(1.0)


def test_pair_outcomes_are_counted_without_pairs(spark):
    """Counts are those of the pairs, of repeated roots and null homes too; a home of 400,000 roots (80 billion pairs) is no more work than its rows."""
    rng = np.random.default_rng(6)
    pick = lambda n, m: [(None if rng.random() < 0.05 else int(rng.integers(0, m)), None if rng.random() < 0.1 else int(rng.integers(0, 4))) for _ in range(n)]
    for most in (30, 400):
        truth, test = (spark.createDataFrame(pick(60, most), "root long, home int") for _ in range(2))
        wanted = tables.pair_outcomes(tables.together(truth), tables.together(test)).groupBy("outcome").count().collect()
        assert sorted(map(tuple, tables.pair_outcome_counts(truth, test).collect())) == sorted(map(tuple, wanted)), most
    empty = spark.createDataFrame([], "root long, home int")
    assert tables.pair_outcome_counts(empty, empty).collect() == []
    many = spark.range(400_000).select(F.col("id").alias("root"), F.lit(1).alias("home"))
    halves = many.select("root", (F.col("root") % 2).cast("int").alias("home"))
    n, half = 400_000 * 399_999 // 2, 200_000 * 199_999
    assert dict(map(tuple, tables.pair_outcome_counts(many, halves).collect())) == {"hit": half, "missed_merge": n - half}


def test_merge_candidates_of_dense_clusters(spark):
    """Two clusters of 150,000 spikes all within reach of one another: no row for each of 45 billion pairs."""
    df = spark.range(300_000).select(F.col("id").alias("spike_idx"), (F.col("id") % 2).alias("cluster_id"), F.floor(F.col("id") / 2).alias("t"), (F.col("id") % 7).cast("double").alias("amplitude"))
    found = suggest.merge_candidates(df, 150_000, 150_000, 10, 1, 30, 0.5, 0.0, 8).collect()
    assert len(found) == 1 and (found[0]["a"], found[0]["b"], found[0]["n_a"], found[0]["n_b"]) == (0, 1, 150_000, 150_000)
    assert found[0]["dip_z"] < 0 and found[0]["amp_ks"] < 0.01  # most lags are short


def test_fdr_threshold():
    found = shape.fdr_threshold(np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 1, 2, 2, 3]), 5, 0.1)
    assert found == {"theta": 2.0, "accepted": 4, "false_positives": 0.6} or found["theta"] == 3.0
    assert found["false_positives"] / found["accepted"] <= 0.1
    assert shape.fdr_threshold(np.array([1.0]), np.array([5.0] * 9), 1, 0.1) is None


def test_boosted_trees(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    x[rng.random(600) < 0.1, 2] = np.nan
    model = learn.boost(x, y, rounds=60)
    assert ((model.predict(x) > 0.5) == y).mean() > 0.95
    line = learn.boost(x, 3 * x[:, 3], loss="squared", rounds=80)
    assert np.corrcoef(line.predict(x), x[:, 3])[0, 1] > 0.97
    assert np.allclose(learn.boost(x, y, rounds=5, share=0.5).margin(x), learn.boost(x, y, rounds=5, share=0.5).margin(x))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:20]], "a double, b double, c double, d double")
    found = [r["prediction"] for r in learn.score(df, model, ["a", "b", "c", "d"]).collect()]
    assert np.allclose(found, model.predict(x[:20]))


def test_small_features():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(99, 2)), [[9.0, 9.0]]])
    assert learn.neighbour_density(x, 5).argmax() == 99 and learn.mahalanobis(x).argmax() == 99
    cut = learn.best_cut(np.arange(100.0), np.arange(100) > 60)
    assert cut["upper"] and cut["test"] > 0.9
    assert learn.paired_interval(np.array([1.0, 2.0])) is None
    low, high = learn.paired_interval(np.arange(20.0))
    assert low < 9.5 < high


def test_tables(spark):
    rows = spark.createDataFrame([(0, 2.0), (1, None), (2, float("nan")), (3, 5.0), (4, 2.0)], "cluster_id long, x double")
    for down, want in ((True, [3, 0, 4, 1, 2]), (False, [0, 4, 3, 1, 2])):
        assert [r["cluster_id"] for r in tables.ranked(rows, "x", down).orderBy("place").collect()] == want
    assert tables.column("ID", rows) == "cluster_id" and tables.column("zz", rows) is None
    with pytest.raises(ValueError):
        tables.append_sessions([("a", rows), ("b", rows.drop("x"))])
    with pytest.raises(ValueError):
        tables.paired(rows, rows.where("cluster_id > 0"), ["cluster_id"])


def test_log_tail(spark, tmp_path):
    log = spark.createDataFrame([(0, "merge"), (1, "split")], "id long, kind string")
    log.write.parquet(str(tmp_path / "log"))
    stream = rates.log_tail(spark, str(tmp_path / "log"), "id long, kind string")
    rates.follow_log(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    log.withColumn("id", F.col("id") + 2).write.mode("append").parquet(str(tmp_path / "log"))
    rates.follow_log(rates.log_tail(spark, str(tmp_path / "log"), "id long, kind string"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]


def test_late_events_are_dropped(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1)
    make([(1, 10, 1, "a", 1.0, ""), (2, 100_000, 1, "a", 1.0, "")]).write.parquet(str(tmp_path / "in" / "events.parquet"))
    found = rates.drain(rates.tumbling_rates(rates.event_stream(spark, str(tmp_path / "in"), "*.parquet"), "1 minute", "1 minute"), "append").collect()
    assert [(r["start"].timestamp(), r["n"]) for r in found] == [(0.0, 1)]


def test_qc_table_and_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(c), int(t), float(a)) for i, (c, t, a) in enumerate(zip(rng.integers(0, 3, 400), np.sort(rng.integers(0, 60_000, 400)), rng.normal(5, 1, 400), strict=True))]
    spikes = spark.createDataFrame(rows, "spike_idx long, cluster_id long, t long, amplitude double")
    found = qc.table(spikes, 60_000, 1000.0, 2, [1, 2, 4], 50, 50, (2, 10), (30, 50))
    assert found.columns == ["cluster_id", *qc.METRICS] and len(qc.METRICS) == 32
    by = {r["cluster_id"]: r for r in found.collect()}
    for c in range(3):
        own = np.array([a for _, k, _, a in rows if k == c])
        assert by[c]["n_spikes"] == len(own) and by[c]["mean_amplitude"] == pytest.approx(own.mean()) and math.isnan(by[c]["d_prime"]) and by[c]["amplitude_dip"] >= 0
    qc.write_tsv(found, str(tmp_path / "tsv"))
    qc.write_json(found, str(tmp_path / "json"))
    lines = "".join(x.read_text() for x in (tmp_path / "tsv").glob("part-*")).splitlines()
    assert lines[0].split("\t") == found.columns and all(len(x.split("\t")) == 33 for x in lines)
    records = [json.loads(x) for f in (tmp_path / "json").glob("part-*") for x in f.read_text().splitlines()]
    assert [set(x) for x in records] == [set(found.columns)] * 3 and all(x["silhouette"] is None for x in records)


def test_as_of_and_neighbours(spark):
    rng = np.random.default_rng(6)
    left = [(int(k), int(t), int(i)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 500, 60), strict=True))]
    right = [(int(k), int(t), float(v)) for k, t, v in zip(rng.integers(0, 3, 40), rng.integers(0, 500, 40), rng.random(40), strict=True)] + [(0, 3, None)]
    a, b = spark.createDataFrame(left, "k long, t long, i long"), spark.createDataFrame(right, "k long, t long, v double")
    want = {}
    for k, t, i in left:
        before = [(u, v) for j, u, v in right if j == k and u <= t and v is not None]
        want[i] = max(before)[1] if before else None
    for block in (1, 37, 10_000):
        assert {r["i"]: r["v"] for r in tables.as_of(a, b, "k", "t", "v", block).collect()} == want
    points = spark.createDataFrame([(5, 0.0, 0.0), (2, 2.0, 0.0), (9, 9.0, 9.0)], "id long, x double, y double")
    assert tables.nearest(points, 1.0, 0.0, 3.0).first()["id"] == 2 and tables.nearest(points, 50.0, 0.0, 3.0).count() == 0
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.4), (1, 9, 0.3)], "a long, b long, s double")
    assert tables.inner_edges(edges, spark.createDataFrame([(1,), (2,), (3,)], "c long"), "c").count() == 2


def test_failures_and_read_only(spark):
    rows = spark.createDataFrame([(1, 0.5, -3.0), (2, float("nan"), 1.0), (3, 0.1, None)], "c long, p double, d double")
    limits = {"p": {"greater": 0.4, "less": 0.9}, "d": {"less": 2.0, "abs": True}, "nothing": {"less": 1}}
    got = [r["f"] for r in rows.orderBy("c").select(tables.threshold_failures(rows, limits).alias("f")).collect()]
    assert got == [["d"], ["p"], ["p", "d"]]
    got = [r["f"] for r in rows.orderBy("c").select(tables.threshold_failures(rows, limits, ("d",)).alias("f")).collect()]
    assert got == [["d"], [], ["p", "d"]]
    assert tables.read_only(spark, "WITH x AS (SELECT explode(sequence(1, 9)) AS a) SELECT a FROM x ORDER BY a", 3).count() == 3
    for sql in ("DROP TABLE IF EXISTS x", "CREATE TABLE x (a INT) USING parquet", "SET a = 1"):
        with pytest.raises(ValueError):
            tables.read_only(spark, sql)
