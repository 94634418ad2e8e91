import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trainloom.functions import distribution as ds
from trainloom.functions import trains as tr
from trainloom.operators import correlograms as co
from trainloom.operators import curation, filters, models, rules, scoring, signal, suggest


def trains(spark, rows):
    return spark.createDataFrame([(i, c, t, float(a)) for i, (c, t, a) in enumerate(rows)], "spike_idx long, cluster_id long, t long, amplitude double")


def test_intervals_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), int(t), 1.0) for c, t in zip(rng.integers(0, 3, 300), rng.integers(0, 10_000, 300), strict=True)]
    sums = [tr.with_isi(trains(spark, rows), b).groupBy("cluster_id").agg(F.sum("isi").alias("s"), F.count("isi").alias("n")).orderBy("cluster_id").collect() for b in (7, 1000, 10**9)]
    assert sums[0] == sums[1] == sums[2]


def test_violators_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(c), int(t), 1.0) for c, t in zip(rng.integers(0, 3, 200), rng.integers(0, 3_000, 200), strict=True)]
    want = set()
    for c in range(3):
        own = sorted((t, i) for i, (d, t, _) in enumerate(rows) if d == c)
        want |= {i for (t, i), (u, k) in zip(own, own[1:]) for i in (i, k) if u - t < 9}
    for block in (7, 500, 10**9):
        assert {r["spike_idx"] for r in tr.isi_violators(trains(spark, rows), 9, block).collect()} == want


def test_home_of_ties(spark):
    table = spark.createDataFrame([(1, 9, 5), (1, 10, 5), (2, 4, 1), (2, 3, 7)], "a long, b long, n long")
    assert sorted(map(tuple, scoring.home(table).collect())) == [(1, 9, 0.5), (2, 3, 0.875)]


def test_core_metrics_of_known_train(spark):
    rows = [(0, 0, 1.0), (0, 10, 3.0), (0, 12, 5.0), (1, 50, 2.0)]
    found = {r["cluster_id"]: r for r in tr.core_metrics(trains(spark, rows), 100, 10.0, 5, 10).collect()}
    a, b = found[0], found[1]
    assert (a["n_spikes"], a["isi_violations"], a["mean_amplitude"]) == (3, 1, 3.0)
    assert a["isi_violation_ratio"] == pytest.approx(1 / 1.2) and a["isi_violation_fraction"] == 0.5
    assert a["refractory_contamination"] == pytest.approx(min(1, 100 / (2 * 5 * 9)))
    assert a["presence_ratio"] == 0.2 and a["longest_silent_gap"] == 0.88
    assert b["std_amplitude"] == 0 and b["drift_slope"] == 0 and b["longest_silent_gap"] == 0.5


def test_dense_rows_for_empty_clusters(spark):
    rows = trains(spark, [(0, 1, 1.0), (3, 2, 1.0)])
    found = tr.dense(rows, rows.groupBy("cluster_id").agg(F.count("*").alias("n")), {"n": 0}).orderBy("cluster_id").collect()
    assert [(r["cluster_id"], r["n"]) for r in found] == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_correlogram_matches_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(c), int(t), 1.0) for c, t in zip(rng.integers(0, 2, 200), rng.integers(0, 500, 200), strict=True)]
    a, b = (sorted(t for c, t, _ in rows if c == k) for k in (0, 1))
    want = [0] * 10
    for x in a:
        for y in b:
            if abs(y - x) <= 25:
                want[min(9, (y - x + 25) * 10 // 50)] += 1
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    found = co.cross_correlogram(trains(spark, rows), pairs, 25, 10).orderBy("bin").collect()
    assert [r["n"] for r in found] == want


def test_dip_of_even_and_two_humps():
    assert ds.dip_statistic(np.arange(1, 11)) == 0  # unimodal
    assert ds.dip_statistic(np.ones(9)) == 0
    two = np.concatenate([np.linspace(0, 1, 50), np.linspace(10, 11, 50)])
    assert ds.dip_statistic(two) > 0.2


FILTERS = [
    ("n > 1", {2, 3}),
    ("n > 1 and x < 0.5", {2}),
    ("not n > 1", {1, 4}),
    ("x != 1", {2, 4}),
    ("gone > 1", {1, 2, 3, 4}),
    ("n > 100 and gone > 1", set()),
    ("n > 0 or gone > 1", {1, 2, 3, 4}),
    ("gone > 1 or n > 100", {1, 2, 3, 4}),
    ("label == 'good'", {1}),
    ("label > 3", {1, 2, 3, 4}),
    ("ood", {1}),
    ("n >", set()),
]


@pytest.mark.parametrize(("text", "ids"), FILTERS)
def test_filters(spark, text, ids):
    rows = [(1, 1, 1.0, "good"), (2, 2, 0.25, "mua"), (3, 3, 1.0, "noise"), (4, None, float("nan"), "mua")]
    table = spark.createDataFrame(rows, "cluster_id long, n long, x double, label string")
    found = {r["cluster_id"] for r in filters.visible(table, text).collect()}
    assert found == ids


def test_rule_files():
    text = """
        default = "Unsorted"
        [[rule]]
        metric = "n"
        op = "<"
        value = 40
        label = "noise"
        [[rule]]
        metric = "x"
        op = "|>="
        value = 0.25
        label = "MUA"
        name = "large"
        all = [{ metric = "n", op = ">", value = 7 }, { metric = "x", op = "!=", value = 3.5 }]
    """
    found, default = rules.parse_rules(text, ("n", "x"))
    assert default == "unsorted" and rules.parse_rules("", ()) == ([], None)
    assert found == [rules.Rule("noise", (("n", "<", 40.0),), "r0"), rules.Rule("mua", (("x", "|>=", 0.25), ("n", ">", 7.0), ("x", "!=", 3.5)), "large")]
    for old, new in (("= 40", "= nan"), ("= 40", '= "40"'), ('"<"', '"<>"'), ('"noise"', '"what"'), ("Unsorted", "none"), ('metric = "n", op', 'metric = "m", op')):
        with pytest.raises(ValueError):
            rules.parse_rules(text.replace(old, new), ("n", "x"))


def test_rules_and_texts(spark):
    with pytest.raises(ValueError):
        rules.parse_rules('[[rule]]\nlabel = "good"\nmetric = "nope"\nop = ">"\nvalue = 1', ("n",))
    row = spark.createDataFrame([([1, 2, 3, 7, 9, 10],)], "ids array<long>")
    assert row.select(rules.runs(F.col("ids")).alias("r")).first()["r"] == "1-3,7,9-10"
    assert rules.quantise(0.4999, [0.5]) == "0.4999" and rules.quantise(0.1234, [0.5]) == "0.12" and rules.quantise(math.nan, []) == "-"


def test_edit_log(spark):
    base = trains(spark, [(c, t, 1.0) for t, c in enumerate([2, 5, 3, 2, 7, 5, 2])])
    log = curation.Log()
    log.append("merge", sources=[2, 3], target=5)
    sizes = lambda: {r["cluster_id"]: r["n"] for r in curation.replay(base, log).groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert sizes() == {5: 6, 7: 1}
    log.append("split", target=8, picks=[(5, 0), (5, 5)])
    assert sizes() == {5: 4, 7: 1, 8: 2}
    log.undo()
    assert sizes() == {5: 6, 7: 1}
    log.redo()
    assert sizes() == {5: 4, 7: 1, 8: 2}
    log.checkout(-1)
    assert sizes() == {2: 3, 3: 1, 5: 2, 7: 1}
    assert curation.Log.read(log.table(spark)).applied()[-1]["target"] == 8
    with pytest.raises(ValueError):
        curation.add_spikes(base, trains(spark, [(1, 5, 1.0)]))


def test_planted_merge_and_split(spark):
    rng = np.random.default_rng(3)
    t, times = 0, []
    while len(times) < 1200:
        t += 60 + int(rng.exponential(940))
        times.append(t)
    rows = [(k % 2, x, rng.normal(5, 0.3)) for k, x in enumerate(times)]
    rows += [(2, 300 * k, rng.normal(3 if k % 2 else 8, 0.4)) for k in range(1000)]
    rows += [(3, 1000 * k + 7, rng.normal(6, 0.3)) for k in range(800)]
    df = trains(spark, rows)
    total = max(x for _, x, _ in rows) + 1
    best = suggest.merge_candidates(df, total, 1500, 50, 1, 30, 0.5, 0.15, 5).collect()
    assert (best[0]["a"], best[0]["b"]) == (0, 1) and best[0]["score"] > 0.5
    splits = suggest.split_candidates(suggest.split_scores(df, total, 30000.0, 45, 30), 0.0, 3).collect()
    assert splits[0]["cluster_id"] == 2 and splits[0]["bimodality"] > 0.55
    assert models.two_gaussians(np.array([a for c, _, a in rows if c == 2]))["gain"] > 6


def test_components_are_small():
    assert suggest.components([(0, 1, 0.9), (1, 2, 0.8), (2, 3, 0.7), (3, 4, 0.6), (5, 6, 0.3)]) == [[0, 1, 2, 3]]


def test_scores(spark):
    same = spark.createDataFrame([("a", "x", 5), ("b", "y", 5)], "a string, b string, n long")
    assert scoring.adjusted_rand(same).first()["ari"] == 1.0
    one = spark.createDataFrame([("a", "a")] * 3, "p string, q string")
    assert math.isnan(scoring.agreement(one, "p", "q", ["a", "b"]).first()["kappa"])
    folds = scoring.assign_folds(spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3)], "g string, n long"), "g", "n", 2).collect()
    assert {r["name"]: r["fold"] for r in folds} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_models():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(8, 1, (300, 2))])
    _, labels = models.kmeans(x, 2)
    assert abs(labels[:300].mean() - labels[300:].mean()) == 1 and models.silhouette(x, labels) > 0.7
    two, one = models.diagonal_mixture(x, 2), models.diagonal_mixture(x, 1)
    assert two["bic"] < one["bic"] - 100
    wide = np.concatenate([rng.normal(0, 1, (450, 2)), rng.normal(0, 6, (50, 2))])
    fitted = models.contaminated(wide)
    assert fitted["gain"] > 10 and 0.8 < fitted["weight"] < 0.97
    assert models.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert models.chi2_tail(20.0, 4) == pytest.approx(0.000499399, abs=1e-8)
    near, far = models.isolation(x[:300], x[300:]), models.isolation(x[::2], x[1::2])
    assert near["d_prime"] > 5 > far["d_prime"] and near["nn_hit_rate"] > 0.99 and near["isolation_distance"] > 50
    w, c = models.ridge_fit(x, x @ np.array([[2.0], [-1.0]]) + 3, 1e-9)
    assert np.allclose(w[:, 0], [2, -1], atol=1e-4) and np.allclose(c, 3, atol=1e-3)
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])
    assert len(models.convex_hull(square)) == 4 and models.polygon_area(models.convex_hull(square)) == 1


def test_filter_in_blocks_is_the_whole_filter(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=400)
    trace = spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(v)], "t long, ch long, v double")
    c = signal.highpass(300, 3000)
    whole = signal.run_biquad(v, c)
    found = [r["v"] for r in signal.filtered(trace, c, 100, 60).orderBy("t").collect()]
    assert len(found) == 400 and np.allclose(found, whole, atol=1e-6)
    assert abs(signal.run_biquad(np.ones(500), c)[-1]) < 1e-9


def test_lttb_keeps_ends_and_spike():
    y = np.zeros(100)
    y[40] = 9
    picked = signal.lttb_points(np.arange(100.0), y, 10)
    assert picked[0] == 0 and picked[-1] == 99 and 40 in picked and len(picked) == 10
    assert len(signal.lttb_points(np.arange(5.0), y[:5], 2)) == 5


def test_lags_are_counted_alike_by_pairs_and_ranks(spark, monkeypatch):
    """Sparse and dense trains, ties and repeated spikes, in small bunches: the counts of all pairs of rows, either way."""
    rng = np.random.default_rng(9)
    rows = [(int(i), c, int(t)) for i, (c, t) in enumerate(zip(rng.choice(list("abc"), 400), rng.integers(-50, 900, 400), strict=True))]
    rows += [(i, "a", 300) for i in (7, 7, 900)] + [(i, "d", 300) for i in (901, 902)] + [(950, "d", 5000), (951, None, 5), (952, "a", None)]
    df = spark.createDataFrame(rows, "spike_idx long, cluster_id string, t long").repartition(3)
    full = [r for r in rows if r[1] is not None and r[2] is not None]
    pairs, edges = {("a", "b"), ("b", "d"), ("c", "c")}, [-25, -20, -20, 0, 7, 26]
    plain: dict = {}
    order: dict = {}
    for p, a, t in full:
        for q, b, u in full:
            k = int(np.searchsorted(edges, u - t, "right")) - 1
            if (a, b) in pairs and 0 <= k < 5:
                plain[a, b, k] = plain.get((a, b, k), 0) + 1
            if (u > t or (u == t and (b > a or (b == a and q > p)))) and u - t < 40:
                order[a, b, (u - t) // 10] = order.get((a, b, (u - t) // 10), 0) + 1
    as_dict = lambda found: {(r["a"], r["b"], r["bin"]): r["n"] for r in found.collect()}
    assert as_dict(co.lag_counts(df, edges, pairs)) == plain and as_dict(co.lag_counts(df, [0, 10, 20, 30, 40], None, True)) == order
    t = np.array(sorted(r[2] for r in full))
    by_time = sorted(full, key=lambda r: r[2])
    ids, spike, own = np.array(["abcd".index(r[1]) for r in by_time]), np.array([r[0] for r in by_time]), t // 37 % 3 > 0
    monkeypatch.setattr(co, "HELD", 50)
    for cuts, wanted, ordered in ((edges, rng.random((4, 4)) < 0.6, False), ([0, 10, 20, 30, 40], np.ones((4, 4), bool), True)):
        one, two = ({}, {})
        for into, way in ((one, co.count_pairs), (two, co.count_ranks)):
            for code, n in way(ids, t, own, spike, np.array(cuts), wanted, ordered):
                for c, m in zip(code.tolist(), n.tolist(), strict=True):
                    into[c] = into.get(c, 0) + m
        assert one == two and sum(one.values()) > 500


def test_swept_trains_count_as_pairs(spark, monkeypatch):
    """Bins of one width, with ties and rows that stand for several: a sweep over the places in cells counts what pairs do, also of dense trains."""
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, kinds, width, bins, ordered = int(rng.integers(1, 80)), int(rng.integers(1, 5)), int(rng.integers(1, 9)), int(rng.integers(2, 6)), trial % 3 == 0
        by = sorted(zip(rng.integers(-40, 60, n).tolist(), rng.integers(0, kinds, n).tolist(), strict=True))
        t, ids, own, spike = np.array([x[0] for x in by]), np.array([x[1] for x in by]), np.array([x[0] for x in by]) // 17 % 3 > 0, np.arange(n)
        cuts = np.array([k * width for k in range(bins + 2)] if ordered else [k * width for k in range(-bins, bins)] + [bins * width + 1])
        wanted, weight = np.ones((kinds, kinds), bool) if ordered else rng.random((kinds, kinds)) < 0.7, None if ordered else rng.integers(1, 4, n)
        one, two = (np.zeros(kinds * kinds * (len(cuts) - 1), np.int64) for _ in range(2))
        for into, found in ((one, co.count_pairs(ids, t, own, spike, cuts, wanted, ordered, weight)), (two, co.count_ranks(ids, t, own, spike, cuts, wanted, ordered, weight, True))):
            for code, m in found:
                np.add.at(into, code, m)
        assert (one == two).all(), trial
    rows = [(c, int(t)) for c, t in zip(rng.choice(["x", "y", "z"], 6000), rng.integers(0, 900, 6000), strict=True)]
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(rows)], "spike_idx long, cluster_id string, t long")
    found = {(r["a"], r["b"], r["bin"]): r["n"] for r in co.lag_counts(df, [-300, -200, -100, 0, 100, 200, 301], {("x", "y"), ("z", "x")}).collect()}
    of = {c: np.array([t for k, t in rows if k == c]) for c in "xyz"}
    for x, y in (("x", "y"), ("z", "x")):
        lags = (of[y][None, :] - of[x][:, None]).ravel()
        assert [found[x, y, k] for k in range(6)] == [int(((lags >= lo) & (lags < hi)).sum()) for lo, hi in zip([-300, -200, -100, 0, 100, 200], [-200, -100, 0, 100, 200, 301], strict=True)]


def test_bunches_are_whole_blocks_apart(monkeypatch):
    monkeypatch.setattr(co, "BUNCH", 4)
    rows = pd.DataFrame({"block": [1, 1, 1, 5, 5, 5, 5, 5, 9, 2, 2], "t": range(11)})
    for step in (1, 2, 3, 11):
        got = list(co.bunches((rows.iloc[i : i + step] for i in range(0, 11, step)), 100, 200))
        assert [t - (t // 300) * 300 for g in got for t in g["t"]] == [(t - b * 100) % 300 for b, t in zip(rows["block"], rows["t"], strict=True)]
        blocks = [set(g["block"]) for g in got]
        assert not any(a & b for i, a in enumerate(blocks) for b in blocks[:i])


def test_dense_trains_are_counted_by_ranks(spark):
    """Two trains of 200,000 spikes within one reach, 40 billion pairs: counts by ranks take seconds."""
    df = spark.range(400_000).select(F.col("id").alias("spike_idx"), (F.col("id") % 2).alias("cluster_id"), F.floor(F.col("id") / 2).alias("t"))
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    found = [r["n"] for r in co.cross_correlogram(df, pairs, 200_000, 4).orderBy("bin").collect()]
    n, half = 200_000, 100_000
    far = half * (half - 1) // 2  # lags from -199,999 to -100,001
    assert sum(found) == n * n and found[0] == far and found[3] == far + half and found[1] + found[0] == n * (n - 1) // 2


def test_ccg_z_in_one_pass(spark):
    """Both z of a pair come from one aggregate, and are those of two dips; without shoulders they are NaN."""
    rng = np.random.default_rng(3)
    rows = [(a, k, int(n)) for a in (1, 2) for k, n in enumerate(rng.integers(0, 30, 100))] + [(3, k, 5) for k in range(100)] + [(4, k, 0) for k in range(100)]
    counts = spark.createDataFrame(rows, "a int, bin int, n long")
    found = co.ccg_z(counts, ["a"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    dip, sync = ({r["a"]: r["z"] for r in co.refractory_dip(counts, ["a"], 100, *w).collect()} for w in ((2, 8), (3, 12)))
    by = {r["a"]: (r["dip_z"], r["sync_z"]) for r in found.collect()}
    assert all(by[a] == pytest.approx((-dip[a], max(0, -sync[a]))) for a in (1, 2)) and all(np.isnan(by[a]).all() for a in (3, 4))


def test_greedy_refractory(spark):
    found = spark.createDataFrame([(0, 10, 1.0), (0, 12, 5.0), (0, 14, 2.0), (0, 15, 3.0), (0, 100, 1.0)], "unit long, t long, v double")
    existing = spark.createDataFrame([(0, 101)], "unit long, t long")
    assert sorted(r["t"] for r in signal.refractory(found, existing, 2, 2).collect()) == [12, 15]


def test_greedy_refractory_of_crowded_runs(spark):
    """One run of many peaks is chosen in blocks, as a plain greedy choice over all of it; so is a chain of ever larger peaks."""
    rng = np.random.default_rng(4)
    rows = [(u, int(t), float(v)) for u in (0, 1) for t, v in zip(rng.integers(0, 40_000, 9000), rng.integers(0, 500, 9000), strict=True)]
    rows += [(2, 7 * i, float(i)) for i in range(6000)]
    taken = [(u, int(t)) for u in (0, 2) for t in rng.integers(0, 40_000, 60)]

    def plain(ticks):
        for u in (0, 1, 2):
            busy = np.full(42_100 + 2 * ticks, False)
            for v, t in sorted((-1e9, t) for w, t in taken if w == u) + sorted((-v, t) for w, t, v in rows if w == u):
                if v == -1e9 or not busy[t + ticks]:
                    busy[t : t + 2 * ticks + 1] = True
                    if v != -1e9:
                        yield u, t, -v

    found = spark.createDataFrame(rows, "unit long, t long, v double").repartition(4)
    existing = spark.createDataFrame(taken, "unit long, t long")
    for ticks in (0, 9, 60):
        assert sorted(tuple(r) for r in signal.refractory(found, existing, ticks, ticks).collect()) == sorted(plain(ticks)), ticks


def test_refractory_takes_a_crowded_unit_in_linear_time():
    """A million peaks of one run take seconds, not their squares."""
    rng = np.random.default_rng(5)
    t, start = rng.integers(0, 10_000_000, 1_000_000), time.time()
    state = signal.greedy_choice(t, rng.random(len(t)), 600)
    picked = np.sort(t[state == 1])
    took, at = time.time() - start, np.searchsorted(picked, t)
    near = np.minimum(np.abs(t - picked[np.minimum(at, len(picked) - 1)]), np.abs(t - picked[np.maximum(at - 1, 0)]))
    assert (np.diff(picked) > 600).all() and near.max() <= 600 and took < 60


def test_crowded_groups_are_fitted_whole(spark):
    """Groups of more rows than one task takes give what all their rows give at once."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(2, 0.5, 900), rng.normal(6, 0.8, 500)])
    rng.shuffle(x)
    rows = spark.createDataFrame([(i, i % 2 * 0 + 1, float(v)) for i, v in enumerate(x)] + [(5000 + i, 2, float(i)) for i in range(60)], "i long, g long, v double").repartition(5)
    whole = models.two_gaussians(x)
    by = {r["g"]: r for r in models.mixture_by_group(rows, "g", "i", "v", most=200).collect()}
    assert by[1]["n"] == 1400 and by[2]["n"] == 60
    assert (by[1]["low"], by[1]["high"], by[1]["weight"]) == pytest.approx((whole["means"][0], whole["means"][1], whole["weight"]), abs=0.02)
    assert abs(by[1]["n_minor"] - min(whole["labels"].sum(), (1 - whole["labels"]).sum())) <= 3 and by[1]["gain"] == pytest.approx(whole["gain"], rel=0.01)
    points = np.concatenate([rng.normal(0, 1, (700, 2)), rng.normal(9, 1, (300, 2))])
    rows = spark.createDataFrame([(i, 1, p.tolist()) for i, p in enumerate(points)], "i long, g long, p array<double>").repartition(5)
    one, many = (models.kmeans_by_group(rows, "g", "i", "p", 2, 2, most=m).first() for m in (5000, 150))
    assert (one["n"], one["smallest"]) == (many["n"], many["smallest"]) == (1000, 300)
    assert many["silhouette"] == pytest.approx(one["silhouette"], abs=0.01)


def test_dip_of_unimodal_and_tied_values():
    assert ds.dip_statistic(np.arange(10.0)) == 0 and ds.dip_statistic(np.ones(9)) == 0
    assert ds.dip_statistic(np.array([0.0] * 5 + [1.0] * 5)) == pytest.approx(0.25, abs=0.21)
    rng = np.random.default_rng(1)
    one, two = rng.normal(0, 1, 400), np.concatenate([rng.normal(-4, 1, 200), rng.normal(4, 1, 200)])
    assert ds.dip_statistic(one) < 0.03 < 0.1 < ds.dip_statistic(two) <= 0.25
    tied = np.round(two)
    assert 0.1 < ds.dip_statistic(tied) <= 0.25


def test_mixture_of_tied_values():
    """Many equal values at the median do not stop a fit."""
    x = np.array([1.0] * 60 + [1.1] * 40 + [5.0] * 30 + [5.2] * 30)
    found = models.two_gaussians(x)
    assert found["means"] == pytest.approx([1.04, 5.1], abs=0.01) and found["weight"] == pytest.approx(0.375, abs=0.01)
    assert models.two_gaussians(np.array([2.0] * 99 + [2.0000001])) is None
