"""Correlograms and event-aligned histograms: joins of trains on a range of time.

Times are cut in blocks as long as the reach; a row meets the rows of its block and of the two beside it, by an
equi-join on the block, so no pair is tried that is more than two blocks apart. A crowded stretch of time is
dealt to as many tasks as it has blocks. Correlograms between clusters count lags block by block without a row for each
pair of spikes: where spikes are dense, a spike's lags in a bin are a difference of two ranks among the other cluster's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near(left: DataFrame, right: DataFrame, reach: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows of left (with t) and right (with u) whose blocks of `reach` ticks are equal or adjacent; callers filter exactly."""
    reach = max(1, reach)
    a = left.withColumn("_block", F.floor(F.col("t") / F.lit(reach)))
    b = right.withColumn("_block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("u") / F.lit(reach)) + k)))
    return a.join(b, ["_block", *(on or [])]).drop("_block")


def lag_bin(dt: Column, reach: int, bins: int) -> Column:
    """Bin of a lag within -reach to reach; the last one is closed."""
    return F.least(F.floor((dt + F.lit(reach)) * F.lit(bins) / F.lit(2 * reach)), F.lit(bins - 1)).cast("int")


def dense(counts: DataFrame, ids: DataFrame, bins: int) -> DataFrame:
    keys = ids.columns
    grid = ids.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


#: A block of time is so many reaches long; blocks are counted together up to so many rows; as many pairs or ranks are held at once.
REACHES, BUNCH, HELD = 8, 50_000, 2_000_000
#: Pairs of clusters that tasks are told; of more, they count all that meet.
FEW_PAIRS = 10_000
#: What a row costs that is swept, in pairs.
PER_ROW = 20


def bunches(batches: Iterator[pd.DataFrame], length: int, apart: int) -> Iterator[pd.DataFrame]:
    """Whole blocks of rows sorted by block, BUNCH rows or more at once, with t such that blocks are too far apart to meet."""

    def moved(rows: pd.DataFrame) -> pd.DataFrame:
        nth = rows["block"].ne(rows["block"].shift()).cumsum().to_numpy()
        return rows.assign(t=rows["t"].to_numpy() - rows["block"].to_numpy() * length + nth * (length + apart))

    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if kept and sum(map(len, kept)) >= BUNCH:
            # What this batch has of the last block is still part of the bunch.
            more = int((batch["block"] == kept[-1]["block"].iloc[-1]).to_numpy().argmin()) if (batch["block"] != kept[-1]["block"].iloc[-1]).any() else len(batch)
            kept.append(batch.iloc[:more])
            batch = batch.iloc[more:]
            if not len(batch):
                continue
            yield moved(pd.concat(kept))
            kept = []
        kept.append(batch)
    if kept:
        yield moved(pd.concat(kept))


def count_pairs(ids: np.ndarray, t: np.ndarray, own: np.ndarray, spike: np.ndarray | None, edges: np.ndarray, wanted: np.ndarray, ordered: bool, weight: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, n) of lags from own rows to any, t sorted, by pairs; code is (id * ids + other) * bins + bin. Some HELD pairs at once. weight: how many rows each one is."""
    bins, most, weight = len(edges) - 1, len(wanted), np.ones(len(t), np.int64) if weight is None else weight
    rows = np.flatnonzero(own)
    low, high = np.searchsorted(t, t[rows] + edges[0]), np.searchsorted(t, t[rows] + edges[-1])
    upto = np.concatenate([[0], np.cumsum(high - low)])
    start = 0
    while start < len(rows):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + HELD, "right")) - 1)
        n = (high - low)[start:end]
        i = np.repeat(rows[start:end], n)
        j = np.arange(len(i)) - np.repeat(upto[start:end] - upto[start] - low[start:end], n)
        good = wanted[ids[i], ids[j]]
        if ordered:
            good &= (t[j] > t[i]) | (ids[j] > ids[i]) | ((ids[j] == ids[i]) & (spike[j] > spike[i]))
        i, j = i[good], j[good]
        code, nth = np.unique((ids[i] * most + ids[j]) * bins + np.searchsorted(edges, t[j] - t[i], "right") - 1, return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, nth, weight[i] * weight[j])
        yield code, total
        start = end


def even(edges: np.ndarray) -> bool:
    """Whether edges but the first and last are equally far apart, as `swept` needs."""
    return len(edges) > 3 and not np.ptp(np.diff(edges[1:-1]))


def cells(t: np.ndarray, edges: np.ndarray) -> int:
    """How many cells as wide as a bin `swept` holds for each cluster."""
    width = int(edges[2] - edges[1])
    return int(t.max() - t.min()) // width + 2 * (int(max(-edges[0], edges[-1])) // width + 2) + len(edges)


def swept(ids: np.ndarray, t: np.ndarray, own: np.ndarray, edges: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of the ranks of own rows plus each inner edge, of equal steps, among each cluster's rows: [cluster, inner edge, other].

    Time is cut in cells as wide as a bin. All ranks of a row at the inner edges are those of its place in successive cells, so
    rows are taken by place in their cells: then a row's ranks lie side by side in a table of what came before, cell by cell.
    """
    most, inner, width = len(wanted), len(edges) - 2, int(edges[2] - edges[1])
    reach = (int(max(-edges[0], edges[-1])) // width + 2) * width
    mine, theirs = np.flatnonzero(own & wanted.any(axis=1)[ids]), np.flatnonzero(wanted.any(axis=0)[ids])
    cell, place = np.divmod(t[theirs] - t.min() + reach, width)
    cell_of, place_of = np.divmod(t[mine] - t.min() + reach + edges[1], width)
    table = np.zeros((cells(t, edges) + 1, most), np.int64)
    np.add.at(table, (cell + 1, ids[theirs]), weight[theirs])
    flat, sums, span = np.cumsum(table, axis=0).reshape(-1), np.zeros((most, inner * most), np.int64), inner * most
    # At one place rows are asked before any is entered, as ranks count what is less.
    order = np.lexsort((np.repeat([0, 1], [len(mine), len(theirs)]), np.concatenate([place_of, place])))
    at = np.concatenate([cell_of * most, cell * most + ids[theirs]])[order].tolist()
    row = np.concatenate([ids[mine], np.full(len(theirs), -1)])[order].tolist()
    each, of = np.concatenate([weight[mine], weight[theirs]])[order].tolist(), list(sums)
    for x, a, w in zip(at, row, each, strict=True):
        if a < 0:
            flat[x] += w
        elif w == 1:
            s = of[a]
            np.add(s, flat[x : x + span], s)
        else:
            of[a] += w * flat[x : x + span]
    return sums.reshape(most, inner, most)


def count_ranks(ids: np.ndarray, t: np.ndarray, own: np.ndarray, spike: np.ndarray | None, edges: np.ndarray, wanted: np.ndarray, ordered: bool, weight: np.ndarray | None = None, sweep: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What count_pairs counts, by the ranks of each own row plus each edge among the other cluster's rows; sweep: those of inner edges by `swept`."""
    bins, most, weight = len(edges) - 1, len(wanted), np.ones(len(t), np.int64) if weight is None else weight
    each = [(t[ids == c], np.concatenate([[0], np.cumsum(weight[ids == c])]), t[own & (ids == c)], weight[own & (ids == c)]) for c in range(most)]
    inner = swept(ids, t, own, edges, wanted, weight) if sweep else None
    searched = [0, bins] if sweep else list(range(bins + 1))
    for a, b in zip(*np.nonzero(wanted), strict=True):
        (mine, times), (theirs, upto), cuts = each[a][2:], each[b][:2], edges.copy()
        if ordered and a >= b:
            cuts[0] = max(cuts[0], 1)  # rows of one time count once, in order of cluster
        ranks, step = np.zeros(bins + 1, np.int64), max(1, HELD // (bins + 1))
        if inner is not None:
            ranks[1:-1] = inner[a, :, b]
        for k in range(0, len(mine), step):
            ranks[searched] += upto[np.searchsorted(theirs, cuts[searched, None] + mine[None, k : k + step])] @ times[k : k + step]
        n = np.diff(ranks)
        if ordered and a == b:
            inside = own & (ids == a)
            twice = lambda x: int((lambda m: m * (m - 1) // 2)(np.unique(x, axis=0, return_counts=True)[1]).sum())
            n[0] += twice(mine) - twice(np.stack([mine, spike[inside]], axis=1))
        found = np.flatnonzero(n)
        yield (a * most + b) * bins + found, n[found]


def lag_counts(trains: DataFrame, edges: list[int], wanted: set[tuple] | None, ordered: bool = False) -> DataFrame:
    """a, b, bin, n: lags of b after a in [edge, next edge) of whole ticks, of the pairs wanted (of all if None); only bins with a count.

    The first edge is 0 at most, the last one above 0. ordered: lags of 0 count once, in order of cluster and spike, and no spike
    meets itself. In each bunch of blocks that way is taken which does less: a step for each pair of spikes in reach, or
    for each spike, other cluster and edge, or, where bins are of one width, a sum of short arrays for each spike.
    """
    cuts = np.array(edges, np.int64)
    length = REACHES * int(max(-cuts[0], cuts[-1]))
    of = lambda t: F.floor(t / F.lit(length)).cast("long")
    rows = trains.where("t is not null and cluster_id is not null").select("cluster_id", F.col("t").cast("long").alias("t"), *([F.col("spike_idx").cast("long").alias("spike")] if ordered else []))
    kind, names = dict(trains.dtypes)["cluster_id"], None
    if wanted is not None:
        # Few clusters go by number, as tasks are slow to read strings.
        names = sorted({x for pair in wanted for x in pair})
        numbers = trains.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], f"cluster_id {kind}, nth int")
        rows = rows.join(F.broadcast(numbers), "cluster_id").drop("cluster_id").withColumnRenamed("nth", "cluster_id")
    rows = rows.withColumn("block", F.explode(F.sequence(of(F.col("t") - int(cuts[-1] - 1)), of(F.col("t") - int(cuts[0])))))
    parts = int(trains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "block").sortWithinPartitions("block")

    def of_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in bunches((b.assign(own=b["t"] // length == b["block"]) for b in batches), length, 2 * length):
            ids, found = pd.factorize(rows["cluster_id"], sort=True)
            named = found if names is None else np.array(names, object)[found]
            t, own = rows["t"].to_numpy(), rows["own"].to_numpy()
            if ordered:
                by = np.argsort(t, kind="stable")
                ids, t, own, spike, weight = ids[by], t[by], own[by], rows["spike"].to_numpy()[by], None
            else:
                # Rows of one cluster and time are one of their number.
                by = np.lexsort((ids, t))
                first = np.flatnonzero(np.concatenate([[True], (np.diff(t[by]) != 0) | (np.diff(ids[by]) != 0)]))
                ids, t, own, spike, weight = ids[by][first], t[by][first], own[by][first], None, np.diff(np.append(first, len(by)))
            ask = np.ones((len(named), len(named)), bool)
            if wanted is not None:
                ask = np.array([[(a, b) in wanted for b in named] for a in named])
            pairs = (np.searchsorted(t, t[own] + cuts[-1]) - np.searchsorted(t, t[own] + cuts[0])).sum()
            # A rank costs about one pair, and a pair of clusters some thousand; a row that is swept PER_ROW and a fortieth of a pair for each sum.
            ranks = len(cuts) * (np.bincount(ids[own], minlength=len(named)) * ask.sum(axis=1)).sum() + 1000 * ask.sum()
            ways = {"pairs": pairs, "ranks": ranks}
            if even(cuts) and (held := cells(t, cuts) * len(named)) <= HELD:
                ways["swept"] = len(t) * PER_ROW + own.sum() * len(cuts) * len(named) // 40 + held + 1000 * ask.sum()
            way = min(ways, key=ways.get)
            args = (ids, t, own, spike, cuts, ask, ordered, weight)
            for code, n in count_pairs(*args) if way == "pairs" else count_ranks(*args, way == "swept"):
                pair, k = np.divmod(code, len(cuts) - 1)
                yield pd.DataFrame({"a": named[pair // len(named)], "b": named[pair % len(named)], "bin": k, "n": n})

    found = dealt.mapInPandas(of_part, f"a {kind}, b {kind}, bin int, n long")
    return found.groupBy("a", "b", "bin").agg(F.sum("n").alias("n"))


def cross_correlogram(trains: DataFrame, pairs: DataFrame, reach: int, bins: int) -> DataFrame:
    """a, b, bin, n for pairs (a, b) of clusters: lags of b after a of at most reach, empty bins too."""
    keys = pairs.select("a", "b").distinct()
    some = keys.limit(FEW_PAIRS + 1).collect()
    wanted = {(r["a"], r["b"]) for r in some} if len(some) <= FEW_PAIRS else None
    edges = [-(-k * 2 * reach // bins) - reach for k in range(bins)] + [reach + 1]
    return dense(lag_counts(trains, edges, wanted), keys, bins)


def auto_correlogram(trains: DataFrame, reach: int, bins: int) -> DataFrame:
    """cluster_id, bin, n: lags between different spikes of a cluster; spikes at one time count."""
    a = trains.select("cluster_id", "t", "spike_idx")
    b = trains.select("cluster_id", F.col("t").alias("u"), F.col("spike_idx").alias("other"))
    dt = F.col("u") - F.col("t")
    counts = near(a, b, reach, ["cluster_id"]).where((F.abs(dt) <= reach) & (F.col("spike_idx") != F.col("other"))).groupBy("cluster_id", lag_bin(dt, reach, bins).alias("bin")).agg(F.count("*").alias("n"))
    return dense(counts, trains.select("cluster_id").distinct(), bins)


def correlograms(trains: DataFrame, bin_ticks: int, half: int) -> DataFrame:
    """All pairs: i, j, k (lag bins from -half to half), n; only bins with a count.

    Forward lags are counted once, rows of one time in order of cluster; bins behind mirror those ahead, and
    lag 0 of a pair is the larger of its two orders.
    """
    counts = lag_counts(trains, [k * bin_ticks for k in range(half + 2)], None, ordered=True)
    ahead = counts.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("bin").alias("k"), "n")
    zero = ahead.where("k = 0")
    zero = zero.unionByName(zero.select(F.col("j").alias("i"), F.col("i").alias("j"), "k", "n")).groupBy("i", "j", "k").agg(F.max("n").alias("n"))
    later = ahead.where("k > 0")
    return zero.unionByName(later).unionByName(later.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("k")).alias("k"), "n"))


def baseline(n_a: Column, n_b: Column, bin_s: float, duration_s: float) -> Column:
    """Count a bin would have if the trains had nothing to do with each other."""
    return n_a * n_b * F.lit(bin_s / (duration_s if duration_s > 0 else 1.0))


def refractory_dip(counts: DataFrame, keys: list[str], bins: int, centre: int, shoulder: int) -> DataFrame:
    """keys, z, score, shoulder_mean, shoulder_std of dense correlograms (bin, n): how far the centre lies below its shoulders.

    Centre: `centre` bins on each side of lag 0; shoulders: the next `shoulder` bins outward of it on each side. Their
    population standard deviation is at least 1e-6. score is 1 - exp(-max(z, 0) / 2), 0 without shoulders.
    """
    return dips(counts, keys, bins, {"": (centre, shoulder)}).select(*keys, "z", (1 - F.exp(-F.greatest(F.col("z"), F.lit(0.0)) / 2)).alias("score"), F.coalesce("m", F.lit(0.0)).alias("shoulder_mean"), F.coalesce("d", F.lit(0.0)).alias("shoulder_std"))


def dips(counts: DataFrame, keys: list[str], bins: int, widths: dict[str, tuple[int, int]]) -> DataFrame:
    """keys, and z, m, d (shoulders' mean and deviation) of each name's centre and shoulder, in one pass over the counts."""
    half, n = bins // 2, F.col("n").cast("double")
    sums = []
    for name, (centre, shoulder) in widths.items():
        r = min(centre, half)
        s = min(shoulder, half - r)
        inner = (F.col("bin") >= half - r) & (F.col("bin") < half + r)
        outer = ~inner & (F.col("bin") >= half - r - s) & (F.col("bin") < half + r + s)
        sums += [F.avg(F.when(inner, n)).alias(f"c{name}"), F.avg(F.when(outer, n)).alias(f"m{name}"), F.greatest(F.stddev_pop(F.when(outer, n)), F.lit(1e-6)).alias(f"d{name}")]
    return counts.groupBy(*keys).agg(*sums).withColumns({f"z{x}": F.coalesce((F.col(f"m{x}") - F.col(f"c{x}")) / F.col(f"d{x}"), F.lit(0.0)) for x in widths})


def ccg_z(counts: DataFrame, keys: list[str], bins: int = 100, least: float = 2.0) -> DataFrame:
    """keys, dip_z, sync_z: the negative of the dip's z over 2 and 8 bins, and its excess over 3 and 12; NaN where shoulders hold under `least` a bin or do not vary."""
    nan = F.lit(float("nan"))
    z = lambda x: F.when((F.coalesce(f"m{x}", F.lit(0.0)) < least) | (F.coalesce(f"d{x}", F.lit(0.0)) <= 1e-5), nan).otherwise(F.least(F.lit(99.0), F.greatest(F.lit(-99.0), -F.col(f"z{x}"))))
    found = dips(counts, keys, bins, {"": (2, 8), "2": (3, 12)}).select(*keys, z("").alias("dip_z"), z("2").alias("sync_z"))
    return found.select(*keys, "dip_z", F.when(F.isnan("sync_z"), nan).otherwise(F.greatest("sync_z", F.lit(0.0))).alias("sync_z"))


def burst_index(acg: DataFrame, reach: int, bins: int, near_: tuple[int, int], far: tuple[int, int]) -> DataFrame:
    """cluster_id, burst_index: mean count at short positive lags over the mean at long ones; NaN where that is 0."""
    width = 2 * reach / bins
    lag = (F.col("bin") - bins // 2) * F.lit(width)
    mean = lambda lo, hi: F.avg(F.when((F.col("bin") >= bins // 2) & (lag >= lo) & (lag < hi), F.col("n").cast("double")))
    sums = acg.groupBy("cluster_id").agg(mean(*near_).alias("x"), mean(*far).alias("y"))
    return sums.select("cluster_id", F.when(F.col("y") > 0, F.col("x") / F.col("y")).otherwise(F.lit(float("nan"))).alias("burst_index"))


def log_bins(acg: DataFrame, reach: int, bins: int, edges: list[float]) -> DataFrame:
    """cluster_id, band, rate: the positive half in bands between the edges (ticks), shared out by overlap, as counts a tick."""
    width = 2 * reach / bins
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])).alias("e")
    rows = acg.where(F.col("bin") >= bins // 2).select("cluster_id", "n", ((F.col("bin") - bins // 2) * F.lit(width)).alias("x"), bands)
    overlap = F.greatest(F.lit(0.0), F.least(F.col("x") + width, F.col("e.hi")) - F.greatest("x", F.col("e.lo"))) / F.lit(width)
    return rows.groupBy("cluster_id", F.col("e.band").alias("band")).agg((F.sum(F.col("n") * overlap) / F.first(F.col("e.hi") - F.col("e.lo"))).alias("rate"))


#: Breakpoints of the normal distribution into 3 to 7 letters, to two digits (fixed values).
SAX_BREAKS = {
    3: (-0.43, 0.43),
    4: (-0.67, 0.0, 0.67),
    5: (-0.84, -0.25, 0.25, 0.84),
    6: (-0.97, -0.43, 0.0, 0.43, 0.97),
    7: (-1.07, -0.57, -0.18, 0.18, 0.57, 1.07),
}


def sax(series: DataFrame, key: str, index: str, value: str, length: int, segments: int, letters: int = 4) -> DataFrame:
    """key, word: z-normalised (population), averaged over equal segments, each a letter; constant series have the middle letter."""
    cuts = SAX_BREAKS[min(7, max(3, letters))]
    stats = series.groupBy(key).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("d"))
    bounds = [(k * length // segments, max((k + 1) * length // segments, k * length // segments + 1)) for k in range(segments)]
    means = series.groupBy(key).agg(F.array(*[F.avg(F.when((F.col(index) >= a) & (F.col(index) < b), F.col(value))) for a, b in bounds]).alias("a")).join(stats, key)
    letter = lambda z: F.substring(F.lit("abcdefg"), 1 + sum((F.when(z > c, 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(1))
    middle = "abcdefg"[len(cuts) // 2]
    word = F.array_join(F.transform("a", lambda x: F.when(F.col("d") > 1e-9, letter((x - F.col("m")) / F.col("d"))).otherwise(middle)), "")
    return means.select(key, word.alias("word"))


def psth(events: DataFrame, trains: DataFrame, before: int, after: int) -> DataFrame:
    """event_id, cluster_id, dt of spikes within [e - before, e + after) of an event (event_id, t); windows are cut at 0."""
    a = events.select("event_id", "t")
    b = trains.select("cluster_id", F.col("t").alias("u"))
    dt = F.col("u") - F.col("t")
    low = F.greatest(F.col("t") - F.lit(before), F.lit(0))
    return near(a, b, max(before, after)).where((F.col("u") >= low) & (F.col("u") < F.col("t") + F.lit(after))).select("event_id", "cluster_id", dt.alias("dt"))


def psth_histogram(raster: DataFrame, before: int, after: int, bins: int) -> DataFrame:
    """bin, n over all events and clusters."""
    width = (before + after) / bins
    counts = raster.groupBy(F.least(F.floor((F.col("dt") + before) / F.lit(width)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = raster.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
