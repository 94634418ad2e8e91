"""Sampled signals as rows (t, ch, v): median removal, filters, peaks, snippets, downsampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subtract_median(trace: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """trace less the median of each group (a time step, or one and a shank; null is a group of its own)."""
    medians = trace.groupBy(*by).agg(F.percentile(value, 0.5).alias("_m"))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    joined = trace.alias("x").join(medians.alias("y"), on)
    return joined.select(*[F.col(f"x.{c}") if c != value else (F.col(f"x.{c}") - F.col("y._m")).alias(c) for c in trace.columns])


def highpass(cutoff: float, rate: float) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of a second-order Butterworth high-pass (quality 1 / sqrt 2), by the bilinear transform."""
    w = 2 * math.pi * cutoff / rate
    alpha, c = math.sin(w) / math.sqrt(2), math.cos(w)
    a0 = 1 + alpha
    return (1 + c) / 2 / a0, -(1 + c) / a0, (1 + c) / 2 / a0, -2 * c / a0, (1 - alpha) / a0


def run_biquad(x: np.ndarray, coefficients: tuple) -> np.ndarray:
    b0, b1, b2, a1, a2 = coefficients
    out = np.empty(len(x))
    x1 = x2 = y1 = y2 = 0.0
    for i, v in enumerate(x.tolist()):
        y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        x2, x1, y2, y1 = x1, v, y1, y
        out[i] = y
    return out


def filtered(trace: DataFrame, coefficients: tuple, block: int, warm_up: int) -> DataFrame:
    """Each channel through the recursion in order of t, in blocks of time; a block starts `warm_up` ticks early, by when what came before has died away."""
    starts = F.array(F.floor(F.col("t") / F.lit(block)), F.when(F.col("t") % block >= block - warm_up, F.floor(F.col("t") / F.lit(block)) + 1))
    rows = trace.withColumn("block", F.explode(F.array_compact(starts)))

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        group["v"] = run_biquad(group["v"].to_numpy(float), coefficients)
        return group[group["t"] >= group["block"] * block][["t", "ch", "v"]]

    kinds = dict(trace.dtypes)
    return rows.select("t", "ch", F.col("v").cast("double"), "block").groupBy("ch", "block").applyInPandas(of, f"t {kinds['t']}, ch {kinds['ch']}, v double")


def peaks(scores: DataFrame, half: int, low: float, high: float, by: list[str]) -> DataFrame:
    """Rows (t, v) that are larger than the `half` rows before, no smaller than the `half` after, and within low to high."""
    w = Window.partitionBy(*by).orderBy("t")
    before, after = F.max("v").over(w.rowsBetween(-half, -1)), F.max("v").over(w.rowsBetween(1, half))
    rows = scores.withColumns({"_b": before, "_a": after})
    return rows.where((F.col("_b").isNull() | (F.col("v") > F.col("_b"))) & (F.col("_a").isNull() | (F.col("v") >= F.col("_a"))) & (F.col("v") >= low) & (F.col("v") <= high)).drop("_b", "_a")


def margin(found: DataFrame, others: DataFrame, reach: int, least: float) -> DataFrame:
    """Peaks (t, v) that beat every other unit's peak (u, w) within reach by at least `least`."""
    from trainloom.operators.correlograms import near

    met = near(found.select("t", "v"), others.select("u", "w"), reach).where(F.abs(F.col("u") - F.col("t")) <= reach).groupBy("t", "v").agg(F.max("w").alias("best"))
    return found.join(met, ["t", "v"], "left").where(F.col("best").isNull() | (F.col("v") - F.col("best") >= least)).drop("best")


#: A block of the greedy choice is as many refractory times long.
CHOICE_BLOCK = 256


def greedy_choice(t: np.ndarray, v: np.ndarray, ticks: int, low: int | None = None, high: int | None = None) -> np.ndarray:
    """1 of each peak taken by falling v (the earlier on ties), none within `ticks` of one taken; 0 of the others.

    Where only the peaks from low up to high are known, 2 of those that hang on peaks beyond. A cell of ticks + 1 holds one
    taken peak at most, and open ones of a cell count by the first and the last, so a peak looks at three cells only.
    """
    out = np.zeros(len(t), np.int8)
    taken: dict[int, int] = {}
    open_: dict[int, tuple[int, int]] = {}
    times, cells = t.tolist(), (t // (ticks + 1)).tolist()
    for i in np.lexsort((t, -v)).tolist():
        x, c = times[i], cells[i]
        if c in taken or x - taken.get(c - 1, x - ticks - 1) <= ticks or taken.get(c + 1, x + ticks + 1) - x <= ticks:
            continue
        beside = c in open_ or (c - 1 in open_ and x - open_[c - 1][1] <= ticks) or (c + 1 in open_ and open_[c + 1][0] - x <= ticks)
        if beside or (low is not None and x - low < ticks) or (high is not None and high - x <= ticks):
            first, last = open_.get(c, (x, x))
            open_[c] = (min(first, x), max(last, x))
            out[i] = 2
        else:
            taken[c] = x
            out[i] = 1
    return out


def refractory(found: DataFrame, existing: DataFrame, ticks: int, gap: int) -> DataFrame:
    """Peaks (unit, t, v) taken by falling v, none within `ticks` of one taken or of an existing (unit, t); peaks without a time are none.

    The choice is greedy: a peak hangs on larger ones in reach, those on larger ones still. Blocks of time choose alone and leave
    open what hangs on peaks beyond their ends; that is chosen in blocks that begin between those, and what is open
    even then (a chain of ever larger peaks through a whole block) as runs, which end where none follows within the gap. Each
    step is exact: a peak decided has no open peak in reach that is larger, and an open one has none taken in reach.
    """
    kind, length = dict(found.dtypes)["unit"], CHOICE_BLOCK * max(ticks, 1)
    block = F.floor(F.col("t") / F.lit(max(ticks, 1)))
    # Of existing peaks, the first and the last of each block as long as the reach decide.
    ends = existing.where("t is not null").groupBy("unit", block.alias("_b")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    ends = ends.select("unit", F.explode(F.array(*[F.struct((F.col("_b") + k).alias("_b"), F.col("lo").alias("lo"), F.col("hi").alias("hi")) for k in (-1, 0, 1)])).alias("e"))
    ends = ends.groupBy("unit", F.col("e._b").alias("_b")).agg(F.sort_array(F.flatten(F.collect_list(F.array("e.lo", "e.hi")))).alias("_ends"))
    free = found.where("t is not null").withColumn("_b", block).join(ends, ["unit", "_b"], "left")
    free = free.where(F.col("_ends").isNull() | ~F.exists("_ends", lambda u: F.abs(F.col("t") - u) <= ticks)).select("unit", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))

    def chosen(rows: DataFrame, shift: int) -> DataFrame:
        """Rows with state 1 (taken) or 2 (open); those taken before stay."""

        def of(group: pd.DataFrame) -> pd.DataFrame:
            low = int(group["_block"].iloc[0]) * length - shift
            state, ask = group["state"].to_numpy(np.int8, copy=True), group["state"].to_numpy() == 2
            state[ask] = greedy_choice(group["t"].to_numpy()[ask], group["v"].to_numpy()[ask], ticks, low, low + length)
            return group.assign(state=state)[state > 0][["unit", "t", "v", "state"]]

        return rows.withColumn("_block", F.floor((F.col("t") + shift) / F.lit(length))).groupBy("unit", "_block").applyInPandas(of, f"unit {kind}, t long, v double, state byte")

    def last(group: pd.DataFrame) -> pd.DataFrame:
        return group[greedy_choice(group["t"].to_numpy(), group["v"].to_numpy(), ticks) == 1][["unit", "t", "v"]]

    # The second choice reads the first one's taken peaks too, so that the plan has one exchange after it and it runs once.
    both = chosen(chosen(free.withColumn("state", F.lit(2).cast("byte")), 0), length // 2)
    w = Window.partitionBy("unit").orderBy("t")
    far = F.coalesce(F.col("t") - F.lag("t").over(w) > max(gap, ticks), F.lit(True))
    rest = both.where("state = 2").withColumn("_new", F.when(far, 1).otherwise(0)).withColumn("run", F.sum("_new").over(w)).select("unit", "t", "v", "run")
    return both.where("state = 1").drop("state").unionByName(rest.groupBy("unit", "run").applyInPandas(last, f"unit {kind}, t long, v double"))


def snippets(trace: DataFrame, spikes: DataFrame, before: int, after: int, length: int) -> DataFrame:
    """spike_idx, pos, ch, v: samples from before to after each spike whose window lies in the recording."""
    inside = spikes.where((F.col("t") >= before) & (F.col("t") + after < length))
    wanted = inside.select("spike_idx", F.posexplode(F.sequence(F.col("t") - before, F.col("t") + after)).alias("pos", "t"))
    return wanted.join(trace, "t").select("spike_idx", "pos", "ch", "v")


def mean_snippet(found: DataFrame) -> DataFrame:
    return found.groupBy("ch", "pos").agg(F.avg("v").alias("v"))


def template_snr(mean: DataFrame, noise: float) -> DataFrame:
    """ch, snr: peak to peak of the mean over the noise."""
    return mean.groupBy("ch").agg(((F.max("v") - F.min("v")) / F.lit(noise)).alias("snr"))


def pixel_columns(trace: DataFrame, start: int, length: int, width: int) -> DataFrame:
    """ch, col, v: the value of largest size in each of `width` columns of a window, the first on ties."""
    inside = trace.where((F.col("t") >= start) & (F.col("t") < start + length))
    col = F.floor((F.col("t") - start) * width / F.lit(length)).cast("int")
    return inside.groupBy("ch", col.alias("col")).agg(F.max_by("v", F.struct(F.abs("v").alias("size"), (-F.col("t")).alias("early"))).alias("v"))


def lttb_points(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """Indices of `count` points by largest triangles: the ends, and from each equal bucket between the point that makes the largest triangle with the one taken before and the mean of the next bucket."""
    n = len(x)
    if count < 3 or count >= n:
        return np.arange(n)
    edges = np.floor(np.arange(count - 1) * (n - 2) / (count - 2)).astype(int) + 1
    taken = [0]
    for k in range(count - 2):
        a, b = edges[k], edges[k + 1]
        c = edges[k + 2] if k + 2 < len(edges) else n
        mx, my = x[b:c].mean() if b < c else x[-1], y[b:c].mean() if b < c else y[-1]
        p = taken[-1]
        area = np.abs((x[p] - mx) * (y[a:b] - y[p]) - (x[p] - x[a:b]) * (my - y[p]))
        taken.append(a + int(np.argmax(area)))
    return np.array([*taken, n - 1])


def lttb(series: DataFrame, by: str, count: int) -> DataFrame:
    """by, t, v: at most `count` points of each series (t, v) that keep its shape; a series is dealt with in one task."""
    kinds = dict(series.dtypes)

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        return group.iloc[lttb_points(group["t"].to_numpy(float), group["v"].to_numpy(float), count)][[by, "t", "v"]]

    return series.select(by, "t", "v").groupBy(by).applyInPandas(of, f"{by} {kinds[by]}, t {kinds['t']}, v {kinds['v']}")


def time_chunks(total: int, budget: int, spikes: int, most: int, reach: int) -> list[tuple[int, int]]:
    """At most `most` evenly spread chunks [a, b) that together hold some `budget` of the spikes; all of it where they fit."""
    if spikes <= budget or total <= 0:
        return [(0, total)]
    length = max(2 * reach, int(total * budget / spikes / most))
    count = max(1, min(most, total // length))
    step = total / count
    return [(int(i * step), int(i * step) + length) for i in range(count)]


def in_chunks(spikes: DataFrame, chunks: list[tuple[int, int]]) -> DataFrame:
    """Spikes within any chunk; chunks are few and part of the plan."""
    return spikes.where(F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in chunks]), lambda c: (F.col("t") >= c["a"]) & (F.col("t") < c["b"])))


def thinned(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """Exactly `most` rows (or all), by the least hash of key and seed."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(most)


def spread(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """At most `most` evenly spread rows of each group."""
    w = Window.partitionBy(*by)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumns({"_n": n, "_k": k}).where((F.col("_n") <= most) | (F.floor(F.col("_k") * most / F.col("_n")) != F.floor((F.col("_k") - 1) * most / F.col("_n")))).drop("_n", "_k")


def in_polygon(x, y, polygon: list[tuple[float, float]]):
    """Even-odd containment of points in a polygon, as a column."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            crosses = (F.lit(y1) > y) != (F.lit(y2) > y)
            inside = F.when(crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), ~inside).otherwise(inside)
    return inside
