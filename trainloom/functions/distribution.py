"""Shape measures of values by group: moments, bimodality, quantiles, cutoffs, two-sample tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample std, population skewness g1 and excess kurtosis g2, SAS bimodality coefficient of each group.

    Skewness is 0 under 3 values, kurtosis under 4, both for constant values; the coefficient takes the
    bias-corrected forms and is 0 under 4 values.
    """
    v = F.col(value)
    out = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"))
    n = F.col("n").cast("double")
    varies = F.col("std") > 0
    g1 = F.when((n >= 3) & varies, F.col("_g1")).otherwise(0.0)
    g2 = F.when((n >= 4) & varies, F.col("_g2")).otherwise(0.0)
    big1 = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    big2 = ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
    bc = F.when((n >= 4) & varies, (big1 * big1 + 1) / (big2 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))).otherwise(0.0)
    return out.select(*by, "n", "mean", "std", g1.alias("skewness"), g2.alias("kurtosis"), bc.alias("bimodality"))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """Linear-interpolation percentiles q0, q1, ... of each group."""
    return df.groupBy(*by).agg(*[F.percentile(value, p).alias(f"q{i}") for i, p in enumerate(at)])


def robust(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """median and 1.4826 * median absolute deviation (at least 1e-6) of each group."""
    centre = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"))
    off = df.join(centre, by).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    return off.groupBy(*by).agg(F.first("median").alias("median"), F.greatest(F.lit(1e-6), 1.4826 * F.percentile("_off", 0.5)).alias("scale"))


def fraction_below(df: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when(F.col(value) < limit, 1.0).otherwise(0.0)).alias("fraction_below"))


def ks_distance(df: DataFrame, group: str, value: str, pairs: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, ks of pairs (a, b) of groups: the largest gap of their cumulative shares, tied values stepping together.

    Values are pre-counted, so equal ones are one row; each pair needs the distinct values of two groups.
    """
    counts = df.groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    sizes = df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    side = lambda name, sign: pairs.join(counts, F.col(name) == F.col("g")).select("a", "b", "v", F.lit(sign).alias("side"), "k")
    steps = side("a", 0).unionByName(side("b", 1)).groupBy("a", "b", "v").agg(F.sum(F.when(F.col("side") == 0, F.col("k")).otherwise(0)).alias("ka"), F.sum(F.when(F.col("side") == 1, F.col("k")).otherwise(0)).alias("kb"))
    steps = steps.join(sizes.select(F.col("g").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("g").alias("b"), F.col("n").alias("n_b")), "b")
    upto = Window.partitionBy("a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("ka").over(upto) / F.col("n_a") - F.sum("kb").over(upto) / F.col("n_b"))
    return steps.withColumn("gap", gap).groupBy("a", "b", "n_a", "n_b").agg(F.max("gap").alias("ks"))


def ks_pvalue(ks: Column, n_a: Column, n_b: Column) -> Column:
    """Smirnov's series with Stephens' correction, 100 terms."""
    n = n_a * n_b / (n_a + n_b)
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * ks
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(ks <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def amplitude_cutoff(df: DataFrame, by: list[str], value: str, bins: int = 30) -> DataFrame:
    """Share of spikes that a detection threshold seems to have cut off, at most 0.5.

    A histogram from the least to the largest value is smoothed over three bins. What lies further above the mode
    than the first bin lies below it has no mirror image: that share of the smoothed counts is taken as
    missing. The mode is the last of equal ones; groups of under 8 or of equal values have 0.
    """
    v = F.col(value)
    ends = df.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n"))
    binned = df.join(ends.where("n >= 8 and hi - lo >= 1e-9"), by).withColumn("bin", F.least(F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    each = binned.groupBy(*by).agg(F.array(*[F.sum(F.when(F.col("bin") == i, 1.0).otherwise(0.0)) for i in range(bins)]).alias("h"))
    beside = lambda i: F.when((i == 0) | (i == bins - 1), 2.0).otherwise(3.0)
    smooth = F.transform("h", lambda x, i: (F.coalesce(F.get("h", i - 1), F.lit(0.0)) + x + F.coalesce(F.get("h", i + 1), F.lit(0.0))) / beside(i))
    mode = F.array_max(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]
    out = each.withColumn("g", smooth).withColumn("mode", mode)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    beyond = add(F.transform("g", lambda x, i: F.when(i > 2 * F.col("mode"), x).otherwise(0.0)))
    cut = out.select(*by, F.least(F.lit(0.5), beyond / add(F.col("g"))).alias("amplitude_cutoff"))
    return ends.select(*by).join(cut, by, "left").fillna({"amplitude_cutoff": 0.0})


def dip_statistic(values: np.ndarray) -> float:
    """Hartigan's dip: the least distance of the empirical distribution to any unimodal one.

    Between the greatest convex minorant up to the modal interval and the least concave majorant beyond it, the
    interval shrinks until the gap inside is no larger than the dip already found outside. Unimodal data have 0.
    """
    x = np.sort(np.asarray(values, dtype=float))
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 0.0
    low, high, dip = 0, n - 1, 0.0
    while True:
        minorant, majorant = hull(x, low, high, lower=True), hull(x, low, high, lower=False)
        if len(minorant) < 2 or len(majorant) < 2:
            break
        # The largest gap between the two hulls, at a touching point of either; the pair of it bounds the modal interval.
        gap, left, right = -1.0, low, high
        for i in minorant:
            k = np.searchsorted(majorant, i, side="right") - 1
            a, b = majorant[k], majorant[min(k + 1, len(majorant) - 1)]
            top = a + 1 if a == b else (a + 1) + (x[i] - x[a]) * (b - a) / (x[b] - x[a]) if x[b] > x[a] else b + 1
            if top - i > gap:
                gap, left, right = top - i, i, b if b > i else i
        for j in majorant:
            k = np.searchsorted(minorant, j, side="left")
            b = minorant[min(k, len(minorant) - 1)]
            a = minorant[max(k - 1, 0)]
            bottom = b if a == b else a + (x[j] - x[a]) * (b - a) / (x[b] - x[a]) if x[b] > x[a] else a
            if j + 1 - bottom > gap:
                gap, left, right = j + 1 - bottom, a, j
        if gap <= dip:
            break
        dip = max(dip, fit_gap(x, [i for i in minorant if i <= left], lower=True), fit_gap(x, [j for j in majorant if j >= right], lower=False))
        if left == low and right == high or left >= right:
            break
        low, high = left, right
    return dip / (2 * n)


def hull(x: np.ndarray, low: int, high: int, lower: bool) -> list[int]:
    """Indices where the convex minorant (or concave majorant) of the steps from low to high touches them."""
    out: list[int] = []
    for i in range(low, high + 1):
        while len(out) > 1:
            a, b = out[-2], out[-1]
            turn = (b - a) * (x[i] - x[a]) - (i - a) * (x[b] - x[a])
            if (turn >= 0) == lower and turn != 0 or turn == 0:
                out.pop()
            else:
                break
        out.append(i)
    return out


def fit_gap(x: np.ndarray, knots: list[int], lower: bool) -> float:
    """The largest distance of the steps to the hull through the knots, in counts; one count at least where there are two knots, also of a tied run."""
    most = 0.0
    for a, b in zip(knots, knots[1:], strict=False):
        most = max(most, 1.0)
        if x[b] > x[a]:
            i = np.arange(a, b + 1)
            off = i - a - (x[i] - x[a]) * (b - a) / (x[b] - x[a])
            most = max(most, 1.0 + float(off.max() if lower else -off.min()))
    return most


def dip(df: DataFrame, by: str, value: str, most: int = 5000) -> DataFrame:
    """Dip of each group's values, of at most `most` evenly strided ones in order of value."""
    order = Window.partitionBy(by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(by))
    stride = F.greatest(F.lit(1), F.ceil(n / F.lit(most)))
    few = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(by, value, F.row_number().over(order).alias("_k"), stride.alias("_s")).where("(_k - 1) % _s = 0")
    kind = dict(df.dtypes)[by]

    def of(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [group[by].iloc[0]], "dip": [dip_statistic(group[value].to_numpy())]})

    return few.select(by, value).groupBy(by).applyInPandas(of, f"{by} {kind}, dip double")
