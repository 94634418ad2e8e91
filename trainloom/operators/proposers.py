"""Proposals to split a cluster by its spikes' features: whitening, outliers, a robust boundary, cuts along an axis.

Moments and memberships are DataFrame plans over all rows; models of a cluster are a few numbers each, that come to the
driver and go back as a broadcast. Mixtures are fitted to at most MAX_FIT rows of a cluster, one of each of as many
equal strata in order of time (a parameter of the operators), and applied to all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainloom.operators import models

#: Limits of the proposals (fixed values): share of rows that must have a dimension, tail and shares of outliers, rows of a fit, of a part, gain, components of an axis.
MIN_PRESENT, OUTLIER_P, OUTLIER_SHARE = 0.5, 1e-3, (0.001, 0.10)
MAX_FIT, MIN_PART, MIN_GAIN, MAX_K = 5000, 100, 10.0, 4


def whitened(vectors: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """group, order, x: each group's vectors in standard scores, without dimensions that less than half of its rows have or that are constant; what is missing is 0."""
    rows = vectors.select(group, order, F.posexplode(F.col(column).cast("array<double>")).alias("j", "v"))
    rows = rows.withColumn("v", F.when(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v")))
    sums = rows.groupBy(group, "j").agg(F.count("*").alias("n"), F.count("v").alias("here"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    kept = sums.where((F.col("here") >= MIN_PRESENT * F.col("n")) & (F.col("here") > 1) & (F.col("var") > 1e-12)).select(group, "j", "mean", F.sqrt("var").alias("std"))
    scores = F.coalesce((F.col("v") - F.col("mean")) / F.col("std"), F.lit(0.0))
    each = rows.join(F.broadcast(kept), [group, "j"]).groupBy(group, order)  # a row a cluster and dimension is broadcast
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", scores.alias("z")))), lambda s: s["z"]).alias("x"))


def moments(rows: DataFrame, group: str) -> dict:
    """(n, mean, covariance) of each group's vectors x, by partial sums a task; a row a cluster comes to the driver."""
    kind = dict(rows.dtypes)[group]

    def of(batches):
        for own in batches:
            for g, part in own.groupby(group):
                x = np.array(part["x"].tolist())
                yield pd.DataFrame([{group: g, "n": len(x), "d": x.shape[1], "s": x.sum(axis=0), "q": (x.T @ x).ravel()}])

    parts = rows.select(group, "x").mapInPandas(of, f"{group} {kind}, n long, d int, s array<double>, q array<double>")
    long = parts.select(group, "n", "d", F.posexplode(F.concat("s", "q")).alias("i", "v")).groupBy(group, "d", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    out = {}
    for r in long.groupBy(group, "d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).collect():
        n, d, v = r["n"], r["d"], np.array([x["v"] for x in r["v"]])
        mean = v[:d] / n
        out[r[group]] = n, mean, (v[d:].reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1)
    return out


def tail_limit(d: int, p: float) -> float:
    """The squared distance beyond which a Gaussian of d dimensions has this share."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if models.chi2_tail(middle, d) > p else (low, middle)
    return high


def scored(rows: DataFrame, group: str, by_group: dict, f: Callable[[np.ndarray, tuple], np.ndarray], name: str) -> DataFrame:
    """rows with what f gives for each group's vectors and its model; groups without a model are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(by_group)  # a few numbers a cluster
    kinds = dict(rows.dtypes)

    def of(batches):
        for own in batches:
            for g, part in own.groupby(group):
                if g in shared.value:
                    yield part.assign(**{name: f(np.array(part["x"].tolist()), shared.value[g])})

    return rows.mapInPandas(of, ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", {name} double")


def distances(x: np.ndarray, model: tuple) -> np.ndarray:
    mean, inverse = model
    return np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)


def outliers(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, order of the rows x far from their group's mean, where they are a thousandth to a tenth of a group of 50 or more.

    Far is a squared Mahalanobis distance that a Gaussian exceeds once in a thousand; mean and covariance are taken
    twice, the second time without the first time's outliers. rows are read three times, so callers write them.
    """
    limits: dict[int, float] = {}

    def far(found: DataFrame, own: dict) -> DataFrame:
        fits = {g: (m, np.linalg.inv(c + 1e-6 * np.eye(len(m)))) for g, (n, m, c) in own.items()}
        limits.update({len(m): tail_limit(len(m), OUTLIER_P) for m, _ in fits.values() if len(m) not in limits})
        return scored(found, group, fits, lambda x, model: (distances(x, model) > limits[x.shape[1]]).astype(float), "far")

    own = {g: v for g, v in moments(rows, group).items() if v[0] >= 50}
    rows = rows.select(group, order, "x")
    again = moments(far(rows, own).where("far = 0").select(group, order, "x"), group)
    flagged = far(rows, {g: again.get(g, v) for g, v in own.items()})
    share = flagged.groupBy(group).agg(F.avg("far").alias("share")).where(F.col("share").between(*OUTLIER_SHARE)).select(group)
    return flagged.where("far = 1").join(F.broadcast(share), group, "left_semi").select(group, order)


def strata(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """One row of each of at most so many equal strata of a group, in order: which one is up to a hash, so that no period of the rows shows."""
    own = Window.partitionBy(group)
    place = (F.row_number().over(own.orderBy(order)) - 1).alias("k")
    cut = rows.select("*", place, F.count("*").over(own).alias("n")).withColumn("stratum", F.floor(F.col("k") * F.least(F.lit(most), F.col("n")) / F.col("n")))
    return cut.groupBy(group, "stratum").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(order)).alias("r")).select("r.*")


def clean_posterior(x: np.ndarray, model: tuple) -> np.ndarray:
    mean, cov, inflation, weight = model
    a, b = np.log(weight) + models.normal_log(x, mean, cov), np.log(1 - weight) + models.normal_log(x, mean, cov * inflation)
    return 1 / (1 + np.exp(np.clip(b - a, -700, 700)))


def robust_boundaries(rows: DataFrame, group: str, order: str, most: int = MAX_FIT) -> DataFrame:
    """group, order, gain, weight, inflation of the rows x that a wider Gaussian about the same mean explains better.

    Of clusters where two gain MIN_GAIN over one, and both parts have MIN_PART rows or more, these being the lesser.
    """
    kind = dict(rows.dtypes)[group]
    fields = "gain double, weight double, inflation double, mean array<double>, cov array<double>"

    def of(own: pd.DataFrame) -> pd.DataFrame:
        found = models.contaminated(np.array(own.sort_values(order)["x"].tolist())) if len(own) >= min(most, 2 * MIN_PART) else None
        if not found or found["gain"] < MIN_GAIN:
            return pd.DataFrame(columns=[group, *(f.split()[0] for f in fields.split(", "))])
        return pd.DataFrame([{group: own[group].iloc[0], "gain": found["gain"], "weight": found["weight"], "inflation": found["inflation"], "mean": found["mean"], "cov": found["cov"].ravel()}])

    fits = strata(rows.select(group, order, "x"), group, order, most).groupBy(group).applyInPandas(of, f"{group} {kind}, {fields}").collect()  # a row a cluster
    by = {r[group]: (np.array(r["mean"]), np.array(r["cov"]).reshape(len(r["mean"]), -1), r["inflation"], r["weight"]) for r in fits}
    minor = scored(rows.select(group, order, "x"), group, by, clean_posterior, "clean")
    parts = minor.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.when(F.col("clean") < 0.5, 1).otherwise(0)).alias("k"))
    good = parts.where((F.col("k") >= MIN_PART) & (2 * F.col("k") < F.col("n")) & (F.col("n") - F.col("k") >= MIN_PART)).select(group)
    told = rows.sparkSession.createDataFrame([(r[group], r["gain"], r["weight"], r["inflation"]) for r in fits], f"{group} {kind}, gain double, weight double, inflation double")
    return minor.where("clean < 0.5").join(F.broadcast(good), group).join(F.broadcast(told), group).select(group, order, "gain", "weight", "inflation")


def crossings(values: np.ndarray, most_k: int = MAX_K) -> list[tuple[float, float]]:
    """(cut, gain): where the lower components of the best mixture by BIC give way to the upper ones, between each two means beside each other; none unless it gains MIN_GAIN over one Gaussian.

    Of several crossings that which is nearest to the middle of the means is taken.
    """
    x = values[np.isfinite(values)]
    fits = [f for k in range(1, most_k + 1) if len(x) >= 2 * MIN_PART and (f := models.diagonal_mixture(x[:, None], k, 60))]
    if not fits or len(fits[0]["weights"]) > 1:
        return []
    best = min(fits, key=lambda f: f["bic"])
    gain = fits[0]["bic"] - best["bic"]
    if len(best["weights"]) < 2 or not gain >= MIN_GAIN:
        return []
    order = np.argsort(best["means"][:, 0])
    w, m, v = (best[k].reshape(-1)[order] for k in ("weights", "means", "variances"))

    def lower_share(at: np.ndarray, split: int) -> np.ndarray:
        logs = np.log(w) - 0.5 * ((at[:, None] - m) ** 2 / v + np.log(v))
        parts = np.exp(logs - logs.max(axis=1, keepdims=True))
        return parts[:, :split].sum(axis=1) / parts.sum(axis=1) - 0.5

    cuts: dict[float, float] = {}
    for split in range(1, len(m)):
        grid = np.linspace(m[split - 1], m[split], 129)
        if grid[-1] - grid[0] < 1e-6:
            continue
        # A finer grid in the chosen interval each time, down to the last digits.
        for _ in range(6):
            share = lower_share(grid, split)
            falls = np.flatnonzero((share[:-1] >= 0) & (share[1:] <= 0))
            if not len(falls):
                break
            middle = (m[split - 1] + m[split]) / 2
            k = falls[np.argmin(np.abs((grid[falls] + grid[falls + 1]) / 2 - middle))]
            grid = np.linspace(grid[k], grid[k + 1], 129)
        else:
            cuts.setdefault(float((grid[0] + grid[-1]) / 2), gain)
    return list(cuts.items())


def axis_cuts(rows: DataFrame, group: str, order: str, value: str, most: int = MAX_FIT) -> DataFrame:
    """group, cut, gain, below, n: the cuts of each group's values, and how many of all its rows lie below; both sides have MIN_PART rows."""
    kind = dict(rows.dtypes)[group]
    own = rows.select(group, order, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))

    def of(part: pd.DataFrame) -> pd.DataFrame:
        found = crossings(part.sort_values(order)["v"].to_numpy(float))
        return pd.DataFrame([{group: part[group].iloc[0], "cut": c, "gain": g} for c, g in found], columns=[group, "cut", "gain"])

    cuts = strata(own, group, order, most).groupBy(group).applyInPandas(of, f"{group} {kind}, cut double, gain double")
    sides = own.join(F.broadcast(cuts), group).groupBy(group, "cut", "gain").agg(F.sum(F.when(F.col("v") < F.col("cut"), 1).otherwise(0)).alias("below"), F.count("*").alias("n"))
    return sides.where((F.col("below") >= MIN_PART) & (F.col("n") - F.col("below") >= MIN_PART))


def assigned(x: np.ndarray, fit: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component, its posterior, and squared distance from its mean of each row, by a mixture of `models.diagonal_mixture`."""
    squares = (x[:, None, :] - fit["means"]) ** 2 / fit["variances"]
    logs = np.log(fit["weights"]) - 0.5 * (np.log(2 * math.pi * fit["variances"]).sum(axis=1) + squares.sum(axis=2))
    best = logs.argmax(axis=1)
    rows = np.arange(len(x))
    return best, 1 / np.exp(logs - logs[rows, best][:, None]).sum(axis=1), squares.sum(axis=2)[rows, best]


def noise_precision(cov: np.ndarray, ridge: float = 0.01) -> np.ndarray | None:
    """Inverse of a noise covariance with a ridge relative to the mean variance; None of a singular one."""
    try:
        return np.linalg.inv(cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov)))
    except np.linalg.LinAlgError:
        return None


def ridge_r2(weights: np.ndarray, intercepts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of each output's variance that a ridge fit explains on its own rows; 0 of a constant output."""
    spread = ((y - y.mean(axis=0)) ** 2).sum(axis=0)
    left = ((y - x @ weights - intercepts) ** 2).sum(axis=0)
    return np.where(spread > 0, 1 - left / np.where(spread > 0, spread, 1), 0.0)
