"""Features by cluster and spike for learned curation, gradient-boosted trees, and reports over runs."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def amplitude_by_time(spikes: DataFrame, total: int, bins: int, least: int = 4) -> DataFrame:
    """cluster_id, bin, n, median, mad, relative: amplitudes of each time bin, and the median over that of the whole cluster; null under `least` spikes."""
    width = max(total / bins, 1.0)
    rows = spikes.withColumn("bin", F.least(F.floor(F.col("t") / F.lit(width)), F.lit(bins - 1)))
    medians = rows.groupBy("cluster_id", "bin").agg(F.count("*").alias("n"), F.percentile("amplitude", 0.5).alias("median"))
    overall = spikes.groupBy("cluster_id").agg(F.percentile("amplitude", 0.5).alias("whole"))
    off = rows.join(medians, ["cluster_id", "bin"]).groupBy("cluster_id", "bin").agg(F.percentile(F.abs(F.col("amplitude") - F.col("median")), 0.5).alias("mad"))
    out = medians.join(off, ["cluster_id", "bin"]).join(overall, "cluster_id")
    enough = F.col("n") >= least
    return out.select("cluster_id", "bin", "n", F.when(enough, F.col("median")).alias("median"), F.when(enough, F.col("mad")).alias("mad"), F.when(enough & (F.col("whole") != 0), F.col("median") / F.col("whole")).alias("relative"))


def robust_scores(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with z: distance from the group's median over 1.4826 median absolute deviations (at least 1e-6)."""
    from trainloom.functions.distribution import robust

    scaled = rows.join(robust(rows, by, value), by)
    return scaled.withColumn("z", (F.col(value) - F.col("median")) / F.col("scale")).drop("median", "scale")


def log_interval(isi: Column, rate: float) -> Column:
    """log10 of 1 + milliseconds."""
    return F.log10(1 + isi * F.lit(1000.0 / rate))


def spike_features(spikes: DataFrame, rate: float, refractory: int) -> DataFrame:
    """cluster_id, spike_idx, amp_z, amp_pct (midpoint rank), log_isi_before, log_isi_after, refractory (an interval of at most that)."""
    order = Window.partitionBy("cluster_id").orderBy("t", "spike_idx")
    n = F.count("*").over(Window.partitionBy("cluster_id"))
    below = F.rank().over(Window.partitionBy("cluster_id").orderBy("amplitude")) - 1
    equal = F.count("*").over(Window.partitionBy("cluster_id", "amplitude"))
    before, after = F.col("t") - F.lag("t").over(order), F.lead("t").over(order) - F.col("t")
    rows = robust_scores(spikes, ["cluster_id"], "amplitude").withColumns({"before": before, "after": after, "pct": (below + 0.5 * equal) / n})
    close = (F.coalesce("before", F.lit(1 << 62)) <= refractory) | (F.coalesce("after", F.lit(1 << 62)) <= refractory)
    return rows.select("cluster_id", "spike_idx", F.col("z").alias("amp_z"), F.col("pct").alias("amp_pct"), log_interval(F.col("before"), rate).alias("log_isi_before"), log_interval(F.col("after"), rate).alias("log_isi_after"), close.alias("refractory"))


def neighbour_density(x: np.ndarray, k: int) -> np.ndarray:
    """Mean distance of each row to its k nearest others, over the median of those."""
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    own = np.sort(d, axis=1)[:, : min(k, max(1, len(x) - 1))].mean(axis=1)
    return own / max(1e-12, float(np.median(own)))


def mahalanobis(x: np.ndarray) -> np.ndarray:
    """Distance of each row from the mean by the rows' own covariance."""
    off = x - x.mean(axis=0)
    cov = np.cov(x.T).reshape(x.shape[1], x.shape[1]) + 1e-6 * max(1e-12, x.var(axis=0).mean()) * np.eye(x.shape[1])
    return np.sqrt((off @ np.linalg.inv(cov) * off).sum(axis=1))


def best_cut(values: np.ndarray, labels: np.ndarray) -> dict:
    """The cut of one axis whose upper or lower side has the largest Jaccard index with the labels, chosen on even rows and scored on odd ones."""

    def score(x: np.ndarray, y: np.ndarray, cut: float, upper: bool) -> float:
        side = x > cut if upper else x <= cut
        return float((side & y).sum() / max(1, (side | y).sum()))

    x, y, u, w = values[::2], labels[::2].astype(bool), values[1::2], labels[1::2].astype(bool)
    best = max(((score(x, y, c, up), c, up) for c in np.unique(x) for up in (True, False)), default=(0.0, 0.0, True))
    return {"cut": float(best[1]), "upper": best[2], "train": best[0], "test": score(u, w, best[1], best[2])}


@dataclass
class Tree:
    """Nodes in order of growth: feature, bin up to which rows go left (missing ones by `missing_left`), children, value."""

    nodes: list[dict] = field(default_factory=list)

    def leaf_values(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), int)
        for k, node in enumerate(self.nodes):
            if node["feature"] >= 0:
                here = np.flatnonzero(at == k)
                x = bins[here, node["feature"]]
                left = np.where(x == 0, node["missing_left"], x <= node["bin"])
                at[here] = np.where(left, node["left"], node["right"])
        return np.array([n["value"] for n in self.nodes])[at]


@dataclass
class Boosted:
    """Gradient-boosted trees over binned features; bin 0 is for missing values."""

    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    rate: float
    loss: str

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.stack([np.searchsorted(e, x[:, j], side="left") + 1 for j, e in enumerate(self.edges)], axis=1)
        out[np.isnan(x)] = 0
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return self.base + self.rate * sum((t.leaf_values(bins) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return 1 / (1 + np.exp(-m)) if self.loss == "logistic" else m


def grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, leaves: int, least: float, ridge: float, width: int, columns: np.ndarray) -> Tree:
    """A tree grown best split first, by histograms of gradients."""

    def best(rows: np.ndarray) -> tuple | None:
        g, h = grad[rows].sum(), hess[rows].sum()
        top = None
        for j in columns:
            hg = np.bincount(bins[rows, j], grad[rows], width)
            hh = np.bincount(bins[rows, j], hess[rows], width)
            for missing_left in (True, False) if hh[0] > 0 else (True,):
                lg, lh = np.cumsum(hg[1:]) + (hg[0] if missing_left else 0), np.cumsum(hh[1:]) + (hh[0] if missing_left else 0)
                rg, rh = g - lg, h - lh
                gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - g**2 / (h + ridge), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 and (top is None or gain[k] > top[0]):
                    top = (float(gain[k]), int(j), k + 1, missing_left)
        return top

    value = lambda rows: float(-grad[rows].sum() / (hess[rows].sum() + ridge))
    everything = np.arange(len(bins))
    tree, open_ = Tree([{"feature": -1, "value": value(everything)}]), {}
    if found := best(everything):
        open_[0] = (found, everything)
    while open_ and (len(tree.nodes) + 1) // 2 < leaves:
        k = max(open_, key=lambda i: open_[i][0][0])
        (_, j, cut, missing_left), rows = open_.pop(k)
        left = np.where(bins[rows, j] == 0, missing_left, bins[rows, j] <= cut)
        tree.nodes[k] |= {"feature": j, "bin": cut, "missing_left": missing_left, "left": len(tree.nodes), "right": len(tree.nodes) + 1}
        for own in (rows[left], rows[~left]):
            tree.nodes.append({"feature": -1, "value": value(own)})
            if found := best(own):
                open_[len(tree.nodes) - 1] = (found, own)
    return tree


def boost(x: np.ndarray, y: np.ndarray, loss: str = "logistic", rounds: int = 50, rate: float = 0.1, leaves: int = 8, least: float = 1.0, ridge: float = 1.0, cuts: int = 32, share: float = 1.0, weights: np.ndarray | None = None, seed: int = 1) -> Boosted:
    """Trees for 0/1 labels (logistic) or numbers (squared); each round takes a share of rows and columns by the seed."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(y)) if weights is None else weights
    edges = [np.unique(np.quantile(v[~np.isnan(v)], np.linspace(0, 1, cuts + 1)[1:-1])) if (~np.isnan(v)).any() else np.zeros(0) for v in x.T]
    mean = float(np.average(y, weights=w))
    base = float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1))) if loss == "logistic" else mean
    model = Boosted(edges, base, [], rate, loss)
    bins, margin = model.binned(x), np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin)) if loss == "logistic" else margin
        grad, hess = (p - y) * w, (p * (1 - p) if loss == "logistic" else np.ones(len(y))) * w
        columns = rng.permutation(x.shape[1])[: max(1, round(share * x.shape[1]))]
        bag = rng.random(len(y)) < share if share < 1 else np.ones(len(y), bool)
        model.trees.append(grow(bins, np.where(bag, grad, 0), np.where(bag, hess, 0), leaves, least, ridge, cuts + 3, np.sort(columns)))
        margin = margin + rate * model.trees[-1].leaf_values(bins)
    return model


def score(rows: DataFrame, model: Boosted, features: list[str]) -> DataFrame:
    """rows with prediction."""

    @F.pandas_udf("double")
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    return rows.withColumn("prediction", of(*[F.col(c).cast("double") for c in features]))


def run_report(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, sd of a measure over runs."""
    return runs.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def paired_interval(deltas: np.ndarray, draws: int = 2000, seed: int = 1) -> tuple[float, float] | None:
    """A 95 % interval of the mean of paired deltas by resampling; None under three."""
    if len(deltas) < 3:
        return None
    rng = np.random.default_rng(seed)
    means = np.sort(deltas[rng.integers(0, len(deltas), (draws, len(deltas)))].mean(axis=1))
    return float(means[draws // 40]), float(means[draws - draws // 40 - 1])
