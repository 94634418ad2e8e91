"""Models of a group's rows: mixtures, k-means, isolation measures.

Kernels are numpy; groups of up to ROWS rows come by applyInPandas. Mixtures and k-means of larger groups start from
strided rows and are then fitted to all rows by sums on the executors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group, and of its surroundings, that a kernel takes at most.
ROWS = 5000


def strided(rows: DataFrame, by: str, order: str, most: int = ROWS) -> DataFrame:
    """Every k-th row of each group, k such that at most `most` are left."""
    w = Window.partitionBy(by)
    step = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / F.lit(most)))
    return rows.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_s": step}).where("_k % _s = 0").drop("_k", "_s")


def kmeans(x: np.ndarray, k: int, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels: seeded k-means++ starts, then Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    labels = np.zeros(len(x), int)
    for step in range(rounds):
        new = assign(x, c)
        if step and (new == labels).all():
            break
        labels = new
        c = np.array([x[labels == j].mean(axis=0) if (labels == j).any() else c[j] for j in range(k)])
    return c, labels


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean over rows of (b - a) / max(a, b), with distances to the own centre and the nearest other one."""
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    d = np.sqrt(((x[:, None, :] - np.array([x[labels == k].mean(axis=0) for k in kinds])[None]) ** 2).sum(axis=2))
    own = np.searchsorted(kinds, labels)
    a = d[np.arange(len(x)), own]
    d[np.arange(len(x)), own] = np.inf
    b = d.min(axis=1)
    big = np.maximum(a, b)
    return float(np.where(big > 0, (b - a) / np.where(big > 0, big, 1), 0).mean())


def two_gaussians(values: np.ndarray) -> dict | None:
    """A 1-D mixture of two Gaussians against one, by BIC: means, deviations, weight of the upper one, gain, labels; None under 50 values or where the minor one dies or has less than a twentieth. It starts from the halves of the sorted values."""
    x = values[np.isfinite(values)]
    n = len(x)
    if n < 50 or x.std() <= 0:
        return None
    parts = np.split(np.sort(x), [n // 2])
    m, v, w = np.array([p.mean() for p in parts]), np.array([max(p.var(), 1e-9) for p in parts]), np.array([0.5, 0.5])
    if m[1] - m[0] < 1e-6:
        return None
    last = -np.inf
    for _ in range(200):
        log = np.log(w) - 0.5 * np.log(2 * np.pi * v) - (x[:, None] - m) ** 2 / (2 * v)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        r = np.exp(log - total[:, None])
        ll = total.sum()
        mass = r.sum(axis=0)
        if mass.min() < 2:
            return None
        w, m = mass / n, (r * x[:, None]).sum(axis=0) / mass
        v = np.maximum((r * (x[:, None] - m) ** 2).sum(axis=0) / mass, 1e-9)
        if abs(ll - last) <= 1e-7 * abs(ll):
            break
        last = ll
    if w.min() < 0.05:
        return None
    order = np.argsort(m)
    labels = (r[:, order[1]] > r[:, order[0]]).astype(int)
    one = -0.5 * n * (math.log(2 * math.pi * x.var()) + 1)
    return {"means": m[order], "std": np.sqrt(v[order]), "weight": float(w[order[1]]), "gain": float((2 * math.log(n) - 2 * one) - (5 * math.log(n) - 2 * ll)), "labels": labels}


def diagonal_mixture(x: np.ndarray, k: int, rounds: int = 100) -> dict | None:
    """A mixture of k Gaussians with diagonal covariances, started by k-means: weights, means, variances, bic, posterior; None where a component dies."""
    n, d = x.shape
    if n < 2 * k:
        return None
    _, labels = kmeans(x, k, 20)
    r = np.eye(k)[labels]
    floor = np.maximum(1e-3 * x.var(axis=0), 1e-12)
    last = -np.inf
    for _ in range(rounds):
        mass = r.sum(axis=0)
        if mass.min() < 1:
            return None
        m = r.T @ x / mass[:, None]
        v = np.maximum(np.stack([(r[:, j : j + 1] * (x - m[j]) ** 2).sum(axis=0) / mass[j] for j in range(k)]), floor)
        log = np.log(mass / n) - 0.5 * (np.log(2 * np.pi * v).sum(axis=1) + (((x[:, None, :] - m) ** 2) / v).sum(axis=2))
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        r, ll = np.exp(log - total[:, None]), total.sum()
        if abs(ll - last) <= 1e-6 * abs(ll):
            break
        last = ll
    return {"weights": mass / n, "means": m, "variances": v, "bic": float((2 * k * d + k - 1) * math.log(n) - 2 * ll), "posterior": r}


def contaminated(x: np.ndarray) -> dict | None:
    """A Gaussian and a wider one about the same mean: mean, covariance, inflation, weight, gain over one Gaussian, posterior of the narrow one."""
    n, d = x.shape
    if n < max(100, 4 * d):
        return None
    best = None
    ridge = 1e-6 * x.var(axis=0).mean() * np.eye(d)
    mean0, cov0 = x.mean(axis=0), np.cov(x.T).reshape(d, d) + ridge
    single = normal_log(x, mean0, cov0).sum()
    for start in (4.0, 25.0):
        mean, cov, inflation, weight, last = mean0, cov0 / 2, start, 0.8, -np.inf
        for _ in range(100):
            a, b = np.log(weight) + normal_log(x, mean, cov), np.log(1 - weight) + normal_log(x, mean, cov * inflation)
            top = np.maximum(a, b)
            total = top + np.log(np.exp(a - top) + np.exp(b - top))
            r, ll = np.exp(a - total), total.sum()
            u = r + (1 - r) / inflation
            mean = (u[:, None] * x).sum(axis=0) / u.sum()
            off = x - mean
            cov = (u[:, None] * off).T @ off / n + ridge
            m2 = (off @ np.linalg.inv(cov) * off).sum(axis=1)
            inflation = float(np.clip(((1 - r) * m2).sum() / max(1e-12, d * (1 - r).sum()), 1.01, 100))
            weight = float(np.clip(r.mean(), 0.5, 1 - 1e-6))
            if abs(ll - last) <= 1e-7 * abs(ll):
                break
            last = ll
        if best is None or ll > best["ll"]:
            best = {"ll": ll, "mean": mean, "cov": cov, "inflation": inflation, "weight": weight, "posterior": r}
    return best | {"gain": float(2 * (best["ll"] - single) - 2 * math.log(n))}


def normal_log(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    factor = np.linalg.cholesky(cov)
    z = np.linalg.solve(factor, (x - mean).T)
    return -0.5 * ((z**2).sum(axis=0) + len(mean) * math.log(2 * math.pi)) - np.log(np.diag(factor)).sum()


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution, by the series or the continued fraction of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def isolation(inside: np.ndarray, outside: np.ndarray, neighbours: int = 8) -> dict[str, float]:
    """Isolation distance (squared), L-ratio, share of own rows among nearest neighbours, Fisher's d', centroid silhouette; NaN where there are too few rows (50) or no way to measure."""
    nan = float("nan")
    out = dict.fromkeys(("isolation_distance", "l_ratio", "nn_hit_rate", "d_prime", "silhouette"), nan)
    n, d = inside.shape
    if n < 50 or not len(outside):
        return out
    ridge = 1e-6 * max(1e-12, inside.var(axis=0).mean()) * np.eye(d)
    mean, cov = inside.mean(axis=0), np.cov(inside.T).reshape(d, d) + ridge
    inverse = np.linalg.inv(cov)
    far = ((outside - mean) @ inverse * (outside - mean)).sum(axis=1)
    if len(outside) >= n:
        out["isolation_distance"] = float(np.sort(far)[n - 1])
    out["l_ratio"] = float(sum(chi2_tail(float(x), d) for x in far) / n)
    pool = np.concatenate([inside, outside[:: max(1, len(outside) // n)]])
    queries = np.arange(0, n, max(1, n // 200))
    dist = ((inside[queries][:, None, :] - pool[None]) ** 2).sum(axis=2)
    dist[np.arange(len(queries)), queries] = np.inf
    out["nn_hit_rate"] = float((np.argsort(dist, axis=1, kind="stable")[:, :neighbours] < n).mean())
    other = outside.mean(axis=0)
    within = (np.cov(inside.T).reshape(d, d) * (n - 1) + np.cov(outside.T).reshape(d, d) * max(0, len(outside) - 1)) / max(1, n + len(outside) - 2) + ridge
    axis = np.linalg.solve(within, mean - other)
    spread = math.sqrt(max(1e-300, float(axis @ within @ axis)))
    out["d_prime"] = float(abs(axis @ (mean - other)) / spread)
    a, b = np.sqrt(((inside - mean) ** 2).sum(axis=1)), np.sqrt(((inside - other) ** 2).sum(axis=1))
    out["silhouette"] = float(((b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())
    return out


def isolation_by_group(vectors: DataFrame, group: str, order: str, column: str, dims: int, most: int = ROWS) -> DataFrame:
    """group, n (rows taken) and its isolation measures against the rows of all other groups, strided to `most` each.

    The surroundings are one strided sample of all rows (`most` a group, then `most` in all), which every
    task gets; a group's own rows are left out there.
    """
    kind = dict(vectors.dtypes)[group]
    few = strided(vectors.select(group, order, F.slice(column, 1, dims).cast("array<double>").alias("x")), group, order, most)
    total = few.count()
    around = few.orderBy(order).withColumn("_k", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("_k") % max(1, math.ceil(total / most)) == 0) if total > most else few
    sample = around.select(group, "x").toPandas()  # `most` rows
    shared = vectors.sparkSession.sparkContext.broadcast((sample[group].to_numpy(), np.array(sample["x"].tolist()).reshape(len(sample), -1)))
    names = ("isolation_distance", "l_ratio", "nn_hit_rate", "d_prime", "silhouette")

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        own, x = rows[group].iloc[0], np.array(rows.sort_values(order)["x"].tolist())
        kinds, others = shared.value
        return pd.DataFrame([{group: own, "n": len(x)} | isolation(x, others[kinds != own])])

    return few.groupBy(group).applyInPandas(of, f"{group} {kind}, n long, " + ", ".join(f"{c} double" for c in names))


def large_groups(rows: DataFrame, group: str, most: int) -> DataFrame:
    """group, n of the groups of more than so many rows."""
    return rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > most)


def mixture_by_group(values: DataFrame, group: str, order: str, value: str, most: int = ROWS, rounds: int = 50) -> DataFrame:
    """group, n, low, high, weight, gain, n_minor of the two-Gaussian split of each group's values; nulls where there is none.

    Groups of up to `most` finite values are fitted in one task. Larger ones start from a fit of `most` strided values, and
    are then fitted to all: each of up to `rounds` rounds sums over all rows on the executors and leaves a row a group.
    """
    kind = dict(values.dtypes)[group]
    finite = values.select(group, order, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    fields = "n long, low double, high double, weight double, gain double, n_minor double, s_low double, s_high double"

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        found = two_gaussians(rows["v"].to_numpy(float))
        row = {group: rows[group].iloc[0], "n": len(rows)}
        if found:
            ones = int(found["labels"].sum())
            row |= {"low": found["means"][0], "high": found["means"][1], "weight": found["weight"], "gain": found["gain"], "n_minor": min(ones, len(found["labels"]) - ones), "s_low": found["std"][0], "s_high": found["std"][1]}
        return pd.DataFrame([row], columns=[group, *(x.split()[0] for x in fields.split(", "))]).astype({"n_minor": "float"})

    fits = strided(finite, group, order, most).groupBy(group).applyInPandas(of, f"{group} {kind}, {fields}")
    large = large_groups(finite, group, most)
    names = ("n", "low", "high", "weight", "gain", "n_minor")
    done = fits.join(F.broadcast(large.select(group)), group, "left_anti").select(group, *names)
    state = {r[group]: r.asDict() for r in fits.join(F.broadcast(large.select(group)), group, "left_semi").collect()}  # a row a crowded group
    rows = finite.join(F.broadcast(large.select(group)), group, "left_semi")
    return done.unionByName(values.sparkSession.createDataFrame([tuple(x.get(k) for k in (group, *names)) for x in refined(rows, group, state, rounds)], done.schema)) if state else done


def refined(rows: DataFrame, group: str, state: dict, rounds: int) -> list[dict]:
    """The fits of state (low, high, s_low, s_high, weight by group) after rounds over all rows (group, v)."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[group]
    moments = {r[group]: r for r in rows.groupBy(group).agg(F.count("*").alias("n"), F.var_pop("v").alias("var")).collect()}
    open_, last = {k for k, x in state.items() if x["low"] is not None}, {}
    for step in range(rounds + 1):
        if not open_:
            break
        now = spark.createDataFrame([(k, *(float(state[k][x]) for x in ("low", "high", "s_low", "s_high", "weight"))) for k in open_], f"{group} {kind}, low double, high double, s_low double, s_high double, weight double")
        log = lambda w, m, s: F.log(w) - 0.5 * F.log(2 * math.pi * s * s) - (F.col("v") - m) * (F.col("v") - m) / (2 * s * s)
        both = rows.join(F.broadcast(now), group).withColumns({"a": log(1 - F.col("weight"), F.col("low"), F.col("s_low")), "b": log(F.col("weight"), F.col("high"), F.col("s_high"))})
        both = both.withColumn("ll", F.greatest("a", "b") + F.log1p(F.exp(-F.abs(F.col("a") - F.col("b"))))).withColumn("r", F.exp(F.col("b") - F.col("ll")))
        v, r = F.col("v"), F.col("r")
        sums = both.groupBy(group).agg(F.count("*").alias("n"), F.sum("ll").alias("ll"), F.sum(r).alias("r"), F.sum(r * v).alias("rv"), F.sum(r * v * v).alias("rvv"), F.sum(v).alias("v"), F.sum(v * v).alias("vv"), F.sum(F.when(F.col("b") > F.col("a"), 1).otherwise(0)).alias("ones"))
        for x in sums.collect():  # a row a crowded group
            k, n, ll, old = x[group], x["n"], x["ll"], state[x[group]]
            one = -0.5 * n * (math.log(2 * math.pi * moments[k]["var"]) + 1)
            old |= {"n_minor": float(min(x["ones"], n - x["ones"])), "gain": (2 * math.log(n) - 2 * one) - (5 * math.log(n) - 2 * ll)}
            if step == rounds or (k in last and abs(ll - last[k]) <= 1e-7 * abs(ll)):
                open_.discard(k)
                continue
            last[k] = ll
            parts = ((n - x["r"], x["v"] - x["rv"], x["vv"] - x["rvv"]), (x["r"], x["rv"], x["rvv"]))
            if min(p[0] for p in parts) <= 1e-9 * n:
                old |= dict.fromkeys(("low", "high", "weight", "gain", "n_minor"))
                open_.discard(k)
                continue
            means = [p[1] / p[0] for p in parts]
            deviations = [math.sqrt(max(p[2] / p[0] - m * m, 1e-9)) for p, m in zip(parts, means, strict=True)]
            old |= {"low": means[0], "high": means[1], "s_low": deviations[0], "s_high": deviations[1], "weight": x["r"] / n}
    for k, x in state.items():
        x["n"] = moments[k]["n"]
        if x["low"] is not None and min(x["weight"], 1 - x["weight"]) < 0.05:
            x |= dict.fromkeys(("low", "high", "weight", "gain", "n_minor"))
        elif x["low"] is not None and x["low"] > x["high"]:
            x |= {"low": x["high"], "high": x["low"], "weight": 1 - x["weight"]}
    return [*state.values()]


def kmeans_by_group(vectors: DataFrame, group: str, order: str, column: str, dims: int, k: int, most: int = ROWS, rounds: int = 50) -> DataFrame:
    """group, n, k, silhouette, smallest: k-means of each group's vectors.

    Groups of up to `most` rows are clustered in one task. Larger ones start from the centres of `most` strided rows; Lloyd's
    rounds then run over all rows, by sums on the executors, and so does the silhouette.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[group]
    rows = vectors.select(group, order, F.slice(column, 1, dims).cast("array<double>").alias("x"))

    def of(own: pd.DataFrame) -> pd.DataFrame:
        x = np.array(own.sort_values(order)["x"].tolist())
        if len(x) < 2 * k:
            return pd.DataFrame([{group: own[group].iloc[0], "n": len(x), "k": k, "silhouette": 0.0, "smallest": 0, "centres": None}])
        centres, labels = kmeans(x, k)
        return pd.DataFrame([{group: own[group].iloc[0], "n": len(x), "k": k, "silhouette": silhouette(x, labels), "smallest": int(np.bincount(labels, minlength=k).min()), "centres": centres.ravel()}])

    fits = strided(rows, group, order, most).groupBy(group).applyInPandas(of, f"{group} {kind}, n long, k int, silhouette double, smallest long, centres array<double>")
    large = large_groups(rows, group, most).select(group)
    done = fits.join(F.broadcast(large), group, "left_anti").drop("centres")
    centres = {r[group]: np.array(r["centres"]).reshape(k, dims) for r in fits.join(F.broadcast(large), group, "left_semi").collect()}  # a row a crowded group
    if not centres:
        return done
    crowded = rows.join(F.broadcast(large), group, "left_semi").select(group, "x")
    counts: dict = {}
    for _ in range(rounds):
        sums = summed(crowded, group, kind, centres, dims)
        new = {g: np.array([s[j][1] / s[j][0] if j in s else c[j] for j in range(k)]) for g, c in centres.items() for s in (sums[g],)}
        counts = {g: [sums[g].get(j, (0,))[0] for j in range(k)] for g in centres}
        still = all(np.allclose(new[g], centres[g], rtol=0, atol=1e-12) for g in centres)
        centres = new
        if still:
            break
    sums = summed(crowded, group, kind, centres, dims)
    out = []
    for g in centres:
        total = sum(s[0] for s in sums[g].values())
        out.append((g, total, k, sum(s[2] for s in sums[g].values()) / total if len(sums[g]) > 1 else 0.0, min(counts[g])))
    return done.unionByName(spark.createDataFrame(out, done.schema))


def summed(rows: DataFrame, group: str, kind: str, centres: dict, dims: int) -> dict:
    """For each group and nearest centre: how many rows, their sum, and the sum of their silhouettes by centres."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # k vectors a crowded group

    def of(batches):
        for own in batches:
            for g, part in own.groupby(group):
                x, c = np.array(part["x"].tolist()), shared.value[g]
                d = np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(axis=2))
                labels = d.argmin(axis=1)
                a = d[np.arange(len(x)), labels]
                d[np.arange(len(x)), labels] = np.inf
                big = np.maximum(a, d.min(axis=1))
                value = np.where(big > 0, (d.min(axis=1) - a) / np.where(big > 0, big, 1), 0)
                yield pd.DataFrame([{group: g, "j": j, "n": int((labels == j).sum()), "total": x[labels == j].sum(axis=0), "value": float(value[labels == j].sum())} for j in np.unique(labels)])

    parts = rows.mapInPandas(of, f"{group} {kind}, j int, n long, total array<double>, value double")
    found = parts.groupBy(group, "j").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", i)) for i in range(dims)]).alias("total"), F.sum("value").alias("value")).collect()  # k rows a crowded group
    out: dict = {g: {} for g in centres}
    for r in found:
        out[r[group]][r["j"]] = (r["n"], np.array(r["total"]), r["value"])
    return out


def ridge_fit(x: np.ndarray, y: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of a ridge regression; the strength is relative to the mean variance, the intercept is free."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    a = (x - mx).T @ (x - mx)
    w = np.linalg.solve(a + strength * np.trace(a) / len(a) * np.eye(len(a)), (x - mx).T @ (y - my))
    return w, my - mx @ w


def top_eigenvectors(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    return values[order], vectors[:, order]


def covariance(vectors: DataFrame, column: str, dims: int) -> np.ndarray:
    """Sample covariance of all vectors, summed on the executors; dims squared numbers come to the driver."""
    x = [F.get(column, i).cast("double") for i in range(dims)]
    row = vectors.agg(*[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(dims) for j in range(i, dims)]).first()
    out = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            out[i, j] = out[j, i] = row[f"c{i}_{j}"]
    return out


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of 2-D points, counter-clockwise."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(pts)[:-1] + half(pts[::-1])[:-1])


def polygon_area(corners: np.ndarray) -> float:
    x, y = corners[:, 0], corners[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)
