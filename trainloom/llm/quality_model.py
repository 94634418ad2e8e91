"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian of its own; its covariance is shrunk to the pooled one and to a multiple of the
identity. A score is the logistic of the difference of log densities (Mahalanobis distances by the inverses of
cached Cholesky factors) and log priors. Statistics are of the text alone: shares of character classes, word
and line lengths, repetition.

The fit takes at most MOST_LABELS labelled rows, those with the least hash of doc_id, so that its cost does not
grow with the corpus; their moments are summed on the executors. Labels of null, or of documents that are
missing, do not count; a doc_id with both labels counts as both. With no labels of a class, every score is the
smoothed share of label 1.

Null texts score as empty ones, very long ones by all of their characters, one text in memory at a time. Rows with equal or null doc_ids are scored as they stand; `score` takes only
the text, so clashing names do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABELS, SHRINK, TO_POOLED, LIMIT = 20_000, 0.1, 0.5, 0.3
#: Scale of the log density difference in the score: densities of many correlated statistics are overconfident.
TEMPERATURE = 4.0
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!", b".,;:'\"-()?", bytes(range(0xC0, 0x100)), b"\n", b" \t\r"]
MEMBER = np.zeros((256, len(CLASSES)))
for _i, _bytes in enumerate(CLASSES):
    MEMBER[list(_bytes), _i] = 1
N_FEATURES = len(CLASSES) + 10


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ MEMBER
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    k, common = len(words), Counter(words)
    triples = max(0, k - 2)
    share = lambda x, of: float(np.log((x + 0.5) / (of + 1.0)))
    rest = [
        np.log1p(k),
        np.log1p(lengths.mean() if k else 0.0),
        np.log1p(lengths.std() if k else 0.0),
        share(len(common), k),
        share(max(common.values(), default=0), k),
        share(sum(map(eq, words, words[1:])), k),
        share(triples - len(set(zip(words, words[1:], words[2:], strict=False))), triples),
        share(len(lines) - len(set(lines)), len(lines)),
        np.log1p(n / max(1, len(lines))),
        share(sum(map(bytes.isupper, words)), k),
    ]
    return [*(np.log((chars + 0.5) / (n + 1.0))).tolist(), *map(float, rest)]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(x) for x in texts], dtype=float).reshape(-1, N_FEATURES)


@dataclass(frozen=True)
class Model:
    """centre and scale of the statistics; per class mean, inverse Cholesky factor, log determinant of the factor, log prior."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float, float], ...]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        logs = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - log_det for mean, inverse, log_det, _ in self.classes]
        odds = (logs[1] - logs[0]) / TEMPERATURE + self.classes[1][3] - self.classes[0][3]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def solve(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """The model from each class's count, sum and sum of outer products."""
    counts = [sums[k][0] if k in sums else 0.0 for k in (0, 1)]
    prior = (counts[1] + 1) / (sum(counts) + 2)
    none = np.zeros(N_FEATURES)
    if min(counts) < 2:
        return Model(none, none + 1, (), prior)
    n, total, outer = (sum(sums[k][i] for k in (0, 1)) for i in range(3))
    centre = total / n
    scale = np.sqrt(np.maximum(np.diag(outer) / n - centre**2, 1e-6))
    means, covariances = [], []
    for k in (0, 1):
        mean = sums[k][1] / counts[k]
        covariances.append((sums[k][2] / counts[k] - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - centre) / scale)
    pooled = (counts[0] * covariances[0] + counts[1] * covariances[1]) / n
    classes = []
    for k in (0, 1):
        round_ = np.eye(N_FEATURES) * max(1e-3, np.trace(covariances[k]) / N_FEATURES)
        factor = np.linalg.cholesky((1 - SHRINK) * covariances[k] + SHRINK * (TO_POOLED * pooled + (1 - TO_POOLED) * round_))
        classes.append((means[k], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(counts[k] / n))))
    return Model(centre, scale, tuple(classes), prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels of which the remainder of crc32(doc_id) by 5 is not 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MOST_LABELS))  # two numbers a row
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("quality", "text")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                x, y = matrix(b.column("text").to_pylist()), b.column("quality").to_numpy()
                for k in (0, 1):
                    own = x[y == k]
                    found[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"quality": np.repeat([0, 1], found.shape[1]).astype(np.int32), "place": np.tile(np.arange(found.shape[1], dtype=np.int32), 2), "value": found.ravel()})

    out = {0: np.zeros(1 + N_FEATURES + N_FEATURES**2), 1: np.zeros(1 + N_FEATURES + N_FEATURES**2)}
    for r in rows.mapInArrow(moments, "quality int, place int, value double").groupBy("quality", "place").agg(F.sum("value").alias("value")).collect():
        out[r["quality"]][r["place"]] = r["value"]
    return solve({k: (v[0], v[1 : 1 + N_FEATURES], v[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES)) for k, v in out.items()})


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([model.scores(matrix(texts.iloc[i : i + 512])) for i in range(0, len(texts), 512)]) if len(texts) else np.zeros(0))

    return of(text.cast("string"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id"), score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= LIMIT, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at least LIMIT, with all their columns."""
    return docs.where(score(fit(docs, labels), F.col("text")) >= LIMIT)
