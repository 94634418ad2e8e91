"""Small query languages over a session's frames: probes, lists of ids, commands."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainloom.functions import trains as tr
from trainloom.operators import correlograms as co
from trainloom.operators import suggest

GRAMMAR = """acg C [win=50] [bin=1]
ccg A B [win=50] [bin=1]
compare A B
window C T0 T1
split C by=amp|time [at=X]
eval merge A B .."""

@dataclass(frozen=True)
class Probe:
    op: str
    ids: tuple[int, ...]
    numbers: dict[str, float] = field(default_factory=dict)
    by: str = ""


@dataclass(frozen=True)
class Form:
    """What a probe is made of: how many clusters, numbers after them, options with what they are without being given, and words to choose from."""

    clusters: int
    numbers: tuple[str, ...] = ()
    options: tuple[tuple[str, float | None], ...] = ()
    choices: tuple[str, ...] = ()


#: Probes, and what their numbers must fulfil: pairs of which the first is below the second, or equal to it where it may be.
CURVE = (("win", 50.0), ("bin", 1.0))
FORMS = {"acg": Form(1, options=CURVE), "ccg": Form(2, options=CURVE), "compare": Form(2), "window": Form(1, numbers=("start", "end")), "split": Form(1, options=(("at", None),), choices=("amp", "time"))}
RANGES = {"bin": lambda x: 0 < x["bin"] <= x["win"], "end": lambda x: 0 <= x["start"] < x["end"]}


def finite(text: str) -> float:
    if not math.isfinite(x := float(text)):
        raise ValueError(f"{text} is no finite number")
    return x


def parse(text: str) -> Probe:
    """A probe, or ValueError that says what is wrong. Windows and bins are in milliseconds, times in seconds."""
    if merge := re.fullmatch(r"\s*eval\s+merge((?:\s+\d+)+)\s*", text):
        ids = tuple(map(int, merge[1].split()))
        if len(set(ids)) == 1:
            raise ValueError("one cluster alone cannot be merged")
        return Probe("merge", ids)
    op, *words = text.split() or [""]
    form = FORMS.get(op)
    if form is None:
        raise ValueError(f"no probe is called '{op}'; there are:\n{GRAMMAR}")
    plain, named = [w for w in words if "=" not in w], dict(w.split("=", 1) for w in words if "=" in w)
    by = named.pop("by", "") if form.choices else ""
    if len(plain) != form.clusters + len(form.numbers) or named.keys() - dict(form.options) or (form.choices and by not in form.choices):
        raise ValueError(f"'{text}' is not of the form: {next(x for x in GRAMMAR.splitlines() if x.startswith(op))}")
    ids = tuple(map(int, plain[: form.clusters]))
    values = {k: finite(x) for k, x in zip(form.numbers, plain[form.clusters :], strict=True)}
    values |= {k: finite(named[k]) if k in named else x for k, x in form.options if k in named or x is not None}
    for k, holds in RANGES.items():
        if k in values and not holds(values):
            raise ValueError(f"{k} is out of range: {values}")
    if op == "ccg" and len(set(ids)) < 2:
        raise ValueError("a cluster's correlogram with itself is asked for by acg")
    return Probe(op, ids, values, by)


def run(spikes: DataFrame, probe: Probe, total: int, rate: float, refractory: int) -> DataFrame:
    """The answer to a probe as a small frame."""
    ticks = lambda ms: max(1, round(ms * rate / 1000))
    if probe.op in ("acg", "ccg"):
        reach = ticks(probe.numbers["win"])
        bins = 2 * max(1, round(probe.numbers["win"] / probe.numbers["bin"]))
        own = spikes.where(F.col("cluster_id").isin(*probe.ids))
        if probe.op == "acg":
            return co.auto_correlogram(own, reach, bins)
        return co.cross_correlogram(own, spikes.sparkSession.createDataFrame([probe.ids], "a long, b long"), reach, bins)
    if probe.op == "window":
        a, b = (round(probe.numbers[k] * rate) for k in ("start", "end"))
        own = spikes.where(F.col("cluster_id") == probe.ids[0])
        part = own.where((F.col("t") >= a) & (F.col("t") < b)).withColumn("t", F.col("t") - a)
        return tr.core_metrics(part, b - a, rate, refractory).withColumn("part", F.lit("window")).unionByName(tr.core_metrics(own, total, rate, refractory).withColumn("part", F.lit("whole")))
    if probe.op == "merge":
        own = spikes.where(F.col("cluster_id").isin(*probe.ids))
        return tr.core_metrics(own, total, rate, refractory).unionByName(tr.core_metrics(own.withColumn("cluster_id", F.lit(-1).cast("long")), total, rate, refractory))
    if probe.op == "split":
        own = spikes.where(F.col("cluster_id") == probe.ids[0])
        axis = F.col("amplitude") if probe.by == "amp" else F.col("t") / F.lit(rate)
        cut = F.lit(probe.numbers["at"]) if "at" in probe.numbers else F.lit(own.select(F.percentile(axis, 0.5)).first()[0])
        return tr.core_metrics(own.withColumn("cluster_id", F.when(axis > cut, 1).otherwise(0).cast("long")), total, rate, refractory)
    return suggest.summaries(spikes.where(F.col("cluster_id").isin(*probe.ids)), 1)


def cluster_list(text: str) -> list[int]:
    """Ids of a list such as "3 7, 10-12", in order; ValueError for anything else."""
    out: list[int] = []
    for word in re.split(r"[\s,]+", text.strip()):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", word)
        if not m or (m[2] and int(m[2]) < int(m[1])):
            raise ValueError(f"no cluster list: {word}")
        out += range(int(m[1]), int(m[2] or m[1]) + 1)
    return list(dict.fromkeys(out))


def isi_residuals(spikes: DataFrame, rate: float) -> DataFrame:
    """cluster_id, spike_idx, slope, residual: amplitudes less what the logarithm of the interval before explains, moved back to the mean; of clusters of nine spikes or more."""
    rows = tr.with_isi(spikes).where("isi > 0").withColumn("x", F.log(F.col("isi") * F.lit(1000.0 / rate)))
    fit = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.regr_slope("amplitude", "x").alias("slope"), F.avg("x").alias("mx")).where("n >= 8 and slope is not null")
    return rows.join(fit, "cluster_id").select("cluster_id", "spike_idx", "slope", (F.col("amplitude") - F.col("slope") * (F.col("x") - F.col("mx"))).alias("residual"))
