"""Threshold rules that label clusters, and threshold flags."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainloom.operators.filters import compare

LABELS = ("noise", "mua", "good", "unsorted")
OPS = ("<", "<=", ">", ">=", "==", "=", "!=")


@dataclass(frozen=True)
class Rule:
    """All of conditions (metric, op, threshold) give the label; an op that begins with "|" takes the absolute value."""

    label: str
    conditions: tuple[tuple[str, str, float], ...]
    name: str = ""


def known_label(text: str) -> str:
    """The label of a text in any case; ValueError for none."""
    if str(text).strip().lower() not in LABELS:
        raise ValueError(f"'{text}' is no label; labels are {', '.join(LABELS)}")
    return text.strip().lower()


def condition(entry: dict, metrics: tuple, name: str) -> tuple[str, str, float]:
    """(metric, op, threshold) of a table with metric, op and value."""
    metric, op, value = (entry.get(k) for k in ("metric", "op", "value"))
    if metric not in metrics:
        raise ValueError(f"{name}: '{metric}' is no metric")
    if str(op).removeprefix("|") not in OPS:
        raise ValueError(f"{name}: '{op}' does not compare")
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name}: {value} is no threshold")
    return metric, op, float(value)


def parse_rules(text: str, metrics: tuple) -> tuple[list[Rule], str | None]:
    """Rules and default label of a TOML text; ValueError for what is unknown.

    Each [[rule]] has metric, op, value and label; name is r and its number where it has none, and all = [{metric,
    op, value}, ...] are conditions that must hold too. default is the label of clusters that no rule fits.
    """
    data, rules = tomllib.loads(text), []
    for i, entry in enumerate(data.get("rule", [])):
        name = entry.get("name", f"r{i}")
        rules.append(Rule(known_label(entry.get("label")), tuple(condition(x, metrics, name) for x in (entry, *entry.get("all", ()))), name))
    return rules, known_label(data["default"]) if "default" in data else None


def holds(metric: Column, op: str, limit: float) -> Column:
    """NaN and null never hold."""
    x = metric.cast("double")
    x = F.abs(x) if op.startswith("|") else x
    return F.when(x.isNull() | F.isnan(x), F.lit(False)).otherwise(compare(x, op.lstrip("|"), F.lit(float(limit))))


def decide(rules: list[Rule]) -> Column:
    """Number of the first rule all of whose conditions hold, else null."""
    fires = [reduce(lambda a, b: a & b, [holds(F.col(m), op, x) for m, op, x in r.conditions]) for r in rules]
    return F.coalesce(*[F.when(f, F.lit(i)) for i, f in enumerate(fires)], F.lit(None).cast("int"))


def labelled(clusters: DataFrame, rules: list[Rule], default: str | None = None) -> DataFrame:
    """clusters with rule (number of the deciding rule) and new_label (its label, else the default, else label unchanged)."""
    label = F.get(F.array(*[F.lit(r.label) for r in rules]), F.col("rule"))
    return clusters.withColumn("rule", decide(rules)).withColumn("new_label", F.coalesce(label, F.lit(default), F.col("label")))


def changes(clusters: DataFrame, rules: list[Rule], default: str | None = None) -> DataFrame:
    """cluster_id, label, new_label, rule where a cluster with spikes gets another label."""
    return labelled(clusters.where("n_spikes > 0"), rules, default).where("label <> new_label").select("cluster_id", "label", "new_label", "rule")


def report(clusters: DataFrame, rules: list[Rule], default: str | None = None) -> DataFrame:
    """label, new_label, rule, n, ids (ascending, as runs): what the rules would do to clusters with spikes."""
    found = labelled(clusters.where("n_spikes > 0"), rules, default).groupBy("label", "new_label", "rule")
    return found.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("cluster_id")).alias("ids")).withColumn("ids", runs(F.col("ids")))


def near_threshold(clusters: DataFrame, rules: list[Rule], margin: float) -> DataFrame:
    """cluster_id, metric, op, threshold, ratio: values within margin interquartile ranges (nearest rank) of a threshold."""
    out = []
    live = clusters.where("n_spikes > 0")
    for m, op, x in dict.fromkeys(c for r in rules for c in r.conditions):
        value = F.abs(F.col(m)) if op.startswith("|") else F.col(m)
        ok = live.where(F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")))
        spread = ok.agg(F.array_sort(F.collect_list(F.col(m).cast("double"))).alias("v")).select((at_rank("v", 0.75) - at_rank("v", 0.25)).alias("iqr"))  # a value a cluster
        ratio = F.abs(value - F.lit(x)) / F.greatest(F.col("iqr"), F.lit(1e-30))
        out.append(ok.crossJoin(F.broadcast(spread)).select("cluster_id", F.lit(m).alias("metric"), F.lit(op).alias("op"), F.lit(x).alias("threshold"), ratio.alias("ratio")).where(F.col("ratio") <= margin))
    return reduce(lambda a, b: a.unionByName(b), out)


def at_rank(values: str, p: float) -> Column:
    """The value at rank round((n - 1) * p)."""
    return F.get(values, F.floor((F.size(values) - 1) * F.lit(p) + 0.5).cast("int"))


def runs(ids: Column) -> Column:
    """Ascending ids as text, runs as first-last: 1-3,7."""
    heads = F.filter(F.transform(ids, lambda x, i: F.when((i == 0) | (F.get(ids, i - 1) != x - 1), x)), lambda x: x.isNotNull())
    tails = F.filter(F.transform(ids, lambda x, i: F.when((i == F.size(ids) - 1) | (F.get(ids, i + 1) != x + 1), x)), lambda x: x.isNotNull())
    return F.array_join(F.zip_with(heads, tails, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))), ",")


def flags(limits: list[tuple[str, str, str, float]]) -> Column:
    """Codes of the limits (code, metric, op, threshold) that a cluster breaks, in their order."""
    return F.array_compact(F.array(*[F.when(holds(F.col(m), op, x), F.lit(code)) for code, m, op, x in limits]))


def flag_modes(flagged: DataFrame) -> DataFrame:
    """flag, n of flags that more than half of the clusters have."""
    total = flagged.agg(F.count("*").alias("total"))
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where("2 * n > total").select("flag", "n")


def flag_delta(flags_: Column, mode: list[str]) -> Column:
    """+X for flags beyond the mode, -X for those of it that lack; = for none."""
    usual = F.array(*map(F.lit, mode)).cast("array<string>")
    more = F.transform(F.array_except(flags_, usual), lambda x: F.concat(F.lit("+"), x))
    less = F.transform(F.array_except(usual, flags_), lambda x: F.concat(F.lit("-"), x))
    both = F.concat(more, less)
    return F.when(F.size(both) == 0, F.lit("=")).otherwise(F.array_join(both, ","))


def quantise(value: float, thresholds: list[float]) -> str:
    """The shortest text of two to seven significant digits that lies on the same side of every threshold."""
    if math.isnan(value):
        return "-"
    if not math.isfinite(value):
        return "inf" if value > 0 else "-inf"
    side = lambda x: [(x > t) - (x < t) for t in thresholds]
    for digits in range(2, 8):
        short = float(f"{value:.{digits - 1}e}")
        if side(short) == side(value):
            return f"{short:g}" if digits < 7 else repr(short)
    return repr(value)


def norm_label(text: Column) -> Column:
    """noise, mua or good by what a free text holds, else unsorted."""
    x = F.lower(F.trim(text))
    return F.when(F.contains(x, F.lit("noise")), "noise").when(F.contains(x, F.lit("mua")) | F.contains(x, F.lit("multi")), "mua").when(F.contains(x, F.lit("good")) | F.contains(x, F.lit("single")), "good").otherwise("unsorted")
