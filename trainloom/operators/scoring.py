"""Comparing clusterings and predictions: contingency, recovery, agreement, classification and regression scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: one partial count a pair of units."""
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cube(rows: DataFrame, root: str, truth: str, test: str) -> DataFrame:
    """root, truth, test, level, n for every grouping of the three clusterings that the comparison needs."""
    sets = [[root, truth, test], [root, truth], [root, test], [truth, test], [root], [truth], [test]]
    base = rows.groupBy(root, truth, test).agg(F.count("*").alias("n"))
    grouped = base.groupingSets([[F.col(c) for c in s] for s in sets], F.col(root), F.col(truth), F.col(test))
    return grouped.agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))


def overlaps(table: DataFrame) -> DataFrame:
    """table (a, b, n) with size_a, size_b and jaccard."""
    sizes_a = table.groupBy("a").agg(F.sum("n").alias("size_a"))
    sizes_b = table.groupBy("b").agg(F.sum("n").alias("size_b"))
    out = table.join(sizes_a, "a").join(sizes_b, "b")
    return out.withColumn("jaccard", F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n")))


def recovery(table: DataFrame, labels_a: DataFrame, labels_b: DataFrame, least: float, keep: list[str]) -> DataFrame:
    """One row: kept units and hits of both sides, precision, recall. A hit has a Jaccard of at least `least` and the same kept label."""
    both = overlaps(table).join(labels_a.toDF("a", "label_a"), "a", "left").join(labels_b.toDF("b", "label_b"), "b", "left").fillna("unsorted", ["label_a", "label_b"])
    hit = (F.col("jaccard") >= least) & (F.col("label_a") == F.col("label_b")) & F.col("label_a").isin(keep)
    counts = both.agg(
        F.count_distinct(F.when(F.col("label_a").isin(keep), F.col("a"))).alias("units_a"),
        F.count_distinct(F.when(F.col("label_b").isin(keep), F.col("b"))).alias("units_b"),
        F.count_distinct(F.when(hit, F.col("a"))).alias("hits_a"),
        F.count_distinct(F.when(hit, F.col("b"))).alias("hits_b"),
    )
    return counts.withColumn("recall", F.col("hits_a") / F.nullif("units_a", F.lit(0))).withColumn("precision", F.col("hits_b") / F.nullif("units_b", F.lit(0)))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row, ari; 1 where both clusterings are one unit, or all units single."""
    two = lambda x: x * (x - 1) / F.lit(2.0)
    cells = table.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    one = cells.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.col("sa") * F.col("sb") / two(F.col("total"))
    most = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def agreement(pairs: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """One row: n, n_agree, observed, expected, kappa (NaN where all agreement is expected)."""
    x, y = F.coalesce(F.col(a), F.lit("unsorted")), F.coalesce(F.col(b), F.lit("unsorted"))
    share = lambda c, v: F.avg(F.when(c == v, 1.0).otherwise(0.0))
    expected = sum((share(x, v) * share(y, v) for v in labels), F.lit(0.0))
    out = pairs.agg(F.count("*").alias("n"), F.sum(F.when(x == y, 1).otherwise(0)).alias("n_agree"), expected.alias("expected"))
    out = out.withColumn("observed", F.col("n_agree") / F.col("n"))
    return out.withColumn("kappa", F.when(F.abs(1 - F.col("expected")) < 1e-12, F.lit(float("nan"))).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def home(table: DataFrame) -> DataFrame:
    """a, home, share: the unit b that holds most of each a (the least one on ties)."""
    best = table.groupBy("a").agg(F.sum("n").alias("_total"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("h"))
    return best.select("a", F.col("h.b").alias("home"), (-F.col("h.less") / F.col("_total")).alias("share"))


def root_verdicts(table: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """root, n_spikes, verdict, n_good, good_share: what the truth (b, label) made of each root a.

    Units labelled good of at least `least` spikes are good, other good and noise spikes noise. noise: nothing
    else; kept: one good unit has 9 in 10; cores: good units have less than half and noise the rest; cleanup: at
    least half, and noise a tenth or more of what is left; else other.
    """
    rows = table.join(labels.toDF("b", "label"), "b", "left").fillna("unsorted", ["label"])
    good = (F.col("label") == "good") & (F.col("n") >= least)
    noise = F.col("label").isin("good", "noise") & ~good
    sums = rows.groupBy("a").agg(
        F.sum("n").alias("n_spikes"), F.sum(F.when(good, 1).otherwise(0)).alias("n_good"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("g"),
        F.coalesce(F.max(F.when(good, F.col("n"))), F.lit(0)).alias("best"), F.sum(F.when(noise, F.col("n")).otherwise(0)).alias("x"),
    ).where(F.col("n_spikes") >= least)
    n, g, x = F.col("n_spikes"), F.col("g"), F.col("x")
    verdict = (
        F.when(x == n, "noise").when(F.col("best") / n >= 0.9, "kept").when((g > 0) & (g / n < 0.5) & (g + x == n), "cores")
        .when((g / n >= 0.5) & (x / n >= 0.1) & (g + x == n), "cleanup").otherwise("other")
    )
    return sums.select(F.col("a").alias("root"), "n_spikes", verdict.alias("verdict"), "n_good", (g / n).alias("good_share"))


def classification(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1 of each class that occurs (0 where undefined)."""
    table = contingency(rows, truth, predicted)
    t = table.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("support"))
    p = table.groupBy(F.col("b").alias("class")).agg(F.sum("n").alias("said"))
    hit = table.where("a = b").select(F.col("a").alias("class"), F.col("n").alias("hit"))
    out = t.join(p, "class", "full").join(hit, "class", "left").fillna(0)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    pr, rc = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    return out.select("class", "support", pr.alias("precision"), rc.alias("recall"), ratio(2 * pr * rc, pr + rc).alias("f1"))


def classification_summary(per_class: DataFrame) -> DataFrame:
    """One row: balanced_accuracy over the classes that truly occur, macro_f1 over all."""
    return per_class.agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def average_rank(x: str, by: list[str] | None = None) -> Column:
    """Rank of x, ties sharing the mean of their ranks."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(w.partitionBy(*(by or [F.lit(0)]), x)) - 1) / 2


def regression(rows: DataFrame, truth: str, predicted: str, by: list[str]) -> DataFrame:
    """by, n, r2, spearman, bias, rmse of each group; ranks need a group's rows in order."""
    ranked = rows.withColumn("_rt", average_rank(truth, by)).withColumn("_rp", average_rank(predicted, by))
    e = F.col(predicted) - F.col(truth)
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), (1 - F.sum(e * e) / F.nullif(F.var_pop(truth) * F.count("*"), F.lit(0.0))).alias("r2"), F.corr("_rt", "_rp").alias("spearman"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return out


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, weight: n / (classes * count)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("n"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("n") / (F.col("classes") * F.col("k"))).alias("weight"))


def percentile_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with pct, the share of the group's values that are no larger, and mid, that of smaller ones and half of the equal ones."""
    w = Window.partitionBy(*by)
    below = F.rank().over(w.orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(*by, value))
    return rows.withColumn("pct", F.cume_dist().over(w.orderBy(value))).withColumn("mid", (below + 0.5 * equal) / F.count("*").over(w))


def top_hits(rows: DataFrame, group: str, order: str, score: str, hit: str) -> DataFrame:
    """group, top1 (whether the row of the best score is a hit; the first row on ties), oracle (whether any is)."""
    best = rows.groupBy(group).agg(F.max_by(hit, F.struct(F.col(score), -F.col(order))).alias("top1"), F.max(hit).alias("oracle"))
    return best


def assign_folds(groups: DataFrame, name: str, size: str, folds: int) -> DataFrame:
    """name, fold: groups by falling size (then name), each to the fold that holds least so far.

    A running least-loaded choice depends on all groups before, so the groups' sizes (one row a group, not the
    rows of the groups) are dealt with in one task.
    """
    rows = groups.select(F.col(name).cast("string").alias("name"), F.col(size).cast("long").alias("size")).coalesce(1).sortWithinPartitions(F.desc("size"), "name")

    def deal(batches):
        load = [0] * folds
        for b in batches:
            out = []
            for k in b["size"]:
                f = min(range(folds), key=lambda i: (load[i], i))
                load[f] += int(k)
                out.append(f)
            yield b.assign(fold=out)[["name", "fold"]]

    return rows.mapInPandas(deal, "name string, fold int")
