"""The table of clusters: order, selection, set operations on units, and tables of several sessions as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Short names of columns that users of curation tools know (fixed values).
ALIASES = {"id": "cluster_id", "n": "n_spikes", "fr": "firing_rate", "amp": "mean_amplitude", "isi": "isi_violations", "group": "label", "pr": "presence_ratio", "cont": "refractory_contamination"}


def column(name: str, table: DataFrame) -> str | None:
    """The column that a name or alias means, whatever its case; None if there is none."""
    wanted = ALIASES.get(name.lower(), name).lower()
    return next((c for c in table.columns if c.lower() == wanted), None)


def ranked(table: DataFrame, by: str, descending: bool) -> DataFrame:
    """table with place, its row in the order by a column; missing and NaN values are last either way, ties by id.

    Tables have a row a cluster, so one order of all rows is small.
    """
    kind = dict(table.dtypes)[by]
    x = F.col(by)
    last = x.isNull() | (F.isnan(x) if kind in ("double", "float") else F.lit(False))
    own = F.when(~last, x)
    order = Window.orderBy(last, own.desc() if descending else own.asc(), "cluster_id")
    return table.withColumn("place", F.row_number().over(order))


def between(table: DataFrame, by: str, descending: bool, first: int, last: int) -> DataFrame:
    """The rows from one cluster to another, both included, in the order shown."""
    rows = ranked(table, by, descending)
    ends = rows.where(F.col("cluster_id").isin(first, last)).agg(F.min("place").alias("a"), F.max("place").alias("b"))
    return rows.crossJoin(F.broadcast(ends)).where(F.col("place").between(F.col("a"), F.col("b"))).drop("a", "b")  # one row of ends


def label_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """cluster_id, label_a, label_b for every id from 0 to the largest; what lacks a label is unsorted."""
    both = a.toDF("cluster_id", "label_a").join(b.toDF("cluster_id", "label_b"), "cluster_id", "full")
    ids = both.agg(F.max("cluster_id").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("cluster_id"))
    return ids.join(both, "cluster_id", "left").fillna("unsorted", ["label_a", "label_b"])


def confusion(diff: DataFrame) -> DataFrame:
    return diff.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


def together(homes: DataFrame) -> DataFrame:
    """a, b (a < b): roots that have the same home unit."""
    x, y = homes.select(F.col("root").alias("a"), "home"), homes.select(F.col("root").alias("b"), "home")
    return x.join(y, "home").where("a < b").select("a", "b")


def pair_outcomes(truth: DataFrame, test: DataFrame) -> DataFrame:
    """a, b, outcome: hit, missed_merge or false_merge of the pairs that truth and test put together."""
    hits = truth.intersect(test).withColumn("outcome", F.lit("hit"))
    missed = truth.exceptAll(test).withColumn("outcome", F.lit("missed_merge"))
    return hits.unionByName(missed).unionByName(test.exceptAll(truth).withColumn("outcome", F.lit("false_merge")))


def pair_outcome_counts(truth: DataFrame, test: DataFrame) -> DataFrame:
    """outcome, n of pair_outcomes(together(truth), together(test)), from homes (root, home) and without the pairs.

    Roots of one home a side at most count by sizes: n roots that share homes make n (n - 1) / 2 pairs. A root of several
    rows makes pairs as often as homes agree; such ones are counted once for each distinct set of homes, against the sets that
    share one. Outcomes without a pair have no row.
    """
    # A home of a side is one value; null is none, and a null root is in no pair.
    rows = truth.select("root", "home", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(test.select("root", "home", F.lit(0).alias("x"), F.lit(1).alias("y"))).where("root is not null and home is not null")
    each = rows.groupBy("root", "home").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).groupBy("root")
    sets = each.agg(F.sort_array(F.collect_list(F.struct("home", "x", "y"))).alias("homes"), ((F.sum("x") <= 1) & (F.sum("y") <= 1)).alias("plain")).groupBy("homes", "plain").agg(F.count("*").alias("n"))
    sets = sets.withColumns({"at": F.expr("get(filter(homes, h -> h.x > 0), 0).home"), "bt": F.expr("get(filter(homes, h -> h.y > 0), 0).home")})
    plain = sets.where("plain")
    pairs = F.expr("sum(n) * (sum(n) - 1) div 2")
    size = lambda *by: plain.dropna(subset=by).groupBy(*by).agg(pairs.alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"))
    hit, x, y = size("at", "bt"), size("at"), size("bt")
    simple = hit.select(F.col("p").alias("hit")).crossJoin(x.select(F.col("p").alias("x"))).crossJoin(y.select(F.col("p").alias("y")))  # one row each
    simple = simple.select("hit", (F.col("x") - F.col("hit")).alias("missed_merge"), (F.col("y") - F.col("hit")).alias("false_merge"))
    # Sets of several rows against all that share a home, each two once; a set against itself has the pairs of its roots.
    sets = sets.select(F.to_json("homes").alias("s"), "plain", "n", F.explode("homes").alias("h"))
    left = sets.where("not plain").select("s", "n", "h")
    right = sets.select(F.col("s").alias("r"), F.col("plain").alias("p"), F.col("n").alias("m"), F.col("h").alias("k"))
    both = left.join(right, F.col("h.home") == F.col("k.home")).where("p or s <= r").groupBy("s", "r", "n", "m").agg(F.sum(F.col("h.x") * F.col("k.x")).alias("x"), F.sum(F.col("h.y") * F.col("k.y")).alias("y"))
    both = both.withColumn("pairs", F.expr("if(s = r, n * (n - 1) div 2, n * m)"))
    mixed = both.agg(F.sum(F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("pairs"))).alias("hit"), F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0)) * F.col("pairs")).alias("missed_merge"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0)) * F.col("pairs")).alias("false_merge"))
    total = simple.unionByName(mixed).agg(*[F.sum(c).alias(c) for c in ("hit", "missed_merge", "false_merge")])
    return total.unpivot([], ["hit", "missed_merge", "false_merge"], "outcome", "n").where("n > 0").select("outcome", F.col("n").cast("long").alias("n"))


def append_sessions(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """One table of several sessions' rows, with sid; raises ValueError where columns or types differ."""
    first = tables[0][1]
    out = None
    for sid, df in tables:
        if df.dtypes != first.dtypes:
            raise ValueError(f"{sid}: columns differ")
        own = df.withColumn("sid", F.lit(sid))
        out = own if out is None else out.unionByName(own)
    return out


def paired(features: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """features and targets side by side, one row for one; raises ValueError where a key is missing or repeated on a side."""
    for name, df in (("features", features), ("targets", targets)):
        if df.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"a key is repeated in {name}")
    lone = features.select(*keys).exceptAll(targets.select(*keys)).unionAll(targets.select(*keys).exceptAll(features.select(*keys)))
    if lone.limit(1).count():
        raise ValueError("a key is missing on a side")
    return features.join(targets, keys)


def unsplit(spikes: DataFrame, before: DataFrame) -> DataFrame:
    """spikes with the clusters that a snapshot (spike_idx, cluster_id) holds, where it holds them."""
    old = before.select("spike_idx", F.col("cluster_id").alias("_old"))
    return spikes.join(old, "spike_idx", "left").withColumn("cluster_id", F.coalesce("_old", "cluster_id")).drop("_old")


def overlap_10_90(spikes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, overlap: shared part of two clusters' 10 to 90 % ranges of amplitude, over the shorter range."""
    ends = spikes.groupBy("cluster_id").agg(F.percentile("amplitude", 0.1).alias("lo"), F.percentile("amplitude", 0.9).alias("hi"))
    both = pairs.join(ends.toDF("a", "la", "ha"), "a").join(ends.toDF("b", "lb", "hb"), "b")
    shared = F.greatest(F.lit(0.0), F.least("ha", "hb") - F.greatest("la", "lb"))
    short = F.least(F.col("ha") - F.col("la"), F.col("hb") - F.col("lb"))
    return both.select("a", "b", F.when(short > 0, shared / short).otherwise(0.0).alias("overlap"))


def as_of(left: DataFrame, right: DataFrame, by: str, t: str, value: str, block: int) -> DataFrame:
    """left with value, what the last row of right at or before its time has for the same key; null if there is none.

    Of right rows at one time the largest value counts. Rows are ordered within blocks of time, and what a block begins
    with comes from one row a key and block, so a crowded key is dealt to as many tasks as it has blocks.
    """
    kinds = dict(right.dtypes)
    own = left.select(by, t, F.lit(1).alias("_asks"), F.lit(None).cast(kinds[value]).alias("_v"), F.struct(*left.columns).alias("_row"))
    theirs = right.where(F.col(value).isNotNull()).select(by, t, F.lit(0).alias("_asks"), F.col(value).alias("_v"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("_row")).schema["_row"].dataType).alias("_row"))
    both = own.unionByName(theirs).withColumn("_block", F.floor(F.col(t) / F.lit(block)))
    inside = Window.partitionBy(by, "_block").orderBy(t, "_asks", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = both.groupBy(by, "_block").agg(F.max(F.when(F.col("_asks") == 0, F.struct(t, "_v"))).alias("_end"))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(by, "_block", F.last("_end", ignorenulls=True).over(before)["_v"].alias("_before"))
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(inside)).where("_asks = 1").join(ends, [by, "_block"])
    return found.select("_row.*", F.coalesce("_last", "_before").alias(value))


def inner_edges(edges: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The edges (a, b) both of whose ends are in members."""
    own = members.select(key).distinct()
    return edges.join(own.withColumnRenamed(key, "a"), "a", "left_semi").join(own.withColumnRenamed(key, "b"), "b", "left_semi").select(*edges.columns)


def nearest(points: DataFrame, x: float, y: float, reach: float) -> DataFrame:
    """The one of points (id, x, y) that is nearest to a place, if one is within reach; the least id on ties. One row at most."""
    away = F.hypot(F.col("x") - F.lit(x), F.col("y") - F.lit(y))
    best = points.select("id", away.alias("distance")).where(F.col("distance") <= reach).agg(F.min(F.struct("distance", "id")).alias("b"))
    return best.where("b is not null").select("b.id", "b.distance")


def threshold_failures(table: DataFrame, limits: dict[str, dict], missing_fails: tuple[str, ...] | None = None) -> Column:
    """Metrics whose limits a row breaks, by name: least (greater) and most (less) are allowed values, abs takes the absolute one.

    What is missing or not finite fails, or where missing_fails is given, only for the metrics that it names.
    """
    broken = []
    for metric, limit in limits.items():
        if metric not in table.columns:
            continue
        x = F.col(metric).cast("double")
        unknown = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        size = F.abs(x) if limit.get("abs") else x
        outside = F.lit(False)
        for name, wrong in (("greater", lambda v, b: v < b), ("less", lambda v, b: v > b)):
            if limit.get(name) is not None:
                outside = outside | wrong(size, F.lit(float(limit[name])))
        fails = F.when(unknown, F.lit(missing_fails is None or metric in missing_fails)).otherwise(outside)
        broken.append(F.when(fails, F.lit(metric)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def read_only(spark: SparkSession, sql: str, most: int = 1000) -> DataFrame:
    """The rows of one SELECT, `most` at most; ValueError for any other statement."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kind = plan.getClass().getSimpleName()
    if kind not in ("Project", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Filter", "UnresolvedWith", "Union", "UnresolvedHaving", "Deduplicate", "Except", "Intersect", "UnresolvedOrderBy", "Join", "SubqueryAlias"):
        raise ValueError(f"only a query may run, not {kind}")
    return spark.sql(sql).limit(most)
