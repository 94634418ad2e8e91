"""Components of what shares a token and passes a check, without all pairs of a crowded token.

Tokens of few classes give candidate pairs at once. For crowded ones pairs come in rounds. In a star round each token
names one class, the least by a hash of the round, and each class meets the classes that its tokens name; much alike
classes share most tokens, so they meet the same few. Of the pairs of other tokens, each class takes one. Pairs that
pass the check are links, classes that links connect are one component, and tokens of a single component are done
with. The last round takes every pair left whose components differ: for each crowded token, the classes outside its
main component against all, each pair at the first token only that both share. What may not link by sizes, places and
sketches is left out inside the join. So no link between components is lost. All tables between steps are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainloom.llm.common import Scratch
from trainloom.llm.components import components

#: A token of more classes is crowded.
FEW = 8
#: Star rounds before all pairs left are taken.
STARS = 3
#: How many tokens of a class before one are known with it, to tell whether two classes shared one of them.
BEFORE = 4
#: Labels, of two numbers each, that are broadcast; more are joined by shuffles. The result is the same.
FEW_LABELS = 500_000

Filter = Callable[[str, str], str]


def small(labels: DataFrame) -> DataFrame:
    """labels, to be broadcast if they are few."""
    return F.broadcast(labels) if labels.count() <= FEW_LABELS else labels


def with_before(rows: DataFrame, order: str) -> DataFrame:
    """rows (token, m, comp) with before in m: the BEFORE tokens that come before this one among its class's rows, in the order of a column of m or token that is the same for all classes."""
    own = Window.partitionBy("m.cid").orderBy(order)
    return rows.withColumn("m", F.col("m").withField("before", F.array_compact(F.array(*[F.lag("token", i + 1).over(own) for i in range(BEFORE)]))))


def distinct_pairs(x: Column, y: Column, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(x, y).alias("hub"), F.greatest(x, y).alias("other")).distinct()


def stars(open_: DataFrame, may_star: Filter, step: int) -> DataFrame:
    """Pairs (hub, other) of each class with the class that its token names in this round."""
    named = open_.groupBy("token").agg(F.min(F.struct(F.xxhash64("m.cid", F.lit(step)).alias("h"), "m", "comp")).alias("rep"))
    met = open_.join(named.select("token", F.col("rep.m").alias("r"), F.col("rep.comp").alias("rc")), "token")
    return distinct_pairs(F.col("m.cid"), F.col("r.cid"), met.where(f"comp <> rc and {may_star('m', 'r')}"))


def all_pairs(open_: DataFrame, may_link: Filter) -> DataFrame:
    """Pairs (hub, other) of different components that share a token and may link; each comes at its first shared token."""
    main = open_.groupBy("token").agg(F.min(F.struct(F.xxhash64("m.cid").alias("h"), "comp")).alias("main")).select("token", F.col("main.comp").alias("main"))
    every = open_.join(main, "token")
    s = every.where("comp <> main").select("token", F.col("m").alias("s"), F.col("comp").alias("cs"))
    t = every.select("token", F.col("m").alias("t"), F.col("comp").alias("ct"), "main")
    met = s.join(t, "token").where(f"cs <> ct and (ct = main or s.cid < t.cid) and {may_link('s', 't')} and not arrays_overlap(s.before, t.before)")
    return distinct_pairs(F.col("s.cid"), F.col("t.cid"), met)


def labelled(rows: DataFrame, id_: Column, labels: DataFrame | None, name: str = "comp") -> DataFrame:
    """rows and the component of id_: its own number where it has no links."""
    if labels is None:
        return rows.withColumn(name, id_)
    return rows.join(labels.toDF("_id", "_comp"), id_ == F.col("_id"), "left").withColumn(name, F.coalesce("_comp", id_)).drop("_id", "_comp")


def apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(hub, other, ch, co) of the pairs whose ends are not of one component."""
    own = None if labels is None else small(labels)
    return labelled(labelled(pairs, F.col("hub"), own, "ch"), F.col("other"), own, "co").where("ch <> co")


def merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp) after links (hub, other) between ids that may have labels already."""
    edges = apart(links, labels).select(F.least("ch", "co").alias("a"), F.greatest("ch", "co").alias("b")).distinct()
    now = components(edges, scratch, name)
    if labels is None:
        return now
    moved = labelled(labels.select("id", F.col("comp").alias("was")), F.col("was"), now)
    return scratch.save(moved.select("id", "comp").unionByName(now.join(labels, "id", "left_anti")), f"{name}-merged")


def connect(crowded: DataFrame, few: DataFrame, order: str, may_link: Filter, may_star: Filter, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, links: DataFrame | None = None, sketches: DataFrame | None = None) -> DataFrame | None:
    """(id, comp) of the classes that have links; None if there are none at all.

    crowded: token, and m, a struct with cid among others; the order of a class's tokens is that of token or a column of
    m. few: candidate pairs (hub, other) of the other tokens. may_star is SQL over two such structs; so is may_link, and
    of sketches (cid, bits), if given, m has bits there. verify gives those of pairs (hub, other) that link. links:
    (hub, other) that are known already.
    """
    labels = None if links is None else merged(None, links, scratch, "known")
    crowded, tried = crowded.select("token", "m"), None
    for step in range(STARS + 1):
        now = labelled(crowded, F.col("m.cid"), None if labels is None else small(labels))
        spread = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        open_ = scratch.save(now.join(spread, "token", "left_semi"), f"open{step}")
        few = few if tried is None else few.join(tried, ["hub", "other"], "left_anti")
        few = scratch.save(apart(few, labels).select("hub", "other"), f"few{step}")
        if step == STARS:
            last = with_before(open_, order)
            if sketches is not None:
                last = last.join(sketches, F.col("m.cid") == F.col("cid")).select("token", F.col("m").withField("bits", F.col("bits")).alias("m"), "comp")
            pairs = all_pairs(last, may_link).unionByName(few).distinct()
        else:
            pairs = stars(open_, may_star, step).unionByName(few.groupBy("other").agg(F.min("hub").alias("hub")).select("hub", "other")).distinct()
        pairs = scratch.save(pairs if tried is None else pairs.join(tried, ["hub", "other"], "left_anti"), f"pairs{step}")
        if pairs.limit(1).count():
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = scratch.save(verify(pairs), f"links{step}")
            if found.limit(1).count():
                labels = merged(labels, found, scratch, f"labels{step}")
        elif not open_.limit(1).count():
            break  # no token of several components, no pair untried
        crowded = open_.select("token", "m")
    return labels
