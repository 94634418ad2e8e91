"""Connected components of a graph as frames: labels fall to the least in reach, by neighbours and by pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """(id, comp) for each id that stands in links (a, b): comp is the least id in reach.

    Each round takes the least label of all neighbours and then the label of one's label; long chains shrink by
    half a round or more, so rounds grow with the logarithm of a component's width. Every round's table is
    written, so a lost executor costs that round's tasks only. Counts alone come to the driver.
    """
    both = scratch.save(links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("c")), "to").groupBy("id").agg(F.min("c").alias("c"))
        lower = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = scratch.save(lower.join(jump, "comp").select("id", "was", F.least("comp", "next").alias("comp")), f"{name}-{step}")
        moved = new.where("was <> comp").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("id", "comp")
        if not moved:
            return labels
