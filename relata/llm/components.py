"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.store import cut, free, same_table


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): the smallest id that can be reached.

    Each round takes the smallest label among an id's neighbours and then the label of that label, so that
    long chains shrink fast. Minima are pre-aggregated: an id with very many links is no burden to one task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.where("a <> b"))
    before = labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("id").alias("least"), F.col("label").alias("jumped"))
        new = cut(least.join(jump, "least", "left").select("id", F.least("least", F.coalesce("jumped", "least")).alias("new"), "label"))
        done = new.where("new <> label").isEmpty()
        free(labels, before)
        if done:
            free(edges)
            return same_table(new, new.select("id", F.col("label").alias("component")))
        before, labels = new, new.select("id", F.col("new").alias("label"))
