"""Connected components of a table of links, by minimum labels and pointer jumping. Nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.llm.common import few_parts, stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), a written table, -> (node, comp): the smallest node reachable, for every node that has a link.

    Each round takes the least label among the neighbours and then that label's own label, so the rounds grow with the logarithm of
    the longest path. Every round is written to the shared folder. Neighbours are reduced before the shuffle, so a node with very many links
    costs as many rows as there are tasks.
    """
    rows = 2 * links.count()
    both = stored(few_parts(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), rows), "links")
    labels = stored(few_parts(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), rows), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        found = lower.join(jump, "low").select("node", F.least("low", "far").alias("comp"), (F.least("low", "far") != F.col("comp")).alias("changed"))
        found = stored(few_parts(found, rows), "labels")
        labels = found.select("node", "comp")
        if not found.where("changed").take(1):
            return labels
