"""Connected components of a table of links, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import written_ids as written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that links lead to.

    Every round takes the least label among a node and its neighbours and then follows that label's own label once; a
    chain of n nodes is done in about log n rounds.  Each round is written to the shared folder.  A node with very many
    links is pre-aggregated before it is shuffled; no links give an empty table.
    """
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")).filter("node <> to").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        after = written(step.join(jump, "low", "left").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") < F.col("component")).alias("moved")), "labels")
        labels = after.select("node", "component")
        if after.filter("moved").isEmpty():
            return labels
