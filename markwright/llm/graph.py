"""Connected components of a link table by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links: component is the smallest node that can be reached.

    Each round a node takes the smallest label around it and then its label's label, so long chains shrink by half at
    least; every round is written to the shared folder. An empty link table gives an empty result; self links and
    repeated links change nothing.
    """
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = cut(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("component")))
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
