"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.staging import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (long columns a and b); the component is its smallest node.

    Each round, a node hands the least label it knows to its neighbours, and labels jump to their own label, so that
    chains shrink by half. Rounds end when no label changes.
    """
    edges = materialise(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("label", "heard").alias("label"))
        jump = near.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = materialise(near.join(jump, near["label"] == jump["at"]).select("node", F.least("label", "further").alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").where("label < old").limit(1).count()
        discard(labels)
        labels = after
        if not changed:
            discard(edges)
            return labels.select("node", F.col("label").alias("component"))
