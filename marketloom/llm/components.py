"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); the root is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours and then its
    label's label, so long chains halve. Rounds are written to the shared folder;
    hot nodes are combined before the shuffle or split by adaptive execution.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other"))
    labels = stored(labels.select("node", F.least("node", "other").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("to"))
        nearer = stored(nearer, "labels")
        ahead = nearer.select(F.col("node").alias("via"), F.col("to").alias("there"))
        jumped = nearer.join(ahead, F.col("to") == F.col("via"))
        after = stored(jumped.select("node", F.col("root").alias("was"), F.col("there").alias("root")), "labels")
        labels = after.select("node", "root")
        if after.filter("was <> root").isEmpty():
            return labels
