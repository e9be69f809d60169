"""Connected components by label propagation with pointer jumping, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that a link touches; the component is its smallest vertex.

    Each round takes the smallest label among the neighbours, then the label of the
    label, so paths halve.  Labels and links stay in tables; the driver only sees the
    number of labels that changed.
    """
    pairs = links.select(F.col(a).alias("v"), F.col(b).alias("w")).where("v <> w")
    edges = materialize(pairs.unionByName(pairs.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct(), "cc-edges")
    label = materialize(edges.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("l")), "cc-labels")
    while True:
        near = edges.join(label.select(F.col("v").alias("w"), F.col("l").alias("m")), "w").groupBy("v").agg(F.min("m").alias("m"))
        low = materialize(label.join(near, "v").select("v", F.col("l").alias("was"), F.least("l", "m").alias("l")), "cc-low")
        up = low.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        label = materialize(low.join(up, "l", "left").select("v", "was", F.least("l", "ll").alias("l")), "cc-labels")
        if label.where("was <> l").isEmpty():
            return label.select(F.col("v").alias("id"), F.col("l").alias("component"))
