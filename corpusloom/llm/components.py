"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import drop_table, write_table


def connected_components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """links: a, b (long). Returns node, component: the smallest node that links lead to. Nodes without links are not in it. tasks: how many write a table at most."""
    edges = write_table(links.select("a", "b").where("a <> b").distinct(), "cc-edges", tasks=tasks)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels", tasks=tasks)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        lower = write_table(lower, "cc-lower", tasks=tasks)
        root = lower.select(F.col("node").alias("root"), F.col("low").alias("root_low"))
        jumped = lower.join(root, F.col("low") == F.col("root"), "left").select("node", "was", F.least("low", F.coalesce("root_low", "low")).alias("component"))
        jumped = write_table(jumped, "cc-labels", tasks=tasks)
        done = jumped.where("was <> component").isEmpty()
        drop_table(lower)
        drop_table(labels)
        labels = jumped
        if done:
            drop_table(edges)
            return labels.select("node", "component")
