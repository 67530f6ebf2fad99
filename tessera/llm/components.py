"""Connected components of a link table by joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, keep


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id that can be reached) for every id in ``links`` (a, b). To be dropped by the caller.

    Each round takes the least label among the neighbours and then follows labels once more (pointer jumping), so long
    chains shrink by more than half a round. Aggregations by id combine on the map side and the joins are plain sort-merge joins, which
    Spark splits where one id has very many links.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = keep(both)
    labels = keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id").withColumn("moved", F.lit(False)))
    done = False
    while not done:
        old = labels.select("id", "component")
        near = edges.join(old.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = old.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        target = old.select(F.col("id").alias("new"), F.col("component").alias("jump"))
        new = F.least("new", F.coalesce("jump", "new"))
        step = step.join(target, "new", "left").select("id", new.alias("component"), (new < F.col("old")).alias("moved"))
        after = keep(step)
        drop(labels)
        labels, done = after, not after.where("moved").limit(1).count()
    drop(edges)
    return labels
