"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import write_table


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node in `links` (a, b: long).

    Each round, a node takes the smallest label around it and then that label's own label (pointer
    jumping), so stars settle in two rounds and chains in a logarithmic number. A round's labels are
    written to the shared folder. The neighbours' labels are reduced by a partial minimum, so a hub
    of many links is no hot spot.
    """
    links = write_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = write_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        hooked = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        roots = labels.select(F.col("node").alias("to"), F.col("component").alias("root"))
        step = write_table(hooked.join(roots, "to", "left").select("node", "was", F.least("to", F.coalesce("root", "to")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("component < was").isEmpty():
            return labels
