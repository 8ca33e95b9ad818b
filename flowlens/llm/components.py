"""Connected components of an edge table, without collecting anything.

Every node starts with the smallest key among itself and its neighbours; each
round takes the smallest label among the neighbours and then the label of that
label (pointer jumping), until a round changes nothing.  Groups are combined by
partial aggregation, so a node with very many neighbours is no hot key, and
every round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of the component, for every node with an edge."""
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialise(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = materialise(
        both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other")
            .groupBy("node").agg(F.min("near").alias("near"))
        )
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("jump"))
        new = materialise(
            stepped.join(jump, "step", "left")
            .select("node", F.least("step", F.coalesce("jump", "step")).alias("label"), F.col("label").alias("old"))
        )
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
