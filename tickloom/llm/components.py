"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of `edges` (columns a and b); component is the smallest id that can be reached.

    Each round takes the least label among the neighbours and then the label of that label, so that long chains need few
    rounds; a round's table is written to the shared folder. Nulls are ignored, repeated edges and loops do no harm, an
    empty table gives an empty table.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(max_rounds):
        near = (both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near")))
        hooked = (labels.join(near, labels.id == near.a, "left")
                  .select("id", F.col("component").alias("before"), F.least("component", F.coalesce("near", "component")).alias("component")))
        hooked = materialize(hooked)
        to = hooked.select(F.col("id").alias("via"), F.col("component").alias("jump"))
        labels = materialize(hooked.join(to, hooked.component == to.via, "left")
                             .select("id", "before", F.least("component", F.coalesce("jump", "component")).alias("component")))
        if labels.where("component <> before").limit(1).count() == 0:
            return labels.select("id", "component")
        labels = labels.select("id", "component")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
