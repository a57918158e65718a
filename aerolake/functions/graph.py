"""Connected components of many graphs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, other: str) -> DataFrame:
    """(*by, node, comp) for the distinct rows of ``nodes``; comp is the smallest node that is reachable.

    ``edges`` (*by, node, other) hold both directions. Each round, all nodes of one label take the smallest label next to any
    of them, and labels then point to the labels of their labels: the number of rounds grows with the logarithm of the
    longest path. Aggregates and joins of tables; a node with most of the edges is pre-aggregated.
    """
    by = list(by)
    state = materialize(nodes.select(*by, node).distinct().withColumn("comp", F.col(node)), "labels")
    edges = edges.select(*by, node, F.col(other).alias("__other"))
    while True:
        seen = edges.join(state.withColumnsRenamed({node: "__other", "comp": "__c"}), [*by, "__other"])
        near = seen.groupBy(*by, node).agg(F.min("__c").alias("__m"))
        cand = state.join(near, [*by, node], "left").withColumn("__m", F.least("comp", "__m"))
        low = cand.groupBy(*by, "comp").agg(F.min("__m").alias("__low"))
        hung = materialize(state.join(low, [*by, "comp"]).select(*by, node, F.col("comp").alias("__was"), F.col("__low").alias("comp")), "labels")
        above = hung.select(*by, F.col(node).alias("comp"), F.col("comp").alias("__up"))
        new = materialize(hung.join(above, [*by, "comp"]).select(*by, node, F.col("__up").alias("comp"), "__was"), "labels")
        if new.where("comp <> __was").isEmpty():
            return new.drop("__was")
        state = new.drop("__was")
