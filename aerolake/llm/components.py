"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node that is reachable. Repeated links and
    links of a node with itself count for nothing, links with a NULL end are left out, other columns are ignored; without
    links the result is empty.

    Links stay in tables: each step is a partial aggregate and a join, written to the shared folder, so a node with most
    of the links is spread over tasks and a lost executor costs its tasks only. Stops when a step changes nothing.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    edges, mark = _written(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        # large star: neighbours above a node are hung under its smallest neighbour, or under itself
        low = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        hung = both.where("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        # small star: a node and its smaller neighbours are hung under the smallest of them
        low = hung.groupBy("v").agg(F.min("m").alias("low"))
        rest = hung.join(low, "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        edges, now = _written(low.select("v", F.col("low").alias("m")).unionAll(rest).distinct())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("m").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("v").alias("node"), F.col("m").alias("component")).unionAll(roots)


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = materialize(edges, "links")
    return edges, tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(v, m))")).first())
