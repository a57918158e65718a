"""Sharding by proportional stratified interleaving.

Rows of a source are put in a seeded random order; row ``r`` of ``n`` gets the fractional rank ``(2r + 1) / 2n``. Sorting
all rows by it interleaves the sources in proportion to their sizes everywhere, so cutting the sequence into equal runs
gives shards that each hold the mixture of the whole, and whose row counts differ by at most one.

Both ranks come from range-placed pieces (``grouped_rank``): a source with most of the rows is never in one task, and
only ids and small columns are shuffled.

Defined results: a NULL source is a source of its own; ties and repeated rows are ordered by id, and equal rows are
interchangeable; an empty table gives an empty result. Other columns are carried along if asked for, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.functions.ranking import grouped_rank
from aerolake.llm.common import shuffle_key
from aerolake.session import materialize


def interleave(docs: DataFrame, shards: int = 16, seed: int = 29, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, *keep, shard, slot): shard 0 .. shards-1, slot gapless from 0 within the shard."""
    rows = docs.select(
        "doc_id", "source", *keep, F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__src"),
        shuffle_key("doc_id", seed).alias("__key"))
    rows = grouped_rank(rows, ["__none", "__src"], ["__key", "doc_id"], "__r")
    # one pass of small rows: sizes per source, and the exact statistics the joins below are planned with
    rows = materialize(rows, "shard-ranks")
    sizes = materialize(rows.groupBy("__none", "__src").agg(F.count(F.lit(1)).alias("__n")), "shard-sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    rows = rows.join(sizes, ["__none", "__src"]).withColumn("__frac", (2 * F.col("__r") + 1) / (2 * F.col("__n")))
    rows = grouped_rank(rows, [], ["__frac", "__none", "__src", "doc_id"], "__at")
    # integer division keeps the cuts exact: shard k starts at the smallest g with g * shards div total = k
    return rows.select(
        "doc_id", "source", *keep, F.expr(f"int(__at * {shards} div {max(total, 1)})").alias("shard"), "__at",
    ).withColumn("slot", F.expr(f"__at - (shard * {total}L + {shards - 1}) div {shards}")).drop("__at")
