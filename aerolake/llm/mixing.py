"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source wants ``weight / sum(weights)`` of the mix but is clamped at ``max_epochs`` times its own size; what a
clamped source leaves over goes to the others in proportion to their weights, until none is above its clamp. The fixed
point is found in one pass over the sources ordered by clamp / weight, a table of one row per source.

A source with target ``t`` and size ``s`` is repeated ``floor(t / s)`` times as a whole. The rest, ``t - floor(t / s) * s``
words, is taken from its documents in a seeded random order until it is used up, so a source meets its target to the
word; at most one document per source is taken in part. The running sum behind that is range-placed by (source, order
key), so a source with most of the rows is spread over many tasks.

Defined results: a NULL text has size 0, a NULL source is a source of its own and comes last, repeated rows count as
often as they occur, sources without words get target 0, an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions.ranking import grouped_running_sum
from aerolake.llm.common import shuffle_key, word_count
from aerolake.session import materialize


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """One row per source with ``source_no``, ``weight`` and ``target`` from rows (source, source_size).

    ``weights`` repeat over the sources by code point, NULL last. ``share`` times all sizes are dealt out; it must not
    exceed ``max_epochs``. The windows run over one row per source.
    """
    if share > max_epochs:
        raise ValueError("share above max_epochs: no mix can meet it")
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("source_no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumns({"weight": w, "__cap": F.lit(float(max_epochs)) * F.col("source_size")})
    order = every.orderBy(F.col("__cap") / F.col("weight"), "source_no")
    rows = rows.withColumns({
        "__total": F.lit(float(share)) * F.sum("source_size").over(every),
        "__caps_before": F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "__weight_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    full = F.col("__cap") / F.col("weight") * F.col("__weight_left") <= F.col("__total") - F.col("__caps_before")
    rows = rows.withColumn("__full", full)
    rest = F.col("__total") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(every), F.lit(0.0))
    left = F.sum(F.when(~F.col("__full"), F.col("weight"))).over(every)
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least("__cap", rest * F.col("weight") / left))
    return rows.withColumn("target", target).select("source", "source_no", "weight", "source_size", "target")


def plan_mix(
    docs: DataFrame, seed: int = 17, size: Column | None = None, weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5, max_epochs: float = 2.0,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, whole (repetitions), extra (words of a further one), taken.

    ``__before`` and ``__budget`` place a document in the seeded order of its source: words before it, and words that the
    fractional repetition takes.
    """
    size = word_count("text") if size is None else size
    rows = materialize(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    budget = F.round("target").cast("long") - whole * F.col("source_size")
    targets = materialize(targets.withColumns({"whole": whole, "__budget": budget}), "mix-targets")
    t = targets.withColumnRenamed("source", "__source")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "weight")
    rows = rows.withColumn("__key", shuffle_key("doc_id", seed))
    rows = grouped_running_sum(rows, ["source_no"], ["__key", "doc_id"], "size", "__before")
    extra = F.least(F.greatest(F.col("__budget") - F.col("__before"), F.lit(0)), F.col("size"))
    return rows.withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))


def mix(docs: DataFrame, seed: int = 17, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
        max_epochs: float = 2.0) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the plan repeats it; same columns.

    A document that the fractional repetition cuts is repeated once more if at least half of it is taken. Texts are not
    shuffled: the plan comes down to one boundary (order key, doc_id) per source, which is joined to the documents.
    """
    plan = plan_mix(docs, seed, None, weights, share, max_epochs)
    inside = F.col("__before") + F.col("size") / 2 <= F.col("__budget")
    edges = plan.groupBy("source").agg(
        F.max("whole").alias("__whole"),
        F.max(F.when(inside & (F.col("__budget") > 0), F.struct("__key", "doc_id"))).alias("__edge"))
    edges = materialize(edges, "mix-edges").withColumnRenamed("source", "__source")
    at = F.struct(shuffle_key("doc_id", seed).alias("__key"), F.col("doc_id"))
    more = F.coalesce(at <= F.col("__edge"), F.lit(False)).cast("int")
    rows = docs.join(edges, F.col("source").eqNullSafe(F.col("__source")))
    copies = F.sequence(F.lit(1), (F.col("__whole") + more).cast("int"))
    rows = rows.where(F.col("__whole") + more > 0).withColumn("__copy", F.explode(copies))
    return rows.select(*docs.columns)
