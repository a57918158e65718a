"""Ranks, caps, shifts and exact quantiles that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.session import materialize

_POS_BITS = 33
TASK_ROWS = 1_000_000


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by key over at least the session's shuffle partitions, and over more where a task would get too many."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // TASK_ROWS)), *keys)


def grouped_rank(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """Zero-based position of each row in its group under a total order; no group is gathered in one task.

    One range shuffle on (group, order) spreads any group over many partitions. A row's rank is its position
    inside its (partition, group) piece plus the sizes of the earlier pieces of the group.
    """
    by = list(by)
    placed = _placed(df, by, order, "rank")
    pieces = placed.groupBy("__part", *by).agg(F.min("__pos").alias("__lo"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return (
        _with_pieces(placed, pieces, by)
        .withColumn(out, F.col("__before") + F.col("__pos") - F.col("__lo"))
        .drop("__part", "__pos", "__lo", "__before")
    )


def cap_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int | Column, rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows of each group by ascending ``order`` (negate a key to sort it down); ``rank`` names their place, from 1.

    Rows are ranked in range-placed pieces, so neither a large group nor a large ``n`` ends up in one task.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    names = [f"__o{i}" for i in range(len(keys))]
    out = df.select("*", *[k.alias(a) for k, a in zip(keys, names)])
    rk = rank or "__rank"
    out = grouped_rank(out, by, names, rk).withColumn(rk, (F.col(rk) + 1).cast("int")).where(F.col(rk) <= n)
    return out.drop(*names, *([] if rank else [rk]))


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` per group, as a partial aggregate."""
    rest = [c for c in df.columns if c not in by]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*by).agg(row).select(*by, *[F.col("__row")[c].alias(c) for c in rest])


def shifted(df: DataFrame, by: Sequence[str], rank: str, k: int, cols: Sequence[str], prefix: str) -> DataFrame:
    """Join each row with the row ``k`` ranks later (earlier if negative) of its group; an equi-join on (group, rank)."""
    other = df.select(*by, (F.col(rank) - k).alias(rank), *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(other, [*by, rank], "left")


def quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], bounded: bool = False,
    extra: Sequence[Column] = (), derived: bool = False,
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group, one ``<col>_q`` array per column, plus ``n``.

    NULLs are ignored. Values are counted first, so repeated ones collapse before the shuffle; the distinct values of a
    group are range-placed, and running counts tell which of them hold the wanted positions. No group is in one task.
    ``bounded`` states that a group cannot outgrow one task (the pixels of one image, say) and uses ``percentile``.
    ``derived`` states that ``df`` comes from joins; it is written out once, so that they do not run twice. ``extra`` are
    further aliased aggregates of the same groups.
    """
    by, probs = list(by), [float(p) for p in probs]
    if bounded:
        aggs = [F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, probs))).alias(f"{c}_q") for c in cols]
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *extra, *aggs)
    if derived:
        df = materialize(df, "values")
    entry = lambda c: F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v"))
    long = df.select(*by, F.explode(F.array(*map(entry, cols))).alias("s")).select(*by, F.col("s.c").alias("__c"), F.col("s.v").alias("__v"))
    key = [*by, "__c"]
    counts = long.where(F.col("__v").isNotNull()).groupBy(*key, "__v").agg(F.count(F.lit(1)).alias("__n"))
    placed = _placed(counts, key, ["__v"], "value-counts")
    pieces = placed.groupBy("__part", *key).agg(F.sum("__n").alias("__s"))
    group = Window.partitionBy(*key)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({"__b": F.coalesce(F.sum("__s").over(before), F.lit(0)), "__t": F.sum("__s").over(group)}).drop("__s")
    inner = Window.partitionBy("__part", *key).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_pieces(placed.withColumn("__end", F.sum("__n").over(inner)), pieces, key).withColumn("__end", F.col("__b") + F.col("__end"))
    at = lambda p: F.lit(p) * (F.col("__t") - 1)
    wanted = [F.struct(F.lit(i).alias("i"), (at(p) - F.floor(at(p))).alias("f"), side(at(p)).alias("k"))
              for i, p in enumerate(probs) for side in (F.floor, F.ceil)]
    inside = lambda w: (w["k"] >= F.col("__end") - F.col("__n")) & (w["k"] < F.col("__end"))
    picked = rows.select(*key, "__v", F.explode(F.filter(F.array(*wanted), inside)).alias("w"))
    picked = picked.groupBy(*key, "w.i").agg((F.min("__v") + (F.max("__v") - F.min("__v")) * F.first("w.f")).alias("__q"))
    arrays = picked.groupBy(*by).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__c") == c, F.struct("i", "__q")))), lambda s: s["__q"]).alias(f"{c}_q")
        for c in cols])
    arrays = arrays.select(*[F.col(c).alias(f"__of_{c}") for c in by], *[F.when(F.size(f"{c}_q") > 0, F.col(f"{c}_q")).alias(f"{c}_q") for c in cols])
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *extra)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return total.join(arrays, same, "left").select(*total.columns, *[f"{c}_q" for c in cols])


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Rows range-placed by (group, order) with ``__pos`` in that order and ``__part``, the partition."""
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__pos", F.monotonically_increasing_id())
    return materialize(out, name).withColumn("__part", F.shiftright("__pos", _POS_BITS))


def _with_pieces(placed: DataFrame, pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what is known of their (partition, group) piece; NULL is a group of its own."""
    p = pieces.withColumnsRenamed({c: f"__of_{c}" for c in ["__part", *by]})
    same = F.col("__part") == F.col("__of___part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return placed.join(p, same).drop("__of___part", *[f"__of_{c}" for c in by])


def grouped_running_sum(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str, out: str
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group; windows only ever see one piece of a group."""
    by = list(by)
    placed = _placed(df, by, order, "running")
    before = lambda keys, o: Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("__part", *by).agg(F.sum(value).alias("__s"))
    pieces = pieces.withColumn("__b", F.coalesce(F.sum("__s").over(before(by or [F.lit(0)], "__part")), F.lit(0))).drop("__s")
    inner = F.coalesce(F.sum(value).over(before(["__part", *by], "__pos")), F.lit(0))
    return _with_pieces(placed.withColumn("__in", inner), pieces, by).withColumn(
        out, F.col("__b") + F.col("__in")).drop("__part", "__pos", "__b", "__in")


def surrounding(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str, prev: str, nxt: str
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row, and the first one after it, within the group.

    Pieces of a range-placed group are filled on their own; what crosses a piece border comes from one row per piece.
    """
    by = list(by)
    placed = _placed(df, by, order, "around")
    inner = Window.partitionBy("__part", *by).orderBy("__pos")
    has = F.col(value).isNotNull()
    pieces = placed.groupBy("__part", *by).agg(
        F.max_by(F.when(has, F.col(value)), F.when(has, F.col("__pos"))).alias("__last"),
        F.min_by(F.when(has, F.col(value)), F.when(has, F.col("__pos"))).alias("__first"))
    outer = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part")
    pieces = pieces.withColumns({
        "__prev": F.last("__last", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1)),
        "__next": F.first("__first", ignorenulls=True).over(outer.rowsBetween(1, Window.unboundedFollowing)),
    }).drop("__last", "__first")
    near = placed.withColumns({
        prev: F.last(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)),
        nxt: F.first(value, ignorenulls=True).over(inner.rowsBetween(1, Window.unboundedFollowing)),
    })
    return _with_pieces(near, pieces, by).withColumns({
        prev: F.coalesce(F.col(prev), F.col("__prev")), nxt: F.coalesce(F.col(nxt), F.col("__next")),
    }).drop("__part", "__pos", "__prev", "__next")
