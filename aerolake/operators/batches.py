"""Seeded batch plans: which sample goes to which batch, with which shared features, on which rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import grouped_rank, grouped_running_sum
from aerolake.session import materialize

# fixed value: added to the epoch to seed a plan
EPOCH_SEED = 777


def _features(pools: Sequence[int], seed: int, *key: str) -> Column:
    """One feature index per pool, drawn once per batch."""
    return F.array(*[F.floor(L.uniform(seed + 1 + i, *key) * p).cast("int") for i, p in enumerate(pools)])


def _shuffled(samples: DataFrame, key: str, seed: int) -> DataFrame:
    return grouped_rank(samples.withColumn("__h", L.uniform(seed, key)), [], ["__h", key], "rn").drop("__h")


def _size_of(sizes: Mapping[int, int], feature: Column) -> Column:
    pairs = [v for k, n in sizes.items() for v in (F.lit(int(k)), F.lit(max(1, int(n))))]
    return F.coalesce(F.element_at(F.create_map(*pairs), feature), F.lit(1))


def plan_batches(samples: DataFrame, key: str, batch: int, pools: Sequence[int], world: int, epoch: int,
                 drop_last: bool = False) -> DataFrame:
    """Shuffle, cut into batches of a fixed size with shared features, and slice whole batches over ranks.

    Columns: rank, batch, pos, the sample key, features. ``drop_last`` keeps a multiple of batch * world.
    """
    seed = EPOCH_SEED + epoch
    total = samples.count()
    if drop_last:
        total -= total % (batch * world)
    per_rank = -(-total // (world * batch))
    rows = _shuffled(samples.select(key), key, seed).where(F.col("rn") < total)
    rows = rows.withColumns({"batch": F.floor(F.col("rn") / batch), "pos": (F.col("rn") % batch).cast("int")})
    return rows.select(
        F.floor(F.col("batch") / max(1, per_rank)).cast("int").alias("rank"), "batch", "pos", key,
        _features(pools, seed, "batch").alias("features"))


def plan_dynamic_batches(samples: DataFrame, key: str, sizes: Mapping[int, int], pools: Sequence[int], scaling: int,
                         world: int, epoch: int, drop_last: bool = False, per_rank: int | None = None) -> DataFrame:
    """Batches whose size depends on the drawn scaling feature; ranks take turns.

    ``per_rank`` limits the number of batches of a rank, as a fixed epoch length does.
    """
    seed = EPOCH_SEED + epoch
    spark = samples.sparkSession
    total = samples.count()
    # no batch is smaller than the smallest size, which bounds how many are needed
    smallest = max(1, min([int(v) for v in sizes.values()] + ([] if set(range(pools[scaling])) <= set(sizes) else [1])))
    plan = spark.range(-(-total // smallest)).withColumnRenamed("id", "batch")
    plan = plan.withColumn("features", _features(pools, seed, "batch"))
    plan = plan.withColumn("size", _size_of(sizes, F.col("features")[scaling]).cast("long"))
    plan = grouped_running_sum(plan, [], ["batch"], "size", "lo").where(F.col("lo") < total)
    hi = F.col("lo") + F.col("size")
    plan = plan.where(hi <= total) if drop_last else plan.withColumn("size", F.least(hi, F.lit(total)) - F.col("lo"))
    if per_rank is not None:
        plan = plan.where(F.floor(F.col("batch") / world) < per_rank)
    slots = plan.select("batch", "features", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("pos"))
    slots = slots.withColumn("rn", F.col("lo") + F.col("pos"))
    rows = slots.join(_shuffled(samples.select(key), key, seed), "rn")
    return rows.select((F.col("batch") % world).cast("int").alias("rank"), "batch", F.col("pos").cast("int").alias("pos"), key, "features")


def hfov_bins(samples: DataFrame, edges: Sequence[float], value: str = "hfov") -> DataFrame:
    """``bin``: how many inner edges are at or below the value."""
    inner = [F.when(F.col(value) >= float(e), 1).otherwise(0) for e in edges[1:-1]]
    total = F.lit(0)
    for c in inner:
        total = total + c
    return samples.withColumn("bin", total)


def plan_balanced_batches(samples: DataFrame, key: str, pools: Sequence[int], world: int, epoch: int,
                          batch: int | None = None, sizes: Mapping[int, int] | None = None, scaling: int = 0,
                          per_rank: int | None = None) -> DataFrame:
    """Every batch draws from one bin of ``samples(key, bin)``; bins are visited in reshuffled rounds.

    A bin is drawn without replacement and reshuffled when used up. With a fixed ``batch`` the plan covers as many
    rows as there are samples, sliced over ranks; with ``sizes`` each rank gets ``per_rank`` batches in turn.
    """
    if (batch is None) == (sizes is None):
        raise ValueError("give either a batch size or sizes by feature")
    seed = EPOCH_SEED + epoch
    samples = samples.select(key, "bin").distinct()
    pool = materialize(samples.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "bins")
    n_bins = pool.count()
    total = samples.select(key).distinct().count()
    n_batches = -(-total // batch) if batch is not None else int(per_rank) * world
    last = -(-n_batches // max(1, n_bins)) - 1
    turn = pool.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    turn = turn.withColumn("__h", L.uniform(seed + 100, "round", "bin"))
    slot = F.row_number().over(Window.partitionBy("round").orderBy("__h", "bin")) - 1
    plan = turn.withColumn("batch", F.col("round") * n_bins + slot).where(F.col("batch") < n_batches)
    plan = plan.withColumn("features", _features(pools, seed, "batch"))
    size = F.lit(batch) if batch is not None else _size_of(sizes, F.col("features")[scaling])
    plan = plan.withColumn("size", size.cast("long"))
    if batch is not None:
        plan = plan.withColumn("lo", F.col("round") * batch)
    else:
        plan = grouped_running_sum(plan, ["bin"], ["round"], "size", "lo")
    plan = materialize(plan.select("batch", "bin", "n", "features", "size", "lo"), "plan")
    draws = plan.select("batch", "bin", "features", "n",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("pos"), "lo")
    draws = draws.withColumn("q", F.col("lo") + F.col("pos")).withColumns({
        "pass": F.floor(F.col("q") / F.col("n")), "at": F.col("q") % F.col("n")})
    passes = plan.groupBy("bin").agg(F.floor((F.max(F.col("lo") + F.col("size")) - 1) / F.max("n")).alias("last"))
    laps = samples.join(passes, "bin").select(key, "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("pass"))
    laps = grouped_rank(laps.withColumn("__h", L.uniform(seed + 200, "bin", "pass", key)), ["bin", "pass"], ["__h", key], "at")
    rows = draws.join(laps.select(key, "bin", "pass", "at"), ["bin", "pass", "at"])
    if batch is not None:
        rows = rows.where(F.col("batch") * batch + F.col("pos") < total)
        rank = F.floor(F.col("batch") / -(-total // (world * batch)))
    else:
        rank = F.col("batch") % world
    return rows.select(rank.cast("int").alias("rank"), "batch", F.col("pos").cast("int").alias("pos"), "bin", key, "features")
