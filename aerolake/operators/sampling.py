"""Voxel thinning, capped and stratified sampling, fusion, and dataset-level repeat and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import cap_per_group, first_per_group, grouped_rank, quantiles
from aerolake.operators.matching import apply_sim3_points
from aerolake.session import materialize

XYZ = ("x", "y", "z")
# fixed values
MIN_VOXEL = 0.01
FRAME_CAP_FACTOR = 1.5


def cell(c: str, size: float | Column) -> Column:
    """Integer grid index of a coordinate."""
    return F.floor(F.col(c) / size)


def with_cells(df: DataFrame, size: float | Column, axes: Sequence[str] = XYZ) -> DataFrame:
    return df.withColumns({"c" + a: cell(a, size) for a in axes})


def voxel_first(points: DataFrame, size: float | Column, by: Sequence[str], order: str = "point_id") -> DataFrame:
    """One original point per voxel: the one with the lowest id."""
    cells = ["cx", "cy", "cz"]
    return first_per_group(with_cells(points, size), [*by, *cells], [order]).select(*points.columns)


def voxel_mean(points: DataFrame, size: float | Column, by: Sequence[str], colors: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Mean position, rounded mean colour and count per voxel."""
    col = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.avg(c) + 0.5))).cast("int").alias(c)
    return with_cells(points, size).groupBy(*by, "cx", "cy", "cz").agg(
        *[F.avg(a).alias(a) for a in XYZ], *[col(c) for c in colors], F.count(F.lit(1)).alias("num"))


def adaptive_voxel(points: DataFrame, by: Sequence[str], fraction: float = 0.01) -> DataFrame:
    """Voxel edge per group: a fraction of twice the largest interquartile range, else of the full extent."""
    q = quantiles(points, by, list(XYZ), [0.25, 0.75], extra=[(F.max(a) - F.min(a)).alias("w" + a) for a in XYZ])
    iqr = F.greatest(*[F.col(f"{a}_q")[1] - F.col(f"{a}_q")[0] for a in XYZ])
    ext = F.when(iqr > 0, iqr * 2).otherwise(F.greatest("wx", "wy", "wz")) * fraction
    return q.select(*by, F.when(ext > 0, ext).otherwise(MIN_VOXEL).alias("voxel"))


def sample_cap(df: DataFrame, by: Sequence[str], n: int, key: Sequence[str], seed: int,
               finite: Sequence[str] = ()) -> DataFrame:
    """At most ``n`` rows per group without replacement, by seeded hash of ``key``; non-finite rows are left out."""
    for c in finite:
        df = df.where(L.finite(c))
    return cap_per_group(df, by, [L.uniform(seed, *key), *key], n)


def sample_two_stage(df: DataFrame, by: Sequence[str], frame: str, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """First a cap per frame of ceil(1.5 n / frames), then ``n`` per group."""
    frames = materialize(df.groupBy(*by).agg(F.countDistinct(frame).alias("__f")), "frames")
    per = F.greatest(F.lit(1), F.ceil(F.lit(n * FRAME_CAP_FACTOR) / F.col("__f")))
    stage = cap_per_group(df.join(frames, list(by)), [*by, frame], [L.uniform(seed, *key), *key], per)
    return cap_per_group(stage.drop("__f"), by, [L.uniform(seed + 1, *key), *key], n)


def stratified_sample(points: DataFrame, tile: Sequence[str], cells: Sequence[str], n: int, key: Sequence[str],
                      seed: int) -> DataFrame:
    """Up to ``n`` rows per tile, covering as many cells as possible first, then filling by seeded hash.

    One row per cell comes from a partial aggregate. The fill needs at most n further rows of a tile, and those
    are among the 2n rows of lowest hash, so no tile is gathered whole.
    """
    h = points.withColumn("__h", L.uniform(seed, *key))
    first = first_per_group(h, [*tile, *cells], ["__h", *key]).withColumn("__fill", F.lit(0))
    fill = cap_per_group(h, tile, ["__h", *key], 2 * n).join(
        first.select(*tile, *key), [*tile, *key], "left_anti").withColumn("__fill", F.lit(1))
    both = first.select(*fill.columns).unionByName(fill)
    return cap_per_group(both, tile, ["__fill", "__h", *key], n).select(*points.columns, F.col("__fill").alias("is_fill"))


def fuse_core(points: DataFrame, members: DataFrame, transforms: DataFrame, cap: int, voxel: float, seed: int = 0,
              frame: str = "frame", order: str = "point_id") -> DataFrame:
    """Points of the core frames of every chunk, moved by the chunk's transform, capped and voxel-thinned per chunk."""
    chunk = ["scene", "chunk_id"]
    core = members.where("role = 'core'").select(*chunk, frame)
    pts = points.join(core, [*chunk, frame], "left_semi")
    pts = apply_sim3_points(pts, transforms, chunk)
    return voxel_first(sample_cap(pts, chunk, cap, [order], seed, XYZ), voxel, chunk, order)


def coverage_fill(base: DataFrame, cand: DataFrame, grid: float, by: Sequence[str] = ("scene",),
                  order: str = "chunk_order") -> DataFrame:
    """Candidates in xy cells that the base leaves empty; of several chunks in a cell the first one fills it."""
    by = list(by)
    keys = [*by, "cx", "cy"]
    ok = L.finite("x") & L.finite("y") & L.finite("z")
    used = with_cells(base.where(ok), grid, ("x", "y")).select(*keys).distinct()
    c = with_cells(cand.where(ok), grid, ("x", "y"))
    owner = c.groupBy(*keys).agg(F.min(order).alias("__own")).join(used, keys, "left_anti")
    return c.join(owner, keys).where(F.col(order) == F.col("__own")).select(*cand.columns)


def fit_view_count(walks: DataFrame, by: Sequence[str], n: int, total: str, seed: int) -> DataFrame:
    """Exactly ``n`` views per seed walk of ``walks(by, pos, node, total)``; ``total`` is the number of views in the scene.

    A walk over all n views is shuffled; a short one is drawn from with replacement; otherwise it is kept.
    """
    by = list(by)
    size = walks.groupBy(*by).agg(F.count(F.lit(1)).alias("__len"), F.max(total).alias("__all"))
    full = (F.col("__len") == n) & (F.col("__all") == n)
    j = walks.join(size, by).where(F.col("__len") >= n)
    shuffled = cap_per_group(j, by, [F.when(full, L.uniform(seed, *by, "pos")).otherwise(0.0), "pos"], n, rank="__k")
    kept = shuffled.select(*by, (F.col("__k") - 1).cast("int").alias("slot"), "node")
    short = size.where(F.col("__len") < n).select(*by, "__len", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    short = short.withColumn("__pick", F.floor(L.uniform(seed + 1, *by, "slot") * F.col("__len")))
    idx = grouped_rank(walks.select(*by, "pos", "node"), by, ["pos"], "__pick")
    return kept.unionByName(short.join(idx, [*by, "__pick"]).select(*by, "slot", "node"))


def concat_datasets(parts: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Union with ``part`` and a global ``idx``: parts in the given order, rows by ``order`` inside a part."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return grouped_rank(out, [], ["part", *order], "idx")


def repeat_dataset(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """Every row ``k`` times in a row: index ``idx`` reads source row idx // k; ``rep`` is idx % k."""
    ranked = grouped_rank(df, [], order, "__i").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return ranked.withColumn("idx", F.col("__i") * k + F.col("rep")).drop("__i")


def resize_dataset(df: DataFrame, n: int, order: Sequence[str], key: Sequence[str], epoch: int, seed: int = 777) -> DataFrame:
    """``n`` rows: one permutation of the epoch, repeated as often as needed; ``rep`` is the repetition number."""
    ranked = grouped_rank(df.withColumn("__h", L.uniform(seed + epoch, *key)), [], ["__h", *order], "__i")
    size = max(1, ranked.count())
    reps = F.ceil((F.lit(n) - F.col("__i")) / size).cast("int")
    out = ranked.where(F.col("__i") < n).withColumn("rep", F.explode(F.sequence(F.lit(0), reps - 1)))
    return out.withColumn("idx", F.col("rep").cast("long") * size + F.col("__i")).drop("__i", "__h")


def split_by_hash(scenes: DataFrame, lists: DataFrame | None = None, name: str = "scene", skip: int = 8) -> DataFrame:
    """Split 'val' where the hexadecimal number after the first ``skip`` characters is a multiple of 10, else 'train'.

    Names that are not hexadecimal there go to 'train'; ``lists(name, split)`` overrides.
    """
    tail = F.substring(F.col(name), skip + 1, 16)
    # a decimal number is a multiple of 10 if its last digit is 0; the text form also covers the upper 64-bit half
    val = tail.rlike("^[0-9a-fA-F]+$") & F.conv(tail, 16, 10).endswith("0")
    out = scenes.withColumn("split", F.when(val, "val").otherwise("train"))
    if lists is None:
        return out
    over = lists.select(name, F.col("split").alias("__s")).dropDuplicates([name])
    return out.join(over, name, "left").withColumn("split", F.coalesce("__s", "split")).drop("__s")
