"""Transform fits over correspondences: moments as one aggregate, a 3x3 solve per group row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.functions import linalg as L
from aerolake.functions.hashing import uniforms
from aerolake.functions.ranking import cap_per_group, grouped_rank, quantiles
from aerolake.session import materialize

SRC = ("sx", "sy", "sz")
DST = ("dx", "dy", "dz")
EYE = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
# fixed values of the fits
EPS = 1e-12
MIN_BASELINE = 1e-8
MIN_RATIO = 1e-12
YAW_MIN_NORM = 1e-8
ROBUST_MIN_POINTS = 10
ROBUST_LARGE = 2000
# rows of a group whose baselines are measured in one piece, baselines of a task, and those a worker measures at a time
PACKED_ROWS = 4096
TASK_PAIRS = 4_000_000
HELD_PAIRS = 1 << 16

POSE_MODES = ("none", "translation", "scale", "scale_translation", "yaw_translation", "scale_yaw_translation", "sim3")
OVERLAP_MODES = ("translation", "yaw_translation", "rigid", "sim3")


def eye() -> Column:
    return F.array(*[F.lit(v) for v in EYE])


def zeros() -> Column:
    return F.array(*[F.lit(0.0)] * 3)


def finite_corr(corr: DataFrame) -> DataFrame:
    cond = L.finite(SRC[0])
    for c in (*SRC[1:], *DST):
        cond = cond & L.finite(c)
    return corr.where(cond)


_SOLUTION = T.StructType([T.StructField("r", T.ArrayType(T.DoubleType())), T.StructField("gain", T.DoubleType())])


@F.pandas_udf(_SOLUTION)
def _solve3(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Rotation and singular-value sum of 3x3 cross-covariances, a whole batch of groups per call."""
    for covs in batches:
        ok = covs.map(lambda c: c is not None and bool(np.isfinite(np.asarray(c, dtype=float)).all()))
        mats = np.stack([np.asarray(c, float) if good else np.eye(3).ravel() for c, good in zip(covs, ok)]).reshape(-1, 3, 3)
        u, sv, vt = np.linalg.svd(mats)
        sign = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
        u[:, :, 2] *= sign[:, None]
        sv[:, 2] *= sign
        yield pd.DataFrame({"r": list((u @ vt).reshape(-1, 9)), "gain": sv.sum(axis=1)})


def fit_sim3(corr: DataFrame, by: Sequence[str], with_scale: bool = True) -> DataFrame:
    """Least-squares similarity (or rigid) transform per group: (by, n, valid, s, r, t).

    Means, variance and cross-covariance are merged moments of one partial aggregate, so large world
    coordinates do not cancel and nothing but one row per group leaves the map side.
    """
    mom = finite_corr(corr).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias("m_" + c) for c in (*SRC, *DST)],
        (F.var_pop(SRC[0]) + F.var_pop(SRC[1]) + F.var_pop(SRC[2])).alias("var"),
        F.array(*[F.covar_pop(d, s) for d in DST for s in SRC]).alias("cov"),
    )
    sol = mom.withColumn("sol", _solve3("cov"))
    s = (F.col("sol.gain") / F.col("var")) if with_scale else F.lit(1.0)
    sol = sol.withColumn("s0", s).withColumn("r0", F.col("sol.r"))
    rm = L.matvec(L.mat3("r0"), L.vec(*["m_" + c for c in SRC]))
    t = F.array(*[F.col("m_" + d) - F.col("s0") * v for d, v in zip(DST, rm)])
    sol = sol.withColumn("t0", t)
    good = (F.col("n") >= 3) & (F.col("var") > EPS) & L.finite("s0") & (F.col("s0") > EPS) & F.forall("t0", L.finite)
    return sol.withColumn("valid", F.coalesce(good, F.lit(False))).select(
        *by, "n", "valid",
        F.when(F.col("valid"), F.col("s0")).otherwise(1.0).alias("s"),
        F.when(F.col("valid"), F.col("r0")).otherwise(eye()).alias("r"),
        F.when(F.col("valid"), F.col("t0")).otherwise(zeros()).alias("t"),
    )


def apply_to_src(corr: DataFrame, tf: DataFrame, by: Sequence[str]) -> DataFrame:
    """Move the source side of the correspondences by their group's transform."""
    j = corr.join(tf.select(*by, "s", "r", "t"), list(by))
    moved = L.matvec(L.mat3("r"), L.vec(*SRC))
    new = [F.col("s") * m + F.col("t")[i] for i, m in enumerate(moved)]
    return j.withColumns(dict(zip(SRC, new))).select(*corr.columns)


def residuals(corr: DataFrame, tf: DataFrame, by: Sequence[str], out: str = "err") -> DataFrame:
    """Correspondences with the distance between the moved source and the destination."""
    j = corr.join(tf.select(*by, "s", "r", "t"), list(by))
    moved = L.matvec(L.mat3("r"), L.vec(*SRC))
    diff = [F.col("s") * m + F.col("t")[i] - F.col(d) for i, (m, d) in enumerate(zip(moved, DST))]
    return j.withColumn(out, L.norm(diff)).select(*corr.columns, out)


def _median_shift(corr: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-axis median of destination minus source: (by, n, t)."""
    diff = corr.select(*by, *[(F.col(d) - F.col(s)).alias("e" + a) for a, s, d in zip("xyz", SRC, DST)])
    q = quantiles(diff, by, ["ex", "ey", "ez"], [0.5], derived=True)
    return q.select(*by, "n", F.array(*[F.col(f"e{a}_q")[0] for a in "xyz"]).alias("t"))


def fit_translation(corr: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median translation per group; rotation and scale stay identity."""
    return _median_shift(finite_corr(corr), by).select(
        *by, "n", F.lit(True).alias("valid"), F.lit(1.0).alias("s"), eye().alias("r"), "t"
    )


def yaw_moments(corr: DataFrame, by: Sequence[str]) -> DataFrame:
    """Closed-form planar rotation per group: (by, n, src_energy, dst_energy, yaw0)."""
    n = F.count(F.lit(1))
    return corr.groupBy(*by).agg(
        n.alias("n"),
        (n * (F.var_pop("sx") + F.var_pop("sy"))).alias("src_energy"),
        (n * (F.var_pop("dx") + F.var_pop("dy"))).alias("dst_energy"),
        F.atan2(
            n * (F.covar_pop("sx", "dy") - F.covar_pop("sy", "dx")),
            n * (F.covar_pop("sx", "dx") + F.covar_pop("sy", "dy")),
        ).alias("yaw0"),
    )


def yaw_matrix(yaw: str | Column) -> Column:
    y = L.col(yaw)
    z, o = F.lit(0.0), F.lit(1.0)
    return F.array(F.cos(y), -F.sin(y), z, F.sin(y), F.cos(y), z, z, z, o)


def fit_yaw(corr: DataFrame, by: Sequence[str]) -> DataFrame:
    """Yaw about z plus median translation; degenerate xy falls back to the translation alone."""
    corr = finite_corr(corr)
    yaw = yaw_moments(corr, by)
    usable = (F.col("src_energy") > EPS) & (F.col("dst_energy") > EPS)
    tf = yaw.select(
        *by, "n", (F.col("n") >= 2).alias("valid"), F.lit(1.0).alias("s"),
        F.when(usable, F.col("yaw0")).otherwise(0.0).alias("yaw"),
    ).withColumn("r", yaw_matrix("yaw")).withColumn("t", zeros())
    tf = materialize(tf, "yaw")
    shift = _median_shift(apply_to_src(corr, tf, by), by).drop("n")
    return tf.drop("t").join(shift, list(by)).select(
        *by, "n", "valid", "s",
        F.when(F.col("valid"), F.col("r")).otherwise(eye()).alias("r"),
        F.when(F.col("valid"), F.col("t")).otherwise(zeros()).alias("t"),
        F.when(F.col("valid"), F.col("yaw")).otherwise(0.0).alias("yaw"),
    )


def baseline_pairs(n: DataFrame, by: Sequence[str], max_pairs: int, seed: int) -> DataFrame:
    """Seeded index pairs (i, j) per group, i <> j; a pair of points gives the single pair (0, 1).

    They are written out: the planner takes exploded rows for as few as there are groups, and would send them all to the driver.
    """
    n_pairs = F.least(F.lit(max_pairs).cast("long"), F.floor(F.col("n") * (F.col("n") - 1) / 2))
    # a handful of groups would come as one small partition
    spark = n.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = n.where("n >= 2").repartition(width, *by).select(
        *by, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") == 2, 0).otherwise(n_pairs - 1))).alias("k")
    )
    draw = lambda side: F.floor(L.uniform(seed + side, *by, "k") * F.col("n"))
    pairs = k.select(
        *by, "k",
        F.when(F.col("n") == 2, 0).otherwise(draw(0)).cast("long").alias("i"),
        F.when(F.col("n") == 2, 1).otherwise(draw(1)).cast("long").alias("j"),
    )
    return materialize(pairs.where("i <> j"), "baselines")


def _median_ratios(head: list[bytes], sizes: np.ndarray, points: np.ndarray, max_pairs: int, seed: int) -> tuple[list, list]:
    """Median and number of the usable baseline ratios of groups whose points (6, rows) follow each other."""
    at = np.cumsum(sizes) - sizes
    wanted = np.minimum(max_pairs, sizes * (sizes - 1) // 2)
    found: list[list[np.ndarray]] = [[] for _ in head]

    def measure(runs: list[tuple[int, int, int]]) -> None:
        group = np.repeat([g for g, _, _ in runs], [hi - lo for _, lo, hi in runs])
        n, names = sizes[group], [(head[g], lo, hi) for g, lo, hi in runs]
        i, j = (np.floor(uniforms(names, seed + side) * n).astype(np.int64) for side in (0, 1))
        i, j = np.where(n == 2, 0, i), np.where(n == 2, 1, j)
        used = i != j
        group = group[used]
        gap = points[:, at[group] + i[used]] - points[:, at[group] + j[used]]
        gap *= gap
        ds, dd = np.sqrt(gap[0] + gap[1] + gap[2]), np.sqrt(gap[3] + gap[4] + gap[5])
        near = (ds > MIN_BASELINE) & (dd > 0)
        ratio, group = dd[near] / ds[near], group[near]
        ratio, group = ratio[ratio > MIN_RATIO], group[ratio > MIN_RATIO]
        ends = np.searchsorted(group, [g for g, _, _ in runs], "right")
        for (g, _, _), part in zip(runs, np.split(ratio, ends[:-1])):
            found[g].append(part)

    runs, held = [], 0
    for g, many in enumerate(wanted.tolist()):
        lo = 0
        while lo < many:
            hi = min(many, lo + HELD_PAIRS - held)
            runs.append((g, lo, hi))
            held += hi - lo
            lo = hi
            if held == HELD_PAIRS:
                measure(runs)
                runs, held = [], 0
    if runs:
        measure(runs)
    medians, counts = [], []
    for parts in found:
        ratio = np.concatenate(parts) if parts else np.zeros(0)
        counts.append(len(ratio))
        if len(ratio):
            low, high = (len(ratio) - 1) // 2, len(ratio) // 2
            ratio = np.partition(ratio, (low, high))
            medians.append(float(ratio[low] if low == high else 0.5 * ratio[low] + 0.5 * ratio[high]))
        else:
            medians.append(None)
    return medians, counts


def _packed_scale(rows: DataFrame, by: list[str], order: Sequence[str], pairs: int, max_pairs: int, seed: int) -> DataFrame:
    """(by, n, q, num_pairs) of groups of at most ``PACKED_ROWS`` rows: the rows of a group lie together, and its baselines are
    drawn and measured there, so no pair of points is ever shuffled. ``pairs`` is the number of baselines of all groups."""
    spark = rows.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    head = F.concat_ws(":", *[F.col(c).cast("string") for c in by], F.lit(""))
    placed = rows.repartition(width, *by).withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    placed = placed.select(*by, head.alias("__head"), "__i", *SRC, *DST)
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("n", T.LongType()), T.StructField("q", T.DoubleType()),
                           T.StructField("num_pairs", T.LongType())])

    def solve(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, table.num_rows))
        points = np.stack([table[c].to_numpy() for c in (*SRC, *DST)])
        first = table.select([*by, "__head"]).take(pa.array(starts)).combine_chunks()
        names = [h.encode() for h in first["__head"].to_pylist()]
        medians, counts = _median_ratios(names, sizes, points, max_pairs, seed)
        out = pa.table([*[first[c] for c in by], pa.array(sizes), pa.array(medians, pa.float64()), pa.array(counts, pa.int64())], schema.names)
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            starts = np.flatnonzero(rest["__i"].to_numpy() == 1)
            if len(starts) > 1:  # the last group may go on in the next batch
                yield solve(rest.slice(0, starts[-1]), starts[:-1])
                rest = rest.slice(starts[-1])
        if rest is not None:
            yield solve(rest, np.zeros(1, np.int64))

    return placed.mapInArrow(run, schema)


def fit_scale(
    corr: DataFrame, by: Sequence[str], order: Sequence[str], max_pairs: int, seed: int = 0
) -> DataFrame:
    """Median ratio of destination to source baselines over seeded pairs: (by, n, scale, num_pairs, scale_valid).

    Groups of up to ``PACKED_ROWS`` rows are measured where their rows lie. The rows of larger ones are ranked and joined with
    their pairs; they have no more than ``max_pairs`` each.
    """
    by = list(by)
    rows = materialize(finite_corr(corr).select(*by, *order, *SRC, *DST), "correspondences")
    n = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    few = F.col("n") <= PACKED_ROWS
    pairs, large = n.agg(F.sum(F.when(few, F.least(F.lit(max_pairs), F.col("n") * (F.col("n") - 1) / 2))), F.count_if(~few)).first()
    big = materialize(n.where(~few), "large-groups") if large else None
    packed = rows if big is None else _but(rows, big, by)
    out = _packed_scale(packed, by, order, int(pairs or 0), max_pairs, seed)
    if big is not None:
        out = out.unionByName(_joined_scale(rows.join(big.drop("n"), by), big, by, order, max_pairs, seed))
    out = materialize(out, "scales")
    return out.select(*by, "n", F.coalesce("q", F.lit(1.0)).alias("scale"), "num_pairs", F.col("q").isNotNull().alias("scale_valid"))


def _but(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of other groups; NULL is a group of its own."""
    names = {c: f"__of_{c}" for c in by}
    same = F.lit(True)
    for c, o in names.items():
        same = same & F.col(c).eqNullSafe(F.col(o))
    return rows.join(groups.select(*by).withColumnsRenamed(names), same, "left_anti")


def _joined_scale(rows: DataFrame, n: DataFrame, by: list[str], order: Sequence[str], max_pairs: int, seed: int) -> DataFrame:
    """(by, n, q, num_pairs) of groups of any size, by joins of ranked rows and index pairs."""
    idx = materialize(grouped_rank(rows, by, order, "i"), "ranked")
    pairs = baseline_pairs(n, by, max_pairs, seed)
    left = idx.select(*by, "i", *SRC, *DST)
    right = idx.select(*by, F.col("i").alias("j"), *[F.col(c).alias("o" + c) for c in (*SRC, *DST)])
    p = pairs.join(left, [*by, "i"]).join(right, [*by, "j"])
    ds = L.norm([F.col(c) - F.col("o" + c) for c in SRC])
    dd = L.norm([F.col(c) - F.col("o" + c) for c in DST])
    p = p.select(*by, ds.alias("ds"), dd.alias("dd")).where((F.col("ds") > MIN_BASELINE) & (F.col("dd") > 0))
    p = p.withColumn("ratio", F.col("dd") / F.col("ds")).where(F.col("ratio") > MIN_RATIO)
    q = quantiles(p, by, ["ratio"], [0.5], bounded=True).select(
        *by, F.col("n").alias("num_pairs"), F.col("ratio_q")[0].alias("q")
    )
    return n.join(q, by, "left").select(*by, "n", "q", F.coalesce("num_pairs", F.lit(0).cast("long")).alias("num_pairs"))


def align_chunks(corr: DataFrame, groups: DataFrame, by: Sequence[str], mode: str, order: Sequence[str],
                 max_pairs: int = 0, seed: int = 0) -> DataFrame:
    """Per-group pose alignment in one of ``POSE_MODES``, with the fallback ladder for few matches.

    ``corr`` holds predicted (source) and reference (destination) camera centres, ``groups`` every group, also
    those without a match. ``max_pairs`` is the size of the seeded sample of baselines, needed by the modes with scale other
    than sim3. One match gives a translation only; no usable baseline gives scale 1; no match gives
    an invalid identity.
    """
    if mode not in POSE_MODES:
        raise ValueError(f"unknown alignment mode {mode}")
    by = list(by)
    base = groups.select(*by).distinct()
    long0 = F.lit(0).cast("long")
    if mode == "none":
        return base.select(
            *by, F.lit(True).alias("valid"), long0.alias("num_corr"), long0.alias("num_scale_pairs"),
            F.lit(1.0).alias("s"), F.lit(0.0).alias("yaw"), F.lit(False).alias("yaw_valid"), eye().alias("r"),
            zeros().alias("t"), F.lit(None).cast("double").alias("median_residual"),
        )
    # written out: joins that make it would run again for each of the fits
    corr = materialize(finite_corr(corr).select(*by, *order, *SRC, *DST), "correspondences")
    wants_scale = "scale" in mode
    wants_yaw = "yaw" in mode
    if mode == "sim3":
        tf = fit_sim3(corr, by).withColumns({"num_scale_pairs": long0, "yaw": F.lit(0.0), "yaw_valid": F.lit(False)})
    else:
        tf = corr.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        if wants_scale:
            if max_pairs <= 0:
                raise ValueError("modes with scale sample baselines: give max_pairs")
            sc = fit_scale(corr, by, order, max_pairs, seed).drop("n")
            tf = tf.join(sc, by, "left")
        else:
            tf = tf.withColumns({"scale": F.lit(1.0), "num_pairs": long0})
        if wants_yaw:
            yaw = yaw_moments(corr, by).withColumn(
                "ok", (F.col("n") >= 2) & (F.sqrt("src_energy") >= YAW_MIN_NORM) & (F.sqrt("dst_energy") >= YAW_MIN_NORM)
            )
            tf = tf.join(yaw.select(*by, F.when(F.col("ok"), F.col("yaw0")).otherwise(0.0).alias("yaw"),
                                    F.col("ok").alias("yaw_valid")), by)
        else:
            tf = tf.withColumns({"yaw": F.lit(0.0), "yaw_valid": F.lit(False)})
        tf = tf.select(
            *by, "n", F.lit(True).alias("valid"), F.coalesce("scale", F.lit(1.0)).alias("s"),
            F.coalesce("num_pairs", long0).alias("num_scale_pairs"), "yaw", "yaw_valid",
        ).withColumn("r", yaw_matrix("yaw")).withColumn("t", zeros())
        if mode != "scale":
            tf = materialize(tf, "align")
            shift = _median_shift(apply_to_src(corr, tf, by), by).drop("n")
            tf = tf.drop("t").join(shift, by)
    tf = materialize(tf, "align")
    res = quantiles(residuals(corr, tf, by).select(*by, "err"), by, ["err"], [0.5], derived=True).select(*by, F.col("err_q")[0].alias("median_residual"))
    out = base.join(tf, by, "left").join(res, by, "left")
    ok = F.coalesce("valid", F.lit(False))
    return out.select(
        *by, ok.alias("valid"), F.coalesce("n", long0).alias("num_corr"),
        F.coalesce("num_scale_pairs", long0).alias("num_scale_pairs"), F.coalesce("s", F.lit(1.0)).alias("s"),
        F.coalesce("yaw", F.lit(0.0)).alias("yaw"), F.coalesce("yaw_valid", F.lit(False)).alias("yaw_valid"),
        F.coalesce("r", eye()).alias("r"), F.coalesce("t", zeros()).alias("t"),
        F.when(ok, F.col("median_residual")).alias("median_residual"),
    )


def fit_overlap(corr: DataFrame, by: Sequence[str], mode: str, min_corr: int) -> DataFrame:
    """Fit used between chunk groups; fewer than ``min_corr`` finite pairs gives an invalid identity."""
    if mode not in OVERLAP_MODES:
        raise ValueError(f"unknown overlap mode {mode}")
    if mode == "translation":
        tf = fit_translation(corr, by)
    elif mode == "yaw_translation":
        tf = fit_yaw(corr, by).drop("yaw")
    else:
        tf = fit_sim3(corr, by, with_scale=mode == "sim3")
    ok = F.col("valid") & (F.col("n") >= min_corr)
    return tf.select(
        *by, "n", ok.alias("valid"), F.when(ok, F.col("s")).otherwise(1.0).alias("s"),
        F.when(ok, F.col("r")).otherwise(eye()).alias("r"), F.when(ok, F.col("t")).otherwise(zeros()).alias("t"),
    )


def fit_sim3_robust(
    corr: DataFrame, by: Sequence[str], order: Sequence[str], trim: float = 0.8, iters: int = 2
) -> DataFrame:
    """Similarity refitted on the pairs with the smallest residuals; fewer than 10 pairs give an identity."""
    by = list(by)
    corr = finite_corr(corr)
    n = F.col("__n")
    keep = F.greatest(
        F.floor(n * F.lit(trim)), F.when(n >= ROBUST_LARGE, ROBUST_LARGE).otherwise(ROBUST_MIN_POINTS)
    )
    tf = materialize(fit_sim3(corr, by), "robust")
    sizes = tf.select(*by, F.col("n").alias("__n"))
    if 0 < trim < 1:
        for _ in range(max(iters, 1)):
            ranked = grouped_rank(residuals(corr, tf, by), by, ["err", *order], "__k")
            kept = ranked.join(sizes, by).where(F.col("__k") < keep)
            tf = materialize(fit_sim3(kept.select(*corr.columns), by), "robust")
    enough = F.col("__n") >= ROBUST_MIN_POINTS
    return tf.join(sizes, by).select(
        *by, "n", (F.col("valid") & enough).alias("valid"), F.when(enough, F.col("s")).otherwise(1.0).alias("s"),
        F.when(enough, F.col("r")).otherwise(eye()).alias("r"), F.when(enough, F.col("t")).otherwise(zeros()).alias("t"),
    )


def _balance_cap(total: int, grid: int, min_cell: int, max_cell: int) -> int:
    return max(1, max_cell if max_cell > 0 else max(min_cell, -(-total // (grid * grid)) if total > 0 else 1))


def _balance_cells(corr: DataFrame, by: Sequence[str], grid: int) -> DataFrame:
    """Finite correspondences with the cell of their midpoint in a grid over the group; -1 without an xy extent."""
    corr = corr.withColumns({"mx": (F.col("sx") + F.col("dx")) / 2, "my": (F.col("sy") + F.col("dy")) / 2})
    b = materialize(corr.groupBy(*by).agg(
        F.min("mx").alias("x0"), (F.max("mx") - F.min("mx")).alias("wx"),
        F.min("my").alias("y0"), (F.max("my") - F.min("my")).alias("wy"),
    ), "bounds")
    bin_of = lambda v, lo, w: F.greatest(
        F.lit(0), F.least(F.lit(grid - 1), F.floor((F.col(v) - F.col(lo)) / F.greatest(F.col(w), F.lit(1e-9)) * grid))
    )
    flat = (F.greatest("wx", "wy") <= 1e-9) if grid > 1 else F.lit(True)
    cell = F.when(flat, F.lit(-1)).otherwise(bin_of("mx", "x0", "wx") * grid + bin_of("my", "y0", "wy"))
    return corr.join(b, list(by)).withColumn("cell", cell.cast("int")).drop("mx", "my", "x0", "wx", "y0", "wy")


def balance_correspondences(
    corr: DataFrame, by: Sequence[str], order: Sequence[str], total: int, grid: int = 16, min_cell: int = 64,
    max_cell: int = 0, seed: int | Column = 0,
) -> DataFrame:
    """Cap correspondences per cell of a midpoint grid, chosen by seeded hash; adds the cell id ``cell``.

    Without an xy extent every row is kept, in cell -1.
    """
    by = list(by)
    j = _balance_cells(finite_corr(corr), by, grid)
    cap = _balance_cap(total, grid, min_cell, max_cell)
    capped = cap_per_group(j.where("cell >= 0"), [*by, "cell"], [L.uniform(seed, *by, *order), *order], cap)
    return capped.unionByName(j.where("cell < 0"))


def balance_statistics(
    corr: DataFrame, by: Sequence[str], total: int, grid: int = 16, min_cell: int = 64, max_cell: int = 0,
) -> DataFrame:
    """What ``balance_correspondences`` does to each group: (by, reason, num_corr_before, num_finite_corr, num_corr_after,
    num_occupied_cells, per_cell_cap, min_cell_count_before, max_cell_count_before). Cell figures are NULL unless the
    reason is 'balanced'. Only counts per cell are shuffled."""
    by = list(by)
    cap = _balance_cap(total, grid, min_cell, max_cell)
    before = corr.groupBy(*by).agg(F.count(F.lit(1)).alias("num_corr_before"))
    cells = _balance_cells(finite_corr(corr), by, grid).groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"))
    kept = F.when(F.col("cell") < 0, F.col("n")).otherwise(F.least("n", F.lit(cap)))
    per = cells.groupBy(*by).agg(
        F.sum("n").alias("finite"), F.sum(kept).alias("after"), F.count(F.lit(1)).alias("cells"), F.min("n").alias("lo"),
        F.max("n").alias("hi"), (F.min("cell") >= 0).alias("spread"))
    reason = F.lit("grid_size <= 1") if grid <= 1 else F.when(F.col("finite").isNull(), "no finite XY midpoints").when(
        F.col("spread"), "balanced").otherwise("degenerate XY span")
    j = before.join(per, by, "left").withColumn("reason", reason)
    only = lambda c: F.when(F.col("reason") == "balanced", c)
    return j.select(
        *by, "reason", "num_corr_before", F.coalesce("finite", F.lit(0)).alias("num_finite_corr"), F.coalesce("after", F.lit(0)).alias("num_corr_after"),
        only(F.col("cells")).alias("num_occupied_cells"), only(F.lit(cap)).alias("per_cell_cap"), only(F.col("lo")).alias("min_cell_count_before"),
        only(F.col("hi")).alias("max_cell_count_before"))
