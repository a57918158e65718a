"""Recentring, augmentation, noise and scale normalisation of poses and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import first_per_group, quantiles
from aerolake.operators.matching import finite_pose
from aerolake.session import materialize

# fixed values of the normalisations
NORM_EPS = 1e-8
ROBUST_MIN_SCALE = 1e-6

XYZ = ("x", "y", "z")


def centre_anchor(cams: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Mean centre of the finite camera poses per group: (by, ax, ay, az)."""
    t = L.trans_of("t_c2w")
    good = cams.where(finite_pose("t_c2w"))
    return materialize(good.groupBy(*by).agg(*[F.avg(c).alias("a" + a) for a, c in zip(XYZ, t)]), "anchor")


def recenter(df: DataFrame, anchor: DataFrame, by: Sequence[str] = ("scene",), cols: Sequence[str] = XYZ) -> DataFrame:
    """Subtract the group's anchor from point columns."""
    j = df.join(anchor, list(by), "left")
    return j.withColumns({c: F.col(c) - F.coalesce(F.col("a" + a), F.lit(0.0)) for c, a in zip(cols, XYZ)}).select(*df.columns)


def restore(df: DataFrame, anchor: DataFrame, by: Sequence[str] = ("scene",), cols: Sequence[str] = XYZ) -> DataFrame:
    """Add the group's anchor back."""
    j = df.join(anchor, list(by), "left")
    return j.withColumns({c: F.col(c) + F.coalesce(F.col("a" + a), F.lit(0.0)) for c, a in zip(cols, XYZ)}).select(*df.columns)


def recenter_poses(cams: DataFrame, anchor: DataFrame, by: Sequence[str] = ("scene",), sign: float = -1.0) -> DataFrame:
    """Shift pose centres by the group's anchor; ``sign`` +1 restores."""
    j = cams.join(anchor, list(by), "left")
    t = [c + sign * F.coalesce(F.col("a" + a), F.lit(0.0)) for a, c in zip(XYZ, L.trans_of("t_c2w"))]
    return j.withColumn("t_c2w", L.pose(L.rot_of("t_c2w"), t)).select(*cams.columns)


def world_params(groups: DataFrame, by: Sequence[str], seed: int, rotation_deg: Sequence[float],
                 translation: Sequence[float], scale: tuple[float, float]) -> DataFrame:
    """Seeded rotation (about x, then y, then z), translation and scale per group."""
    draw = lambda i: L.uniform(seed + i, *by) * 2.0 - 1.0
    p = groups.select(*by).distinct().withColumns(
        {f"w{a}": F.radians(draw(i) * rotation_deg[i]) for i, a in enumerate(XYZ)}
        | {f"o{a}": draw(3 + i) * translation[i] for i, a in enumerate(XYZ)}
        | {"ws": F.lit(float(scale[0])) + L.uniform(seed + 6, *by) * float(scale[1] - scale[0])})
    c = {a: F.cos("w" + a) for a in XYZ}
    s = {a: F.sin("w" + a) for a in XYZ}
    z, o = F.lit(0.0), F.lit(1.0)
    rx = [[o, z, z], [z, c["x"], -s["x"]], [z, s["x"], c["x"]]]
    ry = [[c["y"], z, s["y"]], [z, o, z], [-s["y"], z, c["y"]]]
    rz = [[c["z"], -s["z"], z], [s["z"], c["z"], z], [z, z, o]]
    return p.withColumn("wr", L.pack(L.matmul(rz, L.matmul(ry, rx)))).drop("wx", "wy", "wz")


def augment_anchor(cams: DataFrame, points: DataFrame | None, by: Sequence[str], mode: str, order: Sequence[str]) -> DataFrame:
    """Anchor per group: 'first_camera', 'mean_camera' or 'scene_points' (first camera where a group has no points)."""
    by = list(by)
    t = L.trans_of("t_c2w")
    cen = cams.select(*by, *order, *[c.alias("a" + a) for a, c in zip(XYZ, t)])
    first = first_per_group(cen, by, order).drop(*order)
    if mode == "first_camera":
        return first
    if mode == "mean_camera":
        return cen.groupBy(*by).agg(*[F.avg("a" + a).alias("a" + a) for a in XYZ])
    if mode == "scene_points":
        ok = L.finite("x") & L.finite("y") & L.finite("z")
        m = points.where(ok).groupBy(*by).agg(*[F.avg(a).alias("p" + a) for a in XYZ])
        return first.join(m, by, "left").select(*by, *[F.coalesce("p" + a, "a" + a).alias("a" + a) for a in XYZ])
    raise ValueError(f"unknown anchor mode {mode}")


def _augmented(v: Sequence[Column]) -> list[Column]:
    moved = [(c - F.col("a" + a) + F.col("o" + a)) * F.col("ws") for a, c in zip(XYZ, v)]
    return L.matvec(L.mat3("wr"), moved)


def augment_points(df: DataFrame, params: DataFrame, anchor: DataFrame, by: Sequence[str], cols: Sequence[str] = XYZ,
                   lengths: Sequence[str] = ()) -> DataFrame:
    """((p - anchor + offset) * scale) R^T for points; depth-like ``lengths`` are scaled."""
    j = df.join(materialize(params.join(anchor, list(by)), "augment"), list(by))
    new = dict(zip(cols, _augmented(L.vec(*cols)))) | {c: F.col(c) * F.col("ws") for c in lengths}
    return j.withColumns(new).select(*df.columns)


def augment_poses(cams: DataFrame, params: DataFrame, anchor: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same motion applied to pose centres, and its rotation to the orientations."""
    j = cams.join(materialize(params.join(anchor, list(by)), "augment"), list(by))
    moved = L.pose(L.matmul(L.mat3("wr"), L.rot_of("t_c2w")), _augmented(L.trans_of("t_c2w")))
    return j.withColumn("t_c2w", moved).select(*cams.columns)


def perturb_poses(cams: DataFrame, key: Sequence[str], seed: int, xy_std: float, z_std: float, yaw_std_deg: float,
                  xy_max: float = 0.0, z_max: float = 0.0, yaw_max_deg: float = 0.0) -> DataFrame:
    """Noisy copy ``noisy_c2w`` of every pose beside the clean one, with the noise nx, ny, nz, yaw_deg.

    xy is clipped by its length, z and yaw by their absolute value; a limit of 0 means no clip.
    """
    g = lambda i, std: L.gauss(seed + 10 * i, *key) * float(std)
    clip = lambda c, m: c if m <= 0 else L.clamp(c, -float(m), float(m))
    d = cams.withColumns({"nx": g(1, xy_std), "ny": g(2, xy_std), "nz": clip(g(3, z_std), z_max),
                          "yaw_deg": clip(g(4, yaw_std_deg), yaw_max_deg)})
    if xy_max > 0:
        n = L.norm(L.vec("nx", "ny"))
        f = F.when(n > xy_max, xy_max / n).otherwise(1.0)
        d = d.withColumn("__f", f).withColumns({"nx": F.col("nx") * F.col("__f"), "ny": F.col("ny") * F.col("__f")}).drop("__f")
    y = F.radians("yaw_deg")
    z, o = F.lit(0.0), F.lit(1.0)
    rz = [[F.cos(y), -F.sin(y), z], [F.sin(y), F.cos(y), z], [z, z, o]]
    t = L.add(L.matvec(rz, L.trans_of("t_c2w")), L.vec("nx", "ny", "nz"))
    return d.withColumn("noisy_c2w", L.pose(L.matmul(rz, L.rot_of("t_c2w")), t))


NORM_MODES = ("avg_dis", "avg_log1p", "avg_warp-log1p")


def normalize_set(points: DataFrame, by: Sequence[str], mode: str = "avg_dis", cols: Sequence[str] = XYZ,
                  mask: str = "valid") -> DataFrame:
    """Divide the points of a set by their mean distance to the origin, raw or in log form; adds ``norm_factor``.

    'avg_warp-log1p' also warps each point to its log distance.
    """
    if mode not in NORM_MODES:
        raise ValueError(f"unknown mode {mode}")
    ok = F.col(mask)
    dis = L.norm(L.vec(*cols))
    size = dis if mode == "avg_dis" else F.log1p(dis)
    f = points.groupBy(*by).agg(F.greatest(
        F.lit(NORM_EPS), F.coalesce(F.sum(F.when(ok, size)), F.lit(0.0)) / (F.count_if(ok) + NORM_EPS)).alias("norm_factor"))
    j = points.join(materialize(f, "norm"), list(by))
    warp = F.when(ok, F.log1p(dis) / F.greatest(dis, F.lit(NORM_EPS))).otherwise(0.0) if mode == "avg_warp-log1p" else F.lit(1.0)
    j = j.withColumn("__w", warp)
    return j.withColumns({c: F.col(c) * F.col("__w") / F.col("norm_factor") for c in cols}).select(*points.columns, "norm_factor")


def normalize_lengths(df: DataFrame, by: Sequence[str], cols: Sequence[str], clip_negative: bool = True) -> DataFrame:
    """Divide depth (one column), distances (one column) or translations (three) by the mean of their non-zero lengths."""
    length = F.col(cols[0]) if len(cols) == 1 else L.norm(L.vec(*cols))
    total = F.sum(F.when(length > 0, length)) if clip_negative else F.sum(length)
    f = df.groupBy(*by).agg(F.greatest(
        F.lit(NORM_EPS), F.coalesce(total, F.lit(0.0)) / (F.count_if(length > 0) + NORM_EPS)).alias("norm_factor"))
    j = df.join(materialize(f, "norm"), list(by))
    return j.withColumns({c: F.col(c) / F.col("norm_factor") for c in cols}).select(*df.columns, "norm_factor")


def normalize_scene(points: DataFrame, cams: DataFrame, by: Sequence[str] = ("scene",), pct: float = 95.0) -> DataFrame:
    """Robust world normalisation per group over points and camera centres: (by, mx, my, mz, scale)."""
    by = list(by)
    cen = cams.select(*by, *[c.alias(a) for a, c in zip(XYZ, L.trans_of("t_c2w"))])
    both = points.select(*by, *XYZ).unionByName(cen).where(L.finite("x") & L.finite("y") & L.finite("z"))
    med = materialize(quantiles(both, by, list(XYZ), [0.5]).select(
        *by, *[F.col(f"{a}_q")[0].alias("m" + a) for a in XYZ]), "median")
    dist = both.join(med, by).select(*by, L.norm([F.col(a) - F.col("m" + a) for a in XYZ]).alias("d"))
    q = quantiles(dist, by, ["d"], [pct / 100.0], derived=True)
    return med.join(q, by).select(
        *by, "mx", "my", "mz", F.greatest(F.col("d_q")[0], F.lit(ROBUST_MIN_SCALE)).alias("scale"))
