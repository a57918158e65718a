"""Pixel and view masks. Rows of one view are those of one image, so view-keyed windows are bounded by image size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import quantiles

# fixed value of the confidence filter
MIN_DEPTH = 1e-6


def filter_valid_poses(frames: DataFrame, pose: str = "t_c2w") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): frames with a finite 4x4 pose, and the others with a ``reason``."""
    p = F.col(pose)
    reason = (
        F.when(p.isNull(), "missing_camera_prior")
        .when(F.size(p) != 16, "invalid_T_c2w_shape")
        .when(~F.forall(p, L.finite), "non_finite_T_c2w")
    )
    tagged = frames.withColumn("reason", reason)
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def pose_filter_counts(frames: DataFrame, by: Sequence[str], pose: str = "t_c2w", depth: str | None = None) -> DataFrame:
    """Per group: frames, kept frames, camera priors, depth priors and the count of each reject reason."""
    p = F.col(pose)
    shape_ok = F.coalesce(F.size(p) == 16, F.lit(False))
    finite = F.coalesce(shape_ok & F.forall(p, L.finite), F.lit(False))
    return frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_frames"), F.count_if(finite).alias("num_kept"),
        F.count_if(p.isNotNull()).alias("num_cam_priors"),
        F.count(F.col(depth) if depth else F.lit(None)).alias("num_depth_priors"),
        F.count_if(p.isNull()).alias("missing_camera_prior"),
        F.count_if(p.isNotNull() & ~shape_ok).alias("invalid_shape"),
        F.count_if(shape_ok & ~finite).alias("non_finite"),
    )


def confidence_filter(
    pixels: DataFrame, view: Sequence[str], q: float, conf: str = "conf", depth: str = "z",
    coords: Sequence[str] = (), strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(kept pixels, stats per view): keep confidence at or above the view's ``q`` quantile over valid pixels.

    ``q = 0`` keeps every pixel; ``strict`` keeps only confidence above the quantile.
    """
    view = list(view)
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"q must be in [0, 1], got {q}")
    if q == 0.0:
        n = pixels.groupBy(*view).agg(F.count(F.lit(1)).alias("num_valid")).withColumns({
            "threshold": F.lit(None).cast("double"), "num_dropped": F.lit(0).cast("long"), "drop_fraction": F.lit(0.0)})
        return pixels, n
    ok = L.finite(conf) & L.finite(depth) & (F.col(depth) > MIN_DEPTH)
    for c in coords:
        ok = ok & L.finite(c)
    valid = pixels.where(ok)
    th = quantiles(valid.select(*view, F.col(conf).alias("__c")), view, ["__c"], [q], bounded=True)
    th = th.select(*view, F.col("n").alias("num_valid"), F.col("__c_q")[0].alias("threshold"))
    j = valid.join(th, view)
    hit = (F.col(conf) > F.col("threshold")) if strict else (F.col(conf) >= F.col("threshold"))
    stats = j.groupBy(*view, "threshold", "num_valid").agg(F.count_if(~hit).alias("num_dropped"))
    stats = stats.withColumn("drop_fraction", F.col("num_dropped") / F.greatest(F.lit(1), F.col("num_valid")))
    return j.where(hit).select(*pixels.columns), stats


def _pool(df: DataFrame, view: Sequence[str], value: str, out: str, r: int, fn) -> DataFrame:
    """Neighbourhood reduction of radius ``r`` as a row pass, then a column pass; absent pixels do not count."""
    rows = Window.partitionBy(*view, "y").orderBy("x").rangeBetween(-r, r)
    cols = Window.partitionBy(*view, "x").orderBy("y").rangeBetween(-r, r)
    return df.withColumn(out, fn(F.col(value)).over(rows)).withColumn(out, fn(F.col(out)).over(cols))


def by_view(pixels: DataFrame, view: Sequence[str]) -> DataFrame:
    """One shuffle that serves all row and column windows of a view."""
    return pixels.repartition(*view)


def depth_edge(grid: DataFrame, view: Sequence[str], atol: float | None, rtol: float | None, k: int = 3,
               depth: str = "z", mask: str = "valid", out: str = "edge") -> DataFrame:
    """Mark pixels whose k x k neighbourhood spans more than ``atol``, or ``rtol`` of the own depth."""
    g = by_view(grid, view).withColumn("__d", F.when(F.col(mask), F.col(depth)))
    g = _pool(_pool(g, view, "__d", "__hi", k // 2, F.max), view, "__d", "__lo", k // 2, F.min)
    diff = F.col("__hi") - F.col("__lo")
    hit = F.lit(False)
    if atol is not None:
        hit = hit | F.coalesce(diff > atol, F.lit(False))
    if rtol is not None:
        hit = hit | F.coalesce(diff / F.col(depth) > rtol, F.lit(False))
    return g.withColumn(out, hit).select(*grid.columns, out)


def depth_aliasing(grid: DataFrame, view: Sequence[str], atol: float | None, rtol: float | None, k: int = 3,
                   depth: str = "z", mask: str = "valid", out: str = "alias") -> DataFrame:
    """Mark pixels that lie clearly between the highest and the lowest depth of their neighbourhood."""
    g = by_view(grid, view).withColumn("__d", F.when(F.col(mask), F.col(depth)))
    g = _pool(_pool(g, view, "__d", "__hi", k // 2, F.max), view, "__d", "__lo", k // 2, F.min)
    diff = F.least(F.col("__hi") - F.col(depth), F.col(depth) - F.col("__lo"))
    diff = F.when(F.col(depth).isNotNull(), diff)
    hit = F.lit(False)
    if atol is not None:
        hit = hit | F.coalesce(diff > atol, F.lit(False))
    if rtol is not None:
        hit = hit | F.coalesce(diff / F.col(depth) > rtol, F.lit(False))
    return g.withColumn(out, hit).select(*grid.columns, out)


def _neighbour(view: Sequence[str], along: str, off: int, value: Column) -> Column:
    other = "y" if along == "x" else "x"
    w = Window.partitionBy(*view, other).orderBy(along).rangeBetween(off, off)
    return F.first(value).over(w)


def grid_normals(grid: DataFrame, view: Sequence[str], coords: Sequence[str] = ("px", "py", "pz"),
                 mask: str = "valid") -> DataFrame:
    """Surface normal (nx, ny, nz) per pixel from its four neighbours, with ``normal_ok``; (0, 0, 0) without one."""
    p = F.when(F.col(mask), F.struct(*[F.col(c).alias(a) for c, a in zip(coords, "xyz")]))
    g = by_view(grid, view).withColumn("__p", p)
    g = g.withColumns({
        "__u": _neighbour(view, "y", -1, F.col("__p")), "__d": _neighbour(view, "y", 1, F.col("__p")),
        "__l": _neighbour(view, "x", -1, F.col("__p")), "__r": _neighbour(view, "x", 1, F.col("__p")),
    })
    diff = lambda n: [F.col(f"__{n}.{a}") - F.col(f"__p.{a}") for a in "xyz"]
    total, any_ok = [F.lit(0.0)] * 3, F.lit(False)
    for a, b in (("u", "l"), ("l", "d"), ("d", "r"), ("r", "u")):
        c = L.cross(diff(a), diff(b))
        length = L.norm(c) + 1e-12
        total = [t + F.coalesce(v / length, F.lit(0.0)) for t, v in zip(total, c)]
        any_ok = any_ok | (F.col(f"__{a}").isNotNull() & F.col(f"__{b}").isNotNull() & F.col("__p").isNotNull())
    g = g.withColumns({f"__n{a}": t for a, t in zip("xyz", total)})
    length = L.norm(L.vec("__nx", "__ny", "__nz")) + 1e-12
    return g.withColumns({f"n{a}": F.col(f"__n{a}") / length for a in "xyz"} | {"normal_ok": any_ok}).select(
        *grid.columns, "nx", "ny", "nz", "normal_ok")


def normal_edge(normals: DataFrame, view: Sequence[str], tol: float, k: int = 3, mask: str = "normal_ok",
                out: str = "nedge") -> DataFrame:
    """Mark pixels near a sharp change of direction: largest angle to the neighbour normals, dilated, above ``tol`` degrees.

    A neighbour outside the grid repeats the nearest pixel of the row, then of the column.
    """
    r = k // 2
    length = L.norm(L.vec("nx", "ny", "nz")) + 1e-12
    n = F.struct(*[(F.col(f"n{a}") / length).alias(a) for a in "xyz"], F.col(mask).alias("ok"))
    g = by_view(normals, view).withColumn("__n", n)
    offs = range(-r, r + 1)
    row = F.array(*[F.col("__n") if o == 0 else F.coalesce(_neighbour(view, "x", o, F.col("__n")), F.col("__n")) for o in offs])
    g = g.withColumn("__row", row)
    rows = F.array(*[F.col("__row") if o == 0 else F.coalesce(_neighbour(view, "y", o, F.col("__row")), F.col("__row"))
                     for o in offs])
    g = g.withColumn("__win", F.flatten(rows))
    ang = lambda s: F.when(s["ok"], F.acos(L.clamp(
        s["x"] * F.col("__n.x") + s["y"] * F.col("__n.y") + s["z"] * F.col("__n.z"), -1.0, 1.0))).otherwise(0.0)
    g = g.withColumn("__a", F.array_max(F.transform("__win", ang)))
    g = _pool(g, view, "__a", "__a", r, F.max)
    return g.withColumn(out, F.degrees("__a") > tol).select(*normals.columns, out)


def geometry_mask(grid: DataFrame, view: Sequence[str], conf_q: float | None, edge_rtol: float, normal_tol: float,
                  conf: str = "conf", ambiguous: str | None = None, mask: str = "valid",
                  coords: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    """Keep flag per pixel: valid, unambiguous, confident, and not both a depth edge and a normal edge.

    Adds ``keep``; coordinates of dropped pixels become 0.
    """
    view = list(view)
    base = F.col(mask)
    if ambiguous is not None:
        base = base & ~F.col(ambiguous)
    g = by_view(grid, view)
    if conf_q is not None:
        # the quantile runs over all pixels of the view, as an aggregate window of one image
        th = F.percentile(F.col(conf), F.lit(float(conf_q))).over(Window.partitionBy(*view))
        g = g.withColumn("__th", th)
        base = base & (F.col(conf) > F.col("__th"))
    g = g.withColumn("__base", F.coalesce(base, F.lit(False)))
    g = depth_edge(g, view, None, edge_rtol, out="__de", mask="__base")
    g = normal_edge(grid_normals(g, view, coords, "__base"), view, normal_tol, out="__ne")
    g = g.withColumn("keep", F.col("__base") & ~(F.col("__de") & F.col("__ne")))
    zero = {c: F.when(F.col("keep"), F.col(c)).otherwise(0.0) for c in coords}
    return g.withColumns(zero).select(*grid.columns, "keep")


def residual_filter(pixels: DataFrame, view: Sequence[str], cap: float, keep_pct: float, min_valid: int,
                    pred: str = "z", gt: str = "z_gt", mask: str = "valid") -> DataFrame:
    """Drop pixels above an absolute residual cap, then above the view's ``keep_pct`` quantile of what is left."""
    view = list(view)
    p = pixels.withColumn("__r", F.abs(F.col(pred) - F.col(gt))).where(F.col(mask) & F.col("__r").isNotNull())
    if cap > 0:
        p = p.where(F.col("__r") <= cap)
    if keep_pct >= 100.0:
        return p.select(*pixels.columns)
    th = quantiles(p.select(*view, "__r"), view, ["__r"], [keep_pct / 100.0], bounded=True)
    j = p.join(th, view)
    return j.where((F.col("n") < min_valid) | (F.col("__r") <= F.col("__r_q")[0])).select(*pixels.columns)


def audit_views(views: DataFrame, pixels: DataFrame, key: Sequence[str], depth: str = "z", mask: str = "valid",
                min_ratio: float = 0.0, det_tol: float = 1e-3) -> DataFrame:
    """One row (key, check, value) per failed check of a view.

    ``views`` holds k, t_c2w, width, height. Checks: missing or non-finite pose, rotation determinant, missing
    intrinsics, non-finite depth, grid shape against width x height, share of valid pixels.
    """
    key = list(key)
    stats = pixels.groupBy(*key).agg(
        F.count(F.lit(1)).alias("num"), F.count_if(F.col(mask)).alias("ok"),
        F.count_if(F.col(mask) & ~L.finite(depth)).alias("bad_depth"))
    v = views.join(stats, key, "left")
    p = F.col("t_c2w")
    has = F.coalesce((F.size(p) == 16) & F.forall(p, L.finite), F.lit(False))
    r = L.rot_of("t_c2w")
    det = L.dot(r[0], L.cross(r[1], r[2]))
    num = F.coalesce("num", F.lit(0))
    ratio = F.coalesce("ok", F.lit(0)) / (F.col("width") * F.col("height"))
    check = lambda name, cond, value: F.when(cond, F.struct(F.lit(name).alias("check"), value.cast("double").alias("value")))
    checks = F.array(
        check("non_finite_pose", ~has, F.lit(1)),
        check("rotation_determinant", has & (F.abs(det - 1.0) > det_tol), det),
        check("missing_intrinsics", F.col("k").isNull(), F.lit(1)),
        check("non_finite_depth", F.coalesce("bad_depth", F.lit(0)) > 0, F.col("bad_depth")),
        check("shape_mismatch", num != F.col("width") * F.col("height"), num),
        check("valid_ratio", ratio < min_ratio, ratio),
    )
    rows = v.select(*key, F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c"))
    return rows.select(*key, "c.check", "c.value")
