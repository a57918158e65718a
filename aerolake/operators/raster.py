"""Ground sampling distance, raster bounds, top-surface rasters, smoothing and tiles; rasters are sparse pixel rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import first_per_group, quantiles
from aerolake.session import materialize

# fixed values
DEFAULT_GSD = 0.1
PAD_PIXELS = 4.0
MAX_SPLAT = 8
MIN_TILE = 128
MIN_WEIGHT = 0.05


def _finite(points: DataFrame) -> DataFrame:
    return points.where(L.finite("x") & L.finite("y") & L.finite("z"))


def gsd_from_points(points: DataFrame, by: Sequence[str] = ("scene",), axes: Sequence[str] = ("x", "y"),
                    q: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """(by, num_points, area, gsd): edge of the robust area per point; 0.1 when there is no area."""
    a, b = axes
    s = quantiles(_finite(points), by, [a, b], list(q))
    area = F.greatest(F.lit(0.0), (F.col(f"{a}_q")[1] - F.col(f"{a}_q")[0]) * (F.col(f"{b}_q")[1] - F.col(f"{b}_q")[0]))
    s = s.withColumn("area", area)
    return s.select(*by, F.col("n").alias("num_points"), "area",
                    F.when(F.col("area") > 0, F.sqrt(F.col("area") / F.col("n"))).otherwise(DEFAULT_GSD).alias("gsd"))


def gsd_from_grid(grid: DataFrame, view: Sequence[str], by: Sequence[str], stride: int = 1,
                  coords: Sequence[str] = ("px", "py"), mask: str = "valid") -> DataFrame:
    """(by, num_samples, gsd, p10, p90): median planar distance of neighbouring strided pixels, divided by the stride."""
    g = grid.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0)).where(F.col(mask))
    # the windows run along one row or column of one image
    nxt = lambda along, c: F.first(c).over(Window.partitionBy(*view, "y" if along == "x" else "x").orderBy(along).rangeBetween(stride, stride))
    dist = lambda along: L.norm([nxt(along, c) - F.col(c) for c in coords]) / float(stride)
    d = g.repartition(*view).withColumns({"dx": dist("x"), "dy": dist("y")})
    d = d.select(*by, F.explode(F.array("dx", "dy")).alias("d")).where(L.finite("d") & (F.col("d") > 0))
    s = quantiles(d, by, ["d"], [0.1, 0.5, 0.9], derived=True).select(
        *by, F.col("n").alias("num_samples"), F.col("d_q")[1].alias("gsd"), F.col("d_q")[0].alias("p10"), F.col("d_q")[2].alias("p90"))
    every = grid.select(*by).distinct().join(s, list(by), "left")
    return every.withColumns({"num_samples": F.coalesce("num_samples", F.lit(0).cast("long")), "gsd": F.coalesce("gsd", F.lit(DEFAULT_GSD))})


def raster_bounds(points: DataFrame, gsd: DataFrame, by: Sequence[str] = ("scene",), axes: Sequence[str] = ("x", "y"),
                  q: tuple[float, float] = (0.01, 0.99), padding: float = 0.0) -> DataFrame:
    """(by, u_min, u_max, v_min, v_max, gsd, width, height): quantile bounds padded by four pixels unless told otherwise."""
    by = list(by)
    a, b = axes
    s = quantiles(_finite(points), by, [a, b], list(q)).join(gsd.select(*by, "gsd"), by)
    pad = F.lit(float(padding)) if padding > 0 else F.greatest(F.col("gsd") * PAD_PIXELS, F.lit(0.0))
    s = s.select(*by, "gsd", (F.col(f"{a}_q")[0] - pad).alias("u_min"), (F.col(f"{a}_q")[1] + pad).alias("u_max"),
                 (F.col(f"{b}_q")[0] - pad).alias("v_min"), (F.col(f"{b}_q")[1] + pad).alias("v_max"))
    return s.withColumns({"width": F.ceil((F.col("u_max") - F.col("u_min")) / F.col("gsd")).cast("int"),
                          "height": F.ceil((F.col("v_max") - F.col("v_min")) / F.col("gsd")).cast("int")})


def splat_radius(spacing: float, gsd: float, scale: float) -> int:
    """Pixels a point spreads over, from its spacing; 0 without splatting, at most 8."""
    if scale <= 0:
        return 0
    return int(min(MAX_SPLAT, max(0, math.ceil(max(1.0, scale * spacing / gsd)))))


def rasterize(points: DataFrame, bounds: DataFrame, radius: int = 0, by: Sequence[str] = ("scene",),
              axes: Sequence[str] = ("x", "y"), up: str = "z", key: str = "point_id",
              colors: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Top surface: (by, py, px, z, colours, point id) of the highest point over every pixel of its splat disk.

    Ties go to the nearer offset, then to the lowest id. Only the winner of each pixel is splatted: a lower point of the
    same pixel cannot win any pixel of the disk.
    """
    by = list(by)
    r = max(0, min(MAX_SPLAT, int(radius)))
    b = bounds.select(*by, "u_min", "v_max", "gsd", "width", "height")
    p = points.where(L.finite(up)).join(b, by)
    step = F.greatest(F.col("gsd"), F.lit(1e-12))
    p = p.withColumns({"px": F.floor((F.col(axes[0]) - F.col("u_min")) / step), "py": F.floor((F.col("v_max") - F.col(axes[1])) / step)})
    p = p.where((F.col("px") >= 0) & (F.col("px") < F.col("width")) & (F.col("py") >= 0) & (F.col("py") < F.col("height")))
    p = p.select(*by, "py", "px", (-F.col(up)).alias("__nz"), key, *colors)
    top = first_per_group(p, [*by, "py", "px"], ["__nz", key])
    if r > 0:
        disk = [(dx * dx + dy * dy, dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r]
        offs = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for d, dy, dx in disk])
        s = top.withColumn("__o", F.explode(offs)).withColumns({"py": F.col("py") + F.col("__o.dy"), "px": F.col("px") + F.col("__o.dx")})
        s = s.join(bounds.select(*by, "width", "height"), by)
        s = s.where((F.col("px") >= 0) & (F.col("px") < F.col("width")) & (F.col("py") >= 0) & (F.col("py") < F.col("height"))).drop("width", "height")
        top = first_per_group(s, [*by, "py", "px"], ["__nz", "__o", key])
    return top.select(*by, "py", "px", (-F.col("__nz")).alias("z"), *colors, key)


def _kernel(radius: int, sigma: float) -> list[float]:
    if sigma <= 0:
        return [1.0 / (2 * radius + 1)] * (2 * radius + 1)
    w = [math.exp(-(i * i) / (2.0 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [v / sum(w) for v in w]


def _spread(df: DataFrame, by: Sequence[str], axis: str, limit: str, kernel: list[float]) -> DataFrame:
    """One pass of the separable filter: every pixel adds its weighted value to the pixels that read it, mirrored at the borders."""
    r = len(kernel) // 2
    taps = F.array(*[F.struct(F.lit(i - r).alias("o"), F.lit(w).alias("w")) for i, w in enumerate(kernel)])
    c, last = F.col(axis), F.col(limit) - 1
    # positions that mirror onto this pixel: itself, its reflection at 0, its reflection at the far border
    images = F.filter(F.array(c, F.when(c > 0, -c), F.when(c < last, 2 * last - c)), lambda v: v.isNotNull())
    s = df.withColumn("__at", F.explode(images)).withColumn("__k", F.explode(taps))
    s = s.withColumn("__to", F.col("__at") - F.col("__k.o")).where((F.col("__to") >= 0) & (F.col("__to") <= last))
    keep = [k for k in (*by, "py", "px") if k != axis]
    return s.groupBy(*keep, F.col("__to").alias(axis)).agg(
        F.sum(F.col("sv") * F.col("__k.w")).alias("sv"), F.sum(F.col("sw") * F.col("__k.w")).alias("sw"))


def smooth_raster(raster: DataFrame, bounds: DataFrame, radius: int, sigma: float = 0.0, iterations: int = 1,
                  min_weight: float = MIN_WEIGHT, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Gaussian (``sigma`` > 0) or box mean over the valid pixels; a pixel is kept where the valid weight reaches ``min_weight``."""
    by = list(by)
    cur = raster.select(*by, "py", "px", "z")
    if radius <= 0 or iterations <= 0:
        return cur
    kernel = _kernel(radius, sigma)
    size = bounds.select(*by, "width", "height")
    w = min(max(min_weight, 1e-6), 1.0)
    for _ in range(iterations):
        s = cur.join(size, by).select(*by, "py", "px", F.col("z").alias("sv"), F.lit(1.0).alias("sw"), "width")
        s = _spread(s, by, "px", "width", kernel).join(size.select(*by, "height"), by)
        s = _spread(s, by, "py", "height", kernel)
        cur = materialize(s.where(F.col("sw") >= w).select(*by, "py", "px", (F.col("sv") / F.greatest(F.col("sw"), F.lit(1e-6))).alias("z")), "smooth")
    return cur


def smoothing_coverage(before: DataFrame, after: DataFrame, bounds: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Valid pixels and coverage before and after, and how many were filled."""
    by = list(by)
    k = [*by, "py", "px"]
    n = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return (bounds.select(*by, (F.col("width").cast("long") * F.col("height")).alias("pixels"))
            .join(n(before, "valid_before"), by, "left").join(n(after, "valid_after"), by, "left")
            .join(n(after.join(before.select(*k), k, "left_anti"), "filled"), by, "left").na.fill(0)
            .withColumns({"coverage_before": F.col("valid_before") / F.col("pixels"), "coverage_after": F.col("valid_after") / F.col("pixels")}))


def tile_raster(raster: DataFrame, tile_px: int) -> DataFrame:
    """Add tile indices ty, tx; tiles have at least 128 pixels a side."""
    t = max(MIN_TILE, int(tile_px))
    return raster.withColumns({"ty": F.floor(F.col("py") / t), "tx": F.floor(F.col("px") / t)})


def tile_stats(raster: DataFrame, bounds: DataFrame, tile_px: int, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Per occupied tile: pixel range, filled share, and the 1%, 50% and 99% heights."""
    by = list(by)
    t = max(MIN_TILE, int(tile_px))
    q = quantiles(tile_raster(raster, tile_px), [*by, "ty", "tx"], ["z"], [0.01, 0.5, 0.99], bounded=True)
    j = q.join(bounds.select(*by, "width", "height"), by)
    w = F.least(F.lit(t), F.col("width") - F.col("tx") * t)
    h = F.least(F.lit(t), F.col("height") - F.col("ty") * t)
    return j.select(*by, "ty", "tx", (F.col("tx") * t).alias("x0"), (F.col("ty") * t).alias("y0"), w.alias("tile_width"), h.alias("tile_height"),
                    F.col("n").alias("num_pixels"), (F.col("n") / (w * h)).alias("fill"), F.col("z_q")[0].alias("p1"),
                    F.col("z_q")[1].alias("p50"), F.col("z_q")[2].alias("p99"))


def write_tiles(raster: DataFrame, path: str, tile_px: int, by: Sequence[str] = ("scene",)) -> None:
    """One Parquet partition per tile."""
    tile_raster(raster, tile_px).repartition(*by, "ty", "tx").write.mode("overwrite").partitionBy(*by, "ty", "tx").parquet(path)
