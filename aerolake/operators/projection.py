"""Unprojection, projection joins and what is built on them: z-buffers, view confidence, label fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import first_per_group, grouped_rank
from aerolake.session import materialize

# fixed values
MIN_DEPTH = 1e-6
MIN_TARGET_DEPTH = 0.04
CONF_EPS = 1e-10
FUSE_TOLERANCE = 0.1
ENTROPY_EPS = 1e-8
_FINER = 2

# edges of a view pyramid: apex 0 and the far corners 1..4
_EDGES = ((0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3), (3, 4), (4, 1))


def scaled_k(k: str | Column, sx: float | Column, sy: float | Column) -> Column:
    """Intrinsics rescaled to another grid size."""
    a = L.col(k)
    f = [sx, 1.0, sx, 1.0, sy, sy, 1.0, 1.0, 1.0]
    return F.array(*[a[i] * f[i] for i in range(9)])


def unproject(pixels: DataFrame, cams: DataFrame, key: Sequence[str] = ("scene", "frame"), stride: int = 1,
              z_max: float = float("inf"), depth: str = "z", k_size: tuple[int, int] | None = None,
              grid: tuple[int, int] | None = None) -> DataFrame:
    """World point (px, py, pz) of every pixel with a usable depth; intrinsics are scaled from ``k_size`` to ``grid``."""
    px = pixels.where(L.finite(depth) & (F.col(depth) > MIN_DEPTH) & (F.col(depth) < z_max))
    if stride > 1:
        px = px.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0))
    c = cams.select(*key, "k", "t_c2w")
    if k_size and grid and tuple(k_size) != tuple(grid):
        c = c.withColumn("k", scaled_k("k", grid[0] / k_size[0], grid[1] / k_size[1]))
    j = px.join(c, list(key))
    k, z = F.col("k"), F.col(depth)
    cam = [(F.col("x") - k[2]) * z / k[0], (F.col("y") - k[5]) * z / k[4], z]
    world = L.add(L.matvec(L.rot_of("t_c2w"), cam), L.trans_of("t_c2w"))
    return j.withColumns(dict(zip(("px", "py", "pz"), world))).select(*pixels.columns, "px", "py", "pz")


def projection_columns(pose: str | Column, k: str | Column, prefix: str = "__P") -> dict[str, Column]:
    """What a projection needs of a camera as sixteen columns, computed once per camera: inverse rotation, centre, focal
    lengths and principal point.

    Plain columns keep the join condition small; array reads per use would make it too large to be compiled. The centre is
    kept apart: folded into a 3x4 matrix it cancels with the point, and a point on a pixel or image border changes sides.
    """
    a = L.col(k)
    flat = [*[c for r in L.transpose(L.rot_of(pose)) for c in r], *L.trans_of(pose), a[0], a[2], a[4], a[5]]
    return {f"{prefix}{i}": c for i, c in enumerate(flat)}


def project(p: Sequence[Column], prefix: str = "__P") -> tuple[Column, Column, Column]:
    """(u, v, z) of a world point under ``projection_columns``."""
    m = [F.col(f"{prefix}{i}") for i in range(16)]
    d = [c - t for c, t in zip(p, m[9:12])]
    x, y, z = (m[3 * i] * d[0] + m[3 * i + 1] * d[1] + m[3 * i + 2] * d[2] for i in range(3))
    return m[12] * x / z + m[13], m[14] * y / z + m[15], z


def _pyramid_box(cams: DataFrame, bounds: DataFrame, by: Sequence[str], width: float, height: float) -> DataFrame:
    """xy box per camera of its view pyramid cut by the height range of the points of its group; none if they miss."""
    j = cams.join(bounds, list(by))
    t, r = L.trans_of("t_c2w"), L.rot_of("t_c2w")
    k = F.col("k")
    reach = L.norm([F.greatest(F.abs(t[i] - F.col(f"__lo{a}")), F.abs(t[i] - F.col(f"__hi{a}"))) for i, a in enumerate("xyz")])
    j = j.withColumn("__reach", reach).withColumn("__q0", F.array(*t))
    corners = {}
    for n, (u, v) in enumerate(((0.0, 0.0), (width, 0.0), (width, height), (0.0, height)), 1):
        ray = L.matvec(r, [(u - k[2]) / k[0], (v - k[5]) / k[4], F.lit(1.0)])
        corners[f"__q{n}"] = F.array(*[t[i] + ray[i] * F.col("__reach") for i in range(3)])
    j = j.withColumns(corners)
    point = lambda n: F.struct(*[F.col(f"__q{n}")[i].alias(a) for i, a in enumerate("xyz")])
    edges = F.array(*[F.struct(point(a).alias("a"), point(b).alias("b")) for a, b in _EDGES])

    def clip(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dz = b["z"] - a["z"]
        flat = F.abs(dz) < 1e-12
        s0, s1 = (F.col("__loz") - a["z"]) / dz, (F.col("__hiz") - a["z"]) / dz
        inside = (a["z"] >= F.col("__loz")) & (a["z"] <= F.col("__hiz"))
        lo = F.when(flat, F.when(inside, 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(s0, s1)))
        hi = F.when(flat, F.when(inside, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(s0, s1)))
        at = lambda s, c: a[c] + s * (b[c] - a[c])
        return F.when(lo <= hi, F.struct(
            F.least(at(lo, "x"), at(hi, "x")).alias("x0"), F.greatest(at(lo, "x"), at(hi, "x")).alias("x1"),
            F.least(at(lo, "y"), at(hi, "y")).alias("y0"), F.greatest(at(lo, "y"), at(hi, "y")).alias("y1")))

    j = j.withColumn("__s", F.filter(F.transform(edges, clip), lambda s: s.isNotNull()))
    pick = lambda f, c: f(F.transform("__s", lambda s: s[c]))
    box = {"__x0": F.greatest(pick(F.array_min, "x0"), F.col("__lox")), "__x1": F.least(pick(F.array_max, "x1"), F.col("__hix")),
           "__y0": F.greatest(pick(F.array_min, "y0"), F.col("__loy")), "__y1": F.least(pick(F.array_max, "y1"), F.col("__hiy"))}
    proj = projection_columns("t_c2w", "k")
    j = j.withColumns({**box, "__hit": F.size("__s") > 0, **proj})
    # written out before the filter: a filter pushed below the projection would evaluate the boxes again
    j = materialize(j.drop("t_c2w", "k").select(*[c for c in cams.columns if c not in ("t_c2w", "k")], "__hit", *box, *proj), "pyramids")
    return j.where("__hit AND __x0 <= __x1 AND __y0 <= __y1").drop("__hit")


def point_bounds(points: DataFrame, by: Sequence[str]) -> DataFrame:
    return points.groupBy(*by).agg(
        *[F.min(a).alias("__lo" + a) for a in "xyz"], *[F.max(a).alias("__hi" + a) for a in "xyz"])


def _level() -> Column:
    """Level of a box: its cells have the smallest power of two as edge that is no less than the box."""
    return F.ceil(F.log2(F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"), F.lit(1e-6)))).cast("int")


def _cell(c: str) -> Column:
    return F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__lv")))


def _cells(boxes: DataFrame) -> DataFrame:
    """One row per cell of level ``__lv`` that a box touches: at most four, as the box is no wider than a cell."""
    out = boxes.withColumn("__cx", F.explode(F.sequence(_cell("__x0"), _cell("__x1"))))
    return out.withColumn("__cy", F.explode(F.sequence(_cell("__y0"), _cell("__y1"))))


def box_cells(boxes: DataFrame, by: Sequence[str], finer: int = 0) -> tuple[DataFrame, DataFrame]:
    """(boxes exploded to the cells (__lv, __cx, __cy) they touch, levels in use per group).

    Every box has the level of its own size, so one wide box among many small ones is a handful of rows as well. ``finer``
    takes cells so many levels smaller: at most (2 ** finer + 1) squared rows a box.
    """
    levelled = boxes.withColumn("__lv", _level() - finer)
    return _cells(levelled), materialize(levelled.select(*by, "__lv").distinct(), "levels")


def point_cells(points: DataFrame, levels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every point in its cell of each level in use."""
    return points.join(levels, list(by)).withColumns({"__cx": _cell("x"), "__cy": _cell("y")})


def box_pairs(boxes: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Unordered pairs of boxes that overlap on the ground, columns prefixed a_ and b_.

    The smaller box looks at the levels from its own upwards. A pair is kept only in the cell that holds the lower corner
    of the shared box, so it appears once without a distinct.
    """
    names = [c for c in boxes.columns if c not in by]
    cells, levels = box_cells(boxes, by)
    at = [*by, "__lv", "__cx", "__cy"]
    b = cells.select(*at, *[F.col(c).alias("b_" + c) for c in names])
    a = boxes.withColumn("__own", _level()).join(levels, list(by)).where("__lv >= __own")
    a = _cells(a).select(*at, "__own", *[F.col(c).alias("a_" + c) for c in names])
    j = a.join(b, at).where((F.col("__own") < F.col("__lv")) | (F.col("a_" + key) < F.col("b_" + key)))
    edge = F.pow(F.lit(2.0), F.col("__lv"))
    for c in "xy":
        j = j.where((F.col(f"a___{c}0") <= F.col(f"b___{c}1")) & (F.col(f"b___{c}0") <= F.col(f"a___{c}1")))
        j = j.where(F.floor(F.greatest(f"a___{c}0", f"b___{c}0") / edge) == F.col(f"__c{c}"))
    return j.drop("__lv", "__cx", "__cy", "__own")


def project_join(points: DataFrame, cams: DataFrame, width: float, height: float, by: Sequence[str] = ("scene",),
                 view: str = "frame", keep: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """(by, view, point_id, u, v, z, kept columns) of every point seen by a view: z > 0 and inside the image.

    The equi-join key is a ground cell: each point has one per level of box sizes, each view those under its pyramid. The
    exact test follows. ``carry`` names columns of ``cams`` to add; they hold images, so views are not broadcast, and cells are
    smaller than the pyramids: few views of a cell miss its points, and points of one pyramid spread over tasks.
    """
    by = list(by)
    bounds = materialize(point_bounds(points, by), "bounds")
    boxes = _pyramid_box(cams.select(*by, view, "k", "t_c2w", *carry), bounds, by, width, height)
    if carry:
        pad = lambda c: (F.abs(c) + 1) * 1e-9
        boxes = boxes.withColumns({f"__{a}{n}": F.col(f"__{a}{n}") + pad(f"__{a}{n}") * (2 * n - 1) for a in "xy" for n in (0, 1)})
    cells, levels = box_cells(boxes, by, _FINER if carry else 0)
    p = point_cells(points.select(*by, "point_id", "x", "y", "z", *keep), levels, by).withColumnsRenamed({"x": "__x", "y": "__y", "z": "__z"})
    u, v, z = project(L.vec("__x", "__y", "__z"))
    at = [*by, "__lv", "__cx", "__cy"]
    if carry:
        near = p.join(cells.hint("merge"), at).where("__x >= __x0 AND __x <= __x1 AND __y >= __y0 AND __y <= __y1")
        # exploded, a projection is computed once; filters pushed below it would repeat it until the code is too large to be compiled
        uvz = F.explode(F.array(F.struct(u.alias("u"), v.alias("v"), z.alias("z"))))
        out = near.select(*by, view, "point_id", uvz.alias("__s"), *keep, *carry).select(*by, view, "point_id", "__s.u", "__s.v", "__s.z", *keep, *carry)
    else:
        out = p.join(cells.drop("__x0", "__x1", "__y0", "__y1"), at).select(*by, view, "point_id", u.alias("u"), v.alias("v"), z.alias("z"), *keep)
    return out.where((F.col("z") > 0) & (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))


def zbuffer(points: DataFrame, cams: DataFrame, width: int, height: int, trunc: float, by: Sequence[str] = ("scene",),
            view: str = "frame", colors: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Nearest depth below ``trunc`` per view pixel (rounded half to even), with the colour of that point."""
    p = project_join(points, cams, width, height, by, view, colors).where(F.col("z") < trunc)
    p = p.withColumns({"px": F.rint("u").cast("int"), "py": F.rint("v").cast("int")}).where(
        (F.col("px") < width) & (F.col("py") < height))
    return first_per_group(p.select(*by, view, "py", "px", "z", "point_id", *colors), [*by, view, "py", "px"], ["z", "point_id"])


def export_observations(points: DataFrame, cams: DataFrame, width: int, height: int, by: Sequence[str] = ("scene",),
                        view: str = "frame") -> tuple[DataFrame, DataFrame]:
    """(observations per view with 1-based point ids, header statistics per group).

    An observation row holds its position ``p2d_idx`` in the view, by point id. Statistics: views, points,
    mean observations per view over all views, mean track length over observed points.
    """
    by = list(by)
    seen = materialize(project_join(points, cams, width, height, by, view), "observations")
    obs = grouped_rank(seen.select(*by, view, (F.col("point_id") + 1).alias("point3d_id"), "u", "v"), [*by, view], ["point3d_id"], "p2d_idx")
    tracks = seen.groupBy(*by, "point_id").agg(F.count(F.lit(1)).alias("len"))
    t = tracks.groupBy(*by).agg(F.count(F.lit(1)).alias("num_points"), F.sum("len").alias("num_obs"), F.avg("len").alias("mean_track_length"))
    n = cams.groupBy(*by).agg(F.count(F.lit(1)).alias("num_images"))
    stats = n.join(t, by, "left").select(
        *by, "num_images", F.coalesce("num_points", F.lit(0).cast("long")).alias("num_points"),
        (F.coalesce("num_obs", F.lit(0)) / F.col("num_images")).alias("mean_observations"),
        F.coalesce("mean_track_length", F.lit(0.0)).alias("mean_track_length"))
    return obs, stats


def multiview_confidence(pixels: DataFrame, cams: DataFrame, pairs: DataFrame, width: int, height: int,
                         abs_tol: float = 0.02, rel_tol: float = 0.02, view: str = "frame", depth: str = "z",
                         by: Sequence[str] = ("scene",)) -> DataFrame:
    """Share of overlapping views whose depth agrees with a pixel; 1 for views without overlap.

    ``pairs(by, view, other)`` lists directed overlaps. A pixel counts in a view it projects into (z > 0.04); the view's
    depth is read at the nearest pixel, missing depth reads as 0.
    """
    by = list(by)
    px = unproject(pixels, cams, [*by, view], depth=depth).select(*by, view, "y", "x", "px", "py", "pz")
    other = cams.select(*by, F.col(view).alias("other"), *[c.alias(n) for n, c in projection_columns("t_c2w", "k").items()])
    j = px.join(pairs.select(*by, view, "other"), [*by, view]).join(other, [*by, "other"])
    u, v, z = project(L.vec("px", "py", "pz"))
    j = j.select(*by, view, "other", "y", "x", u.alias("u"), v.alias("v"), z.alias("zz"))
    j = j.where((F.col("zz") > MIN_TARGET_DEPTH) & (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))
    j = j.withColumns({"tx": F.least(F.rint("u"), F.lit(width - 1.0)).cast("int"), "ty": F.least(F.rint("v"), F.lit(height - 1.0)).cast("int")})
    tgt = pixels.select(*by, F.col(view).alias("other"), F.col("y").alias("ty"), F.col("x").alias("tx"), F.col(depth).alias("td"))
    j = j.join(tgt, [*by, "other", "ty", "tx"], "left")
    hit = F.abs(F.col("zz") - F.coalesce("td", F.lit(0.0))) < abs_tol + rel_tol * F.col("zz")
    votes = j.groupBy(*by, view, "y", "x").agg(F.count_if(hit).alias("inliers"), F.count_if(~hit).alias("outliers"))
    has = pairs.where(F.col(view) != F.col("other")).select(*by, view).distinct().withColumn("__ov", F.lit(True))
    out = pixels.select(*by, view, "y", "x").join(votes, [*by, view, "y", "x"], "left").join(has, [*by, view], "left")
    i, o = F.coalesce("inliers", F.lit(0)), F.coalesce("outliers", F.lit(0))
    conf = F.when(F.col("__ov"), i / (i + o + CONF_EPS)).otherwise(1.0)
    return out.select(*by, view, "y", "x", i.cast("long").alias("inliers"), o.cast("long").alias("outliers"), conf.alias("confidence"))


def _images(pixels: DataFrame, cols: Sequence[str], width: int, height: int, by: Sequence[str], view: str) -> DataFrame:
    """(by, view, one array per column): the values of an image at y * width + x, NULL where it has no pixel."""
    inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    row = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("i"), *cols)
    p = pixels.where(inside).groupBy(*by, view).agg(F.array_sort(F.collect_list(row), lambda a, b: a["i"] - b["i"]).alias("l"))
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("l", k - 1)["i"])
    fill = lambda c: F.flatten(F.transform("l", lambda s, k: F.concat(
        F.array_repeat(F.lit(None).cast(pixels.schema[c].dataType), s["i"] - before(k) - 1), F.array(s[c]))))
    return p.select(*by, view, *[fill(c).alias(c) for c in cols])


def fuse_semantics(points: DataFrame, cams: DataFrame, depth: DataFrame, scores: DataFrame, mode: str, width: int,
                   height: int, num_classes: int, by: Sequence[str] = ("scene",), view: str = "frame",
                   tol: float = FUSE_TOLERANCE) -> DataFrame:
    """Class per point from the views that see it at the right depth.

    ``depth(by, view, y, x, z)`` and ``scores(by, view, y, x, cls, logit)`` are per pixel. Modes: 'voting' (most best
    classes), 'average' (largest summed exp of the scores), 'weighted' (votes weighted by 1 - entropy / log C). Ties go
    to the lowest class, points without a view to class 0.
    """
    by = list(by)
    if mode not in ("voting", "average", "weighted"):
        raise ValueError(f"unknown fusion mode {mode}")
    # one pixel has num_classes rows: its scores fit in one array
    px = scores.groupBy(*by, view, "y", "x").agg(F.array_sort(F.collect_list(F.struct("cls", "logit"))).alias("l"))
    best = F.aggregate(F.slice("l", 2, num_classes), F.col("l")[0], lambda a, b: F.when(b["logit"] > a["logit"], b).otherwise(a))
    px = px.withColumn("cls", best["cls"])
    if mode == "average":
        votes = {"__w": F.transform("l", lambda s: F.exp(s["logit"])), "__c": F.transform("l", lambda s: s["cls"])}
    elif mode == "voting":
        votes = {"__c": F.col("cls")}
    else:
        top = F.array_max(F.transform("l", lambda a: a["logit"]))
        px = px.withColumn("__top", top).withColumn("__e", F.transform("l", lambda a: F.exp(a["logit"] - F.col("__top"))))
        px = px.withColumn("__t", F.aggregate("__e", F.lit(0.0), lambda a, e: a + e))
        ent = -F.aggregate("__e", F.lit(0.0), lambda a, e: a + e / F.col("__t") * F.log(e / F.col("__t") + ENTROPY_EPS))
        votes = {"__w": 1.0 - ent / F.log(F.lit(float(num_classes))), "__c": F.col("cls")}
    px = px.select(*by, view, "y", "x", *[c.alias(n) for n, c in votes.items()])
    px = depth.select(*by, view, "y", "x", F.col("z").alias("__d")).join(px.hint("merge"), [*by, view, "y", "x"])
    images = _images(px, ["__d", *votes], width, height, by, view)
    seen = project_join(points, cams.join(images, [*by, view]), width, height, by, view, carry=("__d", *votes))
    x, y = F.rint("u").cast("int"), F.rint("v").cast("int")
    at = lambda c: F.get(c, y * width + x)
    ok = seen.where((x < width) & (y < height) & (F.abs(F.col("z") - at("__d")) < tol))
    if mode == "average":
        v = ok.select(*by, "point_id", F.explode(F.arrays_zip(at("__c").alias("cls"), at("__w").alias("w"))).alias("s")).select(*by, "point_id", "s.cls", "s.w")
    else:
        v = ok.select(*by, "point_id", at("__c").alias("cls"), (at("__w") if mode == "weighted" else F.lit(1.0)).alias("w"))
    tally = v.groupBy(*by, "point_id", "cls").agg(F.round(F.sum("w"), 9).alias("w"))
    win = tally.groupBy(*by, "point_id").agg(F.min_by("cls", F.struct(-F.col("w"), F.col("cls"))).alias("cls"))
    return points.select(*by, "point_id").join(win, [*by, "point_id"], "left").select(
        *by, "point_id", F.coalesce("cls", F.lit(0)).cast("int").alias("cls"))
