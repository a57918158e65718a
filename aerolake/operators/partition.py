"""Footprints, flight frame, adaptive split tree, seams, temporal windows, chunk adjacency and ordering."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.functions import linalg as L
from aerolake.functions.graph import connected_components
from aerolake.functions.ranking import cap_per_group, grouped_rank, grouped_running_sum, quantiles, shifted
from aerolake.operators.neighbors import self_neighbours
from aerolake.operators.projection import box_pairs
from aerolake.session import materialize, scratch_path

# fixed values
CORE_SHARE = 0.7
DEGENERATE = 1e-9
REGION_EPS = 1e-6
GROUND_QUANTILE = 0.05
MAX_OVERLAP_RATIO = 0.95
# decimals to which distances between mean centres are compared: beyond them the order of a sum decides
TIE_DIGITS = 9


def core_target(max_chunk_size: int) -> int:
    """Frames a leaf aims for: 70% of the chunk size, leaving room for the seam."""
    m = max(1, int(max_chunk_size))
    return m if m <= 2 else max(1, min(m - 1, math.floor(m * CORE_SHARE)))


def footprints(points: DataFrame, key: Sequence[str] = ("scene", "frame"), axes: Sequence[str] = ("x", "y"),
               q: tuple[float, float] = (0.02, 0.98), min_points: int = 32, frames: DataFrame | None = None,
               predicted: bool = False) -> DataFrame:
    """Quantile box (a_min, b_min, a_max, b_max) and median centre (ca, cb) of the ground points of each frame.

    ``frames(key, t_c2w)`` adds frames without points. Status is 'ok' or 'too_few_points'; with ``predicted`` it is
    'predicted', 'predicted_sparse', 'camera_fallback' (the camera position) or 'invalid'.
    """
    key = list(key)
    a, b = axes
    ok = L.finite(a) & L.finite(b)
    s = quantiles(points.where(ok), key, [a, b], [q[0], 0.5, q[1]], bounded=True)
    pick = lambda c, i: F.col(f"{c}_q")[i]
    f = s.select(*key, F.col("n").alias("num_points"), pick(a, 0).alias("a_min"), pick(b, 0).alias("b_min"),
                 pick(a, 2).alias("a_max"), pick(b, 2).alias("b_max"), pick(a, 1).alias("ca"), pick(b, 1).alias("cb"))
    few = F.col("num_points") < min_points
    if frames is None:
        names = ("predicted_sparse", "predicted") if predicted else ("too_few_points", "ok")
        return f.withColumn("status", F.when(few, names[0]).otherwise(names[1]))
    j = frames.select(*key, "t_c2w").join(f, key, "left").withColumn("num_points", F.coalesce("num_points", F.lit(0).cast("long")))
    if not predicted:
        return j.drop("t_c2w").withColumn("status", F.when(few, "too_few_points").otherwise("ok"))
    t = L.trans_of("t_c2w")
    idx = {"x": 0, "y": 1, "z": 2}
    cam = [t[idx[c]] for c in axes]
    has_cam = F.coalesce((F.size("t_c2w") == 16) & L.finite(cam[0]) & L.finite(cam[1]), F.lit(False))
    empty = F.col("num_points") == 0
    fall = {c: F.when(empty & has_cam, v).otherwise(F.col(c))
            for c, v in (("ca", cam[0]), ("a_min", cam[0]), ("a_max", cam[0]), ("cb", cam[1]), ("b_min", cam[1]), ("b_max", cam[1]))}
    status = F.when(empty & has_cam, "camera_fallback").when(empty, "invalid").when(few, "predicted_sparse").otherwise("predicted")
    return j.withColumns(fall).withColumn("status", status).drop("t_c2w")


def lookat_footprints(cams: DataFrame, gt_points: DataFrame, by: Sequence[str] = ("scene",), frame: str = "frame",
                      requested_distance: float = 0.0) -> DataFrame:
    """Point (lx, ly, lz) each camera looks at: its view ray meets the ground height, else a point ahead of it.

    Ground is the 5% height quantile of the points, or the lowest camera. The distance ahead is the requested one, else
    the median camera distance to the median point, else the extent of the cameras, else 1.
    """
    by = list(by)
    ok = L.finite("x") & L.finite("y") & L.finite("z")
    g = quantiles(gt_points.where(ok), by, ["x", "y", "z"], [GROUND_QUANTILE, 0.5]).select(
        *by, F.col("z_q")[0].alias("zq"), *[F.col(f"{a}_q")[1].alias("m" + a) for a in "xyz"])
    t = L.trans_of("t_c2w")
    c = cams.select(*by, frame, *[v.alias("c" + a) for a, v in zip("xyz", t)],
                    *[F.col("t_c2w")[4 * i + 2].alias("f" + a) for i, a in enumerate("xyz")])
    ext = c.groupBy(*by).agg(F.min("cz").alias("zmin"), F.count(F.lit(1)).alias("nc"),
                             L.norm([F.max("c" + a) - F.min("c" + a) for a in "xyz"]).alias("span"))
    scene = materialize(ext.join(g, by, "left"), "ground")
    far = c.join(scene, by).select(*by, L.norm([F.col("c" + a) - F.col("m" + a) for a in "xyz"]).alias("d")).where("d > 1e-6")
    med = quantiles(far, by, ["d"], [0.5], derived=True).select(*by, F.col("d_q")[0].alias("dm"))
    span = F.when(F.col("nc") > 1, F.col("span")).otherwise(F.lit(math.sqrt(3.0)))
    ahead = F.coalesce("dm", F.when(span > 1e-6, span).otherwise(1.0))
    scene = materialize(scene.join(med, by, "left").select(*by, F.coalesce("zq", "zmin").alias("zg"), ahead.alias("ahead")), "lookat")
    j = c.join(scene, by)
    n = L.norm(L.vec("fx", "fy", "fz"))
    j = j.withColumns({f"f{a}": F.col(f"f{a}") / n for a in "xyz"})
    hit = F.when(F.abs("fz") > 1e-8, (F.col("zg") - F.col("cz")) / F.col("fz"))
    dist = F.lit(float(requested_distance)) if requested_distance > 0 else F.col("ahead")
    s = F.when(hit > 1e-6, hit).otherwise(F.greatest(dist, F.lit(1e-6)))
    return j.select(*by, frame, *[(F.col("c" + a) + F.col("f" + a) * s).alias("l" + a) for a in "xyz"],
                    (hit > 1e-6).alias("on_ground")).withColumn("on_ground", F.coalesce("on_ground", F.lit(False)))


def infer_axes(cams: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """The two axes with the largest extent of camera centres, in xyz order, as text such as 'xy'."""
    t = L.trans_of("t_c2w")
    ext = cams.groupBy(*by).agg(*[(F.max(v) - F.min(v)).alias("w" + a) for a, v in zip("xyz", t)])
    ranked = F.slice(F.array_sort(F.array(*[F.struct((-F.col("w" + a)).alias("w"), F.lit(a).alias("a")) for a in "xyz"])), 1, 2)
    return ext.select(*by, F.array_join(F.array_sort(F.transform(ranked, lambda s: s["a"])), "").alias("axes"))


def flight_frame(cams: DataFrame, by: Sequence[str] = ("scene",), order: Sequence[str] = ("frame",),
                 axes: Sequence[int] = (0, 1)) -> DataFrame:
    """(by, ox, oy, dx, dy, angle_deg, method): median origin and main flight direction of the camera path.

    The direction is the main axis of the unit displacements between consecutive frames, of the positions if nothing
    moves, else x; its sign follows the way from the first to the last frame.
    """
    by = list(by)
    t = L.trans_of("t_c2w")
    c = cams.select(*by, *order, t[axes[0]].alias("u"), t[axes[1]].alias("v")).where(L.finite("u") & L.finite("v"))
    c = materialize(grouped_rank(c, by, order, "rk"), "path")
    n = shifted(c.select(*by, "rk", "u", "v"), by, "rk", 1, ["u", "v"], "n_")
    d = n.withColumns({"du": F.col("n_u") - F.col("u"), "dv": F.col("n_v") - F.col("v")}).withColumn("len", L.norm(L.vec("du", "dv")))
    good = F.col("len") > 1e-8
    uu, vv = F.when(good, F.col("du") / F.col("len")), F.when(good, F.col("dv") / F.col("len"))
    mom = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("moves"), F.sum(uu * uu).alias("sxx"), F.sum(uu * vv).alias("sxy"), F.sum(vv * vv).alias("syy"),
        F.var_pop("u").alias("pxx"), F.covar_pop("u", "v").alias("pxy"), F.var_pop("v").alias("pyy"),
        F.min_by(F.struct("u", "v"), "rk").alias("first"), F.max_by(F.struct("u", "v"), "rk").alias("last"))
    med = quantiles(c, by, ["u", "v"], [0.5]).select(*by, F.col("u_q")[0].alias("ox"), F.col("v_q")[0].alias("oy"))
    moved = F.col("moves") > 0
    axis = lambda p: 0.5 * F.atan2(2.0 * F.col(p + "xy"), F.col(p + "xx") - F.col(p + "yy"))
    mom = mom.withColumns({
        "ang": F.when(moved, axis("s")).when(F.col("n") >= 2, axis("p")).otherwise(0.0),
        "method": F.when(moved, "pose_delta_orientation").when(F.col("n") >= 2, "pose_position_pca").otherwise("fallback_identity")})
    mom = mom.withColumns({"dx": F.cos("ang"), "dy": F.sin("ang")})
    back = F.col("dx") * (F.col("last.u") - F.col("first.u")) + F.col("dy") * (F.col("last.v") - F.col("first.v")) < 0
    mom = mom.withColumn("sg", F.when(back, -1.0).otherwise(1.0)).withColumns({"dx": F.col("dx") * F.col("sg"), "dy": F.col("dy") * F.col("sg")})
    return mom.join(med, by).select(*by, "ox", "oy", "dx", "dy", F.degrees(F.atan2("dy", "dx")).alias("angle_deg"), "method")


def to_flight(df: DataFrame, frame: DataFrame, by: Sequence[str] = ("scene",), cols: Sequence[str] = ("x", "y")) -> DataFrame:
    """World points to along-track and cross-track coordinates."""
    j = df.join(frame.select(*by, "ox", "oy", "dx", "dy"), list(by))
    p, q = F.col(cols[0]) - F.col("ox"), F.col(cols[1]) - F.col("oy")
    new = {cols[0]: F.col("dx") * p + F.col("dy") * q, cols[1]: -F.col("dy") * p + F.col("dx") * q}
    return j.withColumns(new).select(*df.columns)


def from_flight(df: DataFrame, frame: DataFrame, by: Sequence[str] = ("scene",), cols: Sequence[str] = ("x", "y")) -> DataFrame:
    """Inverse of ``to_flight``."""
    j = df.join(frame.select(*by, "ox", "oy", "dx", "dy"), list(by))
    p, q = F.col(cols[0]), F.col(cols[1])
    new = {cols[0]: F.col("dx") * p - F.col("dy") * q + F.col("ox"), cols[1]: F.col("dy") * p + F.col("dx") * q + F.col("oy")}
    return j.withColumns(new).select(*df.columns)


def boxes_to_flight(df: DataFrame, frame: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """Boxes (a_min, b_min, a_max, b_max) to the bounds of their four turned corners."""
    j = df.join(frame.select(*by, "ox", "oy", "dx", "dy"), list(by))
    corners = [(F.col(p) - F.col("ox"), F.col(q) - F.col("oy")) for p in ("a_min", "a_max") for q in ("b_min", "b_max")]
    u = [F.col("dx") * p + F.col("dy") * q for p, q in corners]
    v = [-F.col("dy") * p + F.col("dx") * q for p, q in corners]
    return j.withColumns({"a_min": F.least(*u), "a_max": F.greatest(*u), "b_min": F.least(*v), "b_max": F.greatest(*v)}).select(*df.columns)


def split_tree(foot: DataFrame, max_chunk_size: int, by: Sequence[str] = ("scene",), frame: str = "frame",
               target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignment of frames to leaves, leaves): median splits of all groups and cells, one level at a time.

    ``foot`` holds finite centres ca, cb and boxes. A cell with more than the target is halved along its longer extent
    (the root along ca when that has extent), lower values and then lower frames to the left. A leaf keeps its path of
    0/1 steps and its region r0..r1 (ca) and s0..s1 (cb).
    """
    by = list(by)
    target = core_target(max_chunk_size) if target is None else target
    region = foot.groupBy(*by).agg(F.min("a_min").alias("r0"), F.max("a_max").alias("r1"), F.min("b_min").alias("s0"), F.max("b_max").alias("s1"))
    eps = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("s1") - F.col("s0")), F.lit(1.0)) * REGION_EPS
    region = region.withColumn("__e", eps)
    for lo, hi in (("r0", "r1"), ("s0", "s1")):
        thin = F.col(hi) - F.col(lo) <= DEGENERATE
        region = region.withColumns({lo: F.when(thin, F.col(lo) - F.col("__e")).otherwise(F.col(lo)),
                                     hi: F.when(thin, F.col(hi) + F.col("__e")).otherwise(F.col(hi))})
    cells = region.drop("__e").withColumn("path", F.lit(""))
    todo = foot.select(*by, frame, "ca", "cb").withColumn("path", F.lit(""))
    done: list[DataFrame] = []
    leaf_parts: list[DataFrame] = []
    key = [*by, "path"]
    while True:
        size = todo.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"), (F.max("ca") - F.min("ca")).alias("ea"), (F.max("cb") - F.min("cb")).alias("eb"))
        root = (F.col("path") == "") & (F.col("ea") > DEGENERATE)
        size = size.withColumn("axis", F.when(root | (F.col("ea") >= F.col("eb")), 0).otherwise(1))
        cells = materialize(cells.join(size, key), "cells")
        leaf = cells.where(F.col("n") <= target)
        leaf_parts.append(leaf.select(*key, "n", "r0", "r1", "s0", "s1"))
        done.append(todo.join(leaf.select(*key), key, "left_semi"))
        split = cells.where(F.col("n") > target)
        if split.isEmpty():
            break
        rows = todo.join(split.select(*key, "n", "axis"), key).withColumn("v", F.when(F.col("axis") == 0, F.col("ca")).otherwise(F.col("cb")))
        rows = grouped_rank(rows, key, ["v", frame], "rk")
        rows = materialize(rows.withColumn("side", (F.col("rk") >= F.floor(F.col("n") / 2)).cast("int")), "split")
        mid = rows.groupBy(*key).agg(((F.max(F.when(F.col("side") == 0, F.col("v"))) + F.min(F.when(F.col("side") == 1, F.col("v")))) / 2).alias("th"))
        cut = split.join(mid, key)
        lo = F.when(F.col("axis") == 0, F.col("r0")).otherwise(F.col("s0"))
        hi = F.when(F.col("axis") == 0, F.col("r1")).otherwise(F.col("s1"))
        cut = cut.withColumn("th", F.when((F.col("th") > lo) & (F.col("th") < hi), F.col("th")).otherwise((lo + hi) / 2))
        kids = cut.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        bound = lambda c, axis, side: F.when((F.col("axis") == axis) & (F.col("side") == side), F.col("th")).otherwise(F.col(c)).alias(c)
        step = F.concat("path", F.col("side").cast("string")).alias("path")
        cells = kids.select(*by, bound("r0", 0, 1), bound("r1", 0, 0), bound("s0", 1, 1), bound("s1", 1, 0), step)
        todo = rows.select(*by, frame, "ca", "cb", step)
    assign, leaves = done[0], leaf_parts[0]
    for a, b in zip(done[1:], leaf_parts[1:]):
        assign, leaves = assign.unionByName(a), leaves.unionByName(b)
    # leaves are numbered by the centre of their region
    mid = lambda p, q: (F.col(p) + F.col(q)) / 2
    leaves = grouped_rank(leaves.withColumns({"__a": mid("r0", "r1"), "__b": mid("s0", "s1")}), by, ["__a", "__b", "path"], "cell_order")
    return assign.select(*by, frame, "path"), leaves.drop("__a", "__b")


def assign_seams(assign: DataFrame, leaves: DataFrame, foot: DataFrame, max_chunk_size: int, min_chunk_size: int,
                 margin: float, by: Sequence[str] = ("scene",), frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """(chunks, members): every leaf with enough frames becomes a chunk, filled up with frames of adjacent leaves.

    Leaves are adjacent when their regions are within the margin on both axes. Candidates come in the order (beyond the
    margin, distance of the frame's box to the region, frame). Members have role 'core' or 'overlap'.
    """
    by = list(by)
    lv = leaves.withColumns({"__x0": F.col("r0") - margin, "__x1": F.col("r1") + margin, "__y0": F.col("s0") - margin, "__y1": F.col("s1") + margin})
    cols = ["path", "n", "r0", "r1", "s0", "s1"]
    once = box_pairs(lv.select(*by, *cols, "__x0", "__x1", "__y0", "__y1"), by, "path")
    near = lambda lo, hi: F.greatest(F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"a_{hi}")) <= margin + 1e-9
    once = once.where(near("r0", "r1") & near("s0", "s1"))
    side = lambda p, q: once.select(*by, *[F.col(p + c).alias(c) for c in cols], F.col(q + "path").alias("b_path"))
    adj = side("a_", "b_").unionAll(side("b_", "a_")).where(F.col("n") >= min_chunk_size)
    frames = assign.join(foot.select(*by, frame, "a_min", "a_max", "b_min", "b_max"), [*by, frame]).withColumnRenamed("path", "b_path")
    gap = lambda lo, hi, p, q: F.greatest(F.lit(0.0), F.col(lo) - F.col(q), F.col(p) - F.col(hi))
    cand = adj.join(frames, [*by, "b_path"]).withColumn("dist", L.norm([gap("a_min", "a_max", "r0", "r1"), gap("b_min", "b_max", "s0", "s1")]))
    cand = materialize(cand.withColumn("far", (F.col("dist") > margin + 1e-9).cast("int")).select(*by, "path", "n", frame, "dist", "far"), "seams")
    budget = F.greatest(F.lit(0), F.lit(int(max_chunk_size)) - F.col("n"))
    taken = cap_per_group(cand, [*by, "path"], ["far", "dist", frame], budget)
    kept = grouped_rank(leaves.where(F.col("n") >= min_chunk_size), by, ["cell_order"], "chunk_id")
    tot = cand.groupBy(*by, "path").agg(F.count(F.lit(1)).alias("num_seam_candidates"))
    chunks = kept.join(tot, [*by, "path"], "left").withColumn("num_seam_candidates", F.coalesce("num_seam_candidates", F.lit(0).cast("long")))
    chunks = chunks.withColumn("num_dropped_seam", F.greatest(F.lit(0).cast("long"), F.col("num_seam_candidates") - budget))
    chunks = materialize(chunks.withColumnRenamed("n", "num_core"), "chunks")
    ids = chunks.select(*by, "path", "chunk_id")
    core = assign.join(ids, [*by, "path"]).select(*by, "chunk_id", frame, F.lit("core").alias("role"))
    over = taken.join(ids, [*by, "path"]).select(*by, "chunk_id", frame, F.lit("overlap").alias("role"))
    return chunks, core.unionByName(over)


def temporal_chunks(frames: DataFrame, max_size: int, ratio: float, min_size: int = 0, merge_tail: bool = False,
                    by: Sequence[str] = ("scene",), order: Sequence[str] = ("frame",)) -> DataFrame:
    """Members (by, chunk_id, order columns, pos, role) of overlapping windows over the frame order of each group.

    A frame shared with the previous window is 'overlap', else 'core'. ``merge_tail`` joins a last window with fewer
    than ``min_size`` core frames to the one before.
    """
    by = list(by)
    r = min(max(float(ratio), 0.0), MAX_OVERLAP_RATIO)
    over = min(max(0, math.ceil(max_size * r) if r > 0 else 0), max_size - 1)
    step = max_size - over
    f = grouped_rank(frames.select(*by, *order), by, order, "pos")
    n = f.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    last = F.when(F.col("__n") <= max_size, 0).otherwise(F.ceil((F.col("__n") - max_size) / step)).cast("long")
    j = f.join(n.withColumn("__last", last), by)
    lo = F.greatest(F.lit(0).cast("long"), F.floor((F.col("pos") - max_size) / step) + 1)
    hi = F.least(F.col("__last"), F.floor(F.col("pos") / step))
    j = j.withColumn("chunk_id", F.explode(F.sequence(lo, hi)))
    shared = (F.col("chunk_id") > 0) & (F.col("pos") < (F.col("chunk_id") - 1) * step + max_size)
    j = j.withColumn("role", F.when(shared, "overlap").otherwise("core"))
    if merge_tail:
        tail_core = F.col("__n") - ((F.col("__last") - 1) * step + max_size)
        tail = (F.col("__last") > 0) & (tail_core < min_size) & (F.col("chunk_id") == F.col("__last"))
        j = j.where(~(tail & (F.col("role") == "overlap")))
        j = j.withColumn("chunk_id", F.when(tail, F.col("chunk_id") - 1).otherwise(F.col("chunk_id")))
    return j.select(*by, "chunk_id", *order, "pos", "role")


def chunk_centres(members: DataFrame, cams: DataFrame, by: Sequence[str] = ("scene",), frame: str = "frame") -> DataFrame:
    """Mean camera centre of the core frames of each chunk (all frames when it has no core)."""
    by = list(by)
    t = L.trans_of("t_c2w")
    c = cams.select(*by, frame, *[v.alias(a) for a, v in zip("xyz", t)])
    core = F.col("role") == "core"
    avg = lambda a: F.coalesce(F.avg(F.when(core, F.col(a))), F.avg(a)).alias("c" + a)
    # both sides have a row per frame, whatever the size of their files says
    return members.hint("merge").join(c, [*by, frame]).groupBy(*by, "chunk_id").agg(*[avg(a) for a in "xyz"])


def chunk_adjacency(members: DataFrame, chunks: DataFrame, centres: DataFrame, by: Sequence[str] = ("scene",),
                    frame: str = "frame", tree: bool = True) -> DataFrame:
    """Directed edges (by, chunk_id, other, dist, rank): chunks that share a frame, or are siblings in the split tree.

    A chunk without an edge is linked to the nearest other centre. ``rank`` orders the neighbours by distance,
    ``cell_order`` and id; distances are equal here if they agree to ``TIE_DIGITS``, since the rounding of means follows the order
    in which rows arrive. ``chunks`` holds chunk_id, cell_order and, with ``tree``, path.
    """
    by = list(by)
    # a frame lies in a few chunks, and their pairs come from its list; a table of members compresses so well that a join of it
    # with itself would be taken for a small one and broadcast
    lists = members.groupBy(*by, frame).agg(F.collect_set("chunk_id").alias("l")).where(F.size("l") > 1)
    pair = lists.select(*by, "l", F.explode("l").alias("chunk_id")).select(
        *by, "chunk_id", F.explode(F.filter("l", lambda o: o > F.col("chunk_id"))).alias("other"))
    if tree:
        # a parent of the binary tree has at most two leaves as children
        s = chunks.where("path <> ''").select(*by, "chunk_id", F.expr("left(path, length(path) - 1)").alias("up"))
        pair = pair.unionByName(s.join(s.withColumnRenamed("chunk_id", "other"), [*by, "up"]).where("chunk_id < other").select(*by, "chunk_id", "other"))
    pair = materialize(pair.distinct(), "adjacent")
    both = pair.unionByName(pair.select(*by, F.col("other").alias("chunk_id"), F.col("chunk_id").alias("other")))
    alone = chunks.select(*by, "chunk_id").join(both, [*by, "chunk_id"], "left_anti")
    if not alone.isEmpty():
        near = self_neighbours(centres, 1, by, ("cx", "cy", "cz"), key="chunk_id").where("near IS NOT NULL")
        link = near.select(*by, F.col("sid").alias("chunk_id"), F.col("near")[0]["tid"].alias("other"))
        link = alone.join(link, [*by, "chunk_id"]).where("other IS NOT NULL")
        both = both.unionByName(link).unionByName(link.select(*by, F.col("other").alias("chunk_id"), F.col("chunk_id").alias("other"))).distinct()
    c = centres.select(*by, "chunk_id", "cx", "cy", "cz")
    o = c.select(*by, F.col("chunk_id").alias("other"), *[F.col("c" + a).alias("o" + a) for a in "xyz"])
    j = both.join(c, [*by, "chunk_id"]).join(o, [*by, "other"]).withColumn("dist", L.norm([F.col("c" + a) - F.col("o" + a) for a in "xyz"]))
    j = j.join(chunks.select(*by, F.col("chunk_id").alias("other"), "cell_order"), [*by, "other"])
    # ranks run inside one chunk's neighbour list
    w = Window.partitionBy(*by, "chunk_id").orderBy(F.round("dist", TIE_DIGITS), "cell_order", "other")
    return j.select(*by, "chunk_id", "other", "dist", (F.row_number().over(w) - 1).alias("rank"))


def order_spatial(chunks: DataFrame, adjacency: DataFrame, centres: DataFrame, cams: DataFrame, by: Sequence[str] = ("scene",)) -> DataFrame:
    """(by, chunk_id, exec_order): breadth-first from the chunk nearest the scene centre, all groups together.

    Neighbours follow their rank. When a component is used up, the next one starts at the unvisited chunk nearest to the
    mean of the visited ones, then to the scene centre, then by id. Components come first: where each of them starts follows
    from counts and sums of those before, one round per component of a scene. Then all of them are searched at once, so the rounds
    follow the greatest depth; a level's neighbours lie in it or in the levels beside it, so only these are looked at. ``adjacency``
    holds both directions.
    """
    by = list(by)
    spark = chunks.sparkSession
    t = L.trans_of("t_c2w")
    centre = materialize(cams.groupBy(*by).agg(*[F.avg(v).alias("s" + a) for a, v in zip("xyz", t)]), "scene-centre")
    node = chunks.select(*by, "chunk_id").join(centres, [*by, "chunk_id"]).join(centre, by)
    node = node.withColumn("home", F.round(L.norm([F.col("c" + a) - F.col("s" + a) for a in "xyz"]), TIE_DIGITS))
    comp = connected_components(node, adjacency, by, "chunk_id", "other")
    node = materialize(node.join(comp, [*by, "chunk_id"]), "nodes")
    size = materialize(node.groupBy(*by, "comp").agg(F.count(F.lit(1)).alias("n"), *[F.sum("c" + a).alias("v" + a) for a in "xyz"]), "component-sizes")
    # where the components start, and in which order
    first = F.min_by(F.struct("chunk_id", "comp"), F.struct("home", "chunk_id")).alias("f")
    opened = node.groupBy(*by).agg(first).select(*by, "f.chunk_id", "f.comp", F.lit(0).alias("k"))
    opened = materialize(opened.join(size, [*by, "comp"]), "opened")
    while True:
        rest = node.join(opened.select(*by, "comp"), [*by, "comp"], "left_anti")
        mean = opened.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("k"), *[(F.sum("v" + a) / F.sum("n")).alias("m" + a) for a in "xyz"])
        rest = rest.join(mean, by).withColumn("d", F.round(L.norm([F.col("c" + a) - F.col("m" + a) for a in "xyz"]), TIE_DIGITS))
        nxt = F.min_by(F.struct("chunk_id", "comp"), F.struct("d", "home", "chunk_id")).alias("f")
        fresh = materialize(rest.groupBy(*by, "k").agg(nxt).select(*by, "f.chunk_id", "f.comp", "k"), "next-component")
        if fresh.isEmpty():
            break
        opened = materialize(opened.unionByName(fresh.join(size, [*by, "comp"])), "opened")
    offset = materialize(grouped_running_sum(opened, by, ["k"], "n", "offset").select(*by, "comp", "offset"), "offsets")
    # places in the components, level by level
    key = [*by, "comp"]
    path, level = scratch_path(spark, "bfs"), 0
    front = opened.select(*key, "chunk_id", F.lit(0).cast("long").alias("pos"))
    schema, before = front.schema, front.limit(0)
    while True:
        front.write.parquet(f"{path}/level={level}")
        front = spark.read.schema(schema).parquet(f"{path}/level={level}")
        reach = adjacency.join(front, [*by, "chunk_id"]).select(*key, F.col("other").alias("chunk_id"), F.struct("pos", "rank").alias("via"))
        beside = front.select(*by, "chunk_id").unionByName(before.select(*by, "chunk_id"))
        reach = reach.join(beside, [*by, "chunk_id"], "left_anti").groupBy(*key, "chunk_id").agg(F.min("via").alias("via"))
        reach = materialize(reach, "reach")
        if reach.isEmpty():
            break
        used = front.groupBy(*key).agg((F.max("pos") + 1).alias("used"))
        nxt = grouped_rank(reach, key, ["via", "chunk_id"], "k").join(used, key)
        before, front, level = front, nxt.select(*key, "chunk_id", (F.col("used") + F.col("k")).alias("pos")), level + 1
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("level", T.IntegerType())])).parquet(path)
    return found.join(offset, key).select(*by, "chunk_id", (F.col("offset") + F.col("pos")).alias("exec_order"))


def order_sequential(chunks: DataFrame, by: Sequence[str] = ("scene",), order: Sequence[str] = ("cell_order", "chunk_id")) -> DataFrame:
    """(by, chunk_id, exec_order, parent_order, level): a chain in which every chunk hangs on the one before."""
    r = grouped_rank(chunks.select(*by, *order), by, order, "exec_order")
    return r.select(*by, "chunk_id", "exec_order", F.when(F.col("exec_order") > 0, F.col("exec_order") - 1).alias("parent_order"),
                    F.col("exec_order").alias("level"))


def chunk_summary(chunks: DataFrame, members: DataFrame, frames: DataFrame, min_size: int, by: Sequence[str] = ("scene",),
                  frame: str = "frame") -> DataFrame:
    """Per group: core-size statistics (population deviation), small chunks, seam totals and share of frames in a core."""
    by = list(by)
    core = members.where("role = 'core'")
    size = core.groupBy(*by, "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    s = size.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_chunks"), F.min("n").alias("core_min"), F.max("n").alias("core_max"), F.avg("n").alias("core_mean"),
        F.stddev_pop("n").alias("core_std"), F.count_if(F.col("n") < min_size).alias("under_min"))
    seam = chunks.groupBy(*by).agg(F.sum("num_seam_candidates").alias("seam_candidates"), F.sum("num_dropped_seam").alias("seam_dropped"))
    # a frame is core in one chunk at most, so rows count frames
    cover = frames.select(*by, frame).join(core.select(*by, frame, F.lit(1).alias("c")).distinct(), [*by, frame], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_frames"), F.count("c").alias("covered"))
    return cover.join(s, by, "left").join(seam, by, "left").withColumn("coverage", F.col("covered") / F.col("num_frames"))


def overlap_uses(members: DataFrame, by: Sequence[str] = ("scene",), frame: str = "frame") -> DataFrame:
    """How often each frame still serves as overlap."""
    return members.where("role = 'overlap'").groupBy(*by, frame).agg(F.count(F.lit(1)).alias("uses"))
