"""Alignment of overlapping chunks: shared-view correspondences, tree and chain merges, final gauge, ICP, seam error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import cap_per_group, quantiles
from aerolake.operators.alignment import align_chunks, eye, fit_sim3, zeros
from aerolake.operators.matching import apply_sim3_points, apply_sim3_poses, centre_correspondences, compose_columns, match_cameras
from aerolake.operators.mergetree import grid_shapes, key_tree, merge_tree, parent_tree
from aerolake.operators.neighbors import build_index, nn_join
from aerolake.operators.sampling import sample_cap
from aerolake.session import materialize

CHUNK = ["scene", "chunk_id"]
PT = ("px", "py", "pz")
PT3 = ("x", "y", "z")


def identity_transforms(chunks: DataFrame) -> DataFrame:
    return chunks.select(*CHUNK, F.lit(1.0).alias("s"), eye().alias("r"), zeros().alias("t"))


def pick_predictions(members: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, frame, chunk_id): whose prediction stands for a frame in a group of chunks: core first, then the lowest chunk."""
    m = members.join(groups, CHUNK)
    best = F.min(F.struct((F.col("role") != "core").alias("o"), F.col("chunk_id").alias("c")))
    return m.groupBy(*by, "frame").agg(best.alias("b")).select(*by, "frame", F.col("b.c").alias("chunk_id"))


def shared_correspondences(points: DataFrame, transforms: DataFrame, src: DataFrame, dst: DataFrame, by: Sequence[str],
                           shapes: DataFrame | None = None, cap_view: int = 0, cap_total: int = 0, seed: int = 0) -> DataFrame:
    """Same frame and pixel, valid on both sides: (by, frame, y, x, sx..dz) in the current aligned coordinates.

    ``src`` and ``dst`` are ``pick_predictions`` of the two sides. Frames whose grids differ in shape are left out.
    Caps keep the rows of lowest seeded hash, per view and then per group; 0 means no cap.
    """
    by = list(by)
    pair = dst.withColumnRenamed("chunk_id", "cd").join(src.withColumnRenamed("chunk_id", "cs"), [*by, "frame"])
    if shapes is not None:
        side = lambda n: shapes.select("scene", F.col("chunk_id").alias(n), "frame", F.struct("h", "w").alias("shape_" + n))
        pair = pair.join(side("cs"), ["scene", "cs", "frame"]).join(side("cd"), ["scene", "cd", "frame"]).where("shape_cs = shape_cd").drop("shape_cs", "shape_cd")
    pair = materialize(pair, "shared")
    ok = points.where("valid").select(*CHUNK, "frame", "y", "x", *PT).where(L.finite("px") & L.finite("py") & L.finite("pz"))

    def moved(side: str, prefix: str) -> DataFrame:
        p = ok.join(pair.select("scene", F.col(side).alias("chunk_id"), "frame").distinct(), [*CHUNK, "frame"], "left_semi")
        p = apply_sim3_points(p, transforms, CHUNK, PT)
        return p.withColumnsRenamed({"chunk_id": side, **{c: prefix + c[1] for c in PT}})

    j = pair.join(moved("cs", "s"), ["scene", "cs", "frame"]).join(moved("cd", "d"), ["scene", "cd", "frame", "y", "x"])
    if cap_view > 0:
        # a view has the pixels of one image
        w = Window.partitionBy(*by, "frame").orderBy(L.uniform(seed, *by, "frame", "y", "x"), "y", "x")
        j = j.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= cap_view).drop("__k")
    if cap_total > 0:
        j = cap_per_group(j, by, [L.uniform(seed + 1, *by, "frame", "y", "x"), "frame", "y", "x"], cap_total)
    return j.select(*by, "frame", "y", "x", "sx", "sy", "sz", "dx", "dy", "dz")


def align_hierarchy(chunks: DataFrame, members: DataFrame, points: DataFrame, mode: str = "yaw_translation", min_corr: int = 512,
                    cap_view: int = 0, cap_total: int = 0, balance: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Bottom-up merge along the chunk keys of ``chunks(scene, chunk_id, key ARRAY<INT>)``: (transforms, edges).

    Nodes with the same parent key form a group; its largest node, then lowest key, is the anchor. The other nodes are
    fitted to it one after another and join it even when the fit fails. All parents of all scenes run together. Chunks
    with one key are fitted to each other as well: the key of each is extended by its place among them.
    """
    same = Window.partitionBy("scene", "key")
    # chunks of one leaf of the tree
    chunks = chunks.select(*CHUNK, "key", (F.row_number().over(same.orderBy("chunk_id")) - 1).alias("__k"), F.count(F.lit(1)).over(same).alias("__n"))
    chunks = chunks.select(*CHUNK, F.when(F.col("__n") > 1, F.concat("key", F.array("__k"))).otherwise(F.col("key")).alias("key"))
    return merge_tree(key_tree(chunks), members, points, mode, min_corr, cap_view, cap_total, balance, seed)


def align_parent_graph(chunks: DataFrame, members: DataFrame, points: DataFrame, mode: str = "yaw_translation", min_corr: int = 512,
                       cap_view: int = 0, cap_total: int = 0, balance: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Merge along ``chunks(scene, chunk_id, parent_id, level)``: deepest level first, each chunk with all that joined it
    is fitted to its parent's group. Children of one parent follow their id. Returns (transforms, edges)."""
    return merge_tree(parent_tree(chunks), members, points, mode, min_corr, cap_view, cap_total, balance, seed)


def align_global(transforms: DataFrame, cams: DataFrame, ref: DataFrame, mode: str, order: Sequence[str] = ("chunk_id",),
                 max_pairs: int = 0) -> tuple[DataFrame, DataFrame]:
    """One fit per scene of all aligned cameras to the reference poses, composed on every chunk: (transforms, fit).

    ``cams(scene, chunk_id, stem, t_c2w)`` are the raw predictions; the first camera per stem counts. ``max_pairs`` as in
    ``align_chunks``.
    """
    moved = apply_sim3_poses(cams, transforms, CHUNK)
    m = match_cameras(moved, ref, order)
    fit = align_chunks(centre_correspondences(m, "scene", "stem"), transforms, ["scene"], mode, ["stem"], max_pairs)
    fit = materialize(fit, "gauge")
    j = transforms.join(fit.select("scene", F.col("s").alias("s2"), F.col("r").alias("r2"), F.col("t").alias("t2")), "scene")
    s, r, t = compose_columns((F.col("s"), F.col("r"), F.col("t")), (F.col("s2"), F.col("r2"), F.col("t2")))
    return j.select(*CHUNK, s.alias("s"), r.alias("r"), t.alias("t")), fit


def _icp_start(src: DataFrame, by: Sequence[str]) -> DataFrame:
    return materialize(src.select(*by).distinct().select(
        *by, F.lit(1.0).alias("s"), eye().alias("r"), zeros().alias("t"), F.lit(0).cast("long").alias("num_corr"),
        F.lit(None).cast("double").alias("last_median")), "icp-total")


def _icp_round(cur: DataFrame, nn: DataFrame, total: DataFrame, fit: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Compose ``fit(by, n2, med, s2, r2, t2)`` onto ``total`` and move the points: (points, total).

    A point's neighbour of this round is at most its distance and the way the point moved away in the next one (``bound``)."""
    j = total.join(fit, by, "left")
    s, r, t = compose_columns((F.col("s"), F.col("r"), F.col("t")), (F.col("s2"), F.col("r2"), F.col("t2")))
    has = F.col("s2").isNotNull()
    new = {"s": s, "r": r, "t": t, "num_corr": F.col("n2"), "last_median": F.col("med")}
    total = materialize(j.select(*by, *[F.when(has, v).otherwise(F.col(c)).alias(c) for c, v in new.items()]), "icp-total")
    old = [F.col("__o" + a) for a in PT3]
    step = fit.select(*by, F.col("s2").alias("s"), F.col("r2").alias("r"), F.col("t2").alias("t"))
    moved = apply_sim3_points(cur.withColumns({"__o" + a: F.col(a) for a in PT3}), step, by)
    way = L.norm(L.sub(L.vec(*PT3), old))
    key = [c for c in cur.columns if c not in (*by, *PT3, "bound")]
    moved = moved.join(nn.select(*by, *key, "dist"), [*by, *key], "left")
    return materialize(moved.select(*by, *key, *PT3, (F.col("dist") + way).alias("bound")), "icp-src"), total


def icp(src: DataFrame, dst: DataFrame, by: Sequence[str] = ("scene",), iterations: int = 8, trim: float = 0.7, max_points: int = 0,
        with_scale: bool = True, gate: float | None = None, seed: int = 0, key: str = "point_id") -> DataFrame:
    """Trimmed iterative closest points: (by, s, r, t, num_corr, last_median), the transform of ``src`` onto ``dst``.

    The targets are indexed once. Each round finds nearest neighbours, keeps distances up to the ``trim`` quantile (within
    ``gate`` if given), refits and composes; what a point was away from its neighbour, and its way since, bound the search of the
    next round. A group that has under 3 pairs or no valid fit keeps its last transform.
    """
    by = list(by)
    trim = min(1.0, max(0.05, trim))
    cols = [*by, key, *PT3]
    cur, tgt = src.select(*cols), dst.select(*cols)
    if max_points > 0:
        cur, tgt = sample_cap(cur, by, max_points, [key], seed + 11, "xyz"), sample_cap(tgt, by, max_points, [key], seed + 22, "xyz")
    cur = materialize(cur.withColumn("bound", F.lit(None).cast("double")), "icp-src")
    tgt = materialize(tgt, "icp-dst")
    index = build_index(tgt, by, key=key)
    total = _icp_start(src, by)
    hit = tgt.select(*by, F.col(key).alias("nn_id"), *[F.col(a).alias("d" + a) for a in PT3])
    for _ in range(max(1, iterations)):
        nn = materialize(nn_join(cur, index, by, src_id=key, dst_id=key, bound="bound"), "icp-nn")
        near = nn if gate is None else nn.where(F.col("dist") <= gate)
        th = quantiles(near, by, ["dist"], [trim]).select(*by, F.col("dist_q")[0].alias("th"))
        kept = materialize(near.join(th, by).where("dist <= th"), "icp-kept")
        corr = kept.join(cur.drop("bound"), [*by, key]).join(hit, [*by, "nn_id"]).withColumnsRenamed({a: "s" + a for a in PT3})
        med = quantiles(kept, by, ["dist"], [0.5]).select(*by, F.col("dist_q")[0].alias("med"))
        fit = fit_sim3(corr, by, with_scale).join(med, by)
        fit = materialize(fit.where("valid").select(*by, F.col("n").alias("n2"), "med", F.col("s").alias("s2"), F.col("r").alias("r2"), F.col("t").alias("t2")), "icp-fit")
        if fit.isEmpty():
            break
        cur, total = _icp_round(cur, nn, total, fit, by)
    return total


def icp_rigid(src: DataFrame, dst: DataFrame, by: Sequence[str] = ("scene",), iterations: int = 20, gate: float | None = None,
              trim: float | None = 0.8, min_pairs: int = 50, max_points: int = 0, seed: int = 0, key: str = "point_id") -> DataFrame:
    """Rigid iterative closest points: (by, s, r, t, num_corr, last_median) with s = 1.

    Each round takes the nearest neighbours closer than ``gate``, keeps the ``trim`` share with the smallest distances but
    ``min_pairs`` at least (ties by id), and fits a rotation and a shift to them; fewer than three pairs give a shift only. With a
    gate, a group with fewer than ``min_pairs`` pairs within it stops. ``max_points`` > 0 looks at as many points of each round, of
    lowest seeded hash. The targets are indexed once; the search of a round is bounded by the last one.
    """
    by = list(by)
    cols = [*by, key, *PT3]
    cur = materialize(src.select(*cols).withColumn("bound", F.lit(None).cast("double")), "icp-src")
    tgt = materialize(dst.select(*cols), "icp-dst")
    index = build_index(tgt, by, key=key)
    hit = tgt.select(*by, F.col(key).alias("nn_id"), *[F.col(a).alias("d" + a) for a in PT3])
    total = _icp_start(src, by)
    live = total.select(*by)
    for i in range(max(1, iterations)):
        pts = cur.join(live, by, "left_semi")
        if max_points > 0:
            pts = sample_cap(pts, by, max_points, [key], seed + i, PT3)
        nn = materialize(nn_join(pts, index, by, src_id=key, dst_id=key, bound="bound"), "icp-nn")
        near = nn if gate is None else nn.where(F.col("dist") < gate)
        size = near.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
        live = materialize(size if gate is None else size.where(F.col("m") >= min_pairs), "icp-live")
        if trim is not None and 0 < trim < 1:
            kept = cap_per_group(near.join(live, by), by, ["dist", key], F.greatest(F.floor(F.col("m") * trim), F.lit(min_pairs)))
        else:
            kept = near.join(live, by)
        kept = materialize(kept.drop("m"), "icp-kept")
        corr = kept.join(cur.drop("bound"), [*by, key]).join(hit, [*by, "nn_id"]).withColumnsRenamed({a: "s" + a for a in PT3})
        corr = materialize(corr, "icp-corr")
        med = quantiles(kept, by, ["dist"], [0.5]).select(*by, F.col("dist_q")[0].alias("med"))
        shift = corr.groupBy(*by).agg(F.array(*[F.avg(F.col("d" + a) - F.col("s" + a)) for a in PT3]).alias("shift"))
        fit = fit_sim3(corr, by, False).join(med, by).join(shift, by)
        turned = F.col("valid") & (F.col("n") >= 3)
        fit = materialize(fit.select(
            *by, F.col("n").alias("n2"), "med", F.lit(1.0).alias("s2"), F.when(turned, F.col("r")).otherwise(eye()).alias("r2"),
            F.when(turned, F.col("t")).otherwise(F.col("shift")).alias("t2")), "icp-fit")
        live = live.select(*by)
        if fit.isEmpty():
            break
        cur, total = _icp_round(cur, nn, total, fit, by)
    return total


def seam_error(members: DataFrame, points: DataFrame, edges: DataFrame, transforms: DataFrame, cap: int = 0, seed: int = 0) -> DataFrame:
    """Per edge (scene, chunk_a, chunk_b): shared views, points, and symmetric median nearest distance and height gap.

    Both sides take their finite points of the shared views in aligned coordinates. ``cap`` > 0 bounds a side: each view
    keeps up to ceil(cap / shared views) points, then the side up to ``cap``, of lowest seeded hash.
    """
    e = edges.select("scene", "chunk_a", "chunk_b").distinct()
    m = members.select(*CHUNK, "frame").distinct()
    shared = e.join(m.withColumnRenamed("chunk_id", "chunk_a"), ["scene", "chunk_a"]).join(
        m.withColumnRenamed("chunk_id", "chunk_b"), ["scene", "chunk_b", "frame"])
    shared = materialize(shared, "shared")
    ok = points.where("valid").select(*CHUNK, "frame", "y", "x", *PT).where(L.finite("px") & L.finite("py") & L.finite("pz"))
    by = ["scene", "chunk_a", "chunk_b"]
    views = materialize(shared.groupBy(*by).agg(F.count(F.lit(1)).alias("num_shared_views")), "seam-views")

    def side(name: str) -> DataFrame:
        p = ok.join(shared.withColumn("chunk_id", F.col(name)), [*CHUNK, "frame"])
        p = apply_sim3_points(p, transforms, CHUNK, PT).withColumnsRenamed(dict(zip(("y", "x"), ("row", "col"))))
        p = p.withColumnsRenamed(dict(zip(PT, "xyz"))).withColumn("pid", F.struct("frame", "row", "col"))
        if cap > 0:
            order = [L.uniform(seed, *by, "chunk_id", "frame", "row", "col"), "pid"]
            p = cap_per_group(p.join(views, by), [*by, "frame"], order, F.ceil(F.lit(cap) / F.col("num_shared_views")))
            p = cap_per_group(p, by, order, cap)
        return materialize(p.select(*by, "pid", "x", "y", "z"), "seam-side")

    a, b = side("chunk_a"), side("chunk_b")
    index = {"a": build_index(a, by, key="pid"), "b": build_index(b, by, key="pid")}

    def directed(s: DataFrame, d: DataFrame, tag: str, other: str) -> DataFrame:
        nn = nn_join(s, index[other], by, src_id="pid", dst_id="pid", sources=index[tag])
        nn = nn.join(s.select(*by, "pid", F.col("z").alias("zs")), [*by, "pid"]).join(
            d.select(*by, F.col("pid").alias("nn_id"), F.col("z").alias("zd")), [*by, "nn_id"])
        q = quantiles(nn.select(*by, "dist", F.abs(F.col("zs") - F.col("zd")).alias("dz")), by, ["dist", "dz"], [0.5], derived=True)
        return q.select(*by, F.col("n").alias("num_" + tag), F.col("dist_q")[0].alias("nn_" + tag), F.col("dz_q")[0].alias("z_" + tag))

    out = e.join(views, by, "left").join(directed(a, b, "a", "b"), by, "left").join(directed(b, a, "b", "a"), by, "left")
    return out.select(
        *by, F.coalesce("num_shared_views", F.lit(0).cast("long")).alias("num_shared_views"), "num_a", "num_b", "nn_a", "nn_b",
        ((F.col("nn_a") + F.col("nn_b")) / 2).alias("seam_error"), ((F.col("z_a") + F.col("z_b")) / 2).alias("seam_error_z"))


def seam_summary(per_edge: DataFrame) -> DataFrame:
    """Unweighted means over the valid edges of a scene."""
    return per_edge.groupBy("scene").agg(
        F.count(F.lit(1)).alias("num_edges"), F.count("seam_error").alias("num_valid_edges"),
        F.avg("seam_error").alias("seam_error"), F.avg("seam_error_z").alias("seam_error_z"))
