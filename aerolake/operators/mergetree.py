"""Alignment of chunks along a merge tree, without a round per chunk.

A chunk joins the group of its parent together with all chunks below it; children of one chunk join in a given order. Which
chunks stand for a shared frame on both sides of every such edge depends on the tree and the members only, so all edges get
their pixel pairs in one join. An edge whose sides are its own chunk and its parent can be fitted at once; others wait until
the edges between have been fitted. Transforms up to the highest fitted ancestor come from pointer doubling, and so do
ancestors: the number of joins grows with the logarithm of the depth, and rounds with the longest run of edges that truly
wait for each other (one for chunks that overlap their neighbours in a chain).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import cap_per_group
from aerolake.operators.alignment import balance_correspondences, eye, fit_overlap, zeros
from aerolake.operators.matching import compose_columns
from aerolake.session import materialize

EDGE = ["scene", "kid"]
PT = ("px", "py", "pz")
_SRT = ("s", "r", "t")


def grid_shapes(points: DataFrame) -> DataFrame:
    return points.groupBy("scene", "chunk_id", "frame").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def ancestors(tree: DataFrame) -> list[DataFrame]:
    """Tables (scene, node, up): the ancestor 1, 2, 4, ... steps up, for nodes that have it."""
    step = materialize(tree.where("parent_id IS NOT NULL").select("scene", F.col("chunk_id").alias("node"), F.col("parent_id").alias("up")), "lift")
    lifts = []
    while not step.isEmpty():
        lifts.append(step)
        step = materialize(_climb(step, step, "up"), "lift")
    return lifts


def _climb(rows: DataFrame, lift: DataFrame, col: str, how: str = "inner") -> DataFrame:
    """Rows with ``col`` replaced by its ancestor in ``lift``; NULL if there is none and ``how`` is left."""
    above = lift.select(F.col("scene").alias("__s"), F.col("node").alias("__n"), F.col("up").alias("__u"))
    j = rows.join(above, (F.col("scene") == F.col("__s")) & (F.col(col) == F.col("__n")), how)
    return j.withColumn(col, F.col("__u")).select(*rows.columns)


def _depths(tree: DataFrame, lifts: list[DataFrame]) -> DataFrame:
    """(scene, node, depth)."""
    at = tree.select("scene", F.col("chunk_id").alias("node"), F.col("chunk_id").alias("at"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(lifts))):
        up = _climb(at.withColumn("to", F.col("at")), lifts[k], "to", "left")
        at = up.select("scene", "node", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.when(F.col("to").isNull(), 0).otherwise(2**k)).alias("depth"))
    return materialize(at.select("scene", "node", "depth"), "depths")


def meeting_edges(pairs: DataFrame, tree: DataFrame, lifts: list[DataFrame]) -> DataFrame:
    """For chunks (scene, a, b): the edge at which they come together, as (scene, c, d, kid, anchor): ``c`` is below ``kid`` or is it,
    ``d`` in the group of its parent ``anchor``. Pairs of different trees have none."""
    depth = _depths(tree, lifts)
    of = lambda c: depth.select("scene", F.col("node").alias(c), F.col("depth").alias("depth_" + c))
    p = pairs.join(of("a"), ["scene", "a"]).join(of("b"), ["scene", "b"])
    deep = F.col("depth_a") >= F.col("depth_b")
    p = p.select("scene", F.when(deep, F.col("a")).otherwise(F.col("b")).alias("c"), F.when(deep, F.col("b")).otherwise(F.col("a")).alias("d"),
                 F.abs(F.col("depth_a") - F.col("depth_b")).alias("gap")).withColumn("u", F.col("c"))
    for k, lift in enumerate(lifts):  # climb to one below the depth of d
        up = _climb(p.withColumn("to", F.col("u")), lift, "to", "left")
        p = up.withColumn("u", F.when((F.col("gap") > 0) & (F.shiftright(F.col("gap") - 1, k) % 2 == 1), F.col("to")).otherwise(F.col("u"))).drop("to")
    p = materialize(_climb(p.withColumn("p", F.col("u")), lifts[0], "p", "left"), "meet")
    below = (F.col("gap") > 0) & (F.col("p") == F.col("d"))
    found = p.where(below).select("scene", "c", "d", F.col("u").alias("kid"), F.col("d").alias("anchor"))
    p = p.where(~F.coalesce(below, F.lit(False))).withColumn("u", F.when(F.col("gap") > 0, F.col("p")).otherwise(F.col("u"))).select("scene", "c", "d", "u").withColumn("v", F.col("d"))
    if p.isEmpty():
        return found
    for lift in reversed(lifts):  # climb both sides to below the common ancestor
        up = _climb(_climb(p.withColumns({"x": F.col("u"), "y": F.col("v")}), lift, "x", "left"), lift, "y", "left")
        go = F.coalesce(F.col("x") != F.col("y"), F.lit(False))
        p = up.select("scene", "c", "d", F.when(go, F.col("x")).otherwise(F.col("u")).alias("u"), F.when(go, F.col("y")).otherwise(F.col("v")).alias("v"))
    info = lambda n: tree.select("scene", F.col("chunk_id").alias(n), F.col("parent_id").alias("p" + n), F.col("ord").alias("o" + n))
    p = p.join(info("u"), ["scene", "u"]).join(info("v"), ["scene", "v"]).where("pu = pv")
    late = F.col("ou") > F.col("ov")
    side = lambda x, y: F.when(late, F.col(x)).otherwise(F.col(y))
    return found.unionByName(p.select("scene", side("c", "d").alias("c"), side("d", "c").alias("d"), side("u", "v").alias("kid"), F.col("pu").alias("anchor")))


def edge_picks(tree: DataFrame, members: DataFrame, lifts: list[DataFrame]) -> DataFrame:
    """(scene, kid, anchor, frame, cs, cd): whose prediction stands for a shared frame on both sides of every edge: core first,
    then the lowest chunk."""
    m = members.groupBy("scene", "chunk_id", "frame").agg((~F.bool_or(F.col("role") == "core")).alias("o"))
    m = materialize(m, "tree-members")
    side = lambda n: m.select("scene", "frame", F.col("chunk_id").alias(n), F.col("o").alias("o" + n))
    pairs = side("a").join(side("b"), ["scene", "frame"]).where("a < b").select("scene", "a", "b").distinct()
    met = materialize(meeting_edges(materialize(pairs, "sharing"), tree, lifts), "met")
    both = met.join(side("c"), ["scene", "c"]).join(side("d"), ["scene", "d", "frame"])
    best = lambda n: F.min(F.struct(F.col("o" + n).alias("o"), F.col(n).alias("c"))).alias("b" + n)
    picked = both.groupBy(*EDGE, "anchor", "frame").agg(best("c"), best("d"))
    return picked.select(*EDGE, "anchor", "frame", F.col("bc.c").alias("cs"), F.col("bd.c").alias("cd"))


def _tops(tree: DataFrame, done: DataFrame | None, doublings: int) -> DataFrame:
    """(scene, node, top, s, r, t): the highest ancestor that fitted edges lead to, and the transform into its frame."""
    node = tree.select("scene", F.col("chunk_id").alias("node"), F.col("parent_id").alias("up"))
    one = {"s": F.lit(1.0), "r": eye(), "t": zeros()}
    if done is None:
        return node.select("scene", "node", F.col("node").alias("top"), *[v.alias(k) for k, v in one.items()])
    j = node.join(done.select("scene", F.col("kid").alias("node"), *_SRT), ["scene", "node"], "left")
    has = F.col("s").isNotNull()
    state = materialize(j.select("scene", "node", F.when(has, F.col("up")).otherwise(F.col("node")).alias("top"),
                                 *[F.when(has, F.col(k)).otherwise(v).alias(k) for k, v in one.items()]), "tops")
    for _ in range(doublings):
        above = state.select("scene", F.col("node").alias("top"), F.col("top").alias("top2"), *[F.col(k).alias(k + "2") for k in _SRT])
        made = compose_columns([F.col(k) for k in _SRT], [F.col(k + "2") for k in _SRT])
        state = materialize(state.join(above, ["scene", "top"]).select("scene", "node", F.col("top2").alias("top"), *[v.alias(k) for k, v in zip(_SRT, made)]), "tops")
    return state


def _inverse(s: Column, r: Column, t: Column) -> tuple[Column, Column, Column]:
    back = L.transpose(L.mat3(r))
    moved = L.matvec(back, [t[i] for i in range(3)])
    return F.lit(1.0) / s, L.pack(back), F.array(*[-m / s for m in moved])


def _moves(open_picks: DataFrame, tops: DataFrame) -> DataFrame:
    """Picks with ``ok``, whether both sides are known in the frames of the edge's two roots, and the transforms into these
    (NULL for the roots themselves)."""
    of = lambda n: tops.select("scene", F.col("node").alias(n), F.struct("top", *_SRT).alias("f_" + n))
    j = open_picks
    for n in ("cs", "cd", "anchor"):
        j = j.join(of(n), ["scene", n])
    get = lambda n: [F.col(f"f_{n}.{k}") for k in _SRT]
    src_root, dst_root = F.col("cs") == F.col("kid"), F.col("cd") == F.col("anchor")
    ok = (src_root | (F.col("f_cs.top") == F.col("kid"))) & (dst_root | (F.col("f_cd.top") == F.col("f_anchor.top")))
    src, dst = get("cs"), compose_columns(get("cd"), _inverse(*get("anchor")))
    pack = lambda root, tf: F.when(~root, F.struct(*[v.alias(k) for k, v in zip(_SRT, tf)]))
    return j.select(*EDGE, "frame", ok.alias("ok"), pack(src_root, src).alias("ms"), pack(dst_root, dst).alias("md"))


def _applied(corr: DataFrame) -> DataFrame:
    new = {}
    for side, m in (("s", "ms"), ("d", "md")):
        cols = [side + a for a in "xyz"]
        moved = L.matvec(L.mat3(F.col(m + ".r")), L.vec(*cols))
        new |= {c: F.coalesce(F.col(m + ".s") * v + F.col(m + ".t")[i], F.col(c)) for i, (c, v) in enumerate(zip(cols, moved))}
    return corr.withColumns(new).drop("ms", "md")


def pixel_pairs(points: DataFrame, picks: DataFrame) -> DataFrame:
    """``picks`` by pixel, valid on both sides, in the coordinates of the two chunks; frames whose grids differ in shape are
    left out. Points are read for the shapes and once for the pixels, whatever the number of edges."""
    shapes = materialize(grid_shapes(points), "shapes")
    shape = lambda n: shapes.select("scene", F.col("chunk_id").alias(n), "frame", F.struct("h", "w").alias("shape_" + n))
    picks = picks.join(shape("cs"), ["scene", "cs", "frame"]).join(shape("cd"), ["scene", "cd", "frame"]).where("shape_cs = shape_cd")
    picks = materialize(picks.drop("shape_cs", "shape_cd"), "picks")
    used = picks.select("scene", F.col("cs").alias("chunk_id"), "frame").union(picks.select("scene", "cd", "frame")).distinct()
    ok = points.where("valid").select("scene", "chunk_id", "frame", "y", "x", *PT).where(L.finite("px") & L.finite("py") & L.finite("pz"))
    pixels = materialize(ok.join(used, ["scene", "chunk_id", "frame"], "left_semi"), "shared-pixels")
    side = lambda n, to: pixels.withColumnsRenamed({"chunk_id": n, **{c: to + c[1] for c in PT}})
    return picks.join(side("cs", "s"), ["scene", "cs", "frame"]).join(side("cd", "d"), ["scene", "cd", "frame", "y", "x"])


def merge_tree(tree: DataFrame, members: DataFrame, points: DataFrame, mode: str, min_corr: int, cap_view: int = 0, cap_total: int = 0,
               balance: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Fit every chunk of ``tree(scene, chunk_id, parent_id, ord, gid, level, child_rank)`` with what hangs on it to its parent's group.

    Roots have no parent; siblings join by ascending ``ord``. Returns (transforms into the roots' frames, edges). Caps keep the
    pixels of lowest hash, seeded with seed + level. An edge without a fit is an identity.
    """
    tree = materialize(tree, "merge-tree")
    lifts = ancestors(tree)
    info = tree.where("parent_id IS NOT NULL").select("scene", F.col("chunk_id").alias("kid"), "gid", "level", "child_rank")
    if not lifts:
        final = _tops(tree, None, 0)
        return final.select("scene", F.col("node").alias("chunk_id"), *_SRT), _edges(info, None)
    picks = edge_picks(tree, members, lifts).join(info.select(*EDGE, "gid", "level"), EDGE)
    corr = pixel_pairs(points, picks)
    salt = lambda k: F.lit(seed + k) + F.col("level")
    if cap_view > 0:
        # a view has the pixels of one image
        w = Window.partitionBy(*EDGE, "frame").orderBy(L.uniform(salt(0), "scene", "gid", "frame", "y", "x"), "y", "x")
        corr = corr.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= cap_view).drop("__k")
    if cap_total > 0 and not balance:
        corr = cap_per_group(corr, EDGE, [L.uniform(salt(1), "scene", "gid", "frame", "y", "x"), "frame", "y", "x"], cap_total)
    corr = materialize(corr, "tree-corr")
    waiting = materialize(corr.select(*EDGE, "anchor", "frame", "cs", "cd").distinct(), "waiting")
    done = info.join(waiting.select(*EDGE).distinct(), EDGE, "left_anti").select(
        *EDGE, F.lit(0).cast("long").alias("n"), F.lit(False).alias("valid"), F.lit(1.0).alias("s"), eye().alias("r"), zeros().alias("t"))
    done = materialize(done, "fitted")
    first = True
    while not waiting.isEmpty():
        moves = materialize(_moves(waiting, _tops(tree, None if first else done, len(lifts))), "moves")
        ready = moves.groupBy(*EDGE).agg(F.bool_and("ok").alias("ok")).where("ok").select(*EDGE)
        ready = materialize(ready, "ready")
        now = corr.join(moves.join(ready, EDGE, "left_semi").drop("ok"), [*EDGE, "frame"])
        now = _applied(now).select(*EDGE, "level", "frame", "y", "x", *[s + a for s in "sd" for a in "xyz"])
        if balance:
            now = balance_correspondences(materialize(now, "corr"), EDGE, ["frame", "y", "x"], total=cap_total, seed=salt(0)).drop("cell")
        fit = fit_overlap(materialize(now, "corr"), EDGE, mode, min_corr)
        fit = ready.join(fit, EDGE, "left").select(
            *EDGE, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("valid", F.lit(False)).alias("valid"),
            F.coalesce("s", F.lit(1.0)).alias("s"), F.coalesce("r", eye()).alias("r"), F.coalesce("t", zeros()).alias("t"))
        done = materialize(done.unionByName(fit), "fitted")
        waiting = materialize(waiting.join(ready, EDGE, "left_anti"), "waiting")
        first = False
    final = _tops(tree, done, len(lifts))
    return final.select("scene", F.col("node").alias("chunk_id"), *_SRT), _edges(info, done)


def _edges(info: DataFrame, done: DataFrame | None) -> DataFrame:
    if done is None:
        done = info.select(*EDGE, F.lit(0).cast("long").alias("n"), F.lit(False).alias("valid"), F.lit(1.0).alias("s"), eye().alias("r"), zeros().alias("t"))
    return info.join(done, EDGE).select("scene", "gid", "n", "valid", *_SRT, "level", "child_rank")


def key_tree(chunks: DataFrame) -> DataFrame:
    """Merge tree of ``chunks(scene, chunk_id, key ARRAY<INT>)``, each with a key of its own: nodes with one parent key join the
    largest of them, then the lowest key, in that order; a node is led by the chunk that leads its first child."""
    nodes = materialize(chunks.select("scene", "key", F.col("chunk_id").alias("lead"), F.lit(1).cast("long").alias("n")), "nodes")
    parts: list[DataFrame] = []
    for level in range((nodes.agg(F.max(F.size("key"))).first()[0] or 0) + 4):
        if (nodes.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= 1:
            break
        up = F.slice("key", 1, F.greatest(F.size("key") - 1, F.lit(0)))
        # the children of one node of the tree
        w = Window.partitionBy("scene", "up")
        kids = nodes.withColumn("up", up).withColumns({
            "rank": F.row_number().over(w.orderBy(-F.col("n"), "key")) - 1, "total": F.sum("n").over(w),
            "first": F.first("lead").over(w.orderBy(-F.col("n"), "key"))})
        kids = materialize(kids, "children")
        gid = F.concat_ws("/", F.lit("g"), F.transform("up", lambda v: v.cast("string")))
        parts.append(kids.where("rank > 0").select("scene", F.col("lead").alias("chunk_id"), F.col("first").alias("parent_id"),
                                                   gid.alias("gid"), F.lit(level).alias("level"), F.col("rank").alias("child_rank")))
        nodes = materialize(kids.where("rank = 0").select("scene", F.col("up").alias("key"), "lead", F.col("total").alias("n")), "nodes")
    roots = nodes.select("scene", F.col("lead").alias("chunk_id"), F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("parent_id"),
                         F.lit("g").alias("gid"), F.lit(-1).alias("level"), F.lit(0).alias("child_rank"))
    for part in parts:
        roots = roots.unionByName(part)
    return roots.withColumn("ord", F.struct("level", "child_rank"))


def parent_tree(chunks: DataFrame) -> DataFrame:
    """Merge tree of ``chunks(scene, chunk_id, parent_id, level)``: deeper children first, then by id."""
    hangs = F.col("parent_id").isNotNull() & (F.col("level") > 0)
    kids = chunks.withColumn("parent_id", F.when(hangs, F.col("parent_id")))
    # the children of one chunk
    w = Window.partitionBy("scene", "parent_id", "level").orderBy("chunk_id")
    ranked = kids.where("parent_id IS NOT NULL").withColumn("child_rank", F.row_number().over(w))
    kids = ranked.unionByName(kids.where("parent_id IS NULL").withColumn("child_rank", F.lit(0)))
    return kids.select("scene", "chunk_id", "parent_id", F.col("chunk_id").alias("gid"), "level", "child_rank",
                       F.struct((-F.col("level")).alias("l"), F.col("chunk_id").alias("c")).alias("ord"))
