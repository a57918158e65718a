"""Descriptor matching between neighbouring views with ratio and reprojection tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import grouped_rank
from aerolake.operators.projection import project, projection_columns
from aerolake.session import materialize

_OUT = "scene long, view_i int, view_j int, id_i long, id_j long, dist double"


def _two_nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two nearest rows of the right block for every row of the left block."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            a, b = np.stack(list(row.vecs_i)).astype(float), np.stack(list(row.vecs_j)).astype(float)
            ids_j = np.asarray(row.ids_j)
            order = np.argsort(ids_j, kind="stable")
            b, ids_j = b[order], ids_j[order]
            d = np.empty((len(a), len(b)))
            for s in range(0, len(a), 64):
                d[s:s + 64] = np.sqrt(((a[s:s + 64, None] - b[None]) ** 2).sum(-1))
            k = min(2, len(b))
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({
                "scene": row.scene, "view_i": row.view_i, "view_j": row.view_j, "id_i": np.repeat(np.asarray(row.ids_i), k),
                "id_j": ids_j[near].ravel(), "dist": np.take_along_axis(d, near, 1).ravel()}))
        if out:
            yield pd.concat(out)


def match_descriptors(desc: DataFrame, window: int = 2, ratio: float = 0.8, block: int = 256) -> DataFrame:
    """(scene, view_i, view_j, id_i, id_j, d1, d2): best match of each descriptor in the next ``window`` views, where it is
    nearer than ``ratio`` times the second best. ``desc(scene, view, id, vec)``.

    Descriptors travel in blocks; a task compares two blocks and returns two rows per descriptor, so no row per
    descriptor pair exists.
    """
    r = grouped_rank(desc.select(F.col("scene").cast("long").alias("scene"), F.col("view").cast("int").alias("view"), F.col("id").cast("long").alias("id"), "vec"),
                     ["scene", "view"], ["id"], "rk")
    b = r.withColumn("blk", F.floor(F.col("rk") / block)).groupBy("scene", "view", "blk").agg(
        F.collect_list(F.struct("id", "vec")).alias("l")).select("scene", "view", "blk", F.col("l.id").alias("ids"), F.col("l.vec").alias("vecs"))
    b = materialize(b, "blocks")
    left = b.select("scene", F.col("view").alias("view_i"), F.col("ids").alias("ids_i"), F.col("vecs").alias("vecs_i"),
                    F.explode(F.sequence(F.col("view") + 1, F.col("view") + window)).alias("view_j"))
    right = b.select("scene", F.col("view").alias("view_j"), F.col("ids").alias("ids_j"), F.col("vecs").alias("vecs_j"))
    near = left.join(right, ["scene", "view_j"]).mapInPandas(_two_nearest, _OUT)
    key = ["scene", "view_i", "view_j", "id_i"]
    # two rows per block of the other view
    near = near.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("dist", "id_j"))).where("k <= 2")
    best = near.groupBy(*key).agg(
        F.max(F.when(F.col("k") == 1, F.col("id_j"))).alias("id_j"), F.max(F.when(F.col("k") == 1, F.col("dist"))).alias("d1"),
        F.max(F.when(F.col("k") == 2, F.col("dist"))).alias("d2"))
    return best.where(F.col("d1") < F.lit(ratio) * F.col("d2"))


def reprojection_filter(matches: DataFrame, keypoints: DataFrame, cams: DataFrame, max_err: float = 8.0) -> DataFrame:
    """Keep matches whose left world point projects within ``max_err`` pixels of both keypoints, in front of both cameras.

    ``keypoints(scene, view, id, u, v, px, py, pz)``, ``cams(scene, view, k, t_c2w)``. Adds err_i and err_j.
    """
    k = keypoints.select("scene", F.col("view").alias("view_i"), F.col("id").alias("id_i"), F.col("u").alias("ui"), F.col("v").alias("vi"), "px", "py", "pz")
    o = keypoints.select("scene", F.col("view").alias("view_j"), F.col("id").alias("id_j"), F.col("u").alias("uj"), F.col("v").alias("vj"))
    j = matches.join(k, ["scene", "view_i", "id_i"]).join(o, ["scene", "view_j", "id_j"])
    for s in ("i", "j"):
        rows = [c.alias(n) for n, c in projection_columns("t_c2w", "k", "P" + s).items()]
        j = j.join(cams.select("scene", F.col("view").alias("view_" + s), *rows), ["scene", "view_" + s])
    p = L.vec("px", "py", "pz")
    for s in ("i", "j"):
        u, v, z = project(p, "P" + s)
        j = j.withColumns({"err_" + s: L.norm([u - F.col("u" + s), v - F.col("v" + s)]), "z" + s: z})
    ok = L.finite("px") & L.finite("py") & L.finite("pz") & (F.col("zi") > 0) & (F.col("zj") > 0)
    return j.where(ok & (F.col("err_i") <= max_err) & (F.col("err_j") <= max_err)).select(*matches.columns, "err_i", "err_j")
