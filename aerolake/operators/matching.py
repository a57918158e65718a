"""Camera matching and similarity application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import first_per_group


def finite_pose(t: str | Column) -> Column:
    """True for a 16-element pose without missing or non-finite entries."""
    t = L.col(t)
    return F.coalesce((F.size(t) == 16) & F.forall(t, L.finite), F.lit(False))


def dedupe_cameras(cams: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """First camera of every (scene, stem)."""
    return first_per_group(cams, ["scene", "stem"], list(order))


def match_cameras(pred: DataFrame, gt: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Pairs of finite poses by (scene, stem); repeated predictions keep the first.

    Columns: scene, stem, the order columns, pred_c2w, gt_c2w.
    """
    p = dedupe_cameras(pred.where(finite_pose("t_c2w")).select("scene", "stem", *order, "t_c2w"), order)
    g = gt.where(finite_pose("t_c2w")).select("scene", "stem", F.col("t_c2w").alias("gt_c2w"))
    return p.withColumnRenamed("t_c2w", "pred_c2w").join(g, ["scene", "stem"])


def centre_correspondences(matched: DataFrame, *keep: str) -> DataFrame:
    """Camera centres of matched poses as correspondences, prediction to reference."""
    s, d = L.trans_of("pred_c2w"), L.trans_of("gt_c2w")
    return matched.select(
        *keep, *[c.alias("s" + a) for a, c in zip("xyz", s)], *[c.alias("d" + a) for a, c in zip("xyz", d)]
    )


def _prefixed(tf: DataFrame, by: Sequence[str]) -> DataFrame:
    """Transform columns under names that cannot clash with point columns such as the colour r."""
    return tf.select(*by, *[F.col(c).alias("__" + c) for c in ("s", "r", "t")])


def apply_sim3_points(
    df: DataFrame, tf: DataFrame, by: Sequence[str], cols: Sequence[str] = ("x", "y", "z")
) -> DataFrame:
    """x -> s R x + t with the transform of the row's group; groups without one keep their coordinates."""
    j = df.join(_prefixed(tf, by), list(by), "left")
    moved = L.matvec(L.mat3("__r"), L.vec(*cols))
    new = {c: F.coalesce(F.col("__s") * m + F.col("__t")[i], F.col(c)) for i, (c, m) in enumerate(zip(cols, moved))}
    return j.withColumns(new).select(*df.columns)


def apply_sim3_poses(df: DataFrame, tf: DataFrame, by: Sequence[str], col: str = "t_c2w") -> DataFrame:
    """Rotate the orientation and move the centre of every pose by its group's transform."""
    j = df.join(_prefixed(tf, by), list(by), "left")
    r = L.mat3("__r")
    centre = [F.col("__s") * m + F.col("__t")[i] for i, m in enumerate(L.matvec(r, L.trans_of(col)))]
    moved = L.pose(L.matmul(r, L.rot_of(col)), centre)
    return j.withColumn(col, F.when(F.col("__s").isNull(), F.col(col)).otherwise(moved)).select(*df.columns)


def compose_columns(first: Sequence[Column], second: Sequence[Column]) -> tuple[Column, Column, Column]:
    """(s, r, t) of second after first; each side is (s, r array, t array)."""
    s1, r1, t1 = first
    s2, r2, t2 = second
    moved = L.matvec(L.mat3(r2), [t1[i] for i in range(3)])
    t = F.array(*[s2 * m + t2[i] for i, m in enumerate(moved)])
    return s2 * s1, L.pack(L.matmul(L.mat3(r2), L.mat3(r1))), t


def compose_sim3(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """Transforms of ``first`` followed by those of ``second``; a missing second is the identity."""
    b = second.select(*by, F.col("s").alias("s2"), F.col("r").alias("r2"), F.col("t").alias("t2"))
    j = first.join(b, list(by), "left")
    s, r, t = compose_columns((F.col("s"), F.col("r"), F.col("t")), (F.col("s2"), F.col("r2"), F.col("t2")))
    has = F.col("s2").isNotNull()
    return j.withColumns({
        "s": F.when(has, s).otherwise(F.col("s")), "r": F.when(has, r).otherwise(F.col("r")),
        "t": F.when(has, t).otherwise(F.col("t")),
    }).select(*first.columns)
