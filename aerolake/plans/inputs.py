"""Operator inputs derived from the fixture views, shared by the registered queries and the tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.functions import linalg as L
from aerolake.plans.fixtures import view

YAW0 = math.atan2(0.8, 0.6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, as the check statements do."""
    return df.select(*[
        F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns
    ])


def flat_tf(df: DataFrame, *keep: str) -> DataFrame:
    """Transform columns spread out: s, r00..r22, t0..t2."""
    return df.select(
        *keep, "s", *[F.col("r")[3 * i + j].alias(f"r{i}{j}") for i in range(3) for j in range(3)],
        *[F.col("t")[i].alias(f"t{i}") for i in range(3)])


def _pose(df: DataFrame, angle) -> DataFrame:
    c, s, z = F.cos(angle), F.sin(angle), F.lit(0.0)
    t = L.pose([[c, s, z], [s, -c, z], [z, z, F.lit(-1.0)]], L.vec("cx", "cy", "cz"))
    return df.select("scene", "frame", F.concat(F.lit("f"), F.lpad(F.col("frame").cast("string"), 5, "0")).alias("stem"),
                     t.alias("t_c2w"))


def gt_cams(spark: SparkSession, d: str) -> DataFrame:
    return _pose(view(spark, d, "fx_cams"), F.lit(0.1) * (F.col("frame") % 5))


def pred_cams(spark: SparkSession, d: str) -> DataFrame:
    angle = F.lit(YAW0) + F.lit(0.1) * (F.col("frame") % 5) + F.lit(0.002) * (F.col("frame") % 3)
    return _pose(view(spark, d, "fx_pred"), angle).withColumn("ord", F.col("frame"))


def corr(spark: SparkSession, d: str) -> DataFrame:
    """Camera-centre correspondences, prediction to reference."""
    p = view(spark, d, "fx_pred").select("scene", "frame", *[F.col("c" + a).alias("s" + a) for a in "xyz"])
    g = view(spark, d, "fx_cams").select("scene", "frame", *[F.col("c" + a).alias("d" + a) for a in "xyz"])
    return p.join(g, ["scene", "frame"])


def pixel_cams(spark: SparkSession, d: str) -> DataFrame:
    """Camera of every pixel frame: k and t_c2w arrays, nadir."""
    one, z = F.lit(1.0), F.lit(0.0)
    t = L.pose([[one, z, z], [z, -one, z], [z, z, -one]], L.vec("cx", "cy", "cz"))
    k = F.array(*[F.lit(v) for v in (50.0, 0.0, 8.0, 0.0, 50.0, 8.0, 0.0, 0.0, 1.0)])
    return view(spark, d, "fx_pixcams").select("frame", k.alias("k"), t.alias("t_c2w"))


def scene_cams(spark: SparkSession, d: str) -> DataFrame:
    """Nadir cameras of the trajectory view: k and t_c2w arrays."""
    one, z = F.lit(1.0), F.lit(0.0)
    t = L.pose([[one, z, z], [z, -one, z], [z, z, -one]], L.vec("cx", "cy", "cz"))
    k = F.array(*[F.lit(v) for v in (50.0, 0.0, 8.0, 0.0, 50.0, 8.0, 0.0, 0.0, 1.0)])
    return view(spark, d, "fx_cams").select("scene", "frame", k.alias("k"), t.alias("t_c2w"))
