"""As-of pose lookup with interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import surrounding

# fixed values, in seconds
SNAP = 1e-4
MAX_GAP = 2.0


def with_slerp(df: DataFrame, first: Column, second: Column, alpha: Column, out: str) -> DataFrame:
    """Add ``out``: the rotation at ``alpha`` between two 4x4 poses along the shortest arc, as a 9-element array.

    The relative rotation's axis comes from its antisymmetric part, or from its diagonal near 180 degrees. Each step is
    a column of its own, so nothing is evaluated twice.
    """
    a, b = L.rot_of(first), L.rot_of(second)
    m = F.col("__m")
    df = df.withColumn("__m", L.pack(L.matmul(L.transpose(a), b)))
    df = df.withColumn("__w", F.array(m[7] - m[5], m[2] - m[6], m[3] - m[1]))
    w = [F.col("__w")[i] for i in range(3)]
    df = df.withColumn("__s2", L.norm(w))
    cos = L.clamp((m[0] + m[4] + m[8] - 1.0) / 2.0, -1.0, 1.0)
    # near 180 degrees: the column of M + I with the largest diagonal is the axis up to length
    big = F.greatest(m[0], m[4], m[8])
    column = lambda j: F.array(*[m[3 * i + j] + (1.0 if i == j else 0.0) for i in range(3)])
    df = df.withColumns({"__t": F.atan2(F.col("__s2") / 2.0, cos),
                         "__h": F.when(m[0] == big, column(0)).when(m[4] == big, column(1)).otherwise(column(2))})
    h = [F.col("__h")[i] for i in range(3)]
    flip = (F.col("__s2") < 1e-9) & (F.col("__t") > 1.0)
    df = df.withColumn("__hn", L.norm(h))
    df = df.withColumns({f"__{n}": F.when(flip, x / F.col("__hn")).when(F.col("__s2") > 0, v / F.col("__s2")).otherwise(0.0)
                         for n, v, x in zip("xyz", w, h)})
    df = df.withColumns({"__c": F.cos(F.col("__t") * alpha), "__n": F.sin(F.col("__t") * alpha)})
    x, y, z, c, n = (F.col(f"__{v}") for v in "xyzcn")
    o = 1.0 - c
    step = [c + x * x * o, x * y * o - z * n, x * z * o + y * n,
            y * x * o + z * n, c + y * y * o, y * z * o - x * n,
            z * x * o - y * n, z * y * o + x * n, c + z * z * o]
    df = df.withColumn("__st", F.array(*step))
    df = df.withColumn(out, F.when(F.col("__t") < 1e-12, L.pack(a)).otherwise(L.pack(L.matmul(a, L.mat3("__st")))))
    return df.drop("__m", "__w", "__s2", "__t", "__h", "__hn", "__x", "__y", "__z", "__c", "__n", "__st")


def asof_frames(queries: DataFrame, frames: DataFrame, by: Sequence[str] = ("scene",), time: str = "t",
                payload: Sequence[str] = ("frame",), snap: float = SNAP, max_gap: float = MAX_GAP) -> DataFrame:
    """Frame pair and fraction for every query time: the last frame at or before it and the next one.

    Adds status ('exact', 'last', 'interpolated', 'before_first', 'gap'), ``alpha``, and prev_/next_ payload structs.
    Queries within ``snap`` of a frame, or after the last one, use that frame. A gap above ``max_gap`` is rejected.
    """
    by = list(by)
    f = frames.select(*by, F.col(time).alias("__t"), F.struct(F.col(time).alias("t"), *payload).alias("__f"))
    q = queries.withColumnRenamed(time, "__t")
    extra = [c for c in q.columns if c not in (*by, "__t")]
    u = f.withColumns({"__q": F.lit(0), "__row": F.lit(None).cast(q.select(F.struct(*extra)).schema[0].dataType)})
    u = u.unionByName(q.select(*by, "__t", F.lit(None).cast(f.schema["__f"].dataType).alias("__f"), F.lit(1).alias("__q"),
                               F.struct(*extra).alias("__row")))
    # frames sort before queries of the same time
    near = surrounding(u, by, ["__t", "__q", "__row", "__f"], "__f", "prev", "next").where("__q = 1")
    t, p, n = F.col("__t"), F.col("prev"), F.col("next")
    to_prev, to_next = t - p["t"], n["t"] - t
    gap = n["t"] - p["t"]
    status = (
        F.when(p.isNull(), "before_first").when(to_prev == 0, "exact").when(n.isNull(), "last")
        .when(to_prev < snap, "exact").when(to_next < snap, "exact_next").when(gap > max_gap, "gap").otherwise("interpolated"))
    out = near.withColumn("status", status)
    return out.select(
        *by, F.col("__t").alias(time), *[F.col("__row")[c].alias(c) for c in extra],
        F.when(F.col("status") == "exact_next", "exact").otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") == "interpolated", to_prev / gap).when(F.col("status").isin("exact", "last", "exact_next"), 0.0).alias("alpha"),
        F.when(F.col("status") == "exact_next", n).when(F.col("status") != "before_first", p).alias("prev"),
        F.when(F.col("status") == "interpolated", n).alias("next"))


def asof_pose(queries: DataFrame, frames: DataFrame, by: Sequence[str] = ("scene",), time: str = "t",
              snap: float = SNAP, max_gap: float = MAX_GAP) -> DataFrame:
    """Interpolated pose and intrinsics: translation and k linear, rotation on the shortest arc.

    ``frames`` holds time, frame, k, t_c2w. Rejected queries have a NULL pose and their status.
    """
    r = asof_frames(queries, frames, by, time, ("frame", "k", "t_c2w"), snap, max_gap)
    a, p, n = F.col("alpha"), F.col("prev"), F.col("next")
    lin = lambda x, y: (1.0 - a) * x + a * y
    t = [lin(x, y) for x, y in zip(L.trans_of(p["t_c2w"]), L.trans_of(n["t_c2w"]))]
    r = with_slerp(r, p["t_c2w"], n["t_c2w"], a, "__r")
    mixed = L.pose(L.mat3("__r"), t)
    single = F.col("status").isin("exact", "last")
    inter = F.col("status") == "interpolated"
    extra = [c for c in r.columns if c not in (*by, time, "status", "alpha", "prev", "next", "__r")]
    return r.select(
        *by, time, *extra, "status", F.when(single | inter, p["frame"] + a).alias("frame_pos"),
        F.when(single, p["k"]).when(inter, F.zip_with(p["k"], n["k"], lin)).alias("k"),
        F.when(single, p["t_c2w"]).when(inter, mixed).alias("t_c2w"))
