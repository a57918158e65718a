"""Sinks: chunk payloads, chunk lists, evaluation bundles, flat metric rows, reconstruction text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import deal
from aerolake.operators.matching import finite_pose

# fixed value: colour of points without one
DEFAULT_COLOR = 220
# fixed value: folders that the chunk lists of all scenes are dealt over
LIST_BLOCKS = 64


def write_chunk_payload(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-chunk arrays as one Parquet partition per (scene, chunk_id).

    Rows are gathered by chunk first, so a chunk is one file; large ones are split by adaptive execution.
    """
    df.hint("rebalance", "scene", "chunk_id").write.mode(mode).partitionBy("scene", "chunk_id").parquet(path)


def read_chunk_payload(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    """The named columns of the payload, with the partition keys; other columns are not read."""
    df = spark.read.parquet(path)
    return df if cols is None else df.select("scene", "chunk_id", *cols)


def update_chunk_payload(df: DataFrame, path: str) -> None:
    """Replace the chunks present in ``df`` and leave the others alone."""
    df.hint("rebalance", "scene", "chunk_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene", "chunk_id").parquet(path)


def export_chunks(chunks: DataFrame, members: DataFrame, adjacency: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per chunk with sorted index lists, one row per (chunk, frame, role)).

    A chunk has at most its configured number of frames, so its lists are short.
    """
    key = ["scene", "chunk_id"]
    pick = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("frame"))))
    lists = members.groupBy(*key).agg(F.array_sort(F.collect_set("frame")).alias("indices"), pick("core").alias("core_indices"),
                                      pick("overlap").alias("overlap_indices"), F.count_if(F.col("role") == "core").alias("num_core"))
    extra = [c for c in chunks.columns if c not in (*key, "num_core")]
    out = chunks.select(*key, *extra).join(lists, key, "left")
    if adjacency is not None:
        out = out.join(adjacency.groupBy(*key).agg(F.array_sort(F.collect_set("other")).alias("neighbours")), key, "left")
    return out, members.select(*key, "frame", "role")


def write_chunk_lists(rows: DataFrame, path: str) -> None:
    """Chunk rows as JSON lines that name their scene, in one folder per block of scenes: a scene lies in one folder, and their
    number is bounded however many scenes there are."""
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("scene"), F.lit(LIST_BLOCKS)))
    blocks.hint("rebalance", "block").write.mode("overwrite").partitionBy("block").json(path)


def write_tagged_lines(lines: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """Lines (path, value) of many logs as text files that follow the number of lines, not of logs: each line is led by the path of its
    log and a tab. A log lies in one file, in the given order."""
    rows = deal(lines, lines.count(), "path").sortWithinPartitions("path", *order)
    rows.select(F.concat_ws("\t", "path", F.coalesce("value", F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def eval_bundle(pred_cams: DataFrame, gt_cams: DataFrame, pred_pts: DataFrame, gt_pts: DataFrame) -> dict[str, DataFrame]:
    """The tables of an evaluation bundle: cameras with a valid flag (an invalid pose is all NaN), finite points with
    colours (220 where missing), and counts per scene."""
    bad = F.array_repeat(F.lit(float("nan")), 16)

    def cams(df: DataFrame) -> DataFrame:
        v = finite_pose("t_c2w")
        return df.select("scene", "stem", F.when(v, F.col("t_c2w")).otherwise(bad).alias("t_c2w"), v.alias("valid"))

    def pts(df: DataFrame) -> DataFrame:
        color = lambda c: (F.coalesce(F.col(c), F.lit(DEFAULT_COLOR)) if c in df.columns else F.lit(DEFAULT_COLOR)).cast("short").alias(c)
        return df.where(L.finite("x") & L.finite("y") & L.finite("z")).select("scene", "x", "y", "z", *[color(c) for c in "rgb"])

    t = {"pred_cameras": cams(pred_cams), "gt_cameras": cams(gt_cams), "pred_points": pts(pred_pts), "gt_points": pts(gt_pts)}
    n = lambda k, **aggs: t[k].groupBy("scene").agg(*[v.alias(a) for a, v in aggs.items()])
    one, ok = F.count(F.lit(1)), F.count_if(F.col("valid"))
    meta = n("pred_cameras", num_cameras=one, num_valid_cameras=ok).join(n("gt_cameras", num_gt_cameras=one, num_valid_gt_cameras=ok), "scene", "full").join(
        n("pred_points", num_points=one), "scene", "full").join(n("gt_points", num_gt_points=one), "scene", "full")
    t["meta"] = meta.na.fill(0)
    return t


def write_eval_bundle(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def flatten_metrics(metrics: DataFrame, keys: Sequence[str] = ("scene",), names: Sequence[str] | None = None) -> DataFrame:
    """One wide row per key from (keys, metric, value); dots in a metric name become 'p', as in precision@0p5."""
    m = metrics.withColumn("metric", F.regexp_replace("metric", r"\.", "p"))
    wanted = [n.replace(".", "p") for n in names] if names is not None else None
    return m.groupBy(*keys).pivot("metric", wanted).agg(F.first("value", ignorenulls=True))


def write_metrics_csv(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").option("header", "true").csv(path)


def recon_image_lines(obs: DataFrame, images: DataFrame, by: Sequence[str] = ("scene",), view: str = "frame") -> DataFrame:
    """(by, image_id, line): the two-line image records of a reconstruction, points in ``p2d_idx`` order.

    ``images`` holds qw..qz, tx..tz, camera_id and name. A view lists the points it sees, so a record is as long as one image's.
    """
    trip = F.concat_ws(" ", F.col("u").cast("string"), F.col("v").cast("string"), F.col("point3d_id").cast("string"))
    pts = obs.groupBy(*by, view).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("p2d_idx").alias("i"), trip.alias("s")))), lambda a: a["s"]), " ").alias("pts"))
    j = images.join(pts, [*by, view], "left")
    head = F.concat_ws(" ", *[F.col(c).cast("string") for c in (view, "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name")])
    return j.select(*by, F.col(view).alias("image_id"), F.concat(head, F.lit("\n"), F.coalesce("pts", F.lit(""))).alias("line"))
