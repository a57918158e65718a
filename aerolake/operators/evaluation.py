"""Error summaries, trajectory, depth, point-map and benchmark reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.functions import linalg as L
from aerolake.functions.ranking import grouped_rank, quantiles, shifted
from aerolake.operators.alignment import fit_sim3
from aerolake.operators.matching import apply_sim3_poses, centre_correspondences
from aerolake.session import materialize

# fixed values of the metrics
DEPTH_EPS = 1e-12
DELTA_RATIO = 1.25
POINTMAP_RATIO = 1.03
SCALE_EPS = 1e-8
AUC_EPS = 1e-15
DICE_EPS = 1e-6


def null_if_not_finite(c: str | Column) -> Column:
    c = L.col(c).cast("double")
    return F.when(L.finite(c), c)


def summarize(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """mean, rmse, median, p90, p95 and max of the finite values per group, with their count."""
    v = F.col("__v")
    vals = df.select(*by, null_if_not_finite(col).alias("__v"))
    q = quantiles(vals, by, ["__v"], [0.5, 0.9, 0.95], derived=True, extra=[
        F.count(v).alias("num"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rmse"), F.max(v).alias("max"),
    ])
    return q.select(
        *by, "num", "mean", "rmse", F.col("__v_q")[0].alias("median"), F.col("__v_q")[1].alias("p90"),
        F.col("__v_q")[2].alias("p95"), "max",
    )


def align_matched(matched: DataFrame, by: Sequence[str], align: str = "sim3") -> DataFrame:
    """Matched poses with the prediction moved onto the reference; groups that cannot be aligned are left out."""
    if align == "none":
        return matched
    tf = materialize(fit_sim3(centre_correspondences(matched, *by), by, with_scale=align == "sim3"), "fit").where("valid")
    return apply_sim3_poses(matched.join(tf.select(*by), list(by), "left_semi"), tf, by, "pred_c2w")


def pose_errors(matched: DataFrame) -> DataFrame:
    """Centre distance ``ate`` and rotation angle ``rot_deg`` of every matched pose."""
    d = L.sub(L.trans_of("pred_c2w"), L.trans_of("gt_c2w"))
    return matched.withColumns({
        "ate": L.norm(d), "rot_deg": L.rotation_angle(L.rot_of("gt_c2w"), L.rot_of("pred_c2w")),
    })


def trajectory_error(matched: DataFrame, by: Sequence[str], align: str = "sim3") -> DataFrame:
    """Aligned trajectory error: both errors summarised per group, one row per (group, metric)."""
    err = pose_errors(align_matched(matched, by, align))
    long = err.select(*by, F.explode(F.array(
        F.struct(F.lit("ate").alias("metric"), F.col("ate").alias("value")),
        F.struct(F.lit("rot_deg").alias("metric"), F.col("rot_deg").alias("value")),
    )).alias("m")).select(*by, "m.metric", "m.value")
    return summarize(long, "value", [*by, "metric"])


def relative_pose_error(matched: DataFrame, by: Sequence[str], order: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """Relative motion error between poses ``k`` apart in matched order, summarised per (group, k, metric)."""
    by = list(by)
    ranked = materialize(grouped_rank(matched.select(*by, *order, "pred_c2w", "gt_c2w"), by, order, "rk"), "rpe")
    parts = []
    for k in steps:
        j = shifted(ranked, by, "rk", int(k), ["pred_c2w", "gt_c2w"], "n_").where(F.col("n_gt_c2w").isNotNull())

        def rel(a: str, b: str) -> tuple[list[list[Column]], list[Column]]:
            rt = L.transpose(L.rot_of(a))
            return L.matmul(rt, L.rot_of(b)), L.matvec(rt, L.sub(L.trans_of(b), L.trans_of(a)))

        rg, tg = rel("gt_c2w", "n_gt_c2w")
        rp, tp = rel("pred_c2w", "n_pred_c2w")
        # E = rel_gt^-1 rel_pred; its translation is rel_gt^T (t_pred - t_gt), whose length is that of the difference
        parts.append(j.select(*by, F.lit(int(k)).alias("k"), F.explode(F.array(
            F.struct(F.lit("rpe_trans").alias("metric"), L.norm(L.sub(tp, tg)).alias("value")),
            F.struct(F.lit("rpe_rot_deg").alias("metric"), L.rotation_angle(rg, rp).alias("value")),
        )).alias("m")).select(*by, "k", "m.metric", "m.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return summarize(out, "value", [*by, "k", "metric"])


def _auc_histogram(max_deg: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hist(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def unpack(rows) -> tuple[np.ndarray, ...]:
            a = np.stack([np.concatenate([np.asarray(r["gt_c2w"], float), np.asarray(r["pred_c2w"], float)]) for r in rows])
            m = a.reshape(-1, 2, 4, 4)
            return m[:, 0, :3, :3], m[:, 0, :3, 3], m[:, 1, :3, :3], m[:, 1, :3, 3]

        def unit(v: np.ndarray) -> np.ndarray:
            return v / (np.linalg.norm(v, axis=-1, keepdims=True) + AUC_EPS)

        def relative(r, t, r2, t2):
            return np.einsum("iba,jbc->ijac", r, r2), np.einsum("iba,ijb->ija", r, t2[None] - t[:, None])

        for left, right, same in batches:
            out = []
            for a, b, eq in zip(left, right, same):
                ga, ta, pa, sa = unpack(a)
                gb, tb, pb, sb = unpack(b)
                rg, tg = relative(ga, ta, gb, tb)
                rp, tp = relative(pa, sa, pb, sb)
                cos = np.clip((np.einsum("ijab,ijab->ij", rg, rp) - 1) / 2, -1, 1)
                d = np.einsum("ija,ija->ij", unit(tg), unit(tp))
                rot = np.degrees(np.arccos(cos))
                tr = np.degrees(np.arccos(np.sqrt(1 - np.maximum(1 - d * d, AUC_EPS))))
                err = np.maximum(rot, np.minimum(tr, np.abs(180 - tr)))
                vals = err[np.triu_indices(err.shape[0], 1)] if eq else err.ravel()
                out.append(np.histogram(vals, bins=np.arange(max_deg + 1))[0])
            yield pd.Series(out)

    return hist


def pose_auc(matched: DataFrame, by: Sequence[str], order: Sequence[str], max_deg: int = 30, block: int = 128) -> DataFrame:
    """Area under the cumulative share of view pairs with error below 1, 2, ... ``max_deg`` degrees, in percent.

    The metric is defined over all pairs of a set. Views are packed in blocks and each pair of blocks is reduced
    to a histogram inside its task, so no row per view pair exists.
    """
    by = list(by)
    ranked = grouped_rank(matched.select(*by, *order, "pred_c2w", "gt_c2w"), by, order, "rk")
    blocks = ranked.withColumn("blk", F.floor(F.col("rk") / block)).groupBy(*by, "blk").agg(
        F.collect_list(F.struct("gt_c2w", "pred_c2w")).alias("v"))
    blocks = materialize(blocks, "blocks")
    last = blocks.groupBy(*by).agg(F.max("blk").alias("last"))
    # each block names its partners; the join is on (set, block), not on the set alone
    left = blocks.join(last, by).withColumn("other", F.explode(F.sequence(F.col("blk"), F.col("last"))))
    right = blocks.select(*by, F.col("blk").alias("other"), F.col("v").alias("w"))
    pairs = left.join(right, [*by, "other"])
    hist = pairs.select(*by, _auc_histogram(max_deg)("v", "w", F.col("blk") == F.col("other")).alias("h"))
    counts = hist.select(*by, F.posexplode("h").alias("bin", "c")).groupBy(*by, "bin").agg(F.sum("c").alias("c"))
    n = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("num_views"))
    # mean of the running sums of a histogram = each bin weighted by the bins from it on
    auc = counts.groupBy(*by).agg(F.sum(F.col("c") * (F.lit(max_deg) - F.col("bin"))).alias("area"))
    pairs_n = F.col("num_views") * (F.col("num_views") - 1) / 2
    return n.join(auc, by).where("num_views >= 2").select(
        *by, "num_views", (F.col("area") / pairs_n / max_deg * 100.0).alias("auc"))


def trajectory_scale(matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean distance to the centroid for reference and prediction, and their ratio, relative and log error."""
    c = centre_correspondences(matched, *by)
    mean = materialize(c.groupBy(*by).agg(*[F.avg(f"{s}{a}").alias(f"m{s}{a}") for s in "sd" for a in "xyz"],
                                          F.count(F.lit(1)).alias("n")), "centroid")
    j = c.join(mean, list(by))
    d = lambda s: L.norm([F.col(f"{s}{a}") - F.col(f"m{s}{a}") for a in "xyz"])
    out = j.groupBy(*by).agg(F.avg(d("d")).alias("g"), F.avg(d("s")).alias("p"), F.max("n").alias("n")).where("n >= 2")
    ratio = F.when((F.col("g") > SCALE_EPS) & (F.col("p") > SCALE_EPS), F.col("p") / F.col("g"))
    return out.select(
        *by, F.col("g").alias("scale_gt"), F.col("p").alias("scale_pred"), ratio.alias("scale_ratio"),
        F.abs(ratio - 1.0).alias("scale_rel_error"), F.abs(F.log(ratio)).alias("scale_log_error"),
    )


def cloud_fscore(dist: DataFrame, by: Sequence[str], thresholds: Sequence[float], closed: bool = True) -> DataFrame:
    """Precision, recall, F-score and outlier share per threshold.

    ``dist`` holds (by, side, d) with side 'acc' for prediction to reference and 'comp' for the other way.
    """
    hit = lambda side, t: F.avg(F.when(
        F.col("side") == side, ((F.col("d") <= t) if closed else (F.col("d") < t)).cast("double")))
    agg = dist.groupBy(*by).agg(*[hit(s, t).alias(f"{s}{i}") for i, t in enumerate(thresholds) for s in ("acc", "comp")])
    rows = agg.select(*by, F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"acc{i}").alias("precision"), F.col(f"comp{i}").alias("recall"))
        for i, t in enumerate(thresholds)])).alias("m")).select(*by, "m.*")
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumns({
        "fscore": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "outlier_ratio": 1.0 - p,
    })


def cloud_error(dist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy and completeness summaries plus both chamfer sums from (by, side, d)."""
    per = summarize(dist, "d", [*by, "side"])
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    l1 = side("acc", "mean") + side("comp", "mean")
    sq = lambda s: side(s, "rmse") * side(s, "rmse")
    return per.groupBy(*by).agg(
        *[side(s, c).alias(f"{s}_{c}") for s in ("acc", "comp") for c in ("mean", "rmse", "median", "p90", "p95", "max")],
        l1.alias("chamfer_l1"), (l1 / 2).alias("chamfer_l1_half"), (sq("acc") + sq("comp")).alias("chamfer_l2"),
    )


def depth_metrics(pixels: DataFrame, view: Sequence[str], by: Sequence[str], pred: str = "z", gt: str = "z_gt",
                  mask: str = "valid") -> DataFrame:
    """abs_rel, rmse, mae and delta per view, then their mean over the views that have a value."""
    p, g = F.col(pred), F.col(gt)
    base = F.col(mask) & L.finite(p) & L.finite(g)
    pos = base & (g > DEPTH_EPS) & (p > DEPTH_EPS)
    per = pixels.groupBy(*dict.fromkeys([*by, *view])).agg(
        F.avg(F.when(pos, F.abs(p - g) / g)).alias("abs_rel"),
        F.sqrt(F.avg(F.when(base, (p - g) * (p - g)))).alias("rmse"),
        F.avg(F.when(base, F.abs(p - g))).alias("mae"),
        F.avg(F.when(pos, (F.greatest(g / p, p / g) < DELTA_RATIO).cast("double"))).alias("delta"),
    )
    return per.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("abs_rel", "rmse", "mae", "delta")],
                                F.count(F.lit(1)).alias("num_views"))


def pointmap_metrics(points: DataFrame, by: Sequence[str], mask: str = "valid", ratio: float = POINTMAP_RATIO) -> DataFrame:
    """Relative point-map error, inlier share, MAE, RMSE and mean ray angle over (px,py,pz) and (gx,gy,gz)."""
    p, g = L.vec("px", "py", "pz"), L.vec("gx", "gy", "gz")
    e, gn, pn = L.norm(L.sub(p, g)), L.norm(g), L.norm(p)
    ok = F.col(mask)
    rel = ok & (gn > 0)
    best = F.greatest(F.coalesce(F.try_divide(gn, pn), F.lit(ratio + 1)), pn / gn)
    chord = L.norm([a / pn - b / gn for a, b in zip(p, g)])
    return points.groupBy(*by).agg(
        F.avg(F.when(rel, e / gn)).alias("rel_ae"),
        F.avg(F.when(rel, ((best > 0) & (best < ratio)).cast("double"))).alias("inlier_ratio"),
        F.avg(F.when(ok, e)).alias("mae"), F.sqrt(F.avg(F.when(ok, e * e))).alias("rmse"),
        F.avg(F.when(rel & (pn > 0), F.degrees(2 * F.asin(F.least(F.lit(1.0), chord / 2))))).alias("ray_deg"),
    )


def benchmark_table(metrics: DataFrame, scenes: Sequence | None = None) -> DataFrame:
    """(dataset, metric, method) rows with one column per scene and the average over the scenes present."""
    keys = ["dataset", "metric", "method"]
    v = null_if_not_finite("value")
    piv = metrics.withColumn("scene", F.concat(F.lit("scene_"), F.col("scene").cast("string"))).groupBy(*keys)
    piv = piv.pivot("scene", [f"scene_{s}" for s in scenes] if scenes is not None else None).agg(F.first(v, ignorenulls=True))
    return piv.join(metrics.groupBy(*keys).agg(F.avg(v).alias("average")), keys)


def benchmark_rollup(metrics: DataFrame) -> DataFrame:
    """Means per scene with subtotals by method and dataset; ``level`` counts the rolled-up columns."""
    v = null_if_not_finite("value")
    return metrics.rollup("dataset", "method", "scene").agg(
        F.avg(v).alias("mean_value"), F.count(v).alias("num_scenes"), F.grouping_id().alias("level"))


def ablation_report(results: DataFrame, names: DataFrame) -> DataFrame:
    """One row per named experiment: macro means over scenes, summed edge counts, peak memory, missing flag.

    ``names`` holds (experiment, display, source); ``source`` is the experiment whose rows are used.
    """
    mean = lambda c: F.avg(null_if_not_finite(c)).alias(c)
    agg = results.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("num_scenes"), mean("chamfer"), mean("ate"), mean("seam"), mean("seam_z"), mean("runtime"),
        F.sum("valid_edges").alias("valid_edges"), F.sum("total_edges").alias("total_edges"),
        F.max(null_if_not_finite("memory")).alias("peak_memory"),
        F.count_if(null_if_not_finite("chamfer").isNull() | null_if_not_finite("ate").isNull()).alias("invalid_rows"),
    ).withColumnRenamed("experiment", "source")
    return names.join(agg, "source", "left").withColumn("missing", F.col("num_scenes").isNull())


def scalability(results: DataFrame, methods: DataFrame, counts: Sequence[int]) -> DataFrame:
    """Every expected (method, image count) with stage times and the remainder; absent runs are marked."""
    grid = methods.select("method", F.explode(F.array(*[F.lit(int(c)) for c in counts])).alias("images"))
    j = grid.join(results, ["method", "images"], "left")
    stages = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("chunking", "model", "alignment")]
    other = F.greatest(F.lit(0.0), F.col("total") - stages[0] - stages[1] - stages[2])
    return j.select("method", "images", "total", "memory", "chunking", "model", "alignment", other.alias("other"),
                    F.col("total").isNull().alias("missing"))


def segmentation_scores(scores: DataFrame, pixel: Sequence[str], by: Sequence[str], num_classes: int,
                        ignore: int = 255, smoothing: float = 0.0, background: bool = True, eps: float = DICE_EPS) -> DataFrame:
    """Cross-entropy (label smoothing, ignored label) and soft Dice loss over (pixel, cls, logit, label)."""
    key = list(dict.fromkeys([*by, *pixel]))
    # one pixel has num_classes rows, so its scores fit in one array
    px = scores.where(F.col("label") != ignore).groupBy(*key, "label").agg(
        F.array_sort(F.collect_list(F.struct("cls", "logit"))).alias("l"), F.max("logit").alias("top"))
    px = px.withColumn("lse", F.col("top") + F.log(F.aggregate(
        "l", F.lit(0.0), lambda a, s: a + F.exp(s["logit"] - F.col("top")))))
    logp = F.transform("l", lambda s: F.struct(s["cls"].alias("cls"), (s["logit"] - F.col("lse")).alias("lp")))
    px = px.withColumn("lp", logp)
    hit = F.aggregate("lp", F.lit(0.0), lambda a, s: a + F.when(s["cls"] == F.col("label"), s["lp"]).otherwise(0.0))
    mean = F.aggregate("lp", F.lit(0.0), lambda a, s: a + s["lp"]) / num_classes
    px = px.withColumn("ce", -((1 - smoothing) * hit + smoothing * mean))
    ce = px.groupBy(*by).agg(F.avg("ce").alias("cross_entropy"), F.count(F.lit(1)).alias("num_pixels"))
    cls = px.select(*by, "label", F.explode("lp").alias("s")).select(
        *by, F.col("s.cls").alias("cls"), F.exp("s.lp").alias("p"), (F.col("label") == F.col("s.cls")).cast("double").alias("y"))
    per = cls.groupBy(*by, "cls").agg(
        F.sum(F.col("p") * F.col("y")).alias("i"), F.sum(F.col("p") + F.col("y")).alias("d"), F.sum("y").alias("ny"))
    if not background:
        per = per.where("cls <> 0")
    dice = per.where("ny > 0").groupBy(*by).agg(
        (1 - F.avg((2 * F.col("i") + eps) / (F.col("d") + eps))).alias("dice_loss"), F.count(F.lit(1)).alias("num_classes"))
    return ce.join(dice, list(by), "left")


def confidence_error(pixels: DataFrame, view: Sequence[str], by: Sequence[str], err: str, conf: str, alpha: float) -> DataFrame:
    """Mean of err * conf - alpha * log(conf) per view, then over the views with data."""
    e, c = L.col(err), L.col(conf)
    per = pixels.groupBy(*dict.fromkeys([*by, *view])).agg(F.avg(e * c - alpha * F.log(c)).alias("v"))
    return per.groupBy(*by).agg(F.avg("v").alias("confidence_error"), F.count("v").alias("num_views"))


def trimmed_mean(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], pct: float) -> DataFrame:
    """Mean of the floor(n * pct / 100) smallest values per group."""
    by = list(by)
    ranked = grouped_rank(df.where(L.finite(col)).select(*by, *order, col), by, [col, *order], "__r")
    n = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    kept = ranked.join(n, by).withColumn("__k", F.floor(F.col("__n") * F.lit(float(pct)) / 100.0)).where("__r < __k")
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("kept"), F.avg(col).alias("trimmed_mean"))


def fit_depth_scale(pixels: DataFrame, by: Sequence[str], view: Sequence[str], order: Sequence[str], pred: str = "z",
                    gt: str = "z_gt", mask: str = "valid", max_total: int = 0, seed: int = 0) -> DataFrame:
    """One scale per set: median of gt / pred over valid pixels; ``max_total`` > 0 caps each view in proportion to its share."""
    by, key = list(by), list(dict.fromkeys([*by, *view]))
    p, g = F.col(pred), F.col(gt)
    masked = pixels.where(F.col(mask))
    total = masked.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    ok = masked.where(L.finite(p) & L.finite(g) & (g > DEPTH_EPS) & (p > DEPTH_EPS))
    if max_total > 0:
        ok = _capped_views(ok.join(total, by), key, order, max_total, seed)
    q = quantiles(ok.select(*by, (g / p).alias("ratio")), by, ["ratio"], [0.5], derived=True)
    return total.join(q, by, "left").select(
        *by, F.coalesce("n", F.lit(0).cast("long")).alias("num_ratios"),
        F.when(F.col("ratio_q")[0] > 0, F.col("ratio_q")[0]).otherwise(1.0).alias("depth_scale"))


def _capped_views(ok: DataFrame, key: Sequence[str], order: Sequence[str], max_total: int, seed: int) -> DataFrame:
    # the rank runs inside one view, whose size is that of one image
    w = Window.partitionBy(*key).orderBy(L.uniform(seed, *key, *order), *order)
    ok = ok.withColumns({"rk": F.row_number().over(w), "nv": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    cap = F.greatest(F.lit(1), F.floor(F.lit(max_total) * F.col("nv") / F.col("total")))
    return ok.where(F.col("rk") <= cap)
