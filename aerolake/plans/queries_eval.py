"""Registered queries: error summaries, trajectory, depth and benchmark reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.operators import evaluation as E
from aerolake.operators import matching as M
from aerolake.plans import checksql as S
from aerolake.plans import inputs as I
from aerolake.plans.fixtures import view
from aerolake.plans.queries_align import uniform_sql
from aerolake.plans.registry import query


def matched(spark, d):
    return M.match_cameras(I.pred_cams(spark, d), I.gt_cams(spark, d))


@query("f1_summarize", f"""SELECT scene, {S.SUMMARY} FROM (SELECT scene, value FROM {{fx_metrics}}) GROUP BY scene""")
def f1(spark, d):
    return I.rounded(E.summarize(view(spark, d, "fx_metrics"), "value", ["scene"]))


_ERR = "sqrt(" + " + ".join(f"({S.moved(i)} - d{a})^2" for i, a in enumerate("xyz")) + ")"


@query("f2_trajectory_error", f"""WITH RECURSIVE {S.POSES}, {S.horn('corr', 'scene')},
v AS (SELECT scene, 'ate' AS metric, {_ERR} AS value FROM corr JOIN sim USING (scene) WHERE valid
  UNION ALL SELECT scene, 'rot_deg', {S.rot_error()} FROM corr JOIN sim USING (scene) WHERE valid)
SELECT scene, metric, {S.SUMMARY.replace(', 6)', ', 4)')} FROM v GROUP BY scene, metric""")
def f2(spark, d):
    return I.rounded(E.trajectory_error(matched(spark, d), ["scene"]), 4)


@query("f2_trajectory_error_rigid", f"""WITH RECURSIVE {S.POSES}, {S.horn('corr', 'scene', with_scale=False)},
v AS (SELECT scene, 'ate' AS metric, {_ERR} AS value FROM corr JOIN sim USING (scene) WHERE valid
  UNION ALL SELECT scene, 'rot_deg', {S.rot_error()} FROM corr JOIN sim USING (scene) WHERE valid)
SELECT scene, metric, {S.SUMMARY.replace(', 6)', ', 4)')} FROM v GROUP BY scene, metric""")
def f2_rigid(spark, d):
    return I.rounded(E.trajectory_error(matched(spark, d), ["scene"], align="rigid"), 4)


_EYE = "(SELECT DISTINCT scene, " + ", ".join(f"{float(i == j)}::DOUBLE AS r{i}{j}" for i in range(3) for j in range(3)) + " FROM corr)"


@query("f2_trajectory_error_unaligned", f"""WITH {S.POSES}
SELECT scene, metric, {S.SUMMARY.replace(', 6)', ', 4)')} FROM (
  SELECT scene, 'ate' AS metric, sqrt((sx-dx)^2 + (sy-dy)^2 + (sz-dz)^2) AS value FROM corr
  UNION ALL SELECT c.scene, 'rot_deg', {S.rot_error()} FROM corr c JOIN {_EYE} USING (scene)) GROUP BY scene, metric""")
def f2_none(spark, d):
    return I.rounded(E.trajectory_error(matched(spark, d), ["scene"], align="none"), 4)


_REL = """
ang AS (SELECT *, 0.1::DOUBLE * (frame % 5) AS ga, atan2(0.8::DOUBLE, 0.6::DOUBLE) + 0.1::DOUBLE * (frame % 5) + 0.002::DOUBLE * (frame % 3) AS pa FROM corr),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame) AS rk FROM ang),
pr AS (SELECT a.scene, b.rk - a.rk AS k,
  a.gca*(b.dx-a.dx) + a.gsa*(b.dy-a.dy) AS gx, a.gsa*(b.dx-a.dx) - a.gca*(b.dy-a.dy) AS gy, -(b.dz-a.dz) AS gz,
  a.pca*(b.sx-a.sx) + a.psa*(b.sy-a.sy) AS px, a.psa*(b.sx-a.sx) - a.pca*(b.sy-a.sy) AS py, -(b.sz-a.sz) AS pz,
  degrees(acos(greatest(-1, least(1, cos((b.pa - a.pa) - (b.ga - a.ga)))))) AS rot
  FROM rk a JOIN rk b ON a.scene = b.scene AND a.rk < b.rk)"""


@query("f3_relative_pose_error", f"""WITH {S.POSES}, {_REL},
v AS (SELECT scene, CAST(k AS INT) AS k, 'rpe_trans' AS metric, sqrt((gx-px)^2 + (gy-py)^2 + (gz-pz)^2) AS value FROM pr WHERE k IN (1, 5, 10)
  UNION ALL SELECT scene, CAST(k AS INT), 'rpe_rot_deg', rot FROM pr WHERE k IN (1, 5, 10))
SELECT scene, k, metric, {S.SUMMARY.replace(', 6)', ', 4)')} FROM v GROUP BY scene, k, metric""")
def f3(spark, d):
    return I.rounded(
        E.relative_pose_error(matched(spark, d), ["scene"], ["stem"], [1, 5, 10]), 4)


@query("f6_pose_auc", f"""WITH {S.POSES}, {_REL},
e AS (SELECT scene, greatest(rot, degrees(acos(sqrt(1 - greatest(1e-15, 1 - ((gx*px + gy*py + gz*pz) /
  ((sqrt(gx*gx+gy*gy+gz*gz) + 1e-15) * (sqrt(px*px+py*py+pz*pz) + 1e-15)))^2))))) AS err FROM pr),
n AS (SELECT scene, count(*) AS num_views FROM corr GROUP BY scene)
SELECT scene, num_views, round(coalesce(sum(CASE WHEN err < 30 THEN 30 - floor(err) WHEN err = 30 THEN 1 ELSE 0 END), 0) / (num_views * (num_views - 1) / 2) / 30 * 100.0, 6) AS auc
FROM n JOIN e USING (scene) GROUP BY scene, num_views""")
def f6(spark, d):
    return I.rounded(E.pose_auc(matched(spark, d), ["scene"], ["stem"]))


@query("f7_depth_metrics", """WITH p AS (SELECT floor(frame / 8) AS setid, * FROM {fx_pixels}),
v AS (SELECT setid, frame, avg(CASE WHEN valid THEN abs(z - z_gt) / z_gt END) AS abs_rel, sqrt(avg(CASE WHEN valid THEN (z - z_gt)^2 END)) AS rmse,
  avg(CASE WHEN valid THEN abs(z - z_gt) END) AS mae, avg(CASE WHEN valid THEN CASE WHEN greatest(z / z_gt, z_gt / z) < 1.25 THEN 1.0::DOUBLE ELSE 0 END END) AS delta FROM p GROUP BY setid, frame)
SELECT CAST(setid AS BIGINT) AS setid, round(avg(abs_rel), 6) AS abs_rel, round(avg(rmse), 6) AS rmse, round(avg(mae), 6) AS mae, round(avg(delta), 6) AS delta, count(*) AS num_views FROM v GROUP BY setid""")
def f7(spark, d):
    px = view(spark, d, "fx_pixels").withColumn("setid", F.floor(F.col("frame") / 8))
    return I.rounded(E.depth_metrics(px, ["frame"], ["setid"]))


@query("f8_pointmap_metrics", """WITH p AS (SELECT frame, valid, (x - 8) * z / 50 AS px, (y - 8) * z / 50 AS py, z AS pz, (x - 8) * z_gt / 50 AS gx, (y - 8) * z_gt / 50 + 1 AS gy, z_gt AS gz FROM {fx_pixels}),
q AS (SELECT *, sqrt((px-gx)^2 + (py-gy)^2 + (pz-gz)^2) AS e, sqrt(gx*gx + gy*gy + gz*gz) AS gn, sqrt(px*px + py*py + pz*pz) AS pn FROM p WHERE valid)
SELECT frame, round(avg(e / gn), 6) AS rel_ae, round(avg(CASE WHEN greatest(gn / pn, pn / gn) < 1.03::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS inlier_ratio,
  round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse,
  round(avg(degrees(2 * atan2(sqrt((px/pn-gx/gn)^2 + (py/pn-gy/gn)^2 + (pz/pn-gz/gn)^2), sqrt((px/pn+gx/gn)^2 + (py/pn+gy/gn)^2 + (pz/pn+gz/gn)^2)))), 6) AS ray_deg FROM q GROUP BY frame""")
def f8(spark, d):
    z, g = F.col("z"), F.col("z_gt")
    u, v = (F.col("x") - 8), (F.col("y") - 8)
    px = view(spark, d, "fx_pixels").select("frame", "valid", (u * z / 50).alias("px"), (v * z / 50).alias("py"), z.alias("pz"),
                                            (u * g / 50).alias("gx"), (v * g / 50 + 1).alias("gy"), g.alias("gz"))
    return I.rounded(E.pointmap_metrics(px, ["frame"]))


@query("f9_trajectory_scale", f"""WITH {S.POSES},
m AS (SELECT scene, avg(sx) AS ax, avg(sy) AS ay, avg(sz) AS az, avg(dx) AS bx, avg(dy) AS by_, avg(dz) AS bz FROM corr GROUP BY scene),
g AS (SELECT scene, avg(sqrt((dx-bx)^2 + (dy-by_)^2 + (dz-bz)^2)) AS g, avg(sqrt((sx-ax)^2 + (sy-ay)^2 + (sz-az)^2)) AS p FROM corr JOIN m USING (scene) GROUP BY scene)
SELECT scene, round(g, 6) AS scale_gt, round(p, 6) AS scale_pred, round(p / g, 6) AS scale_ratio, round(abs(p / g - 1), 6) AS scale_rel_error, round(abs(ln(p / g)), 6) AS scale_log_error FROM g""")
def f9(spark, d):
    return I.rounded(E.trajectory_scale(matched(spark, d), ["scene"]))


_SC = ", ".join(f"round(max(value) FILTER (WHERE scene = {i}), 6) AS scene_{i}" for i in range(6))


@query("f11_benchmark_table", f"""SELECT dataset, metric, method, {_SC}, round(avg(value), 6) AS average FROM {{fx_metrics}} GROUP BY ALL""")
def f11(spark, d):
    return I.rounded(E.benchmark_table(view(spark, d, "fx_metrics"), list(range(6))))


@query("f11_benchmark_rollup", """SELECT dataset, method, scene, round(avg(value), 6) AS mean_value, count(value) AS num_scenes,
  CAST(grouping(dataset) * 4 + grouping(method) * 2 + grouping(scene) AS BIGINT) AS level FROM {fx_metrics} GROUP BY ROLLUP (dataset, method, scene)""")
def f11_rollup(spark, d):
    return I.rounded(E.benchmark_rollup(view(spark, d, "fx_metrics")))


_ABL = """r AS (SELECT o_orderpriority AS experiment, o_custkey % 6 AS scene, avg(o_totalprice) / 1000 AS chamfer,
  CASE WHEN o_custkey % 6 = 5 AND o_orderpriority = '5-LOW' THEN NULL ELSE avg(o_totalprice) / 2000 END AS ate, max(o_totalprice) / 3000 AS seam,
  min(o_totalprice) AS seam_z, CAST(count(*) AS DOUBLE) AS runtime, count(*) FILTER (WHERE o_orderstatus = 'F') AS valid_edges, count(*) AS total_edges,
  max(o_totalprice) AS memory FROM {orders} GROUP BY o_orderpriority, o_custkey % 6)"""


def _abl(spark, d):
    return spark.sql("WITH " + _ABL + " SELECT * FROM r", orders=view(spark, d, "orders"))


def _names(spark, d):
    base = view(spark, d, "orders").select(F.col("o_orderpriority").alias("source")).distinct()
    own = base.select(F.col("source").alias("experiment"), F.concat(F.lit("Exp "), "source").alias("display"), "source")
    alias = base.select(F.concat("source", F.lit("-alias")).alias("experiment"), F.concat(F.lit("Alias of "), "source").alias("display"),
                        F.when(F.col("source") == "5-LOW", F.lit("absent")).otherwise(F.col("source")).alias("source"))
    return own.unionByName(alias)


@query("f12_ablation_report", f"""WITH {_ABL},
s AS (SELECT DISTINCT o_orderpriority AS source FROM orders),
n AS (SELECT source AS experiment, 'Exp ' || source AS display, source FROM s UNION ALL
  SELECT source || '-alias', 'Alias of ' || source, CASE WHEN source = '5-LOW' THEN 'absent' ELSE source END FROM s),
a AS (SELECT experiment AS source, count(*) AS num_scenes, round(avg(chamfer), 6) AS chamfer, round(avg(ate), 6) AS ate, round(avg(seam), 6) AS seam,
  round(avg(seam_z), 6) AS seam_z, round(avg(runtime), 6) AS runtime, sum(valid_edges)::BIGINT AS valid_edges, sum(total_edges)::BIGINT AS total_edges,
  max(memory) AS peak_memory, count(*) FILTER (WHERE chamfer IS NULL OR ate IS NULL) AS invalid_rows FROM r GROUP BY experiment)
SELECT n.*, a.* EXCLUDE (source), num_scenes IS NULL AS missing FROM n LEFT JOIN a USING (source)""")
def f12(spark, d):
    return I.rounded(E.ablation_report(_abl(spark, d), _names(spark, d)))


_COUNTS = (100, 250, 500, 1000, 2000)


@query("f13_scalability", """WITH r AS (SELECT o_orderpriority AS method, CAST(CASE o_custkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 250 WHEN 2 THEN 500 ELSE 1000 END AS INT) AS images,
  max(o_totalprice) AS total, min(o_totalprice) AS memory, avg(o_totalprice) / 4 AS chunking, avg(o_totalprice) / 3 AS model, avg(o_totalprice) / 5 AS alignment FROM orders GROUP BY 1, 2),
g AS (SELECT DISTINCT o_orderpriority AS method, CAST(unnest([100, 250, 500, 1000, 2000]) AS INT) AS images FROM orders)
SELECT method, images, round(total, 6) AS total, round(memory, 6) AS memory, round(chunking, 6) AS chunking, round(model, 6) AS model, round(alignment, 6) AS alignment,
  CASE WHEN total IS NULL THEN 0 ELSE round(greatest(0, total - chunking - model - alignment), 6) END AS other, total IS NULL AS missing FROM g LEFT JOIN r USING (method, images)""")
def f13(spark, d):
    o = view(spark, d, "orders")
    images = F.element_at(F.array(*[F.lit(c) for c in _COUNTS[:4]]), (F.col("o_custkey") % 4 + 1).cast("int"))
    p = F.col("o_totalprice")
    r = o.groupBy(F.col("o_orderpriority").alias("method"), images.alias("images")).agg(
        F.max(p).alias("total"), F.min(p).alias("memory"), (F.avg(p) / 4).alias("chunking"), (F.avg(p) / 3).alias("model"),
        (F.avg(p) / 5).alias("alignment"))
    return I.rounded(E.scalability(r, o.select(F.col("o_orderpriority").alias("method")).distinct(), _COUNTS))


@query("f14_segmentation_scores", """WITH m AS (SELECT frame, y, x, max(logit) AS top, ln(sum(exp(logit))) AS lse FROM {fx_scores} GROUP BY frame, y, x),
s AS (SELECT s.*, logit - lse AS lp FROM {fx_scores} s JOIN m USING (frame, y, x)),
c AS (SELECT frame, y, x, -(0.9::DOUBLE * sum(CASE WHEN cls = label THEN lp ELSE 0 END) + 0.1::DOUBLE * sum(lp) / 4) AS ce FROM s GROUP BY frame, y, x),
ce AS (SELECT frame, round(avg(ce), 6) AS cross_entropy, count(*) AS num_pixels FROM c GROUP BY frame),
k AS (SELECT frame, cls, sum(CASE WHEN cls = label THEN exp(lp) ELSE 0 END) AS i, sum(exp(lp) + CASE WHEN cls = label THEN 1 ELSE 0 END) AS dd FROM s GROUP BY frame, cls HAVING count(*) FILTER (WHERE cls = label) > 0),
di AS (SELECT frame, round(1 - avg((2 * i + 1e-6) / (dd + 1e-6)), 6) AS dice_loss, count(*) AS num_classes FROM k GROUP BY frame)
SELECT * FROM ce LEFT JOIN di USING (frame)""")
def f14(spark, d):
    return I.rounded(E.segmentation_scores(view(spark, d, "fx_scores"), ["frame", "y", "x"], ["frame"], 4, smoothing=0.1))


@query("f15_confidence_error", """WITH v AS (SELECT floor(frame / 8) AS setid, frame, avg(CASE WHEN valid THEN abs(z - z_gt) * (1 + conf) - 0.2::DOUBLE * ln(1 + conf) END) AS v FROM {fx_pixels} GROUP BY ALL)
SELECT CAST(setid AS BIGINT) AS setid, round(avg(v), 6) AS confidence_error, count(v) AS num_views FROM v GROUP BY setid""")
def f15(spark, d):
    px = view(spark, d, "fx_pixels").withColumns({
        "setid": F.floor(F.col("frame") / 8), "err": F.when(F.col("valid"), F.abs(F.col("z") - F.col("z_gt"))), "c": 1 + F.col("conf")})
    return I.rounded(E.confidence_error(px, ["frame"], ["setid"], "err", "c", 0.2))


@query("f16_trimmed_mean", """WITH e AS (SELECT frame, y, x, abs(z - z_gt) + conf AS err FROM {fx_pixels} WHERE valid),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY err, y, x) AS k, count(*) OVER (PARTITION BY frame) AS n FROM e)
SELECT frame, count(*) AS kept, round(avg(err), 6) AS trimmed_mean FROM r WHERE k <= floor(n * 80 / 100) GROUP BY frame""")
def f16(spark, d):
    px = view(spark, d, "fx_pixels").where("valid").withColumn("err", F.abs(F.col("z") - F.col("z_gt")) + F.col("conf"))
    return I.rounded(E.trimmed_mean(px, "err", ["frame"], ["y", "x"], 80))


@query("e12_fit_depth_scale", f"""WITH p AS (SELECT floor(frame / 8) AS setid, * FROM {{fx_pixels}} WHERE valid),
t AS (SELECT setid, count(*) AS total FROM p GROUP BY setid),
o AS (SELECT *, row_number() OVER (PARTITION BY setid, frame ORDER BY {uniform_sql('setid::BIGINT, frame, y, x', 5)}, y, x) AS rk, count(*) OVER (PARTITION BY setid, frame) AS nv
  FROM p JOIN t USING (setid) WHERE z > 0 AND z_gt > 0)
SELECT CAST(setid AS BIGINT) AS setid, count(*) AS num_ratios, round(median(z_gt / z), 6) AS depth_scale FROM o WHERE rk <= greatest(1, floor(600 * nv / total)) GROUP BY setid""")
def e12(spark, d):
    px = view(spark, d, "fx_pixels").withColumn("setid", F.floor(F.col("frame") / 8))
    return I.rounded(E.fit_depth_scale(px, ["setid"], ["frame"], ["y", "x"], max_total=600, seed=5))


@query("e12_fit_depth_scale_all", """SELECT CAST(floor(frame / 8) AS BIGINT) AS setid, count(*) FILTER (z > 0 AND z_gt > 0) AS num_ratios,
round(coalesce(median(z_gt / z) FILTER (z > 0 AND z_gt > 0), 1.0), 6) AS depth_scale FROM {fx_pixels} WHERE valid GROUP BY ALL""")
def e12_all(spark, d):
    px = view(spark, d, "fx_pixels").withColumn("setid", F.floor(F.col("frame") / 8))
    return I.rounded(E.fit_depth_scale(px, ["setid"], ["frame"], ["y", "x"]))
