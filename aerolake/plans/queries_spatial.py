"""Registered queries: projection, nearest-neighbour and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.operators import evaluation as E
from aerolake.operators import frusta as FR
from aerolake.operators import neighbors as N
from aerolake.operators import projection as PR
from aerolake.operators import timeline as TL
from aerolake.plans import inputs as I
from aerolake.plans.fixtures import view
from aerolake.plans.registry import query

_D = "sqrt((a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2)"


def _nn_sql(a: str, b: str) -> str:
    return f"""(SELECT a.scene, a.point_id, min({{{{'d': {_D}, 'id': b.point_id}}}}) AS m FROM {{{a}}} a JOIN {{{b}}} b ON a.scene = b.scene GROUP BY a.scene, a.point_id)""".replace("{{", "{").replace("}}", "}")


@query("c12_nn_join", f"SELECT scene, point_id, m.id AS nn_id, round(m.d, 6) AS dist FROM {_nn_sql('fx_points', 'fx_points_gt')}")
def c12(spark, d):
    return I.rounded(N.nn_join(view(spark, d, "fx_points"), view(spark, d, "fx_points_gt"), ["scene"]))


@query("c12_nn_join_vectors", f"""SELECT a.label, a.vec_id, min_by(b.vec_id, {{'d': {_D}, 'i': b.vec_id}}) AS nn_id, round(min({_D}), 6) AS dist
FROM v a JOIN v b ON a.label % 5 = b.label GROUP BY a.label, a.vec_id""".replace("FROM v a JOIN v b", "FROM {fx_vectors} a JOIN {fx_vectors} b"))
def c12_vectors(spark, d):
    v = view(spark, d, "fx_vectors").select("vec_id", "label", "x", "y", "z")
    src = v.select(F.struct("label", "vec_id").alias("src"), (F.col("label") % 5).alias("grp"), "x", "y", "z")
    out = N.nn_join(src, v.withColumnRenamed("label", "grp"), ["grp"], src_id="src", dst_id="vec_id")
    return I.rounded(out.select("src.label", "src.vec_id", "nn_id", "dist"))


@query("c13_projected_spacing", """WITH c AS (SELECT scene, x, y, count(*) AS n FROM {fx_points} GROUP BY scene, x, y),
d AS (SELECT a.scene, min(sqrt((a.x-b.x)^2 + (a.y-b.y)^2)) AS d FROM c a JOIN c b ON a.scene = b.scene AND (a.x <> b.x OR a.y <> b.y) WHERE a.n = 1 GROUP BY a.scene, a.x, a.y)
SELECT scene, count(*) AS num, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.75), 6) AS spacing FROM d GROUP BY scene""")
def c13(spark, d):
    return I.rounded(N.projected_spacing(view(spark, d, "fx_points"), ["scene"]))


@query("c13_initial_point_scale", f"""WITH d AS (SELECT a.scene, a.point_id, {_D} AS d FROM {{fx_points}} a JOIN {{fx_points}} b ON a.scene = b.scene AND a.point_id <> b.point_id),
m AS (SELECT scene, point_id, list_avg(min(d, 3)) AS m FROM d GROUP BY scene, point_id)
SELECT scene, round(greatest(quantile_disc(m, 0.5), 1e-8) * 0.5, 6) AS scale FROM m GROUP BY scene""")
def c13_scale(spark, d):
    return I.rounded(N.initial_point_scale(view(spark, d, "fx_points"), ["scene"], 0.5))


_DISTS = f"""dst AS (SELECT scene, 'acc' AS side, m.d AS d FROM {_nn_sql('fx_points', 'fx_points_gt')}
  UNION ALL SELECT scene, 'comp', m.d FROM {_nn_sql('fx_points_gt', 'fx_points')})"""
_SIDE = lambda s: ", ".join(f"round({e}, 6) AS {s}_{n}" for n, e in (
    ("mean", f"avg(d) FILTER (WHERE side = '{s}')"), ("rmse", f"sqrt(avg(d * d) FILTER (WHERE side = '{s}'))"),
    ("median", f"quantile_cont(d, 0.5) FILTER (WHERE side = '{s}')"), ("p90", f"quantile_cont(d, 0.9) FILTER (WHERE side = '{s}')"),
    ("p95", f"quantile_cont(d, 0.95) FILTER (WHERE side = '{s}')"), ("max", f"max(d) FILTER (WHERE side = '{s}')")))
_MEAN = lambda e, s: f"avg({e}) FILTER (WHERE side = '{s}')"


@query("f4_cloud_error", f"""WITH {_DISTS} SELECT scene, {_SIDE('acc')}, {_SIDE('comp')}, round({_MEAN('d', 'acc')} + {_MEAN('d', 'comp')}, 6) AS chamfer_l1,
  round(({_MEAN('d', 'acc')} + {_MEAN('d', 'comp')}) / 2, 6) AS chamfer_l1_half, round({_MEAN('d * d', 'acc')} + {_MEAN('d * d', 'comp')}, 6) AS chamfer_l2 FROM dst GROUP BY scene""")
def f4(spark, d):
    dist = N.cloud_distances(view(spark, d, "fx_points"), view(spark, d, "fx_points_gt"), ["scene"])
    return I.rounded(E.cloud_error(dist, ["scene"]))


@query("f5_cloud_fscore", f"""WITH {_DISTS}, t AS (SELECT CAST(unnest([0.5, 1, 2, 5]) AS DOUBLE) AS threshold),
p AS (SELECT scene, threshold, avg(CAST(d <= threshold AS INT)) FILTER (WHERE side = 'acc') AS p, avg(CAST(d <= threshold AS INT)) FILTER (WHERE side = 'comp') AS r FROM dst, t GROUP BY scene, threshold)
SELECT scene, threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS fscore, round(1 - p, 6) AS outlier_ratio FROM p""")
def f5(spark, d):
    dist = N.cloud_distances(view(spark, d, "fx_points"), view(spark, d, "fx_points_gt"), ["scene"])
    return I.rounded(E.cloud_fscore(dist, ["scene"], [0.5, 1.0, 2.0, 5.0]))


# --- projection ---------------------------------------------------------------------------------------------------

# world point of a pixel under its nadir camera
_PX = """px AS (SELECT p.frame, p.y, p.x, p.z, p.conf, c.cx + (p.x - 8) * p.z / 50 AS px, c.cy - (p.y - 8) * p.z / 50 AS py, c.cz - p.z AS pz
  FROM {fx_pixels} p JOIN {fx_pixcams} c USING (frame) WHERE p.z > 1e-6)"""
# nadir projection of points into the trajectory cameras of their scene
_SEEN = """seen AS (SELECT * FROM (SELECT p.scene, c.frame, p.point_id, 50 * (p.x - c.cx) / (c.cz - p.z) + 8 AS u, -50 * (p.y - c.cy) / (c.cz - p.z) + 8 AS v, c.cz - p.z AS z, p.r, p.g, p.b
  FROM {fx_points} p JOIN {fx_cams} c USING (scene)) WHERE z > 0 AND u >= 0 AND u < 16 AND v >= 0 AND v < 16)"""


@query("c1_unproject", f"WITH {_PX} SELECT frame, y, x, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM px")
def c1(spark, d):
    p = PR.unproject(view(spark, d, "fx_pixels").select("frame", "y", "x", "z"), I.pixel_cams(spark, d), ["frame"])
    return I.rounded(p.drop("z"))


@query("c2_project_join", f"WITH {_SEEN} SELECT scene, frame, point_id, round(u, 6) AS u, round(v, 6) AS v, round(z, 6) AS z FROM seen")
def c2(spark, d):
    return I.rounded(PR.project_join(view(spark, d, "fx_points"), I.scene_cams(spark, d), 16, 16))


@query("c3_zbuffer", f"""WITH {_SEEN}, k AS (SELECT *, CAST(round_even(u, 0) AS INT) AS px, CAST(round_even(v, 0) AS INT) AS py FROM seen WHERE z < 98),
n AS (SELECT *, row_number() OVER (PARTITION BY scene, frame, py, px ORDER BY z, point_id) AS k FROM k WHERE px < 16 AND py < 16)
SELECT scene, frame, py, px, round(z, 6) AS z, point_id, r, g, b FROM n WHERE k = 1""")
def c3(spark, d):
    return I.rounded(PR.zbuffer(view(spark, d, "fx_points"), I.scene_cams(spark, d), 16, 16, 98.0))


_PAIRS = "pr AS (SELECT a.frame, b.frame AS other FROM {fx_pixcams} a JOIN {fx_pixcams} b ON a.frame <> b.frame AND abs(a.frame - b.frame) <= 9 AND abs(a.cx - b.cx) <= 10 AND abs(a.cy - b.cy) <= 10)"


# three scenes with equal frame ids that hold different frames
_SCENES = "sf AS (SELECT CAST(scene AS INT) AS scene, frame FROM {fx_pixcams} CROSS JOIN range(3) r(scene) WHERE frame % (scene + 2) <> 0)"


@query("c4_multiview_confidence", f"""WITH {_PX}, {_PAIRS}, {_SCENES},
ps AS (SELECT a.scene, pr.* FROM pr JOIN sf a USING (frame) JOIN sf b ON b.scene = a.scene AND b.frame = pr.other),
q AS (SELECT ps.scene, px.frame, y, x, other, 50 * (px - c.cx) / (c.cz - pz) + 8 AS u, -50 * (py - c.cy) / (c.cz - pz) + 8 AS v, c.cz - pz AS zz FROM px JOIN ps USING (frame) JOIN {{fx_pixcams}} c ON c.frame = other),
s AS (SELECT *, CAST(least(15, round_even(u, 0)) AS INT) AS tx, CAST(least(15, round_even(v, 0)) AS INT) AS ty FROM q WHERE zz > 0.04 AND u >= 0 AND u < 16 AND v >= 0 AND v < 16),
h AS (SELECT s.scene, s.frame, s.y, s.x, abs(zz - coalesce(t.z, 0)) < 3 + 0.02::DOUBLE * zz AS hit FROM s LEFT JOIN {{fx_pixels}} t ON t.frame = s.other AND t.y = s.ty AND t.x = s.tx),
n AS (SELECT scene, frame, y, x, count(*) FILTER (WHERE hit) AS i, count(*) FILTER (WHERE NOT hit) AS o FROM h GROUP BY scene, frame, y, x), ov AS (SELECT DISTINCT scene, frame FROM ps)
SELECT sf.scene, p.frame, p.y, p.x, coalesce(i, 0) AS inliers, coalesce(o, 0) AS outliers, round(CASE WHEN ov.frame IS NULL THEN 1 ELSE coalesce(i, 0) / (coalesce(i, 0) + coalesce(o, 0) + 1e-10) END, 6) AS confidence
FROM {{fx_pixels}} p JOIN sf USING (frame) LEFT JOIN n ON n.scene = sf.scene AND n.frame = p.frame AND n.y = p.y AND n.x = p.x LEFT JOIN ov ON ov.scene = sf.scene AND ov.frame = p.frame""")
def c4(spark, d):
    scenes = lambda df: df.withColumn("scene", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("frame % (scene + 2) <> 0")
    c = scenes(view(spark, d, "fx_pixcams"))
    o = c.select("scene", F.col("frame").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    near = c.withColumn("other", F.explode(F.sequence(F.col("frame") - 9, F.col("frame") + 9))).where("other <> frame").join(o, ["scene", "other"])
    pairs = near.where("abs(cx - ox) <= 10 AND abs(cy - oy) <= 10").select("scene", "frame", "other")
    px = scenes(view(spark, d, "fx_pixels").select("frame", "y", "x", "z"))
    return I.rounded(PR.multiview_confidence(px, scenes(I.pixel_cams(spark, d)), pairs, 16, 16, abs_tol=3.0))


def _frusta(spark, d):
    cams = I.scene_cams(spark, d)
    stats = cams.select("scene", "frame", (80 + F.col("frame") % 7).cast("double").alias("near"), (95 + F.col("frame") % 5).cast("double").alias("far"))
    return FR.frustum_corners(cams, stats, ["scene", "frame"])


# nadir frusta are square in plan, so two of them meet at their lowest common height or not at all
_HW = "0.16::DOUBLE"


@query("c5_frustum_pairs", f"""WITH f AS (SELECT scene, frame, cx, cy, cz, cz - (95 + frame % 5) AS lo, cz - (80 + frame % 7) AS hi FROM {{fx_cams}}),
p AS (SELECT a.scene, a.frame AS view_a, b.frame AS view_b, abs(a.cx - b.cx) AS dx, abs(a.cy - b.cy) AS dy, greatest(a.lo, b.lo) AS h, least(a.hi, b.hi) AS top, a.cz AS za, b.cz AS zb FROM f a JOIN f b ON a.scene = b.scene AND a.frame < b.frame)
SELECT scene, view_a, view_b FROM p WHERE h <= top AND greatest(dx, dy) <= {_HW} * (za - h) + {_HW} * (zb - h)""")
def c5(spark, d):
    return FR.frustum_pairs(_frusta(spark, d))


@query("c6_points_in_frustum", f"""SELECT p.scene, c.frame, p.point_id FROM {{fx_points}} p JOIN {{fx_cams}} c USING (scene)
WHERE c.cz - p.z BETWEEN 80 + c.frame % 7 AND 95 + c.frame % 5 AND greatest(abs(p.x - c.cx), abs(p.y - c.cy)) <= {_HW} * (c.cz - p.z)""")
def c6(spark, d):
    return FR.points_in_frustum(view(spark, d, "fx_points"), _frusta(spark, d))


# points on the pixel rays and their scores: fused over the grid cameras; 25 m is the depth tolerance of this scene
_FUSE = f"""WITH {_PX}, pt AS (SELECT frame * 256 + y * 16 + x AS point_id, px + 0.11::DOUBLE AS x, py + 0.07::DOUBLE AS y, pz AS z FROM px),
vw AS (SELECT * FROM (SELECT point_id, c.frame, 50 * (p.x - c.cx) / (c.cz - p.z) + 8 AS u, -50 * (p.y - c.cy) / (c.cz - p.z) + 8 AS v, c.cz - p.z AS zz FROM pt p CROSS JOIN {{fx_pixcams}} c) WHERE zz > 0 AND u >= 0 AND u < 16 AND v >= 0 AND v < 16),
ok AS (SELECT point_id, w.frame, t.y, t.x FROM vw w JOIN {{fx_pixels}} t ON t.frame = w.frame AND t.y = round_even(v, 0) AND t.x = round_even(u, 0) WHERE abs(zz - t.z) < 1.5),
sc AS (SELECT frame, y, x, cls, logit, ln(sum(exp(logit)) OVER (PARTITION BY frame, y, x)) AS lse, row_number() OVER (PARTITION BY frame, y, x ORDER BY logit DESC, cls) AS k FROM {{fx_scores}}),
en AS (SELECT frame, y, x, 1 + sum(exp(logit - lse) * ln(exp(logit - lse) + 1e-8)) / ln(4) AS w FROM sc GROUP BY frame, y, x)"""


def _fuse_sql(weight: str) -> str:
    return f"""{_FUSE}, tl AS (SELECT point_id, cls, round(sum({weight}), 9) AS w FROM ok JOIN sc USING (frame, y, x) JOIN en USING (frame, y, x) GROUP BY point_id, cls),
wn AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY w DESC, cls) AS j FROM tl WHERE w <> -1)
SELECT CAST(0 AS INT) AS scene, CAST(pt.point_id AS INT) AS point_id, CAST(coalesce(cls, 0) AS INT) AS cls FROM pt LEFT JOIN (SELECT * FROM wn WHERE j = 1) USING (point_id)"""


def _fuse(spark, d, mode):
    px, cams = view(spark, d, "fx_pixels"), I.pixel_cams(spark, d).withColumn("scene", F.lit(0))
    p = PR.unproject(px.select("frame", "y", "x", "z"), cams, ["frame"])
    pts = p.select(F.lit(0).alias("scene"), (F.col("frame") * 256 + F.col("y") * 16 + F.col("x")).alias("point_id"),
                   (F.col("px") + 0.11).alias("x"), (F.col("py") + 0.07).alias("y"), F.col("pz").alias("z"))
    sc = view(spark, d, "fx_scores").withColumn("scene", F.lit(0))
    return PR.fuse_semantics(pts, cams, px.withColumn("scene", F.lit(0)), sc, mode, 16, 16, 4, tol=1.5)


query("c7_fuse_semantics_average", _fuse_sql("exp(logit)"))(lambda s, d: _fuse(s, d, "average"))
query("c7_fuse_semantics_voting", _fuse_sql("1").replace("ok JOIN sc USING (frame, y, x) JOIN en", "ok JOIN (SELECT * FROM sc WHERE k = 1) sc USING (frame, y, x) JOIN en"))(lambda s, d: _fuse(s, d, "voting"))
query("c7_fuse_semantics_weighted", _fuse_sql("en.w").replace("ok JOIN sc USING (frame, y, x) JOIN en", "ok JOIN (SELECT * FROM sc WHERE k = 1) sc USING (frame, y, x) JOIN en"))(lambda s, d: _fuse(s, d, "weighted"))


_OBS = f"WITH {_SEEN}"


@query("a4_export_observations", f"""{_OBS} SELECT scene, frame, point_id + 1 AS point3d_id, round(u, 6) AS u, round(v, 6) AS v, row_number() OVER (PARTITION BY scene, frame ORDER BY point_id) - 1 AS p2d_idx FROM seen""")
def a4(spark, d):
    return I.rounded(PR.export_observations(view(spark, d, "fx_points"), I.scene_cams(spark, d), 16, 16)[0])


@query("a4_export_statistics", f"""{_OBS}, t AS (SELECT scene, point_id, count(*) AS n FROM seen GROUP BY scene, point_id),
s AS (SELECT scene, count(*) AS num_points, sum(n) AS o, avg(n) AS m FROM t GROUP BY scene), c AS (SELECT scene, count(*) AS num_images FROM {{fx_cams}} GROUP BY scene)
SELECT scene, num_images, coalesce(num_points, 0) AS num_points, round(coalesce(o, 0) / num_images, 6) AS mean_observations, round(coalesce(m, 0), 6) AS mean_track_length FROM c LEFT JOIN s USING (scene)""")
def a4_stats(spark, d):
    return I.rounded(PR.export_observations(view(spark, d, "fx_points"), I.scene_cams(spark, d), 16, 16)[1])


# --- as-of ---------------------------------------------------------------------------------------------------------

_ASOF = """tl AS (SELECT scene, frame, t, cx, cy, cz FROM {fx_cams}),
p AS (SELECT q.qid, q.scene, q.t, max(f.t) AS pt, max(f.frame) AS pf FROM {fx_asof} q LEFT JOIN tl f ON f.scene = q.scene AND f.t <= q.t GROUP BY q.qid, q.scene, q.t),
n AS (SELECT q.qid, min(f.t) AS nt FROM {fx_asof} q JOIN tl f ON f.scene = q.scene AND f.t > q.t GROUP BY q.qid),
s AS (SELECT p.*, nt, CASE WHEN pt IS NULL THEN 'before_first' WHEN pt = t THEN 'exact' WHEN nt IS NULL THEN 'last' WHEN t - pt < 1e-4 THEN 'exact' WHEN nt - t < 1e-4 THEN 'exact' WHEN nt - pt > 20000 THEN 'gap' ELSE 'interpolated' END AS status,
  (t - pt) / (nt - pt) AS a FROM p LEFT JOIN n USING (qid))"""


@query("c9_asof_pose", f"""WITH {_ASOF},
g AS (SELECT s.*, CASE WHEN status = 'interpolated' THEN a ELSE 0 END AS al, x.cx AS x0, coalesce(y.cx, x.cx) AS x1, x.cz AS z0, coalesce(y.cz, x.cz) AS z1,
  0.1::DOUBLE * (x.frame % 5) AS g0, 0.1::DOUBLE * (coalesce(y.frame, x.frame) % 5) AS g1
  FROM s JOIN tl x ON x.scene = s.scene AND x.frame = s.pf LEFT JOIN tl y ON y.scene = s.scene AND y.frame = s.pf + 1)
SELECT scene, qid, status, CASE WHEN status <> 'gap' THEN round(pf + al, 6) END AS frame_pos, CASE WHEN status <> 'gap' THEN round((1-al) * x0 + al * x1, 6) END AS cx,
  CASE WHEN status <> 'gap' THEN round((1-al) * z0 + al * z1, 6) END AS cz, CASE WHEN status <> 'gap' THEN round(cos((1-al) * g0 + al * g1), 6) END AS r00,
  CASE WHEN status <> 'gap' THEN CASE WHEN round(sin((1-al) * g0 + al * g1), 6) = 0 THEN 0 ELSE round(sin((1-al) * g0 + al * g1), 6) END END AS r10 FROM g""")
def c9(spark, d):
    k = F.array(*[F.lit(v) for v in (50.0, 0.0, 8.0, 0.0, 50.0, 8.0, 0.0, 0.0, 1.0)])
    frames = I.gt_cams(spark, d).join(view(spark, d, "fx_frames").select("scene", "frame", "t"), ["scene", "frame"]).withColumn("k", k)
    r = TL.asof_pose(view(spark, d, "fx_asof"), frames, max_gap=20000.0)
    m = F.col("t_c2w")
    return I.rounded(r.select("scene", "qid", "status", "frame_pos", m[3].alias("cx"), m[11].alias("cz"), m[0].alias("r00"), m[4].alias("r10")))
