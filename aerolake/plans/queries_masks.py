"""Registered queries: filters, masks and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.operators import filters as FL
from aerolake.operators import masks as K
from aerolake.operators import transforms as T
from aerolake.plans import checksql as S
from aerolake.plans import inputs as I
from aerolake.plans.fixtures import view
from aerolake.plans.queries_align import uniform_sql
from aerolake.plans.registry import query


def _dirty_cams(spark, d):
    """Camera rows with missing, short and non-finite poses mixed in."""
    good = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i + F.col("frame")).cast("double"))
    t = (F.when(F.col("frame") % 11 == 4, None).when(F.col("frame") % 7 == 3, F.slice(good, 1, 12))
         .when(F.col("frame") % 5 == 2, F.transform(good, lambda v: F.when(v == F.col("frame"), F.lit(float("nan"))).otherwise(v)))
         .otherwise(good))
    depth = F.when(F.col("value") > 5, F.lit("d"))
    return view(spark, d, "fx_frames").select("scene", "frame", t.alias("t_c2w"), depth.alias("depth"))


_REASON = "CASE WHEN frame % 11 = 4 THEN 'missing_camera_prior' WHEN frame % 7 = 3 THEN 'invalid_T_c2w_shape' WHEN frame % 5 = 2 THEN 'non_finite_T_c2w' END"


@query("b1_filter_valid_poses_kept", f"SELECT scene, frame FROM {{fx_frames}} WHERE {_REASON} IS NULL")
def b1_kept(spark, d):
    return K.filter_valid_poses(_dirty_cams(spark, d))[0].select("scene", "frame")


@query("b1_filter_valid_poses_rejected", f"SELECT scene, frame, {_REASON} AS reason FROM {{fx_frames}} WHERE {_REASON} IS NOT NULL")
def b1_rejected(spark, d):
    return K.filter_valid_poses(_dirty_cams(spark, d))[1].select("scene", "frame", "reason")


@query("b1_pose_filter_counts", f"""WITH r AS (SELECT *, {_REASON} AS reason FROM {{fx_frames}})
SELECT scene, count(*) AS num_frames, count(*) FILTER (WHERE reason IS NULL) AS num_kept, count(*) FILTER (WHERE reason IS NULL OR reason <> 'missing_camera_prior') AS num_cam_priors,
  count(*) FILTER (WHERE value > 5) AS num_depth_priors, count(*) FILTER (WHERE reason = 'missing_camera_prior') AS missing_camera_prior,
  count(*) FILTER (WHERE reason = 'invalid_T_c2w_shape') AS invalid_shape, count(*) FILTER (WHERE reason = 'non_finite_T_c2w') AS non_finite FROM r GROUP BY scene""")
def b1_counts(spark, d):
    return K.pose_filter_counts(_dirty_cams(spark, d), ["scene"], depth="depth")


@query("b2_filter_scenes", """WITH n AS (SELECT n_name AS scene, n_nationkey AS ord FROM nation),
st AS (SELECT n_name AS scene, 'proc' || (s_suppkey % 3) AS process, s_suppkey AS pos, CASE WHEN s_acctbal > 1500 THEN 'finished' ELSE 'failed' END AS state FROM supplier JOIN nation ON n_nationkey = s_nationkey),
fst AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY pos) AS k FROM st WHERE regexp_matches(process, '^proc[12]')),
md AS (SELECT DISTINCT n_name AS scene FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 = 1),
a AS (SELECT * FROM n WHERE scene IN (SELECT scene FROM md) AND scene IN (SELECT scene FROM fst WHERE k = 1 AND state = 'finished')),
b AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS i FROM a)
SELECT scene, ord FROM b WHERE i >= 1 AND i < 20 AND (i - 1) % 2 = 0""")
def b2(spark, d):
    n, s = view(spark, d, "nation"), view(spark, d, "supplier")
    js = s.join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    md = js.select(F.col("n_name").alias("scene"), F.concat(F.lit("mod"), (F.col("s_suppkey") % 4).cast("string")).alias("modality"))
    st = js.select(F.col("n_name").alias("scene"), F.concat(F.lit("proc"), (F.col("s_suppkey") % 3).cast("string")).alias("process"),
                   F.col("s_suppkey").alias("pos"), F.when(F.col("s_acctbal") > 1500, "finished").otherwise("failed").alias("state"))
    scenes = n.select(F.col("n_name").alias("scene"), F.col("n_nationkey").alias("ord"))
    return FL.filter_scenes(scenes, ["all", "NATION_.*", {"exists": "mod1"}, {"process_state": ("proc[12].*", "finished")}, [1, 20, 2]], md, st)


@query("b3_filter_frames", """WITH f AS (SELECT scene, frame, 'f' || lpad(CAST(frame AS VARCHAR), 5, '0') AS stem, value FROM {fx_frames}),
a AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame) - 1 AS i FROM f WHERE value > 3 AND NOT value > 60 AND regexp_matches(stem, '^f000[0-7]'))
SELECT scene, stem FROM a WHERE i >= 1 AND i < 40 AND (i - 1) % 3 = 0""")
def b3(spark, d):
    f = view(spark, d, "fx_frames").withColumn("stem", F.concat(F.lit("f"), F.lpad(F.col("frame").cast("string"), 5, "0")))
    files = f.where("value > 3").select("scene", F.lit("depth").alias("modality"), "stem").unionByName(
        f.where("value > 60").select("scene", F.lit("mask").alias("modality"), "stem"))
    frames = f.select("scene", "stem", F.col("frame").alias("ord"))
    return FL.filter_frames(frames, ["exists: depth", "!exists: mask", "f000[0-7]", [1, 40, 3]], files).select("scene", "stem")


@query("b4_video_frames", """WITH s AS (SELECT c_nationkey AS scene, c_custkey AS seg, CAST(c_custkey AS DOUBLE) AS st, c_custkey + 0.25::DOUBLE * (c_nationkey % 9) AS en, 4 + c_nationkey % 3 AS fps FROM customer),
n AS (SELECT *, CAST(ceil((en - st) / (1.0::DOUBLE / fps)) AS BIGINT) AS n FROM s),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY scene ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n),
e AS (SELECT *, unnest(range(0, n)) AS i FROM b WHERE n > 0)
SELECT scene, seg, CAST(b + i AS BIGINT) AS pos, round(st + i * (1.0::DOUBLE / fps), 6) AS t FROM e""")
def b4(spark, d):
    c = view(spark, d, "customer")
    seg = c.select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("seg"), F.col("c_custkey").cast("double").alias("start"),
                   (F.col("c_custkey") + F.lit(0.25) * (F.col("c_nationkey") % 9)).alias("end"), (4 + F.col("c_nationkey") % 3).alias("fps"))
    return I.rounded(FL.video_frames(seg))


_TH = "SELECT frame, quantile_cont(conf, 0.3) AS th, count(*) AS n FROM {fx_pixels} WHERE valid GROUP BY frame"


@query("b5_confidence_filter_kept", f"""WITH t AS ({_TH}) SELECT p.frame, y, x, z, conf FROM {{fx_pixels}} p JOIN t USING (frame) WHERE valid AND conf >= th""")
def b5_kept(spark, d):
    return K.confidence_filter(view(spark, d, "fx_pixels"), ["frame"], 0.3)[0].select("frame", "y", "x", "z", "conf")


@query("b5_confidence_filter_stats", f"""WITH t AS ({_TH}) SELECT frame, round(th, 6) AS threshold, n AS num_valid, count(*) FILTER (WHERE conf < th) AS num_dropped,
  round(count(*) FILTER (WHERE conf < th) / n, 6) AS drop_fraction FROM {{fx_pixels}} p JOIN t USING (frame) WHERE valid GROUP BY frame, th, n""")
def b5_stats(spark, d):
    return I.rounded(K.confidence_filter(view(spark, d, "fx_pixels"), ["frame"], 0.3)[1])


@query("b5_confidence_filter_strict", f"""WITH t AS ({_TH}) SELECT p.frame, y, x FROM {{fx_pixels}} p JOIN t USING (frame) WHERE valid AND conf > th""")
def b5_strict(spark, d):
    return K.confidence_filter(view(spark, d, "fx_pixels"), ["frame"], 0.3, strict=True)[0].select("frame", "y", "x")


_NB = """nb AS (SELECT a.frame, a.y, a.x, a.z, max(b.z) AS hi, min(b.z) AS lo FROM {fx_pixels} a JOIN {fx_pixels} b
  ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)"""


@query("b6_depth_edge", f"""WITH {_NB} SELECT frame, y, x, coalesce(hi - lo > 19.5, false) OR coalesce((hi - lo) / z > 0.22::DOUBLE, false) AS edge FROM nb""")
def b6(spark, d):
    return K.depth_edge(view(spark, d, "fx_pixels"), ["frame"], 19.5, 0.22).select("frame", "y", "x", "edge")


@query("b7_depth_aliasing", f"""WITH {_NB} SELECT frame, y, x, coalesce(z IS NOT NULL AND least(hi - z, z - lo) > 7, false) OR coalesce(z IS NOT NULL AND least(hi - z, z - lo) / z > 0.09::DOUBLE, false) AS alias FROM nb""")
def b7(spark, d):
    return K.depth_aliasing(view(spark, d, "fx_pixels"), ["frame"], 7.0, 0.09).select("frame", "y", "x", "alias")


def _pointmap(spark, d):
    p = view(spark, d, "fx_pixels")
    z = F.col("z")
    return p.withColumns({"px": (F.col("x") - 8) * z / 50, "py": (F.col("y") - 8) * z / 50, "pz": z})


_PM = "pm AS (SELECT *, (x - 8) * z / 50 AS px, (y - 8) * z / 50 AS py, z AS pz, {ok} AS ok FROM {{fx_pixels}}{join})"


def _cross(a: str, b: str) -> str:
    """Unit cross product of two neighbour differences as a struct; NULL if one is missing."""
    v = lambda n, c: f"({n}.p{c} - c.p{c})"
    cx = f"({v(a,'y')} * {v(b,'z')} - {v(a,'z')} * {v(b,'y')})"
    cy = f"({v(a,'z')} * {v(b,'x')} - {v(a,'x')} * {v(b,'z')})"
    cz = f"({v(a,'x')} * {v(b,'y')} - {v(a,'y')} * {v(b,'x')})"
    ln = f"(sqrt({cx}^2 + {cy}^2 + {cz}^2) + 1e-12)"
    return f"{{'x': {cx} / {ln}, 'y': {cy} / {ln}, 'z': {cz} / {ln}}}"


def normals_sql(src: str) -> str:
    pairs = [("u", "l"), ("l", "d"), ("d", "r"), ("r", "u")]
    js = " ".join(f"LEFT JOIN {src} {n} ON {n}.frame = c.frame AND {n}.y = c.y + {dy} AND {n}.x = c.x + {dx} AND {n}.ok AND c.ok"
                  for n, dy, dx in (("u", -1, 0), ("d", 1, 0), ("l", 0, -1), ("r", 0, 1)))
    cols = ", ".join(f"CASE WHEN {a}.ok AND {b}.ok THEN {_cross(a, b)} END AS s{i}" for i, (a, b) in enumerate(pairs))
    tot = ", ".join(" + ".join(f"coalesce(s{i}.{c}, 0)" for i in range(4)) + f" AS t{c}" for c in "xyz")
    return f"""nc AS (SELECT c.frame, c.y, c.x, {cols} FROM {src} c {js}),
nt AS (SELECT frame, y, x, {tot}, s0 IS NOT NULL OR s1 IS NOT NULL OR s2 IS NOT NULL OR s3 IS NOT NULL AS ok FROM nc),
nn AS (SELECT frame, y, x, ok, tx / (sqrt(tx*tx+ty*ty+tz*tz) + 1e-12) AS nx, ty / (sqrt(tx*tx+ty*ty+tz*tz) + 1e-12) AS ny, tz / (sqrt(tx*tx+ty*ty+tz*tz) + 1e-12) AS nz FROM nt)"""


_EDGES = """offs AS (SELECT o.v AS dy, p.v AS dx FROM (SELECT unnest([-1, 0, 1]) AS v) o, (SELECT unnest([-1, 0, 1]) AS v) p),
ry AS (SELECT c.frame, c.y, c.x, dx, coalesce(r.y, c.y) AS ty FROM nn c CROSS JOIN offs LEFT JOIN nn r ON r.frame = c.frame AND r.y = c.y + dy AND r.x = c.x),
rx AS (SELECT ry.*, coalesce(r.x, ry.x) AS tx FROM ry LEFT JOIN nn r ON r.frame = ry.frame AND r.y = ry.ty AND r.x = ry.x + dx),
an AS (SELECT rx.frame, rx.y, rx.x, max(CASE WHEN b.ok THEN acos(greatest(-1, least(1, a.nx*b.nx + a.ny*b.ny + a.nz*b.nz))) ELSE 0 END) AS ang
  FROM rx JOIN nn a ON a.frame = rx.frame AND a.y = rx.y AND a.x = rx.x JOIN nn b ON b.frame = rx.frame AND b.y = rx.ty AND b.x = rx.tx GROUP BY ALL),
ne AS (SELECT a.frame, a.y, a.x, degrees(max(b.ang)) AS ang FROM an a JOIN an b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)"""


@query("b8_grid_normals", f"""WITH {_PM.format(ok='valid', join='')}, {normals_sql('pm')}
SELECT frame, y, x, {S.rnd('nx', 'nx')}, {S.rnd('ny', 'ny')}, {S.rnd('nz', 'nz')}, ok AS normal_ok FROM nn""".replace("{{", "{").replace("}}", "}"))
def b8(spark, d):
    return I.rounded(K.grid_normals(_pointmap(spark, d), ["frame"]).select("frame", "y", "x", "nx", "ny", "nz", "normal_ok"))


@query("b9_normal_edge", f"""WITH {_PM.format(ok='valid', join='')}, {normals_sql('pm')}, {_EDGES}
SELECT frame, y, x, ang > 120 AS nedge FROM ne""".replace("{{", "{").replace("}}", "}"))
def b9(spark, d):
    n = K.grid_normals(_pointmap(spark, d), ["frame"])
    return K.normal_edge(n, ["frame"], 120.0).select("frame", "y", "x", "nedge")


@query("b10_geometry_mask", f"""WITH qt AS (SELECT frame AS qf, quantile_cont(conf, 0.2) AS th FROM {{fx_pixels}} GROUP BY frame),
{_PM.format(ok='valid AND conf > th AND (y + x) % 13 <> 5', join=' JOIN qt ON qf = frame')}, {normals_sql('pm')}, {_EDGES},
de AS (SELECT a.frame, a.y, a.x, a.z, a.ok, coalesce((max(b.z) - min(b.z)) / a.z > 0.18::DOUBLE, false) AS edge FROM pm a LEFT JOIN pm b
  ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.ok GROUP BY a.frame, a.y, a.x, a.z, a.ok)
SELECT frame, y, x, ok AND NOT (edge AND ang > 100) AS keep, CASE WHEN ok AND NOT (edge AND ang > 100) THEN round(z, 6) ELSE 0 END AS pz FROM de JOIN ne USING (frame, y, x)""".replace("{{", "{").replace("}}", "}"))
def b10(spark, d):
    g = _pointmap(spark, d).withColumn("amb", (F.col("y") + F.col("x")) % 13 == 5)
    return I.rounded(K.geometry_mask(g, ["frame"], 0.2, 0.18, 100.0, ambiguous="amb").select("frame", "y", "x", "keep", "pz"))


@query("b12_recenter", """WITH a AS (SELECT scene, avg(cx) AS ax, avg(cy) AS ay, avg(cz) AS az FROM {fx_cams} GROUP BY scene)
SELECT scene, point_id, round(p.x - coalesce(ax, 0), 6) AS x, round(p.y - coalesce(ay, 0), 6) AS y, round(p.z - coalesce(az, 0), 6) AS z FROM {fx_points} p LEFT JOIN a USING (scene)""")
def b12(spark, d):
    anchor = T.centre_anchor(I.gt_cams(spark, d))
    return I.rounded(T.recenter(view(spark, d, "fx_points"), anchor).select("scene", "point_id", "x", "y", "z"))


@query("b12_restore", """SELECT scene, point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM {fx_points}""")
def b12_restore(spark, d):
    anchor = T.centre_anchor(I.gt_cams(spark, d))
    pts = view(spark, d, "fx_points").select("scene", "point_id", "x", "y", "z")
    return I.rounded(T.restore(T.recenter(pts, anchor), anchor))


_DRAW = lambda i: f"({uniform_sql('scene', 40 + i)} * 2 - 1)"


@query("b13_augment_world", f"""WITH a AS (SELECT scene, avg(cx) AS ax, avg(cy) AS ay, avg(cz) AS az FROM {{fx_cams}} GROUP BY scene),
w AS (SELECT *, radians({_DRAW(0)} * 5) AS wx, radians({_DRAW(1)} * 5) AS wy, radians({_DRAW(2)} * 180) AS wz, {_DRAW(3)} * 10 AS ox, {_DRAW(4)} * 10 AS oy, {_DRAW(5)} * 2 AS oz,
  0.8::DOUBLE + {uniform_sql('scene', 46)} * (1.25::DOUBLE - 0.8::DOUBLE) AS s FROM a),
m AS (SELECT scene, frame, (cx - ax + ox) * s AS x0, (cy - ay + oy) * s AS y0, (cz - az + oz) * s AS z0, wx, wy, wz FROM {{fx_cams}} JOIN w USING (scene)),
m1 AS (SELECT *, cos(wx) * y0 - sin(wx) * z0 AS y1, sin(wx) * y0 + cos(wx) * z0 AS z1 FROM m),
m2 AS (SELECT *, cos(wy) * x0 + sin(wy) * z1 AS x2, -sin(wy) * x0 + cos(wy) * z1 AS z2 FROM m1)
SELECT scene, frame, round(cos(wz) * x2 - sin(wz) * y1, 6) AS x, round(sin(wz) * x2 + cos(wz) * y1, 6) AS y, round(z2, 6) AS z FROM m2""")
def b13(spark, d):
    cams = I.gt_cams(spark, d)
    params = T.world_params(cams, ["scene"], 40, (5, 5, 180), (10, 10, 2), (0.8, 1.25))
    anchor = T.augment_anchor(cams, None, ["scene"], "mean_camera", ["frame"])
    pts = view(spark, d, "fx_cams").select("scene", "frame", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return I.rounded(T.augment_points(pts, params, anchor, ["scene"]))


def _world(anchor: str) -> str:
    """CTEs of the augmentation about an anchor a(scene, ax, ay, az): w with the draws, and points m2 of q(scene, id, x, y, z)."""
    return f"""a AS ({anchor}),
w AS (SELECT *, radians({_DRAW(0)} * 5) AS wx, radians({_DRAW(1)} * 5) AS wy, radians({_DRAW(2)} * 180) AS wz, {_DRAW(3)} * 10 AS ox, {_DRAW(4)} * 10 AS oy, {_DRAW(5)} * 2 AS oz,
  0.8::DOUBLE + {uniform_sql('scene', 46)} * (1.25::DOUBLE - 0.8::DOUBLE) AS s FROM a),
m AS (SELECT q.*, (x - ax + ox) * s AS x0, (y - ay + oy) * s AS y0, (z - az + oz) * s AS z0, wx, wy, wz FROM q JOIN w USING (scene)),
m1 AS (SELECT *, cos(wx) * y0 - sin(wx) * z0 AS y1, sin(wx) * y0 + cos(wx) * z0 AS z1 FROM m),
m2 AS (SELECT *, cos(wy) * x0 + sin(wy) * z1 AS x2, -sin(wy) * x0 + cos(wy) * z1 AS z2 FROM m1)"""


_MOVED = "round(cos(wz) * x2 - sin(wz) * y1, 6) AS x, round(sin(wz) * x2 + cos(wz) * y1, 6) AS y, round(z2, 6) AS z"
_FIRST_CAM = "SELECT scene, arg_min(cx, frame) AS ax, arg_min(cy, frame) AS ay, arg_min(cz, frame) AS az FROM {fx_cams} GROUP BY scene"


@query("b13_augment_points_scene_points", f"""WITH q AS (SELECT * FROM {{fx_points}}), c AS ({_FIRST_CAM}), p AS (SELECT scene, avg(x) AS px, avg(y) AS py, avg(z) AS pz FROM q WHERE r < 100 GROUP BY scene),
{_world("SELECT scene, coalesce(px, ax) AS ax, coalesce(py, ay) AS ay, coalesce(pz, az) AS az FROM c LEFT JOIN p USING (scene)")} SELECT scene, point_id, {_MOVED} FROM m2""")
def b13_scene_points(spark, d):
    cams, pts = I.gt_cams(spark, d), view(spark, d, "fx_points")
    params = T.world_params(cams, ["scene"], 40, (5, 5, 180), (10, 10, 2), (0.8, 1.25))
    anchor = T.augment_anchor(cams, pts.where("r < 100"), ["scene"], "scene_points", ["frame"])
    return I.rounded(T.augment_points(pts.select("scene", "point_id", "x", "y", "z"), params, anchor, ["scene"]))


# camera rotation about z by an angle, times diag(1, -1, -1); columns 0 and 2 after the turn about x, y, z
@query("b13_augment_poses", f"""WITH q AS (SELECT scene, frame, cx AS x, cy AS y, cz AS z, cos(0.1::DOUBLE * (frame % 5)) AS ca, sin(0.1::DOUBLE * (frame % 5)) AS sa FROM {{fx_cams}}),
{_world(_FIRST_CAM)},
r AS (SELECT *, cos(wx) * sa AS b1, sin(wx) * sa AS b2, sin(wx) AS c1, -cos(wx) AS c2 FROM m2),
r2 AS (SELECT *, cos(wy) * ca + sin(wy) * b2 AS d0, -sin(wy) * ca + cos(wy) * b2 AS d2, sin(wy) * c2 AS e0, cos(wy) * c2 AS e2 FROM r)
SELECT scene, frame, {_MOVED}, round(cos(wz) * d0 - sin(wz) * b1, 6) AS r00, round(sin(wz) * d0 + cos(wz) * b1, 6) AS r10, round(d2, 6) AS r20, round(cos(wz) * e0 - sin(wz) * c1, 6) AS r02, round(sin(wz) * e0 + cos(wz) * c1, 6) AS r12, round(e2, 6) AS r22 FROM r2""")
def b13_poses(spark, d):
    cams = I.gt_cams(spark, d)
    params = T.world_params(cams, ["scene"], 40, (5, 5, 180), (10, 10, 2), (0.8, 1.25))
    out = T.augment_poses(cams, params, T.augment_anchor(cams, None, ["scene"], "first_camera", ["frame"]), ["scene"])
    t = lambda i: F.col("t_c2w")[i]
    return I.rounded(out.select("scene", "frame", t(3).alias("x"), t(7).alias("y"), t(11).alias("z"), t(0).alias("r00"), t(4).alias("r10"), t(8).alias("r20"),
                                t(2).alias("r02"), t(6).alias("r12"), t(10).alias("r22")))


def _gauss(i: int) -> str:
    s = 9 + 10 * i
    return f"(sqrt(-2 * ln(1 - {uniform_sql('scene, frame', 2 * s + 1)})) * cos(2 * pi() * {uniform_sql('scene, frame', 2 * s + 2)}))"


@query("b14_perturb_poses", f"""WITH g AS (SELECT scene, frame, cx, cy, cz, {_gauss(1)} * 2 AS gx, {_gauss(2)} * 2 AS gy,
  greatest(-1.5, least(1.5, {_gauss(3)})) AS nz, greatest(-4, least(4, {_gauss(4)} * 3)) AS yaw FROM {{fx_cams}}),
f AS (SELECT *, CASE WHEN sqrt(gx*gx+gy*gy) > 3 THEN 3 / sqrt(gx*gx+gy*gy) ELSE 1 END AS f FROM g)
SELECT scene, frame, round(gx * f, 6) AS nx, round(gy * f, 6) AS ny, round(nz, 6) AS nz, round(yaw, 6) AS yaw_deg,
  round(cos(radians(yaw)) * cx - sin(radians(yaw)) * cy + gx * f, 6) AS cx, round(sin(radians(yaw)) * cx + cos(radians(yaw)) * cy + gy * f, 6) AS cy, round(cz + nz, 6) AS cz FROM f""")
def b14(spark, d):
    p = T.perturb_poses(I.gt_cams(spark, d), ["scene", "frame"], 9, 2.0, 1.0, 3.0, 3.0, 1.5, 4.0)
    c = L.trans_of("noisy_c2w")
    return I.rounded(p.select("scene", "frame", "nx", "ny", "nz", "yaw_deg", *[v.alias("c" + a) for a, v in zip("xyz", c)]))


def _norm_sql(size: str, warp: str) -> str:
    return f"""WITH p AS (SELECT floor(frame / 8) AS setid, frame, y, x, (x - 8) * z / 50 AS px, (y - 8) * z / 50 AS py, z AS pz, valid FROM {{fx_pixels}}),
q AS (SELECT *, sqrt(px*px + py*py + pz*pz) AS dis FROM p),
f AS (SELECT setid, greatest(1e-8, sum({size}) FILTER (WHERE valid) / (count(*) FILTER (WHERE valid) + 1e-8)) AS norm_factor FROM q GROUP BY setid)
SELECT CAST(setid AS BIGINT) AS setid, frame, y, x, {S.rnd(f'px * {warp} / norm_factor', 'px')}, {S.rnd(f'pz * {warp} / norm_factor', 'pz')}, round(norm_factor, 6) AS norm_factor FROM q JOIN f USING (setid)"""


def _norm(spark, d, mode):
    p = _pointmap(spark, d).withColumn("setid", F.floor(F.col("frame") / 8))
    out = T.normalize_set(p, ["setid"], mode, ("px", "py", "pz"))
    return I.rounded(out.select("setid", "frame", "y", "x", "px", "pz", "norm_factor"))


query("b15_normalize_set_avg_dis", _norm_sql("dis", "1"))(lambda s, d: _norm(s, d, "avg_dis"))
query("b15_normalize_set_avg_log1p", _norm_sql("ln(1 + dis)", "1"))(lambda s, d: _norm(s, d, "avg_log1p"))
query("b15_normalize_set_warp", _norm_sql("ln(1 + dis)", "ln(1 + dis) / greatest(dis, 1e-8)"))(lambda s, d: _norm(s, d, "avg_warp-log1p"))


@query("b15_normalize_depth", """WITH f AS (SELECT frame, greatest(1e-8, sum(z) FILTER (WHERE z > 0) / (count(*) FILTER (WHERE z > 0) + 1e-8)) AS norm_factor FROM {fx_pixels} GROUP BY frame)
SELECT frame, y, x, round(z / norm_factor, 6) AS z, round(norm_factor, 6) AS norm_factor FROM {fx_pixels} JOIN f USING (frame)""")
def b15_depth(spark, d):
    return I.rounded(T.normalize_lengths(view(spark, d, "fx_pixels").select("frame", "y", "x", "z"), ["frame"], ["z"]))


@query("b15_normalize_translations", """WITH f AS (SELECT scene, greatest(1e-8, sum(sqrt(cx*cx+cy*cy+cz*cz)) / (count(*) FILTER (WHERE cx*cx+cy*cy+cz*cz > 0) + 1e-8)) AS norm_factor FROM {fx_cams} GROUP BY scene)
SELECT scene, frame, round(cx / norm_factor, 6) AS cx, round(cy / norm_factor, 6) AS cy, round(cz / norm_factor, 6) AS cz, round(norm_factor, 6) AS norm_factor FROM {fx_cams} JOIN f USING (scene)""")
def b15_trans(spark, d):
    c = view(spark, d, "fx_cams").select("scene", "frame", "cx", "cy", "cz")
    return I.rounded(T.normalize_lengths(c, ["scene"], ["cx", "cy", "cz"], clip_negative=False))


@query("b16_normalize_scene", """WITH u AS (SELECT scene, x, y, z FROM {fx_points} UNION ALL SELECT scene, cx, cy, cz FROM {fx_cams}),
m AS (SELECT scene, median(x) AS mx, median(y) AS my, median(z) AS mz FROM u GROUP BY scene)
SELECT scene, round(mx, 6) AS mx, round(my, 6) AS my, round(mz, 6) AS mz, round(greatest(1e-6, quantile_cont(sqrt((x-mx)^2 + (y-my)^2 + (z-mz)^2), 0.95)), 6) AS scale FROM u JOIN m USING (scene) GROUP BY scene, mx, my, mz""")
def b16(spark, d):
    return I.rounded(T.normalize_scene(view(spark, d, "fx_points"), I.gt_cams(spark, d)))


@query("b17_residual_filter", """WITH r AS (SELECT *, abs(z - z_gt) + 0 AS r FROM {fx_pixels} WHERE valid AND abs(z - z_gt) <= 0.75),
t AS (SELECT frame, quantile_cont(r, 0.9) AS th, count(*) AS n FROM r GROUP BY frame) SELECT r.frame, y, x, z FROM r JOIN t USING (frame) WHERE n < 50 OR r <= th""")
def b17(spark, d):
    return K.residual_filter(view(spark, d, "fx_pixels"), ["frame"], 0.75, 90.0, 50).select("frame", "y", "x", "z")


@query("b18_audit_views", """WITH s AS (SELECT frame, count(*) AS num, count(*) FILTER (WHERE valid) AS ok FROM {fx_pixels} GROUP BY frame),
v AS (SELECT frame, num, ok, frame % 11 = 4 AS nopose, frame % 5 = 2 AS scaled, frame % 7 = 3 AS nok FROM s)
SELECT frame, 'non_finite_pose' AS check, 1.0::DOUBLE AS value FROM v WHERE nopose
UNION ALL SELECT frame, 'rotation_determinant', 8.0 FROM v WHERE NOT nopose AND scaled
UNION ALL SELECT frame, 'missing_intrinsics', 1.0 FROM v WHERE nok
UNION ALL SELECT frame, 'shape_mismatch', num FROM v WHERE num <> 256
UNION ALL SELECT frame, 'valid_ratio', round(ok / 256, 6) FROM v WHERE ok / 256 < 0.94::DOUBLE""")
def b18(spark, d):
    c = I.pixel_cams(spark, d)
    bad = F.when(F.col("frame") % 11 == 4, None).when(
        F.col("frame") % 5 == 2, F.transform("t_c2w", lambda v, i: F.when(i % 4 == 3, v).otherwise(v * 2))).otherwise(F.col("t_c2w"))
    c = c.select("frame", F.when(F.col("frame") % 7 != 3, F.col("k")).alias("k"), bad.alias("t_c2w"), F.lit(16).alias("width"), F.lit(16).alias("height"))
    return I.rounded(K.audit_views(c, view(spark, d, "fx_pixels"), ["frame"], min_ratio=0.94))
