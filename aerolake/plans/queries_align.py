"""Registered queries: camera matching, similarity application and transform fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.operators import alignment as A
from aerolake.operators import matching as M
from aerolake.plans import checksql as S
from aerolake.plans import inputs as I
from aerolake.plans.fixtures import view
from aerolake.plans.registry import query

_COPIES = """
copies AS (SELECT scene, frame, stem, cx, cy, cz, 0 AS ord FROM prp
  UNION ALL SELECT scene, frame, stem, cx + 5, cy, cz, 1 AS ord FROM prp)"""


@query("c10_match_cameras", f"""WITH {S.POSES}, {_COPIES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY scene, stem ORDER BY ord) AS k FROM copies)
SELECT r.scene, r.stem, r.ord, {S.rnd('r.cx', 'px')}, {S.rnd('r.cy', 'py')}, {S.rnd('g.cx', 'gx')}, {S.rnd('g.cy', 'gy')}
FROM ranked r JOIN gtp g USING (scene, stem) WHERE k = 1""")
def c10(spark, d):
    p = I.pred_cams(spark, d).withColumn("ord", F.lit(0))
    shift = F.transform("t_c2w", lambda v, i: F.when(i == 3, v + 5).otherwise(v))
    m = M.match_cameras(p.unionByName(p.withColumns({"ord": F.lit(1), "t_c2w": shift})), I.gt_cams(spark, d))
    return I.rounded(m.select(
        "scene", "stem", "ord", F.col("pred_c2w")[3].alias("px"), F.col("pred_c2w")[7].alias("py"),
        F.col("gt_c2w")[3].alias("gx"), F.col("gt_c2w")[7].alias("gy")))


_TF = ", ".join(S.rnd(f"r{i}{j}", f"r{i}{j}") for i in range(3) for j in range(3)) + ", " + \
    ", ".join(S.rnd(f"t{i}", f"t{i}") for i in range(3))


@query("e1_fit_sim3", f"""WITH RECURSIVE {S.POSES}, {S.horn('corr', 'scene')}
SELECT scene, n, valid, {S.rnd('s', 's')}, {_TF} FROM sim""")
def e1(spark, d):
    return I.rounded(I.flat_tf(A.fit_sim3(I.corr(spark, d), ["scene"]), "scene", "n", "valid"))


@query("e1_fit_rigid", f"""WITH RECURSIVE {S.POSES}, {S.horn('corr', 'scene', with_scale=False)}
SELECT scene, n, valid, {S.rnd('s', 's')}, {_TF} FROM sim""")
def e1_rigid(spark, d):
    return I.rounded(I.flat_tf(A.fit_sim3(I.corr(spark, d), ["scene"], with_scale=False), "scene", "n", "valid"))


_YAW = """
mom AS (SELECT scene, count(*) AS n, atan2(covar_pop(sx, dy) - covar_pop(sy, dx), covar_pop(sx, dx) + covar_pop(sy, dy)) AS yaw
  FROM corr GROUP BY scene),
sh AS (SELECT scene, max(n) AS n, max(yaw) AS yaw, median(dx - (cos(yaw) * sx - sin(yaw) * sy)) AS t0,
  median(dy - (sin(yaw) * sx + cos(yaw) * sy)) AS t1, median(dz - sz) AS t2 FROM corr JOIN mom USING (scene) GROUP BY scene)"""


@query("e2_fit_yaw", f"""WITH {S.POSES}, {_YAW}
SELECT scene, n, {S.rnd('yaw', 'yaw')}, {S.rnd('t0', 't0')}, {S.rnd('t1', 't1')}, {S.rnd('t2', 't2')} FROM sh""")
def e2(spark, d):
    tf = A.fit_yaw(I.corr(spark, d), ["scene"])
    return I.rounded(tf.select("scene", "n", "yaw", *[F.col("t")[i].alias(f"t{i}") for i in range(3)]))


@query("e3_fit_translation", f"""WITH {S.POSES}
SELECT scene, count(*) AS n, {S.rnd('median(dx - sx)', 't0')}, {S.rnd('median(dy - sy)', 't1')}, {S.rnd('median(dz - sz)', 't2')}
FROM corr GROUP BY scene""")
def e3(spark, d):
    tf = A.fit_translation(I.corr(spark, d), ["scene"])
    return I.rounded(tf.select("scene", "n", *[F.col("t")[i].alias(f"t{i}") for i in range(3)]))


def uniform_sql(keys: str, seed: int | str) -> str:
    """The hashed uniform of the engine in SQL; ``keys`` is a comma-separated list."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', {keys}, '{seed}')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


_SCALE = f"""
idx AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame) - 1 AS i FROM corr),
cnt AS (SELECT scene, count(*) AS n FROM idx GROUP BY scene),
ks AS (SELECT scene, n, unnest(generate_series(0, CASE WHEN n = 2 THEN 0 ELSE least(20000, n * (n - 1) // 2) - 1 END)) AS k FROM cnt WHERE n >= 2),
prs AS (SELECT scene, CASE WHEN n = 2 THEN 0 ELSE CAST(floor({uniform_sql('scene, k', 0)} * n) AS BIGINT) END AS i,
  CASE WHEN n = 2 THEN 1 ELSE CAST(floor({uniform_sql('scene, k', 1)} * n) AS BIGINT) END AS j FROM ks),
rat AS (SELECT scene, sqrt((a.dx-b.dx)^2 + (a.dy-b.dy)^2 + (a.dz-b.dz)^2) AS dd,
  sqrt((a.sx-b.sx)^2 + (a.sy-b.sy)^2 + (a.sz-b.sz)^2) AS ds
  FROM prs p JOIN idx a USING (scene, i) JOIN idx b ON b.scene = p.scene AND b.i = p.j WHERE p.i <> p.j),
sca AS (SELECT scene, median(dd / ds) AS scale, count(*) AS num_pairs FROM rat WHERE ds > 1e-8 AND dd > 0 GROUP BY scene)"""


@query("e4_fit_scale", f"""WITH {S.POSES}, {_SCALE}
SELECT c.scene, c.n, round(coalesce(scale, 1.0), 6) AS scale, coalesce(num_pairs, 0) AS num_pairs, scale IS NOT NULL AS scale_valid
FROM cnt c LEFT JOIN sca USING (scene)""")
def e4(spark, d):
    return I.rounded(A.fit_scale(I.corr(spark, d), ["scene"], ["frame"], max_pairs=20000))


def _align(spark, d, mode):
    corr = I.corr(spark, d)
    out = A.align_chunks(corr, view(spark, d, "fx_frames"), ["scene"], mode, ["frame"], max_pairs=20000)
    keep = ("scene", "valid", "num_corr", "num_scale_pairs", "yaw", "median_residual")
    return I.rounded(I.flat_tf(out, *keep).select(*keep, "s", "r00", "r10", "t0", "t1", "t2"))


def _align_sql(mode: str) -> str:
    head = f"WITH RECURSIVE {S.POSES}"
    if mode == "sim3":
        head += f", {S.horn('corr', 'scene')}, tf AS (SELECT scene, n, 0 AS np, 0.0::DOUBLE AS yaw, s, r00, r01, r02, r10, r11, r12, r20, r21, r22, t0, t1, t2 FROM sim)"
    else:
        scale = "coalesce(scale, 1.0)" if "scale" in mode else "1.0::DOUBLE"
        yaw = "yaw" if "yaw" in mode else "0.0::DOUBLE"
        head += (f", {_SCALE}, mom AS (SELECT scene, count(*) AS n, atan2(covar_pop(sx, dy) - covar_pop(sy, dx), "
                 f"covar_pop(sx, dx) + covar_pop(sy, dy)) AS yaw FROM corr GROUP BY scene), "
                 f"sy AS (SELECT scene, n, {'coalesce(num_pairs, 0)' if 'scale' in mode else '0'} AS np, {scale} AS s, {yaw} AS yaw "
                 f"FROM mom LEFT JOIN sca USING (scene)), "
                 f"sr AS (SELECT *, cos(yaw) AS r00, -sin(yaw) AS r01, 0 AS r02, sin(yaw) AS r10, cos(yaw) AS r11, 0 AS r12, "
                 f"0 AS r20, 0 AS r21, 1 AS r22 FROM sy), ")
        if mode == "scale":
            head += "tf AS (SELECT *, 0.0::DOUBLE AS t0, 0.0::DOUBLE AS t1, 0.0::DOUBLE AS t2 FROM sr)"
        else:
            med = [f"median(d{a} - s * (r{i}0 * sx + r{i}1 * sy + r{i}2 * sz)) AS t{i}" for i, a in enumerate("xyz")]
            head += f"sh AS (SELECT scene, {', '.join(med)} FROM corr JOIN sr USING (scene) GROUP BY scene), tf AS (SELECT * FROM sr JOIN sh USING (scene))"
    res = " + ".join(f"({S.moved(i)} - d{a})^2" for i, a in enumerate("xyz"))
    cols = ", ".join(S.rnd(c, c) for c in ("yaw", "s", "r00", "r10", "t0", "t1", "t2"))
    return f"""{head}, res AS (SELECT scene, median(sqrt({res})) AS median_residual FROM corr JOIN tf USING (scene) GROUP BY scene)
SELECT scene, true AS valid, n AS num_corr, CAST(np AS BIGINT) AS num_scale_pairs, {cols}, {S.rnd('median_residual', 'median_residual')}
FROM tf JOIN res USING (scene)"""


for _mode in ("translation", "scale", "scale_translation", "yaw_translation", "scale_yaw_translation", "sim3"):
    query(f"e5_align_chunks_{_mode}", _align_sql(_mode))(lambda spark, d, mode=_mode: _align(spark, d, mode))


def _robust_sql() -> str:
    res = lambda t: "sqrt(" + " + ".join(f"({S.moved(i)} - d{a})^2" for i, a in enumerate("xyz")) + ")"
    sql = f"WITH RECURSIVE {S.POSES}, {S.horn('corr', 'scene', 'f0')}"
    for i in (1, 2):
        sql += f""", e{i} AS (SELECT corr.*, f{i-1}.n, row_number() OVER (PARTITION BY scene ORDER BY {res('')}, frame) - 1 AS k
  FROM corr JOIN (SELECT * REPLACE ((SELECT count(*) FROM corr c WHERE c.scene = f{i-1}.scene) AS n) FROM f{i-1}) f{i-1} USING (scene)),
c{i} AS (SELECT * FROM e{i} WHERE k < greatest(floor(n * 0.8::DOUBLE), CASE WHEN n >= 2000 THEN 2000 ELSE 10 END)), {S.horn(f'c{i}', 'scene', f'f{i}')}"""
    return f"{sql} SELECT scene, n, valid, {S.rnd('s', 's')}, {_TF} FROM f2"


@query("e6_fit_sim3_robust", _robust_sql())
def e6(spark, d):
    return I.rounded(I.flat_tf(A.fit_sim3_robust(I.corr(spark, d), ["scene"], ["frame"]), "scene", "n", "valid"))


_PCORR = """
pc AS (SELECT a.scene, a.point_id, a.x AS sx, a.y AS sy, a.z AS sz, b.x AS dx, b.y AS dy, b.z AS dz
  FROM {fx_points} a JOIN {fx_points_gt} b USING (scene, point_id))"""


@query("e7_balance_correspondences", f"""WITH {_PCORR},
b AS (SELECT scene, min((sx+dx)/2) AS x0, max((sx+dx)/2) - min((sx+dx)/2) AS wx, min((sy+dy)/2) AS y0, max((sy+dy)/2) - min((sy+dy)/2) AS wy FROM pc GROUP BY scene),
c AS (SELECT pc.*, CAST(least(7, greatest(0, floor(((sx+dx)/2 - x0) / wx * 8))) * 8 + least(7, greatest(0, floor(((sy+dy)/2 - y0) / wy * 8))) AS INT) AS cell
  FROM pc JOIN b USING (scene)),
k AS (SELECT *, row_number() OVER (PARTITION BY scene, cell ORDER BY {uniform_sql('scene, point_id', 7)}, point_id) AS k FROM c)
SELECT scene, cell, count(*) AS num, sum(point_id)::BIGINT AS id_sum FROM k WHERE k <= 32 GROUP BY scene, cell""")
def e7(spark, d):
    out = A.balance_correspondences(point_corr(spark, d), ["scene"], ["point_id"], grid=8, total=2048, min_cell=16, seed=7)
    return out.groupBy("scene", "cell").agg(F.count(F.lit(1)).alias("num"), F.sum("point_id").alias("id_sum"))


_CELLS = f"""WITH {_PCORR},
b AS (SELECT scene, min((sx+dx)/2) AS x0, max((sx+dx)/2) - min((sx+dx)/2) AS wx, min((sy+dy)/2) AS y0, max((sy+dy)/2) - min((sy+dy)/2) AS wy FROM pc GROUP BY scene),
c AS (SELECT pc.*, CAST(least(7, greatest(0, floor(((sx+dx)/2 - x0) / wx * 8))) * 8 + least(7, greatest(0, floor(((sy+dy)/2 - y0) / wy * 8))) AS INT) AS cell
  FROM pc JOIN b USING (scene))"""


@query("e7_balance_rows", f"""{_CELLS} SELECT scene, point_id, cell FROM (SELECT *, row_number() OVER (PARTITION BY scene, cell ORDER BY {uniform_sql('scene, point_id', 7)}, point_id) AS k FROM c) WHERE k <= 32""")
def e7_rows(spark, d):
    out = A.balance_correspondences(point_corr(spark, d), ["scene"], ["point_id"], grid=8, total=2048, min_cell=16, seed=7)
    return out.select("scene", "point_id", "cell")


@query("e7_balance_statistics", f"""{_CELLS}, n AS (SELECT scene, cell, count(*) AS n FROM c GROUP BY ALL)
SELECT scene, 'balanced' AS reason, CAST(sum(n) AS BIGINT) AS num_corr_before, CAST(sum(n) AS BIGINT) AS num_finite_corr, CAST(sum(least(n, 32)) AS BIGINT) AS num_corr_after,
  count(*) AS num_occupied_cells, CAST(32 AS INT) AS per_cell_cap, min(n) AS min_cell_count_before, max(n) AS max_cell_count_before FROM n GROUP BY scene""")
def e7_statistics(spark, d):
    return A.balance_statistics(point_corr(spark, d), ["scene"], grid=8, total=2048, min_cell=16)


def point_corr(spark, d):
    a = view(spark, d, "fx_points").select("scene", "point_id", *[F.col(c).alias("s" + c) for c in "xyz"])
    b = view(spark, d, "fx_points_gt").select("scene", "point_id", *[F.col(c).alias("d" + c) for c in "xyz"])
    return a.join(b, ["scene", "point_id"])


_MOVE = ", ".join(S.rnd(S.moved(i).replace("sx", "c.cx").replace("sy", "c.cy").replace("sz", "c.cz"), f"c{a}")
                  for i, a in enumerate("xyz"))


@query("b11_apply_sim3", f"""WITH RECURSIVE {S.POSES}, {S.horn('corr', 'scene')}
SELECT scene, frame, {_MOVE} FROM {{fx_pred}} c JOIN sim USING (scene)""")
def b11(spark, d):
    tf = A.fit_sim3(I.corr(spark, d), ["scene"])
    pts = view(spark, d, "fx_pred").select("scene", "frame", "cx", "cy", "cz")
    return I.rounded(M.apply_sim3_points(pts, tf, ["scene"], ("cx", "cy", "cz")))


@query("b11_compose_sim3", f"""WITH {S.POSES}, {_YAW}
SELECT scene, 1.0::DOUBLE AS s, {S.rnd('cos(2 * yaw)', 'r00')}, {S.rnd('sin(2 * yaw)', 'r10')},
  {S.rnd('cos(yaw) * t0 - sin(yaw) * t1 + t0', 't0')}, {S.rnd('sin(yaw) * t0 + cos(yaw) * t1 + t1', 't1')}, {S.rnd('2 * t2', 't2')}
FROM sh""")
def b11_compose(spark, d):
    tf = A.fit_yaw(I.corr(spark, d), ["scene"]).select("scene", "s", "r", "t")
    return I.rounded(I.flat_tf(M.compose_sim3(tf, tf, ["scene"]), "scene").select("scene", "s", "r00", "r10", "t0", "t1", "t2"))
