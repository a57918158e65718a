"""Registered queries: chunk alignment, seam error, ICP and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.operators import hierarchy as H
from aerolake.operators import projection as PR
from aerolake.operators import raster as R
from aerolake.plans import checksql as S
from aerolake.plans import inputs as I
from aerolake.plans.fixtures import view
from aerolake.plans.queries_align import uniform_sql
from aerolake.plans.queries_sampling import MEMBERS_SQL, members
from aerolake.plans.queries_spatial import _D, _PX
from aerolake.plans.registry import query
from aerolake.session import materialize

# every chunk saw the world turned by -0.05 c about z after a shift by -(c, -2 c, c / 2)
_CP = f"""{MEMBERS_SQL}, {_PX},
cp AS (SELECT m.scene, m.chunk_id, m.frame, role, y, x, cos(0.05 * chunk_id) * (px - chunk_id) + sin(0.05 * chunk_id) * (py + 2 * chunk_id) AS px, -sin(0.05 * chunk_id) * (px - chunk_id) + cos(0.05 * chunk_id) * (py + 2 * chunk_id) AS py, pz - chunk_id / 2 AS pz
  FROM mem m JOIN px USING (frame))"""


def chunk_pixels(spark, d):
    px = view(spark, d, "fx_pixels").select("frame", "y", "x", "z", "valid")
    p = PR.unproject(px, I.pixel_cams(spark, d), ["frame"]).join(members(spark, d), "frame")
    c = F.col("chunk_id")
    a, u, v = F.lit(0.05) * c, F.col("px") - c, F.col("py") + 2 * c
    return p.select("scene", "chunk_id", "frame", "role", "y", "x", "valid", (F.cos(a) * u + F.sin(a) * v).alias("px"),
                    (-F.sin(a) * u + F.cos(a) * v).alias("py"), (F.col("pz") - c / 2).alias("pz"))


def chunk_keys(spark, d):
    """Chunks with the binary digits of their id as tree key, as many as the largest id has."""
    c = materialize(members(spark, d).select("scene", "chunk_id").distinct(), "chunk-ids")
    digits = max(1, (c.agg(F.max("chunk_id")).first()[0] or 0).bit_length())
    return c.withColumn("key", F.array(*[(F.shiftright("chunk_id", digits - 1 - i) % 2).cast("int") for i in range(digits)]))


@query("c11_shared_correspondences", f"""WITH {_CP},
j AS (SELECT a.scene, b.chunk_id AS gid, a.frame, a.y, a.x, b.px AS sx, b.py AS sy, b.pz AS sz, a.px AS dx, a.py AS dy, a.pz AS dz FROM cp a JOIN cp b ON b.chunk_id = a.chunk_id + 1 AND a.frame = b.frame AND a.y = b.y AND a.x = b.x),
k AS (SELECT *, row_number() OVER (PARTITION BY gid, frame ORDER BY {uniform_sql('scene, gid, frame, y, x', 4)}, y, x) AS k FROM j),
n AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY {uniform_sql('scene, gid, frame, y, x', 5)}, frame, y, x) AS n FROM k WHERE k <= 200)
SELECT scene, gid, frame, y, x, {S.rnd('sx', 'sx')}, {S.rnd('sy', 'sy')}, {S.rnd('sz', 'sz')}, {S.rnd('dx', 'dx')}, {S.rnd('dy', 'dy')}, {S.rnd('dz', 'dz')} FROM n WHERE n <= 300""")
def c11(spark, d):
    pts = chunk_pixels(spark, d)
    ch = members(spark, d).select("scene", "chunk_id").distinct()
    src = H.pick_predictions(members(spark, d), ch.withColumn("gid", F.col("chunk_id")), ["scene", "gid"])
    dst = H.pick_predictions(members(spark, d), ch.withColumn("gid", F.col("chunk_id") + 1), ["scene", "gid"])
    return I.rounded(H.shared_correspondences(pts, H.identity_transforms(ch), src, dst, ["scene", "gid"], H.grid_shapes(pts), 200, 300, 4))


# all chunks end in the frame of chunk 0, which is the world: the known turn and shift of each chunk are undone
_UNDO = f"""WITH {MEMBERS_SQL}, c AS (SELECT DISTINCT scene, chunk_id FROM mem)
SELECT scene, chunk_id, 1.0::DOUBLE AS s, {S.rnd('cos(0.05 * chunk_id)', 'r00', 5)}, {S.rnd('sin(0.05 * chunk_id)', 'r10', 5)}, {S.rnd('chunk_id', 't0', 5)}, {S.rnd('-2 * chunk_id', 't1', 5)}, {S.rnd('chunk_id / 2', 't2', 5)} FROM c"""


def _flat(tf):
    return I.rounded(I.flat_tf(tf, "scene", "chunk_id").select("scene", "chunk_id", "s", "r00", "r10", "t0", "t1", "t2"), 5)


@query("e8_align_hierarchy", _UNDO)
def e8(spark, d):
    pts = materialize(chunk_pixels(spark, d), "chunk-pixels")
    return _flat(H.align_hierarchy(chunk_keys(spark, d), members(spark, d), pts, min_corr=128)[0])


@query("e9_align_parent_graph", _UNDO)
def e9(spark, d):
    pts = materialize(chunk_pixels(spark, d), "chunk-pixels")
    ch = members(spark, d).select("scene", "chunk_id").distinct()
    ch = ch.withColumns({"parent_id": F.when(F.col("chunk_id") > 0, F.col("chunk_id") - 1), "level": F.col("chunk_id").cast("int")})
    return _flat(H.align_parent_graph(ch, members(spark, d), pts, min_corr=128)[0])


# two scenes with the same chunk ids; in the second one every chunk is turned and shifted the other way
_UNDO_SCENES = f"""WITH {MEMBERS_SQL}, c AS (SELECT DISTINCT g.scene, chunk_id, 1 - 2 * g.scene AS g FROM mem, (SELECT unnest([0, 1]::BIGINT[]) AS scene) g)
SELECT scene, chunk_id, 1.0::DOUBLE AS s, {S.rnd('cos(0.05 * chunk_id)', 'r00', 5)}, {S.rnd('g * sin(0.05 * chunk_id)', 'r10', 5)}, {S.rnd('g * chunk_id', 't0', 5)}, {S.rnd('g * -2 * chunk_id', 't1', 5)}, {S.rnd('g * chunk_id / 2', 't2', 5)} FROM c"""


def scene_members(spark, d):
    return members(spark, d).withColumn("scene", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))


def scene_pixels(spark, d):
    px = view(spark, d, "fx_pixels").select("frame", "y", "x", "z", "valid")
    p = PR.unproject(px, I.pixel_cams(spark, d), ["frame"]).join(scene_members(spark, d), "frame")
    c = F.col("chunk_id") * (1 - 2 * F.col("scene"))
    a, u, v = F.lit(0.05) * c, F.col("px") - c, F.col("py") + 2 * c
    p = p.select("scene", "chunk_id", "frame", "role", "y", "x", "valid", (F.cos(a) * u + F.sin(a) * v).alias("px"),
                 (-F.sin(a) * u + F.cos(a) * v).alias("py"), (F.col("pz") - c / 2).alias("pz"))
    return materialize(p, "chunk-pixels")


@query("e8_align_hierarchy_scenes", _UNDO_SCENES)
def e8_scenes(spark, d):
    keys = chunk_keys(spark, d).withColumn("scene", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return _flat(H.align_hierarchy(keys, scene_members(spark, d), scene_pixels(spark, d), min_corr=128)[0])


@query("e9_align_parent_graph_scenes", _UNDO_SCENES)
def e9_scenes(spark, d):
    ch = scene_members(spark, d).select("scene", "chunk_id").distinct()
    ch = ch.withColumns({"parent_id": F.when(F.col("chunk_id") > 0, F.col("chunk_id") - 1), "level": F.col("chunk_id").cast("int")})
    return _flat(H.align_parent_graph(ch, scene_members(spark, d), scene_pixels(spark, d), min_corr=128)[0])


def _chunk_cams(spark, d):
    """Predicted cameras in chunk coordinates: twice too large, turned by 30 degrees in every scene."""
    p = I.pred_cams(spark, d).drop("ord")
    return p.withColumn("chunk_id", F.floor(F.col("frame") / 20))


@query("e10_align_global", f"""WITH RECURSIVE {S.POSES}, ch AS (SELECT DISTINCT scene, CAST(floor(frame / 20) AS BIGINT) AS chunk_id FROM {{fx_frames}}),
mv AS (SELECT scene, frame, sx + floor(frame / 20) AS sx, sy, sz, dx, dy, dz FROM corr), {S.horn('mv', 'scene')}
SELECT scene, chunk_id, round(s, 6) AS s, {S.rnd('r00', 'r00')}, {S.rnd('r10', 'r10')}, {S.rnd('t0 + s * r00 * chunk_id', 't0')}, {S.rnd('t1 + s * r10 * chunk_id', 't1')}, {S.rnd('t2 + s * r20 * chunk_id', 't2')} FROM ch JOIN sim USING (scene)""")
def e10(spark, d):
    cams = _chunk_cams(spark, d)
    tf = cams.select("scene", "chunk_id").distinct().select(
        "scene", "chunk_id", F.lit(1.0).alias("s"), H.eye().alias("r"), F.array(F.col("chunk_id").cast("double"), F.lit(0.0), F.lit(0.0)).alias("t"))
    out, _ = H.align_global(materialize(tf, "tf"), cams, I.gt_cams(spark, d), "sim3")
    return I.rounded(I.flat_tf(out, "scene", "chunk_id").select("scene", "chunk_id", "s", "r00", "r10", "t0", "t1", "t2"))


def _icp_sql(rounds: int) -> str:
    sql = "WITH RECURSIVE p0 AS (SELECT scene, point_id, x, y, z FROM {fx_points}), g AS (SELECT * FROM {fx_points_gt})"
    for i in range(rounds):
        mv = ", ".join(f"{S.moved(j).replace('sx', 'p.x').replace('sy', 'p.y').replace('sz', 'p.z')} AS {a}" for j, a in enumerate("xyz"))
        sql += f""", n{i} AS MATERIALIZED (SELECT a.scene, a.point_id, any_value(a.x) AS sx, any_value(a.y) AS sy, any_value(a.z) AS sz, min({_D}) AS d, arg_min(b.x, {{{{'d': {_D}, 'i': b.point_id}}}}) AS dx, arg_min(b.y, {{{{'d': {_D}, 'i': b.point_id}}}}) AS dy, arg_min(b.z, {{{{'d': {_D}, 'i': b.point_id}}}}) AS dz
  FROM p{i} a JOIN g b USING (scene) GROUP BY a.scene, a.point_id),
k{i} AS (SELECT * FROM n{i} QUALIFY d <= quantile_cont(d, 0.7) OVER (PARTITION BY scene)), {S.horn(f'k{i}', 'scene', f's{i}')},
p{i + 1} AS MATERIALIZED (SELECT p.scene, p.point_id, {mv} FROM p{i} p JOIN s{i} USING (scene))""".replace("{{", "{").replace("}}", "}")
    last = rounds - 1
    return f"""{sql} SELECT scene, round(avg(p.x), 4) AS x, round(avg(p.y), 4) AS y, round(avg(p.z), 4) AS z, any_value(s.n) AS num_corr, round(any_value(m.med), 5) AS last_median
FROM p{rounds} p JOIN s{last} s USING (scene) JOIN (SELECT scene, median(d) AS med FROM k{last} GROUP BY scene) m USING (scene) GROUP BY scene"""


@query("e11_icp", _icp_sql(2))
def e11(spark, d):
    from aerolake.operators.matching import apply_sim3_points

    p = view(spark, d, "fx_points")
    tf = H.icp(p, view(spark, d, "fx_points_gt"), iterations=2)
    moved = apply_sim3_points(p.select("scene", "x", "y", "z"), tf, ["scene"]).groupBy("scene").agg(*[F.round(F.avg(a), 4).alias(a) for a in "xyz"])
    return moved.join(tf.select("scene", "num_corr", F.round("last_median", 5).alias("last_median")), "scene")


def _rigid_sql(rounds: int, gate: float) -> str:
    sql = "WITH RECURSIVE p0 AS (SELECT scene, point_id, x, y, z FROM {fx_points}), g AS (SELECT * FROM {fx_points_gt})"
    for i in range(rounds):
        mv = ", ".join(f"{S.moved(j).replace('sx', 'p.x').replace('sy', 'p.y').replace('sz', 'p.z')} AS {a}" for j, a in enumerate("xyz"))
        sql += f""", n{i} AS MATERIALIZED (SELECT a.scene, a.point_id, any_value(a.x) AS sx, any_value(a.y) AS sy, any_value(a.z) AS sz, min({_D}) AS d, arg_min(b.x, {{{{'d': {_D}, 'i': b.point_id}}}}) AS dx, arg_min(b.y, {{{{'d': {_D}, 'i': b.point_id}}}}) AS dy, arg_min(b.z, {{{{'d': {_D}, 'i': b.point_id}}}}) AS dz
  FROM p{i} a JOIN g b USING (scene) GROUP BY a.scene, a.point_id),
k{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY d, point_id) AS k, count(*) OVER (PARTITION BY scene) AS m FROM n{i} WHERE d < {gate}::DOUBLE) WHERE m >= 50 AND k <= greatest(floor(m * 0.8::DOUBLE), 50)), {S.horn(f'k{i}', 'scene', f's{i}', with_scale=False)},
p{i + 1} AS MATERIALIZED (SELECT p.scene, p.point_id, {mv} FROM p{i} p JOIN s{i} USING (scene))""".replace("{{", "{").replace("}}", "}")
    last = rounds - 1
    return f"""{sql} SELECT scene, round(avg(p.x), 4) AS x, round(avg(p.y), 4) AS y, round(avg(p.z), 4) AS z, any_value(s.n) AS num_corr, round(any_value(m.med), 5) AS last_median
FROM p{rounds} p JOIN s{last} s USING (scene) JOIN (SELECT scene, median(d) AS med FROM k{last} GROUP BY scene) m USING (scene) GROUP BY scene"""


@query("e11_icp_rigid", _rigid_sql(2, 2.5))
def e11_rigid(spark, d):
    from aerolake.operators.matching import apply_sim3_points

    p = view(spark, d, "fx_points")
    tf = H.icp_rigid(p, view(spark, d, "fx_points_gt"), iterations=2, gate=2.5)
    moved = apply_sim3_points(p.select("scene", "x", "y", "z"), tf, ["scene"]).groupBy("scene").agg(*[F.round(F.avg(a), 4).alias(a) for a in "xyz"])
    return moved.join(tf.select("scene", "num_corr", F.round("last_median", 5).alias("last_median")), "scene")


_DIR = lambda a, b, t: f"""n{t} AS (SELECT e.scene, e.chunk_a, e.chunk_b, a.frame AS f, a.y, a.x, min({{{{'d': sqrt((a.px-b.px)^2 + (a.py-b.py)^2 + (a.pz-b.pz)^2), 'f': b.frame, 'y': b.y, 'x': b.x, 'z': abs(a.pz - b.pz)}}}}) AS m
  FROM sh e JOIN cp a ON a.chunk_id = e.{a} AND a.frame = e.frame JOIN sh e2 ON e2.chunk_a = e.chunk_a AND e2.chunk_b = e.chunk_b JOIN cp b ON b.chunk_id = e2.{b} AND b.frame = e2.frame GROUP BY ALL),
q{t} AS (SELECT scene, chunk_a, chunk_b, count(*) AS num_{t}, median(m.d) AS nn_{t}, median(m.z) AS z_{t} FROM n{t} GROUP BY scene, chunk_a, chunk_b)""".replace("{{", "{").replace("}}", "}")


@query("f10_seam_error", f"""WITH {_CP}, e AS (SELECT DISTINCT a.scene, a.chunk_id AS chunk_a, a.chunk_id + 1 AS chunk_b FROM mem a JOIN mem b ON b.chunk_id = a.chunk_id + 1),
sh AS (SELECT e.*, a.frame FROM e JOIN mem a ON a.chunk_id = chunk_a JOIN mem b ON b.chunk_id = chunk_b AND a.frame = b.frame),
{_DIR('chunk_a', 'chunk_b', 'a')}, {_DIR('chunk_b', 'chunk_a', 'b')}, v AS (SELECT scene, chunk_a, chunk_b, count(*) AS num_shared_views FROM sh GROUP BY ALL)
SELECT *, round((nn_a + nn_b) / 2, 6) AS seam_error, round((z_a + z_b) / 2, 6) AS seam_error_z FROM v JOIN (SELECT * REPLACE (nn_a AS nn_a) FROM qa) USING (scene, chunk_a, chunk_b) JOIN qb USING (scene, chunk_a, chunk_b)""".replace(
    "SELECT *, round((nn_a", "SELECT scene, chunk_a, chunk_b, num_shared_views, num_a, num_b, round(nn_a, 6) AS nn_a, round(nn_b, 6) AS nn_b, round((nn_a"))
def f10(spark, d):
    return I.rounded(_seams(spark, d))


def _seams(spark, d):
    m = members(spark, d)
    ch = m.select("scene", "chunk_id").distinct()
    nxt = ch.select("scene", (F.col("chunk_id") - 1).alias("chunk_id"), F.col("chunk_id").alias("chunk_b"))
    edges = ch.join(nxt, ["scene", "chunk_id"]).withColumnRenamed("chunk_id", "chunk_a")
    return H.seam_error(m, chunk_pixels(spark, d), edges, H.identity_transforms(ch))


@query("f10_seam_summary", f"""WITH {_CP}, e AS (SELECT DISTINCT a.scene, a.chunk_id AS chunk_a, a.chunk_id + 1 AS chunk_b FROM mem a JOIN mem b ON b.chunk_id = a.chunk_id + 1),
sh AS (SELECT e.*, a.frame FROM e JOIN mem a ON a.chunk_id = chunk_a JOIN mem b ON b.chunk_id = chunk_b AND a.frame = b.frame),
{_DIR('chunk_a', 'chunk_b', 'a')}, {_DIR('chunk_b', 'chunk_a', 'b')}
SELECT e.scene, count(*) AS num_edges, count(nn_a + nn_b) AS num_valid_edges, round(avg((nn_a + nn_b) / 2), 6) AS seam_error, round(avg((z_a + z_b) / 2), 6) AS seam_error_z
FROM e LEFT JOIN qa USING (scene, chunk_a, chunk_b) LEFT JOIN qb USING (scene, chunk_a, chunk_b) GROUP BY e.scene""")
def f10_summary(spark, d):
    return I.rounded(H.seam_summary(_seams(spark, d)))


# --- rasters -------------------------------------------------------------------------------------------------------

_GSD = """gsd AS (SELECT scene, count(*) AS num_points, greatest(0, (quantile_cont(x, 0.99) - quantile_cont(x, 0.01)) * (quantile_cont(y, 0.99) - quantile_cont(y, 0.01))) AS area FROM {fx_points} GROUP BY scene)"""
_BND = """b0 AS (SELECT scene, 4.0::DOUBLE AS gsd, quantile_cont(x, 0.01) - 16 AS u_min, quantile_cont(x, 0.99) + 16 AS u_max, quantile_cont(y, 0.01) - 16 AS v_min, quantile_cont(y, 0.99) + 16 AS v_max FROM {fx_points} GROUP BY scene),
bnd AS (SELECT *, CAST(ceil((u_max - u_min) / gsd) AS INT) AS width, CAST(ceil((v_max - v_min) / gsd) AS INT) AS height FROM b0)"""


def _bounds(spark, d):
    p = view(spark, d, "fx_points")
    return materialize(R.raster_bounds(p, p.select("scene").distinct().withColumn("gsd", F.lit(4.0))), "bounds")


@query("h1_gsd_from_points", f"WITH {_GSD} SELECT scene, num_points, round(area, 4) AS area, round(sqrt(area / num_points), 6) AS gsd FROM gsd")
def h1(spark, d):
    return I.rounded(R.gsd_from_points(view(spark, d, "fx_points"))).withColumn("area", F.round("area", 4))


@query("h1_gsd_from_grid", f"""WITH {_PX}, s AS (SELECT * FROM px WHERE x % 2 = 0 AND y % 2 = 0),
dd AS (SELECT a.frame, sqrt((a.px-b.px)^2 + (a.py-b.py)^2) / 2 AS d FROM s a JOIN s b ON a.frame = b.frame AND ((b.x = a.x + 2 AND a.y = b.y) OR (b.y = a.y + 2 AND a.x = b.x)))
SELECT CAST(frame // 8 AS BIGINT) AS setid, count(*) AS num_samples, round(median(d), 6) AS gsd, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.9), 6) AS p90 FROM dd WHERE d > 0 GROUP BY frame // 8""")
def h1_grid(spark, d):
    p = PR.unproject(view(spark, d, "fx_pixels").select("frame", "y", "x", "z", "valid"), I.pixel_cams(spark, d), ["frame"])
    return I.rounded(R.gsd_from_grid(p.withColumn("setid", F.floor(F.col("frame") / 8)), ["frame", "setid"], ["setid"], 2))


@query("h2_raster_bounds", f"WITH {_BND} SELECT scene, gsd, round(u_min, 6) AS u_min, round(u_max, 6) AS u_max, round(v_min, 6) AS v_min, round(v_max, 6) AS v_max, width, height FROM bnd")
def h2(spark, d):
    return I.rounded(_bounds(spark, d))


_RAST = f"""{_BND}, pp AS (SELECT p.*, b.width, b.height, CAST(floor((x - u_min) / gsd) AS BIGINT) AS px, CAST(floor((v_max - y) / gsd) AS BIGINT) AS py FROM {{fx_points}} p JOIN bnd b USING (scene)),
inn AS (SELECT * FROM pp WHERE px >= 0 AND px < width AND py >= 0 AND py < height),
dsk AS (SELECT * FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS dx) CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS dy) WHERE dx * dx + dy * dy <= 4),
spl AS (SELECT scene, py + dy AS py, px + dx AS px, z, r, g, b, point_id, dx, dy, width, height FROM inn, dsk),
ras AS (SELECT scene, py, px, z, r, g, b, point_id FROM spl WHERE px >= 0 AND px < width AND py >= 0 AND py < height QUALIFY row_number() OVER (PARTITION BY scene, py, px ORDER BY z DESC, dx * dx + dy * dy, dy, dx, point_id) = 1)"""


@query("h3_rasterize", f"WITH {_RAST} SELECT scene, py, px, round(z, 6) AS z, r, g, b, point_id FROM ras")
def h3(spark, d):
    return I.rounded(R.rasterize(view(spark, d, "fx_points"), _bounds(spark, d), 2))


def _raster(spark, d):
    return materialize(R.rasterize(view(spark, d, "fx_points"), _bounds(spark, d), 2), "raster")


# the two-dimensional filter read directly: every output pixel gathers its mirrored neighbourhood
_SMOOTH = f"""{_RAST}, off AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS ox) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS oy)),
kn AS (SELECT ox, oy, exp(-(ox*ox + oy*oy) / (2 * 0.8::DOUBLE * 0.8::DOUBLE)) / pow(1 + 2 * exp(-1 / (2 * 0.8::DOUBLE * 0.8::DOUBLE)), 2) AS w FROM off),
grd AS (SELECT scene, width, height, unnest(range(0, width)) AS px FROM bnd), gr2 AS (SELECT *, unnest(range(0, height)) AS py FROM grd),
rd AS (SELECT scene, py, px, w, CASE WHEN px + ox < 0 THEN -(px + ox) WHEN px + ox > width - 1 THEN 2 * (width - 1) - px - ox ELSE px + ox END AS rx, CASE WHEN py + oy < 0 THEN -(py + oy) WHEN py + oy > height - 1 THEN 2 * (height - 1) - py - oy ELSE py + oy END AS ry FROM gr2, kn),
smo AS (SELECT rd.scene, rd.py, rd.px, sum(w * z) / sum(w) AS z FROM rd JOIN ras ON ras.scene = rd.scene AND ras.py = rd.ry AND ras.px = rd.rx GROUP BY rd.scene, rd.py, rd.px HAVING sum(w) >= 0.3)"""


@query("h4_smooth_raster", f"WITH {_SMOOTH} SELECT scene, py, px, round(z, 6) AS z FROM smo")
def h4(spark, d):
    return I.rounded(R.smooth_raster(_raster(spark, d), _bounds(spark, d), 1, 0.8, 1, 0.3))


@query("h4_smoothing_coverage", f"""WITH {_SMOOTH}, a AS (SELECT scene, count(*) AS valid_before FROM ras GROUP BY scene), c AS (SELECT scene, count(*) AS valid_after, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM ras r WHERE r.scene = smo.scene AND r.py = smo.py AND r.px = smo.px)) AS filled FROM smo GROUP BY scene)
SELECT scene, CAST(width AS BIGINT) * height AS pixels, valid_before, valid_after, filled, round(valid_before / (width * height), 6) AS coverage_before, round(valid_after / (width * height), 6) AS coverage_after FROM bnd JOIN a USING (scene) JOIN c USING (scene)""")
def h4_cov(spark, d):
    r, b = _raster(spark, d), _bounds(spark, d)
    return I.rounded(R.smoothing_coverage(r, R.smooth_raster(r, b, 1, 0.8, 1, 0.3), b))


@query("h5_tile_stats", f"""WITH {_RAST}, t AS (SELECT *, py // 128 AS ty, px // 128 AS tx FROM ras)
SELECT t.scene, ty, tx, tx * 128 AS x0, ty * 128 AS y0, least(128, any_value(width) - tx * 128) AS tile_width, least(128, any_value(height) - ty * 128) AS tile_height, count(*) AS num_pixels,
  round(count(*) / (least(128, any_value(width) - tx * 128) * least(128, any_value(height) - ty * 128)), 6) AS fill, round(quantile_cont(z, 0.01), 6) AS p1, round(quantile_cont(z, 0.5), 6) AS p50, round(quantile_cont(z, 0.99), 6) AS p99
FROM t JOIN bnd USING (scene) GROUP BY t.scene, ty, tx""")
def h5(spark, d):
    return I.rounded(R.tile_stats(_raster(spark, d), _bounds(spark, d), 100))
