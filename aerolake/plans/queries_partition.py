"""Registered queries: footprints, flight frame, split tree, seams, windows, adjacency, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.operators import partition as D
from aerolake.plans import checksql as S
from aerolake.plans import inputs as I
from aerolake.plans.fixtures import view
from aerolake.plans.registry import query


def _ground(spark, d):
    """Points of the cloud, grouped into frames of up to 40 by id."""
    return view(spark, d, "fx_points").withColumn("frame", F.floor(F.col("point_id") / 120))


_GROUND = "g AS (SELECT *, floor(point_id / 120) AS frame FROM {fx_points})"
_BOX = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}" for c, q, n in (
    ("x", 0.02, "a_min"), ("y", 0.02, "b_min"), ("x", 0.98, "a_max"), ("y", 0.98, "b_max"), ("x", 0.5, "ca"), ("y", 0.5, "cb")))


@query("d1_footprints", f"""WITH {_GROUND} SELECT scene, CAST(frame AS BIGINT) AS frame, count(*) AS num_points, {_BOX}, CASE WHEN count(*) < 36 THEN 'too_few_points' ELSE 'ok' END AS status FROM g GROUP BY scene, frame""")
def d1(spark, d):
    return I.rounded(D.footprints(_ground(spark, d), min_points=36))


@query("d1_footprints_predicted", f"""WITH {_GROUND}, f AS (SELECT scene, frame, count(*) AS n, {_BOX.replace('round(', '(').replace(', 6)', ')')} FROM g GROUP BY scene, frame),
c AS (SELECT scene, CAST(frame AS BIGINT) AS frame, cx, cy FROM {{fx_cams}})
SELECT c.scene, c.frame, coalesce(n, 0) AS num_points, {', '.join(f"round(coalesce({a}, {b}), 6) AS {a}" for a, b in (('a_min', 'c.cx'), ('b_min', 'c.cy'), ('a_max', 'c.cx'), ('b_max', 'c.cy'), ('ca', 'c.cx'), ('cb', 'c.cy')))},
CASE WHEN n IS NULL THEN 'camera_fallback' WHEN n < 36 THEN 'predicted_sparse' ELSE 'predicted' END AS status FROM c LEFT JOIN f ON f.scene = c.scene AND f.frame = c.frame""")
def d1_predicted(spark, d):
    cams = I.gt_cams(spark, d).withColumn("frame", F.col("frame").cast("long"))
    return I.rounded(D.footprints(_ground(spark, d), min_points=36, frames=cams, predicted=True))


@query("d2_lookat_footprints", """WITH zg AS (SELECT c.scene, coalesce(q, z) AS zg FROM (SELECT scene, min(cz) AS z FROM {fx_cams} GROUP BY scene) c LEFT JOIN (SELECT scene, quantile_cont(z, 0.05) AS q FROM {fx_points} GROUP BY scene) p USING (scene)),
e AS (SELECT scene, sqrt((max(cx)-min(cx))^2 + (max(cy)-min(cy))^2 + (max(cz)-min(cz))^2) AS span FROM {fx_cams} GROUP BY scene)
SELECT scene, frame, round(cx, 6) AS lx, round(cy, 6) AS ly, round(CASE WHEN cz - zg > 1e-6 THEN zg ELSE cz - span END, 6) AS lz, cz - zg > 1e-6 AS on_ground FROM {fx_cams} JOIN zg USING (scene) JOIN e USING (scene)""")
def d2(spark, d):
    return I.rounded(D.lookat_footprints(I.gt_cams(spark, d), view(spark, d, "fx_points")))


@query("d3_infer_axes", """WITH e AS (SELECT scene, max(cx) - min(cx) AS wx, max(cy) - min(cy) AS wy, max(cz) - min(cz) AS wz FROM {fx_cams} GROUP BY scene)
SELECT scene, CASE WHEN wz <= wx AND wz <= wy THEN 'xy' WHEN wy <= wx AND wy < wz THEN 'xz' ELSE 'yz' END AS axes FROM e""")
def d3(spark, d):
    return D.infer_axes(I.gt_cams(spark, d))


_FLIGHT = """dl AS (SELECT scene, frame, cx, cy, lead(cx) OVER w - cx AS du, lead(cy) OVER w - cy AS dv FROM {fx_cams} WINDOW w AS (PARTITION BY scene ORDER BY frame)),
un AS (SELECT *, sqrt(du*du + dv*dv) AS len FROM dl),
mo AS (SELECT scene, median(cx) AS ox, median(cy) AS oy, 0.5::DOUBLE * atan2(2 * sum(du*dv/(len*len)) FILTER (WHERE len > 1e-8), sum((du*du - dv*dv)/(len*len)) FILTER (WHERE len > 1e-8)) AS ang,
  arg_max(cx, frame) - arg_min(cx, frame) AS gx, arg_max(cy, frame) - arg_min(cy, frame) AS gy FROM un GROUP BY scene),
fl AS (SELECT scene, ox, oy, cos(ang) * sg AS dx, sin(ang) * sg AS dy FROM (SELECT *, CASE WHEN cos(ang) * gx + sin(ang) * gy < 0 THEN -1 ELSE 1 END AS sg FROM mo))"""


@query("d4_flight_frame", f"""WITH {_FLIGHT} SELECT scene, round(ox, 6) AS ox, round(oy, 6) AS oy, {S.rnd('dx', 'dx')}, {S.rnd('dy', 'dy')}, round(degrees(atan2(dy, dx)), 3) AS angle_deg, 'pose_delta_orientation' AS method FROM fl""")
def d4(spark, d):
    return I.rounded(D.flight_frame(I.gt_cams(spark, d))).withColumn("angle_deg", F.round("angle_deg", 3))


@query("d5_to_flight", f"""WITH {_FLIGHT} SELECT scene, frame, {S.rnd('dx * (cx - ox) + dy * (cy - oy)', 'x', 5)}, {S.rnd('-dy * (cx - ox) + dx * (cy - oy)', 'y', 5)} FROM {{fx_cams}} JOIN fl USING (scene)""")
def d5(spark, d):
    pts = view(spark, d, "fx_cams").select("scene", "frame", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return I.rounded(D.to_flight(pts, D.flight_frame(I.gt_cams(spark, d))), 5)


@query("d5_from_flight", """SELECT scene, frame, round(cx, 5) AS x, CASE WHEN round(cy, 5) = 0 THEN 0 ELSE round(cy, 5) END AS y FROM {fx_cams}""")
def d5_back(spark, d):
    pts = view(spark, d, "fx_cams").select("scene", "frame", F.col("cx").alias("x"), F.col("cy").alias("y"))
    fr = D.flight_frame(I.gt_cams(spark, d))
    return I.rounded(D.from_flight(D.to_flight(pts, fr), fr), 5)


@query("d5_boxes_to_flight", f"""WITH {_FLIGHT}, b AS (SELECT scene, frame, cx - 15 AS a0, cx + 15 AS a1, cy - 10 AS b0, cy + 10 AS b1 FROM {{fx_cams}}),
c AS (SELECT b.*, ox, oy, dx, dy, [dx*(a0-ox)+dy*(b0-oy), dx*(a0-ox)+dy*(b1-oy), dx*(a1-ox)+dy*(b0-oy), dx*(a1-ox)+dy*(b1-oy)] AS u, [-dy*(a0-ox)+dx*(b0-oy), -dy*(a0-ox)+dx*(b1-oy), -dy*(a1-ox)+dx*(b0-oy), -dy*(a1-ox)+dx*(b1-oy)] AS v FROM b JOIN fl USING (scene))
SELECT scene, frame, {S.rnd('list_min(u)', 'a_min', 5)}, {S.rnd('list_max(u)', 'a_max', 5)}, {S.rnd('list_min(v)', 'b_min', 5)}, {S.rnd('list_max(v)', 'b_max', 5)} FROM c""")
def d5_boxes(spark, d):
    return I.rounded(D.boxes_to_flight(_foot(spark, d).drop("ca", "cb"), D.flight_frame(I.gt_cams(spark, d))), 5)


def _foot(spark, d):
    c = view(spark, d, "fx_cams")
    return c.select("scene", "frame", F.col("cx").alias("ca"), F.col("cy").alias("cb"), (F.col("cx") - 15).alias("a_min"), (F.col("cx") + 15).alias("a_max"),
                    (F.col("cy") - 10).alias("b_min"), (F.col("cy") + 10).alias("b_max"))


# the split tree as a recursion over whole levels; the target of 22 is 70% of 32
_TREE = """tree AS (SELECT scene, frame, cx AS ca, cy AS cb, '' AS path, 0 AS lvl, min(cx - 15) OVER (PARTITION BY scene) AS r0, max(cx + 15) OVER (PARTITION BY scene) AS r1, min(cy - 10) OVER (PARTITION BY scene) AS s0, max(cy + 10) OVER (PARTITION BY scene) AS s1 FROM {fx_cams}
UNION ALL SELECT scene, frame, ca, cb, path || CAST(side AS VARCHAR), lvl + 1, CASE WHEN axis = 0 AND side = 1 THEN t2 ELSE r0 END, CASE WHEN axis = 0 AND side = 0 THEN t2 ELSE r1 END, CASE WHEN axis = 1 AND side = 1 THEN t2 ELSE s0 END, CASE WHEN axis = 1 AND side = 0 THEN t2 ELSE s1 END
FROM (SELECT *, CASE WHEN th > lo AND th < hi THEN th ELSE (lo + hi) / 2 END AS t2
FROM (SELECT *, (max(CASE WHEN side = 0 THEN v END) OVER (PARTITION BY scene, path) + min(CASE WHEN side = 1 THEN v END) OVER (PARTITION BY scene, path)) / 2 AS th, CASE WHEN axis = 0 THEN r0 ELSE s0 END AS lo, CASE WHEN axis = 0 THEN r1 ELSE s1 END AS hi
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY scene, path ORDER BY v, frame) - 1 >= n // 2 THEN 1 ELSE 0 END AS side
FROM (SELECT *, CASE WHEN axis = 0 THEN ca ELSE cb END AS v
FROM (SELECT *, CASE WHEN (path = '' AND ea > 1e-9) OR ea >= eb THEN 0 ELSE 1 END AS axis
FROM (SELECT *, count(*) OVER (PARTITION BY scene, path) AS n, max(ca) OVER (PARTITION BY scene, path) - min(ca) OVER (PARTITION BY scene, path) AS ea, max(cb) OVER (PARTITION BY scene, path) - min(cb) OVER (PARTITION BY scene, path) AS eb FROM tree)) WHERE n > 22))))),
fin AS (SELECT * FROM (SELECT *, max(lvl) OVER (PARTITION BY scene, frame) AS deep FROM tree) WHERE lvl = deep),
leaf AS (SELECT scene, path, count(*) AS n, any_value(r0) AS r0, any_value(r1) AS r1, any_value(s0) AS s0, any_value(s1) AS s1 FROM fin GROUP BY scene, path),
lord AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY (r0+r1)/2, (s0+s1)/2, path) - 1 AS cell_order FROM leaf)"""


@query("d6_split_tree", f"WITH RECURSIVE {_TREE} SELECT scene, frame, path FROM fin")
def d6(spark, d):
    return D.split_tree(_foot(spark, d), 32)[0]


@query("d6_split_tree_leaves", f"WITH RECURSIVE {_TREE} SELECT scene, path, n, round(r0, 6) AS r0, round(r1, 6) AS r1, round(s0, 6) AS s0, round(s1, 6) AS s1, cell_order FROM lord")
def d6_leaves(spark, d):
    return I.rounded(D.split_tree(_foot(spark, d), 32)[1])


_SEAM = f"""{_TREE}, cid AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY cell_order) - 1 AS chunk_id FROM lord WHERE n >= 8),
cnd AS (SELECT a.scene, a.chunk_id, a.n, f.frame, sqrt(greatest(0, f.ca - 15 - a.r1, a.r0 - f.ca - 15)^2 + greatest(0, f.cb - 10 - a.s1, a.s0 - f.cb - 10)^2) AS dist
  FROM cid a JOIN lord b ON a.scene = b.scene AND a.path <> b.path AND greatest(a.r0 - b.r1, b.r0 - a.r1) <= 5 + 1e-9 AND greatest(a.s0 - b.s1, b.s0 - a.s1) <= 5 + 1e-9 JOIN fin f ON f.scene = b.scene AND f.path = b.path),
rnk AS (SELECT *, row_number() OVER (PARTITION BY scene, chunk_id ORDER BY dist > 5 + 1e-9, dist, frame) AS k FROM cnd),
mem AS (SELECT f.scene, chunk_id, frame, 'core' AS role FROM fin f JOIN cid USING (scene, path) UNION ALL SELECT scene, chunk_id, frame, 'overlap' FROM rnk WHERE k <= 32 - n)"""


def chunked(spark, d):
    foot = _foot(spark, d)
    assign, leaves = D.split_tree(foot, 32)
    return D.assign_seams(assign, leaves, foot, 32, 8, 5.0)


@query("d7_assign_seams_members", f"WITH RECURSIVE {_SEAM} SELECT * FROM mem")
def d7(spark, d):
    return chunked(spark, d)[1]


@query("d7_assign_seams_chunks", f"""WITH RECURSIVE {_SEAM} SELECT c.scene, c.chunk_id, c.path, c.n AS num_core, c.cell_order, count(frame) AS num_seam_candidates, greatest(0, count(frame) - (32 - c.n)) AS num_dropped_seam
FROM cid c LEFT JOIN cnd USING (scene, chunk_id) GROUP BY c.scene, c.chunk_id, c.path, c.n, c.cell_order""")
def d7_chunks(spark, d):
    return chunked(spark, d)[0].select("scene", "chunk_id", "path", "num_core", "cell_order", "num_seam_candidates", "num_dropped_seam")


def _temporal_sql(merge: bool) -> str:
    # windows of 20 with 5 shared frames, step 15
    tail = "k = last AND last > 0 AND n - ((last - 1) * 15 + 20) < 8" if merge else "false"
    return f"""WITH f AS (SELECT scene, frame, frame AS pos, count(*) OVER (PARTITION BY scene) AS n FROM {{fx_frames}}),
w AS (SELECT *, CASE WHEN n <= 20 THEN 0 ELSE CAST(ceil((n - 20) / 15) AS BIGINT) END AS last FROM f), k AS (SELECT *, unnest(range(0, last + 1)) AS k FROM w),
m AS (SELECT *, CASE WHEN k > 0 AND pos < (k - 1) * 15 + 20 THEN 'overlap' ELSE 'core' END AS role FROM k WHERE pos >= k * 15 AND pos < k * 15 + 20)
SELECT scene, CASE WHEN {tail} THEN k - 1 ELSE k END AS chunk_id, frame, CAST(pos AS BIGINT) AS pos, role FROM m WHERE NOT ({tail} AND role = 'overlap')"""


@query("d8_temporal_chunks", _temporal_sql(False))
def d8(spark, d):
    return D.temporal_chunks(view(spark, d, "fx_frames"), 20, 0.25)


@query("d8_temporal_chunks_merged", _temporal_sql(True))
def d8_merged(spark, d):
    return D.temporal_chunks(view(spark, d, "fx_frames"), 20, 0.25, 8, True)


_ADJ = f"""{_SEAM}, ctr AS (SELECT m.scene, chunk_id, avg(cx) AS cx, avg(cy) AS cy, avg(cz) AS cz FROM mem m JOIN {{fx_cams}} USING (scene, frame) WHERE role = 'core' GROUP BY m.scene, chunk_id),
prs AS (SELECT DISTINCT a.scene, a.chunk_id, b.chunk_id AS other FROM mem a JOIN mem b ON a.scene = b.scene AND a.frame = b.frame AND a.chunk_id <> b.chunk_id
  UNION SELECT a.scene, a.chunk_id, b.chunk_id FROM cid a JOIN cid b ON a.scene = b.scene AND a.chunk_id <> b.chunk_id AND a.path <> '' AND b.path <> '' AND left(a.path, length(a.path) - 1) = left(b.path, length(b.path) - 1)),
dpr AS (SELECT p.*, sqrt((a.cx-b.cx)^2 + (a.cy-b.cy)^2 + (a.cz-b.cz)^2) AS dist, c.cell_order FROM prs p JOIN ctr a ON a.scene = p.scene AND a.chunk_id = p.chunk_id JOIN ctr b ON b.scene = p.scene AND b.chunk_id = p.other JOIN cid c ON c.scene = p.scene AND c.chunk_id = p.other)"""


def _adjacent(spark, d):
    from aerolake.session import materialize

    chunks, members = chunked(spark, d)
    members = materialize(members, "members")
    cen = materialize(D.chunk_centres(members, I.gt_cams(spark, d)), "centres")
    return chunks, members, cen, D.chunk_adjacency(members, chunks, cen)


@query("d9_chunk_adjacency", f"""WITH RECURSIVE {_ADJ} SELECT scene, chunk_id, other, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY scene, chunk_id ORDER BY dist, cell_order, other) - 1 AS INT) AS rank FROM dpr""")
def d9(spark, d):
    return I.rounded(_adjacent(spark, d)[3])


# one row per pop of the queue, with lists for the queue and what was seen
_MEAN = lambda a: f"list_avg(list_transform(list_filter(ns, lambda n: list_contains(seen, n.i)), lambda n: n.{a})) AS m{a}"
_QUEUE = f"""{_ADJ}, sc AS (SELECT scene, avg(cx) AS sx, avg(cy) AS sy, avg(cz) AS sz FROM {{fx_cams}} GROUP BY scene),
nd AS MATERIALIZED (SELECT c.scene, list({{'i': c.chunk_id, 'x': cx, 'y': cy, 'z': cz, 'h': sqrt((cx - sx)^2 + (cy - sy)^2 + (cz - sz)^2)}}) AS ns FROM cid c JOIN ctr USING (scene, chunk_id) JOIN sc USING (scene) GROUP BY c.scene),
nb AS MATERIALIZED (SELECT scene, chunk_id, list(other ORDER BY dist, cell_order, other) AS os FROM dpr GROUP BY ALL),
bf AS (SELECT scene, []::BIGINT[] AS seen, [list_sort(list_transform(ns, lambda n: {{'h': n.h, 'i': n.i}}))[1].i] AS q FROM nd UNION ALL
  SELECT scene, CASE WHEN len(q) > 0 AND NOT list_contains(seen, q[1]) THEN list_append(seen, q[1]) ELSE seen END,
    CASE WHEN len(q) = 0 THEN [list_sort(list_transform(list_filter(ns, lambda n: NOT list_contains(seen, n.i)), lambda n: {{'d': sqrt((n.x - mx)^2 + (n.y - my)^2 + (n.z - mz)^2), 'h': n.h, 'i': n.i}}))[1].i]
    WHEN list_contains(seen, q[1]) THEN q[2:] ELSE list_concat(q[2:], list_filter(coalesce(os, []), lambda o: o <> q[1] AND NOT list_contains(seen, o))) END
  FROM (SELECT b.*, ns, os, {_MEAN('x')}, {_MEAN('y')}, {_MEAN('z')} FROM bf b JOIN nd ON nd.scene = b.scene LEFT JOIN nb ON nb.scene = b.scene AND nb.chunk_id = b.q[1] WHERE len(seen) < len(ns))),
odr AS (SELECT scene, arg_max(seen, len(seen)) AS seen FROM bf GROUP BY scene)"""


@query("d10_order_spatial", f"WITH RECURSIVE {_QUEUE} SELECT scene, unnest(seen) AS chunk_id, generate_subscripts(seen, 1) - 1 AS exec_order FROM odr")
def d10(spark, d):
    from aerolake.session import materialize

    chunks, _, cen, adj = _adjacent(spark, d)
    return D.order_spatial(chunks, materialize(adj, "adjacency"), cen, I.gt_cams(spark, d))


@query("d10_order_sequential", f"""WITH RECURSIVE {_SEAM}, o AS (SELECT scene, chunk_id, row_number() OVER (PARTITION BY scene ORDER BY cell_order, chunk_id) - 1 AS exec_order FROM cid)
SELECT *, CASE WHEN exec_order > 0 THEN exec_order - 1 END AS parent_order, exec_order AS level FROM o""")
def d10_seq(spark, d):
    return D.order_sequential(chunked(spark, d)[0])


@query("d11_chunk_summary", f"""WITH RECURSIVE {_SEAM}, z AS (SELECT scene, chunk_id, count(*) AS n FROM mem WHERE role = 'core' GROUP BY scene, chunk_id),
s AS (SELECT scene, count(*) AS num_chunks, min(n) AS core_min, max(n) AS core_max, round(avg(n), 6) AS core_mean, round(stddev_pop(n), 6) AS core_std, count(*) FILTER (WHERE n < 17) AS under_min FROM z GROUP BY scene),
t AS (SELECT scene, chunk_id, n, count(frame) AS c FROM cid LEFT JOIN cnd USING (scene, chunk_id, n) GROUP BY ALL), u AS (SELECT scene, sum(c)::BIGINT AS seam_candidates, sum(greatest(0, c - (32 - n)))::BIGINT AS seam_dropped FROM t GROUP BY scene),
v AS (SELECT scene, count(*) AS num_frames FROM {{fx_frames}} GROUP BY scene), w AS (SELECT scene, count(*) AS covered FROM mem WHERE role = 'core' GROUP BY scene)
SELECT *, round(coalesce(covered, 0) / num_frames, 6) AS coverage FROM v LEFT JOIN w USING (scene) LEFT JOIN s USING (scene) LEFT JOIN u USING (scene)""")
def d11(spark, d):
    chunks, members = chunked(spark, d)
    return I.rounded(D.chunk_summary(chunks, members, view(spark, d, "fx_frames"), 17))


@query("d11_overlap_uses", f"WITH RECURSIVE {_SEAM} SELECT scene, frame, count(*) AS uses FROM mem WHERE role = 'overlap' GROUP BY scene, frame")
def d11_uses(spark, d):
    return D.overlap_uses(chunked(spark, d)[1])
