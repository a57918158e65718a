"""Registered queries: covisibility edges, view sampling, descriptor matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.operators import descriptors as DS
from aerolake.operators import graphs as G
from aerolake.plans import inputs as I
from aerolake.plans.fixtures import view
from aerolake.plans.queries_align import uniform_sql
from aerolake.plans.registry import query
from aerolake.session import materialize

LO, HI = 0.04, 0.055


# Check SQL of the samplers: a recursive query whose rows are the state of a walk, with lists for path and stack.


def _graph(scenes: bool) -> str:
    """Edges, neighbour lists (with the nodes that are too close to the neighbour), nodes and seeds by scene."""
    ed = "SELECT scene, src, dst, w FROM {fx_scene_edges}" if scenes else "SELECT 0 AS scene, src, dst, w FROM {fx_edges}"
    of = "unnest([0, 1, 2]::BIGINT[])" if scenes else "0"
    return f"""ed AS MATERIALIZED ({ed}),
st AS (SELECT scene, dst AS node, list(DISTINCT src) AS sl FROM (SELECT scene, src, dst FROM ed WHERE w >= {HI} - 1e-12 UNION SELECT scene, dst, src FROM ed WHERE w >= {HI} - 1e-12) GROUP BY ALL),
ef AS (SELECT scene, src, dst, w FROM (SELECT a.scene, a.src, a.dst, greatest(a.w, coalesce(b.w, a.w)) AS w FROM ed a LEFT JOIN ed b ON a.scene = b.scene AND a.src = b.dst AND a.dst = b.src) WHERE w >= {LO} AND w < {HI} - 1e-12),
al AS MATERIALIZED (SELECT ef.scene, src AS node, list({{'nw': -w, 'dst': dst, 'sl': coalesce(sl, [])}} ORDER BY -w, dst) AS nb FROM ef LEFT JOIN st ON st.scene = ef.scene AND st.node = dst GROUP BY ALL),
nl AS MATERIALIZED (SELECT scene, list(node ORDER BY node) AS ns FROM (SELECT scene, src AS node FROM ed UNION SELECT scene, dst FROM ed) GROUP BY scene),
sd AS (SELECT {of} AS scene, c_custkey AS seed_id FROM customer)"""


def _draw(scenes: bool, cand: str, k: str, step: str, t: float) -> str:
    """Ids of k candidates by weight, all in order if there are no more."""
    u = uniform_sql(f"{'scene, ' if scenes else ''}seed_id, attempt, {step}, s.dst", 6)
    return f"""CASE WHEN len({cand}) <= {k} THEN list_transform({cand}, lambda s: s.dst)
 ELSE list_transform(list_sort(list_transform({cand}, lambda s: {{'g': s.nw / {t}::DOUBLE + ln(-ln({u})), 'd': s.dst}}))[1:{k}], lambda s: s.d) END"""


def _starts(scenes: bool, p: str, mode: str) -> str:
    """A start node for every attempt of the seeds of a mode."""
    key = "scene, " if scenes else ""
    return f"""{p}a AS (SELECT scene, seed_id, unnest([0, 1, 2, 3]) AS attempt FROM {mode}),
{p}s AS (SELECT scene, seed_id, attempt, ns[1 + CAST(floor({uniform_sql(key + 'seed_id, attempt', 5)} * len(ns)) AS BIGINT)] AS start FROM {p}a JOIN nl USING (scene))"""


def _star(scenes: bool, p: str, seeds: str, t: float, trunk: int) -> str:
    return f"""{_starts(scenes, p, seeds)},
{p}c AS (SELECT s.*, coalesce(nb, [])[1:12] AS c FROM {p}s s LEFT JOIN al ON al.scene = s.scene AND node = start),
{p}w AS (SELECT scene, seed_id, attempt, list_concat([start], {_draw(scenes, 'c', '5', '0', t)}) AS path FROM {p}c)"""


_NEXT = "list_filter(coalesce(nb, [])[1:12], lambda s: NOT list_contains(path, s.dst) AND (len(path) < 2 OR NOT list_has_any(s.sl, path)))"


def _chain(scenes: bool, p: str, seeds: str, t: float, trunk: int) -> str:
    return f"""{_starts(scenes, p, seeds)},
{p}r AS (SELECT scene, seed_id, attempt, [start] AS path FROM {p}s UNION ALL
  SELECT scene, seed_id, attempt, list_append(path, c[1].dst) FROM (SELECT r.*, {_NEXT} AS c FROM {p}r r JOIN al ON al.scene = r.scene AND node = path[-1] WHERE len(path) < 6) WHERE len(c) > 0),
{p}w AS (SELECT scene, seed_id, attempt, arg_max(path, len(path)) AS path FROM {p}r GROUP BY ALL)"""


def _tree(scenes: bool, p: str, seeds: str, t: float, trunk: int) -> str:
    return f"""{_starts(scenes, p, seeds)},
{p}r AS (SELECT scene, seed_id, attempt, [start] AS path, -1 AS i FROM {p}s UNION ALL
  SELECT scene, seed_id, attempt, CASE WHEN i >= 0 THEN list_concat(path, {_draw(scenes, 'c', 'k', 'i', t)}) WHEN len(c) > 0 THEN list_append(path, c[1].dst) ELSE path END,
    CASE WHEN i < 0 AND len(c) > 0 AND len(path) + 1 < {trunk} THEN -1 ELSE i + 1 END
  FROM (SELECT *, least(2, 6 - len(path), len(c)) AS k FROM (SELECT r.*, CASE WHEN i < 0 THEN {_NEXT} ELSE list_filter(coalesce(nb, []), lambda s: NOT list_contains(path, s.dst))[1:12] END AS c
    FROM {p}r r LEFT JOIN al ON al.scene = r.scene AND node = CASE WHEN i < 0 THEN path[-1] ELSE path[i + 1] END WHERE len(path) < 6 AND i < len(path)))),
{p}w AS (SELECT scene, seed_id, attempt, arg_max(path, len(path)) AS path FROM {p}r GROUP BY ALL)"""


def _walk(scenes: bool, p: str, seeds: str, t: float, trunk: int) -> str:
    key = "scene, " if scenes else ""
    start = lambda nodes, attempt: f"{nodes}[1 + CAST(floor({uniform_sql(f'{key}seed_id, {attempt}', 5)} * len({nodes})) AS BIGINT)]"
    free = lambda nb: f"list_filter(coalesce({nb}, []), lambda s: NOT list_contains(path, s.dst))[1:12]"
    return f"""{p}r AS (SELECT scene, seed_id, 0 AS attempt, 0 AS step, [s] AS path, [s] AS stack, s AS start, []::BIGINT[] AS tried FROM (SELECT scene, seed_id, {start('ns', '0')} AS s FROM {seeds} JOIN nl USING (scene)) UNION ALL
  SELECT scene, seed_id, CASE WHEN fin THEN attempt + 1 ELSE attempt END, CASE WHEN fin THEN 0 ELSE step + 1 END, CASE WHEN fin THEN [s2] ELSE list_concat(path, nx) END,
    CASE WHEN fin THEN [s2] WHEN len(nx) > 0 THEN list_concat(stack, nx) ELSE stack[1:len(stack) - 1] END, CASE WHEN fin THEN s2 ELSE start END, CASE WHEN fin THEN seen ELSE tried END
  FROM (SELECT *, {_draw(scenes, 'c', '1', 'step', t)} AS nx, {start('fr', 'attempt + 1')} AS s2
    FROM (SELECT *, CASE WHEN {uniform_sql(key + 'seed_id, attempt, step', 7)} < 0.1 AND len(c1) > 0 THEN c1 ELSE c0 END AS c, list_filter(ns, lambda x: NOT list_contains(seen, x)) AS fr
      FROM (SELECT r.*, ns, len(stack) = 0 AS fin, list_concat(tried, path) AS seen, {free('a.nb')} AS c0, {free('b.nb')} AS c1
        FROM {p}r r JOIN nl ON nl.scene = r.scene LEFT JOIN al a ON a.scene = r.scene AND a.node = r.stack[-1] LEFT JOIN al b ON b.scene = r.scene AND b.node = r.start
        WHERE len(path) < 6 AND (len(stack) > 0 OR attempt < 3)))) WHERE NOT fin OR len(fr) > 0),
{p}w AS (SELECT scene, seed_id, attempt, arg_max(path, len(path)) AS path FROM {p}r GROUP BY ALL)"""


_SAMPLERS = {"anchor_star": _star, "random_walk": _walk, "tree": _tree, "greedy_chain": _chain}
_FIRST = "QUALIFY row_number() OVER (PARTITION BY scene, seed_id ORDER BY len(path) < 6, CASE WHEN len(path) >= 6 THEN 0 ELSE -len(path) END, attempt) = 1"


def _rows(scenes: bool, source: str, more: str = "") -> str:
    key = "scene, " if scenes else ""
    return f"SELECT {key}seed_id{more}, CAST(pos - 1 AS INT) AS pos, path[pos] AS node FROM (SELECT *, unnest(range(1, least(6, len(path)) + 1)) AS pos FROM ({source}))"


def sampled(mode: str, scenes: bool, t: float, trunk: int = 2) -> str:
    """Check SQL of one sampler."""
    return f"WITH RECURSIVE {_graph(scenes)},\n{_SAMPLERS[mode](scenes, '', 'sd', t, trunk)}\n" + _rows(scenes, f"SELECT * FROM w {_FIRST}")


def mixed(scenes: bool) -> str:
    """Check SQL of the mixture, with default temperature and trunk."""
    key = "scene, " if scenes else ""
    cuts = {"anchor_star": (0, 0.5), "random_walk": (0.5, 0.75), "tree": (0.75, 0.9), "greedy_chain": (0.9, 2)}
    ctes, parts = [], []
    for k, (mode, (lo, hi)) in enumerate(cuts.items()):
        ctes.append(f"m{k} AS (SELECT * FROM sd WHERE {uniform_sql(key + 'seed_id', 14)} >= {lo}::DOUBLE AND {uniform_sql(key + 'seed_id', 14)} < {hi}::DOUBLE)")
        ctes.append(_SAMPLERS[mode](scenes, f"x{k}", f"m{k}", 1.0, 2))
        parts.append(f"SELECT * FROM (SELECT scene, seed_id, attempt, path, '{mode}' AS mode FROM x{k}w) {_FIRST}")
    return f"WITH RECURSIVE {_graph(scenes)},\n" + ",\n".join(ctes) + "\n" + _rows(scenes, " UNION ALL ".join(f"({x})" for x in parts), ", mode")

_EFF = f"""ed AS MATERIALIZED (SELECT * FROM {{fx_edges}}), ef AS (SELECT * FROM (SELECT a.src, a.dst, greatest(a.w, coalesce(b.w, a.w)) AS w FROM ed a LEFT JOIN ed b ON a.src = b.dst AND a.dst = b.src) WHERE w >= {LO} AND w < {HI} - 1e-12),
ak AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM ef)"""


def edges(spark, d):
    return materialize(view(spark, d, "fx_edges"), "edges")


@query("c8_covis_edges_max", f"WITH {_EFF} SELECT src, dst, round(w, 9) AS w FROM ak WHERE k <= 10")
def c8(spark, d):
    return I.rounded(G.covis_edges(edges(spark, d), "max", LO, HI, 10), 9)


@query("c8_covis_edges_mean", """WITH ed AS (SELECT * FROM {fx_edges}), m AS (SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, (coalesce(a.w, 0) + coalesce(b.w, 0)) / 2 / (1 + 1e-8) AS w FROM ed a FULL JOIN ed b ON a.src = b.dst AND a.dst = b.src)
SELECT src, dst, round(w, 9) AS w FROM m WHERE w > 0.045""")
def c8_mean(spark, d):
    return I.rounded(G.covis_edges(edges(spark, d), "mean", 0.045), 9)


def seeds(spark, d):
    """One seed per customer."""
    return view(spark, d, "customer").select(F.col("c_custkey").alias("seed_id"))


_STARTS = f"""nd AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM ed UNION SELECT dst FROM ed)), nn AS (SELECT count(*) AS n FROM nd),
sa AS (SELECT c_custkey AS seed_id, unnest([0, 1, 2, 3]) AS attempt FROM customer),
st AS (SELECT seed_id, attempt, node AS start FROM (SELECT sa.*, CAST(floor({uniform_sql('seed_id, attempt', 5)} * n) AS BIGINT) AS idx FROM sa, nn) JOIN nd USING (idx))"""
_PICK = """fb AS (SELECT seed_id, path FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY len(path) < 6, CASE WHEN len(path) >= 6 THEN 0 ELSE -len(path) END, attempt) AS k FROM wl) WHERE k = 1)
SELECT seed_id, CAST(pos - 1 AS INT) AS pos, path[pos] AS node FROM (SELECT *, unnest(range(1, least(6, len(path)) + 1)) AS pos FROM fb)"""


@query("g8_sample_anchor_star", f"""WITH {_EFF}, {_STARTS},
cd AS (SELECT seed_id, attempt, start, dst, k, -w / 0.5::DOUBLE + ln(-ln({uniform_sql('seed_id, attempt, 0, dst', 6)})) AS g, count(*) OVER (PARTITION BY seed_id, attempt) AS m FROM st JOIN ak ON src = start AND k <= 12),
pk AS (SELECT *, row_number() OVER (PARTITION BY seed_id, attempt ORDER BY CASE WHEN m <= 5 THEN k ELSE g END) AS j FROM cd),
wl AS (SELECT st.seed_id, st.attempt, list_concat([any_value(st.start)], coalesce(list(dst ORDER BY j) FILTER (WHERE dst IS NOT NULL), [])) AS path FROM st LEFT JOIN (SELECT * FROM pk WHERE j <= 5) p ON p.seed_id = st.seed_id AND p.attempt = st.attempt GROUP BY st.seed_id, st.attempt),
{_PICK}""")
def g8(spark, d):
    return G.sample_anchor_star(edges(spark, d), seeds(spark, d), 6, LO, HI, 12, 0.5, seed=5)


@query("g9_sample_random_walk", sampled("random_walk", False, 0.5))
def g9(spark, d):
    return G.sample_random_walk(edges(spark, d), seeds(spark, d), 6, LO, HI, 12, 0.5, seed=5)


@query("g10_sample_greedy_chain", f"""WITH RECURSIVE {_EFF}, {_STARTS}, sg AS MATERIALIZED (SELECT src, dst FROM ed WHERE w >= {HI} - 1e-12 UNION SELECT dst, src FROM ed WHERE w >= {HI} - 1e-12), a12 AS MATERIALIZED (SELECT * FROM ak WHERE k <= 12),
gr AS (SELECT seed_id, attempt, [start] AS path FROM st UNION ALL
  SELECT seed_id, attempt, list_append(path, dst) FROM (SELECT gr.*, a.dst, row_number() OVER (PARTITION BY seed_id, attempt ORDER BY a.k) AS j FROM gr JOIN a12 a ON a.src = path[-1]
    WHERE len(path) < 6 AND NOT list_contains(path, a.dst) AND (len(path) < 2 OR NOT EXISTS (SELECT 1 FROM sg WHERE sg.dst = a.dst AND list_contains(path, sg.src)))) WHERE j = 1),
wl AS (SELECT seed_id, attempt, arg_max(path, len(path)) AS path FROM gr GROUP BY seed_id, attempt), {_PICK}""")
def g10(spark, d):
    return G.sample_greedy_chain(edges(spark, d), seeds(spark, d), 6, LO, HI, 12, seed=5)


@query("g11_sample_tree", sampled("tree", False, 0.5, 3))
def g11(spark, d):
    return G.sample_tree(edges(spark, d), seeds(spark, d), 6, LO, HI, 12, 0.5, trunk_ratio=0.4, seed=5)


@query("g11_sample_mixed", mixed(False))
def g11_mixed(spark, d):
    return G.sample_mixed(edges(spark, d), seeds(spark, d), 6, seed=5, lo=LO, hi=HI, topk=12)


def scene_edges(spark, d):
    return materialize(view(spark, d, "fx_scene_edges"), "edges")


def scene_seeds(spark, d):
    """One seed per customer in each of the three graphs."""
    return seeds(spark, d).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("scene"), "seed_id")


SCENE = {"by": ["scene"]}


@query("c8_covis_edges_scenes", f"""WITH {_EFF.replace("fx_edges", "fx_scene_edges").replace("a.src, a.dst", "a.scene, a.src, a.dst").replace("ON a.src", "ON a.scene = b.scene AND a.src").replace("BY src", "BY scene, src")}
SELECT scene, src, dst, round(w, 9) AS w FROM ak WHERE k <= 10""")
def c8_scenes(spark, d):
    return I.rounded(G.covis_edges(scene_edges(spark, d), "max", LO, HI, 10, **SCENE), 9)


@query("c8_covis_edges_mean_scenes", """WITH ed AS (SELECT * FROM {fx_scene_edges}), m AS (SELECT coalesce(a.scene, b.scene) AS scene, coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, (coalesce(a.w, 0) + coalesce(b.w, 0)) / 2 / (1 + 1e-8) AS w FROM ed a FULL JOIN ed b ON a.scene = b.scene AND a.src = b.dst AND a.dst = b.src)
SELECT scene, src, dst, round(w, 9) AS w FROM m WHERE w > 0.045""")
def c8_mean_scenes(spark, d):
    return I.rounded(G.covis_edges(scene_edges(spark, d), "mean", 0.045, **SCENE), 9)


@query("g8_sample_anchor_star_scenes", sampled("anchor_star", True, 0.5))
def g8_scenes(spark, d):
    return G.sample_anchor_star(scene_edges(spark, d), scene_seeds(spark, d), 6, LO, HI, 12, 0.5, seed=5, **SCENE)


@query("g9_sample_random_walk_scenes", sampled("random_walk", True, 0.5))
def g9_scenes(spark, d):
    return G.sample_random_walk(scene_edges(spark, d), scene_seeds(spark, d), 6, LO, HI, 12, 0.5, seed=5, **SCENE)


@query("g10_sample_greedy_chain_scenes", sampled("greedy_chain", True, 0.5))
def g10_scenes(spark, d):
    return G.sample_greedy_chain(scene_edges(spark, d), scene_seeds(spark, d), 6, LO, HI, 12, seed=5, **SCENE)


@query("g11_sample_tree_scenes", sampled("tree", True, 0.5, 3))
def g11_scenes(spark, d):
    return G.sample_tree(scene_edges(spark, d), scene_seeds(spark, d), 6, LO, HI, 12, 0.5, trunk_ratio=0.4, seed=5, **SCENE)


@query("g11_sample_mixed_scenes", mixed(True))
def g11_mixed_scenes(spark, d):
    return G.sample_mixed(scene_edges(spark, d), scene_seeds(spark, d), 6, seed=5, lo=LO, hi=HI, topk=12, **SCENE)


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)))"
_MATCH = f"""pr AS (SELECT a.frame AS view_i, b.frame AS view_j, a.vec_id AS id_i, b.vec_id AS id_j, {_DIST} AS d FROM {{fx_vectors}} a JOIN {{fx_vectors}} b ON b.frame - a.frame BETWEEN 1 AND 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY view_i, view_j, id_i ORDER BY d, id_j) AS k FROM pr),
bm AS (SELECT view_i, view_j, id_i, max(id_j) FILTER (WHERE k = 1) AS id_j, max(d) FILTER (WHERE k = 1) AS d1, max(d) FILTER (WHERE k = 2) AS d2 FROM rk WHERE k <= 2 GROUP BY ALL),
mt AS (SELECT * FROM bm WHERE d1 < 0.96::DOUBLE * d2)"""


def _desc(spark, d):
    return view(spark, d, "fx_vectors").select(F.lit(0).alias("scene"), F.col("frame").alias("view"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("c14_match_descriptors", f"WITH {_MATCH} SELECT CAST(0 AS BIGINT) AS scene, view_i, view_j, id_i, id_j, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM mt")
def c14(spark, d):
    return I.rounded(DS.match_descriptors(_desc(spark, d), 2, 0.96))


_UV = "SELECT vec_id AS id, frame AS view, x, y, z, 50 * (x - frame) / (300 - z) + 8 AS u, -50 * y / (300 - z) + 8 AS v FROM {fx_vectors}"


@query("c14_reprojection_filter", f"""WITH {_MATCH}, kp AS ({_UV}),
e AS (SELECT m.*, a.x, a.y, a.z, a.u AS ui, a.v AS vi, b.u AS uj, b.v AS vj FROM mt m JOIN kp a ON a.id = id_i JOIN kp b ON b.id = id_j),
f AS (SELECT *, sqrt((50 * (x - view_j) / (300 - z) + 8 - uj)^2 + (-50 * y / (300 - z) + 8 - vj)^2) AS err_j FROM e)
SELECT view_i, view_j, id_i, id_j, round(err_j, 6) AS err_j FROM f WHERE z < 300 AND err_j <= 3""")
def c14_reproject(spark, d):
    v = view(spark, d, "fx_vectors")
    h = 300 - F.col("z")
    kp = v.select(F.lit(0).cast("long").alias("scene"), F.col("frame").alias("view"), F.col("vec_id").alias("id"), (50 * (F.col("x") - F.col("frame")) / h + 8).alias("u"),
                  (-50 * F.col("y") / h + 8).alias("v"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    one, z = F.lit(1.0), F.lit(0.0)
    pose = L.pose([[one, z, z], [z, -one, z], [z, z, -one]], [F.col("view").cast("double"), z, F.lit(300.0)])
    k = F.array(*[F.lit(x) for x in (50.0, 0.0, 8.0, 0.0, 50.0, 8.0, 0.0, 0.0, 1.0)])
    cams = kp.select("scene", "view").distinct().select("scene", "view", k.alias("k"), pose.alias("t_c2w"))
    out = DS.reprojection_filter(DS.match_descriptors(_desc(spark, d), 2, 0.96), kp, cams, 3.0)
    return I.rounded(out.select("view_i", "view_j", "id_i", "id_j", "err_j"))
