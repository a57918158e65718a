"""Registered queries: thinning, sampling, fusion, batch plans and dataset arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.operators import batches as B
from aerolake.operators import sampling as P
from aerolake.plans import inputs as I
from aerolake.plans.fixtures import view
from aerolake.plans.queries_align import uniform_sql
from aerolake.plans.registry import query

_CELL = "CAST(floor(x / {s}) AS BIGINT) AS vx, CAST(floor(y / {s}) AS BIGINT) AS vy, CAST(floor(z / {s}) AS BIGINT) AS vz"


def points(spark, d):
    return view(spark, d, "fx_points")


@query("g1_voxel_first", f"""WITH c AS (SELECT *, {_CELL.format(s=20)} FROM {{fx_points}}),
k AS (SELECT *, row_number() OVER (PARTITION BY scene, vx, vy, vz ORDER BY point_id) AS k FROM c)
SELECT scene, point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, r FROM k WHERE k = 1""")
def g1(spark, d):
    return I.rounded(P.voxel_first(points(spark, d), 20.0, ["scene"]).select("scene", "point_id", "x", "y", "z", "r"))


@query("g2_voxel_mean", f"""WITH c AS (SELECT *, {_CELL.format(s=20)} FROM {{fx_points}})
SELECT scene, vx, vy, vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, CAST(floor(avg(r) + 0.5) AS INT) AS r, CAST(floor(avg(g) + 0.5) AS INT) AS g, CAST(floor(avg(b) + 0.5) AS INT) AS b, count(*) AS num
FROM c GROUP BY scene, vx, vy, vz""")
def g2(spark, d):
    return I.rounded(P.voxel_mean(points(spark, d), 20.0, ["scene"]).withColumnsRenamed({"cx": "vx", "cy": "vy", "cz": "vz"}))


@query("g3_adaptive_voxel", """SELECT scene, round(0.01::DOUBLE * 2 * greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), quantile_cont(y, 0.75) - quantile_cont(y, 0.25), quantile_cont(z, 0.75) - quantile_cont(z, 0.25)), 6) AS voxel
FROM {fx_points} GROUP BY scene""")
def g3(spark, d):
    return I.rounded(P.adaptive_voxel(points(spark, d), ["scene"]))


@query("g4_sample_cap", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY {uniform_sql('point_id', 3)}, point_id) AS k FROM {{fx_points}})
SELECT scene, point_id FROM k WHERE k <= 500""")
def g4(spark, d):
    return P.sample_cap(points(spark, d), ["scene"], 500, ["point_id"], 3, ("x", "y", "z")).select("scene", "point_id")


@query("g4_sample_two_stage", f"""WITH p AS (SELECT scene, point_id, point_id // 256 AS frame FROM {{fx_points}}), f AS (SELECT scene, count(DISTINCT frame) AS f FROM p GROUP BY scene),
a AS (SELECT p.*, f.f, row_number() OVER (PARTITION BY scene, frame ORDER BY {uniform_sql('point_id', 3)}, point_id) AS k FROM p JOIN f USING (scene)),
b AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY {uniform_sql('point_id', 4)}, point_id) AS j FROM a WHERE k <= greatest(1, ceil(1500 / f)))
SELECT scene, frame, point_id FROM b WHERE j <= 1000""")
def g4_two(spark, d):
    p = points(spark, d).withColumn("frame", F.floor(F.col("point_id") / 256))
    return P.sample_two_stage(p, ["scene"], "frame", 1000, ["point_id"], 3).select("scene", "frame", "point_id")


@query("g5_stratified_sample", f"""WITH p AS (SELECT scene, point_id, CAST(floor(x / 128) AS BIGINT) AS tx, CAST(floor(y / 128) AS BIGINT) AS ty, floor(x / 16) AS gx, floor(y / 16) AS gy, {uniform_sql('point_id', 6)} AS h FROM {{fx_points}}),
a AS (SELECT *, row_number() OVER (PARTITION BY scene, tx, ty, gx, gy ORDER BY h, point_id) AS k FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY scene, tx, ty ORDER BY CAST(k > 1 AS INT), h, point_id) AS j FROM a)
SELECT scene, tx, ty, point_id, CAST(k > 1 AS INT) AS is_fill FROM b WHERE j <= 80""")
def g5(spark, d):
    p = points(spark, d).withColumns({
        "tx": F.floor(F.col("x") / 128), "ty": F.floor(F.col("y") / 128), "gx": F.floor(F.col("x") / 16), "gy": F.floor(F.col("y") / 16)})
    return P.stratified_sample(p, ["scene", "tx", "ty"], ["gx", "gy"], 80, ["point_id"], 6).select("scene", "tx", "ty", "point_id", "is_fill")


# chunks of 8 pixel frames, the next two frames as overlap; every chunk has its own transform
MEMBERS_SQL = """mem AS (SELECT DISTINCT CAST(0 AS BIGINT) AS scene, CAST(frame // 8 AS BIGINT) AS chunk_id, frame, 'core' AS role FROM {fx_pixels}
  UNION ALL SELECT DISTINCT CAST(0 AS BIGINT), CAST(frame // 8 AS BIGINT) - 1, frame, 'overlap' FROM {fx_pixels} WHERE frame % 8 < 2 AND frame >= 8)"""


def members(spark, d):
    f = view(spark, d, "fx_pixels").select("frame").distinct()
    zero = F.lit(0).cast("long")
    chunk = F.floor(F.col("frame") / 8)
    core = f.select(zero.alias("scene"), chunk.alias("chunk_id"), "frame", F.lit("core").alias("role"))
    over = f.where((F.col("frame") % 8 < 2) & (F.col("frame") >= 8)).select(
        zero.alias("scene"), (chunk - 1).alias("chunk_id"), "frame", F.lit("overlap").alias("role"))
    return core.unionByName(over)


def chunk_points(spark, d):
    """Points of every chunk member frame: a point's frame is its id divided by 256."""
    p = points(spark, d).drop("scene").withColumn("frame", F.floor(F.col("point_id") / 256).cast("int"))
    return p.join(members(spark, d), "frame")


def chunk_transforms(spark, d):
    c = members(spark, d).select("scene", "chunk_id").distinct()
    z, o = F.lit(0.0), F.lit(1.0)
    return c.select("scene", "chunk_id", F.lit(2.0).alias("s"), F.array(z, -o, z, o, z, z, z, z, o).alias("r"),
                    F.array(F.col("chunk_id").cast("double"), F.lit(1.0), F.lit(-1.0)).alias("t"))


@query("g6_fuse_core", f"""WITH {MEMBERS_SQL},
p AS (SELECT m.scene, m.chunk_id, p.point_id, 2 * -p.y + m.chunk_id AS x, 2 * p.x + 1 AS y, 2 * p.z - 1 AS z FROM {{fx_points}} p JOIN mem m ON m.frame = p.point_id // 256 AND m.role = 'core'),
a AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY {uniform_sql('point_id', 0)}, point_id) AS k FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, floor(x / 50), floor(y / 50), floor(z / 50) ORDER BY point_id) AS j FROM a WHERE k <= 1200)
SELECT scene, chunk_id, point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM b WHERE j = 1""")
def g6(spark, d):
    out = P.fuse_core(chunk_points(spark, d).where("role = 'core'"), members(spark, d), chunk_transforms(spark, d), 1200, 50.0)
    return I.rounded(out.select("scene", "chunk_id", "point_id", "x", "y", "z"))


@query("g7_coverage_fill", """WITH base AS (SELECT DISTINCT scene, floor(x / 10) AS cx, floor(y / 10) AS cy FROM {fx_points} WHERE r < 40),
c AS (SELECT *, floor(x / 10) AS cx, floor(y / 10) AS cy, g // 32 AS chunk_order FROM {fx_points} WHERE r >= 40),
o AS (SELECT *, min(chunk_order) OVER (PARTITION BY scene, cx, cy) AS own FROM c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.scene = c.scene AND b.cx = c.cx AND b.cy = c.cy))
SELECT scene, point_id, CAST(chunk_order AS BIGINT) AS chunk_order FROM o WHERE chunk_order = own""")
def g7(spark, d):
    p = points(spark, d).withColumn("chunk_order", F.floor(F.col("g") / 32))
    return P.coverage_fill(p.where("r < 40"), p.where("r >= 40"), 10.0).select("scene", "point_id", "chunk_order")


_WALKS = "w AS (SELECT user_id AS scene, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id AS node FROM events), n AS (SELECT scene, count(*) AS len FROM w GROUP BY scene)"


@query("g12_fit_view_count", f"""WITH {_WALKS},
a AS (SELECT w.*, row_number() OVER (PARTITION BY scene ORDER BY CASE WHEN len = 70 THEN {uniform_sql('scene, pos', 2)} ELSE 0 END, pos) - 1 AS slot FROM w JOIN n USING (scene) WHERE len >= 70),
s AS (SELECT scene, len, unnest(range(0, 70)) AS slot FROM n WHERE len < 70),
p AS (SELECT scene, slot, CAST(floor({uniform_sql('scene, slot', 3)} * len) AS BIGINT) AS pos FROM s)
SELECT scene, CAST(slot AS INT) AS slot, node FROM a WHERE slot < 70 UNION ALL SELECT scene, CAST(slot AS INT), node FROM p JOIN w USING (scene, pos)""")
def g12(spark, d):
    f = view(spark, d, "fx_frames")
    n = f.groupBy("scene").agg(F.count(F.lit(1)).alias("total"))
    walks = f.join(n, "scene").select("scene", F.col("frame").cast("long").alias("pos"), F.col("event_id").alias("node"), "total")
    return P.fit_view_count(walks, ["scene"], 70, "total", 2)


def _feat(pools, seed, key="batch"):
    return "[" + ", ".join(f"CAST(floor({uniform_sql(key, seed + 1 + i)} * {p}) AS INT)" for i, p in enumerate(pools)) + "]"


def _spread(df, n):
    return df.select(*[c for c in df.columns if c != "features"], *[F.col("features")[i].alias(f"f{i}") for i in range(n)])


@query("g13_plan_batches", f"""WITH r AS (SELECT sample, row_number() OVER (ORDER BY {uniform_sql('sample', 780)}, sample) - 1 AS rn FROM {{fx_bins}}),
b AS (SELECT *, rn // 24 AS batch, rn % 24 AS pos FROM r), t AS (SELECT count(*) AS n FROM r), f AS (SELECT *, {_feat([4, 7], 780)} AS f FROM b)
SELECT CAST(batch // CAST(ceil(n / 72) AS BIGINT) AS INT) AS rank, batch, CAST(pos AS INT) AS pos, sample, f[1] AS f0, f[2] AS f1 FROM f, t""")
def g13(spark, d):
    return _spread(B.plan_batches(view(spark, d, "fx_bins"), "sample", 24, [4, 7], 3, 3), 2)


_SIZES = {0: 12, 1: 8, 2: 6, 3: 4}


@query("g14_plan_dynamic_batches", f"""WITH t AS (SELECT count(*) AS n FROM part),
q AS (SELECT unnest(range(0, CAST(ceil(n / 4) AS BIGINT))) AS batch FROM t), g AS (SELECT batch, {_feat([4, 7], 780)} AS f FROM q),
z AS (SELECT *, CASE f[1] WHEN 0 THEN 12 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 4 END AS size FROM g),
l AS (SELECT *, coalesce(sum(size) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM z),
r AS (SELECT p_partkey AS sample, row_number() OVER (ORDER BY {uniform_sql('p_partkey', 780)}, p_partkey) - 1 AS rn FROM part)
SELECT CAST(batch % 3 AS INT) AS rank, batch, CAST(rn - lo AS INT) AS pos, sample, f[1] AS f0, f[2] AS f1 FROM l JOIN r ON rn >= lo AND rn < lo + size""")
def g14(spark, d):
    return _spread(B.plan_dynamic_batches(view(spark, d, "fx_bins"), "sample", _SIZES, [4, 7], 0, 3, 3), 2)


_BINS = "s AS (SELECT p_partkey AS sample, CAST(p_size >= 20 AS INT) + CAST(p_size >= 30 AS INT) + CAST(p_size >= 40 AS INT) AS bin FROM part), nb AS (SELECT bin, count(*) AS n FROM s GROUP BY bin), k AS (SELECT count(*) AS k FROM nb)"
_EDGES = [10, 20, 30, 40, 50]


def _balanced_sql(size: str, lo: str, n_batches: str, tail: str) -> str:
    return f"""WITH {_BINS}, t AS (SELECT count(*) AS total FROM part),
rd AS (SELECT unnest(range(0, CAST(ceil({n_batches} / k) AS BIGINT))) AS round FROM k, t),
tu AS (SELECT round, bin, n, k, round * k + row_number() OVER (PARTITION BY round ORDER BY {uniform_sql('round, bin', 880)}, bin) - 1 AS batch FROM rd, nb, k),
f AS (SELECT *, {_feat([4, 7], 780)} AS f FROM tu, t WHERE batch < {n_batches}), z AS (SELECT *, {size} AS size FROM f),
l AS (SELECT *, {lo} AS lo FROM z), e AS (SELECT *, unnest(range(0, CAST(size AS BIGINT))) AS pos FROM l),
q AS (SELECT *, (lo + pos) // n AS pass, (lo + pos) % n AS slot FROM e), ps AS (SELECT DISTINCT bin, pass FROM q),
la AS (SELECT sample, bin, pass, row_number() OVER (PARTITION BY bin, pass ORDER BY {uniform_sql('bin, pass::BIGINT, sample', 980)}, sample) - 1 AS slot FROM s JOIN ps USING (bin))
{tail}"""


@query("g15_plan_balanced_batches", _balanced_sql("24", "round * 24", "ceil(total / 24)", """SELECT CAST(batch // CAST(ceil(total / 72) AS BIGINT) AS INT) AS rank, batch, CAST(pos AS INT) AS pos, bin, sample, f[1] AS f0, f[2] AS f1
FROM q JOIN la USING (bin, pass, slot) WHERE batch * 24 + pos < total"""))
def g15(spark, d):
    s = B.hfov_bins(view(spark, d, "fx_bins"), _EDGES)
    return _spread(B.plan_balanced_batches(s, "sample", [4, 7], 3, 3, batch=24), 2)


@query("g15_plan_balanced_dynamic", _balanced_sql(
    "CASE f[1] WHEN 0 THEN 12 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 4 END",
    "coalesce(sum(size) OVER (PARTITION BY bin ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
    "(total // 30) * 3", "SELECT CAST(batch % 3 AS INT) AS rank, batch, CAST(pos AS INT) AS pos, bin, sample, f[1] AS f0, f[2] AS f1 FROM q JOIN la USING (bin, pass, slot)"))
def g15_dynamic(spark, d):
    s = B.hfov_bins(view(spark, d, "fx_bins"), _EDGES)
    return _spread(B.plan_balanced_batches(s, "sample", [4, 7], 3, 3, sizes=_SIZES, per_rank=s.count() // 30), 2)


@query("g16_concat_datasets", """SELECT 0 AS part, p_partkey AS sample, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part
UNION ALL SELECT 1, s_suppkey, (SELECT count(*) FROM part) + row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier""")
def g16(spark, d):
    a = view(spark, d, "part").select(F.col("p_partkey").alias("sample"))
    b = view(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"))
    return P.concat_datasets([a, b], ["sample"]).select("part", "sample", "idx")


@query("g16_repeat_dataset", """SELECT p_partkey AS sample, CAST(r AS INT) AS rep, (row_number() OVER (PARTITION BY r ORDER BY p_partkey) - 1) * 3 + r AS idx FROM part, (SELECT unnest(range(0, 3)) AS r)""")
def g16_repeat(spark, d):
    return P.repeat_dataset(view(spark, d, "part").select(F.col("p_partkey").alias("sample")), 3, ["sample"])


@query("g16_resize_dataset", f"""WITH p AS (SELECT p_partkey AS sample, row_number() OVER (ORDER BY {uniform_sql('p_partkey', 779)}, p_partkey) - 1 AS i FROM part), n AS (SELECT count(*) AS n FROM part),
x AS (SELECT sample, CAST(r AS INT) AS rep, r * n + i AS idx FROM p, n, (SELECT unnest(range(0, 3)) AS r))
SELECT x.* FROM x, n WHERE idx < n * 5 // 2""")
def g16_resize(spark, d):
    p = view(spark, d, "part").select(F.col("p_partkey").alias("sample"))
    return P.resize_dataset(p, p.count() * 5 // 2, ["sample"], ["sample"], epoch=2)


@query("g17_split_by_hash", """WITH s AS (SELECT p_partkey, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 24) AS scene FROM part)
SELECT scene, CASE WHEN p_partkey < 20 THEN 'test' WHEN CAST('0x' || substr(scene, 9) AS UBIGINT) % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM s""")
def g17(spark, d):
    s = view(spark, d, "part").select("p_partkey", F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 24).alias("scene"))
    over = s.where("p_partkey < 20").select("scene", F.lit("test").alias("split"))
    return P.split_by_hash(s.select("scene"), over)
