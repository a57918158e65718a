"""Chunk adjacency without joins of member tables that only look small, and orders that do not hang on rounding."""

from aerolake.operators import partition as D
from aerolake.session import materialize


def test_members_are_not_broadcast(spark):
    # 300,000 members in a file of a few kilobytes: the planner's size says nothing about the rows
    members = materialize(spark.range(300000).selectExpr("0L AS scene", "CAST(floor(id / 100) AS BIGINT) AS chunk_id", "CAST(id AS INT) AS frame", "'core' AS role").coalesce(1))
    pose = "transform(sequence(0, 15), i -> CAST(id AS DOUBLE))"
    cams = spark.range(300000).selectExpr("0L AS scene", "CAST(id AS INT) AS frame", f"{pose} AS t_c2w")
    plan = D.chunk_centres(members, cams)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_every_pair_of_chunks_that_share_a_frame_is_linked(spark):
    members = spark.createDataFrame([(s, c, f, "core") for s, c, f in ((0, 0, 1), (0, 1, 1), (0, 2, 1), (0, 2, 2), (0, 3, 2), (0, 3, 2), (1, 0, 2), (1, 1, 2))],
                                    "scene long, chunk_id long, frame int, role string")
    ids = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]
    chunks = spark.createDataFrame([(s, c, "", c) for s, c in ids], "scene long, chunk_id long, path string, cell_order long")
    centres = spark.createDataFrame([(s, c, float(c), 0.0, 0.0) for s, c in ids], "scene long, chunk_id long, cx double, cy double, cz double")
    got = {(r.scene, r.chunk_id, r.other) for r in D.chunk_adjacency(members, chunks, centres).collect()}
    once = {(0, 0, 1), (0, 0, 2), (0, 1, 2), (0, 2, 3), (1, 0, 1)}
    assert got == once | {(s, b, a) for s, a, b in once}


def test_equal_distances_do_not_follow_the_rounding_of_means(spark):
    # chunks 1 and 2 are equally far from chunk 0, and 0 and 3 from the scene's centre, but for the last digits
    ids = [(0, c) for c in range(4)]
    chunks = spark.createDataFrame([(s, c, "", c) for s, c in ids], "scene long, chunk_id long, path string, cell_order long")
    members = spark.createDataFrame([(s, c, f, "core") for s, c, f in ((0, 0, 1), (0, 1, 1), (0, 2, 1), (0, 2, 2), (0, 3, 2))],
                                    "scene long, chunk_id long, frame int, role string")
    at = [(0.0, 0.0), (0.0, 72.1710314548019), (0.0, -72.17103145480178), (-100.00000000000001, 0.0)]
    centres = spark.createDataFrame([(0, c, x, y, 0.0) for c, (x, y) in enumerate(at)], "scene long, chunk_id long, cx double, cy double, cz double")
    adj = materialize(D.chunk_adjacency(members, chunks, centres))
    assert [r.other for r in adj.where("chunk_id = 0").orderBy("rank").collect()] == [1, 2]
    pose = "transform(sequence(0, 15), i -> CASE WHEN i = 3 THEN -50.00000000000001D ELSE 0D END)"
    cams = spark.range(1).selectExpr("0L AS scene", f"{pose} AS t_c2w")
    got = D.order_spatial(chunks, adj, centres, cams)
    assert [r.chunk_id for r in got.orderBy("exec_order").collect()] == [0, 1, 2, 3]
