"""Known transforms are recovered; invalid groups fall back."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.hashing import uniforms
from aerolake.operators import alignment as A
from aerolake.operators import hierarchy as H
from aerolake.operators import matching as M
from aerolake.operators import timeline as TL
from aerolake.session import materialize


def rotation(axis, angle):
    a = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def corr(seed, n, s, r, t, noise=0.0):
    rng = np.random.default_rng(seed)
    src = rng.normal(size=(n, 3)) * [50, 30, 5] + 1e6  # large world coordinates
    dst = s * src @ r.T + t + rng.normal(size=(n, 3)) * noise
    return pd.DataFrame(np.hstack([src, dst]), columns=["sx", "sy", "sz", "dx", "dy", "dz"]).assign(id=np.arange(n))


def test_sim3_recovered(spark):
    r = rotation([1, 2, 3], 2.0)
    df = pd.concat([corr(1, 200, 0.5, r, [10, -4, 2]).assign(g=0), corr(2, 2, 1, np.eye(3), [0, 0, 0]).assign(g=1)])
    got = A.fit_sim3(spark.createDataFrame(df), ["g"]).toPandas().set_index("g")
    assert got.loc[0, "valid"] and not got.loc[1, "valid"]
    assert got.loc[1, "s"] == 1.0 and list(got.loc[1, "r"]) == list(A.EYE)
    np.testing.assert_allclose(np.reshape(got.loc[0, "r"], (3, 3)), r, atol=1e-9)
    assert abs(got.loc[0, "s"] - 0.5) < 1e-9
    res = A.residuals(spark.createDataFrame(df[df.g == 0]), A.fit_sim3(spark.createDataFrame(df[df.g == 0]), ["g"]), ["g"])
    assert res.agg(F.max("err")).first()[0] < 1e-5


def test_reflection_gives_proper_rotation(spark):
    df = corr(3, 100, 1.0, np.diag([1.0, 1.0, -1.0]), [0, 0, 0]).assign(g=0)
    r = np.reshape(A.fit_sim3(spark.createDataFrame(df), ["g"]).first()["r"], (3, 3))
    assert np.linalg.det(r) > 0.999


def test_robust_ignores_outliers(spark):
    r = rotation([0, 0, 1], 0.4)
    df = corr(4, 200, 2.0, r, [1, 2, 3]).assign(g=0)
    df.loc[:19, ["dx", "dy", "dz"]] += 500.0
    got = A.fit_sim3_robust(spark.createDataFrame(df), ["g"], ["id"]).first()
    assert abs(got["s"] - 2.0) < 1e-6


def test_yaw_degenerate_is_translation(spark):
    df = pd.DataFrame({"sx": [1.0] * 4, "sy": [2.0] * 4, "sz": [0.0, 1, 2, 3], "dx": [4.0] * 4, "dy": [1.0] * 4, "dz": [5.0, 6, 7, 8], "g": 0, "id": range(4)})
    got = A.fit_yaw(spark.createDataFrame(df), ["g"]).first()
    assert got["yaw"] == 0.0 and list(got["t"]) == [3.0, -1.0, 5.0]


def test_align_ladder(spark):
    one = corr(5, 1, 1.0, np.eye(3), [3, 4, 5]).assign(g=1)
    many = corr(6, 30, 2.0, rotation([0, 0, 1], 0.3), [1, 1, 1]).assign(g=2)
    groups = spark.createDataFrame(pd.DataFrame({"g": [1, 2, 3]}))
    got = A.align_chunks(spark.createDataFrame(pd.concat([one, many])), groups, ["g"], "scale_yaw_translation", ["id"], max_pairs=20000).toPandas().set_index("g")
    np.testing.assert_allclose(got.loc[1, "t"], [3, 4, 5], atol=1e-6)
    assert got.loc[1, "s"] == 1.0 and abs(got.loc[2, "s"] - 2.0) < 1e-9 and abs(got.loc[2, "yaw"] - 0.3) < 1e-9
    assert not got.loc[3, "valid"] and got.loc[3, "num_corr"] == 0


def test_compose_is_associative(spark):
    rng = np.random.default_rng(7)
    tf = lambda: spark.createDataFrame([(0, float(rng.uniform(0.5, 2)), [float(v) for v in rotation(rng.normal(size=3), 1.0).ravel()], [float(v) for v in rng.normal(size=3)])],
                                       "g int, s double, r array<double>, t array<double>")
    a, b, c = tf(), tf(), tf()
    left = M.compose_sim3(M.compose_sim3(a, b, ["g"]), c, ["g"]).first()
    right = M.compose_sim3(a, M.compose_sim3(b, c, ["g"]), ["g"]).first()
    np.testing.assert_allclose(left["r"], right["r"], atol=1e-12)
    np.testing.assert_allclose(left["t"], right["t"], atol=1e-12)


@pytest.mark.parametrize("angle", [0.0, 1e-7, 1.0, np.pi - 1e-6, np.pi])
def test_slerp_half_way(spark, angle):
    r0, axis = rotation([1, 1, 0], 0.7), [0.3, -0.5, 0.8]
    r1 = r0 @ rotation(axis, angle)
    pose = lambda r: [float(v) for v in np.vstack([np.hstack([r, np.zeros((3, 1))]), [[0, 0, 0, 1]]]).ravel()]
    df = spark.createDataFrame([(pose(r0), pose(r1))], "a array<double>, b array<double>")
    got = np.reshape(TL.with_slerp(df, F.col("a"), F.col("b"), F.lit(0.5), "o").first()["o"], (3, 3))
    want = [r0 @ rotation(axis, angle / 2)] + ([r0 @ rotation(axis, -angle / 2)] if angle == np.pi else [])
    assert min(np.abs(got - w).max() for w in want) < 1e-6


def test_icp_recovers_small_motion(spark):
    rng = np.random.default_rng(8)
    g = pd.DataFrame(rng.uniform(0, 50, (400, 3)) * [1, 1, 0.2], columns=list("xyz")).assign(point_id=np.arange(400), scene=0)
    r, t = rotation([0, 0, 1], 0.01), np.array([0.3, -0.2, 0.1])
    p = g.assign(**dict(zip("xyz", (g[list("xyz")].to_numpy() @ r.T + t).T)))
    tf = H.icp(spark.createDataFrame(p), spark.createDataFrame(g), iterations=4, trim=0.9).first()
    back = tf["s"] * p[list("xyz")].to_numpy() @ np.reshape(tf["r"], (3, 3)).T + np.array(tf["t"])
    assert np.abs(back - g[list("xyz")].to_numpy()).max() < 1e-6


def test_balance_statistics_name_the_reason(spark):
    nan = float("nan")
    rows = [(0, i, float(i % 4), float(i // 4), 0.0) for i in range(16)] + [(1, i, 5.0, 5.0, 0.0) for i in range(3)] + [(2, 0, nan, 1.0, 0.0)]
    corr = spark.createDataFrame([(g, i, x, y, z, x, y, z) for g, i, x, y, z in rows], "g long, i long, sx double, sy double, sz double, dx double, dy double, dz double")
    got = {r.g: tuple(r)[1:] for r in A.balance_statistics(corr, ["g"], 12, grid=2, min_cell=1).collect()}
    assert got[0] == ("balanced", 16, 16, 12, 4, 3, 4, 4)
    assert got[1] == ("degenerate XY span", 3, 3, 3, None, None, None, None)
    assert got[2] == ("no finite XY midpoints", 1, 0, 0, None, None, None, None)
    kept = A.balance_correspondences(corr, ["g"], ["i"], 12, grid=2, min_cell=1).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in kept} == {0: 12, 1: 3}
    assert {r.reason for r in A.balance_statistics(corr, ["g"], 12, grid=1).collect()} == {"grid_size <= 1"}


def test_rigid_icp_against_plain_rounds(spark):
    rng = np.random.default_rng(12)
    g = rng.uniform(0, 40, (300, 3))
    r, t = rotation([0, 0.2, 1], 0.02), np.array([0.4, -0.3, 0.2])
    p = g[:260] @ r.T + t + rng.normal(0, 0.02, (260, 3))
    far = rng.uniform(200, 240, (60, 3))  # a group that the gate leaves without enough pairs
    frame = lambda *parts: pd.concat([pd.DataFrame(x, columns=list("xyz")).assign(scene=s, point_id=np.arange(len(x))) for s, x in parts])

    def plain(x, rounds, gate, trim, least):
        rt, tt = np.eye(3), np.zeros(3)
        for _ in range(rounds):
            d = np.linalg.norm(x[:, None] - g[None], axis=2)
            j, d = d.argmin(1), d.min(1)
            keep = np.flatnonzero(d < gate)
            if len(keep) < least:
                break
            keep = keep[np.argsort(d[keep], kind="stable")[: max(int(len(keep) * trim), least)]]
            a, b = x[keep], g[j[keep]]
            u, _, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
            turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
            shift = b.mean(0) - turn @ a.mean(0)
            rt, tt, x = turn @ rt, turn @ tt + shift, x @ turn.T + shift
        return rt, tt

    tf = H.icp_rigid(spark.createDataFrame(frame((0, p), (1, far))), spark.createDataFrame(frame((0, g), (1, g))), iterations=3, gate=1.5)
    got = {row["scene"]: row for row in tf.collect()}
    rt, tt = plain(p, 3, 1.5, 0.8, 50)
    np.testing.assert_allclose(np.reshape(got[0]["r"], (3, 3)), rt, atol=1e-9)
    np.testing.assert_allclose(got[0]["t"], tt, atol=1e-8)
    assert got[0]["s"] == 1.0 and got[1]["num_corr"] == 0 and list(got[1]["t"]) == [0, 0, 0]


def test_icp_writes_one_index(spark, monkeypatch):
    from aerolake.operators import neighbors as N

    built = []
    real = N._indexed
    monkeypatch.setattr(N, "_indexed", lambda *a: built.append(1) or real(*a))
    rng = np.random.default_rng(1)
    g = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 9, (80, 3)), columns=list("xyz")).assign(scene=0, point_id=np.arange(80)))
    H.icp(g, g, iterations=3).collect()
    assert len(built) == 1
    built.clear()
    N.cloud_distances(g, g, ["scene"]).collect()
    assert len(built) == 2


def test_merge_goes_on_after_a_failed_fit(spark):
    chunks = spark.createDataFrame([(0, 0, [0]), (0, 1, [1])], "scene long, chunk_id long, key array<int>")
    members = spark.createDataFrame([(0, 0, 1, "core"), (0, 1, 2, "core")], "scene long, chunk_id long, frame int, role string")
    pts = spark.createDataFrame([(0, 0, 1, 0, 0, True, 1.0, 1.0, 1.0), (0, 1, 2, 0, 0, True, 2.0, 2.0, 2.0)],
                                "scene long, chunk_id long, frame int, y int, x int, valid boolean, px double, py double, pz double")
    tf, edges = H.align_hierarchy(chunks, members, pts)
    e = edges.first()
    assert not e["valid"] and e["n"] == 0
    assert all(r["s"] == 1.0 and list(r["t"]) == [0, 0, 0] for r in tf.collect())


def test_baseline_pairs_have_their_size(spark):
    # the planner must not take exploded pairs for a table small enough to be broadcast
    n = spark.range(20).select(F.col("id").alias("g"), F.lit(300).cast("long").alias("n"))
    pairs = A.baseline_pairs(n, ["g"], 20000, 0)
    rows = pairs.count()
    assert rows > 20 * 19000 and pairs.rdd.getNumPartitions() > 1
    assert int(str(pairs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > rows


def test_baselines_of_groups_that_fit_together_are_not_written(spark, monkeypatch):
    # pairs grow with the square of a group's rows: only groups of more than PACKED_ROWS rows join theirs, at most max_pairs each
    rng = np.random.default_rng(11)
    rows = [(g, i, *map(float, rng.normal(size=6))) for g, n in (("a", 1), ("b", 2), ("c", 90), ("d", 300)) for i in range(n)]
    corr = spark.createDataFrame(rows, "g string, id int, sx double, sy double, sz double, dx double, dy double, dz double")
    names = []
    monkeypatch.setattr(A, "materialize", lambda df, name: names.append(name) or materialize(df, name))
    scales = lambda: {r["g"]: (r["n"], r["num_pairs"], r["scale_valid"], r["scale"]) for r in A.fit_scale(corr, ["g"], ["id"], 5000).collect()}
    packed = scales()
    assert "baselines" not in names and packed["a"] == (1, 0, False, 1.0) and packed["b"][:3] == (2, 1, True) and packed["d"][1] > 4900
    for limit in (100, 0):
        names.clear()
        monkeypatch.setattr(A, "PACKED_ROWS", limit)
        got = scales()
        assert names.count("baselines") == 1 and set(got) == set(packed)
        for g, want in packed.items():
            assert got[g][:3] == want[:3] and abs(got[g][3] - want[3]) < 1e-12


def test_hashed_uniforms_equal_those_of_spark(spark):
    runs = [(b"s:7:", 0, 120), (b"", 5, 12), (b"x" * 46 + b":", 8, 20), (b"y" * 60 + b":", 0, 11), (b"z:", 99990, 100020)]
    for seed in (0, 12):
        k = spark.createDataFrame([(h.decode()[:-1] if h else None, n, j) for j, (h, lo, hi) in enumerate(runs) for n in range(lo, hi)], "h string, k long, j int")
        want = [r["u"] for r in k.select("j", "k", L.uniform(seed, "h", "k").alias("u")).orderBy("j", "k").collect()]
        assert uniforms(runs, seed).tolist() == want
