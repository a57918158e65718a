"""Projection at the borders of pixels and images, and label fusion."""

import numpy as np
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.operators import projection as P


def test_border_points_project_as_the_plain_formula(spark):
    rng = np.random.default_rng(5)
    n = 2000
    cx, cy = 5.0 * rng.integers(0, 8, n) + 0.01 * rng.integers(0, 15000, n), 0.013 * rng.integers(0, 15000, n)
    z = 80 + rng.integers(0, 2000, n) / 100
    i, j = rng.integers(0, 16, n), rng.integers(0, 16, n)
    px, py, pz = cx + (i - 8) * z / 50, cy - (j - 8) * z / 50, 100.0 - z
    k = [50.0, 0.0, 8.0, 0.0, 50.0, 8.0, 0.0, 0.0, 1.0]
    pose = lambda x, y: [1.0, 0.0, 0.0, x, 0.0, -1.0, 0.0, y, 0.0, 0.0, -1.0, 100.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(int(a), pose(float(x), float(y)), k, *map(float, p)) for a, (x, y, *p) in enumerate(zip(cx, cy, px, py, pz))]
    df = spark.createDataFrame(rows, "i long, t_c2w array<double>, k array<double>, x double, y double, z double")
    df = df.select("i", "x", "y", "z", *[c.alias(m) for m, c in P.projection_columns("t_c2w", "k").items()])
    u, v, depth = P.project(L.vec("x", "y", "z"))
    got = np.array([tuple(r)[1:] for r in df.select("i", u.alias("u"), v.alias("v"), depth.alias("d")).orderBy("i").collect()])
    want = np.stack([50 * (px - cx) / (100 - pz) + 8, -50 * (py - cy) / (100 - pz) + 8, 100 - pz], axis=1)
    assert (got == want).all()


def test_fusion_reads_images_in_the_join(spark):
    k, n = [10.0, 0.0, 2.0, 0.0, 10.0, 2.0, 0.0, 0.0, 1.0], 4
    pose = lambda x: [1.0, 0.0, 0.0, x, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 10.0, 0.0, 0.0, 0.0, 1.0]
    cams = spark.createDataFrame([(0, f, pose(float(f)), k) for f in range(3)], "scene int, frame int, t_c2w array<double>, k array<double>")
    # pixels are missing at the start, in the middle and at the end of images, and one lies outside
    pixels = [(0, f, y, x, 10.0 if (x + f) % 3 else 4.0) for f in range(3) for y in range(n) for x in range(n) if (f, y, x) not in ((0, 0, 0), (1, 1, 2), (2, 3, 3))]
    depth = spark.createDataFrame([*pixels, (0, 1, 1, 7, 10.0)], "scene int, frame int, y int, x int, z double")
    logit = lambda f, y, x, c: ((y * 7 + x * 3 + f + c * 13) % 17) / 4
    scores = spark.createDataFrame([(*p[:4], c, logit(*p[1:4], c)) for p in pixels for c in (2, 5)], "scene int, frame int, y int, x int, cls int, logit double")
    pts = [(0, i, -2.3 + 0.37 * i, 1.5 - 0.21 * i, 0.01 * i) for i in range(20)]
    points = spark.createDataFrame(pts, "scene int, point_id int, x double, y double, z double")
    seen = {p[:4]: p[4] for p in pixels}
    for mode in ("voting", "average", "weighted"):
        want = {}
        for _, i, px, py, pz in pts:
            tally = {}
            for f in range(3):
                zz = 10 - pz
                u, v = 10 * (px - f) / zz + 2, -10 * py / zz + 2
                at = (0, f, int(np.rint(v)), int(np.rint(u)))
                if not (0 <= u < n and 0 <= v < n) or abs(seen.get(at, 1e9) - zz) >= 0.5:
                    continue
                e = {c: np.exp(logit(*at[1:], c)) for c in (2, 5)}
                q = {c: w / sum(e.values()) for c, w in e.items()}
                best = max(e, key=lambda c: (e[c], -c))
                one = 1 + sum(w * np.log(w + 1e-8) for w in q.values()) / np.log(2)
                for c, w in e.items() if mode == "average" else [(best, 1.0 if mode == "voting" else one)]:
                    tally[c] = tally.get(c, 0) + w
            want[i] = min(tally, key=lambda c: (-round(tally[c], 9), c)) if tally else 0
        out = P.fuse_semantics(points, cams, depth, scores, mode, n, n, 2, tol=0.5)
        assert {r.point_id: r.cls for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # pairs of points and views are projected once and not shuffled to images
        assert "explode(array(struct(u" in plan and plan.count("strategy=merge") == 1
    assert len(set(want.values())) == 3
