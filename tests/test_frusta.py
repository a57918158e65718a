"""Frusta that only touch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.operators import frusta as FR

# (frame, frame, centre, centre) of nadir cameras 30 m apart whose sides touch in the plane where the lower one starts
TOUCHING = (
    (377, 380, 60.0, 1241.7297, 103.4594, 30.0, 1242.9797, 105.9594),
    (732, 735, 110.0, 2441.7297, 103.4594, 80.0, 2442.9797, 105.9594),
    (1087, 1090, 70.0, 3601.7297, 103.4594, 100.0, 3602.9797, 105.9594),
    (1442, 1445, 20.0, 4801.7297, 103.4594, 50.0, 4802.9797, 105.9594),
    (2152, 2155, 70.0, 7161.7297, 103.4594, 40.0, 7162.9797, 105.9594),
    (2862, 2865, 60.0, 9521.7297, 103.4594, 90.0, 9522.9797, 105.9594),
)


def test_touching_frusta_are_pairs_and_a_gap_is_none(spark):
    cams = []
    for i, (fa, fb, ax, ay, az, bx, by, bz) in enumerate(TOUCHING):
        away = 1e-6 if bx > ax else -1e-6
        for scene, gap in ((2 * i, 0.0), (2 * i + 1, away)):
            cams += [(scene, fa, ax, ay, az), (scene, fb, bx + gap, by, bz)]
    c = spark.createDataFrame(cams, "scene int, frame int, cx double, cy double, cz double")
    one, z = F.lit(1.0), F.lit(0.0)
    pose = L.pose([[one, z, z], [z, -one, z], [z, z, -one]], L.vec("cx", "cy", "cz"))
    k = F.array(*[F.lit(v) for v in (50.0, 0.0, 8.0, 0.0, 50.0, 8.0, 0.0, 0.0, 1.0)])
    stats = c.select("scene", "frame", (80 + F.col("frame") % 7).cast("double").alias("near"), (95 + F.col("frame") % 5).cast("double").alias("far"))
    frusta = FR.frustum_corners(c.select("scene", "frame", k.alias("k"), pose.alias("t_c2w")), stats, ["scene", "frame"])
    got = {tuple(r) for r in FR.frustum_pairs(frusta).collect()}
    assert got == {(2 * i, min(t[:2]), max(t[:2])) for i, t in enumerate(TOUCHING)}


def test_clear_pairs_are_decided_by_clipped_edges_as_by_triangles(monkeypatch):
    rng = np.random.default_rng(12)

    def frusta(n):
        turn = np.linalg.qr(rng.normal(size=(n, 3, 3)))[0]
        turn[:, :, 0] *= np.sign(np.linalg.det(turn))[:, None]
        at = np.array([(d * 0.4 * sx, d * 0.3 * sy, d) for d in (1.0, 6.0) for sx, sy in FR.CORNER_SIGNS])
        return at @ turn.transpose(0, 2, 1) + rng.uniform(-4, 4, (n, 1, 3))

    a, b = frusta(3000), frusta(3000)
    b[:50] = a[:50].mean(axis=1, keepdims=True) + 0.1 * (a[:50] - a[:50].mean(axis=1, keepdims=True))  # one inside the other
    a[50:100] += 50.0
    hit, sure = FR._decided(a, b, FR._touch(a, b))
    want = FR._meet(a, b, np.array(FR.TRIANGLES))
    assert sure.all() and (hit == want).all() and hit[:50].all() and not hit[50:100].any() and 300 < hit.sum() < 2700
    b[100:110] = a[100:110, :1]  # a point has no planes: left to the triangles
    assert not FR._decided(a, b, FR._touch(a, b))[1][100:110].any()
    # pairs that are clear are not measured by triangles
    measured = []
    monkeypatch.setattr(FR, "_edges_hit", lambda p, q, touch: measured.append(len(p)) or np.zeros(len(p), bool))
    flat = lambda x: pa.array(list(x[110:].reshape(-1, 24)))
    out = next(FR._overlap.func(iter([(flat(a), flat(b))])))
    assert not measured and out.to_pylist() == want[110:].tolist()
