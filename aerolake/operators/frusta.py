"""View frusta: corners and planes, overlapping pairs, and points inside."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.functions import linalg as L
from aerolake.operators.projection import box_cells, box_pairs, point_cells
from aerolake.session import materialize

# fixed values: default range of a view without depth, corner order (near then far plane), triangles and plane triples
DEFAULT_NEAR = 0.1
DEFAULT_FAR = 100.0
CORNER_SIGNS = ((1, 1), (-1, 1), (-1, -1), (1, -1))
TRIANGLES = (
    (0, 1, 2), (0, 2, 3), (0, 3, 7), (0, 7, 4), (1, 2, 6), (1, 6, 5),
    (1, 4, 5), (1, 0, 4), (2, 6, 7), (2, 3, 7), (6, 7, 4), (6, 5, 4),
)
PLANES = ((0, 1, 3), (1, 6, 2), (0, 3, 7), (2, 6, 3), (0, 5, 1), (6, 5, 4))
EDGES = np.array(((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)))
# rounding of corners relative to their coordinates, and the slope from which an edge crosses a plane well enough to allow for it
TOUCH = 64 * 2.0**-52
STEEP = 1e-3
CLEAR = 8.0
_TEST_BATCH, _CLIP_BATCH = 256, 1024


def frustum_corners(cams: DataFrame, stats: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, corners): eight world corners per camera, flat in one array; ``stats(key, near, far)`` gives the depth range."""
    j = cams.join(stats.select(*key, "near", "far"), list(key), "left")
    near = F.coalesce("near", F.lit(DEFAULT_NEAR))
    far = F.coalesce("far", F.lit(DEFAULT_FAR))
    k, r, t = F.col("k"), L.rot_of("t_c2w"), L.trans_of("t_c2w")
    out = []
    for d in (near, far):
        for sx, sy in CORNER_SIGNS:
            out.extend(L.add(L.matvec(r, [d * k[2] / k[0] * float(sx), d * k[5] / k[4] * float(sy), d]), t))
    return j.select(*key, F.array(*out).alias("corners"))


def frustum_planes(corners: str | Column) -> Column:
    """Six inward planes (a, b, c, d) of a corner array, flat."""
    c = L.col(corners)
    p = lambda i: [c[3 * i + a] for a in range(3)]
    out = []
    for i0, i1, i2 in PLANES:
        n = L.cross(L.sub(p(i1), p(i0)), L.sub(p(i2), p(i0)))
        length = L.norm(n)
        n = [v / length for v in n]
        out.extend([*n, -L.dot(n, p(i0))])
    return F.array(*out)


def _boxes(frusta: DataFrame) -> DataFrame:
    axis = lambda a: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("corners")[i * 3 + a])
    return frusta.withColumns({
        f"__{c}{n}": f(axis(a)) for a, c in enumerate("xyz") for n, f in ((0, F.array_min), (1, F.array_max))})


def points_in_frustum(points: DataFrame, frusta: DataFrame, by: Sequence[str] = ("scene",), view: str = "frame") -> DataFrame:
    """(by, view, point_id) of the points on the inner side of all six planes."""
    by = list(by)
    boxes = materialize(_boxes(frusta).withColumn("planes", frustum_planes("corners")).drop("corners"), "frusta")
    cells, levels = box_cells(boxes, by)
    p = point_cells(points.select(*by, "point_id", "x", "y", "z"), levels, by)
    j = p.join(cells, [*by, "__lv", "__cx", "__cy"]).where("z >= __z0 AND z <= __z1")
    side = lambda i: F.col("planes")[4 * i] * F.col("x") + F.col("planes")[4 * i + 1] * F.col("y") + F.col("planes")[4 * i + 2] * F.col("z") + F.col("planes")[4 * i + 3]
    inside = side(0) >= 0
    for i in range(1, 6):
        inside = inside & (side(i) >= 0)
    return j.where(inside).select(*by, view, "point_id")


def _touch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance up to which two frusta of a pair touch: the rounding of their largest coordinate."""
    return TOUCH * np.maximum(np.abs(a).max(axis=(1, 2)), np.abs(b).max(axis=(1, 2)))


def _edges_hit(tri_a: np.ndarray, tri_b: np.ndarray, touch: np.ndarray) -> np.ndarray:
    """Whether any triangle edge of a frustum pierces or touches a triangle of the other; arrays (pairs, 12, 3, 3).

    By signed volumes: the ends of the edge lie on different sides of the triangle's plane, and the edge passes all three
    sides of the triangle in one sense. What is ``touch`` away counts as passed, unless the edge runs along the plane.
    """
    p = tri_a.reshape(len(tri_a), -1, 1, 3)
    q = tri_a[:, :, [1, 2, 0]].reshape(p.shape)
    corner = [tri_b[:, None, :, k] for k in range(3)]
    normal = np.cross(corner[1] - corner[0], corner[2] - corner[0])
    normal = normal / np.linalg.norm(normal, axis=-1, keepdims=True)
    height_p, height_q = (((x - corner[0]) * normal).sum(-1) for x in (p, q))
    length = np.linalg.norm(q - p, axis=-1)
    near = np.where(np.abs(height_p - height_q) > STEEP * length, touch[:, None, None], 0.0)
    above = below = True
    for k in range(3):
        c0, c1 = corner[k], corner[(k + 1) % 3]
        turn = ((q - p) * np.cross(c0 - p, c1 - p)).sum(-1)
        slack = near * length * np.linalg.norm(c1 - c0, axis=-1)
        above, below = above & (turn >= -slack), below & (turn <= slack)
    across = (np.minimum(height_p, height_q) <= near) & (np.maximum(height_p, height_q) >= -near)
    return ((above | below) & across & (height_p != height_q)).any(axis=(1, 2))


def _contains(corners: np.ndarray, point: np.ndarray, touch: np.ndarray) -> np.ndarray:
    i = np.array(PLANES)
    p0, p1, p2 = corners[:, i[:, 0]], corners[:, i[:, 1]], corners[:, i[:, 2]]
    n = np.cross(p1 - p0, p2 - p0)
    n /= np.linalg.norm(n, axis=-1, keepdims=True)
    return (((point[:, None] - p0) * n).sum(-1) >= -touch[:, None]).all(axis=1)


def _heights(corners: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(pairs, 8, 6): how far the corners of the other frustum lie inside the planes of this one."""
    i = np.array(PLANES)
    p0 = corners[:, i[:, 0]]
    n = np.cross(corners[:, i[:, 1]] - p0, corners[:, i[:, 2]] - p0)
    with np.errstate(divide="ignore", invalid="ignore"):
        n /= np.linalg.norm(n, axis=-1, keepdims=True)
    return sum((other[:, :, None, k] - p0[:, None, :, k]) * n[:, None, :, k] for k in range(3))


def _edge_inside(heights: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Whether a part of an edge lies at least ``depth`` inside all planes, by clipping the edge at each of them."""
    h = heights - depth[:, None, None]
    p, q = h[:, EDGES[:, 0]], h[:, EDGES[:, 1]]
    out_p, out_q = p < 0, q < 0
    with np.errstate(divide="ignore", invalid="ignore"):
        t = p / (p - q)
    start = np.where(out_p, np.where(out_q, np.inf, t), 0.0).max(axis=2)
    end = np.where(out_q & ~out_p, t, 1.0).min(axis=2)
    return (start <= end).any(axis=1)


def _decided(a: np.ndarray, b: np.ndarray, touch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether frusta meet, whether that is sure). They meet where an edge of one has a part in the other; pairs that do so, or fail
    to, by no more than ``CLEAR`` times their rounding are not sure, nor are flat frusta."""
    in_a, in_b = _heights(a, b), _heights(b, a)
    clear = CLEAR * touch
    hit = _edge_inside(in_a, clear) | _edge_inside(in_b, clear)
    miss, left = np.zeros(len(a), bool), np.flatnonzero(~hit)
    miss[left] = ~(_edge_inside(in_a[left], -clear[left]) | _edge_inside(in_b[left], -clear[left]))
    return hit, (hit | miss) & np.isfinite(in_a).all(axis=(1, 2)) & np.isfinite(in_b).all(axis=(1, 2))


@F.arrow_udf(T.BooleanType())
def _overlap(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Exact test on candidate pairs: by clipped edges, and by triangles for those that only just meet or miss."""
    tri = np.array(TRIANGLES)
    corners = lambda col: col.flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 3)
    for left, right in batches:
        a_all, b_all = corners(left), corners(right)
        out = np.zeros(len(left), bool)
        for i in range(0, len(left), _CLIP_BATCH):
            a, b = a_all[i:i + _CLIP_BATCH], b_all[i:i + _CLIP_BATCH]
            hit, sure = _decided(a, b, _touch(a, b))
            out[i:i + _CLIP_BATCH] = hit & sure
            rest = np.flatnonzero(~sure)
            for k in range(0, len(rest), _TEST_BATCH):
                at = rest[k:k + _TEST_BATCH]
                out[i + at] = _meet(a[at], b[at], tri)
        yield pa.array(out)


def _meet(a: np.ndarray, b: np.ndarray, tri: np.ndarray) -> np.ndarray:
    near = _touch(a, b)
    hit = _contains(a, b[:, 0], near) | _contains(b, a[:, 0], near)
    todo = ~hit
    if todo.any():
        ta, tb = a[todo][:, tri], b[todo][:, tri]
        hit[todo] = _edges_hit(ta, tb, near[todo]) | _edges_hit(tb, ta, near[todo])
    return hit


def frustum_pairs(frusta: DataFrame, by: Sequence[str] = ("scene",), view: str = "frame") -> DataFrame:
    """(by, view_a, view_b) with view_a < view_b whose frusta intersect, touch or contain each other.

    Candidates are pairs whose boxes overlap. Frusta that touch do so up to the rounding of their corners.
    """
    by = list(by)
    pad = lambda c: F.abs(F.col(c)) * TOUCH
    boxes = _boxes(frusta).withColumns({f"__{a}{n}": F.col(f"__{a}{n}") + (2 * n - 1) * pad(f"__{a}{n}") for a in "xy" for n in (0, 1)})
    boxes = materialize(boxes, "frusta")
    j = box_pairs(boxes, by, view).where((F.col("a___z0") <= F.col("b___z1")) & (F.col("b___z0") <= F.col("a___z1")))
    a, b = F.col("a_" + view), F.col("b_" + view)
    return j.where(_overlap("a_corners", "b_corners")).select(*by, F.least(a, b).alias("view_a"), F.greatest(a, b).alias("view_b"))


def directed_pairs(pairs: DataFrame, by: Sequence[str] = ("scene",), view: str = "frame") -> DataFrame:
    """Both directions of undirected pairs, as (by, view, other)."""
    one = pairs.select(*by, F.col("view_a").alias(view), F.col("view_b").alias("other"))
    return one.unionByName(pairs.select(*by, F.col("view_b").alias(view), F.col("view_a").alias("other")))
