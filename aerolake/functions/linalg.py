"""Column expressions for fixed-size linear algebra, quaternions and hashed randomness (all JVM-side)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]
Mat = Sequence[Sequence[Column]]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vec(*cols: str | Column) -> list[Column]:
    return [col(c) for c in cols]


def mat3(arr: str | Column) -> list[list[Column]]:
    a = col(arr)
    return [[a[3 * i + j] for j in range(3)] for i in range(3)]


def rot_of(t: str | Column) -> list[list[Column]]:
    """Rotation block of a row-major 4x4 array."""
    a = col(t)
    return [[a[4 * i + j] for j in range(3)] for i in range(3)]


def trans_of(t: str | Column) -> list[Column]:
    a = col(t)
    return [a[4 * i + 3] for i in range(3)]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def matvec(m: Mat, v: Vec) -> list[Column]:
    return [dot(row, v) for row in m]


def matmul(a: Mat, b: Mat) -> list[list[Column]]:
    return [[dot(row, [b[k][j] for k in range(len(b))]) for j in range(len(b[0]))] for row in a]


def transpose(m: Mat) -> list[list[Column]]:
    return [[m[j][i] for j in range(len(m))] for i in range(len(m[0]))]


def add(a: Vec, b: Vec) -> list[Column]:
    return [x + y for x, y in zip(a, b)]


def sub(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def scale(a: Vec, s: Column) -> list[Column]:
    return [x * s for x in a]


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def pack(m: Mat) -> Column:
    return F.array(*[x for row in m for x in row])


def pose(r: Mat, t: Vec) -> Column:
    """Row-major 4x4 array from rotation and translation."""
    rows = [[*r[i], t[i]] for i in range(3)] + [[F.lit(0.0)] * 3 + [F.lit(1.0)]]
    return pack(rows)


def rigid_inverse(t: str | Column) -> Column:
    """Inverse of a rigid 4x4 pose: (R^T, -R^T t)."""
    rt = transpose(rot_of(t))
    return pose(rt, [-x for x in matvec(rt, trans_of(t))])


def finite(c: str | Column) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def angle_deg(cos: Column) -> Column:
    return F.degrees(F.acos(clamp(cos, -1.0, 1.0)))


def rotation_angle(a: Mat, b: Mat) -> Column:
    """Angle in degrees between two rotations; trace(A^T B) is the elementwise product sum."""
    tr = None
    for i in range(3):
        for j in range(3):
            term = a[i][j] * b[i][j]
            tr = term if tr is None else tr + term
    return angle_deg((tr - 1.0) / 2.0)


def quat_to_mat(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation of a quaternion; it is normalised by its squared length, so any non-zero scale works."""
    k = 2.0 / (w * w + x * x + y * y + z * z)
    return [
        [1.0 - k * (y * y + z * z), k * (x * y - w * z), k * (x * z + w * y)],
        [k * (x * y + w * z), 1.0 - k * (x * x + z * z), k * (y * z - w * x)],
        [k * (x * z - w * y), k * (y * z + w * x), 1.0 - k * (x * x + y * y)],
    ]


def uniform(seed: int | Column, *keys: str | Column) -> Column:
    """Uniform number in [0, 1) from the keys and a seed: the first 52 bits of an MD5, so any engine can repeat it."""
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    text = F.concat_ws(":", *[col(k).cast("string") for k in keys], s)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def gauss(seed: int, *keys: str | Column) -> Column:
    """Standard normal by Box-Muller from two hashed uniforms."""
    u1 = uniform(2 * seed + 1, *keys)
    u2 = uniform(2 * seed + 2, *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * math.pi * u2)
