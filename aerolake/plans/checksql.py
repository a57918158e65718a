"""Pieces of SQL shared by the check statements: similarity fits without an SVD, pose views, rounding."""

from __future__ import annotations

# Poses of the trajectory views: rotation about z by an angle, times diag(1, -1, -1). ca, sa are its cosine and sine.
POSES = """
gtp AS (SELECT scene, frame, 'f' || lpad(CAST(frame AS VARCHAR), 5, '0') AS stem, cx, cy, cz,
  cos(0.1::DOUBLE * (frame % 5)) AS ca, sin(0.1::DOUBLE * (frame % 5)) AS sa FROM {fx_cams}),
prp AS (SELECT scene, frame, 'f' || lpad(CAST(frame AS VARCHAR), 5, '0') AS stem, cx, cy, cz,
  cos(atan2(0.8::DOUBLE, 0.6::DOUBLE) + 0.1::DOUBLE * (frame % 5) + 0.002::DOUBLE * (frame % 3)) AS ca,
  sin(atan2(0.8::DOUBLE, 0.6::DOUBLE) + 0.1::DOUBLE * (frame % 5) + 0.002::DOUBLE * (frame % 3)) AS sa FROM {fx_pred}),
corr AS (SELECT p.scene, p.frame, p.cx AS sx, p.cy AS sy, p.cz AS sz, g.cx AS dx, g.cy AS dy, g.cz AS dz,
  p.ca AS pca, p.sa AS psa, g.ca AS gca, g.sa AS gsa FROM prp p JOIN gtp g USING (scene, frame))"""


def rnd(expr: str, alias: str, digits: int = 6) -> str:
    """Rounded output column without a negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END AS {alias}"


def horn(corr: str, by: str, name: str = "sim", with_scale: bool = True, rounds: int = 40) -> str:
    """CTEs that fit a similarity per group by the quaternion method.

    The top eigenvector of the 4x4 profile matrix comes from repeated squaring in a recursive CTE. Result table
    ``name``: by, n, s, r00..r22, t0..t2, valid.
    """
    a = ["xx", "xy", "xz", "yx", "yy", "yz", "zx", "zy", "zz"]
    cov = ", ".join(f"covar_pop(d{c[1]}, s{c[0]}) AS h{c}" for c in a)
    ent = {
        "00": "hxx + hyy + hzz", "01": "hyz - hzy", "02": "hzx - hxz", "03": "hxy - hyx",
        "11": "hxx - hyy - hzz", "12": "hxy + hyx", "13": "hzx + hxz", "22": "-hxx + hyy - hzz", "23": "hyz + hzy",
        "33": "-hxx - hyy + hzz",
    }
    shift = "(1e-30 + 3 * (" + " + ".join(f"abs(h{c})" for c in a) + "))"
    key = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    init = ", ".join(f"(({e}){' + ' + shift if k[0] == k[1] else ''}) / (4 * {shift}) AS m{k}" for k, e in ent.items())
    prod = {k: " + ".join(f"{key(int(k[0]), q)} * {key(q, int(k[1]))}" for q in range(4)) for k in ent}
    tr = " + ".join(f"({prod[f'{i}{i}']})" for i in range(4))
    step = ", ".join(f"({prod[k]}) / ({tr}) AS m{k}" for k in ent)
    big = "greatest(m00, m11, m22, m33)"
    q = [f"CASE WHEN m00 = {big} THEN {key(0, j)} WHEN m11 = {big} THEN {key(1, j)} WHEN m22 = {big} THEN {key(2, j)} "
         f"ELSE {key(3, j)} END AS q{j}" for j in range(4)]
    nn = "(q0*q0 + q1*q1 + q2*q2 + q3*q3)"
    rot = {
        "r00": f"1 - 2*(q2*q2 + q3*q3)/{nn}", "r01": f"2*(q1*q2 - q0*q3)/{nn}", "r02": f"2*(q1*q3 + q0*q2)/{nn}",
        "r10": f"2*(q1*q2 + q0*q3)/{nn}", "r11": f"1 - 2*(q1*q1 + q3*q3)/{nn}", "r12": f"2*(q2*q3 - q0*q1)/{nn}",
        "r20": f"2*(q1*q3 - q0*q2)/{nn}", "r21": f"2*(q2*q3 + q0*q1)/{nn}", "r22": f"1 - 2*(q1*q1 + q2*q2)/{nn}",
    }
    ax = "xyz"
    # trace(R^T cov) / variance
    gain = " + ".join(f"r{i}{j} * h{ax[j]}{ax[i]}" for i in range(3) for j in range(3))
    s = f"({gain}) / var" if with_scale else "1.0::DOUBLE"
    trs = ", ".join(
        f"md{ax[i]} - s0 * (" + " + ".join(f"r{i}{j} * ms{ax[j]}" for j in range(3)) + f") AS t{i}" for i in range(3))
    ok = "n >= 3 AND var > 1e-12"
    outs = ", ".join([f"CASE WHEN {ok} THEN s0 ELSE 1.0 END AS s"]
                     + [f"CASE WHEN {ok} THEN r{i}{j} ELSE {float(i == j)} END AS r{i}{j}" for i in range(3) for j in range(3)]
                     + [f"CASE WHEN {ok} THEN t{i} ELSE 0.0 END AS t{i}" for i in range(3)])
    return f"""
{name}_mom AS (SELECT {by}, count(*) AS n, avg(sx) AS msx, avg(sy) AS msy, avg(sz) AS msz, avg(dx) AS mdx, avg(dy) AS mdy,
  avg(dz) AS mdz, var_pop(sx) + var_pop(sy) + var_pop(sz) AS var, {cov} FROM {corr} GROUP BY {by}),
{name}_it AS (SELECT {by}, 0 AS it, {init} FROM {name}_mom
  UNION ALL SELECT {by}, it + 1, {step} FROM {name}_it WHERE it < {rounds}),
{name}_q AS (SELECT {by}, {', '.join(q)} FROM {name}_it WHERE it = {rounds}),
{name}_r AS (SELECT {by}, {', '.join(f'{e} AS {k}' for k, e in rot.items())} FROM {name}_q),
{name}_s AS (SELECT *, {s} AS s0 FROM {name}_mom JOIN {name}_r USING ({by})),
{name}_t AS (SELECT *, {trs} FROM {name}_s),
{name} AS (SELECT {by}, n, ({ok}) AS valid, {outs} FROM {name}_t)"""


def moved(i: int, t: str = "") -> str:
    """Coordinate i of the moved source point."""
    return f"({t}s * ({t}r{i}0 * sx + {t}r{i}1 * sy + {t}r{i}2 * sz) + {t}t{i})"


def rot_error() -> str:
    """Angle between the reference rotation and fit rotation times predicted rotation, both about z times diag(1,-1,-1)."""
    g = [["gca", "gsa", "0"], ["gsa", "-gca", "0"], ["0", "0", "-1"]]
    p = [["pca", "psa", "0"], ["psa", "-pca", "0"], ["0", "0", "-1"]]
    terms = []
    for i in range(3):
        for j in range(3):
            if g[i][j] != "0":
                terms.append(f"({g[i][j]}) * (" + " + ".join(f"r{i}{k} * ({p[k][j]})" for k in range(3) if p[k][j] != "0") + ")")
    return f"degrees(acos(greatest(-1, least(1, ({' + '.join(terms)} - 1) / 2))))"


SUMMARY = """count(value) AS num, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rmse,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90,
  round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max"""
