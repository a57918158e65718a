"""Walks and chunk ordering against plain Python on a small graph."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from aerolake.functions import ranking
from aerolake.operators import graphs as G
from aerolake.operators import partition as D
from aerolake.plans.fixtures import view

N, LO, HI, K, T = 6, 0.2, 0.95, 4, 0.7


def uniform(seed, *keys):
    text = ":".join(str(k) for k in (*keys, seed))
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def graph():
    rng = np.random.default_rng(3)
    e = {(i, j): float(rng.random()) for i in range(20) for j in range(20) if i != j and rng.random() < 0.35}
    return e


def effective(e):
    out = {}
    for (i, j), w in e.items():
        m = max(w, e.get((j, i), w))
        if LO <= m < HI - 1e-12:
            out.setdefault(i, []).append((-m, j))
    return {i: sorted(v) for i, v in out.items()}


def draw(nbrs, k, seed, sid, att, step):
    if len(nbrs) <= k:
        return [d for _, d in nbrs]
    key = lambda s: (s[0] / T + math.log(-math.log(max(uniform(seed, sid, att, step, s[1]), 1e-18))), s[1])
    return [d for _, d in sorted(nbrs, key=key)[:k]]


def frames(spark):
    e = graph()
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in e.items()], "src long, dst long, w double")
    return e, edges, spark.createDataFrame([(s,) for s in range(12)], "seed_id long")


def paths(df):
    p = df.toPandas().sort_values(["seed_id", "pos"])
    return p.groupby("seed_id").node.apply(list).to_dict()


def test_random_walk(spark):
    e, edges, seeds = frames(spark)
    adj, nodes = effective(e), sorted({x for k in e for x in k})
    want = {}
    for sid in range(12):
        tried, best = set(), []
        for att in range(4):
            free = [n for n in nodes if n not in tried]
            if not free:
                break
            start = free[int(uniform(5, sid, att) * len(free))]
            path, stack, step = [start], [start], 0
            while len(path) < N and stack:
                pick = lambda n: [s for s in adj.get(n, []) if s[1] not in path][:K]
                first = pick(start)
                cand = first if uniform(7, sid, att, step) < 0.1 and first else pick(stack[-1])
                got = draw(cand, 1, 6, sid, att, step)
                step += 1
                if got:
                    path += got
                    stack += got
                else:
                    stack.pop()
            if len(path) > len(best):
                best = path
            if len(path) >= N:
                break
            tried |= set(path)
        want[sid] = best
    assert paths(G.sample_random_walk(edges, seeds, N, LO, HI, K, T, seed=5)) == want


def test_tree(spark):
    e, edges, seeds = frames(spark)
    adj, nodes = effective(e), sorted({x for k in e for x in k})
    strong = lambda u, c: max(e.get((u, c), 0), e.get((c, u), 0)) >= HI - 1e-12
    trunk = min(max(2, math.ceil(N * 0.5)), N)
    want = {}
    for sid in range(12):
        best = []
        for att in range(4):
            path = [nodes[int(uniform(5, sid, att) * len(nodes))]]
            while len(path) < trunk:
                c = [d for _, d in adj.get(path[-1], [])[:K] if d not in path and (len(path) < 2 or not any(strong(u, d) for u in path))]
                if not c:
                    break
                path.append(c[0])
            i = 0
            while len(path) < N and i < len(path):
                c = [s for s in adj.get(path[i], []) if s[1] not in path][:K]
                path += draw(c, min(2, N - len(path), len(c)), 6, sid, att, i)
                i += 1
            if len(path) > len(best):
                best = path
            if len(path) >= N:
                break
        want[sid] = best
    assert paths(G.sample_tree(edges, seeds, N, LO, HI, K, T, trunk_ratio=0.5, seed=5)) == want


def test_mixed_covers_every_seed(spark):
    _, edges, seeds = frames(spark)
    got = G.sample_mixed(edges, seeds, N, seed=5, lo=LO, hi=HI, topk=K).toPandas()
    assert set(got.seed_id) == set(range(12)) and got.groupby("seed_id")["mode"].nunique().eq(1).all()
    assert not got.duplicated(["seed_id", "node"]).any()


def test_order_spatial_matches_queue(spark):
    rng = np.random.default_rng(9)
    rows, adj, want = [], [], {}
    cams = []
    for scene in (0, 1):
        c = rng.uniform(0, 100, (9, 3))
        comp = [set(range(5)), set(range(5, 9))] if scene else [set(range(9))]
        nb = {i: [] for i in range(9)}
        for group in comp:
            g = sorted(group)
            for a, b in zip(g, g[1:]):
                nb[a].append(b)
                nb[b].append(a)
        for i in nb:
            nb[i].sort(key=lambda j: (np.linalg.norm(c[i] - c[j]), j))
            adj += [(scene, i, j, float(np.linalg.norm(c[i] - c[j])), r) for r, j in enumerate(nb[i])]
        rows += [(scene, i, *map(float, c[i])) for i in range(9)]
        cams += [(scene, [float(v) for v in (1, 0, 0, p[0], 0, 1, 0, p[1], 0, 0, 1, p[2], 0, 0, 0, 1)]) for p in c]
        home = c.mean(0)
        queue, seen = [int(np.argmin(np.linalg.norm(c - home, axis=1)))], []
        while len(seen) < 9:
            if not queue:
                mean = c[seen].mean(0)
                rest = [i for i in range(9) if i not in seen]
                queue = [min(rest, key=lambda i: (np.linalg.norm(c[i] - mean), np.linalg.norm(c[i] - home), i))]
            cur = queue.pop(0)
            if cur not in seen:
                seen.append(cur)
                queue += [j for j in nb[cur] if j not in seen]
        want.update({(scene, i): k for k, i in enumerate(seen)})
    cen = spark.createDataFrame(rows, "scene long, chunk_id long, cx double, cy double, cz double")
    a = spark.createDataFrame(adj, "scene long, chunk_id long, other long, dist double, rank int")
    got = D.order_spatial(cen.select("scene", "chunk_id"), a, cen, spark.createDataFrame(cams, "scene long, t_c2w array<double>"))
    assert {(r.scene, r.chunk_id): r.exec_order for r in got.collect()} == want


def test_temporal_chunks_cover_frames(spark):
    f = spark.createDataFrame([(s, i) for s, n in ((0, 5), (1, 20), (2, 47)) for i in range(n)], "scene long, frame int")
    got = D.temporal_chunks(f, 20, 0.25).toPandas()
    core = got[got.role == "core"]
    assert len(core) == 72 and not core.duplicated(["scene", "frame"]).any()
    assert got.groupby(["scene", "chunk_id"]).size().max() == 20


def test_edges_are_dealt_over_tasks_by_their_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ranking, "TASK_ROWS", 5)
    rows = [(o, s, 1) for o in range(12) for s in ((o % 5, o % 3 + 5, 9) if o % 4 else (2, 2, None))] + [(None, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    sets = {}
    for o, s, _ in rows:
        if o is not None and s is not None:
            sets.setdefault(o, set()).add(s)
    for name, key in (("fx_edges", lambda o: ()), ("fx_scene_edges", lambda o: (o % 3,))):
        n, c = Counter(), Counter()
        for o, l in sets.items():
            n.update((*key(o), s) for s in l)
            c.update((*key(o), s, t) for s in l for t in l if s != t)
        edges = view(spark, str(tmp_path), name)
        assert {tuple(r)[:-1]: r.w for r in edges.collect()} == {k: v / n[k[:-1]] for k, v in c.items()}
        e = edges.localCheckpoint()
        # four shuffle partitions in this session
        assert e.rdd.getNumPartitions() == -(-sum(c.values()) // 5) > 4
        assert G.covis_edges(e, by=["scene"] if "scene" in e.columns else []).rdd.getNumPartitions() == -(-len(c) // 5) > 4


def test_lower_bound_is_applied_before_the_join_of_directions(spark, monkeypatch):
    """One direction below the bound, one absent, loops, and few or many strong edges: as without the first cut."""
    import random

    rng = random.Random(4)
    w = {(s, a, b): rng.choice((0.001, 0.01, 0.02, 0.05, 0.08)) for s in (0, 1) for a in range(12) for b in range(12) if rng.random() < 0.5}
    edges = spark.createDataFrame([(*k, v) for k, v in w.items()], "scene long, src long, dst long, w double")
    rows = []
    monkeypatch.setattr(G, "deal", lambda df, n, *keys: rows.append(df.count()) or df)
    for few in (200_000, 0):
        monkeypatch.setattr(G, "FEW_ROWS", few)
        for mode, lo in (("max", 0.08), ("max", 0.001), ("mean", 0.07), ("mean", 7.0)):
            rows.clear()
            got = {(r.scene, r.src, r.dst): r.w for r in G.covis_edges(edges, mode, lo, by=["scene"]).collect()}
            if (mode, lo, few) == ("max", 0.08, 200_000):
                assert rows and max(rows) < len(w) / 1.4
            if mode == "max":
                want = {k: max(v, w.get((k[0], k[2], k[1]), v)) for k, v in w.items() if k[1] != k[2]}
                want = {k: v for k, v in want.items() if v >= lo}
            else:
                keys = {(s, *p) for s, a, b in w if a != b for p in ((a, b), (b, a))}
                want = {k: (w.get(k, 0) + w.get((k[0], k[2], k[1]), 0)) / 2 / (w.get((k[0], k[1], k[1]), 1) + G.SELF_EPS) for k in keys}
                want = {k: v for k, v in want.items() if v > lo}
            assert got == want


def test_mixture_reads_its_graph_once(spark, monkeypatch):
    edges = spark.range(40).selectExpr("id AS src", "(id * 7 + 3) % 40 AS dst", "(id % 9) / 10D AS w")
    seeds = spark.range(60).selectExpr("id AS seed_id")
    calls = []
    covis = G.covis_edges
    monkeypatch.setattr(G, "covis_edges", lambda *a, **k: calls.append(1) or covis(*a, **k))
    got = G.sample_mixed(edges, seeds, 4, lo=0.1, hi=0.75, topk=3).collect()
    assert len({r["mode"] for r in got}) == 4 and len(calls) == 1
