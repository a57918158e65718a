"""Merge trees against plain merges one after another, and the number of written tables against the length of a chain."""

import numpy as np
import pytest

from aerolake.operators import hierarchy as H
from aerolake.operators import mergetree as M

PIX = 4


def scene(seed, n, overlap):
    """Members {(chunk, frame): role} and points {(chunk, frame, y, x): xyz}: noisy, so it matters which chunk stands for a frame."""
    rng = np.random.default_rng(seed)
    members, points = {}, {}
    for c in range(n):
        for f in range(2 * c, 2 * c + 2 + overlap):
            if f < 2 * n + overlap - 1:
                members[c, f] = "core" if f // 2 == c else "overlap"
    for c, f in members:
        shift = np.array([c, -2.0 * c, 0.5 * c])
        for y in range(PIX):
            for x in range(PIX):
                if rng.random() < 0.9:
                    points[c, f, y, x] = np.array([f, y, x]) - shift + rng.normal(0, 0.1, 3)
    return members, points


def tables(spark, scenes):
    rows = [(s, c, f, r) for s, (m, _) in scenes.items() for (c, f), r in m.items()]
    pts = [(s, *k, True, *map(float, v)) for s, (_, p) in scenes.items() for k, v in p.items()]
    return (spark.createDataFrame(rows, "scene long, chunk_id long, frame int, role string"),
            spark.createDataFrame(pts, "scene long, chunk_id long, frame int, y int, x int, valid boolean, px double, py double, pz double"))


def own_merge(members, points, merges):
    """Shifts by chunk after ``merges``: (child chunks, anchor chunks) in order, each fitted by the median shift."""
    at = {c: np.zeros(3) for c, _ in members}
    counts = []

    def pick(group):
        out = {}
        for (c, f), role in members.items():
            if c in group:
                out[f] = min(out.get(f, (9, 0)), (role != "core", c))
        return {f: c for f, (_, c) in out.items()}

    for child, anchor in merges:
        src, dst = pick(child), pick(anchor)
        size = lambda c, f: tuple(max((k[i] for k in points if k[:2] == (c, f)), default=-1) for i in (2, 3))
        diffs = [points[dst[f], f, y, x] + at[dst[f]] - points[src[f], f, y, x] - at[src[f]] for f in src if f in dst and size(src[f], f) == size(dst[f], f)
                 for y in range(PIX) for x in range(PIX) if (src[f], f, y, x) in points and (dst[f], f, y, x) in points]
        counts.append(len(diffs))
        if len(diffs) >= 5:
            for c in child:
                at[c] = at[c] + np.median(diffs, axis=0)
    return at, counts


def graph_merges(parent, level):
    group = {c: c for c in parent}
    for lv in sorted(set(level.values()), reverse=True):
        for c in sorted(c for c in parent if parent[c] is not None and level[c] == lv):
            yield [x for x in group if group[x] == c], [x for x in group if group[x] == parent[c]]
            group = {x: parent[c] if g == c else g for x, g in group.items()}


def compare(tf, edges, scenes, want):
    got = {(r.scene, r.chunk_id): np.array(r.t) for r in tf.collect()}
    assert set(got) == {(s, c) for s in scenes for c, _ in scenes[s][0]}
    for s, (at, counts) in want.items():
        assert sorted(r.n for r in edges.collect() if r.scene == s) == sorted(counts)
        for c, t in at.items():
            np.testing.assert_allclose(got[s, c], t, atol=1e-9)


@pytest.mark.parametrize("overlap", [1, 4])
def test_parent_graph(spark, overlap):
    scenes = {s: scene(s, 9, overlap) for s in (0, 1)}
    chain = ({c: c - 1 if c else None for c in range(9)}, {c: c for c in range(9)})
    parent = {0: None, 1: 0, 2: 1, 3: 1, 4: 0, 5: 4, 6: 2, 7: 2, 8: 5}
    tree = (parent, {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 2, 6: 3, 7: 3, 8: 3})
    shapes = {0: chain, 1: tree}
    rows = [(s, c, p[c], lv[c]) for s, (p, lv) in shapes.items() for c in p]
    chunks = spark.createDataFrame(rows, "scene long, chunk_id long, parent_id long, level int")
    members, points = tables(spark, scenes)
    tf, edges = H.align_parent_graph(chunks, members, points, "translation", 5)
    compare(tf, edges, scenes, {s: own_merge(*scenes[s], graph_merges(*shapes[s])) for s in scenes})


def test_hierarchy(spark):
    scenes = {s: scene(s + 5, 7, 5) for s in (0, 1)}
    keys = {0: {c: [c // 4, c // 2 % 2, c % 2] for c in range(7)}, 1: {c: [c % 3] if c < 5 else [c % 3, c] for c in range(7)}}
    chunks = spark.createDataFrame([(s, c, k) for s in keys for c, k in keys[s].items()], "scene long, chunk_id long, key array<int>")

    def merges(key):
        same = {}
        for c in sorted(key):
            same.setdefault(tuple(key[c]), []).append(c)
        nodes = {}
        for k, cs in same.items():
            for i, c in enumerate(cs):
                nodes[k + (i,) if len(cs) > 1 else k] = [c]
        while len(nodes) > 1:
            groups = {}
            for k, cs in nodes.items():
                groups.setdefault(k[:-1], []).append((-len(cs), list(k), cs))
            nodes = {}
            for up, kids in groups.items():
                kids.sort(key=lambda x: x[:2])
                joined = list(kids[0][2])
                for _, _, cs in kids[1:]:
                    yield list(cs), list(joined)
                    joined += cs
                nodes[up] = joined

    members, points = tables(spark, scenes)
    tf, edges = H.align_hierarchy(chunks, members, points, "translation", 5)
    compare(tf, edges, scenes, {s: own_merge(*scenes[s], merges(keys[s])) for s in scenes})


def test_work_grows_with_the_logarithm_of_a_chain(spark, monkeypatch):
    written = []
    real = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name="step": written.append(name) or real(df, name))
    counts = []
    for n in (6, 24):
        members, points = tables(spark, {0: scene(1, n, 1)})
        chunks = spark.createDataFrame([(0, c, c - 1 if c else None, c) for c in range(n)], "scene long, chunk_id long, parent_id long, level int")
        written.clear()
        tf, _ = H.align_parent_graph(chunks, members, points, "translation", 5)
        assert tf.count() == n and written.count("fitted") == 2  # one round of fits
        counts.append(len(written))
    assert counts[1] - counts[0] <= 6


def test_lone_chunks_and_empty_trees(spark):
    members, points = tables(spark, {0: scene(1, 2, 1)})
    chunks = spark.createDataFrame([(0, 0, None, 0), (0, 1, None, 0), (7, 3, None, 0)], "scene long, chunk_id long, parent_id long, level int")
    tf, edges = H.align_parent_graph(chunks, members, points)
    assert tf.count() == 3 and edges.count() == 0
    assert H.align_parent_graph(chunks.limit(0), members, points)[0].count() == 0
