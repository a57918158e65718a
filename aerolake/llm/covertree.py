"""Near-duplicate vectors of equal label: exact threshold pairs by dual traversal of cover trees.

On unit vectors cosine >= c is chord distance <= sqrt(2 - 2c), a metric, so covering radii bound what a pair of nodes can
hold. Vectors of a label are dealt to cells around pivots and cells to blocks of about ``BLOCK`` rows; every block gets a
cover tree with nested levels of halving radii. Blocks are dealt to tiles of about ``TILE`` bytes, and a block goes once to
every tile of its label that holds a block whose covering ball comes within the threshold, not once to every such block: what
is shuffled grows with the tiles a block meets. The trees of two blocks that meet are walked level by level, all node pairs of
a level at once: a pair is pruned if its balls are too far apart, accepted whole if its balls lie within the threshold, and
opened otherwise. What is left where nodes are no longer much fewer than points is decided by the cosine itself: in single
precision where it is farther from the threshold than rounding reaches, else in double precision.

A pair of tiles gives one row per linked vector (its count of links, and one vector of its part of the links),
never one per pair, so a group of copies costs no rows beyond its members. Counts are summed, parts are joined to
components in tables.

Pivots are a sample of at most ``PIVOTS`` rows; they only steer which rows share a block, every row is compared exactly.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, and those with a NULL label or
id, are linked with nothing; vectors of different length are not compared; a row that is repeated as a whole counts as one
vector; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import usable_vectors
from aerolake.llm.components import components
from aerolake.session import materialize

BLOCK, PIVOTS = 512, 4096
#: Bytes of vectors of a tile, block roots that one task compares with as many, tiles of a small label for the sake of parallel work.
TILE, STRIP, LEAST_TILES = 16 << 20, 2048, 4
#: Radii of the levels below the root, and the slack for rounding in distances.
RADII, SLACK = (1.0, 0.5, 0.25, 0.125), 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the largest component first, against overflow."""
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def build(u: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nested levels of a cover tree: per level the node of every point, and the centre (a point) of every node.

    Level 0 is one node. A node keeps its centre at the next level; members beyond the halved radius get new centres
    greedily, in the order of the points.
    """
    d = _chords(u, u)
    nodes, centres = [np.zeros(len(u), np.int64)], [np.zeros(1, np.int64)]
    for radius in RADII:
        node, centre = np.full(len(u), -1), []
        for k, first in enumerate(centres[-1]):
            left = np.flatnonzero(nodes[-1] == k)
            c = first
            while len(left):
                near = d[c, left] <= radius
                near |= left == c
                node[left[near]] = len(centre)
                centre.append(c)
                left = left[~near]
                c = left[0] if len(left) else -1
        nodes.append(node)
        centres.append(np.array(centre))
    return nodes, centres


def _radii(u: np.ndarray, nodes: list[np.ndarray], centres: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for node, centre in zip(nodes, centres):
        gap = u - u[centre][node]
        r = np.zeros(len(centre))
        np.maximum.at(r, node, np.sqrt((gap * gap).sum(axis=1)))
        out.append(r)
    return out


def _tree(u: np.ndarray, nodes: list[np.ndarray], centres: list[np.ndarray]) -> tuple:
    """A tree with what every walk needs of it: points, nodes, centres, radii, points in single precision."""
    return u, nodes, centres, _radii(u, nodes, centres), u.astype(np.float32)


def linked(a: tuple, b: tuple, cosine: float) -> np.ndarray:
    """Matrix of links between the points of two trees (unit vectors, nodes, centres), by dual traversal."""
    (ua, na, ca, ra, fa), (ub, nb, cb, rb, fb) = (t if len(t) == 5 else _tree(*t) for t in (a, b))
    limit = math.sqrt(2 - 2 * cosine)
    out, open_, at = np.zeros((len(ua), len(ub)), bool), np.ones((1, 1), bool), 0
    for level in range(len(ca)):
        if level and 2 * len(ca[level]) * len(cb[level]) > out.size:
            break  # about as many pairs of nodes as of points
        if level:  # children of the pairs that stayed open; a node's parent is that of its centre
            open_ = open_[np.ix_(na[at][ca[level]], nb[at][cb[level]])]
        at = level
        d = _chords(ua[ca[level]], ub[cb[level]])
        reach = ra[level][:, None] + rb[level][None, :]
        whole = open_ & (d + reach <= limit - SLACK)
        if whole.any():
            out |= whole[np.ix_(na[level], nb[level])]
        open_ = open_ & ~whole & (d <= limit + reach + SLACK)
        if not open_.any():
            return out
    rounding = (ua.shape[1] + 4) * 2.0**-23
    maybe = fa @ fb.T >= np.float32(cosine - rounding)
    if not open_.all():
        maybe &= open_[np.ix_(na[at], nb[at])]
    i, j = np.divmod(np.flatnonzero(maybe), maybe.shape[1])
    if 8 * len(i) > maybe.size:
        return out | (maybe & (ua @ ub.T >= cosine))
    sure = (ua[i] * ub[j]).sum(axis=1) >= cosine
    out[i[sure], j[sure]] = True
    return out


def _parts(links: np.ndarray, rows: np.ndarray, cols: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label reachable over the links of one matrix, for its rows and columns, which come with labels."""
    none = max(rows.max(), cols.max()) + 1
    while True:
        new_cols = np.minimum(cols, np.where(links, rows[:, None], none).min(axis=0))
        new_rows = np.minimum(rows, np.where(links, new_cols[None, :], none).min(axis=1))
        if square:
            new_cols = new_rows
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while (parent[at] != at).any():
        at = parent[at]
    return at


def _united(parent: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
    """Unite the roots ``old`` with the roots ``new``."""
    pairs = np.unique(np.stack([old, new], axis=1)[old != new], axis=0)
    for pair in pairs:
        x, y = _roots(parent, pair)
        parent[max(x, y)] = min(x, y)


def _pivots(rows: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Per (label, length) unit pivots from a bounded sample: about one per BLOCK rows, PIVOTS at most."""
    n = min(PIVOTS, -(-rows.count() // BLOCK))
    out: dict[tuple[int, int], list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect():
        out.setdefault((r["label"], len(r["embedding"])), []).append(r["embedding"])
    return {k: unit(np.array(v)) for k, v in out.items()}


def _celled(rows: DataFrame, pivots: dict) -> DataFrame:
    """Adds ``dim`` and ``cell``, the nearest pivot of the label."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def run(parts):
        for p in parts:
            p = p.assign(dim=p.embedding.map(len).astype("int32"), cell=np.int32(0))
            for key, at in p.groupby(["label", "dim"]).indices.items():
                if (own := held.value.get((int(key[0]), int(key[1])))) is not None:
                    u = unit(np.stack(p.embedding.to_numpy()[at]))
                    p.iloc[at, p.columns.get_loc("cell")] = (u @ own.T).argmax(axis=1).astype("int32")
            yield p

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInPandas(run, f"vec_id long, embedding {kind}, label long, dim int, cell int")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block: block (id), label, dim, ids, vectors (as given), tree, root and reach."""
    kind = "float32" if "float" in rows.schema["embedding"].dataType.simpleString() else "float64"
    by = ["label", "dim", "cell"]
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("k"))
    # written out, its size is known: vectors are not shuffled to meet it
    rows = rows.join(materialize(sizes, "cover-sizes"), by).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("k")))

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("vec_id").sort_values("vec_id")
        given = np.stack(p.embedding.to_numpy())
        u = unit(given)
        nodes, centres = build(u)
        reach = float(_radii(u, nodes[:1], centres[:1])[0][0])
        first = p.iloc[0]
        return pd.DataFrame([{
            "block": f"{first.label}:{first.dim}:{first.cell}:{first.salt}", "label": first.label, "dim": first.dim, "ids": p.vec_id.to_numpy(),
            "vectors": given.astype(kind).tobytes(), "kind": kind, "nodes": [n.astype("int32") for n in nodes], "centres": [c.astype("int32") for c in centres],
            "root": u[0], "reach": reach}])

    return rows.groupBy(*by, "salt").applyInPandas(
        pack, "block string, label long, dim int, ids array<long>, vectors binary, kind string, nodes array<array<int>>, centres array<array<int>>, "
        "root array<double>, reach double")


def _paired(df: DataFrame, part: str, parts: str) -> DataFrame:
    """Every row once per pair (p, q), p <= q, of the parts 0 .. parts - 1 that its own part is in."""
    other = df.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
    return other.withColumns({"p": F.least(part, "__o"), "q": F.greatest(part, "__o")}).drop("__o")


def _meetings(blocks: DataFrame, cosine: float) -> DataFrame:
    """(block, p, q): the pairs of tiles, p <= q, in which a block meets another within reach, or itself."""
    limit, by = math.sqrt(2 - 2 * cosine) + SLACK, ["label", "dim"]
    roots = blocks.select(*by, "block", "root", "reach", F.octet_length("vectors").alias("size"))
    sums = roots.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    labels = max(1, sums.count())
    least = min(LEAST_TILES, math.ceil(math.sqrt(4 * roots.sparkSession.sparkContext.defaultParallelism / labels)))
    sums = sums.select(*by, F.least("n", F.greatest(F.ceil(F.col("size") / TILE), F.lit(least))).cast("long").alias("tiles"),
                       F.ceil(F.col("n") / STRIP).cast("long").alias("strips"))
    placed = roots.drop("size").join(sums, by).withColumns({
        "tile": F.pmod(F.xxhash64("block"), F.col("tiles")), "strip": F.pmod(F.xxhash64(F.lit(1), "block"), F.col("strips"))})

    def meet(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        one, two = p[p.strip == key[2]], p[p.strip == key[3]]
        near = _chords(np.stack(one.root.to_numpy()), np.stack(two.root.to_numpy())) <= limit + one.reach.to_numpy()[:, None] + two.reach.to_numpy()[None, :]
        out = []
        for mine, others, hit in ((one, two, near), (two, one, near.T)):
            tiles, at = np.unique(others.tile.to_numpy(), return_inverse=True)
            met = np.zeros((len(mine), len(tiles)), np.float32)
            for k in range(len(tiles)):
                met[:, k] = hit[:, at == k].any(axis=1)
            i, k = np.nonzero(met)
            own = mine.tile.to_numpy()[i]
            out.append(pd.DataFrame({"block": mine.block.to_numpy()[i], "p": np.minimum(own, tiles[k]), "q": np.maximum(own, tiles[k])}))
        return pd.concat(out)

    strips = _paired(placed, "strip", "strips").select(*by, "p", "q", "block", "root", "reach", "tile", "strip")
    return strips.groupBy(*by, "p", "q").applyInPandas(meet, "block string, p long, q long").distinct(), placed.select("block", "tile")


def near_vectors(rows: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    good = usable_vectors(rows).where("vec_id IS NOT NULL AND label IS NOT NULL")
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    blocks = materialize(_blocks(_celled(good, _pivots(good))), "cover-blocks")
    meetings, tiles = _meetings(blocks, cosine)
    meetings = materialize(meetings.join(tiles, "block"), "cover-meetings")
    sides = blocks.select("block", "label", "dim", "ids", "vectors", "kind", "nodes", "centres").join(meetings, "block")

    def walk(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        trees, ids, start = [], [], [0]
        p = p.sort_values("block")
        for r in p.itertuples():
            u = unit(np.frombuffer(r.vectors, r.kind).reshape(-1, r.dim))
            trees.append(_tree(u, [np.asarray(n) for n in r.nodes], [np.asarray(c) for c in r.centres]))
            ids.append(np.asarray(r.ids))
            start.append(start[-1] + len(u))
        n, parent = np.zeros(start[-1], np.int64), np.arange(start[-1])
        first, last = np.flatnonzero(p.tile.to_numpy() == key[2]), np.flatnonzero(p.tile.to_numpy() == key[3])
        for i in first:
            for j in last:
                if key[2] == key[3] and j < i:
                    continue
                links = linked(trees[i], trees[j], cosine)
                if i == j:
                    np.fill_diagonal(links, False)
                if not links.any():
                    continue
                at, to = np.arange(start[i], start[i + 1]), np.arange(start[j], start[j + 1])
                n[at] += links.sum(axis=1)
                if i != j:
                    n[to] += links.sum(axis=0)
                old = _roots(parent, at), _roots(parent, to)
                parent[at], parent[to] = old
                new = _parts(links, *old, i == j)
                _united(parent, np.concatenate(old), np.concatenate(new))
        every, has = np.concatenate(ids), np.flatnonzero(n)
        return pd.DataFrame({"vec_id": every[has], "n": n[has], "part": every[_roots(parent, has)]})

    found = sides.groupBy("label", "dim", "p", "q").applyInPandas(walk, "vec_id long, n long, part long")
    found = materialize(found, "cover-links")
    comp = components(found.select(F.col("vec_id").alias("a"), F.col("part").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links")).join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id")).join(counts, "vec_id", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
