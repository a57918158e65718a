"""Covisibility edges and view sampling: all walks of all scenes advance together, one join per step.

``by`` names the columns that tell graphs apart (the scene, usually): edges and seeds carry them, node and seed ids need only be
unique within a graph, and every rank, draw and join is made within it. Without ``by`` all edges are one graph.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import linalg as L
from aerolake.functions.ranking import cap_per_group, deal, grouped_rank
from aerolake.session import materialize

# fixed values
EPS = 1e-12
SELF_EPS = 1e-8
MODES = ("anchor_star", "random_walk", "tree", "greedy_chain")
DEFAULT_MIX = (0.5, 0.25, 0.15, 0.10)
# rows of two ids and keys that every task may hold
FEW_ROWS = 200_000
_CUT_EVERY = 4


def covis_edges(edges: DataFrame, mode: str = "max", lo: float | None = None, hi: float | None = None, topk: int | None = None,
                bidirectional: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Effective edges (*by, src, dst, w).

    'max': the larger of both directions for every stored edge, kept in [lo, hi). 'mean': the mean of both directions
    (an absent one is 0) over the mean self-covisibility of the source (1 when absent), kept above ``lo``. ``topk`` keeps
    the strongest edges of a node, lower ids first among equals. ``edges`` is counted and read several times: pass a written table.
    """
    if bidirectional and lo is not None and lo > 0:
        edges = _within_reach(edges, mode, lo, by)
    e = edges.select(*by, "src", "dst", "w")
    back = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("wb"))
    if bidirectional:
        # the join sorts both directions of the edges: as many tasks as their number asks for
        rows = edges.count()
        e, back = (deal(x, rows, *by, "src", "dst") for x in (e, back))
    if mode == "max":
        out = e.where("src <> dst")
        if bidirectional:
            out = out.join(back, [*by, "src", "dst"], "left").withColumn("w", F.greatest("w", F.coalesce("wb", F.col("w")))).drop("wb")
        if lo is not None:
            out = out.where(F.col("w") >= lo)
        if hi is not None:
            out = out.where(F.col("w") < hi - EPS)
    elif mode == "mean":
        own = e.where("src = dst").select(*by, "src", F.col("w").alias("own"))
        out = e.where("src <> dst")
        if bidirectional:
            out = out.join(back.where("src <> dst"), [*by, "src", "dst"], "full").withColumn(
                "w", (F.coalesce("w", F.lit(0.0)) + F.coalesce("wb", F.lit(0.0))) / 2).drop("wb")
        out = out.join(own, [*by, "src"], "left").withColumn("w", F.col("w") / (F.coalesce("own", F.lit(1.0)) + SELF_EPS)).drop("own")
        if lo is not None:
            out = out.where(F.col("w") > lo)
    else:
        raise ValueError(f"unknown edge mode {mode}")
    return out if topk is None else cap_per_group(out, [*by, "src"], [-F.col("w"), "dst"], topk)


def _within_reach(edges: DataFrame, mode: str, lo: float, by: Sequence[str]) -> DataFrame:
    """The edges that can pass a lower bound above 0, as a written table, or all where that would not halve them. Neither the larger nor
    the mean of two directions exceeds both, so one of them has to reach the bound alone; both of its directions are kept, and
    self-covisibility."""
    key, bound = [*by, "src", "dst"], lo
    if mode == "mean":
        own = edges.where("src = dst").agg(F.min("w").alias("least"), F.max("w").alias("most")).first()
        bound = lo * (min(1.0, 1.0 if own.least is None else own.least) + SELF_EPS)
        if bound <= 0 or math.isnan(own.most or 0.0):
            return edges
    # the mean may round up to the bound
    some = edges.where((F.col("w") >= bound * (1 - 1e-9)) & (F.col("src") != F.col("dst"))).select(key)
    some = materialize(some.unionByName(some.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))), "strong-directions")
    rows, strong, kept = edges.count(), some.count(), edges.where("src <> dst")
    if 2 * strong > rows:
        return edges
    if strong > FEW_ROWS:
        kept, some = (deal(x, rows, *key) for x in (kept, some))
    else:
        some = F.broadcast(some)
    kept = kept.join(some, key, "left_semi").unionByName(edges.where("src = dst"))
    return materialize(kept.select(*key, "w"), "strong-edges")


def adjacency(edges: DataFrame, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, node, nbrs): at most ``limit`` strongest neighbours of a node, strongest first, as structs (nw = -w, dst)."""
    top = cap_per_group(edges, [*by, "src"], [-F.col("w"), "dst"], limit)
    nbrs = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("nw"), F.col("dst"))))
    return materialize(top.groupBy(*by, F.col("src").alias("node")).agg(nbrs.alias("nbrs")), "adjacency")


def _nodes(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, idx, node, n): nodes by their rank in their graph, and the number of its nodes."""
    ids = edges.select(*by, F.col("src").alias("node")).union(edges.select(*by, "dst")).distinct()
    ids = materialize(grouped_rank(ids, by, ["node"], "idx"), "nodes")
    if not by:
        return ids.withColumn("n", F.lit(ids.count()))
    return ids.join(ids.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), list(by))


def _sized(seeds: DataFrame, nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seeds of graphs that have nodes, with the number of these."""
    first = nodes.where("idx = 0").select(*by, "n")
    if by:
        return seeds.join(first, list(by))
    size = first.first()
    return seeds.withColumn("n", F.lit(size.n if size else 0)).where("n > 0")


class ViewGraph(NamedTuple):
    """What the samplers read of the edges, so that several of them share one pass: ranked nodes, neighbour lists of at most
    ``topk`` + ``n`` nodes, and pairs at or above the upper bound (None when there are none)."""

    nodes: DataFrame
    wide: DataFrame
    strong: DataFrame | None
    topk: int

    def narrow(self) -> DataFrame:
        """The ``topk`` strongest neighbours."""
        return self.wide.withColumn("nbrs", F.slice("nbrs", 1, self.topk))


def view_graph(edges: DataFrame, n: int, lo: float | None = None, hi: float | None = None, topk: int = 50, bidirectional: bool = True,
               by: Sequence[str] = ()) -> ViewGraph:
    """The tables the samplers walk on; ``edges`` is read several times: pass a written table."""
    nodes = materialize(_nodes(edges, by), "ranked-nodes")
    wide = adjacency(covis_edges(edges, "max", lo, hi, bidirectional=bidirectional, by=by), topk + n, by)
    return ViewGraph(nodes, wide, _strong_pairs(edges, hi, bidirectional, by), topk)


def seed_starts(edges: DataFrame, seeds: DataFrame, attempts: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, seed_id, attempt, start): a hashed start node for every attempt; seeds of graphs without nodes have none."""
    return _starts(materialize(_nodes(edges, by), "ranked-nodes"), seeds, attempts, seed, by)


def _starts(nodes: DataFrame, seeds: DataFrame, attempts: int, seed: int, by: Sequence[str]) -> DataFrame:
    a = _sized(seeds.select(*by, "seed_id"), nodes, by)
    a = a.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    a = a.withColumn("idx", F.floor(L.uniform(seed, *by, "seed_id", "attempt") * F.col("n"))).drop("n")
    return a.join(nodes, [*by, "idx"]).select(*by, "seed_id", "attempt", F.col("node").alias("start"))


def _gumbel(seed: int, t: float, step: Column, s: Column, by: Sequence[str]) -> Column:
    """Sort key of a neighbour for weighted draws without replacement (smallest first)."""
    u = L.uniform(seed, *by, F.col("seed_id"), F.col("attempt"), step, s["dst"])
    return s["nw"] / max(t, 1e-8) + F.log(-F.log(F.greatest(u, F.lit(1e-18))))


def _drawn(nbrs: Column, k: Column | int, seed: int, t: float, step: Column, by: Sequence[str]) -> Column:
    """Ids of ``k`` neighbours drawn by weight; all of them, in order, when there are no more than ``k``."""
    keyed = F.array_sort(F.transform(nbrs, lambda s: F.struct(_gumbel(seed, t, step, s, by).alias("g"), s["dst"].alias("dst"))))
    ids = F.transform(keyed, lambda s: s["dst"])
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(nbrs) <= k, F.transform(nbrs, lambda s: s["dst"])).otherwise(F.slice(ids, 1, F.greatest(k, F.lit(0))))


def _best(walks: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Of the attempts of a seed: the first full walk, else the longest, earlier first: (*by, seed_id, pos, node)."""
    full = F.size("path") >= n
    key = F.struct((~full).alias("f"), F.when(full, 0).otherwise(-F.size("path")).alias("l"), F.col("attempt").alias("a"))
    best = walks.groupBy(*by, "seed_id").agg(F.min_by("path", key).alias("path"))
    return best.select(*by, "seed_id", F.posexplode(F.slice("path", 1, n)).alias("pos", "node"))


def _run(state: DataFrame, steps: int, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    for i in range(steps):
        state = step(state, i)
        if (i + 1) % _CUT_EVERY == 0:
            state = materialize(state, "walks")
            if i + 1 < steps and state.where("NOT done").isEmpty():
                break
    return state


def _neighbours(state: DataFrame, adj: DataFrame, node: Column, by: Sequence[str]) -> DataFrame:
    """State with the neighbour list of a node; empty where it has none."""
    j = state.withColumn("node", node).join(adj, [*by, "node"], "left")
    return j.withColumn("nbrs", F.coalesce("nbrs", F.array().cast(adj.schema["nbrs"].dataType)))


def _unvisited(nbrs: Column, path: Column) -> Column:
    return F.filter(nbrs, lambda s: ~F.array_contains(path, s["dst"]))


def sample_anchor_star(edges: DataFrame, seeds: DataFrame, n: int, lo: float | None = None, hi: float | None = None, topk: int = 50,
                       temperature: float = 1.0, attempts: int = 4, bidirectional: bool = True, seed: int = 0, by: Sequence[str] = (),
                       graph: ViewGraph | None = None) -> DataFrame:
    """An anchor and up to n - 1 of its strongest neighbours, drawn by softmax weight: (*by, seed_id, pos, node)."""
    g = graph or view_graph(edges, n, lo, hi, topk, bidirectional, by)
    s = _neighbours(_starts(g.nodes, seeds, attempts, seed, by), g.narrow(), F.col("start"), by)
    path = F.concat(F.array("start"), _drawn(F.col("nbrs"), n - 1, seed + 1, temperature, F.lit(0), by))
    return _best(s.select(*by, "seed_id", "attempt", path.alias("path")), n, by)


def _strong_pairs(edges: DataFrame, hi: float | None, bidirectional: bool, by: Sequence[str]) -> DataFrame | None:
    """Ordered pairs (*by, src, dst) at or above the upper bound, or None when there are none."""
    if hi is None:
        return None
    s = edges.where(F.col("w") >= hi - EPS).select(*by, "src", "dst")
    if bidirectional:
        s = s.union(s.select(*by, "dst", "src")).distinct()
    s = materialize(s, "strong")
    return None if s.isEmpty() else s


def _chain_step(adj: DataFrame, strong: DataFrame | None, target: int, by: Sequence[str]) -> Callable[[DataFrame, int], DataFrame]:
    """Append the strongest neighbour that is new and not too close to any chosen node."""
    keys = [*by, "seed_id", "attempt"]

    def step(state: DataFrame, _: int) -> DataFrame:
        go = ~F.col("done") & (F.size("path") < target)
        j = _neighbours(state, adj, F.element_at("path", -1), by).withColumn("cand", F.when(go, _unvisited(F.col("nbrs"), F.col("path"))))
        if strong is not None:
            # at most topk candidates times n path nodes per walk
            c = j.where("cand IS NOT NULL AND size(path) >= 2").select(*keys, "path", F.explode("cand").alias("c"))
            near = c.select(*keys, F.col("c.dst").alias("dst"), F.explode("path").alias("src")).join(strong, [*by, "src", "dst"], "left_semi")
            banned = near.groupBy(*keys).agg(F.collect_set("dst").alias("ban"))
            j = j.join(banned, keys, "left").withColumn("cand", F.when(
                F.col("ban").isNull(), F.col("cand")).otherwise(F.filter("cand", lambda s: ~F.array_contains(F.col("ban"), s["dst"]))))
        found = F.coalesce(F.size("cand"), F.lit(0)) > 0
        path = F.when(found, F.concat("path", F.array(F.col("cand")[0]["dst"]))).otherwise(F.col("path"))
        return j.select(*keys, path.alias("path"), (F.col("done") | (go & ~found)).alias("done"))

    return step


def sample_greedy_chain(edges: DataFrame, seeds: DataFrame, n: int, lo: float | None = None, hi: float | None = None, topk: int = 50,
                        attempts: int = 4, bidirectional: bool = True, global_max: bool = True, seed: int = 0, by: Sequence[str] = (),
                        graph: ViewGraph | None = None) -> DataFrame:
    """Always the strongest valid new neighbour of the last node; the top-k limit comes before the visited filter."""
    g = graph or view_graph(edges, n, lo, hi, topk, bidirectional, by)
    strong = g.strong if global_max else None
    s = _starts(g.nodes, seeds, attempts, seed, by).select(*by, "seed_id", "attempt", F.array("start").alias("path"), F.lit(False).alias("done"))
    return _best(_run(s, n - 1, _chain_step(g.narrow(), strong, n, by)), n, by)


def sample_tree(edges: DataFrame, seeds: DataFrame, n: int, lo: float | None = None, hi: float | None = None, topk: int = 50,
                temperature: float = 1.0, branching: int = 2, trunk_ratio: float = 0.25, attempts: int = 4,
                bidirectional: bool = True, seed: int = 0, by: Sequence[str] = (), graph: ViewGraph | None = None) -> DataFrame:
    """A greedy trunk of ceil(n * ratio) nodes (at least 2), then ``branching`` weighted children per node, breadth first."""
    g = graph or view_graph(edges, n, lo, hi, topk, bidirectional, by)
    trunk = min(max(2, math.ceil(n * trunk_ratio)), n)
    s = _starts(g.nodes, seeds, attempts, seed, by).select(*by, "seed_id", "attempt", F.array("start").alias("path"), F.lit(False).alias("done"))
    s = _run(s, trunk - 1, _chain_step(g.narrow(), g.strong, trunk, by))

    def grow(state: DataFrame, i: int) -> DataFrame:
        # the k strongest unvisited neighbours are among the k + n strongest ones
        j = _neighbours(state, g.wide, F.get("path", F.lit(i)), by)
        go = (F.size("path") < n) & (F.size("path") > i)
        j = j.withColumn("cand", F.slice(_unvisited(F.col("nbrs"), F.col("path")), 1, topk))
        k = F.least(F.lit(branching), F.lit(n) - F.size("path"), F.size("cand"))
        path = F.when(go, F.concat("path", _drawn(F.col("cand"), k, seed + 1, temperature, F.lit(i), by))).otherwise(F.col("path"))
        return j.select(*by, "seed_id", "attempt", path.alias("path")).withColumn("done", (F.size("path") >= n) | (F.size("path") <= i + 1))

    s = s.withColumn("done", F.size("path") >= n)
    return _best(_run(materialize(s, "trunk"), n, grow), n, by)


def sample_random_walk(edges: DataFrame, seeds: DataFrame, n: int, lo: float | None = None, hi: float | None = None, topk: int = 50,
                       temperature: float = 1.0, restart: float = 0.1, attempts: int = 4, bidirectional: bool = True, seed: int = 0,
                       by: Sequence[str] = (), graph: ViewGraph | None = None) -> DataFrame:
    """Weighted next node among the unvisited neighbours of the stack top (or of the start, with the restart probability);
    a dead end pops the stack. Later attempts start outside the nodes visited before: (*by, seed_id, pos, node)."""
    g = graph or view_graph(edges, n, lo, hi, topk, bidirectional, by)
    adj, nodes, ranked = g.wide, g.nodes, g.nodes.drop("n")
    keys = [*by, "seed_id"]
    empty = F.array().cast("array<bigint>")
    left = _sized(seeds.select(*keys), nodes, by).withColumn("tried", empty)
    walks: list[DataFrame] = []

    def advance(state: DataFrame, i: int) -> DataFrame:
        j = _neighbours(state, adj, F.try_element_at("stack", F.lit(-1)), by)
        pick = lambda c: F.slice(_unvisited(F.col(c), F.col("path")), 1, topk)
        j = j.withColumns({"top": pick("nbrs"), "first": pick("start_nbrs")})
        again = L.uniform(seed + 2, *keys, "attempt", F.lit(i)) < restart
        cand = F.when(again & (F.size("first") > 0), F.col("first")).otherwise(F.col("top"))
        nxt = _drawn(cand, 1, seed + 1, temperature, F.lit(i), by)
        go = ~F.col("done")
        j = j.withColumn("nxt", F.when(go, nxt).otherwise(empty))
        stack = F.when(~go, F.col("stack")).when(F.size("nxt") > 0, F.concat("stack", "nxt")).otherwise(
            F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0))))
        out = j.select(*keys, "n", "attempt", F.concat("path", "nxt").alias("path"), stack.alias("stack"), "start_nbrs", "tried")
        return out.withColumn("done", (F.size("path") >= n) | (F.size("stack") == 0))

    for a in range(attempts):
        # the idx-th node outside those tried before: skip as many as lie at or below it
        s = left.withColumn("attempt", F.lit(a)).where(F.size("tried") < F.col("n"))
        room = F.col("n") - F.size("tried")
        s = s.withColumn("__i", F.floor(L.uniform(seed, *keys, "attempt") * room))
        ranks = s.select(*keys, F.explode("tried").alias("node")).join(ranked, [*by, "node"])
        ranks = ranks.groupBy(*keys).agg(F.array_sort(F.collect_list("idx")).alias("__r"))
        s = s.join(ranks, keys, "left")
        shift = F.aggregate(F.coalesce("__r", empty), F.col("__i"), lambda acc, r: F.when(r <= acc, acc + 1).otherwise(acc))
        s = s.withColumn("idx", shift).join(ranked, [*by, "idx"]).join(adj, [*by, "node"], "left")
        start = F.array("node")
        s = s.select(*keys, "n", "attempt", start.alias("path"), start.alias("stack"),
                     F.coalesce("nbrs", F.array().cast(adj.schema["nbrs"].dataType)).alias("start_nbrs"), "tried", (F.lit(n) <= 1).alias("done"))
        s = materialize(_run(materialize(s, "walks"), 2 * n, advance), "walks")
        walks.append(s.select(*keys, "attempt", "path"))
        left = s.where(F.size("path") < n).select(*keys, "n", F.array_union("tried", "path").alias("tried"))
        if left.isEmpty():
            break
    return _best(reduce(DataFrame.unionByName, walks), n, by)


def sample_mixed(edges: DataFrame, seeds: DataFrame, n: int, mix: Sequence[float] = DEFAULT_MIX, seed: int = 0,
                 by: Sequence[str] = (), **kw) -> DataFrame:
    """Each seed draws one of the four modes by probability, all on one graph: (*by, seed_id, mode, pos, node)."""
    p = [max(0.0, float(x)) for x in mix]
    p = list(DEFAULT_MIX) if sum(p) <= 0 else p
    u, edge, mode = L.uniform(seed + 9, *by, "seed_id") * sum(p), 0.0, F.lit(MODES[-1])
    cuts = []
    for m, x in zip(MODES[:-1], p):
        edge += x
        cuts.append((edge, m))
    for c, m in reversed(cuts):
        mode = F.when(u < c, m).otherwise(mode)
    tagged = materialize(seeds.select(*by, "seed_id", mode.alias("mode")), "modes")
    run = {"anchor_star": sample_anchor_star, "random_walk": sample_random_walk, "tree": sample_tree, "greedy_chain": sample_greedy_chain}
    made = {k: kw[k] for k in ("lo", "hi", "topk", "bidirectional") if k in kw}
    graph = view_graph(edges, n, by=by, **made)
    parts = []
    for m, fn in run.items():
        mine = tagged.where(F.col("mode") == m)
        if p[MODES.index(m)] > 0 and not mine.isEmpty():
            parts.append(fn(edges, mine, n, seed=seed, by=by, graph=graph, **kw).withColumn("mode", F.lit(m)))
    return reduce(DataFrame.unionByName, parts)
