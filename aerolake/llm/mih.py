"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

* **Codes.** Unit vectors are centred, rotated to their principal axes and then by rotations learned to bring the axes close
  to +-1 (iterative quantization); the signs are the code. Several rotations from different starts are put together until
  the code has about ``BITS`` bits. The fit uses a sample of at most ``SAMPLE`` rows; every row is indexed.
* **Radius.** Learned on the sample: the ``REACH`` quantile of the code distances of true neighbours. In a sample neighbours
  are farther away than in the whole table, so the radius errs on the large side.
* **Index.** Rows are dealt to blocks of about ``BLOCK``; in each, every 8-bit substring of the codes has a table from value
  to rows. By the pigeonhole principle a code within radius r agrees with the query in some substring up to
  r // substrings bits; probing all values that close retrieves every code within r. A query that would find fewer than k
  rows in a block probes with a growing radius, until k are found or the block is used up.
* **Rerank.** Retrieved rows are ranked by cosine in double precision; a block gives the k best per query, and the best of
  all blocks are the answer.

Queries go to all blocks in blocks of their own, as packed rows, so a group of near copies with a third of all rows is
spread like anything else, and no candidate pair ever leaves a task.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, or have a NULL id, take no part;
vectors of another length than the query are no candidates; a repeated row counts once; a query is not its own candidate
(by id); with fewer than k candidates all are returned. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.common import usable_vectors
from aerolake.llm.covertree import unit
from aerolake.session import materialize

#: Bounds of the fit: rows, of which queries; code length aimed at, substring length, quantile of neighbour distances.
SAMPLE, SAMPLE_QUERIES, BITS, PART, REACH = 4096, 512, 128, 8, 0.99
BLOCK, QUERY_BLOCK = 1024, 512


@dataclass
class Code:
    """Centre, projection (dimensions x bits) and search radius of the vectors of one length."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def of(self, u: np.ndarray) -> np.ndarray:
        """Packed codes, 8 bits a byte."""
        return np.packbits((u - self.mean) @ self.turn > 0, axis=1)


def _quantized_rotation(x: np.ndarray, rng: np.random.Generator, steps: int = 30) -> np.ndarray:
    turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(steps):
        a, _, b = np.linalg.svd(np.sign(x @ turn).T @ x)
        turn = (a @ b).T
    return turn


def fit(sample: np.ndarray, k: int, seed: int = 3) -> Code:
    """Code of unit vectors, learned on ``sample``."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    mean = sample.mean(axis=0)
    axes = np.linalg.svd(sample - mean, full_matrices=True)[2].T
    x = (sample - mean) @ axes
    turn = np.hstack([axes @ _quantized_rotation(x, rng) for _ in range(max(1, round(BITS / dim)))])
    code = Code(mean, turn, turn.shape[1])
    q = sample[:SAMPLE_QUERIES]
    score = q @ sample.T
    np.fill_diagonal(score, -2)
    k = min(k, len(sample) - 1)
    if k > 0:
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        bits = code.of(sample)
        gaps = np.bitwise_count(bits[: len(q), None] ^ bits[near]).sum(axis=2)
        code.radius = int(np.quantile(gaps, REACH, method="higher"))
    return code


def tables(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per substring its distinct values and the row-to-value map: the postings of the index."""
    return [np.unique(codes[:, j], return_inverse=True) for j in range(codes.shape[1])]


def probe(index: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Matrix of rows within ``radius`` of each query: pigeonhole probes of every substring, then whole codes."""
    near = radius // len(index)
    found = np.zeros((len(queries), len(codes)), bool)
    for j, (values, rows) in enumerate(index):
        hit = np.bitwise_count(queries[:, j, None] ^ values[None, :]) <= near
        found |= hit[:, rows]
    gap = np.zeros(found.shape, np.uint16)
    for j in range(codes.shape[1]):
        gap += np.bitwise_count(queries[:, j, None] ^ codes[None, :, j])
    return found & (gap <= radius)


def search_block(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, code: Code, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query: query_id, vec_id, score."""
    u, uq = unit(vectors), unit(q_vectors)
    codes, queries = code.of(u), code.of(uq)
    index = tables(codes)
    other = ids[None, :] != q_ids[:, None]
    found, radius = probe(index, codes, queries, code.radius) & other, code.radius
    want = np.minimum(k, other.sum(axis=1))
    while (short := np.flatnonzero(found.sum(axis=1) < want)).size:
        radius += len(index)
        found[short] = probe(index, codes, queries[short], radius) & other[short]
    score = np.where(found, uq @ u.T, -np.inf)
    # everything that may be among the k best, ties and rounding included; then the exact measure decides
    edge = -np.sort(-score, axis=1)[:, min(k, score.shape[1]) - 1]
    i, j = np.nonzero(found & (score >= edge[:, None] - 1e-9))
    a, b = q_vectors[i].astype(np.float64), vectors[j].astype(np.float64)
    exact = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    out = pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "score": exact})
    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id", sort=False).head(k)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """One row per block of about ``size`` rows of one length: dim, block, blocks, ids, vectors (float64 bytes)."""
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("blocks"))
    rows = rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("vec_id").sort_values("vec_id")
        data = np.stack(p.embedding.to_numpy()).astype(np.float64)
        return pd.DataFrame([{"dim": p.dim.iloc[0], "block": p.block.iloc[0], "blocks": p.blocks.iloc[0],
                              "ids": p.vec_id.to_numpy(), "vectors": data.tobytes()}])

    return rows.groupBy("dim", "block").applyInPandas(pack, "dim int, block long, blocks long, ids array<long>, vectors binary")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query. Both tables: vec_id, embedding."""
    def ready(t: DataFrame) -> DataFrame:
        t = usable_vectors(t).where("vec_id IS NOT NULL")
        return t.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))

    rows, queries = ready(rows), ready(queries)
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["embedding"])
    codes = {dim: fit(unit(np.array(v)), k) for dim, v in sample.items()}
    held = rows.sparkSession.sparkContext.broadcast(codes)  # projections fitted on SAMPLE rows: at most their size each
    index = materialize(_packed(rows, BLOCK), "mih-index")
    asked = materialize(_packed(queries, QUERY_BLOCK), "mih-queries").select(
        "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # every block of queries meets every block of the index of its length, as two packed rows
    counts = index.groupBy("dim").agg(F.max("blocks").alias("n"))
    asked = asked.join(counts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    pairs = index.drop("blocks").join(asked, ["dim", "block"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in p.itertuples():
            dim = int(r.dim)
            code = held.value.get(dim) or Code(np.zeros(dim), np.eye(dim), dim)
            out.append(search_block(np.asarray(r.ids), np.frombuffer(r.vectors).reshape(-1, dim), np.asarray(r.q_ids),
                                    np.frombuffer(r.q_vectors).reshape(-1, dim), code, k))
        return pd.concat(out)

    best = pairs.groupBy("dim", "block", "q_block").applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
