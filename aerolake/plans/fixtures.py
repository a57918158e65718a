"""Views that read the driver's tables as frames, cameras, pixels, points, edges and metrics.

Each view is one SQL text for both engines. ``US(c)`` is microseconds since the epoch and ``E(i)`` the i-th
embedding element; both are spelled per dialect. On Spark the frame numbering goes through ``grouped_rank``
so that a scene with most of the rows is not ranked in one task, and the view graphs are counted in tasks of bounded size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.functions.ranking import deal, grouped_rank
from aerolake.session import materialize

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {
    "fx_frames": """SELECT user_id AS scene, event_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame,
  US(ts) / 1e6 AS t, value, event_type FROM {events}""",
    "fx_cams": """SELECT scene, frame, t,
  CAST(10 * CASE WHEN CAST(floor(frame / 12) AS INT) % 2 = 0 THEN frame % 12 ELSE 11 - frame % 12 END AS DOUBLE) AS cx,
  CAST(40 * floor(frame / 12) AS DOUBLE) + value / 100 AS cy, 100 + value / 50 AS cz FROM {fx_frames}""",
    "fx_pred": """SELECT scene, frame, t,
  CAST(0.5 AS DOUBLE) * (CAST(0.6 AS DOUBLE) * cx - CAST(0.8 AS DOUBLE) * cy) + scene + (frame % 7) / CAST(100 AS DOUBLE) AS cx,
  CAST(0.5 AS DOUBLE) * (CAST(0.8 AS DOUBLE) * cx + CAST(0.6 AS DOUBLE) * cy) + 2 - (frame % 5) / CAST(100 AS DOUBLE) AS cy,
  CAST(0.5 AS DOUBLE) * cz - 3 + (frame % 3) / CAST(100 AS DOUBLE) AS cz FROM {fx_cams}""",
    "fx_points": """SELECT o_custkey % 3 AS scene, o_orderkey AS point_id, (o_totalprice * 7) % 500 AS x,
  (o_totalprice * 3) % 400 AS y, (o_totalprice % 13) + (o_orderkey % 5) AS z, CAST(o_orderkey % 256 AS INT) AS r,
  CAST(o_custkey % 256 AS INT) AS g, CAST((o_orderkey + o_custkey) % 256 AS INT) AS b FROM {orders}""",
    "fx_points_gt": """SELECT scene, point_id, x + CAST(0.3 AS DOUBLE) * (point_id % 3) AS x,
  y - CAST(0.2 AS DOUBLE) * (point_id % 4) AS y, z + CAST(0.1 AS DOUBLE) * (point_id % 2) AS z FROM {fx_points}""",
    "fx_pixels": """SELECT CAST(floor(o_orderkey / 256) AS INT) AS frame, CAST(floor(o_orderkey % 256 / 16) AS INT) AS y,
  CAST(o_orderkey % 16 AS INT) AS x, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 80 + o_totalprice % 20 END AS z,
  (o_custkey % 101) / CAST(100 AS DOUBLE) AS conf,
  80 + o_totalprice % 20 + CAST(0.5 AS DOUBLE) * (o_orderkey % 3) AS z_gt, o_orderkey % 17 <> 0 AS valid FROM {orders}""",
    "fx_vectors": """SELECT vec_id, label, label % 3 AS scene, CAST(floor(vec_id / 50) AS INT) AS frame,
  100 * CAST(E(1) AS DOUBLE) AS x, 100 * CAST(E(2) AS DOUBLE) AS y, 100 * CAST(E(3) AS DOUBLE) AS z, embedding
  FROM {embeddings}""",
    "fx_scores": """SELECT frame, y, x, c.cls, ((y * 7 + x * 3 + frame + c.cls * 13) % 17) / CAST(4 AS DOUBLE) AS logit,
  (y + x) % 4 AS label
  FROM {fx_pixels} CROSS JOIN (SELECT 0 AS cls UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) c""",
    "fx_edges": """SELECT a.l_suppkey AS src, b.l_suppkey AS dst, CAST(count(*) AS DOUBLE) / max(n.n) AS w
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}) a
  JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}) b
    ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
  JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM {lineitem} GROUP BY l_suppkey) n ON n.l_suppkey = a.l_suppkey
  GROUP BY a.l_suppkey, b.l_suppkey""",
    # three view graphs with the same node ids
    "fx_scene_edges": """SELECT a.scene, a.l_suppkey AS src, b.l_suppkey AS dst, CAST(count(*) AS DOUBLE) / max(n.n) AS w
  FROM (SELECT DISTINCT l_orderkey % 3 AS scene, l_orderkey, l_suppkey FROM {lineitem}) a
  JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}) b
    ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
  JOIN (SELECT l_orderkey % 3 AS scene, l_suppkey, count(DISTINCT l_orderkey) AS n FROM {lineitem} GROUP BY 1, 2) n
    ON n.scene = a.scene AND n.l_suppkey = a.l_suppkey
  GROUP BY a.scene, a.l_suppkey, b.l_suppkey""",
    "fx_metrics": """SELECT o_orderpriority AS method, o_orderstatus AS dataset, o_custkey % 6 AS scene, 'ate_rmse' AS metric,
  avg(CASE WHEN o_custkey % 6 = 5 AND o_orderstatus = 'F' THEN NULL ELSE o_totalprice / 1000 END) AS value FROM {orders}
  GROUP BY o_orderpriority, o_orderstatus, o_custkey % 6""",
    "fx_asof": """SELECT event_id AS qid, user_id AS scene, US(ts) / 1e6 + (event_id % 4) * CAST(300 AS DOUBLE) AS t
  FROM {events}""",
    "fx_bins": "SELECT p_partkey AS sample, p_size AS hfov, p_type AS kind FROM {part}",
    # camera of every pixel frame: nadir, on a 5 m grid that drifts, so no two cameras share a coordinate
    "fx_pixcams": """SELECT DISTINCT CAST(floor(o_orderkey / 256) AS INT) AS frame,
  5 * (floor(o_orderkey / 256) % 8) + CAST(0.01 AS DOUBLE) * floor(o_orderkey / 256) AS cx,
  5 * (floor(floor(o_orderkey / 256) / 8) % 8) + CAST(0.013 AS DOUBLE) * floor(o_orderkey / 256) AS cy,
  CAST(100 AS DOUBLE) AS cz FROM {orders}""",
}

_REF = re.compile(r"\{(\w+)\}")


def _dialect(sql: str, spark: bool) -> str:
    if spark:
        sql = re.sub(r"\bUS\((\w+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", sql)
        return re.sub(r"\bE\((\w+)\)", r"element_at(embedding, \1)", sql)
    sql = re.sub(r"\bUS\((\w+)\)", r"epoch_us(\1)", sql)
    return re.sub(r"\bE\((\w+)\)", r"embedding[\1]", sql)


def oracle(sql: str) -> str:
    """Inline the views a check statement names in braces as WITH clauses; base tables stay plain names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _REF.findall(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    body = _REF.sub(r"\1", _dialect(sql, spark=False)).strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({_REF.sub(chr(92) + '1', _dialect(VIEWS[n], spark=False))})" for n in needed)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("scene"), "event_id", "ts", "value", "event_type")
    ranked = grouped_rank(events, ["scene"], ["ts", "event_id"], "frame")
    return ranked.select(
        "scene", "event_id", F.col("frame").cast("int").alias("frame"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), "value", "event_type")


def _edges(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    """Suppliers that share orders, from the supplier list of each order. Counting pairs barely shrinks them, so they are dealt
    over as many tasks as their number asks for, and the counters of a task stay small on any input."""
    li = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    own = li.select("l_orderkey", "l_suppkey")
    lists = deal(own, own.count(), "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("l"))
    lists = materialize(lists.select(*[(F.col("l_orderkey") % 3).alias(c) for c in by], "l"), "order-lists")
    one = lists.select(*by, "l", F.explode("l").alias("src"))
    pairs = one.select(*by, "src", F.explode("l").alias("dst")).where("src <> dst")
    total = lists.agg(F.sum(F.size("l") * (F.size("l") - 1))).first()[0] or 0
    shared = deal(pairs, total, *by, "src", "dst").groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("c"))
    # one row a node: written out, its size is known, and edges are not sorted to meet it
    n = materialize(one.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("n")), "order-counts")
    return shared.join(n, [*by, "src"]).select(*by, "src", "dst", (F.col("c").cast("double") / F.col("n")).alias("w"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a base table, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "fx_frames":
        return _frames(spark, sf_dir)
    if name in ("fx_edges", "fx_scene_edges"):
        return _edges(spark, sf_dir, ["scene"] if name == "fx_scene_edges" else [])
    if name == "fx_scores":
        # four classes per pixel, without a cross join
        p = view(spark, sf_dir, "fx_pixels").withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(3))))
        logit = (F.col("y") * 7 + F.col("x") * 3 + F.col("frame") + F.col("cls") * 13) % 17 / F.lit(4.0)
        return p.select("frame", "y", "x", "cls", logit.alias("logit"), ((F.col("y") + F.col("x")) % 4).alias("label"))
    parts: dict[str, DataFrame] = {}

    def sub(m: re.Match) -> str:
        parts[m.group(1)] = view(spark, sf_dir, m.group(1))
        return "{" + m.group(1) + "}"

    text = _REF.sub(sub, _dialect(VIEWS[name], spark=True))
    return spark.sql(text, **parts)
