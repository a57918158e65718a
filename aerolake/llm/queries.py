"""Registered queries of this subpackage: one per operator, thin, over whole tables, and the SQL that checks them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm import alignment, bpe, chat, covertree, hyperminhash, licenses, linededup, mih, mixing, quality, rankqueue, runs, sharding
from aerolake.llm.common import read, word_count

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance, draw, rank and decision of every document; target text is what `labels` calls good."""
    return quality.select_top(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))[0]


@query("op4_mixing", r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(CAST(doc_id AS VARCHAR) || ':17') AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM s),
w AS (SELECT source, source_size, i, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
    2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM n),
-- a source is full if it is full when all sources with a smaller or equal cap / weight are full, and the others share the rest
f AS (SELECT a.source, any_value(a.source_size) AS source_size, any_value(a.cap) AS cap, any_value(a.w) AS w,
    any_value(a.total) AS total, any_value(a.cap / a.w) * sum(CASE WHEN (b.cap / b.w, b.i) >= (a.cap / a.w, a.i) THEN b.w ELSE 0 END)
      <= any_value(a.total) - sum(CASE WHEN (b.cap / b.w, b.i) < (a.cap / a.w, a.i) THEN b.cap ELSE 0 END) AS full_
  FROM w a CROSS JOIN w b GROUP BY a.source, a.i),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE least(cap, (total - coalesce(sum(cap) FILTER (full_) OVER (), 0)) * w
    / sum(w) FILTER (NOT full_) OVER ()) END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS whole,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id) - d.size AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  whole * size + least(greatest(CAST(round(target) AS BIGINT) - whole * source_size - before, 0), size) AS taken FROM r""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document by the mix 3 : 1 : 2 of all sources, 150 % of the words, at most two epochs."""
    plan = mixing.plan_mix(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; row counts of shards differ by at most one, each holds the mixture of sources."""
    utf8 = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"))
    rows = sharding.interleave(docs, 16, keep=["size", "text_crc32"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


def vocabulary() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document."""
    return bpe.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


@query("op7_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS words FROM l),
d AS (SELECT words, min({'d': doc_id, 'l': line_no}) AS first, len(words) AS n FROM w WHERE len(words) > 0 GROUP BY words),
v AS (SELECT words, first, n, j, array_to_string(words[1:j - 1] || words[j + 1:], ' ') AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM d WHERE n >= 8)),
p AS (
  SELECT v.words, g.first FROM v JOIN (SELECT v, j, n, min(first) AS first FROM v GROUP BY v, j, n HAVING count(*) > 1) g USING (v, j, n)
  UNION ALL SELECT v.words, d.first FROM v JOIN d ON array_to_string(d.words, ' ') = v.v AND d.n = v.n - 1 AND d.n >= 8
  UNION ALL SELECT d.words, v.first FROM v JOIN d ON array_to_string(d.words, ' ') = v.v AND d.n = v.n - 1 AND d.n >= 8),
k AS (SELECT d.words, d.n, coalesce(min(p.first) FILTER (p.first < d.first), d.first) AS keep, d.first
  FROM d LEFT JOIN p ON d.words = p.words GROUP BY d.words, d.n, d.first)
SELECT w.doc_id, w.line_no, CAST(k.n AS INT) AS n_words, k.keep = {'d': w.doc_id, 'l': w.line_no} AS kept,
  k.keep.d AS keep_doc_id, k.keep.l AS keep_line_no FROM w JOIN k ON w.words = k.words""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of `documents`: kept or not, and where the line is that stands for it."""
    return linededup.dedup_lines(read(spark, sf_dir, "documents"))


@query("op2_near_dedup")
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and decision of every document, shingles of five words, similarity 0.75."""
    return hyperminhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op1_chat_format", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '(\\|\[/?INST\]|</?s>|<</?SYS>>|</?role>|</?turn>)', '\\\1', 'g') AS esc,
    regexp_replace(role, '(\\|\[/?INST\]|</?s>|<</?SYS>>|</?role>|</?turn>)', '\\\1', 'g') AS esc_role FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, md5(text))) AS loss_sha256,
  CAST(sum(length(esc) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 26 + length(esc_role) END) AS BIGINT)
    AS formatted_chars FROM e GROUP BY conv_id""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations; every turn goes through the log as a start and its deltas."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    return chat.digests(chat.format_log(chat.events_of_turns(turns.unionByName(own))))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document and where it comes from; documents lie in folders source/lang/thousand of ids."""
    docs = read(spark, sf_dir, "documents")
    folder = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string")]
    path = F.concat_ws("/", *folder, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text")).withColumnRenamed("file", "doc_id")


@query("op6_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
    AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links,
  (SELECT min(r.b) FROM r WHERE r.a = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(r.b) FROM r WHERE r.a = e.vec_id) AS kept FROM embeddings e""")
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and decision of every vector: equal label, cosine from 0.93 on."""
    return covertree.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op9_nearest")
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every vector whose id is divisible by 50, among all others."""
    rows = read(spark, sf_dir, "embeddings")
    return mih.nearest(rows, rows.where("vec_id % 50 = 0"))


def plant_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of every tenth document or so repeat from a place on, by the id's checksum; the others stay as they are."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a : a + p]
    return words[:a] + (turn * ((n - a) // p + 1))[: n - a]


@query("op11_runs")
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document: number, longest one, digests of all and of the text without repeats."""
    return runs.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), edit=plant_period)


def rank_file() -> str:
    """Path of the public vocabulary of ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op12_rank_bpe")
def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of every document, by the vocabulary of ranks."""
    return rankqueue.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), rank_file())


def piece_model() -> str:
    """Path of the public vocabulary of pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers that cut the same bytes, and how common the linked pairs of ids are."""
    return alignment.link_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), piece_model())
