"""Corpus pipeline: quality selection, line dedup, near-dedup, mixing, tokenization.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder and
reads it back as the next stage's documents. All but the last return the columns of ``documents``.

Defined results, for all stages: an empty table gives an empty result; further columns are kept, whatever their names, by all
stages but the last; texts are handled whole, whatever their length. NULL and empty texts have no n-grams and log ratios of 0 in the
quality stage, no lines to drop, no near-duplicates, size 0 in the mix, and no tokens. Rows that share an id are one document for
the fit of the quality stage and for the near-duplicate stage; rows with a NULL id are never dropped as duplicates. Ties go to the
smaller id (line dedup: to the earlier line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerolake.llm import bpe, hyperminhash, linededup, mixing, quality
from aerolake.llm.common import read
from aerolake.llm.queries import vocabulary
from aerolake.session import materialize


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance towards the text that `labels` calls good."""
    return quality.resample(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before, equal or one word apart; documents that lose all their words go."""
    return linededup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return hyperminhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to; NULL and empty texts have no tokens."""
    return bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary())


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]

#: SQL cannot state hashed models, Gumbel draws and BPE; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
