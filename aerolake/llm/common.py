"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: str | Column, seed: int) -> Column:
    """Seeded pseudo-random order key: MD5 of the id and the seed, so neither partitioning nor engine matters."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed))))


def usable_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has a direction: not NULL, not empty, not all zero, and every component a finite number."""
    inf = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return rows.where(F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0))
