"""Column expressions for text: natural order, numeric tokens, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake.functions.linalg import col


def natural_key(c: str | Column) -> Column:
    """Sortable array in which digit runs compare as numbers: text, number, text, ... starting with text."""
    tokens = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\d+|\D+)"), 1)
    padded = F.transform(tokens, lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(t, 30, "0")).otherwise(t))
    return F.when(col(c).rlike(r"^\d"), F.concat(F.array(F.lit("")), padded)).otherwise(padded)


def lines(c: str | Column, keep_blank: bool = False) -> Column:
    """Trimmed lines of a text; blank ones are dropped unless asked for."""
    out = F.transform(F.split(F.regexp_replace(col(c), r"\s+$", ""), r"\r?\n"), lambda s: F.trim(s))
    return out if keep_blank else F.filter(out, lambda s: s != "")


def numbers(c: str | Column) -> Column:
    """Numbers of a line separated by blanks or commas; NULL if any token is not a number."""
    tokens = F.filter(F.split(F.regexp_replace(col(c), ",", " "), r"\s+"), lambda t: t != "")
    vals = F.transform(tokens, lambda t: t.try_cast("double"))
    return F.when((F.size(tokens) > 0) & F.forall(vals, lambda v: v.isNotNull()), vals)
