"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as word sequences. The edit bound is one word (inserted, deleted or replaced) between lines of at
least ``min_words`` words each, and 0 for shorter ones. A line is dropped if an equal line, or one within the bound,
comes earlier; lines are ordered by (doc_id, line number) of their first occurrence.

1. Equal lines are collapsed by a 128-bit identity in a partial aggregate, so a line in most documents is one row.
2. Two lines one edit apart agree in their first or in their second half, measured on the shorter one. Each distinct line
   gives the hashes of these halves; only lines that share one with another line go on, with the half that may differ.
3. Those lines emit their deletion variants in that half as hashed keys: (variant, position) meets lines that differ in
   the word at this position, (variant) meets the line that is the variant itself. Every line is joined with the earliest
   one of each key only, so a family of a million variants of a line gives a million pairs, not their square.
4. The pairs are verified word by word; a line with a verified earlier partner is dropped wherever it occurs.

Defined results: NULL and empty texts have no lines; blank lines are never dropped; repeated rows with one id are the
same document and are treated alike; documents with a NULL id have no place in the order, are left as they are and do
not count as earlier. Texts of any length are handled; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.session import materialize

MIN_WORDS = 8
_ODD = r"[\x09-\x0D]|\x20\x20"


def _normal(line: Column) -> Column:
    """Words joined by single blanks."""
    return F.trim(F.when(line.rlike(_ODD), F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the lines that hold a word, as single-blank word sequences; line numbers start at 0."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", _normal(F.col("line"))).where(F.col("line") != "")


def _identity(line: str = "line") -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"), F.length(line).alias("n"))


def _halves(words: Column, n: Column) -> list[Column]:
    """Hashed halves of a line, in the order of KINDS."""
    def pair(m: Column, longer: int) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.slice(words, F.lit(1), h), m, F.lit(1)), F.xxhash64(F.slice(words, h + 1 + longer, m - h), m, F.lit(0))]

    return [*pair(n, 0), *pair(n - 1, 1)]


#: Columns of the hashed halves: against lines at least as long (h of the line's own n words) and against lines one word
#: shorter; "tail" means that the second half may differ, as the first one was hashed.
KINDS = ("same_tail", "same_head", "more_tail", "more_head")


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, id, n_words, *KINDS) of every line that holds a word; the halves are NULL for short lines."""
    words = F.split("line", " ")
    n = F.size(words)
    halves = [F.when(n >= min_words, h).alias(k) for h, k in zip(_halves(words, n), KINDS)]
    return lines(docs).select("doc_id", "line_no", _identity().alias("id"), n.alias("n_words"), *halves)


def distinct_lines(rows: DataFrame) -> DataFrame:
    """One row per distinct line of ``occurrences``: id, first (doc_id, line_no), n_words, *KINDS."""
    return rows.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), *[F.max(c).alias(c) for c in ("n_words", *KINDS)])


def _candidates(distinct: DataFrame, min_words: int) -> DataFrame:
    """Lines that share a half with another: id, first, and which variants they have to emit."""
    entry = lambda k: F.struct(F.col(k).alias("key"), F.lit(k.startswith("more")).alias("longer"), F.lit(k.endswith("tail")).alias("tail"))
    rows = distinct.where(F.col("n_words") >= min_words)
    # the shorter line must be long enough itself
    rows = rows.withColumn("h", F.explode(F.when(F.col("n_words") > min_words, F.array(*map(entry, KINDS))).otherwise(
        F.array(*map(entry, KINDS[:2]))))).select("id", "first", "h.key", "h.longer", "h.tail")
    longer, tail = F.col("longer"), F.col("tail")
    met = rows.groupBy("key").agg(F.count_if(~longer).alias("same"), F.count_if(longer).alias("more"))
    met = met.where((F.col("same") > 1) | ((F.col("same") > 0) & (F.col("more") > 0)))
    rows = rows.join(met, "key")
    return rows.groupBy("id", "first").agg(
        F.bool_or(~longer & tail & (F.col("same") > 1)).alias("swap_tail"),
        F.bool_or(~longer & ~tail & (F.col("same") > 1)).alias("swap_head"),
        F.bool_or(~longer & (F.col("more") > 0)).alias("whole"),
        F.bool_or(longer & tail & (F.col("same") > 0)).alias("cut_tail"),
        F.bool_or(longer & ~tail & (F.col("same") > 0)).alias("cut_head"))


def _with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` lines with their words, read from the document of the first occurrence."""
    by_doc = wanted.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(*wanted.columns)).alias("wanted"))
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    rows = texts.join(by_doc, "doc_id").select(F.split("text", "\n").alias("all"), "wanted")
    rows = rows.select("all", F.explode("wanted").alias("w"))
    rows = rows.select("w.*", _normal(F.element_at("all", F.col("w.first.line_no") + 1)).alias("line"))
    # repeated rows of a document, and documents that share an id, give a line more than once or another line
    return rows.where(_identity() == F.col("id")).dropDuplicates(["id"]).withColumn("words", F.split("line", " ")).drop("line")


def _variants(rows: DataFrame) -> DataFrame:
    """(key, role, id, first): hashed deletion variants. Roles: 0 differs at this position, 1 deletion, 2 whole line."""
    n = F.size("words")
    each = rows.select("id", "first", "swap_tail", "swap_head", "whole", "cut_tail", "cut_head", n.alias("n"),
                       F.posexplode("words").alias("j", "word"))
    # a word hashed at its own place and at the place it has once an earlier word is gone; a variant is the xor of these
    each = each.withColumns({"a": F.xxhash64("word", "j"), "b": F.xxhash64("word", F.col("j") - 1)})
    line = Window.partitionBy("id")
    upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"pa": F.expr("bit_xor(a)").over(upto), "pb": F.expr("bit_xor(b)").over(upto)})
    each = each.withColumn("tb", F.last("pb").over(line.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    variant = F.col("pa").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("tb").bitwiseXOR(F.col("pb")))
    half, half_less = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2)
    swap = F.when(F.col("j") >= half, F.col("swap_tail")).otherwise(F.col("swap_head"))
    cut = (F.col("cut_tail") & (F.col("j") >= half_less)) | (F.col("cut_head") & (F.col("j") <= half_less))
    entry = lambda key, role: F.struct(key.alias("key"), F.lit(role).alias("role"))
    none = F.lit(None).cast("struct<key:bigint,role:int>")
    rows = each.select("id", "first", F.explode(F.array_compact(F.array(
        F.when(swap, entry(F.xxhash64(variant, "n", "j"), 0)).otherwise(none),
        F.when(cut, entry(F.xxhash64(variant, F.col("n") - 1), 1)).otherwise(none),
        F.when(F.col("whole") & (F.col("j") == F.col("n") - 1), entry(F.xxhash64("pa", "n"), 2)).otherwise(none)))).alias("e"))
    return rows.select("e.key", "e.role", "id", "first")


def _pairs(variants: DataFrame) -> DataFrame:
    """(id, other): each line with the earliest line of each of its keys, where that is earlier."""
    at = F.struct("first", "id")
    hubs = variants.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, at)).alias(f"r{r}") for r in range(3)],
                                       F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    hub = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    rows = variants.join(hubs, "key").withColumn("hub", hub).where(F.col("hub.first") < F.col("first"))
    return rows.select("id", F.col("hub.id").alias("other")).distinct()


def _close(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one word edit apart: common head plus common tail leave at most one word."""
    def run(x: Column, y: Column) -> Column:
        least = F.least(F.size(x), F.size(y))
        at = F.array_position(F.zip_with(F.slice(x, F.lit(1), least), F.slice(y, F.lit(1), least), lambda u, v: u == v), F.lit(False))
        return F.when(at == 0, least).otherwise(at - 1)

    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (run(a, b) + run(F.reverse(a), F.reverse(b)) >= longest - 1)


def near_lines(docs: DataFrame, distinct: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, keeper): distinct lines with an earlier line one word edit away, and the first occurrence of the earliest."""
    words = materialize(_with_words(docs, _candidates(distinct, min_words)), "line-words")
    pairs = _pairs(_variants(words))
    mine = words.select("id", F.col("words").alias("w1"))
    other = words.select(F.col("id").alias("other"), F.col("words").alias("w2"), F.col("first").alias("keeper"))
    checked = pairs.join(mine, "id").join(other, "other").where(_close(F.col("w1"), F.col("w2")))
    return checked.groupBy("id").agg(F.min("keeper").alias("keeper"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every line that holds a word: doc_id, line_no, n_words, kept, and the place of the line kept in its stead."""
    rows = materialize(occurrences(docs, min_words), "line-occurrences")
    distinct = materialize(distinct_lines(rows), "line-ids")
    near = near_lines(docs, distinct, min_words)
    keepers = distinct.select("id", "first").join(near, "id", "left").select("id", F.coalesce("keeper", "first").alias("keeper"))
    keeper = F.col("keeper")
    return rows.select("doc_id", "line_no", "n_words", "id").join(keepers, "id").select(
        "doc_id", "line_no", "n_words", (keeper == F.struct("doc_id", "line_no")).alias("kept"),
        keeper["doc_id"].alias("keep_doc_id"), keeper["line_no"].alias("keep_line_no"))


def drop_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the dropped lines; a document that loses all its words is left out. Same columns; ``n_chars`` follows."""
    gone = dedup_lines(docs, min_words).where("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("__gone"))
    all_lines = F.split("text", "\n")
    rest = F.array_join(F.filter(all_lines, lambda _, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    rows = docs.join(gone, "doc_id", "left").withColumn("__cut", F.col("__gone").isNotNull())
    rows = rows.withColumn("text", F.when(F.col("__cut"), rest).otherwise(F.col("text")))
    rows = rows.where(~F.col("__cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
