"""Quality selection by importance resampling.

Two bag-of-hashed-n-gram models are estimated, one of target text (documents labelled good) and one of raw text (all
documents). A document's log importance is the mean log ratio of the two over its n-grams; documents are then drawn
without replacement by Gumbel top-k: the k largest of log weight plus seeded Gumbel noise.

Two streams of n-grams are used: three successive UTF-8 bytes, and three successive word shapes (case, edge symbols,
digits, length class, same as one of the two words before). Each gives one mean log ratio; a two-feature logistic fit on
the labelled sample puts them on the scale of log odds, so weight 0 means as likely good as not. k is the number of
documents with a positive log weight: it follows the corpus and is no fixed share.

The labelled sample is bounded (``SAMPLE`` documents, those with the smallest hash); raw counts, scores and ranks cover
all documents. What comes to the driver is bounded by parameters: one count per hash bucket, two numbers per sampled
document. Log ratios are fixed-point integers, so a document's score does not depend on how rows are batched.

Defined results: NULL and empty texts have no n-grams and a log ratio of 0; documents with a NULL id take part like
others; if the labels do not hold both classes nothing can be judged and every document is kept; an empty table gives an
empty result. Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.functions.ranking import grouped_rank
from aerolake.session import materialize

#: Labelled documents the models are fitted on at most; hash buckets of the two streams.
SAMPLE, BYTE_BUCKETS, SHAPE_BUCKETS = 20_000, 1 << 14, 1 << 13
#: Log ratios are multiples of 1 / UNIT; SHRINK n-grams of ratio 0 are added to each mean; bytes handled at a time.
UNIT, SHRINK, CHUNK = 4096, 8, 1 << 20
_MIX = np.uint32(2654435761)


@dataclass
class Model:
    """Fixed-point log ratios per bucket (bytes first, then shapes) and the logistic coefficients (constant, bytes, shapes)."""

    ratio: np.ndarray
    coef: tuple[float, float, float] | None = None


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about CHUNK bytes; a longer text is a run of its own."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def byte_ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram and the row it belongs to, as offsets; trigrams across rows are left out."""
    n = len(data)
    starts, lens = offsets[:-1], np.diff(offsets)
    counts = np.maximum(lens - 2, 0)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(lens) + 1, np.int64)
    d = data.astype(np.uint32)
    h = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    h *= _MIX
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    bucket = (h >> np.uint32(18)).astype(np.int64)
    inside = np.ones(n - 2, bool)
    for back in (1, 2):  # trigrams that begin in the last two bytes of a row
        ends = offsets[1:][lens >= back] - back
        inside[ends[ends < n - 2]] = False
    return bucket[inside], np.concatenate([[0], np.cumsum(counts)])


_CLASS = np.zeros(256, np.uint8)  # 0 lower case or not ASCII, 1 upper case, 2 digit, 3 closing punctuation, 4 other symbol
for _c in range(33, 127):
    _CLASS[_c] = 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 0 if 97 <= _c <= 122 else 3 if chr(_c) in ".,;:?'\"()-" else 4
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shape_ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of word shapes and their offsets by row; a row's first words follow an empty shape."""
    rows = len(offsets) - 1
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    begin = np.flatnonzero(word & (~before | edge[:-1]))
    last = np.flatnonzero(word & (~after | edge[1:]))
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    per_row = np.searchsorted(begin, offsets).astype(np.int64)
    kind = _CLASS[data]
    size = last - begin + 1
    upper, digit = (np.add.reduceat((kind == k).astype(np.int32), begin) for k in (1, 2))
    # words as hashes: position-weighted byte sums, blanks counting nothing
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(data)]])))
    weight = _POWERS[place & 63]
    h = np.add.reduceat(np.where(word, (data.astype(np.uint64) + np.uint64(1)) * weight, np.uint64(0)), begin)
    first = np.zeros(len(begin) + 1, bool)
    first[per_row] = True
    same = np.zeros(len(begin), bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:-1]
    same[2:] |= (h[2:] == h[:-2]) & ~first[1:-2] & ~first[2:-1]
    case = np.where(upper == 0, 0, np.where((upper == 1) & (kind[begin] == 1), 1, np.where(upper * 2 > size, 2, 3)))
    shape = (1 + case + 4 * (kind[last] == 3) + 8 * (kind[last] == 4) + 16 * (digit > 0) + 32 * (size > 12) + 64 * same
             + 128 * (kind[begin] == 4)).astype(np.uint32)
    one = np.concatenate([[0], shape[:-1]]).astype(np.uint32)
    one[first[:-1]] = 0
    two = np.concatenate([[0], one[:-1]]).astype(np.uint32)
    two[first[:-1]] = 0
    g = (shape << np.uint32(18)) ^ (one << np.uint32(9)) ^ two
    g *= _MIX
    g ^= g >> np.uint32(15)
    g *= np.uint32(2246822519)
    return (g >> np.uint32(19)).astype(np.int64) + BYTE_BUCKETS, per_row


_POWERS = np.array([pow(1099511628211, k, 1 << 64) for k in range(64)], np.uint64)


def _segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _row_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def labelled_sample(labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, good) of at most ``limit`` labelled documents; one row per id, good only if no label says otherwise."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("__q"))
    rows = rows.select("doc_id", (F.col("__q") > 0).alias("good"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, n_grams, by_bytes, by_shapes) of all documents as a written table."""
    sample = materialize(labelled_sample(labels, limit), "quality-sample")
    good = F.broadcast(sample.where("good").select(F.col("doc_id").alias("__id"), F.lit(True).alias("__target")))  # <= limit rows
    rows = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("__id"), "left").select("text", "__target")
    buckets = BYTE_BUCKETS + SHAPE_BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            wanted = np.array(_row_of(batch, "__target").fill_null(False).to_pylist(), bool)
            for a, b, data, offsets in _chunks(_row_of(batch, "text").fill_null("")):
                for grams, at in (byte_ngrams(data, offsets), shape_ngrams(data, offsets)):
                    raw += np.bincount(grams, minlength=buckets)
                    target += np.bincount(grams[np.repeat(wanted[a:b], np.diff(at))], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counts = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for k, r, t in counts.collect():  # one row per bucket
        raw[k], target[k] = r, t
    ratio = np.zeros(buckets, np.int64)
    for part in (slice(0, BYTE_BUCKETS), slice(BYTE_BUCKETS, buckets)):
        p, q = target[part] + 0.5, raw[part] + 0.5
        ratio[part] = np.rint(UNIT * np.log((p / p.sum()) / (q / q.sum())))
    model = Model(ratio)
    scored = materialize(_scored(docs.select("doc_id", "text"), model, keep_text=False), "quality-scores")
    # one row per id, however often it is repeated; of an id with several texts the lowest scores count
    fitted = scored.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("by_bytes", "by_shapes")).alias("x"), F.first("good").alias("good"))
    fitted = fitted.orderBy("doc_id").select("x.by_bytes", "x.by_shapes", "good")
    model.coef = _logistic(np.array([[float(x) for x in r] for r in fitted.collect()]).reshape(-1, 3))  # <= limit rows
    return model, scored


def _scored(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_grams`` and the mean log ratios ``by_bytes`` and ``by_shapes``; without the text if not wanted."""
    held = docs.sparkSession.sparkContext.broadcast(model.ratio)  # one number per bucket
    names = [c for c in docs.columns if c not in ("n_grams", "by_bytes", "by_shapes") and (keep_text or c != "text")]
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("n_grams", T.LongType()),
                           T.StructField("by_bytes", T.DoubleType()), T.StructField("by_shapes", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = held.value
        for batch in batches:
            n, out = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows))
            for a, b, data, offsets in _chunks(_row_of(batch, "text").fill_null("")):
                for k, (grams, at) in enumerate((byte_ngrams(data, offsets), shape_ngrams(data, offsets))):
                    size = np.diff(at)
                    n[a:b] += size
                    out[k, a:b] = _segment_sums(ratio[grams], at) / (UNIT * (size + SHRINK))
            yield pa.RecordBatch.from_arrays([*[_row_of(batch, c) for c in names], pa.array(n), *map(pa.array, out)], schema.names)

    return docs.mapInArrow(run, schema)


def _logistic(rows: np.ndarray) -> tuple[float, float, float] | None:
    """Ridge logistic fit by Newton steps; None unless both classes are there."""
    y = rows[:, 2]
    if not 0 < y.sum() < len(y):
        return None
    scale = np.maximum(rows[:, :2].std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(rows)), rows[:, :2] / scale])
    beta, ridge = np.zeros(3), np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale[0]), float(beta[2] / scale[1])


def _weighted(scored: DataFrame, model: Model, seed: int) -> DataFrame:
    """Adds ``log_weight`` and ``draw``, the weight with seeded Gumbel noise."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(f"gumbel{seed}"))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    a, b, c = model.coef or (0.0, 0.0, 0.0)
    weight = F.lit(a) + F.lit(b) * F.col("by_bytes") + F.lit(c) * F.col("by_shapes")
    return scored.withColumn("log_weight", weight).withColumn("draw", F.col("log_weight") - F.log(-F.log(u)))


def select_top(docs: DataFrame, labels: DataFrame, seed: int = 7, limit: int = SAMPLE) -> tuple[DataFrame, Model]:
    """Per document: doc_id, n_grams, by_bytes, by_shapes, log_weight, draw, rank (0 = largest draw), kept."""
    model, scored = fit(docs, labels, limit)
    rows = _weighted(scored, model, seed)
    good = rows.where("log_weight > 0").count() if model.coef else None
    ranked = grouped_rank(rows.withColumn("__down", -F.col("draw")), [], ["__down", "doc_id"], "rank")
    kept = F.lit(True) if good is None else F.col("rank") < good
    return ranked.withColumn("kept", kept).drop("__down"), model


def resample(docs: DataFrame, labels: DataFrame, seed: int = 7, limit: int = SAMPLE) -> DataFrame:
    """The selected rows of ``docs``, same columns. The draw is cut at the smallest selected one, and scores are taken again
    on the way through, so no text is shuffled."""
    ranked, model = select_top(docs, labels, seed, limit)
    if model.coef is None:
        return docs
    edge = ranked.where("kept").agg(F.max(F.struct(-F.col("draw"), "doc_id"))).first()[0]
    if edge is None:
        return docs.limit(0)
    rows = _weighted(_scored(docs, model), model, seed)
    return rows.where(_at_or_before(edge[0], edge[1])).select(*docs.columns)


def _at_or_before(down: float, doc_id: int | None) -> Column:
    mine = -F.col("draw")
    same = mine == F.lit(down)
    tie = F.col("doc_id").isNull() if doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(doc_id))
    return (mine < F.lit(down)) | (same & tie)
