"""Near-duplicate documents by HyperMinHash: compressed registers, banding, collision-corrected estimates, verification.

A document is its set of distinct 5-word shingles (64-bit hashes of the words, A-Z lower-cased). Documents with equal
sets form one class, whose smallest id stands for it.

* **Sketch.** Shingle hashes are dealt to ``REGISTERS`` buckets; of each bucket's minimum the register stores the count of
  leading zeros (6 bits) and the next 10 bits. Empty buckets copy a filled one along a fixed permutation of their own, so
  small sets have the same collision law as large ones.
* **Banding.** ``BANDS`` runs of 4 registers, 64 bits each. A pair with similarity s shares a band with probability
  1 - (1 - s^4)^32: 0.999995 at 0.75, more above.
* **Candidates without all pairs of a bucket.** First every member of a bucket meets its smallest member only. Where the
  verified links leave a bucket in several components, the members outside its largest component (usually few) are
  compared with the rest of the bucket, in blocks that hold their sets; only links that join components leave the task.
  A bucket of mutual copies costs one pair per member, and no link between components is lost.
* **Estimate.** The share of equal registers, less the share expected to be equal by chance. Pairs below ``LEAST`` are
  dropped before verification; that is 4.4 standard errors under the threshold for sets that fill the registers. In small
  sets two shingles may share a bucket and copied registers repeat it, so pairs with a set under ``SMALL`` are not
  estimated: they are verified, which costs little. Pairs whose sizes alone rule the similarity out are dropped, too.
* **Verification** on the full sets, in integers: 100 * intersection >= 75 * union.

Sets are not kept for all: texts of documents in candidate pairs are read again. Components come from links in tables.

Defined results: NULL and empty texts have an empty set and are linked with nothing; with fewer than five words the whole
sequence is the one shingle; rows that share an id are one document if their texts are equal; rows with a NULL id are
linked with nothing (component NULL, kept). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.llm.components import components
from aerolake.llm.quality import _chunks, _row_of
from aerolake.session import materialize

REGISTERS, BANDS, SHINGLE = 128, 32, 5
#: Estimated similarity under which a pair is not verified; rows of a bucket compared at a time.
LEAST, BLOCK = 0.58, 256
#: Sets under this size are verified without an estimate.
SMALL = 64
_BUCKET_BITS, _VALUE_BITS, _MANTISSA = 7, 57, 10
#: Chance that unequal minima give equal registers: equal leading zeros (1/3) and equal mantissas.
CHANCE = 2.0**-_MANTISSA / 3


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _splitmix(np.arange(256, dtype=np.uint64))
_BYTE[_BLANK] = 0
_PLACE = _splitmix(np.arange(1000, 1000 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


def _rotation() -> np.ndarray:
    """For every register the order in which it asks the others when its bucket is empty."""
    h = _splitmix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1 << 32)).reshape(REGISTERS, REGISTERS)
    return np.argsort(h, axis=1)


_ASK = _rotation()


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data = _LOWER[data]
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    begin = np.flatnonzero(word & (~before | edge[:-1]))
    per_row = np.searchsorted(begin, offsets)
    if len(begin):
        cuts = np.append(begin, len(data))
        place = np.arange(begin[0], len(data)) - np.repeat(begin, np.diff(cuts))
        power = np.full(int(place.max()) + 1, _STEP, np.uint64)
        power[0] = 1
        h = np.add.reduceat(_BYTE[data[begin[0]:]] * np.cumprod(power)[place], begin - begin[0])
        size = np.add.reduceat(word[begin[0]:].astype(np.uint64), begin - begin[0])
        h = _splitmix(h ^ (size << np.uint64(40)))
        n = len(h) - SHINGLE + 1
        full = _splitmix(sum(h[k : n + k] * _PLACE[k] for k in range(SHINGLE))) if n > 0 else h[:0]
    for a, b in zip(per_row[:-1], per_row[1:]):
        if b - a >= SHINGLE:
            yield np.unique(full[a : b - SHINGLE + 1])
        elif b > a:
            yield _splitmix(np.array([(h[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of non-empty sorted sets, one row of 16-bit numbers each."""
    bounds = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_VALUE_BITS)
    least, empty = np.zeros((len(sets), REGISTERS), np.uint64), np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, bounds)
        empty[i] = np.append(at[1:], len(s)) == at
        least[i] = s[np.minimum(at, len(s) - 1)]
    v = least & np.uint64((1 << _VALUE_BITS) - 1)
    bits = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    shift = bits - 1 - _MANTISSA
    tail = np.where(shift >= 0, v >> np.maximum(shift, 0).astype(np.uint64), v << np.maximum(-shift, 0).astype(np.uint64))
    zeros = np.clip(_VALUE_BITS - bits, 0, 63).astype(np.uint64)
    reg = ((zeros << np.uint64(_MANTISSA)) | (tail & np.uint64((1 << _MANTISSA) - 1))).astype(np.uint16)
    rows = np.flatnonzero(empty.any(axis=1))
    todo, filled = empty[rows].copy(), ~empty[rows]
    for step in range(REGISTERS):  # the permutation visits every bucket, so one filled bucket is enough
        if not todo.any():
            break
        ask = _ASK[:, step]
        take = todo & filled[:, ask]
        i, j = np.nonzero(take)
        reg[rows[i], j] = reg[rows[i], ask[j]]
        todo &= ~take
    return reg


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, print, bands): digest of the set and 32 longs of 4 registers; NULL for an empty set."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()),
                           T.StructField("print", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _row_of(batch, "doc_id")
            for a, b, data, offsets in _chunks(_row_of(batch, "text").fill_null("")):
                sets = list(shingle_sets(data, offsets))
                some = [s for s in sets if len(s)]
                bands = iter(registers(some).view("<i8").tolist() if some else [])
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()),
                     pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64()))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of register rows (last axis)."""
    share = (a == b).mean(axis=-1)
    return (share - CHANCE) / (1 - CHANCE)


def may_be_close(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of register rows have to be verified."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (100 * low >= percent * high) & ((low < SMALL) | (estimate(a, b) >= LEAST))


def _registers_of(bands: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, "<i8") for x in bands]).view("<u2")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that have to be verified."""
    one = classes.select(F.col("rep").alias("a"), F.col("bands").alias("x"), F.col("n_shingles").alias("n"))
    two = classes.select(F.col("rep").alias("b"), F.col("bands").alias("y"), F.col("n_shingles").alias("m"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "n", "m")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield p.loc[may_be_close(_registers_of(p.x), _registers_of(p.y), p.n.to_numpy(), p.m.to_numpy(), percent), ["a", "b"]]

    return rows.mapInPandas(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, set) of the documents in ``ids``: sorted shingle hashes as bytes, written once."""
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _chunks(_row_of(batch, "text").fill_null("")):
                sets = [s.tobytes() for s in shingle_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([_row_of(batch, "doc_id").slice(a, b - a), pa.array(sets, pa.binary())], ["doc_id", "set"])

    # an id with several texts takes part with one of them, chosen by content
    sets = texts.mapInArrow(to_sets, "doc_id long, set binary").groupBy("doc_id").agg(F.min("set").alias("set"))
    return materialize(sets, "shingle-sets")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets of their documents."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    rows = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    rows = rows.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(check, "a long, b long")


def _crossing(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between components that meet in a bucket. ``members``: (bucket, n, rep, component).

    The largest component of a bucket is not compared with itself. The others are dealt to blocks; block meets block, and
    each meets the largest component a block of it at a time, so no task holds more than two blocks.
    """
    parts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("n")).where(F.col("top.m") < F.col("n"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    main = main.select("bucket", F.col("top.component").alias("main"), blocks(F.col("n") - F.col("top.m")).alias("ko"),
                       blocks(F.col("top.m")).alias("km"))
    rows = members.select("bucket", "rep", "component").join(main, "bucket")
    inner = F.col("component") == F.col("main")
    mine = F.pmod(F.xxhash64("rep"), F.when(inner, F.col("km")).otherwise(F.col("ko"))).cast("int")
    rows = rows.withColumns({"inner": inner, "mine": mine})
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    meet = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    at = F.when(inner, F.transform(upto("ko"), lambda t: meet(t, F.col("mine"), 1))).otherwise(F.concat(
        F.transform(upto("km"), lambda t: meet(F.col("mine"), t, 1)),
        F.transform(upto("ko"), lambda t: meet(F.least(F.col("mine"), t), F.greatest(F.col("mine"), t), 0))))
    rows = rows.select("bucket", "rep", "component", "inner", "mine", F.explode(at).alias("at"))
    columns = ["rep", "component", "inner", "mine", "bands", "n_shingles"]
    gathered = lambda t, names: t.groupBy("bucket", "at").agg(*[F.collect_list(c).alias(c) for c in names])
    rows = gathered(rows.join(classes, "rep"), columns).withColumn("open", _open_members("at", *columns, F.lit(percent)))
    # only members with a partner that may be close go on, now with their sets
    member = F.explode(F.filter(F.arrays_zip(*columns, "open"), lambda m: m["open"])).alias("m")
    rows = rows.where(F.exists("open", lambda o: o)).select("bucket", "at", member).select("bucket", "at", *[f"m.{c}" for c in columns])
    rows = materialize(rows, "open-members")
    sets = _sets(rows.select(F.col("rep").alias("doc_id")).distinct(), docs).withColumnRenamed("doc_id", "rep")
    rows = gathered(rows.join(sets, "rep"), [*columns, "set"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                out += _joining(np.asarray(r.rep), np.asarray(r.component), _side(r.at, r.inner, r.mine), _registers_of(r.bands),
                                [np.frombuffer(x, np.uint64) for x in r.set], percent)
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.mapInPandas(run, "a long, b long").distinct()


def _side(at: dict, inner: list, mine: list) -> np.ndarray | None:
    """What tells two blocks apart, which are compared across only: the largest component, or the number of the block."""
    return np.asarray(inner) if at["kind"] == 1 else np.asarray(mine) if at["i"] != at["j"] else None


def _partners(rep: np.ndarray, comp: np.ndarray, side: np.ndarray | None, regs: np.ndarray, size: np.ndarray,
              percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members with the places of their smaller partners, of other components, that have to be verified."""
    if (comp == comp[0]).all():
        return
    for u in range(len(rep)):
        open_ = (comp != comp[u]) & (rep < rep[u])
        if side is not None:
            open_ &= side != side[u]
        vs = np.flatnonzero(open_)
        if len(vs):
            vs = vs[may_be_close(regs[vs], regs[u], size[vs], size[u], percent)]
            if len(vs):
                yield u, vs


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _open_members(at: pd.DataFrame, rep: pd.Series, comp: pd.Series, inner: pd.Series, mine: pd.Series, bands: pd.Series,
                  size: pd.Series, percent: pd.Series) -> pd.Series:
    """Which members of a block have a partner, or are one."""
    out = []
    for a, r, c, i, m, b, n, p in zip(at.to_dict("records"), rep, comp, inner, mine, bands, size, percent):
        open_ = np.zeros(len(r), bool)
        for u, vs in _partners(np.asarray(r), np.asarray(c), _side(a, i, m), _registers_of(b), np.asarray(n), p):
            open_[u] = True
            open_[vs] = True
        out.append(open_)
    return pd.Series(out)


def _joining(rep: np.ndarray, comp: np.ndarray, side: np.ndarray | None, regs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links (a, b) of one block, or of two told apart by ``side``: per member one to each other component that it reaches."""
    out, every, at = [], None, None
    size = np.array([len(s) for s in sets])
    for u, vs in _partners(rep, comp, side, regs, size, percent):
        if every is None:  # places of all shingles of the block among its distinct ones
            every = np.unique(np.concatenate(sets), return_inverse=True)[1]
            at = np.concatenate([[0], np.cumsum(size)])
        held = np.zeros(every.max() + 1, np.int64)
        held[every[at[u] : at[u + 1]]] = 1
        both = np.add.reduceat(held[every], at[:-1])[vs]
        vs = vs[100 * both >= percent * (size[u] + size[vs] - both)]
        out += [(rep[u], rep[v]) for v in vs[np.unique(comp[vs], return_index=True)[1]]]
    return out


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    marks = materialize(sketches(docs), "sketches")
    classes = marks.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min(F.struct("doc_id", "bands", "n_shingles")).alias("c"))
    classes = materialize(classes.select("print", F.col("c.doc_id").alias("rep"), "c.bands", "c.n_shingles"), "classes")
    links = _links(docs, classes.select("rep", "bands", "n_shingles"), percent)
    comp = components(links).withColumnRenamed("node", "rep")
    of = materialize(classes.select("print", "rep").join(comp, "rep", "left").select(
        "print", F.coalesce("component", "rep").alias("component_id")), "class-components")
    rows = marks.select("doc_id", "n_shingles", "print").join(of, "print", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == own, F.lit(True))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"))


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b), a > b, between class representatives: enough of them to connect every component."""
    rows = classes.select("rep", F.posexplode("bands").alias("i", "bits")).select(F.xxhash64("i", "bits").alias("bucket"), "rep")
    full = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(rows.join(full, "bucket").select("bucket", "rep", "hub", "n"), "buckets")
    pairs = members.where("rep > hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = materialize(_estimated(pairs, classes, percent), "pairs")
    links = materialize(_verified(pairs, docs, percent), "links")
    comp = components(links).withColumnRenamed("node", "rep")
    members = members.where("n > 2").select("bucket", "rep").join(comp, "rep", "left")
    members = materialize(members.withColumn("component", F.coalesce("component", "rep")), "members")
    return links.unionAll(materialize(_crossing(members, classes, docs, percent), "links"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the document with the smallest id; same columns."""
    gone = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
