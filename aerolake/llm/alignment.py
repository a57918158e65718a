"""Alignment of the tokens of two tokenizers, and which token pairs go together across a corpus.

Both tokenizers cut the same bytes. Byte offsets where tokens of both end cut them into groups. The groups are found by
skipping along diagonals: at token i of A and i + shift of B, slices of the two arrays of ends are compared, doubling in
length while they are equal; so stretches where one token meets one token are jumped. At the first difference the two lists
are advanced in turn to their next common end, which is one irregular group, and the shift is updated.

Links are pairs of token occurrences that overlap. How many documents hold a pair of ids linked is counted over the corpus
and brought back without a row per document and pair: texts are handled in chunks of a few megabytes, each with one list of
its distinct pairs and the number of its documents that hold them, and every document keeps places in its chunk's list. The
lists are added up by pair, the highest count per A id is joined on (a pair has at most one row there, and an A id at most as
many pairs as B has tokens), and counts go back to the chunks, where they meet the documents again. Documents, lists and
counts of a chunk are one group of bounded size; a document that is longer than a chunk is a chunk of its own.

Defined results: texts that are NULL or empty, or whose tokens of A or B do not give back a blank and the text, have no tokens;
special tokens inside texts are plain text; repeated rows are documents of their own; other columns are passed through
unless they have the name of an output column, in which case the output replaces them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.llm import bpe
from aerolake.llm.pieces import slices
from aerolake.session import materialize

#: Bytes of text in a chunk whose documents share a list of pairs.
CHUNK_BYTES = 4 << 20
#: First length of a probe along a diagonal; a power of two.
PROBE = 4

class Tokens:
    """Tokenizers A (byte-level BPE file, by its own library) and B (sentencepiece model) with the bytes of their tokens."""

    def __init__(self, a_spec: str, b_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        letters = {c: b for b, c in bpe.byte_letters().items()}
        model = json.loads(a_spec)["model"]
        self.a_bytes = {i: bytes(map(letters.__getitem__, t)) for t, i in model["vocab"].items()}
        self._encode_a = _ranked(model, self.a_bytes)
        if self._encode_a is None:
            library = Tokenizer.from_str(a_spec)
            library.encode_special_tokens = True
            self._encode_a = lambda text: library.encode(text, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        top = max(self.a_bytes, default=-1) + 1
        self.a_size, self.b_size = np.zeros(top, np.int64), np.array([len(t) for t in self.b_bytes], np.int64)
        for i, t in self.a_bytes.items():
            self.a_size[i] = len(t)
        known = set(self.a_bytes.values())
        self.lossless = all(bytes([c]) in known for c in range(256))
        # ids of up to seven decimal digits and a mark, filled up with zero bytes
        written = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], "S8").view(np.uint64)
        self.text_a = written(top, ","), written(top, "|")
        self.text_b = written(len(pieces), ","), written(len(pieces), ";")

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and ends of A, ids and ends of B; None if there are no tokens or a tokenizer does not keep the bytes."""
        if not text:
            return None
        whole = " " + text
        a, b = self._encode_a(whole), self.b.encode(text)
        given = whole.encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != given:
            return None
        # a byte-level vocabulary that has every byte gives back any text
        if not self.lossless and b"".join(map(self.a_bytes.__getitem__, a)) != given:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return a, np.cumsum(self.a_size[a]), b, np.cumsum(self.b_size[b])


def _ranked(model: dict, tokens: dict[int, bytes]) -> Callable[[str], list[int]] | None:
    """The encoder of the library for rank files, which is faster, if ids follow the order of the merges, so that they are
    ranks; None if they do not."""
    import public_tokenizers
    import tiktoken

    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made) or len(set(made)) != len(made) or len(made) + 256 < len(vocab) - 1:
        return None
    singles = {i for i in tokens if len(tokens[i]) == 1}
    ranks = {tokens[i]: i for i in singles | set(made)}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def _load(a_spec: str, b_model: bytes) -> Tokens:
    return Tokens(a_spec, b_model)


def links(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places of the tokens of A and of B that overlap, from two lists of ends that close at the same place."""
    link_a, link_b = [], []
    i = j = 0
    n = len(a)
    while i < n:
        start, probe = i, PROBE
        while a[i : i + probe] == b[j : j + probe] and i < n:
            i, j, probe = i + probe, j + probe, 2 * probe
        if i < n:
            while probe > 1:  # the first difference lies within the last probe
                probe //= 2
                if a[i : i + probe] == b[j : j + probe]:
                    i, j = i + probe, j + probe
        else:
            i, j = n, len(b)
        if i > start:  # a stretch of one token with one token
            link_a += range(start, i)
            link_b += range(j - i + start, j)
            if i == n:
                break
        while True:  # an irregular group, up to the next common end
            link_a.append(i)
            link_b.append(j)
            x, y = a[i], b[j]
            if x < y:
                i += 1
            elif y < x:
                j += 1
            else:
                break
        i += 1
        j += 1
    return link_a, link_b


class Alignment:
    """Links of one text as places of tokens of A and of B, and its groups by their last tokens."""

    __slots__ = ("last_a", "last_b", "link_a", "link_b")

    def __init__(self, a_end: np.ndarray, b_end: np.ndarray) -> None:
        self.link_a, self.link_b = map(np.array, links(a_end.tolist(), b_end.tolist()))
        closed = a_end[self.link_a] == b_end[self.link_b]  # a group ends where both tokens of a link do
        self.last_a, self.last_b = self.link_a[closed], self.link_b[closed]

    def each(self, a: list[int], b: list[int]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and of B, group by group."""
        i = j = 0
        for i2, j2 in zip(self.last_a.tolist(), self.last_b.tolist()):
            yield a[i : i2 + 1], b[j : j2 + 1]
            i, j = i2 + 1, j2 + 1

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Linked ids, a << 32 | b."""
        return a[self.link_a] << 32 | b[self.link_b]

    def text(self, a: np.ndarray, b: np.ndarray, both: Tokens) -> bytes:
        """The groups as ``a1,a2|b1;a3|b2,b3``: every id is written with the mark that follows it."""
        last_a, last_b = self.last_a, self.last_b
        at_a = np.arange(len(a)) + np.repeat(np.append(0, last_b[:-1] + 1), np.diff(last_a, prepend=-1))
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        parts = np.empty(len(a) + len(b), np.uint64)
        parts[at_a], parts[at_b] = both.text_a[0][a], both.text_b[0][b]
        parts[at_a[last_a]], parts[at_b[last_b]] = both.text_a[1][a[last_a]], both.text_b[1][b[last_b]]
        return parts.tobytes().translate(None, b"\0")[:-1]


def _held(docs: DataFrame, a_path: str, b_path: str) -> Callable[[], Tokens]:
    """Both vocabulary files, broadcast: fixed sizes."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        held = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    return lambda: _load(*held.value)


_GROUPS = T.ArrayType(T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("a", "b")]))
_GROUPS_ARROW = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs`` with ``groups``, an array of the ids of A and of B of every group; without tokens it is empty."""
    tokens = _held(docs, a_path, b_path)
    keep = [c for c in docs.columns if c != "groups"]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("groups", _GROUPS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokens()
        for part in (p for batch in batches for p in slices(batch, "text")):
            found = [both.encode(t.as_py()) for t in part.column(part.schema.get_field_index("text"))]
            made = [[{"a": x, "b": y} for x, y in Alignment(t[1], t[3]).each(t[0], t[2])] if t else [] for t in found]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, _GROUPS_ARROW)], schema.names)

    return docs.select(*keep).mapInArrow(run, schema)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_LONGS = T.ArrayType(T.LongType())


def _chunked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of two kinds: one per document (``pair`` NULL), with its counts, digest, and places and multiplicities of its
    distinct pairs in its chunk's list; and one per chunk (``places`` NULL), with its list of pairs, a << 32 | b, and the
    number of the chunk's documents that hold them."""
    tokens = _held(docs, a_path, b_path)
    keep = [c for c in docs.columns if c != "text"]
    fields = docs.select(*keep).schema.fields
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("__chunk", T.LongType()),
                           *[T.StructField(n, T.LongType()) for n in _COUNTS], T.StructField("groups_sha256", T.StringType()),
                           *[T.StructField(n, T.BinaryType()) for n in ("__places", "__times")],
                           *[T.StructField(n, _LONGS) for n in ("__pair", "__docs")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number = tokens(), TaskContext.get().partitionId() << 32
        chunk, size = _Chunk(schema, len(fields)), 0
        for part in (p for batch in batches for p in slices(batch, "__text")):
            at = part.schema.get_field_index("__text")
            made = []
            for text in part.column(at):
                text = text.as_py()
                found = both.encode(text)
                size += len(text or "")
                if found is None:
                    made.append((0, 0, 0, 0, "", None))
                    continue
                a, a_end, b, b_end = found
                aligned = Alignment(a_end, b_end)
                pairs = aligned.pairs(a, b)
                digest = hashlib.sha256(aligned.text(a, b, both)).hexdigest()
                made.append((len(a), len(b), len(aligned.last_a), len(pairs), digest, np.unique(pairs, return_counts=True)))
            chunk.add([c for i, c in enumerate(part.columns) if i != at], made)
            if size >= CHUNK_BYTES:
                yield from chunk.rows(number)
                chunk, size, number = _Chunk(schema, len(fields)), 0, number + 1
        yield from chunk.rows(number)

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)


class _Chunk:
    """Documents of a chunk until its list of pairs is complete."""

    def __init__(self, schema: T.StructType, kept: int) -> None:
        self.names, self.kept, self.parts = schema.names, kept, []

    def add(self, columns: list[pa.Array], made: list[tuple]) -> None:
        self.parts.append((columns, made))

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        held = [m[5][0] for _, made in self.parts for m in made if m[5] is not None]
        pairs, docs = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
        lists = pa.list_(pa.int64())
        for columns, made in self.parts:
            places = [None if m[5] is None else np.searchsorted(pairs, m[5][0]).astype("<u4").tobytes() for m in made]
            times = [None if m[5] is None else m[5][1].astype("<u4").tobytes() for m in made]
            n = len(made)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(n, number)), *[pa.array([m[k] for m in made], pa.int64()) for k in range(4)],
                 pa.array([m[4] for m in made], pa.string()), pa.array([p or b"" for p in places], pa.binary()),
                 pa.array([t or b"" for t in times], pa.binary()), pa.nulls(n, lists), pa.nulls(n, lists)], self.names)
        if len(pairs):
            none = [pa.nulls(1, c.type) for c in self.parts[0][0]]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array([number]), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 2,
                 pa.array([pairs], lists), pa.array([docs.astype(np.int64)], lists)], self.names)


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs`` without the text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair is held by as many
    documents as any pair of its A id) and count_sum (number of documents that hold a link's pair, over all links)."""
    made = (*_COUNTS, "n_best", "count_sum", "groups_sha256")
    docs = docs.select(*[c for c in docs.columns if c not in made])
    table = materialize(_chunked(docs, a_path, b_path), "aligned")
    lists = table.where("__pair IS NOT NULL").select("__chunk", F.explode(F.arrays_zip("__pair", "__docs")).alias("p"))
    lists = lists.select("__chunk", F.col("p.__pair").alias("pair"), F.col("p.__docs").alias("docs"))
    counts = lists.groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    judged = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    known = lists.select(F.col("__chunk").alias("of"), "pair").join(judged, "pair").select("of", "pair", "n", "top")
    rows = table.where("__pair IS NULL").drop("__pair", "__docs")
    keep = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[table.schema[c] for c in keep], *[T.StructField(n, T.LongType()) for n in (*_COUNTS, "n_best", "count_sum")],
                           T.StructField("groups_sha256", T.StringType())])

    def judge(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        by = np.argsort(pairs.column("pair").to_numpy(), kind="stable")  # order of the chunk's list
        n, top = pairs.column("n").to_numpy()[by], pairs.column("top").to_numpy(zero_copy_only=False)[by]
        held = [(np.frombuffer(p.as_py(), "<u4"), np.frombuffer(t.as_py(), "<u4").astype(np.int64))
                for p, t in zip(texts.column("__places"), texts.column("__times"))]
        new = {"n_best": [int(t[top[p]].sum()) for p, t in held], "count_sum": [int((t * n[p]).sum()) for p, t in held]}
        cols = [pa.array(new[c], pa.int64()) if c in new else texts.column(c) for c in schema.names]
        return pa.Table.from_arrays(cols, schema.names)

    return rows.groupBy("__chunk").cogroup(known.groupBy("of")).applyInArrow(judge, schema)
