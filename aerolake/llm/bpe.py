"""Byte-level BPE: encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece there is exactly one token that ends its BPE encoding. It is found from left to right: an
Aho-Corasick automaton over the vocabulary gives all tokens that are suffixes of the prefix, and the right one is the one
that is compatible with the last token of the shorter prefix in front of it, two tokens being compatible if BPE leaves
their concatenation as this pair. Following the stored tokens back from the end gives the ids. The work is linear in the
piece, however long it is and however its merges are nested.

Encoding is a narrow map over Arrow batches, a megabyte of text at a time: no shuffle, and each worker holds the vocabulary
and the automaton. Frequent pieces are looked up in memo tables that are bounded in bytes and emptied at the end of a task.

Defined results: NULL and empty texts have no tokens; the special tokens of the vocabulary file are recognised inside
texts; other columns are passed through as they are unless they have the name of an output column, in which case the
output replaces them.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aerolake.llm.pieces import MEMO_BYTES, Splitter, slices

#: Token pairs of which a worker remembers whether they are compatible.
MEMO_PAIRS = 200_000
#: Bytes of a memo's generation where the worker does nothing else; in a pipeline, executors are fuller (MEMO_BYTES).
ALONE_BYTES = 40 << 20
#: Rows that are decoded at a time.
DECODE_ROWS = 256


class ByteBPE:
    """A byte-level BPE vocabulary, read from the JSON text of a tokenizers file."""

    def __init__(self, spec: str, memo_bytes: int = MEMO_BYTES) -> None:
        import ahocorasick

        spec = json.loads(spec)
        letters = byte_letters()
        to_byte = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        raw = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.rank: dict[int, int] = dict.fromkeys(raw, -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[z], self.left[z], self.right[z], self.merge[x, y] = r, x, y, r
        self.length = {i: len(t) for i, t in raw.items()}
        self.automaton = ahocorasick.Automaton()
        for i, t in raw.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = raw | {i: s.encode() for s, i in self.special.items()}
        self._pairs: dict[int, bool] = {}
        self._plain = Splitter(self._piece, memo_bytes)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps ``a`` and ``b`` apart. Their merges are undone, latest first; the pair at the seam must not
        have a merge that comes before the one undone last (nor at the same rank on the right: BPE goes left to right)."""
        x, y, before = a, b, sys.maxsize
        while True:
            if self.merge.get((x, y), sys.maxsize) < before:
                good = False
                break
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                good = True
                break
            if rx > ry:
                x, before = self.right[x], rx
            else:
                y, before = self.left[y], ry + 1
        if len(self._pairs) >= MEMO_PAIRS:
            self._pairs.clear()
        self._pairs[a << 32 | b] = good
        return good

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, whose characters stand for its bytes (latin-1)."""
        n = len(piece)
        last = [-1] * (n + 1)
        known, length = self._pairs, self.length
        for end, (token, size) in self.automaton.iter(piece):
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    before = last[start]
                    good = known.get(before << 32 | token)
                    if good is None:
                        good = self.compatible(before, token)
                    if not good:
                        continue
                last[end] = token
        ids = []
        while n:
            ids.append(last[n])
            n -= length[last[n]]
        return ids[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special and any(s in text for s in self.special):
            return self._encode_special(text)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        """As ``encode``, but special tokens inside the text are plain text."""
        return self._plain.encode(text)

    def forget(self) -> None:
        """Empty the memo tables."""
        self._plain.forget()
        self._pairs.clear()

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode().decode("latin-1")), "<u4").tobytes()

    def _encode_special(self, text: str) -> bytes:
        out, at = [], 0
        while True:
            # leftmost special token, the longest at that place
            hits = [(text.find(s, at), -len(s), s) for s in self.special]
            hits = [h for h in hits if h[0] >= 0]
            if not hits:
                return b"".join([*out, self.encode_plain(text[at:])])
            i, _, s = min(hits)
            out += [self.encode_plain(text[at:i]), self.special[s].to_bytes(4, "little")]
            at = i + len(s)

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes.__getitem__, tokens)).decode("utf-8", "replace")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load(spec: str, memo_bytes: int = MEMO_BYTES) -> ByteBPE:
    """The vocabulary, kept by a worker; without memo tables between tasks."""
    return ByteBPE(spec, memo_bytes)


def _mapped(docs: DataFrame, vocab_path: str, outputs: dict[str, tuple[T.DataType, pa.DataType]], row,
            memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """``docs`` with output columns that ``row(bpe, text)`` gives as a tuple."""
    with open(vocab_path, encoding="utf-8") as f:
        spec = f.read()
    held = docs.sparkSession.sparkContext.broadcast(spec)  # the vocabulary file: fixed size, and not on every executor
    keep = [c for c in docs.columns if c not in outputs]
    source = docs.select(*keep)
    # texts come last so that other columns can be passed on without a copy
    schema = T.StructType([*source.schema.fields, *[T.StructField(n, k[0]) for n, k in outputs.items()]])
    arrow = [k[1] for k in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(held.value, memo_bytes)
        try:
            for part in (p for batch in batches for p in slices(batch, "__text")):
                rows = [row(bpe, t.as_py()) for t in part.column(part.schema.get_field_index("__text"))]
                made = [pa.array(list(c), k) for c, k in zip(zip(*rows), arrow)]
                cols = [part.column(i) for i, n in enumerate(part.schema.names) if n != "__text"]
                yield pa.RecordBatch.from_arrays([*cols, *made], schema.names)
        finally:
            bpe.forget()

    return source.withColumn("__text", docs["text"]).mapInArrow(run, schema)


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (array of int); the text stays."""

    def row(bpe: ByteBPE, text: str | None):
        ids = np.frombuffer(bpe.encode(text), "<u4").astype(np.int32)
        return len(ids), ids

    return _mapped(docs, vocab_path, {"n_tokens": (T.LongType(), pa.int64()),
                                      "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))}, row)


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``ids`` and ``decoded_sha256``, the digest of the text that the ids decode
    to: encoding and decoding in one pass, so decoded texts never leave the worker."""

    def row(bpe: ByteBPE, text: str | None):
        ids = bpe.encode(text)
        return len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    out = _mapped(docs, vocab_path, {"n_tokens": (T.LongType(), pa.int64()), "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
                                     "decoded_sha256": (T.StringType(), pa.string())}, row)
    return out.drop("text")


def decode(rows: DataFrame, vocab_path: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of the column ``ids``; a NULL array gives an empty text."""
    with open(vocab_path, encoding="utf-8") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in rows.columns if c != "decoded"]
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(held.value)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for k in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(k, DECODE_ROWS)
                texts = [bpe.decode(np.array(i.as_py() or [], "<u4").tobytes()) for i in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return rows.select(*keep).mapInArrow(run, schema)


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 in place of the text: ids and decoded texts never leave the
    worker that made them."""

    def row(bpe: ByteBPE, text: str | None):
        ids = bpe.encode(text)
        back = bpe.decode(ids).encode()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    out = _mapped(docs, vocab_path, {"n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()),
                                     "decoded_sha256": (T.StringType(), pa.string())}, row, ALONE_BYTES)
    return out.drop("text")
