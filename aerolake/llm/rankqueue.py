"""Byte-level BPE from a rank file, by a queue of merge ranks over a hierarchical bitmap.

A pre-token starts as a linked list of its bytes. Each pair of neighbours whose bytes together are a token waits in the bucket
of that token's rank; a bitmap of three levels of 64-bit words says which buckets hold something, so the next rank is found
with three find-first-set steps, however many ranks are in use. The bucket's positions are merged from left to right; each
merge links the right neighbour out and puts the two new pairs in their buckets. Entries whose pair has changed since are
stale and skipped. If a merge opens a lower rank, that rank comes first in its pre-token. The work is proportional to the
number of pairs that ever exist (at most three per byte) and independent of their order, which suits very long pre-tokens.
The pre-tokens of a slice of texts that are not known yet go through one queue together, closed off from each other.

Encoding is a narrow map over Arrow batches, a megabyte of text at a time: no shuffle. A worker holds the ranks; frequent
pre-tokens are looked up in memo tables that are bounded in bytes and emptied at the end of a task.

Defined results: NULL and empty texts have no tokens; there are no special tokens, their strings are plain text; a pre-token that is a
token itself is that token; repeated rows each get their own result; other columns are passed through unless they have the
name of an output column, in which case the output replaces them. A NULL array of ids decodes to an empty text.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aerolake.llm.pieces import Recent, Splitter, slices

#: Rows that are decoded at a time.
DECODE_ROWS = 256
DECODE_IDS = 1 << 16  # ids decoded at a time
#: Mark of the node that ends a pre-token.
CLOSE = -2


class RankQueue:
    """Buckets of positions by rank; ``first`` is the smallest rank whose bucket holds something."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, [position])
        else:
            bucket.append(position)

    def fill(self, rank: int, positions: list[int]) -> None:
        """Put positions into an empty bucket."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """Smallest rank that waits, or -1."""
        top = self.top
        if not top:
            return -1
        i = (top & -top).bit_length() - 1
        word = self.mid[i]
        i = i << 6 | (word & -word).bit_length() - 1
        word = self.low[i]
        return i << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empty a bucket; its positions from left to right."""
        i, j = rank >> 6, rank >> 12
        self.low[i] &= ~(1 << (rank & 63))
        if not self.low[i]:
            self.mid[j] &= ~(1 << (i & 63))
            if not self.mid[j]:
                self.top &= ~(1 << j)
        positions = self.buckets.pop(rank)
        positions.sort()
        return positions


class RankBPE:
    """A vocabulary of byte strings, each with its rank, which is its id."""

    def __init__(self, lines: bytes) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
        self.bytes = {r: t for t, r in self.ranks.items()}
        size = max(self.ranks.values(), default=0) + 1
        self.queue = RankQueue(size)
        # every id in decimal with a comma, closed by zero bytes; where its bytes lie among those of all, -1 long where there is none
        self._decimal = np.array([f"{r}," for r in range(size)], "S").view(np.uint8).reshape(size, -1)
        lengths = [len(self.bytes[r]) if r in self.bytes else -1 for r in range(size)]
        self._flat = np.frombuffer(b"".join(self.bytes[r] for r in range(size) if r in self.bytes), np.uint8)
        self._length = np.array(lengths, np.int64)
        self._start = np.concatenate([[0], np.cumsum(np.maximum(self._length, 0))[:-1]])
        self.byte_rank = np.array([self.ranks.get(bytes([c]), 0) for c in range(256)], np.int64)
        self.pair_rank = np.array([self.ranks.get(bytes([c, d]), -1) for c in range(256) for d in range(256)], np.int64)
        self._splitter, self._known, self._pieces = Splitter(), Recent(), Recent()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        cuts = [self._splitter.cut(t) if t else [""] for t in texts]
        ids = self._known.lookup(set().union(*[c[1:] for c in cuts]))  # runs after a blank
        spaced = self._splitter.spaced
        pieces = {r: spaced(r) for r, known in ids.items() if known is None}
        firsts = [self._splitter.split(c[0]) for c in cuts]
        made = self._pieces.lookup({p for found in [*pieces.values(), *firsts] for p in found})
        new = [p for p, known in made.items() if known is None]
        made.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        for r, found in pieces.items():
            ids[r] = made[found[0]] if len(found) == 1 else b"".join(map(made.__getitem__, found))
        self._known.keep(ids)
        # what is a run of its own after a blank is known as that
        self._pieces.keep({p: made[p] for found in pieces.values() if len(found) > 1 for p in found})
        return [b"".join([*map(made.__getitem__, f), *map(ids.__getitem__, c[1:])]) for f, c in zip(firsts, cuts)]

    def decode(self, ids: bytes) -> bytes:
        every = np.frombuffer(ids, "<u4")
        return b"".join([self._decoded(every[k : k + DECODE_IDS]) for k in range(0, len(every), DECODE_IDS)])

    def _decoded(self, ids: np.ndarray) -> bytes:
        length = self._length[ids]
        if length.min() < 0:
            raise KeyError(int(ids[length.argmin()]))
        ends = np.cumsum(length)
        return self._flat[np.repeat(self._start[ids] - ends + length, length) + np.arange(ends[-1])].tobytes()

    def listed(self, ids: bytes) -> bytes:
        """The ids in decimal, joined by commas."""
        digits = self._decimal[np.frombuffer(ids, "<u4")]
        return digits[digits != 0].tobytes()[:-1]

    def forget(self) -> None:
        """Empty the memo tables."""
        self._known.forget()
        self._pieces.forget()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, none of them empty, by one queue."""
        out = [self.ranks[p].to_bytes(4, "little") if p in self.ranks else b"" for p in pieces]
        rest = [k for k, ids in enumerate(out) if not ids]
        if not rest:
            return out
        text = b"".join([pieces[k] + b"\0" for k in rest])  # each is closed by a node that pairs with nothing
        data = np.frombuffer(text, np.uint8).astype(np.int64)
        n = len(data)
        close = np.cumsum([len(pieces[k]) + 1 for k in rest]) - 1
        waits = np.full(n, -1, np.int64)
        waits[:-1] = self.pair_rank[data[:-1] << 8 | data[1:]]
        waits[close - 1], waits[close] = -1, CLOSE
        links = np.arange(-1, n - 1)
        links[close[:-1] + 1] = -1
        at = np.flatnonzero(waits >= 0)
        at = at[np.argsort(waits[at], kind="stable")]
        edges = np.flatnonzero(np.diff(waits[at], prepend=-1))
        listed, ends = at.tolist(), np.append(edges[1:], len(at)).tolist()
        for rank, start, end in zip(waits[at[edges]].tolist(), edges.tolist(), ends):
            self.queue.fill(rank, listed[start:end])
        token = self.byte_rank[data].tolist()
        gone = self._merge(text, waits.tolist(), links.tolist(), close.tolist(), token)
        ids = np.array(token, "<u4")
        stays = np.frombuffer(gone, np.uint8) == 0
        stays[close] = False
        ends = np.cumsum(stays)[close].tolist()
        raw, start = ids[stays].tobytes(), 0
        for k, end in zip(rest, ends):
            out[k] = raw[4 * start : 4 * end]
            start = end
        return out

    def _merge(self, text: bytes, wait: list[int], before: list[int], close: list[int], token: list[int]) -> bytearray:
        """Merge what waits in the queue. ``wait`` holds the rank of a node's pair with the next one (-1: none, CLOSE: the
        node ends a pre-token), ``token`` the nodes' ids. Returns a mark for every node that is gone."""
        rank_of, queue = self.ranks.get, self.queue
        buckets, fill = queue.buckets, queue.fill
        after = list(range(1, len(text) + 1))
        gone = bytearray(len(text))
        while (rank := queue.first()) >= 0:
            held = -1
            for i in queue.take(rank):
                if wait[i] != rank:
                    continue  # stale: the pair has changed or the node is gone
                if i < held:
                    queue.push(rank, i)
                    continue
                j = after[i]
                after[i] = end = after[j]
                token[i], gone[j] = rank, 1
                wait[j] = wait[i] = -1
                lower = False
                if wait[end] != CLOSE:
                    before[end] = i
                    new = rank_of(text[i : after[end]])
                    if new is not None:
                        wait[i] = new
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            fill(new, [i])
                        lower = new < rank
                left = before[i]
                if left >= 0:
                    new = rank_of(text[left:end])
                    if new is None:
                        wait[left] = -1
                    else:
                        wait[left] = new
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            fill(new, [left])
                        lower = lower or new < rank
                if lower:
                    held = close[bisect_left(close, i)]  # the rest of this pre-token waits for the lower rank
        return gone


@lru_cache(maxsize=2)
def load(lines: bytes) -> RankBPE:
    """The vocabulary, kept by a worker; without memo tables between tasks."""
    return RankBPE(lines)


Row = Callable[[RankBPE, bytes], tuple]


def _mapped(docs: DataFrame, ranks_path: str, outputs: dict[str, tuple[T.DataType, pa.DataType]], row: Row) -> DataFrame:
    """``docs`` without the text, with the columns that ``row(bpe, ids)`` gives as a tuple."""
    with open(ranks_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: fixed size
    keep = [c for c in docs.columns if c not in outputs and c != "text"]
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(n, k[0]) for n, k in outputs.items()]])
    arrow = [k[1] for k in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(held.value)
        try:
            for part in (p for batch in batches for p in slices(batch, "__text")):
                at = part.schema.get_field_index("__text")
                rows = [row(bpe, ids) for ids in bpe.encode_texts(part.column(at).to_pylist())]
                made = [pa.array(list(c), k) for c, k in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if i != at], *made], schema.names)
        finally:
            bpe.forget()

    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (array of int) in place of the text."""

    def row(bpe: RankBPE, ids: bytes):
        return len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32)

    return _mapped(docs, ranks_path, {"n_tokens": (T.LongType(), pa.int64()),
                                      "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))}, row)


def decode(rows: DataFrame, ranks_path: str) -> DataFrame:
    """``rows`` with ``decoded``, the bytes of the column ``ids``."""
    with open(ranks_path, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in rows.columns if c != "decoded"]
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(held.value)
        for batch in batches:
            for k in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(k, DECODE_ROWS)
                ids = part.column(part.schema.get_field_index("ids"))
                texts = [bpe.decode(np.array(i.as_py() or [], "<u4").tobytes()) for i in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], schema.names)

    return rows.select(*keep).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 in place of the text."""

    def row(bpe: RankBPE, ids: bytes):
        return len(ids) // 4, hashlib.sha256(bpe.listed(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _mapped(docs, ranks_path, {"n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()),
                                      "decoded_sha256": (T.StringType(), pa.string())}, row)
