"""Periodic runs of words in texts, by uniting suffix classes in order of decreasing LCP.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word extends
keeping period q, and that is at least LEAST_TURNS periods and LEAST_WORDS words long.

The suffixes of a text that share at least l words form classes. Going down in l, neighbours in suffix order whose common
prefix has l words are united (Kruskal's order, union-find); every class holds its positions in order. When a union makes
two positions i < j neighbours in their class and j - i <= l, the words from i to j + l have period j - i, it is the smallest
one, and l is the exact common prefix, so the stretch cannot go on to the right. It seeds a run; it is the run itself if the
words before i and before j differ (every run is seeded there, too, so no other seed is needed). Only common prefixes of
LEAST_WORDS - 1 words or more can seed a run, so positions whose words occur once are left out of the suffix order early.

Suffixes of about a megabyte of texts are ordered together by prefix doubling in NumPy; words carry their text's number, so
no class spans two texts. Common prefixes are compared only where the words before differ and follow from those elsewhere.
Everything is linear in memory, whatever the length of a text, and there is no shuffle: one narrow map over Arrow batches.

Defined results: NULL texts, empty texts and texts without words have no run; repeated rows each get their own result; ties
between longest runs go to the smallest start, then the smallest period; other columns are passed through unless they have
the name of an output column, in which case the output replaces them. A NULL id is an id like any other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aerolake.llm.pieces import slices

#: Fewest words and fewest periods of a run.
LEAST_WORDS, LEAST_TURNS = 6, 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Run = tuple[int, int, int]
#: Given a row's id and its words, the words to look at.
Edit = Callable[[object, list[bytes]], list[bytes]]


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of bytes other than blank, tab, line feed, vertical tab, form feed, carriage return."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """(start, length, period) of all runs of every text, by start, then period."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)  # each text is closed by a word of its own
    n = int(sizes.sum())
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=begin[1:])
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    word = np.zeros(n, np.int64)
    for t, b in zip(texts, begin):
        word[b : b + len(t)] = np.fromiter(map(number.__getitem__, t), np.int64, len(t))
    of_text = np.repeat(np.arange(len(texts)), sizes)
    word += of_text * (len(number) + 1)
    close = begin[1:] - 1
    word[close] = -1 - np.arange(len(texts))
    found: list[list[Run]] = [[] for _ in texts]
    order = _suffix_order(word)
    if len(order) > 1:
        lcp = _common_prefixes(word, order)
        for start, length, period in _seeds(word, order, lcp):
            k = of_text[start]
            found[k].append((int(start - begin[k]), length, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def _suffix_order(word: np.ndarray) -> np.ndarray:
    """Positions in suffix order, without those whose LEAST_WORDS - 1 words do not come again in their text."""
    _, index = np.unique(word, return_inverse=True)
    size = np.bincount(index)
    rank = (np.cumsum(size) - size)[index]  # rank of a class: number of suffixes before it
    open_ = np.flatnonzero(size[index] > 1)
    width, kept = 1, None
    while len(open_):
        if kept is None and 2 * width >= LEAST_WORDS:
            kept = open_  # every position in a class of `width` < LEAST_WORDS words is still here
        key = rank[open_]
        # a class of several positions lies within one text, and its words end before the text's closing word
        after = rank[open_ + width]
        by = np.lexsort((after, key))
        at, key, after = open_[by], key[by], after[by]
        new_class = np.ones(len(at), bool)
        new_class[1:] = (key[1:] != key[:-1]) | (after[1:] != after[:-1])
        new_key = np.ones(len(at), bool)
        new_key[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new_class)
        index = np.cumsum(new_class) - 1
        head = np.maximum.accumulate(np.where(new_key, np.arange(len(at)), 0))
        rank[at] = key + first[index] - head
        counts = np.diff(np.append(first, len(at)))
        open_ = at[counts[index] > 1]
        width *= 2
    if kept is None:
        return np.zeros(0, np.int64)
    return kept[np.argsort(rank[kept], kind="stable")]


def _common_prefixes(word: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words that neighbours in suffix order share. Where the words before two neighbours are equal, their common prefix is
    one word shorter than that of the positions before; only the others are compared, and their lengths sum to O(n log n)."""
    n = len(word)
    before = np.full(n, -1, np.int64)  # position -> the one in front of it in suffix order
    before[order[1:]] = order[:-1]
    here = np.flatnonzero(before >= 0)
    there = before[here]
    follows = (here > 0) & (there > 0) & (word[here - 1] == word[there - 1])
    # the step is only sound if the pair before are neighbours, too
    follows &= before[here - 1] == there - 1
    free = np.flatnonzero(~follows)
    common = np.zeros(len(here), np.int64)
    common[free] = _compare(word, there[free], here[free])
    # `here` ascends, and a pair that follows comes right after the pair it follows
    root = np.maximum.accumulate(np.where(follows, 0, np.arange(len(here))))
    common = common[root] - (here - here[root])
    lcp = np.zeros(n, np.int64)
    lcp[here] = common
    return lcp[order[1:]]


def _compare(word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share: a few steps for all together, then each on its own by doubling slices."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for step in range(16):
        live = live[word[a[live] + step] == word[b[live] + step]]
        out[live] = step + 1
    for k in live.tolist():
        i, j, m = int(a[k]) + 16, int(b[k]) + 16, 32
        while True:
            x, y = word[i : i + m], word[j : j + m]
            size = min(len(x), len(y))
            apart = np.flatnonzero(x[:size] != y[:size])
            if len(apart):
                out[k] = i + int(apart[0]) - int(a[k])
                break
            i, j, m = i + size, j + size, m * 2
    return out


def _seeds(word: np.ndarray, order: np.ndarray, lcp: np.ndarray) -> Iterator[Run]:
    """Runs from the newly adjacent positions of classes united by decreasing common prefix."""
    wanted = np.flatnonzero(lcp >= LEAST_WORDS - 1)
    wanted = wanted[np.argsort(-lcp[wanted], kind="stable")]
    place, values = order.tolist(), word
    parent: dict[int, int] = {}
    held: dict[int, list[int]] = {}

    def find(x: int) -> int:
        if x not in parent:
            parent[x] = x
            held[x] = [place[x]]
            return x
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, common in zip(wanted.tolist(), lcp[wanted].tolist()):
        a, b = find(k), find(k + 1)
        if len(held[a]) < len(held[b]):
            a, b = b, a
        parent[b] = a
        many, few = held[a], held.pop(b)
        new: list[tuple[int, int]] = []
        last = len(few) - 1
        for m, x in enumerate(few):
            at = bisect_left(many, x)
            # neighbours from the other class only; those of the same class were neighbours before or have one in between
            if at and (m == 0 or many[at - 1] != few[m - 1]):
                new.append((many[at - 1], x))
            if at < len(many) and (m == last or many[at] < few[m + 1]):
                new.append((x, many[at]))
            many.insert(at, x)
        for i, j in new:
            period = j - i
            if period <= common and common + period >= LEAST_WORDS and common >= (LEAST_TURNS - 1) * period:
                if i == 0 or values[i - 1] != values[j - 1]:
                    yield i, common + period, period


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words without those that any run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    inside = np.cumsum(edge)
    return [w for w, c in zip(words, inside.tolist()) if c == 0]


def longest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then smallest period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _mapped(docs: DataFrame, outputs: dict[str, tuple[T.DataType, pa.DataType]], row, id_col: str, edit: Edit | None) -> DataFrame:
    """``docs`` without the text, with the columns that ``row(words, runs)`` gives as a tuple."""
    keep = [c for c in docs.columns if c not in outputs and c != "text"]
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(n, k[0]) for n, k in outputs.items()]])
    arrow = [k[1] for k in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "__text")):
            texts = [words_of(t.as_py()) for t in part.column(part.schema.get_field_index("__text"))]
            if edit is not None:
                ids = part.column(part.schema.get_field_index("__id")).to_pylist()
                texts = list(map(edit, ids, texts))
            rows = list(map(row, texts, find_runs(texts)))
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows), arrow)]
            cols = [part.column(i) for i, n in enumerate(part.schema.names) if n not in ("__text", "__id")]
            yield pa.RecordBatch.from_arrays([*cols, *made], schema.names)

    return docs.select(*keep, docs[id_col].alias("__id"), docs["text"].alias("__text")).mapInArrow(run, schema)


def runs(docs: DataFrame, id_col: str = "doc_id", edit: Edit | None = None) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period), and ``collapsed``, the kept words joined by one blank,
    in place of the text."""

    def row(words: list[bytes], found: list[Run]):
        return [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(collapse(words, found)).decode("utf-8", "replace")

    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    return _mapped(docs, {"runs": (kind, pa.list_(_RUN)), "collapsed": (T.StringType(), pa.string())}, row, id_col, edit)


def digests(docs: DataFrame, id_col: str = "doc_id", edit: Edit | None = None) -> DataFrame:
    """``docs`` with number of runs, the longest one, and digests of all runs and of the kept words, in place of the text."""

    def row(words: list[bytes], found: list[Run]):
        best = longest(found)
        start, length, period = best or (None, None, None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
        return (len(found), start, length, period, 1000 * length // period if best else None,
                hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapse(words, found))).hexdigest())

    long, text = (T.LongType(), pa.int64()), (T.StringType(), pa.string())
    return _mapped(docs, {"n_runs": long, "start": long, "length": long, "period": long, "exponent_milli": long,
                          "runs_sha256": text, "collapsed_sha256": text}, row, id_col, edit)
