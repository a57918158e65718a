"""What the tokenizers of this subpackage share: cutting texts into pre-tokens, bounded memos, and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that a worker holds as Python objects at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of one generation of a memo (two are kept), what an entry takes beside its text and its ids, longest text kept.
MEMO_BYTES, ENTRY_BYTES, MEMO_LENGTH = 12 << 20, 160, 32
#: Entries of one generation where texts are kept by the slice.
MEMO_ENTRIES = 120_000
_SPACES = "\t-\r \x85\xa0  -     　"


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about SLICE_BYTES bytes of ``column``."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


class Memo(dict):
    """Text to ids, filled on demand and bounded in bytes. What was not asked for since the table was last full is
    forgotten, which changes no result."""

    def __init__(self, make: Callable[[str], bytes], limit: int = MEMO_BYTES) -> None:
        super().__init__()
        self.make, self.limit, self.old, self.size = make, limit, {}, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= MEMO_LENGTH:
            self.size += len(text) + len(ids) + ENTRY_BYTES
            if self.size > self.limit:
                self.old, self.size = dict(self), 0
                self.clear()
            self[text] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old, self.size = {}, 0


class Recent:
    """Text to ids in two generations, read and filled for many texts at a time. Entries are short, so their number bounds
    the bytes."""

    def __init__(self) -> None:
        self.new, self.old = {}, {}

    def lookup(self, texts: Iterable[str]) -> dict[str, bytes | None]:
        new, old = self.new, self.old
        return {t: new[t] if t in new else old.get(t) for t in texts}

    def keep(self, known: dict[str, bytes]) -> None:
        self.new.update({t: ids for t, ids in known.items() if len(t) <= MEMO_LENGTH})
        if len(self.new) > MEMO_ENTRIES:
            self.new, self.old = {}, self.new

    def forget(self) -> None:
        self.new, self.old = {}, {}


class Splitter:
    """Texts to pieces by the pattern of the byte-level vocabularies, and pieces to ids by ``encode_piece``."""

    def __init__(self, encode_piece: Callable[[str], bytes] | None = None, memo_bytes: int = MEMO_BYTES) -> None:
        self.find, self.find_any, self.odd_blank, self.lone_blank = _patterns()
        self.pieces, self.runs = Memo(encode_piece, memo_bytes), Memo(self._spaced, memo_bytes)

    def cut(self, text: str) -> list[str]:
        """The text without the blanks that stand between two other characters that are no white space. Such a blank always
        begins a piece, so the text can be cut there first: most of these runs are known, and a look-up is cheaper than the
        pattern."""
        return self.lone_blank.split(text) if self.odd_blank.search(text) else text.split(" ")

    def split(self, run: str) -> list[str]:
        """Pieces of a text or a part of it."""
        return (self.find if max(run, default="") < "\U00010000" else self.find_any)(run)

    def encode(self, text: str) -> bytes:
        runs = self.cut(text)
        return self._run(runs[0]) + b"".join(map(self.runs.__getitem__, runs[1:]))

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(run)))

    def spaced(self, run: str) -> list[str]:
        """Pieces of a blank and a part of a text; letters stay together."""
        return [" " + run] if run.isalpha() else self.split(" " + run)

    def _spaced(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.spaced(run)))

    def forget(self) -> None:
        self.pieces.forget()
        self.runs.forget()


def _patterns() -> tuple:
    """Piece splitters for texts within the BMP, with character classes spelled out, and for any text; patterns for a blank
    beside other white space and for one that is not."""
    import re

    import regex

    def ranges(prop: str) -> str:
        member, out, start = regex.compile(rf"\p{{{prop}}}"), [], None
        for c in range(0x10001):
            inside = c < 0x10000 and not 0xD800 <= c < 0xE000 and bool(member.match(chr(c)))
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
                start = None
        return "".join(out)

    def pattern(letter: str, number: str) -> str:
        s = _SPACES
        # the contractions only compete with the run of other characters, so the frequent kinds are tried first
        return (rf" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{s}{letter}{number}]+"
                rf"|[{s}]+(?![^{s}])|[{s}]+")

    return (re.compile(pattern(ranges("L"), ranges("N"))).findall, regex.compile(pattern(r"\p{L}", r"\p{N}")).findall,
            re.compile(f" [{_SPACES}]|[{_SPACES}] "), re.compile(f"(?<![{_SPACES}]) (?![{_SPACES}])"))
