"""Encoding by the rank queue against the library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from aerolake.llm import rankqueue
from aerolake.llm.queries import QUERIES, rank_file
from tests.conftest import SF
from tests.llm.helpers import documents


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_file(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(2)
    bits = ["a", "the", "'s", "'re", "'S", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "é", "Ω", "漢", "1", "²", "𝒜", "😀", "‍",
            "_", "...", "<|endoftext|>", "zzzz", "́", "\x00", "\r\n", "ab", "q"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(800)]


def test_queue_finds_the_first_rank():
    rnd = random.Random(8)
    queue, held = rankqueue.RankQueue(300_000), {}
    for _ in range(4000):
        if held and rnd.random() < 0.4:
            rank = queue.first()
            assert rank == min(held) and queue.take(rank) == sorted(held.pop(rank))
        else:
            rank, at = rnd.choice([rnd.randrange(300_000), rnd.randrange(70)]), rnd.randrange(1000)
            queue.push(rank, at)
            held.setdefault(rank, []).append(at)
    while held:
        rank = queue.first()
        assert rank == min(held) and queue.take(rank) == sorted(held.pop(rank))
    assert queue.first() == -1


def test_any_ranks_against_plain_merges():
    """Vocabularies whose longer tokens may have lower ranks than their parts."""
    rnd = random.Random(6)
    for _ in range(300):
        tokens = {bytes([c]) for c in b"abc"} | {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(rnd.randint(1, 25))}
        order = sorted(tokens)
        rnd.shuffle(order)
        bpe = rankqueue.RankBPE(b"\n".join(base64.b64encode(t) + b" %d" % r for r, t in enumerate(order)))
        piece = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))] if piece not in bpe.ranks else [piece]
        while True:
            pairs = [(bpe.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in bpe.ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = b"".join(bpe.ranks[p].to_bytes(4, "little") for p in parts)
        given = [piece, b"ab", piece[::-1], piece]
        assert bpe.encode_pieces(given)[::3] == [want, want] and bpe.encode_pieces([piece]) == [want] and bpe.queue.first() == -1


def test_table_against_library(spark, library):
    texts = [None, "", "a" * 100_000, "ab" * 30_000 + " x", "漢字" * 20_000, " " * 5000, "=" * 9000, *odd_texts()]
    docs = documents(spark, list(enumerate(texts)), "ids decoded n_tokens")
    rows = rankqueue.decode(rankqueue.encode(docs, rank_file()), rank_file()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want) and bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    empty = documents(spark, [])
    assert rankqueue.encode(empty, rank_file()).count() == rankqueue.digests(empty, rank_file()).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in rankqueue.decode(nulls, rank_file()).collect()] == [b""]


def test_query_against_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_rank_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_ids_are_listed_and_decoded_by_table():
    words = {0: b"a", 1: b"\0", 3: "é".encode(), 12: b"abc" * 40}  # ranks with gaps, a zero byte, a long token
    bpe = rankqueue.RankBPE(b"\n".join(base64.b64encode(t) + b" %d" % r for r, t in words.items()))
    pack = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    for ids in ([], [0], [12, 3, 1, 0], [3, 12, 0] * rankqueue.DECODE_IDS):
        assert bpe.decode(pack(ids)) == b"".join(words[i] for i in ids)
        assert bpe.listed(pack(ids)) == ",".join(map(str, ids)).encode()
    for bad in (2, 99):
        with pytest.raises((KeyError, IndexError)):
            bpe.decode(pack([0, bad]))
