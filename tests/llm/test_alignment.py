"""Token alignment against plain Python over the libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from aerolake.llm import alignment
from aerolake.llm.queries import QUERIES, piece_model, vocabulary
from tests.conftest import SF
from tests.llm.helpers import documents


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_model())


def own_alignment(libraries, text):
    """(ids of A, ids of B, groups, links) by interval overlap; None if the bytes are not kept."""
    a, b = libraries
    if not text:
        return None
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(c): c for c in letters} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in letters)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    spans = lambda raw: [(sum(map(len, raw[:k])), sum(map(len, raw[: k + 1]))) for k in range(len(raw))] if len(raw) < 200 else fast(raw)
    def fast(raw):
        out, at = [], 0
        for t in raw:
            out.append((at, at + len(t)))
            at += len(t)
        return out
    sa, sb = spans(raw_a), spans(raw_b)
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, links, i, j = [], [], 0, 0
    for cut in cuts:
        i2, j2 = i, j
        while i2 < len(sa) and sa[i2][1] <= cut:
            i2 += 1
        while j2 < len(sb) and sb[j2][1] <= cut:
            j2 += 1
        groups.append((ids_a[i:i2], ids_b[j:j2]))
        links += [(ids_a[x], ids_b[y]) for x in range(i, i2) for y in range(j, j2) if sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1]]
        i, j = i2, j2
    return ids_a, ids_b, groups, links


def check(libraries, texts, got):
    """``texts`` and ``got`` by key; a key for every row."""
    own = {k: own_alignment(libraries, t) for k, t in texts.items()}
    counts = Counter(p for o in own.values() if o for p in set(o[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    for k, r in got.items():
        if own[k] is None:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, 0, "")
            continue
        ids_a, ids_b, groups, links = own[k]
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(ids_a), len(ids_b), len(groups), len(links))
        assert r.groups_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_best, r.count_sum) == (sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links))
    assert len(got) == len(texts)


def test_groups_and_links_of_random_ends():
    rnd = random.Random(4)
    for _ in range(3000):
        total = rnd.randint(1, 60)
        cut = lambda share: sorted({total, *(e for e in range(1, total) if rnd.random() < share)})
        a = cut(rnd.random())
        b = sorted({total, *(e for e in a if rnd.random() < 0.9), *(e for e in range(1, total) if rnd.random() < 0.1)})
        found = alignment.Alignment(np.array(a), np.array(b))
        assert [a[i] for i in found.last_a] == [b[j] for j in found.last_b] == sorted(set(a) & set(b))
        ends = lambda t, k: (t[k - 1] if k else 0, t[k])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if ends(a, i)[0] < ends(b, j)[1] and ends(b, j)[0] < ends(a, i)[1]]
        assert list(zip(found.link_a.tolist(), found.link_b.tolist())) == want


def test_table_against_plain_python(spark, libraries, monkeypatch):
    rnd = random.Random(7)
    bits = ["a", "the", "'s", " ", "  ", "\n", "\t", "é", "Ω", "漢", "1", "2024", "😀", "<|endoftext|>", "<s>", "<0x41>", "▁", "zzzz", "\x00", "tion", "under", "!"]
    texts = [None, "", " ", "▁", "word " * 30_000, "x" * 3000, *["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(300)]]
    texts += texts[6:20]
    texts = dict(enumerate(texts))
    docs = documents(spark, list(texts.items()), "n_a groups pair n").repartition(3)
    got = alignment.link_counts(docs, vocabulary(), piece_model())
    assert set(docs.columns) - {"text"} <= set(got.columns)
    check(libraries, texts, {r.doc_id: r for r in got.collect()})
    assert sum(own_alignment(libraries, t) is None for t in texts.values()) > 3
    for r in alignment.groups(docs, vocabulary(), piece_model()).where("doc_id < 60").collect():
        own = own_alignment(libraries, texts[r.doc_id])
        assert [(list(g.a), list(g.b)) for g in r.groups] == (own[2] if own else [])
    empty = documents(spark, [])
    assert alignment.link_counts(empty, vocabulary(), piece_model()).count() == alignment.groups(empty, vocabulary(), piece_model()).count() == 0
    null_ids = documents(spark, [(None, "the end"), (None, "the end"), (None, None)])
    assert sorted(r.count_sum for r in alignment.link_counts(null_ids, vocabulary(), piece_model()).collect()) == [0, 4, 4]


def test_many_chunks(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 400)
    texts = {k: "the quick brown fox %d tokenisation " % (k % 7) * (1 + k % 5) for k in range(60)}
    docs = documents(spark, list(texts.items())).coalesce(2)
    check(libraries, texts, {r.doc_id: r for r in alignment.link_counts(docs, vocabulary(), piece_model()).collect()})


def test_query_against_plain_python(spark, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_alignment"](spark, SF)
    check(libraries, texts, {r.doc_id: r for r in got.collect()})
