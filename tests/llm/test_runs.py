"""Periodic runs against all starts and periods."""

import hashlib
import random
import zlib

import pytest

from aerolake.llm import runs
from aerolake.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.helpers import documents, words


def own_runs(w):
    """Maximal stretches by every period in turn, with the smallest period only."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def own_digest(w):
    found = own_runs(w)
    best = min(found, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


def periodic(rnd):
    out = []
    for _ in range(rnd.randint(1, 5)):
        turn = [rnd.choice("abc") for _ in range(rnd.randint(1, 6))]
        out += (turn * 12)[: rnd.randint(1, 6 * len(turn))]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_random_words(seed):
    rnd = random.Random(seed)
    texts = [[rnd.choice("ab") for _ in range(rnd.randint(0, 60))] for _ in range(60)] + [periodic(rnd) for _ in range(60)]
    texts += [[], ["a"], ["a"] * rnd.randint(1, 300), list("ab") * rnd.randint(1, 60), (list("aab") * 9 + ["x"]) * 7]
    got = runs.find_runs([[x.encode() for x in t] for t in texts])
    assert got == [own_runs(t) for t in texts]


def test_runs_of_long_texts():
    rnd = random.Random(3)
    turn = [str(rnd.random()).encode() for _ in range(9000)]
    assert runs.find_runs([turn * 5, [b"a"] * 60_000, turn * 3, turn]) == [[(0, 45000, 9000)], [(0, 60_000, 1)], [], []]
    assert runs.find_runs([]) == []


def test_runs_of_table(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n", "a b a b a b a b", "é é é\x0bé é\x0cé\xa0é", "x" * 200_000, "w " * 9000]
    texts += [" ".join(periodic(rnd)) for _ in range(50)]
    rows = list(enumerate(texts))
    docs = documents(spark, rows + [rows[3], (None, "a a a a a a")], "n_runs runs start collapsed")
    got = runs.digests(docs).collect()
    assert len(got) == len(rows) + 2 and sum(r.doc_id == 3 for r in got) == 2
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for r in got:
        assert tuple(r[n] for n in names) == own_digest(words(texts[r.doc_id] if r.doc_id is not None else "a a a a a a"))
    for r in runs.runs(docs).collect():
        if r.doc_id == 3:
            assert [tuple(x) for x in r.runs] == [(0, 8, 2)] and r.collapsed == "a b"
    assert runs.digests(documents(spark, [])).count() == 0 and runs.runs(documents(spark, [])).count() == 0


def test_query_against_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_runs"](spark, SF).collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) > 5
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for r in got:
        w = words(docs[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n < 3000:
            assert tuple(r[x] for x in names) == own_digest(w)
