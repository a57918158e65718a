"""Near-dedup, quality, mixing, sharding, embeddings, nearest neighbours."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.llm import covertree, hyperminhash, mih, mixing, quality, sharding
from aerolake.llm.common import read
from aerolake.session import materialize
from tests.conftest import SF
from tests.llm.helpers import documents, near_components, shingles, words


def near_docs():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    docs, base = [], [[rnd.choice(vocab) for _ in range(n)] for n in (6, 9, 12, 30, 60, 200, 400)]
    for d in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append((d, rnd.choice([" ", "\n"]).join(w)))
    chain = [rnd.choice(vocab) for _ in range(200)]  # each close to the next, the ends are not
    for d in range(150, 170):
        docs.append((d, " ".join(chain)))
        at = rnd.randrange(200 - 20)
        chain[at : at + 20] = [rnd.choice(vocab) for _ in range(20)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "A b"), (204, "a  B"), (205, "a b c"), (206, "É É É É É"), (207, "é é é é é")]
    return docs


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    docs = near_docs()
    want = near_components(docs)
    rows = hyperminhash.near_duplicates(documents(spark, docs + [docs[0], (None, docs[1][1]), (None, None)], "bands print rep")).collect()
    assert len(rows) == len(docs) + 3
    sizes = {d: len(shingles(t)) for d, t in docs}
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = hyperminhash.drop_near_duplicates(documents(spark, docs)).select("doc_id").collect()
    assert {r[0] for r in kept} == {d for d, c in want.items() if d == c}
    assert hyperminhash.near_duplicates(documents(spark, [])).count() == 0


def test_register_estimate():
    rng = np.random.default_rng(1)
    for size in (8, 100, 3000):
        errors = []
        for _ in range(60):
            union = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            cut = size // 8
            a, b = np.unique(union[: size - cut]), np.unique(union[cut:])
            regs = hyperminhash.registers([a, b])
            errors.append(hyperminhash.estimate(regs[0], regs[1]) - len(np.intersect1d(a, b)) / size)
        assert abs(np.mean(errors)) < 0.04


def test_no_pair_of_small_sets_is_dropped_before_verification():
    """Pairs at exactly 0.75: 3 k shared shingles of 4 k in all."""
    rng = np.random.default_rng(11)
    lost = 0
    for union in (4, 8, 12, 16, 20):
        shared = 3 * union // 4
        for _ in range(2000):
            x = np.unique(rng.integers(0, 2**63, union, dtype=np.int64).view(np.uint64))
            rng.shuffle(x)
            cut = rng.integers(0, union - shared + 1)
            a, b = np.sort(x[: shared + cut]), np.sort(np.concatenate([x[:shared], x[shared + cut :]]))
            regs = hyperminhash.registers([a, b])
            size = np.array([len(a), len(b)])
            close = hyperminhash.may_be_close(regs[:1], regs[1], size[:1], size[1], 75)
            assert close[0]
            bands = regs.view("<i8")
            lost += not (bands[0] == bands[1]).any()
    assert lost <= 1  # banding loses 5 in a million


def test_quality_of_an_id_repeated_in_most_rows(spark):
    docs = [(i, ("good words here " if i % 2 else "xq zz kk ") * 20 + str(i)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int")
    once = {r.doc_id: r for r in quality.select_top(documents(spark, docs), labels)[0].collect()}
    often, model = quality.select_top(documents(spark, docs + [docs[3]] * 200), labels)
    assert often.count() == 260 and {r.doc_id for r in often.collect()} == set(once)


def test_quality_on_held_out_labels(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    extra = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionAll(extra).withColumn("rank", F.lit("clash")).withColumn("quality", F.lit(5))
    half = labels.where("doc_id % 2 = 0")
    rows, _ = quality.select_top(docs, half)
    rows = rows.join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    assert len(rows) > 100
    assert np.mean([r.kept for r in rows if r.quality]) >= 0.98 and np.mean([not r.kept for r in rows if not r.quality]) >= 0.9
    picked, _ = quality.select_top(docs, half)
    ids = {r.doc_id for r in picked.where("kept").collect()}
    kept = quality.resample(docs, half)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == ids
    draws = sorted(((r.draw, r.rank, r.kept) for r in picked.collect()), reverse=True)
    assert [d[1] for d in draws] == list(range(len(draws))) and sum(d[2] for d in draws) == sum(r.log_weight > 0 for r in picked.collect())


def test_quality_without_both_classes(spark):
    docs = documents(spark, [(1, "a b"), (2, None), (None, ""), (1, "a b")])
    labels = spark.createDataFrame([(1, 1, 0), (9, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, labels).count() == 4
    rows, _ = quality.select_top(docs, labels.limit(0))
    assert rows.where("kept").count() == 4
    assert quality.select_top(documents(spark, []), labels)[0].count() == 0


def byte_trigrams(text):
    b = text.encode()
    return len(b) - 2 if len(b) > 2 else 0


def test_ngram_counts_by_row():
    texts = ["", "ab", "abc", "é", "Stop stop STOP!! 12 | x", " lead and trail \n", "word"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    grams, at = quality.byte_ngrams(data, offsets)
    assert np.diff(at).tolist() == [byte_trigrams(t) for t in texts] and len(grams) == at[-1]
    shapes, at = quality.shape_ngrams(data, offsets)
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    for k, t in enumerate(texts):  # a row's n-grams do not depend on its neighbours
        alone = np.frombuffer(t.encode(), np.uint8)
        assert quality.shape_ngrams(alone, np.array([0, len(alone)]))[0].tolist() == shapes[at[k] : at[k + 1]].tolist()


def filled(sizes, weights, share, most):
    """Clamp and share again until nothing is above its clamp."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest, left = total - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / left for s in names}
        over = {s for s in names if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_against_plain_python(spark):
    rnd = random.Random(3)
    rows = [(d, " ".join("w" * 1 for _ in range(int(rnd.paretovariate(1.1) * 10) % 700)), rnd.choice(["a", "a", "a", "b", "Z", "é", None])) for d in range(300)]
    rows += [(300, None, "a"), (301, "", "only empty"), (302, " \t", "only empty")]
    df = documents(spark, rows + [rows[0]], "size target")
    plan = mixing.plan_mix(df.drop("size", "target")).collect()
    rows = rows + [rows[0]]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = filled(sizes, (3, 1, 2), 1.5, 2.0)
    taken = Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12, abs=1e-9)
        assert r.whole * r.size <= r.taken <= min(2 * r.size, (r.whole + 1) * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.plan_mix(documents(spark, rows).repartition(7)).collect()
    key = lambda p: sorted((r.doc_id, r.size, r.taken) for r in p)
    assert key(plan) == key(again)
    # the mix itself: whole copies, and the part-document rounded
    by_doc = {r.doc_id: r for r in plan if r.doc_id}
    mixed = Counter(r.doc_id for r in mixing.mix(documents(spark, rows)).select("doc_id").collect())
    for d, r in by_doc.items():
        # an empty document at a position within the budget is repeated like its neighbours
        low, high = (r.whole + (r.extra == r.size and r.size > 0), r.whole + (r.extra > 0 or r.size == 0))
        assert low <= mixed[d] <= high
    assert mixing.plan_mix(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0


def test_interleaved_shards(spark):
    rows = [(d, str(d), "big" if d % 3 else "small" if d % 2 else None) for d in range(1000)] + [(5, "5", "big"), (None, "x", None)]
    out = sharding.interleave(documents(spark, rows, "shard slot"), 16, keep=["text"]).collect()
    assert len(out) == len(rows) and Counter(r.text for r in out) == Counter(r[1] for r in rows)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for k in range(16):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(counts[k]))
    for s in ("big", "small", None):
        per = Counter(r.shard for r in out if r.source == s)
        assert max(per.values()) - min(per.get(k, 0) for k in range(16)) <= 2
    # the order is the one of fractional ranks over a seeded order of each source
    key = lambda r: (hashlib.md5(f"{r[0]}:29".encode()).hexdigest() if r[0] is not None else hashlib.md5(b"29").hexdigest(), r[0] is not None, r[0] or 0)
    order = []
    for s in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == s), key=key)
        order += [((2 * i + 1) / (2 * len(own)), s is None, s or "", r[0] is not None, r[0] or 0, r[1]) for i, r in enumerate(own)]
    want = [o[-1] for o in sorted(order)]
    assert [r.text for r in sorted(out, key=lambda r: (r.shard, r.slot))] == want
    assert [r.shard for r in sorted(out, key=lambda r: (r.shard, r.slot))] == [g * 16 // len(want) for g in range(len(want))]
    assert sharding.interleave(documents(spark, []), 16).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(260, 12))
    for i in range(60, 200):  # chains and clouds around the first ones
        x[i] = x[rng.integers(0, i if i % 2 else 5)] + rng.normal(size=12) * rng.choice([0.02, 0.2, 0.3])
    x[200:210] = x[3]
    x[210:215] = x[3] * 1e-3
    label = [int(v) for v in rng.choice([0, 1], len(x), p=[0.8, 0.2])]
    rows = [(i, [float(np.float32(v)) for v in x[i]], label[i]) for i in range(len(x))]
    odd = [(900, None, 0), (901, [0.0] * 12, 0), (902, [float("nan")] + [1.0] * 11, 0), (903, [float("inf")] * 12, 0), (904, [None] + [1.0] * 11, 0),
           (905, [], 0), (906, rows[3][1], None), (907, [1.0, 0.0], 0), (908, [1.0, 0.01], 0), (None, rows[3][1], 0)]
    return rows, odd


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    rows, odd = vectors()
    df = spark.createDataFrame(rows + odd + [rows[7]], VECTORS).withColumn("block", F.lit("clash")).withColumn("dim", F.lit(1))
    good = rows + odd[7:9]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in good}
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] >= 0.93]
    from tests.llm.helpers import roots

    want, count = roots([i for i, _, _ in rows + odd if i is not None], links), Counter(x for p in links for x in p)
    out = covertree.near_vectors(df).collect()
    assert len(out) == len(rows) + len(odd) + 1
    for r in out:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id is None
    assert covertree.near_vectors(df.limit(0)).count() == 0


def test_a_block_is_sent_once_to_a_tile_however_many_blocks_it_meets(spark, monkeypatch):
    # 4 components a vector: balls of random blocks all meet, one label of 30 blocks or more has 435 pairs of them
    monkeypatch.setattr(covertree, "BLOCK", 12)
    monkeypatch.setattr(covertree, "TILE", 12 * 4 * 4 * 8)
    x = np.random.default_rng(9).normal(size=(400, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], VECTORS)
    u = covertree.unit(x)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    written = []
    monkeypatch.setattr(covertree, "materialize", lambda d, name: written.append((name, out := materialize(d, name))) or out)
    assert [r.n_links for r in covertree.near_vectors(df).orderBy("vec_id").collect()] == near.sum(axis=1).tolist()
    tables = dict(written)
    blocks, sent = tables["cover-blocks"].count(), [r["count"] for r in tables["cover-meetings"].groupBy("block").count().collect()]
    tiles = tables["cover-meetings"].select("tile").distinct().count()
    assert blocks > 30 and len(sent) == blocks and max(sent) <= tiles < blocks / 3


def test_dual_traversal_is_exact():
    rng = np.random.default_rng(8)
    for spread in (0.01, 0.1, 0.4, 1.0):
        a, b = (covertree.unit(rng.normal(size=4) + spread * rng.normal(size=(n, 4))) for n in (70, 90))
        got = covertree.linked((a, *covertree.build(a)), (b, *covertree.build(b)), 0.93)
        assert (got == (a @ b.T >= 0.93)).all()


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(mih, "BLOCK", 64)
    rows, odd = vectors(4)
    df = spark.createDataFrame(rows + odd + [rows[7]], VECTORS).withColumn("rank", F.lit("clash"))
    queries = df.where("vec_id % 10 = 0")
    got = {}
    for r in mih.nearest(df, queries).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows + odd[6:7]}
    hit = total = 0
    for q in range(0, 260, 10):
        exact = sorted((-float(unit[q] @ unit[i]), i) for i in unit if i != q)[:5]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        assert all(s == pytest.approx(float(unit[q] @ unit[v]), abs=1e-12) for _, v, s in own)
        hit, total = hit + len({v for _, v, _ in own} & {v for _, v in exact}), total + 5
    assert hit / total >= 0.9
    few = mih.nearest(df.where("vec_id < 4"), df.where("vec_id in (0, 900, 901)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2), (0, 3)]
    assert mih.nearest(df.limit(0), df.limit(0)).count() == 0 and mih.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_probing_retrieves_the_whole_ball():
    rng = np.random.default_rng(0)
    codes, queries = (rng.integers(0, 256, (n, 16), dtype=np.uint8) for n in (300, 20))
    codes[:50] = queries[0] ^ rng.choice(np.array([0, 1, 2, 4], np.uint8), (50, 16))
    gap = np.bitwise_count(queries[:, None] ^ codes[None]).sum(axis=2)
    for radius in (0, 8, 20, 55):
        assert (mih.probe(mih.tables(codes), codes, queries, radius) == (gap <= radius)).all()


def test_gumbel_noise_is_uniform_in_rank(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "0D AS by_bytes", "0D AS by_shapes")
    draws = [r.draw for r in quality._weighted(rows, quality.Model(np.zeros(1), (0.0, 1.0, 1.0)), 7).collect()]
    assert np.mean(draws) == pytest.approx(0.5772, abs=0.1) and np.var(draws) == pytest.approx(math.pi**2 / 6, abs=0.2)
