"""Registered queries against their SQL, and the pipeline stage by stage against plain Python."""

import hashlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from aerolake.llm import mixing, quality
from aerolake.llm.common import read
from aerolake.llm.queries import ORACLES, QUERIES, vocabulary
from tests.conftest import SF
from tests.llm.helpers import line_keepers, near_components, words
from tests.test_queries import rows


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = rows(QUERIES[name](spark, SF).toArrow())
    assert got == rows(con.execute(ORACLES[name]).to_arrow_table()) and got[1]


def test_pipeline_stage_by_stage(spark):
    from tokenizers import Tokenizer

    from aerolake.session import materialize

    docs = read(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), "stage")
        seen[name] = ([tuple(r) for r in before.select("doc_id", "text", "source").collect()], docs)
        if stage is not corpus_pipeline.tokenize:
            assert docs.schema.simpleString() == before.schema.simpleString()
    (given, out) = seen["quality classifier"]
    picked, _ = quality.select_top(read(spark, SF, "documents"), read(spark, SF, "labels"))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in picked.where("kept").collect()}
    (given, out) = seen["line dedup"]
    keep = line_keepers([(d, t) for d, t, _ in given])
    want = {}
    for d, t, _ in given:
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if keep.get((d, n), (True,))[0])
        if left == t or words(left):
            want[d] = left
    assert {r.doc_id: r.text for r in out.collect()} == want
    (given, out) = seen["MinHash near-dedup"]
    roots = near_components([(d, t) for d, t, _ in given])
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, c in roots.items() if d == c)
    (given, out) = seen["mixing sources to target weights"]
    copies = Counter(r.doc_id for r in out.collect())
    sizes = {d: len(words(t)) for d, t, _ in given}
    for r in mixing.plan_mix(seen["MinHash near-dedup"][1]).collect():
        assert abs(copies[r.doc_id] * r.size - r.taken) * 2 <= r.size or r.size == 0
    assert sum(copies[d] * n for d, n in sizes.items()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)
    (given, out) = seen["BPE encoding and decoding"]
    lib = Tokenizer.from_file(vocabulary())
    assert sorted((r.doc_id, tuple(r.ids)) for r in out.collect()) == sorted(
        (d, tuple(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in given)
    digest = lambda ids: hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert all(r.decoded_sha256 == digest(r.ids) for r in out.collect())
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "ids").collect()
    pairs = lambda t: sorted((r.doc_id, tuple(r.ids)) for r in t)
    assert pairs(whole) == pairs(out.collect())
