"""Chat formatting, line dedup, BPE, licence scan."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aerolake.llm import bpe, chat, licenses, linededup
from aerolake.llm.queries import vocabulary
from tests.llm.helpers import documents, line_keepers, words

LOG = "conv_id long, message long, seq int, kind string, role string, text string"


def test_log_is_folded(spark):
    log = [
        (1, 0, 0, "start", "user", None), (1, 0, 1, "delta", None, "he"), (1, 0, 2, "delta", None, "llo"),
        (1, 1, 0, "start", "assistant", None), (1, 1, 1, "delta", None, "bad"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "go"),
        (1, 1, 4, "delta", None, "od"), (1, 1, 4, "delta", None, "od"),
        (1, 2, 0, "start", "user", None), (1, 2, 1, "delta", None, "typo"), (1, 2, 2, "edit", None, "fixed"), (1, 2, 3, "delta", None, "!"),
        (1, 3, 0, "start", "user", None), (1, 3, 1, "delta", None, "gone"), (1, 3, 2, "delete", None, None),
        (None, 5, 1, "delta", None, None), (2, 7, 0, "start", None, None)]
    rows = chat.fold(spark.createDataFrame(log, LOG).withColumn("piece", F.lit(1)).orderBy(F.rand(1))).collect()
    assert {(r.conv_id, r.message): (r.role, r.text) for r in rows} == {
        (1, 0): ("user", "hello"), (1, 1): ("assistant", "good"), (1, 2): ("user", "fixed!"), (None, 5): ("", ""), (2, 7): ("", "")}


def test_chat_round_trip(spark):
    rnd = random.Random(4)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<role>", "</turn>", "\\", " ", "[", "<", "/", "é😀", "\n", "a"]
    rows = []
    for conv in [None, *range(30)]:
        for turn in range(rnd.randint(1, 6)):
            text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "tool</role>", "", None]), rnd.choice([text, text, None])))
    rows += [(3, 0, "user", "x" * 5000), rows[0]]  # a long text, a tie and a repeated row
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    pieces = chat.format_log(chat.events_of_turns(turns, 7))
    want = {}
    key = lambda r: (r[1], r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    for conv in {r[0] for r in rows}:
        want[conv] = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: tuple(r.message)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.piece
    assert {c: list(chat.parse(t)) for c, t in whole.items()} == want
    for r in chat.digests(pieces).collect():
        said = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.n_turns == len(want[r.conv_id]) and r.formatted_chars == len(whole[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in want[r.conv_id]).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(chat.format_log(chat.events_of_turns(turns.limit(0)))).count() == 0


def line_docs():
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 14))] for _ in range(12)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                i, kind = rnd.randrange(len(w)), rnd.randrange(3)
                w[i : i + 1] = [[], [rnd.choice(vocab)], [w[i], rnd.choice(vocab)]][kind]
            lines.append(rnd.choice([" ", "  ", "\t"]).join(w))
        docs.append((d, "\n".join(lines)))
    long = " ".join(rnd.choice(vocab) for _ in range(3000))
    return docs + [(100, None), (101, ""), (102, " \n\n"), (103, long), (104, long + " end"), (105, "one two"), (106, "one  two\n")]


def test_lines_against_all_pairs(spark):
    docs = line_docs()
    got = linededup.dedup_lines(documents(spark, docs + [docs[0], (None, docs[1][1])], "line_no id first"))
    got = {((r.doc_id, r.line_no)): (r.kept, (r.keep_doc_id, r.keep_line_no)) for r in got.collect()}
    assert got == line_keepers(docs)
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_lines_are_dropped(spark):
    docs = line_docs()
    keep = line_keepers(docs)
    want = {}
    for d, t in docs:
        left = [x for n, x in enumerate((t or "").split("\n")) if keep.get((d, n), (True,))[0]]
        cut = any(not keep.get((d, n), (True,))[0] for n in range(len((t or "").split("\n"))))
        if not cut or words("\n".join(left)):
            want[d] = "\n".join(left) if cut else t
    out = linededup.drop_lines(documents(spark, docs, "line_no"))
    assert out.columns[-1] == "line_no"
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    rnd = random.Random(1)
    bits = ["a", "the", "'s", "'re", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "é", "Ω", "漢", "1", "²", "𝒜", "😀", "‍",
            "_", "...", "<|endoftext|>", "<|endof", "zzzz", "́", "\x00", "\r\n"]
    texts = [None, "", "a" * 20000, "ab" * 5000 + " x", *["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(600)]]
    docs = documents(spark, list(enumerate(texts)), "ids decoded")
    rows = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == lib.decode(want, skip_special_tokens=False)
    for r in bpe.digests(docs, vocabulary()).collect():
        ids = b"".join(i.to_bytes(4, "little") for i in lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode(documents(spark, []), vocabulary()).count() == 0


def tokens(text):
    return [w for w in re.findall(licenses._TOKEN, text.lower()) if w not in licenses.STOP_WORDS]


def own_licence(texts):
    """{file: (license_id, score)} by plain cosines over all segments and templates."""
    vocab = {w for _, t in licenses.TEMPLATES for w in tokens(t)}
    df = Counter(w for t in texts.values() for w in vocab & set(re.findall(licenses._TOKEN, (t or "").lower())))
    idf = lambda w: math.log((len(texts) + 1) / ((df[w] if w in vocab else 0) + 1)) + 1
    vec = lambda t: {w: n * idf(w) for w, n in Counter(tokens(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for f, text in texts.items():
        for segment in re.split(licenses._CUT, text or ""):
            v = vec(segment)
            for name, template in licenses.TEMPLATES:
                t = vec(template)
                if not v:
                    continue
                score = round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 6)
                if score >= licenses.LEAST and len(set(re.findall(licenses._TOKEN, (text or "").lower())) & vocab) >= 2:
                    out[f] = min(out.get(f, (9, "")), (-score, name))
    return {f: (n, -s) for f, (s, n) in out.items()}


def test_licence_scan(spark):
    files = [
        (1, "a/LICENSE", "MIT License\n\n" + licenses.TEMPLATES[15][1] + "\nmore words here"), (2, "a/b/c/x.py", "no notice"), (3, "a/b/COPYING", licenses.TEMPLATES[11][1]),
        (4, "a/b/c/y.py", "Some code. Licensed under the Apache License, Version 2.0. And more code follows in this line."), (5, "z/q.txt", "public software"),
        (6, "top.txt", None), (7, None, "Released under the MIT License."), (8, "a/d/e.txt", ""), (9, "k/only.txt", "released under the MIT license."), (10, "k/v/w.txt", "x " * 5000),
        (11, "n/near.py", "This file is licensed under the Apache License, Version 2.0, see below."), (4, "a/b/c/y.py", "Some code. Licensed under the Apache License, Version 2.0. And more code follows in this line.")]
    df = spark.createDataFrame(files, "file long, path string, text string").withColumn("score", F.lit("clash"))
    rows = licenses.scan(df).collect()
    assert len(rows) == len(files)
    got = {r.file: (r.license_id, r.how, r.from_path) for r in rows}
    own = own_licence({(f, k): t for k, (f, _, t) in enumerate(files)})
    own = {f: v for (f, _), v in own.items()}
    for r in rows:
        assert (r.file in own) == (r.how in ("file", "header"))
        if r.file in own:
            assert r.license_id == own[r.file][0] and r.score == pytest.approx(own[r.file][1], abs=2e-6)
    assert got[1] == ("MIT", "file", "a/LICENSE") and got[2] == ("GPL-3.0", "inherited", "a/b/COPYING")
    assert got[4][:2] == ("Apache-2.0", "header") and got[5] == (None, None, None) and got[6] == (None, None, None)
    assert got[8] == ("MIT", "inherited", "a/LICENSE") and got[10] == ("MIT", "inherited", "k/only.txt") and got[7][0] == "MIT"
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_verdict_does_not_follow_corpus_size(spark):
    """A notice with one more common word, at equal shares of files."""
    notice = "This project is licensed under the MIT License."
    bits = [(2, "project"), (4, "license"), (5, "licensed"), (5, "under"), (10, "mit")]
    found = []
    for n in (40, 40_000):
        words = F.concat_ws(" ", *[F.when(F.col("id") % k == 0, F.lit(w)) for k, w in bits])
        files = spark.range(n).select(F.col("id").alias("file"), words.alias("text"))
        files = files.unionByName(spark.createDataFrame([(-1, notice)], "file long, text string"))
        found.append({r.file: (r.license_id, r.score) for r in licenses.match(files).collect()}[-1])
    assert found[0][0] == found[1][0] == "MIT" and found[0][1] == pytest.approx(found[1][1], abs=0.05)


@pytest.mark.parametrize("wrapped", [True, False])
def test_full_licence_texts_and_wrapped_notices(spark, wrapped):
    lay = lambda t: t if wrapped else re.sub(r"\s+", " ", t)
    texts = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    holder = "Copyright (c) 2021 Jane Doe and contributors\n\n"
    files = [(i, f"{name}/d1.txt", lay(holder + text)) for i, (name, text) in enumerate(texts.items())]
    files += [(100 + i, f"{name}/sub/x.py", "no notice") for i, name in enumerate(texts)]
    notice = "# Licensed under the Apache License,\n# Version 2.0.\n#\nx = 1\n" + "y = x\n" * 50
    files += [(200, "code/a.py", lay(notice) if wrapped else notice)]
    got = {r.path: (r.license_id, r.how) for r in licenses.scan(spark.createDataFrame(files, "file long, path string, text string")).collect()}
    for name in texts:
        assert got[f"{name}/d1.txt"] == (name, "file") and got[f"{name}/sub/x.py"] == (name, "inherited")
    assert got["code/a.py"] == ("Apache-2.0", "header")


def test_licences_are_not_taken_for_one_another(spark):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as\n" \
          "published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    bsd = licenses.TEMPLATES[3][1]
    cases = [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 1.", None),
        (gnu.format("", ";", "2"), "GPL-2.0"), (gnu.format("", ",", "3"), "GPL-3.0"), (gnu.format("Lesser ", ";", "2.1"), "LGPL-2.1"),
        (gnu.format("Affero ", ",", "3"), "AGPL-3.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY 3.0.", None),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except '
         "in compliance with the License.", "MPL-1.1"),
        (bsd, "BSD-2-Clause"), (bsd + "\n" + licenses.TEMPLATES[4][1], "BSD-3-Clause"), ("Released under the BSD License.", None), ("SOFTWARE.", None)]
    files = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "file long, text string")
    full = (licenses.TEXTS / "GPL-3.0.txt").read_text()
    affero = full.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
    files = files.unionByName(spark.createDataFrame([(100, full), (101, affero)], files.schema))
    got = {r.file: r for r in licenses.match(files).collect()}
    assert [got[i].license_id if i in got else None for i in range(len(cases))] == [name for _, name in cases]
    assert got[100].whole and (101 not in got or not got[101].whole)


def test_licence_of_files_without_id_and_of_one_word(spark):
    full = (licenses.TEXTS / "MIT.txt").read_text()
    files = [(None, "a/x.txt", "Released under the MIT License."), (None, "b/y.txt", "nothing here"), (None, "c/z.txt", full),
             (1, "d/x.txt", "SOFTWARE.\nfoo"), (2, "e/x.txt", "SOFTWARE.\nlicense")]
    rows = licenses.scan(spark.createDataFrame(files, "file long, path string, text string")).collect()
    assert {r.path: (r.license_id, r.how) for r in rows} == {
        "a/x.txt": ("MIT", "file"), "b/y.txt": (None, None), "c/z.txt": ("MIT", "file"), "d/x.txt": (None, None), "e/x.txt": (None, None)}


def test_memo_tables_are_bounded():
    """Both generations of both tables of a worker, as they really are, with far more pieces than they hold."""
    import sys

    from aerolake.llm.pieces import Memo

    held = 0
    for width in (12, 20):
        m = Memo(lambda t: t.encode()[:8])
        for i in range(400_000):
            m[f"{i:0{width}d}"]
        held += sum(sys.getsizeof(k) + sys.getsizeof(v) for g in (m, m.old) for k, v in g.items()) + sys.getsizeof(m) + sys.getsizeof(m.old)
    assert held < 36 << 20


def test_memo_limits_are_kept_apart():
    """The limit is the caller's, and what a smaller one forgets is made again with the same result."""
    from aerolake.llm.pieces import MEMO_BYTES, Memo, Splitter

    made = []
    small, large = (Memo(lambda t: made.append(t) or t.encode()[::-1], n) for n in (2_000, 20_000))
    for m, again in ((small, True), (large, False)):
        made.clear()
        for _ in range(2):
            assert all(m[f"w{i}"] == f"w{i}".encode()[::-1] for i in range(60))
        assert (len(made) > 60) is again
    s = Splitter(None, 5_000)
    assert (s.pieces.limit, s.runs.limit, Splitter().runs.limit) == (5_000, 5_000, MEMO_BYTES)
