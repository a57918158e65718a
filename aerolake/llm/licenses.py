"""Licence scan in DataFrame operations: sparse TF-IDF cosine against templates, then inheritance from ancestor folders.

Texts are cut into sentences, with the wrapped lines of a paragraph joined, and these into lines. Segments and templates become sparse TF-IDF vectors; document frequencies of all
words are counted over all files, with the templates as one file more. Words in less than one of ``RARE`` files weigh the
same, so weights follow the shares of files and not their number. A segment matches a template from cosine ``least`` on if
they share two words, if it holds the name, version and kind that the template states (``TELLS``), and if it states no other
kind of the same family (lesser, non-commercial, ...). A file's own licence is that of its best segment (ties: smaller id).
Sentences that several licences have (``SHARED``) are licence text but name none, and BSD-3-Clause goes before BSD-2-Clause,
whose sentences it holds.

A whole file with a cosine of ``WHOLE`` to the full text of a licence (``licence_texts``) has that licence, before its
segments. Only texts whose words in the file hold ``WHOLE`` squared of the text's squared norm can come to that.

A file is a licence file of its folder if it is such a text, if its base name says so, or if segments that match make up at
least ``share`` of its words. A file without a licence of its own takes that of the nearest ancestor folder with a licence file (of several
in one folder the best match, then the smallest path). Folders are resolved once each and joined to the files.

Whole texts are scanned. Only files that hold two words of the template vocabulary are cut into segments, as a match
needs two shared words in one segment. Templates and their vocabulary are fixed tables, so their joins are broadcast.

Defined results: NULL and empty texts have no licence of their own and may inherit one; a NULL path has no folder;
repeated rows are resolved alike; a
NULL id is an id like others, and rows of one id with different texts are different files; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.session import materialize

# The wording of public licence notices and headers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which "
     "accompanies this distribution."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
     "Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
     "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
     "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");"),
)
SHARED = ("You may not use this file except in compliance with the License.",)
#: Words that tell licences apart, in their spellings.
TELLS = (
    ("apache",), ("mozilla", "mpl"), ("eclipse", "epl"), ("mit",), ("bsd",), ("gnu", "gpl", "lgpl", "agpl"), ("cc", "creative"),
    ("lesser", "lgpl"), ("affero", "agpl"), ("library",), ("nc", "noncommercial", "commercial"), ("sa", "sharealike", "alike"),
    ("nd", "noderivatives", "noderivs", "derivatives"), ("1", "1.0", "v1", "v1.0"), ("1.1", "v1.1"), ("2", "2.0", "v2", "v2.0"),
    ("2.1", "v2.1"), ("3", "3.0", "v3", "v3.0"), ("4", "4.0", "v4", "v4.0"))
#: A name and the kinds of its family.
KINDS = {"gnu": ("lesser", "affero", "library"), "cc": ("nc", "sa", "nd")}
_HEAD = 40
# Words too frequent to tell licences apart.
STOP_WORDS = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "its", "of", "on", "or", "that",
              "the", "this", "to", "with", "you")
FILE_NAMES = r"(?i)^(licen[cs]es?|copying|copyright|unlicense)([._-].*)?$"
LEAST, WHOLE, SHARE, RARE = 0.6, 0.9, 0.5, 1000.0
TEXTS = Path(__file__).with_name("licence_texts")
_CUT = r"\n|(?<=[.;:!?])(?<!\bv\.)\s+(?![\s#*/]*either\s+version)"
#: Sentences with their wrapped lines: a line without letters and digits ends a paragraph.
_PART = r"\n[^a-zA-Z0-9\n]*\n|(?<=[.;:!?])(?<!\bv\.)\s+(?![\s#*/]*either\s+version)"
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"


def _tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 0), lambda w: ~w.isin(*STOP_WORDS))


def _bit(word: str) -> int:
    return 1 << next(i for i, spellings in enumerate(TELLS) if spellings[0] == word)


def _tells(tokens: Column) -> Column:
    """Bits of TELLS in a token array."""
    return sum((F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), 1 << i).otherwise(0) for i, words in enumerate(TELLS)), F.lit(0))


def _vectors(rows: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """(*keys, word, w): TF-IDF vectors of the token arrays ``tokens``."""
    tf = rows.select(*keys, F.explode("tokens").alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(weights, "word").select(*keys, "word", (F.col("tf") * F.col("idf")).alias("w"))


def _unit(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, word, tw): the vectors at length one; rows of templates."""
    norms = vectors.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return vectors.join(norms, keys).select(*keys, "word", (F.col("w") / F.col("norm")).alias("tw"))


def _weights(files: DataFrame, vocabulary: list[str], others: DataFrame) -> DataFrame:
    """(word, idf) of every word of the files, the templates and the ``tokens`` of others, which do not count as files."""
    held = F.array_distinct(_tokens(F.col("text")))
    words = files.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ours = files.sparkSession.createDataFrame([(w, 1) for w in vocabulary], "word string, df long")  # of the fixed templates
    ours = ours.unionByName(others.select(F.explode("tokens").alias("word"), F.lit(0).cast("long").alias("df")))
    df = words.unionByName(ours).groupBy("word").agg(F.sum("df").alias("df"))
    share = F.least((F.lit(files.count()) + 1.0) / F.greatest("df", F.lit(1)), F.lit(RARE))
    return materialize(df.select("word", (F.log(share) + 1.0).alias("idf")), "license-weights")


def _whole(files: DataFrame, full: DataFrame, weights: DataFrame) -> DataFrame:
    """(file, whole_id, whole_score): files that are the full text of a licence; titles must agree on lesser and affero."""
    unit = materialize(_unit(_vectors(full, ["license_id"], weights), ["license_id"]), "license-texts")
    kinds = lambda tokens: _tells(F.slice(tokens, 1, _HEAD)).bitwiseAND(F.lit(_bit("lesser") | _bit("affero")))
    unit = unit.join(full.select("license_id", kinds(F.col("tokens")).alias("kind")), "license_id")
    rows = files.select("file", _tokens(F.col("text")).alias("tokens"))
    held = rows.select("file", F.explode(F.array_distinct("tokens")).alias("word")).join(F.broadcast(unit), "word")  # fixed texts
    near = held.groupBy("file", "license_id").agg(F.sum(F.col("tw") * F.col("tw")).alias("held")).where(F.col("held") >= WHOLE * WHOLE - 1e-9)
    near = materialize(near.select("file").distinct(), "license-near")
    rows = rows.join(near, "file").withColumn("head", kinds(F.col("tokens")))
    vec = materialize(_vectors(rows, ["file", "head"], weights), "license-whole")
    size = vec.groupBy("file").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vec.join(F.broadcast(unit), "word").where("head = kind").groupBy("file", "license_id").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scores = dots.join(size, "file").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= WHOLE)
    best = scores.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "license_id")).alias("b"))
    return best.select("file", F.col("b.license_id").alias("whole_id"), (-F.col("b.s")).alias("whole_score"))


def match(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(file, license_id, score, matched, whole): files, by an id column ``file`` and ``text``, with a licence of their own.

    matched: words in matching segments; whole: the file is the full text of the licence.
    """
    spark = files.sparkSession
    given = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEMPLATES)], "template int, license_id string, text string")
    given = given.select("template", "license_id", _tokens(F.col("text")).alias("tokens"))
    full = spark.createDataFrame([(p.stem, p.read_text()) for p in sorted(TEXTS.glob("*.txt"))], "license_id string, text string")
    full = full.select("license_id", _tokens(F.col("text")).alias("tokens"))
    vocabulary = sorted({w for r in given.select("tokens").collect() for w in r[0]})  # of the fixed templates
    hits = files.where(F.col("text").isNotNull()).select(
        "file", F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), 0), F.array(*map(F.lit, vocabulary))).alias("hits"), "text")
    weights = _weights(files, vocabulary, full)
    need = _tells(F.col("tokens"))
    bars = sum((F.when(need.bitwiseAND(F.lit(_bit(name))) != 0, sum(map(_bit, kinds))).otherwise(0) for name, kinds in KINDS.items()), F.lit(0))
    rules = given.select("template", need.alias("need"), bars.bitwiseAND(F.bitwise_not(need)).alias("bars"), F.col("template").isin(
        *[i for i, (_, text) in enumerate(TEMPLATES) if text in SHARED]).alias("shared"))
    unit = _unit(_vectors(given, ["template", "license_id"], weights), ["template", "license_id"]).join(rules, "template")
    unit = unit.withColumn("license_id", F.when(~F.col("shared"), F.col("license_id")))
    parts = hits.where(F.size("hits") >= 2).select("file", F.posexplode(F.split("text", _PART)).alias("no", "part"))
    in_lines = F.split("part", "\n")
    # sub 0 is the sentence, the others are its lines
    segments = parts.select("file", "no", F.posexplode(F.when(F.size(in_lines) > 1, F.concat(F.array("part"), in_lines)).otherwise(
        F.array("part"))).alias("sub", "segment"))
    segments = segments.select("file", "no", "sub", _tokens(F.col("segment")).alias("tokens"),
                               F.regexp_count("segment", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    segments = segments.where(F.arrays_overlap("tokens", F.array(*map(F.lit, vocabulary))))
    vec = _vectors(segments, ["file", "no", "sub", "words"], weights)
    told = sum((F.when(F.col("word").isin(*words), 1 << i).otherwise(0) for i, words in enumerate(TELLS)), F.lit(0))
    size = vec.groupBy("file", "no", "sub").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.bit_or(told).alias("tells"))
    dots = vec.join(F.broadcast(unit), "word").groupBy("file", "no", "sub", "words", "template", "license_id", "need", "bars").agg(
        F.sum(F.col("w") * F.col("tw")).alias("dot"), F.count(F.lit(1)).alias("common")).where("common >= 2")
    scores = dots.join(size, ["file", "no", "sub"]).where("(tells & need) = need AND (tells & bars) = 0").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    named = F.struct((-F.col("score")).alias("s"), "license_id")
    bests = lambda: [F.min(F.when(F.col("license_id") != "BSD-2-Clause", named)).alias("b"),
                     F.min(F.when(F.col("license_id") == "BSD-2-Clause", named)).alias("b2"), F.bool_or(F.col("license_id") == "BSD-3-Clause").alias("b3")]
    again = lambda: [F.min("b").alias("b"), F.min("b2").alias("b2"), F.bool_or("b3").alias("b3")]
    best = scores.groupBy("file", "no", "sub", "words").agg(*bests())
    in_part = F.greatest(F.max(F.when(F.col("sub") == 0, F.col("words"))), F.sum(F.when(F.col("sub") > 0, F.col("words"))))
    best = best.groupBy("file", "no").agg(*again(), in_part.alias("words"))
    best = best.groupBy("file").agg(*again(), F.sum("words").alias("matched"))
    two = F.when(~F.coalesce("b3", F.lit(False)), F.col("b2"))
    best = best.select("file", F.least("b", two).alias("b"), "matched")
    best = best.join(_whole(files, full, weights), "file", "full")
    return best.select("file", F.coalesce("whole_id", "b.license_id").alias("license_id"), F.coalesce("whole_score", -F.col("b.s")).alias("score"),
                       "matched", F.col("whole_id").isNotNull().alias("whole"))


def scan(files: DataFrame, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """Per row of ``files`` (file, path, text): file, path, license_id, score, how (header, file, inherited) and from_path."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    key = F.struct("file", F.xxhash64("text").alias("text")).alias("key")
    found = match(files.select(key.alias("file"), "text"), least).withColumnRenamed("file", "key")
    base = materialize(files.select(key, "file", "path", folder.alias("folder"), words.alias("words")), "license-files")
    own = base.join(found, "key", "left")
    named = F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE_NAMES)
    is_file = F.col("license_id").isNotNull() & (F.col("whole") | named | (F.col("matched") >= F.lit(share) * F.col("words")))
    own = materialize(own.withColumn("is_file", F.coalesce(is_file, F.lit(False))), "license-own")
    holders = own.where("is_file AND folder IS NOT NULL").groupBy(F.col("folder").alias("at")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "path", "license_id")).alias("b"))
    parts = F.split("folder", "/")
    ancestors = own.where(F.col("folder").isNotNull()).select("folder").distinct().withColumn(
        "depth", F.explode(F.sequence(F.lit(0), F.size(parts))))
    # depth 0 is the root, depth k the first k parts of the folder
    ancestors = ancestors.withColumn("at", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).where("folder <> '' OR depth = 0")
    near = ancestors.join(holders, "at").groupBy("folder").agg(F.max_by("b", "depth").alias("b"))
    near = near.select("folder", F.col("b.license_id").alias("up"), F.col("b.s").alias("up_s"), F.col("b.path").alias("up_path"))
    rows = own.join(near, "folder", "left")
    mine = F.col("license_id").isNotNull()
    how = F.when(mine, F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("up").isNotNull(), "inherited")
    return rows.select(
        "file", "path", F.coalesce("license_id", "up").alias("license_id"), F.coalesce("score", -F.col("up_s")).alias("score"),
        how.alias("how"), F.when(mine, F.col("path")).otherwise(F.col("up_path")).alias("from_path"))
