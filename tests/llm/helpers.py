"""Small tables and plain-Python versions of the operators."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows, extra=""):
    """``rows``: (doc_id, text) or (doc_id, text, source); ``extra`` names a further column of a clashing name."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra.split():
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def roots(ids, links):
    """Smallest id reachable."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_components(docs, percent=75):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    close = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    return roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if close(sets[a], sets[b])])


def word_distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def line_keepers(docs, min_words=8):
    """{(doc_id, line_no): (kept, keeper)} of all lines with a word."""
    rows = [((d, n), tuple(words(line))) for d, t in docs if d is not None for n, line in enumerate((t or "").split("\n"))]
    rows = [(at, w) for at, w in rows if w]
    first = {}
    for at, w in sorted(rows):
        first.setdefault(w, at)
    keep = {}
    for w, at in first.items():
        near = [o for v, o in first.items() if o < at and len(w) >= min_words and len(v) >= min_words and word_distance_at_most_one(w, v)]
        keep[w] = min(near, default=at)
    return {at: (keep[w] == at, keep[w]) for at, w in rows}
