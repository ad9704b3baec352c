"""Small document tables and brute-force versions of the corpus operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 4001}" for i in range(60_000))
SENTENCE = "the quick brown fox jumps over the lazy dog near the old river bank while rain falls on the quiet town"

#: nulls in every column, empty and blank texts, repeated rows, ties, one very long text
EDGES = [
    (1, SENTENCE, "en", "a", 103),
    (1, SENTENCE, "en", "a", 103),
    (2, SENTENCE.upper(), "en", None, None),
    (3, None, "en", "a", None),
    (4, "", None, "b", 0),
    (5, " \t\n\x0b\x0c\r ", "de", "b", 7),
    (None, SENTENCE + " again", "en", "b", 1),
    (None, None, None, None, None),
    (6, LONG, "en", "c", len(LONG)),
    (7, LONG + " tail", "en", "c", len(LONG) + 5),
    (8, "one\n\n\ntwo\n" * 3, "en", "c", 30),
    (9, "4111 1111 1111 1111 a@b.co 10.0.0.300 10.0.0.255 +1 (212) 555-0100 é", "fr", "c", 70),
    (10, "123 !!! 456", "es", "c", 11),
    (11, "x" * 5000, "en", "c", 5000),
]


def edge_docs(spark, clash: bool = False):
    df = spark.createDataFrame(EDGES, FIELDS)
    if clash:
        for name in ("_doc", "_sum", "_text", "_score", "n_words", "kept", "topic", "key", "place", "found", "class"):
            df = df.selectExpr("*", f"'{name}' as {name}")
    return df


def no_docs(spark):
    return spark.createDataFrame([], FIELDS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def shingle_set(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_classes(docs, least=0.8):
    """doc_id to the smallest id of its component under set Jaccard of five-word shingles."""
    sets = {i: shingle_set(t) for i, t in docs}
    inverted, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for g in s for j in inverted[g])
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= least:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            inverted[g].append(i)
    return {i: find(i) for i in sets}


def cut_repeats(docs, size=400):
    """doc_id to (bytes, removed, runs, kept bytes)."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(x[k : k + size] for _, x in raw for k in range(len(x) - size + 1))
    out = {}
    for i, x in raw:
        lost = bytearray(len(x))
        for k in range(len(x) - size + 1):
            if seen[x[k : k + size]] > 1:
                lost[k : k + size] = b"\1" * size
        kept = bytes(c for c, f in zip(x, lost, strict=True) if not f)
        runs = sum(1 for k in range(len(lost)) if lost[k] and (k == 0 or not lost[k - 1]))
        out[i] = (len(x), sum(lost), runs, kept)
    return out
