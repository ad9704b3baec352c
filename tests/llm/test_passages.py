"""Passages of over 50 words that stand twice, against brute force."""

from __future__ import annotations

import random
from collections import Counter

from asset_atlas.llm import queries, rows, substrings

from .small import EDGES, SF, edge_docs, no_docs, words


def brute(docs, size=51):
    texts = [(i, words(t)) for i, t in docs]
    seen = Counter(tuple(w[k : k + size]) for _, w in texts for k in range(len(w) - size + 1))
    out = {}
    for i, w in texts:
        hit = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                hit[k : k + size] = [True] * size
        out[i] = (sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit)), sum(hit))
    return out


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    planted = [[word() for _ in range(rng.randint(45, 80))] for _ in range(12)]
    docs = []
    for i in range(80):
        body = [word() for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(planted)
        docs.append((i, rng.choice([" ", "\n", "  "]).join(body)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: [tuple(p) for p in r["_passages"]] for r in substrings.repeated_passages(df).collect()}
    want = brute(docs)
    assert {i: (len(p), sum(b - a for a, b in p)) for i, p in got.items()} == want
    # of these passages most are shorter than the 400 bytes of the byte strings
    assert sum(n > 0 for n, _ in want.values()) > 30


def test_query_columns(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows.documents(spark, SF).select("doc_id", "text").collect()]
    got = queries.op10_substrings(spark, SF).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_passages"], r["n_passage_words"]) for r in got} == brute(docs)


def test_edges(spark):
    got = substrings.repeated_passages(edge_docs(spark, clash=True)).collect()
    assert len(got) == len(EDGES)
    assert all(r["_passages"] for r in got if r["doc_id"] in (6, 7))
    assert not any(r["_passages"] for r in got if r["doc_id"] in (1, 3, 4, 5, 8, 11))
    assert substrings.repeated_passages(no_docs(spark)).collect() == []
