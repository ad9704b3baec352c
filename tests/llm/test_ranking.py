"""Ranked search against brute force over one and many shards."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from asset_atlas.llm import ranking, rows

from .small import EDGES, SF, edge_docs, lowered, no_docs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, items, k=10):
    terms = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, length = len(terms), sum(c.total() for _, c in terms)
    df, by_term = Counter(), defaultdict(list)
    for i, c in terms:
        df.update(c.keys())
        m = 25 + (75 * c.total() * n) // length
        for t, tf in c.items():
            by_term[t].append((i, (1_000_000_000 * tf) // (1000 * tf + 8 * m)))
    out = set()
    for item, text in items:
        score = Counter()
        for t, times in Counter(TERM.findall(lowered(text))).items():
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
            for i, impact in by_term[t]:
                score[i] += times * w * impact
        best = sorted((-s, i) for i, s in score.items() if s > 0)[:k]
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def found(index, items, **more):
    return {tuple(r) for r in ranking.search(index, items, **more).select("item_id", "rank", "doc_id", "score").collect()}


@pytest.fixture(scope="module")
def tables(spark):
    docs = rows.documents(spark, SF).select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    return docs, items, brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


@pytest.mark.parametrize("shard_bytes,item_block", [(1 << 14, 3), (ranking.SHARD_BYTES, ranking.ITEM_BLOCK)])
def test_documents_and_items(spark, tables, shard_bytes, item_block):
    docs, items, want = tables
    index = ranking.build_index(docs, shard_bytes=shard_bytes)
    assert found(index, items, item_block=item_block) == want


def test_blocks_and_shared_coordinates(spark, monkeypatch):
    monkeypatch.setattr(ranking, "OWN", 8)
    monkeypatch.setattr(ranking, "SHARED", 4)
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 5)
    rng = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    common = [f"c{i}" for i in range(12)]

    def text(size):
        topic = rng.choice(topics)
        return " ".join(rng.choice(topic if rng.random() < 0.6 else common) for _ in range(size))

    docs = [(i, text(rng.choice([3, 20, 90]))) for i in range(700)] + [(1000 + i, "t0w1 t0w2 c1") for i in range(60)]
    items = [(i, text(12)) for i in range(25)] + [(99, "nowhere"), (98, None)]
    sizes, term, tf, ids = [], [], [], []
    for i, t in docs:
        c = Counter(TERM.findall(t))
        ids.append(i)
        sizes.append(len(c))
        term += [hash(x) & (2**64 - 1) for x in sorted(c)]
        tf += [c[x] for x in sorted(c)]
    got = ranking.shard_arrays(np.array(sizes), np.array(term, dtype=np.uint64), np.array(tf), len(docs), sum(tf))
    shard = ranking.Shard({n: rows.pack(got[n].astype(t)) for n, t in ranking.FIELDS} | {"docs": ids})
    df = Counter(x for _, t in docs for x in set(TERM.findall(t)))
    out = set()
    for item, t in items:
        c = {x: k for x, k in Counter(TERM.findall(t or "")).items() if x in df}
        if c:
            w = [k * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[x] + 1))) for x, k in c.items()]
            at = shard.find(np.array([hash(x) & (2**64 - 1) for x in c], dtype=np.uint64))
            place, score = shard.best(at, np.array(w), 10)
            best = sorted((-int(s), ids[p]) for p, s in zip(place, score, strict=True))
            out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert out == brute(docs, items)
    assert shard.skipped > 0 and shard.scored < 25 * len(docs)


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 7, "alpha beta") for i in range(30)] + [(50, "gamma"), (None, "alpha beta")], "doc_id bigint, text string")
    items = spark.createDataFrame([("x", "Alpha!"), ("x", "Alpha!"), (None, "gamma gamma"), ("z", "")], "item_id string, text string")
    got = [tuple(r) for r in ranking.search(ranking.build_index(docs.repartition(3)), items).select("item_id", "rank", "doc_id").collect()]
    x = sorted(r for r in got if r[0] == "x")
    assert [r[1] for r in x] == sorted([*range(1, 11)] * 2)
    assert [d for _, _, d in x[::2]] == [None, 0, 0, 0, 0, 0, 1, 1, 1, 1]
    assert [r for r in got if r[0] is None] == [(None, 1, 50)]


def test_edges(spark):
    index = ranking.build_index(edge_docs(spark, clash=True))
    items = spark.createDataFrame([(1, "quick fox"), (2, None), (3, "")], "item_id bigint, text string")
    got = ranking.search(index, items).collect()
    assert {r["item_id"] for r in got} == {1} and len(got) == 4 <= len(EDGES)
    assert ranking.search(index, items.limit(0)).collect() == []
    assert ranking.search(ranking.build_index(no_docs(spark)), items).collect() == []
