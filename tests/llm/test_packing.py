"""Packing: ids against the plain tokenizer, gapless sequences, few of them."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from asset_atlas.llm import packing, queries, rows

from .small import EDGES, SF, edge_docs, no_docs

ODD = [
    "Erth.,!x a1.b É.e (a)b-c|:d <|ENDOFTEXT|> it's. don't", "a<|endoftext|>b x", "ΑΣ ΣΑΣ. 'll é ́x \x1cy\x85z",
    "x" * 5000, "", " \t", None, "A,B" * 3000,
]


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_str(packing.vocabulary())
    return lambda text: [*tok.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(placed, texts, plain, capacity=packing.CAPACITY):
    """Every document whole and in order, every sequence gapless and within the capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in placed:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["_sequence"]].append((r["_offset"], r["_length"]))
        assert len(r["_ids"]) == 4 * r["_length"]
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["_piece"])
        whole = np.frombuffer(b"".join(bytes(r["_ids"]) for r in parts), dtype="<u4").tolist()
        assert whole == plain(texts[i])
        assert [r["_start"] for r in parts] == list(range(0, len(whole), capacity))
        assert all(r["_length"] == capacity for r in parts[:-1])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_ids_and_places_of_odd_texts(spark, plain):
    texts = dict(enumerate(ODD))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check(packing.pack(df).collect(), texts, plain)


def test_documents_in_few_sequences(spark, plain):
    docs = rows.documents(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    placed = packing.pack(docs.repartition(5)).collect()
    used = check(placed, texts, plain)
    assert used <= -(-sum(r["_length"] for r in placed) // packing.CAPACITY) + 1


def test_query_digests(spark, plain):
    texts = {r["doc_id"]: r["text"] for r in rows.documents(spark, SF).select("doc_id", "text").collect()}
    for r in queries.op13_packing(spark, SF).collect():
        part = plain(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())


def test_training_rows(spark, plain):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7)) for i in range(40)], "doc_id bigint, text string")
    placed = packing.pack(docs, capacity=32, groups=4).cache()
    check(placed.collect(), {i: "a b c " * (i % 7) for i in range(40)}, plain, capacity=32)
    rows_ = packing.sequences(placed).collect()
    assert sum(r["_length"] for r in rows_) == sum(r["_length"] for r in placed.collect())
    assert all(len(r["_ids"]) == 4 * r["_length"] <= 4 * 32 for r in rows_)
    placed.unpersist()


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    lengths = np.unique(rng.integers(1, capacity + 1, rng.integers(1, 60)))
    counts = rng.integers(1, 400, len(lengths))
    seen, at = defaultdict(int), defaultdict(list)
    for r in sorted(packing.plan(lengths, counts, capacity, groups=64)):
        assert r.lo == seen[r.length]
        seen[r.length] = r.hi
        for k in range(r.hi - r.lo):
            at[r.sequence + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    assert seen == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    # first-fit decreasing as a yardstick
    rooms = []
    for length in np.repeat(lengths, counts)[::-1].tolist():
        k = next((k for k, room in enumerate(rooms) if room >= length), None)
        if k is None:
            rooms.append(capacity - length)
        else:
            rooms[k] -= length
    assert len(at) <= len(rooms) * 1.03 + 2


def test_edges(spark):
    placed = packing.pack(edge_docs(spark, clash=True)).collect()
    assert sum(r["_piece"] == 0 for r in placed) == len(EDGES)
    assert {r["_length"] for r in placed if r["doc_id"] in (3, 4, 5)} == {1}
    assert packing.pack(no_docs(spark)).collect() == []
