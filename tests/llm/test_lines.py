"""Line dedup against brute force, with lines repeated inside documents."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from asset_atlas.llm import lines

from .small import lowered

BLANKS = " \t\n\x0b\x0c\r"


def cut(docs, least=20, spread=3):
    """doc_id to (lines, dropped, kept text)."""
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = lowered(line.strip(BLANKS))
            if len(key) >= least:
                holders[key].add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= spread}
    out = {}
    for i, t in docs:
        rows = (t or "").split("\n")
        left = [r for r in rows if last.get(lowered(r.strip(BLANKS)), i) == i]
        out[i] = (len(rows), len(rows) - len(left), "\n".join(left))
    return out


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], r["_kept"]) for r in lines.dedup_lines(df).collect()}


def test_a_line_twice_in_one_document_counts_once(spark):
    line = "this line has more than twenty characters"
    docs = [(1, f"{line}\nown\n{line}"), (2, line)]
    assert run(spark, docs) == {1: (3, 0, docs[0][1]), 2: (1, 0, line)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_line_tables(spark, seed):
    rng = random.Random(seed)
    pool = [f"line number {i} of a pool " + "é" * rng.randint(0, 3) for i in range(40)] + ["short", ""]
    pool += [f"  {x.upper()}\t" for x in pool[:10]]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) or None) for i in range(60)]
    assert run(spark, docs) == cut(docs)
