"""The backoff model of order three against a recursive brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

from asset_atlas.llm import lm

from .small import words

START, END = "<s>", None


def brute(texts, order):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    tokens = {i: [*words(t), END] for i, t in texts}
    counts = [Counter() for _ in range(order)]
    for i, w in tokens.items():
        if not held[i]:
            padded = [START] * (order - 1) + w
            for k in range(len(w)):
                for m in range(order):
                    counts[m][tuple(padded[k + order - 1 - m : k + order])] += 1
    disc = [lm.discounts([sum(c == r for c in x.values()) for r in range(1, 7)]) for x in counts]
    n = sum(counts[0].values())

    def taken(m, gram):
        r = counts[m][gram]
        return r * (disc[m][r] if r < len(disc[m]) else 1)

    whole, left, low = [Counter() for _ in range(order)], [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for m in range(1, order):
        for gram, r in counts[m].items():
            whole[m][gram[:-1]] += r
            left[m][gram[:-1]] += taken(m, gram)
    rest = n - sum(taken(0, g) for g in counts[0])

    def p(gram):
        m = len(gram) - 1
        if m == 0:
            return taken(0, gram) / n if counts[0][gram] else rest / n
        context = gram[:-1]
        if not whole[m][context]:
            return p(gram[1:])
        spare = whole[m][context] - left[m][context]
        full = spare <= 1e-9 * whole[m][context]
        total = whole[m][context] + full
        if counts[m][gram]:
            return taken(m, gram) / total
        return (1 if full else spare) / total / (1 - low[m][context]) * p(gram[1:])

    # a level's weights need the level below alone
    for m in range(1, order):
        for gram in counts[m]:
            low[m][gram[:-1]] += p(gram[1:])
    out = {}
    for i, w in tokens.items():
        padded = [START] * (order - 1) + w
        out[i] = sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(w)))
    seen = [c for c in whole[order - 1] if whole[order - 1][c]][:15]
    for context in seen:
        assert math.isclose(sum(p((*context, g[0])) for g in counts[0]) + p((*context, "\0never")), 1, rel_tol=1e-9)
    return out


def test_trigrams_match_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(25)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    texts += [(200, None), (201, "never seen words here"), (202, "W1 w2\tw3")]
    want = brute(texts, 3)
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, order=3).collect()}
    assert set(got) == set(want)
    for i, x in want.items():
        assert math.isclose(got[i], x, rel_tol=1e-9), i
