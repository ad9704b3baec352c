"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from asset_atlas.llm import queries, rows, spelling

from .small import SF, edge_docs, lowered, no_docs


def neighbours(words):
    """word to the words one edit away, through all strings with one place wild or gone."""
    at = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            at[w[:i], w[i + 1 :]].add(w)
        for i in range(len(w) + 1):
            at[w[:i], w[i:]].add(w)
    out = defaultdict(set)
    for group in at.values():
        for w in group:
            out[w] |= group - {w}
    return out


def brute(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            if len(w) >= 5:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def rows_of(df):
    got = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len({r["word"] for r in got})
    return {tuple(r) for r in got}


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows.documents(spark, SF).select("doc_id", "text").collect()]
    assert rows_of(queries.op12_spelling(spark, SF)) == brute(docs)


def mutated(rng, alphabet, n):
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, 11))) for _ in range(n)}
    for w in sorted(words):
        for _ in range(3):
            i, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
            words.add(rng.choice([w[:i] + c + w[i:], w[: i - 1] + w[i:], w[:i] + c + w[i + 1 :]]))
    return sorted(w for w in words if len(w) >= 5)


@pytest.mark.parametrize("seed,alphabet,hot", [(1, "ab", 2000), (2, "abcé", 7), (3, "abcdefgh", 2000)])
def test_random_words(spark, seed, alphabet, hot):
    rng = random.Random(seed)
    words = [(w, rng.randint(3, 40)) for w in mutated(rng, alphabet, 150)]
    df = spark.createDataFrame(words, "word string, n bigint")
    # a low bound makes the dictionary hold grams of every length
    grams = spelling.gram_dictionary(df, frequent_share=0.01)
    got = {frozenset((r["word_a"], r["word_b"])) for r in spelling.near_words(df, grams, hot).collect()}
    assert {len(g) for g in grams.count} == {2, 3, 4}
    near = neighbours([w for w, _ in words])
    assert got == {frozenset((w, x)) for w in near for x in near[w]}


def test_an_edit_affects_no_more_grams_than_the_bound(spark):
    rng = random.Random(9)
    words = mutated(rng, "abcd", 300)
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    grams = spelling.gram_dictionary(df, frequent_share=0.004)
    for w in words[:200]:
        s = spelling.padded(w)
        ends, kept = spelling.decompose(s, grams)
        bound = spelling.surely_kept(s, ends, kept, grams)
        assert 1 <= bound <= len(kept)
        spelled = Counter(s[a:b] for a, b in kept)
        for i in range(len(w) + 1):
            for x in [w[:i] + "c" + w[i:], w[:i] + w[i + 1 :], w[:i] + "d" + w[i + 1 :]]:
                t = spelling.padded(x)
                other = Counter(t[a:b] for a, b in spelling.decompose(t, grams)[1])
                assert (spelled & other).total() >= bound


def test_chains_and_ties(spark):
    text = " ".join(["colours"] * 3 + ["colour"] * 6 + ["colur"] * 12 + ["coluur"] * 12 + ["house"] * 4 + ["hause"] * 2)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = {r["word"]: r for r in spelling.variants(df, misspell_every=None).collect()}
    assert {w: r["form"] for w, r in got.items()} == {
        "colours": "colour", "colour": "colur", "colur": None, "coluur": None, "house": None}
    assert got["colours"]["root"] == "colur" and got["colur"]["n_near"] == 2 and got["house"]["n_near"] == 0


def test_edges(spark):
    got = spelling.variants(edge_docs(spark, clash=True)).collect()
    assert {"quick", "brown"} <= {r["word"] for r in got}
    assert spelling.variants(no_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(no_docs(spark), min_chars=3)
