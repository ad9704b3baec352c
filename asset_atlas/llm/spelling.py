"""Spelling variants: words one edit apart, found through a variable-length gram index.

Words are counted natively. A gram dictionary is built level by level over the distinct words: all grams
of the least length, and longer ones only behind a gram that is too frequent. A word, padded at both
ends, is decomposed into the longest dictionary gram at each place that no earlier one covers. From the
dictionary follows how many grams a single edit can affect at worst, so two words one edit apart share
at least the rest; each word therefore enters only its rarest grams, one more than an edit can affect,
into the lists that are merged.

An edit lies wholly before or behind a shared gram, so the other side is the same in both words: a list
is keyed by the gram with all that stands before it, or with all behind it, and by the word's length.
Keys with very many words are split and their probes repeated. A pair that meets in a list is verified
by edit distance within the join.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the misspelling
draw; repeated rows count again; ties for a form go to the first word in code-point order; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS = 5
MIN_COUNT = 3
MISSPELL_EVERY = 97
SHORTEST, LONGEST = 2, 4
PAD = 2
#: a gram is frequent, and gives way to longer ones, from this share of all gram places on; so at most
#: 1 / share grams of a length are, and with an alphabet of 90 the dictionary stays under 400,000 entries
FREQUENT_SHARE = 1 / 2048
HOT_KEY_ROWS = 2000
MOST_ROUNDS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z lowered; words of ASCII alone take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def word_counts(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                misspell_every: int | None = MISSPELL_EVERY) -> DataFrame:
    """(word, n) of words long and frequent enough; every ``misspell_every``-th (document, word) loses a letter."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= min_chars)
    words = runs.select("id", lower_ascii(F.col("run")).alias("word"))
    if misspell_every:
        drawn = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = F.pmod("h", F.length("word")).cast("int")
        less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        words = drawn.select(F.when(F.pmod("h", F.lit(misspell_every)) == 0, less).otherwise(F.col("word")).alias("word"))
        words = words.filter(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


class Grams(NamedTuple):
    """Dictionary grams with their frequency, and all proper prefixes of them."""

    count: dict[str, int]
    prefixes: frozenset[str]
    longest: int


def padded(word: str) -> str:
    return "^" * PAD + word + "$" * PAD


def gram_dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST,
                    frequent_share: float = FREQUENT_SHARE) -> Grams:
    """Grams of the least length and, behind frequent ones, longer ones; of bounded size."""
    full = F.concat(F.lit("^" * PAD), F.col("word"), F.lit("$" * PAD))
    places = words.select(full.alias("s")).select(
        "s", F.explode(F.sequence(F.lit(1), F.length("s") - shortest + 1)).alias("p"))
    count: dict[str, int] = {}
    level, floor = places.select("s", "p"), 0.0
    for q in range(shortest, longest + 1):
        grams = level.filter(F.length("s") - F.col("p") + 1 >= q).groupBy(
            F.substring(F.col("s"), F.col("p"), F.lit(q)).alias("gram")).agg(F.count("*").alias("n"))
        found = {r["gram"]: r["n"] for r in grams.collect()}
        if q == shortest:
            floor = max(1.0, sum(found.values()) * frequent_share)
        count |= found
        frequent = [g for g, n in found.items() if n > floor]
        if not frequent or q == longest:
            break
        few = words.sparkSession.createDataFrame([(g,) for g in frequent], "gram string")
        level = level.withColumn("gram", F.substring(F.col("s"), F.col("p"), F.lit(q))).join(
            F.broadcast(few), "gram", "left_semi").drop("gram")
    return Grams(count, frozenset(g[:k] for g in count for k in range(1, len(g))), longest)


def decompose(s: str, grams: Grams, shortest: int = SHORTEST) -> tuple[list[int], list[tuple[int, int]]]:
    """End of the longest dictionary gram at each place, and (start, end) of those no earlier one covers."""
    ends, kept, reach = [], [], 0
    for p in range(len(s) - shortest + 1):
        q = min(grams.longest, len(s) - p)
        while q > shortest and s[p : p + q] not in grams.count:
            q -= 1
        ends.append(p + q)
        if p + q > reach:
            kept.append((p, p + q))
            reach = p + q
    return ends, kept


def surely_kept(s: str, ends: list[int], kept: list[tuple[int, int]], grams: Grams) -> int:
    """Grams that stay whatever single edit is made between the pads.

    An edit at i changes the grams over it and those before it that the dictionary could carry on into
    it; from the first such place on nothing before the edit is counted. Behind the edit a gram may be
    covered anew unless it ends more than the longest gram later. An insertion before i keeps no fewer
    than a replacement of i, but for the one at the very end.
    """
    least = len(kept)
    for i in range(PAD, len(s) - PAD + 1):
        first = next(
            (p for p in range(max(0, i - grams.longest + 1), min(i, len(ends)))
             if ends[p] > i or s[p:i] in grams.prefixes),
            i,
        )
        last = i + grams.longest
        if i == len(s) - PAD:
            stay = sum(p < first or (p >= i and end > last - 1) for p, end in kept)
        else:
            stay = sum(p < first or (p > i and end > last) for p, end in kept)
        least = min(least, stay)
    return least


def listed(word: str, grams: Grams) -> list[tuple[int, int]]:
    """(start, end) in the padded word of its rarest grams, one more than an edit can affect."""
    s = padded(word)
    ends, kept = decompose(s, grams)
    affected = len(kept) - surely_kept(s, ends, kept, grams)
    kept.sort(key=lambda g: (grams.count.get(s[g[0] : g[1]], 0), s[g[0] : g[1]], g[0]))
    return kept[: affected + 1]


def gram_lists(words: DataFrame, grams: Grams) -> DataFrame:
    """(word, n, from, to) for each listed gram of each word, places in the padded word from 0."""
    shipped = words.sparkSession.sparkContext.broadcast(grams)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            found = [listed(w, shipped.value) for w in pdf["word"]]
            pdf = pdf.assign(p=[[g[0] for g in f] for f in found], q=[[g[1] for g in f] for f in found])
            yield pdf

    table = words.mapInPandas(run, "word string, n bigint, p array<int>, q array<int>")
    return table.select("word", "n", F.inline(F.arrays_zip(F.col("p").alias("from"), F.col("q").alias("to"))))


def near_words(words: DataFrame, grams: Grams | None = None, hot: int = HOT_KEY_ROWS) -> DataFrame:
    """(word_a, n_a, word_b, n_b): each pair of words one edit apart once, the shorter or smaller first."""
    grams = grams or gram_dictionary(words)
    lists = gram_lists(words, grams)
    s = F.concat(F.lit("^" * PAD), F.col("word"), F.lit("$" * PAD))
    before = F.concat(F.lit("<"), F.substring(s, F.lit(1), F.col("to")))
    behind = F.concat(F.lit(">"), F.substring(s, F.col("from") + 1, F.length(s)))
    keys = stored(
        lists.select("word", "n", F.length("word").alias("size"), F.explode(F.array(before, behind)).alias("key")),
        "spelling-keys",
    )
    often = keys.groupBy("key", "size").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select(
        "key", "size", F.ceil(F.col("c") / hot).cast("int").alias("parts"))
    often = stored(often, "spelling-hot")
    index = keys.join(often, ["key", "size"], "left").select(
        "key", "size", F.col("word").alias("word_b"), F.col("n").alias("n_b"),
        F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), F.col("parts"))).cast("int").alias("part"),
    )
    longer = F.array(F.col("size"), F.col("size") + 1)
    probe = keys.withColumn("size", F.explode(longer)).join(often, ["key", "size"], "left").select(
        "key", "size", F.col("word").alias("word_a"), F.col("n").alias("n_a"),
        F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
            F.sequence(F.lit(0), F.col("parts") - 1))).alias("part"),
    )
    close = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.part") == F.col("b.part"))
        & ((F.length("word_a") < F.length("word_b")) | (F.col("word_a") < F.col("word_b")))
        & (F.levenshtein("word_a", "word_b", 1) == 1)
    )
    return probe.alias("a").join(index.alias("b"), close).select("word_a", "n_a", "word_b", "n_b").distinct()


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form) links, by doubling the distance known."""
    state = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MOST_ROUNDS):
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if state.join(ahead, "root", "left_semi").isEmpty():
            return state
        last, state = state, stored(
            state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        discard(last)
    raise RuntimeError("forms do not end")


def variants(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
             misspell_every: int | None = MISSPELL_EVERY) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word.

    ``form`` is the most frequent word one edit away, if at least twice as frequent as the word itself.
    """
    if 2 * LONGEST > min_chars + 2 * PAD:
        raise ValueError("with words this short an edit could affect all grams")
    words = stored(word_counts(docs, text, min_chars, min_count, misspell_every), "spelling-words")
    pairs = stored(near_words(words), "spelling-pairs")
    both = pairs.select(F.col("word_a").alias("word"), F.col("word_b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("word_b").alias("word"), F.col("word_a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    takes = F.coalesce(-F.col("best.m") >= 2 * F.col("n"), F.lit(False))
    known = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = last_forms(known.filter(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
