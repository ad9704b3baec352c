"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is a built-in expression over the row's own text, so the rules never shuffle and run
where the scan runs. Repeated word windows are found by sorting the row's window hashes, which is
n log n in the text's length.

Defined cases: null or empty text has no word and fails the length rule; a text of one or two words
has no window; rows that repeat are judged alone; an empty table gives an empty result; other
columns pass through; one with the name of a measure is replaced by it, one with a leading underscore
is left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import BLANKS, carried, whole_text

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
            "n_upper_words", "mean_word_chars", "symbol_ratio", "stop_ratio", "upper_ratio", "repeat_ratio",
            "dup_line_ratio", "base_failed", "kept", "broken"]

# fixed values: frequent function words, by language
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "was", "as", "by", "it",
    "der", "die", "das", "und", "zu", "den", "ist", "von", "mit", "auf", "ein", "eine", "im",
    "le", "la", "les", "de", "des", "et", "un", "une", "en", "du", "est", "que", "qui", "dans",
    "el", "los", "las", "y", "con", "por", "para", "del", "se", "una", "lo",
]


class Rule(NamedTuple):
    """A text fails when ``measure`` lies outside [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: the floor every caller gets: too few words, or over half of them in repeated windows
BASE = [
    Rule("few_words", "n_words", low=50),
    Rule("repeats", "repeat_ratio", high=0.5),
]

#: shape rules on top of the floor
TABLE = [
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("shouting", "upper_ratio", high=0.5),
    Rule("same_lines", "dup_line_ratio", high=0.4),
]

SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    """Runs of non-blank characters; a blank text has none."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _windows(words: Column) -> Column:
    """(hash, place) of every window of three words, ascending."""
    places = F.sequence(F.lit(0), F.size(words) - 3)
    window = F.transform(
        places,
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        ),
    )
    return F.when(F.size(words) >= 3, F.sort_array(window)).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")
    )


def _repeated_places(windows: Column) -> Column:
    """First words of the windows that occur twice or more, ascending."""
    twin = F.filter(
        windows,
        lambda x, i: (F.get(windows, i - 1)["h"] == x["h"]) | (F.get(windows, i + 1)["h"] == x["h"]),
    )
    return F.sort_array(twin["i"])


def _covered(places: Column) -> Column:
    """Words inside the windows that start at the ascending ``places``."""
    return F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the raw counts and ratios the rules look at."""
    docs, whole = carried(docs, *MEASURES), whole_text(text)
    out = docs.withColumn("_words", _words(whole)).withColumn("_windows", _windows(F.col("_words")))
    out = out.withColumn(
        "_lines", F.filter(F.split(whole, "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    ).withColumn("_joined", F.array_join("_words", ""))
    symbols = F.when(
        F.col("_joined").rlike(r"[#*$%&|<>]"),
        F.length("_joined") - F.length(F.translate("_joined", SYMBOLS, "")),
    ).otherwise(0)
    stop = F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))
    shout = F.filter("_words", lambda w: w.rlike("^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"))
    out = out.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(_repeated_places(F.col("_windows"))).alias("n_repeat_words"),
        F.size(stop).cast("long").alias("n_stop_words"),
        F.size(shout).cast("long").alias("n_upper_words"),
    )
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return out.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbol_ratio": F.col("n_symbols") / words,
            "stop_ratio": F.col("n_stop_words") / words,
            "upper_ratio": F.col("n_upper_words") / words,
            "repeat_ratio": F.col("n_repeat_words") / words,
            "dup_line_ratio": F.col("n_dup_lines") / lines,
        }
    )


def failed(rules: list[Rule]) -> Column:
    """True when any rule of the table is broken."""
    broken = F.lit(False)
    for rule in rules:
        if rule.low is not None:
            broken = broken | (F.col(rule.measure) < rule.low)
        if rule.high is not None:
            broken = broken | (F.col(rule.measure) > rule.high)
    return broken


def judge(docs: DataFrame, text: str = "text", base: list[Rule] = BASE, table: list[Rule] = TABLE) -> DataFrame:
    """Measures plus ``base_failed``, ``kept`` and the names of the broken rules."""
    reasons = F.filter(
        F.array(*[F.when(failed([r]), F.lit(r.name)) for r in [*base, *table]]), lambda x: x.isNotNull()
    )
    return measure(docs, text).withColumns(
        {"base_failed": failed(base), "kept": ~failed([*base, *table]), "broken": F.array_join(reasons, ",")}
    )
