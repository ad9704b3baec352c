"""Full-text search over names and paths."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import query_terms, search_tokens
from .catalog import sort_keys
from .usages import unused_assets

K1, B = 1.2, 0.75
MIN_IDF = 1e-6


def _words(assets: DataFrame) -> DataFrame:
    """(source_id, asset_id, words) spread by asset over the session's shuffle partitions.

    A small file of names is a lot of terms: they are split off after the shuffle, in a fixed number of
    partitions, and the terms of an asset are then counted where they are, without another shuffle.
    """
    columns = ("name", "stem", "rel_path")
    parts = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = assets.select("source_id", "asset_id", *columns).repartition(parts, "asset_id")
    return spread.select(
        "source_id", "asset_id", F.concat(*[search_tokens(F.col(c)) for c in columns]).alias("words"))


def inverted_index(assets: DataFrame) -> DataFrame:
    """(source_id, term, asset_id, tf) over name, stem and path."""
    return (
        _words(assets).select("source_id", "asset_id", F.explode("words").alias("term"))
        .groupBy("source_id", "term", "asset_id")
        .agg(F.count("*").alias("tf"))
    )


def _like(q: str) -> Column:
    needle = F.lower(F.lit(q))
    return F.lower("stem").contains(needle) | F.lower("rel_path").contains(needle)


class TermIndex(NamedTuple):
    """(source_id, term, asset_id, tf, words_n) rows in the order of their terms, and the totals they lack."""

    terms: DataFrame
    totals: DataFrame


def store_term_index(assets: DataFrame, folder: str) -> TermIndex:
    """Write the terms of a catalogue in ranges, sorted, so that a prefix is in few files and row groups."""
    rows = _words(assets)
    (
        rows.select("source_id", "asset_id", F.size("words").alias("words_n"), F.explode("words").alias("term"))
        .groupBy("source_id", "term", "asset_id", "words_n")
        .agg(F.count("*").alias("tf"))
        .repartitionByRange("term", "asset_id")
        .sortWithinPartitions("term", "asset_id")
        .write.mode("overwrite")
        .parquet(f"{folder}/terms")
    )
    totals = rows.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words_n"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
    return open_term_index(assets.sparkSession, folder)


def open_term_index(spark: SparkSession, folder: str) -> TermIndex:
    return TermIndex(spark.read.parquet(f"{folder}/terms"), spark.read.parquet(f"{folder}/totals"))


def _score(n: Column, mean: Column, words_n: Column, df: list[Column], tf: list[Column]) -> Column:
    """BM25 over the terms, higher is better."""
    length = words_n / mean

    def part(d: Column, t: Column) -> Column:
        idf = F.greatest(F.log((n - d + 0.5) / (d + 0.5)), F.lit(MIN_IDF))
        return idf * t * (K1 + 1) / (t + K1 * (1 - B + B * length))

    return reduce(lambda a, b: a + b, [part(d, t) for d, t in zip(df, tf, strict=True)])


def indexed_matches(index: TermIndex, terms: list[str], source_id: int | None = None) -> DataFrame:
    """(asset_id, score) of the assets holding every prefix term, from the stored index alone.

    The prefixes go to the scan; what is read and aggregated grows with the assets that hold one.
    """
    one = F.lit(True) if source_id is None else F.col("source_id") == source_id
    starts = [F.col("term").startswith(t) for t in terms]
    places = range(len(terms))
    rows = index.terms.filter(reduce(lambda a, b: a | b, starts) & one)
    per = rows.groupBy("asset_id").agg(
        F.first("words_n").alias("words_n"),
        *[F.coalesce(F.sum(F.when(s, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, s in zip(places, starts, strict=True)],
    )
    held = [F.col(f"tf{i}") > 0 for i in places]
    counts = per.agg(F.struct(*[F.count_if(h).alias(f"df{i}") for i, h in zip(places, held, strict=True)])).scalar()
    totals = index.totals.filter(one).agg(
        F.struct(F.sum("n").alias("n"), (F.sum("words_n") / F.sum("n")).alias("mean"))).scalar()
    known = per.filter(reduce(lambda a, b: a & b, held)).withColumns({"s": counts, "t": totals})
    score = _score(F.col("t.n"), F.col("t.mean"), F.col("words_n"),
                   [F.col(f"s.df{i}") for i in places], [F.col(f"tf{i}") for i in places])
    return known.select("asset_id", score.alias("score"))


def text_matches(assets: DataFrame, terms: list[str]) -> DataFrame:
    """Assets holding every prefix term, with their BM25 score, without a stored index.

    Term counts are worked out inside each row; only row counts, the mean length and one document
    frequency per term are aggregated, so nothing but the result is shuffled.
    """
    words = F.concat(*[search_tokens(F.col(c)) for c in ("name", "stem", "rel_path")])
    rows = assets.withColumn("words", words)
    places = range(len(terms))

    def frequency(term: str) -> Column:
        return F.size(F.filter("words", lambda w: w.startswith(term)))

    counted = rows.select(
        "*",
        F.size("words").alias("words_n"),
        *[frequency(t).alias(f"tf{i}") for i, t in enumerate(terms)],
    ).drop("words")
    stats = counted.agg(
        F.struct(
            F.count("*").alias("n"),
            F.avg("words_n").alias("mean"),
            *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in places],
        ).alias("s")
    )
    scored = counted.filter(
        reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in places])
    ).withColumn("s", stats.scalar())
    score = _score(F.col("s.n"), F.col("s.mean"), F.col("words_n"),
                   [F.col(f"s.df{i}") for i in places], [F.col(f"tf{i}") for i in places])
    return scored.withColumn("score", score).drop("s", "words_n", *[f"tf{i}" for i in places])


def search(
    assets: DataFrame,
    q: str = "",
    folder: str | None = None,
    exts: list[str] | None = None,
    usages: DataFrame | None = None,
    unused_only: bool = False,
    sort: str | None = None,
    limit: int | None = None,
    index: TermIndex | None = None,
) -> DataFrame:
    """Catalogue search: text and filters choose the rows, then they are ordered and cut if asked.

    With a stored ``index`` of these assets the terms are looked up there.
    """
    q = q.strip()
    terms = query_terms(q) if len(q) >= 2 else []
    if terms and index is not None:
        rows = assets.join(indexed_matches(index, terms), "asset_id")
    elif terms:
        rows = text_matches(assets, terms)
    else:
        rows = assets.filter(_like(q)) if q else assets
    if folder is not None:
        rows = rows.filter(F.col("dir") == folder)
    if exts:
        rows = rows.filter(F.col("ext").isin(exts))
    if unused_only:
        rows = unused_assets(rows, usages)
    if sort:
        order = sort_keys(sort)
    elif terms:
        order = [F.desc("score"), F.asc("asset_id")]
    else:
        order = [F.asc("dir"), F.asc("name"), F.asc("asset_id")]
    listed = rows.orderBy(*order)
    return listed if limit is None else listed.limit(limit)
