"""From raw documents to a weighted training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asset_atlas.llm import decontam, langid, lines, mixing, near
from asset_atlas.llm.rows import documents
from asset_atlas.session import stored

#: below this calibrated probability the language is not accepted
MIN_LANG_SCORE = 0.4


def _same(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``; those with a leading underscore are working names and go."""
    return out.select(*[c for c in docs.columns if c in out.columns])


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language stays in doubt."""
    scored = langid.predict(docs, langid.train(docs))
    sure = (F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= MIN_LANG_SCORE)
    return _same(docs, scored.filter(sure))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that stand in three documents or more down to the latest of these."""
    cut = lines.dedup_lines(docs)
    whole = {"text": F.when(F.col("_n_dropped") > 0, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        whole["n_chars"] = F.when(F.col("_n_dropped") > 0, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return _same(docs, cut.withColumns(whole))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that source, language and topic meet their target shares."""
    drawn = mixing.mix_sources(docs)
    kept = [c for c in docs.columns if c in drawn.columns and c.lower() not in ("topic", "rate", "copies")]
    return drawn.filter(F.col("_copies") > 0).select(
        *kept, F.col("_topic").alias("topic"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies")
    )


STAGES = [
    ("language_id", languages),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
]

#: models and probabilistic candidates are not SQL; tests check the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
