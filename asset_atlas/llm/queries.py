"""The registered corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import decontam, langid, lines, lm, mixing, near, packing, pii, quality, ranking, rules, spelling, substrings
from .queries_sql import ORACLES  # noqa: F401
from .rows import documents, id_fold, whole_text


def op1_lm(spark: SparkSession, d: str) -> DataFrame:
    return lm.score_texts(documents(spark, d).select("doc_id", "text"))


def op2_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_counts(pii.find_spans(documents(spark, d), keep=["doc_id"]))


def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text", "source", "lang")
    return mixing.mix_sources(docs).select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_n_words").alias("n_words"),
        F.round("_rate", 6).alias("rate"), F.col("_copies").alias("copies"),
    )


def op4_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text", "n_chars")
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    return quality.score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        (id_fold(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.judge(documents(spark, d).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_lines", "n_stop_words", "n_upper_words", "broken",
    )


def op6_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, d).select("doc_id", "text")).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op8_langid(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs), keep=["doc_id"]).select(
        "doc_id",
        (id_fold(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"),
    )


def op7_near(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    return near.classes(docs).select(F.col("_doc").alias("doc_id"), "class_id", "class_rows")


def op9_decontam(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    return decontam.matches(documents(spark, d).select("doc_id", "text"), items)


def op10_substrings(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    # rows of one text and id have the same passages, so they are matched by both
    digest = docs.withColumn("digest", F.xxhash64(whole_text()))
    passages = substrings.repeated_passages(digest, keep=["doc_id", "digest"]).filter(F.size("_passages") > 0).distinct()
    cut = substrings.remove_repeats(digest, keep=["doc_id", "digest"])
    same = cut["doc_id"].eqNullSafe(passages["doc_id"]) & (cut["digest"] == passages["digest"])
    words = F.aggregate("_passages", F.lit(0).cast("long"), lambda n, p: n + p["last"] - p["first"])
    return cut.join(passages, same, "left").select(
        cut["doc_id"],
        F.col("_n_bytes").alias("n_bytes"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
        F.coalesce(F.size("_passages"), F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce(words, F.lit(0)).alias("n_passage_words"),
    )


def op11_ranking(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    index = ranking.build_index(documents(spark, d).select("doc_id", "text"))
    return ranking.search(index, items).select("item_id", "rank", "doc_id", "score")


def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(documents(spark, d).select("doc_id", "text")).select(
        "word", "n", "n_near", "form", "form_n", "root")


def op13_packing(spark: SparkSession, d: str) -> DataFrame:
    table = stored(packing.pieces(documents(spark, d).select("doc_id", "text")), "packing-pieces")
    digest = table.withColumn("ids_crc32", F.crc32("_ids")).drop("_ids")
    return packing.packed(digest).select(
        "doc_id", F.col("_piece").alias("piece"), F.col("_start").alias("start"), F.col("_length").alias("length"),
        "ids_crc32", F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"),
    )


_ALL = (
    op1_lm, op2_pii, op3_mixing, op4_quality, op5_rules, op6_lines, op7_near, op8_langid, op9_decontam,
    op10_substrings, op11_ranking, op12_spelling, op13_packing,
)
QUERIES = {q.__name__: q for q in _ALL}
