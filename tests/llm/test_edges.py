"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, everywhere."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from asset_atlas.llm import decontam, langid, lines, lm, mixing, near, pii, quality, rules, substrings

from .small import EDGES, FIELDS, edge_docs, no_docs


def items(spark):
    return spark.createDataFrame([(1, "never there"), (2, None), (2, "")], "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, None), (None, 1)], "doc_id bigint, quality int")


OPERATORS = {
    "lm": lambda s, d: lm.score_texts(d),
    "pii": lambda s, d: pii.redact_counts(pii.find_spans(d)),
    "mixing": lambda s, d: mixing.mix_sources(d),
    "quality": lambda s, d: quality.score(d, quality.train(d, labels(s))),
    "rules": lambda s, d: rules.judge(d),
    "lines": lambda s, d: lines.dedup_lines(d),
    "near": lambda s, d: near.classes(d),
    "langid": lambda s, d: langid.predict(d, langid.train(d)),
    "substrings": lambda s, d: substrings.remove_repeats(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, name):
    got = OPERATORS[name](spark, edge_docs(spark, clash=True)).collect()
    assert len(got) == len(EDGES)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, no_docs(spark)).collect() == []


def test_decontamination_of_odd_rows(spark):
    docs = edge_docs(spark, clash=True)
    assert decontam.matches(docs, items(spark)).collect() == []
    assert decontam.clean(docs, items(spark)).count() == len(EDGES)
    assert decontam.matches(docs, items(spark).limit(0)).collect() == []
    assert decontam.clean(no_docs(spark), items(spark)).collect() == []


def test_odd_rows_have_defined_results(spark):
    docs = edge_docs(spark)
    by = lambda df, key: {r[key]: r for r in df.collect()}
    lang = by(langid.predict(docs, langid.train(docs)), "doc_id")
    assert [lang[i]["_lang"] for i in (3, 4, 5, 10)] == ["und"] * 4
    assert lang[4]["_score"] == 0.0
    score = by(lm.score_texts(docs), "doc_id")
    assert [score[i]["n_tokens"] for i in (3, 4, 5)] == [1, 1, 1]
    line = by(lines.dedup_lines(docs), "doc_id")
    assert (line[3]["_n_lines"], line[3]["_kept"], line[4]["_kept"]) == (1, "", "")
    # the sentence stands in rows 1, 1 and 2, so both rows of id 1 lose it
    assert (line[1]["_n_dropped"], line[2]["_n_dropped"]) == (1, 0)
    group = near.classes(docs).filter("_doc in (1, 2)").collect()
    assert {r["class_id"] for r in group} == {-(1 << 63)} or {r["class_id"] for r in group} == {1}
    cut = substrings.remove_repeats(docs).collect()
    assert {r["doc_id"]: r["_n_removed"] for r in cut}[11] == 5000
    assert all(0 <= r["_score"] <= 1 for r in quality.score(docs, quality.train(docs, labels(spark))).collect())


def test_repeated_rows_are_kept_once(spark):
    kept = near.keep_one(edge_docs(spark)).collect()
    assert sum(r["doc_id"] == 1 for r in kept) <= 1
    assert {r["doc_id"] for r in kept} >= {3, 4, 5, 8, 9, 10, 11}


@pytest.fixture
def folder(spark, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_no_rows(spark, stage, folder):
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, edge_docs(spark, clash=True), folder)
    assert set(FIELDS.replace(",", "").split()[::2]) <= set(got.columns)
    assert got.count() <= len(EDGES)
    assert run(spark, no_docs(spark), folder).collect() == []


def test_languages_stage_drops_the_undecided(spark):
    kept = corpus_pipeline.languages(spark, edge_docs(spark), "").collect()
    assert not {r["doc_id"] for r in kept} & {3, 4, 5, 10}
    assert {1, 2} <= {r["doc_id"] for r in kept}


def test_pipeline_follows_its_stages(spark):
    from .small import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in got.collect()}
    assert set(docs.columns) <= set(got.columns)
    assert ids and ids <= {r["doc_id"] for r in docs.collect()}
    held = decontam.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct()
    assert not ids & {r["doc_id"] for r in held.collect()}
    assert got.filter(F.col("copies") < 1).isEmpty()
