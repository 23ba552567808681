"""The pipeline, stage by stage, against plain versions of its stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import quality, queries, stages

from .fixtures import SCHEMA, WORD, corpus, frame
from .test_joins import plain_join, plain_substrings
from .test_models import LABELS, marked
from .test_tokens import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    rows, labels = marked(11)
    item = " ".join(f"leak{i}word" for i in range(30))
    more = [(10_000 + i, t) for i, (_, t) in enumerate(corpus(5))] + [(20_000, "Before it. " + item + ". After it all."), (None, "A row without an id stays."), (None, None)]
    frame(spark, rows + more).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_quality", F.lit("clash"))
    forest = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = stages.quality(spark, docs, folder)
    assert kept.columns == COLUMNS
    expected = quality.score_quality(docs.select("doc_id", "text"), forest, "q").where("q >= 0.3").select("doc_id", "text")
    assert rows_of(kept) == rows_of(expected) and 0 < kept.count() < docs.count()

    # From here on, every row of the table, so that there is enough to find.
    start = rows_of(docs)
    named = [r for r in start if r[0] is not None]
    linked, _ = plain_join(named, 5, 75)
    one = stages.near_duplicates(spark, docs.drop("_quality"), folder)
    assert one.columns == COLUMNS
    assert rows_of(one) == sorted([r for r in start if r[0] is None or linked[r[0]][0] == 0 or linked[r[0]][1] == r[0]], key=repr)

    cut = stages.repeated_passages(spark, one, folder)
    assert cut.columns == COLUMNS
    plain = plain_substrings(rows_of(one), 20)
    expected = []
    for i, text in rows_of(one):
        if i is None:
            expected.append((i, text))
            continue
        n, removed, kept_text = plain[i]
        if n == 0 or removed < n:
            expected.append((i, kept_text if removed else text))
    assert rows_of(cut) == sorted(expected, key=repr)
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())

    clean = stages.leaks(spark, cut, folder)
    assert clean.columns == COLUMNS
    assert {r[0] for r in rows_of(cut)} - {r[0] for r in rows_of(clean)} == {20_000}

    packed = stages.packing(spark, clean, folder).collect()
    check_packing(rows_of(clean), packed, (1024, 64, 1024), 0)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]


def test_run_on_an_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_instruction_packing_takes_every_answer(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet").where("role = 'assistant'").select("conv_id", "turn")
    got = queries.QUERIES["instruction_packing"](spark, data).select("doc_id").distinct().count()
    assert got == turns.distinct().count() > 0


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith("op")))
def test_registered_queries(spark, data, name):
    """Each query gives a row for each document, or more, of the whole table."""
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    out = queries.QUERIES[name](spark, data)
    rows = out.count()
    assert "doc_id" in out.columns
    assert rows >= n if name.startswith("op4_") else rows == n or name.startswith("op7_")


def test_words():
    assert WORD.findall("a b\x0bc  d") == ["a", "b", "c", "d"]
