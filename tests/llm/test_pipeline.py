"""Every stage of the corpus pipeline against the operator that it applies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from strandmill.llm import decontaminate, near_dedup, toxicity
from strandmill.llm.shared import stored


@pytest.fixture(scope="module")
def steps(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, data), name)
        out.append(docs)
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_toxicity(spark, data, steps):
    model = toxicity.train(steps[0], spark.read.parquet(f"{data}/labels.parquet"))
    assert ids(steps[1]) == ids(toxicity.score(steps[0], model).where("predicted = 0"))


def test_one_of_each_group(steps):
    groups = near_dedup.near_duplicates(steps[1], width=5)
    assert ids(steps[2]) == ids(groups.where("kept"))
    assert steps[2].count() == groups.select("component_id").distinct().count()


def test_no_benchmark_left(spark, data, steps):
    found = decontaminate.find_items(steps[2], spark.read.parquet(f"{data}/benchmark.parquet"))
    assert ids(steps[3]) == ids(steps[2]) - ids(found)


def test_personal_data_is_gone(steps):
    assert ids(steps[4]) == ids(steps[3])
    assert steps[4].where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
    both = steps[3].select("doc_id", F.col("text").alias("was")).join(steps[4], "doc_id")
    assert both.where("was <> text AND NOT text RLIKE '<[A-Z_]+>'").count() == 0


def test_mix_takes_its_budget(steps):
    taken = steps[5].groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    assert taken.where("abs(taken - target) > 1").count() == 0
    assert ids(steps[5]) <= ids(steps[4])


def test_repeated_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    assert pipeline.drop_near_copies(spark, docs.union(docs), data).count() == pipeline.drop_near_copies(spark, docs, data).count()


def test_stages_on_odd_rows(spark, data):
    """Nulls, empties, a very long text, repeated rows and columns with the stages' own names."""
    texts = [None, "", "  ", "one", "a b c d e f", "a b c d e f", "x " * 200_000, "mail a@b.org now"]
    rows = [(None if i == 3 else i, t, None if i % 2 else "s", "k", 1, "p", 2.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, source string, _row_key string, size int, _spans string, taken double")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() == {"near_dedup": 7}.get(name, 9), name
        assert {r["_row_key"] for r in out.collect()} == {"k"}
    out = pipeline.mix_sources(spark, docs, data)
    assert out.columns == [*docs.columns, "size_", "source_size", "target", "taken_"]
    assert {r["size"] for r in out.collect()} == {1}


def test_mixed_texts_hold_the_words_taken(steps):
    rows = steps[5].select("text", "size", "taken").collect()
    assert all(len((r["text"] or "").split()) == r["taken"] <= r["size"] for r in rows)
    again = steps[5].groupBy("doc_id").agg(F.sum("taken").alias("all"), F.max("size").alias("size"))
    assert again.where("all > 3 * size").count() == 0 and again.where("all > size").count() > 0


def test_empty(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, data), "empty")
    assert docs.count() == 0


def test_one_row_of_each_group_stays(spark):
    """Rows without an id, and rows of one id, are copies like any other."""
    words = [f"w{i}" for i in range(300)]
    text, close, other = " ".join(words), " ".join([*words, "more"]), " ".join(f"v{i}" for i in range(300))
    rows = [(None, text), (7, close), (7, text), (None, other), (None, other + " end"), (3, None), (3, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in pipeline.drop_near_copies(spark, docs, "").collect()]
    groups = [{text, close}, {other, other + " end"}]
    assert [sum(t in g for _, t in left) for g in groups] == [1, 1]
    assert [i for i, t in left if t in groups[0]] == [7]
    assert len(left) == 5
