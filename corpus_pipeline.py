"""Corpus pipeline: filter, deduplicate, decontaminate, redact and mix ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  Every stage works on
all that its predecessor kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import decontaminate, mixing, near_dedup, pii, toxicity
from strandmill.llm.shared import forget, free_name, keep_rows, stored

#: Iterative training, links and edit distances are not expressible in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    Null and empty texts get the model's intercept as score; without labels of
    both classes every text has the score of the labels' share.  Repeated rows
    are judged alike.  An empty table stays empty; other columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more).

    Of a group the row of the smallest id stays, null ids last, ties by a hash
    of id and text.  Rows without words are copies only of rows with the same id
    and text.  An empty table stays empty; other columns may have any name, and
    of rows that agree in id and text any one stays.
    """
    key = free_name(docs, "_row_key")
    keys = stored(near_dedup.representatives(docs, width=5, percent=80).withColumnRenamed("row_key", key), "kept")
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return keep_rows(rows, keys, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none.  Repeated rows are judged alike; null and
    empty items match nothing.  Empty tables give all documents back.  Other
    columns pass through.
    """
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.

    Null and empty texts stay; of overlapping spans the earlier, longer one
    counts.  Repeated rows are redacted alike.  An empty table stays empty;
    other columns may have any name.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each time the mix takes a text, cut to the words taken at a source's end.

    Null and empty texts have no words and are left out.  A null source is one
    of its own.  Repeated rows take separately.  An empty table stays empty.
    Size, source_size, target and taken are added under free names.
    """
    return mixing.materialized(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each read from the table that the one before wrote; that table is removed when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name)
            if before is not None:
                forget(before)
            before = docs
    return docs
