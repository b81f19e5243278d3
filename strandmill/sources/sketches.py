"""Marker sketches as Parquet tables: (id, length, markers), with the parameters they were made with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ani import markers

#: Shorter records give no sketch (fixed value).
LEAST_LENGTH = 500


def sketch(records: DataFrame, k: int, c: int, by: str = "id", least: int = LEAST_LENGTH) -> DataFrame:
    """(id, length, k, c, markers): one sketch for each value of ``by`` over its records (seq) of at least ``least`` bases.

    By record id it is a sketch for each record, by file name one for each file.  Values whose records hold no
    marker have an empty array; values whose records are all too short have no row.
    """
    kept = records.where(F.length("seq") >= least).select(F.col(by).alias("id"), "seq")
    sizes = kept.groupBy("id").agg(F.sum(F.length("seq")).alias("length"))
    found = markers(kept, k, c).groupBy("id").agg(F.array_sort(F.collect_list("marker")).alias("markers"))
    none = F.array().cast("array<bigint>")
    return sizes.join(found, "id", "left").select("id", "length", F.lit(k).alias("k"), F.lit(c).alias("c"), F.coalesce("markers", none).alias("markers"))


def too_short(records: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(records): how many records are too short for a sketch."""
    return records.agg(F.count_if(F.length("seq") < least).alias("records"))


def write_sketches(sketches: DataFrame, path: str) -> None:
    sketches.write.mode("overwrite").parquet(path)


def read_sketches(spark: SparkSession, path: str, k: int, c: int) -> DataFrame:
    """Sketches made with these parameters; an error if the table has others."""
    rows = spark.read.parquet(path)
    other = rows.where((F.col("k") != k) | (F.col("c") != c)).select("k", "c").limit(1).collect()
    if other:
        raise ValueError(f"sketches of k={other[0].k}, c={other[0].c} where k={k}, c={c} are needed")
    return rows


def marker_rows(sketches: DataFrame) -> DataFrame:
    """(id, marker): the screen's input, from stored sketches."""
    return sketches.select("id", F.explode("markers").alias("marker"))


def small_sketches(sketches: DataFrame, least: int = 20, share: float = 0.25, many: int = 10_000) -> DataFrame:
    """(small, large, warn): sketches under ``least`` markers, the others, and whether small ones are over ``share`` of more than ``many``."""
    small = F.size("markers") < least
    counts = sketches.agg(F.count_if(small).alias("small"), F.count_if(~small).alias("large"))
    total = F.col("small") + F.col("large")
    return counts.withColumn("warn", (total > many) & (F.col("small") > share * total))
