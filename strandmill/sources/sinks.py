"""Text sinks: assembly graphs, alignments, regions, identity matrices, step timings."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gfa_lines(nodes: DataFrame, reads: DataFrame, edges: DataFrame) -> DataFrame:
    """(value) of a graph: a header, segments with depth tags, read groups and links, in that order.

    ``nodes``: node, seq, dp1, dp2, dp3, median_dp1; ``reads``: node, at, read, forward; ``edges``: node1, node2, dir1, dir2.
    """
    head = nodes.sparkSession.createDataFrame([(0, "", "H\tVN:Z:1.0")], "kind int, key string, value string")
    depth = [F.concat(F.lit(f"{tag}:f:"), F.format_string("%.2f", c)) for tag, c in (("DP", "dp1"), ("DP2", "dp2"), ("DP3", "dp3"), ("MEDIAN_DP1", "median_dp1"))]
    key = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    seg = nodes.select(F.lit(1).alias("kind"), key("node").alias("key"), F.concat_ws("\t", F.lit("S"), F.concat(F.lit("u"), F.col("node").cast("string")), "seq", F.concat(F.lit("LN:i:"), F.length("seq").cast("string")), *depth).alias("value"))
    grp = reads.select(F.lit(2).alias("kind"), F.concat(key("node"), key("at")).alias("key"), F.concat_ws("\t", F.lit("a"), F.concat(F.lit("u"), F.col("node").cast("string")), F.col("at").cast("string"), "read", F.when(F.col("forward"), "+").otherwise("-")).alias("value"))
    sign = lambda c, plus: F.when(F.col(c) == plus, "+").otherwise("-")
    link = edges.select(F.lit(3).alias("kind"), F.concat(key("node1"), key("node2")).alias("key"), F.concat_ws("\t", F.lit("L"), F.concat(F.lit("u"), F.col("node1").cast("string")), sign("dir1", True), F.concat(F.lit("u"), F.col("node2").cast("string")), sign("dir2", False), F.lit("0M")).alias("value"))
    return head.union(seg).union(grp).union(link)


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> None:
    """Lines (kind, key, value) as one ordered text file."""
    rows = lines.orderBy("kind", "key", "value").select("value").coalesce(1)
    (rows.write.option("compression", compression) if compression else rows.write).text(path)


def paf(hits: DataFrame) -> DataFrame:
    """Tab-separated alignments: query, its length and span, strand, reference, its length and span, anchors, chain span, 255."""
    return hits.select(
        F.concat_ws("\t", "query", "len1", "start1", "end1", F.when(F.col("reverse"), "-").otherwise("+"), "ref", "len2", "start2", "end2", "anchors", F.col("end1") - F.col("start1"), F.lit("255")).alias("value")
    )


def bed(regions: DataFrame) -> DataFrame:
    """Low-quality regions: contig, start, stop, length, depth, condition, contig length, share."""
    size = F.col("stop") - F.col("start")
    return regions.select(F.concat_ws("\t", "ref", "start", "stop", size, "depth", "condition", "length", F.format_string("%.4f", size / F.col("length"))).alias("value"))


def sparse_matrix(pairs: DataFrame) -> DataFrame:
    """Reference, query, identity and both aligned shares in percent, best first within a reference."""
    pct = lambda c: F.format_string("%.2f", F.col(c) * 100)
    return pairs.select(F.concat_ws("\t", "ref", "query", pct("ani"), pct("af_ref"), pct("af_query")).alias("value"))


class Timer:
    """Step durations as a table, with the rest and the total."""

    def __init__(self) -> None:
        self.began, self.steps = time.perf_counter(), []

    def measure(self, name: str, step: Callable):
        at = time.perf_counter()
        out = step()
        self.steps.append((name, time.perf_counter() - at))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        total = max(time.perf_counter() - self.began, 1e-9)
        rows = [*self.steps, ("OTHER", total - sum(s for _, s in self.steps)), ("TOTAL", total)]
        return spark.createDataFrame([(n, float(s), 100.0 * s / total) for n, s in rows], "step string, duration_s double, duration_percent double")


def resume(spark: SparkSession, path: str, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage table: read if it was written with the same parameters, made and written otherwise."""
    full = f"{path}/{fingerprint}"
    try:
        return spark.read.parquet(full)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    make().write.mode("overwrite").parquet(full)
    return spark.read.parquet(full)
