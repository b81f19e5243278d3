"""Sequence objects read from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import clean_bases


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): the A, C, G, T letters of every document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), clean_bases(F.col("text")).alias("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): the same of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), clean_bases(F.col("text")).alias("seq"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, start, stop): line items as intervals on their supplier's axis."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ref"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("stop"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, length) of those axes."""
    return intervals(spark, sf_dir).groupBy("ref").agg((F.max("stop") + 500).alias("length"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bidirected edges between customers (even nodes) and suppliers (odd nodes), one for each line item."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    q = F.col("l_quantity").cast("long")
    return items.join(orders, "l_orderkey").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edge_id"),
        (F.col("o_custkey") * 2).alias("node1"),
        (F.col("l_suppkey") * 2 + 1).alias("node2"),
        (F.col("l_returnflag") == "N").alias("dir1"),
        (F.col("l_linestatus") == "O").alias("dir2"),
        (q * 100).alias("overlap"),
        (F.col("l_partkey") % 4).alias("diff_snpmers"),
        (F.col("l_partkey") % 17).alias("shared_snpmers"),
        (F.col("l_partkey") % 23 + q).alias("shared_minimizers"),
    )


SQL_READS = "reads AS (SELECT doc_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
SQL_CONTIGS = "contigs AS (SELECT item_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)"
SQL_INTERVALS = "iv AS (SELECT l_suppkey AS ref, l_partkey AS start, l_partkey + l_quantity::BIGINT AS stop FROM lineitem)"
SQL_BOUNDS = "bounds AS (SELECT ref, max(stop) + 500 AS length FROM iv GROUP BY ref)"
SQL_EDGES = """edges AS (SELECT l_orderkey * 100 + l_linenumber AS edge_id, o_custkey * 2 AS node1, l_suppkey * 2 + 1 AS node2,
  l_returnflag = 'N' AS dir1, l_linestatus = 'O' AS dir2, l_quantity::BIGINT * 100 AS overlap, l_partkey % 4 AS diff_snpmers,
  l_partkey % 17 AS shared_snpmers, l_partkey % 23 + l_quantity::BIGINT AS shared_minimizers
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_HALF = """half AS (SELECT *, node1 AS node, dir1 AS side, node2 AS other, dir2 AS other_side FROM edges
  UNION ALL SELECT *, node2, dir2, node1, dir1 FROM edges)"""


def sql_kmers(source: str, name: str, k: int, palindromes: bool = False) -> str:
    """CTEs that leave ``name`` (id, pos, kmer, forward, split) of a sequence CTE, as strings."""
    h = k // 2
    drop = "" if palindromes else "WHERE mf <> mr"
    return f"""{name}_a AS (SELECT id, seq, unnest(range(0, length(seq) - {k} + 1)) AS pos FROM {source} WHERE length(seq) >= {k}),
{name}_b AS (SELECT id, pos, substr(seq, pos + 1, {k}) AS f FROM {name}_a),
{name}_c AS (SELECT id, pos, f, reverse(translate(f, 'ACGT', 'TGCA')) AS r FROM {name}_b),
{name}_d AS (SELECT *, substr(f, 1, {h}) || '_' || substr(f, {h} + 2) AS mf, substr(r, 1, {h}) || '_' || substr(r, {h} + 2) AS mr FROM {name}_c),
{name} AS (SELECT id, pos, CASE WHEN mf <= mr THEN f ELSE r END AS kmer, mf < mr AS forward, least(mf, mr) AS split FROM {name}_d {drop})"""
