"""Statistics of an assembly, and the tests that a graph table must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Contigs of these lengths are counted apart (fixed values).
LONG, LARGE = 100_000, 1_000_000


def half_length(contigs: DataFrame, group: list[str], counted: Column, half: Column, reached: str) -> DataFrame:
    """(group, n50): the largest length at which the bases of contigs as long reach ``half``; lengths are summed first.

    ``half`` is an aggregate over a group's contigs, ``counted`` says which contigs add up, and ``reached`` is
    the comparison (">=" or ">") in SQL.  Groups that never reach it have 0.
    """
    summed = contigs.where(counted).groupBy(*group, "length").agg(F.sum("length").alias("_w"))
    down = Window.partitionBy(*group).orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    goal = contigs.groupBy(*group).agg(half.alias("_half"))
    run = summed.withColumn("_run", F.sum("_w").over(down)).join(goal, group)
    found = run.where(f"_run {reached} _half").groupBy(*group).agg(F.max("length").alias("n50"))
    return goal.select(*group).join(found, group, "left").na.fill(0, ["n50"])


def draft_statistics(contigs: DataFrame, group: list[str]) -> DataFrame:
    """Statistics of unpolished contigs (group, length, circular, kept), one row for each group.

    n50, contigs and bases are of the kept ones, the other columns of all; half of the bases is rounded down
    and bases is twice that half.
    """
    half = F.floor(F.coalesce(F.sum(F.when(F.col("kept"), F.col("length"))), F.lit(0)) / 2)
    counts = contigs.groupBy(*group).agg(
        F.max("length").alias("largest"),
        F.count_if("kept").alias("contigs"),
        F.count_if(F.col("circular") & (F.col("length") >= LARGE)).alias("circular_1m"),
        F.count_if(F.col("length") >= LARGE).alias("over_1m"),
        F.count_if(F.col("length") >= LONG).alias("over_100k"),
        (half * 2).alias("bases"),
    )
    return counts.join(half_length(contigs, group, F.col("kept"), half, ">="), group)


def final_statistics(contigs: DataFrame, group: list[str]) -> DataFrame:
    """Statistics of classified contigs (group, length, circular, class), one row for each group.

    Bases are those of primary contigs; n50 runs over contigs of every class until more than half of these
    bases is passed.  Lengths are counted strictly above their marks.
    """
    primary = F.col("class") == "primary"
    bases = F.coalesce(F.sum(F.when(primary, F.col("length"))), F.lit(0))
    counts = contigs.groupBy(*group).agg(
        F.max("length").alias("largest"),
        F.count_if(primary).alias("primary"),
        F.count_if(F.col("class") == "alternate").alias("alternate"),
        F.count_if(F.col("class") == "duplicate").alias("duplicate"),
        F.count_if(F.col("circular") & (F.col("length") > LARGE)).alias("circular_1m"),
        F.count_if(F.col("length") > LARGE).alias("over_1m"),
        F.count_if(F.col("length") > LONG).alias("over_100k"),
        bases.alias("bases"),
    )
    return counts.join(half_length(contigs, group, F.lit(True), F.floor(bases / 2), ">"), group)


def broken_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, fault): edges whose id is used twice ("repeated") or that miss an end among ``nodes`` (node) ("loose")."""
    repeated = edges.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1").select("edge_id", F.lit("repeated").alias("fault"))
    ends = edges.select("edge_id", F.explode(F.array("node1", "node2")).alias("node"))
    loose = ends.join(nodes.select("node"), "node", "left_anti").select("edge_id", F.lit("loose").alias("fault"))
    return repeated.union(loose.distinct())


def concatenate(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, ...) and edges of two graphs as one; ids of the second are moved past those of the first."""
    past = lambda df, name: F.broadcast(df.agg((F.coalesce(F.max(name), F.lit(-1)) + 1).alias("_past")))
    ids = past(nodes, "node")
    moved = more_nodes.join(ids).withColumn("node", F.col("node") + F.col("_past")).select(nodes.columns)
    linked = more_edges.join(ids).withColumn("node1", F.col("node1") + F.col("_past")).withColumn("node2", F.col("node2") + F.col("_past")).drop("_past")
    linked = linked.join(past(edges, "edge_id")).withColumn("edge_id", F.col("edge_id") + F.col("_past")).select(edges.columns)
    return nodes.union(moved), edges.union(linked)
