"""Cleaning loops over a contig graph (nodes: node, length, reads, depth; edges as in ``graph``).

Each round is a join or a grouped map and a written table; loops stop when
nothing changes.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import graph as G
from .greedy import Edge, Graph
from .tables import stored


def without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes ``gone`` (node) and their edges."""
    left = nodes.join(gone, "node", "left_anti")
    return left, edges.join(gone.withColumnRenamed("node", "node1"), "node1", "left_anti").join(gone.withColumnRenamed("node", "node2"), "node2", "left_anti")


def keep_tips_apart(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those of the nodes ``gone``, which stay as isolated nodes."""
    return edges.join(gone.withColumnRenamed("node", "node1"), "node1", "left_anti").join(gone.withColumnRenamed("node", "node2"), "node2", "left_anti")


def remove_tips(nodes: DataFrame, edges: DataFrame, length: int = 20_000, reads: int = 3, rounds: int | None = None, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tips are taken off until there is none (each round takes some), or in the stated ``rounds``; ``keep`` isolates them instead.

    The rule sees one component, so a round looks again only at those that the round before changed.
    """
    live, links, taken = nodes, edges, []
    label = stored(G.components(edges), "labels")
    for _ in count() if rounds is None else range(rounds):
        sized = live.join(G.unique_lengths(live, links), "node")
        half = G.half_edges(links.select("node1", "node2", "dir1", "dir2"))
        gone = stored(G.tips(sized, links, length, reads, label).join(half.select("node").distinct(), "node", "left_semi"), "tips")
        if not gone.limit(1).count():
            break
        taken.append(gone)
        # A node of one neighbour leaves the rest of its component connected; where others go, components are found anew.
        near = half.where("node <> other").join(gone, "node", "left_semi").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b"))
        changed = label.join(gone, "node", "left_semi").join(near.where("a < b").select("node", F.lit(True).alias("forked")), "node", "left").groupBy("component").agg(F.max("forked").alias("forked"))
        left = stored(label.join(changed, "component").join(gone, "node", "left_anti").select("node", "component", "forked"), "labels")
        live = live.join(left.select("node"), "node", "left_semi")
        links = stored(links.join(left.select(F.col("node").alias("node1")), "node1", "left_semi").join(gone.toDF("node2"), "node2", "left_anti").select(*edges.columns), "links")
        label, torn = left.where("forked IS NULL").select("node", "component"), left.where("forked").select(F.col("node").alias("node1"))
        if torn.limit(1).count():
            label = stored(label.union(G.components(links.join(torn, "node1", "left_semi"))), "labels")
        live = stored(live, "nodes")
    for gone in [reduce(DataFrame.union, taken)] if taken else []:
        nodes, edges = (nodes, keep_tips_apart(edges, gone)) if keep else without(nodes, edges, gone)
        nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    return nodes, edges


def cut_coverage(nodes: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Without nodes whose mean depth over the three levels is under ``least``."""
    mean = F.aggregate("depths", F.lit(0.0), lambda a, d: a + d) / F.size("depths")
    return without(nodes, edges, nodes.where(mean < least).select("node"))


def cut_z_edges(edges: DataFrame, threshold: float = 1.0) -> DataFrame:
    return edges.join(G.z_edges(edges, threshold), "edge_id", "left_anti")


def component_kernel(nodes: DataFrame, edges: DataFrame, kernel, schema: str, label: DataFrame | None = None) -> DataFrame:
    """Apply ``kernel`` (Graph -> rows) to every component of at least one edge; rows get the component first.

    ``label`` (node, component) may be that of a graph with more edges, for
    kernels to which components side by side mean nothing.  Rows come sorted by
    component and are taken as a stream, so one component is held at a time and
    small ones cost no frame each.
    """
    label = G.components(edges) if label is None else label
    n = nodes.join(label, "node").select("component", F.lit(True).alias("is_node"), F.struct("node", "reads", "depths", "unique_length").alias("n"), F.lit(None).cast("struct<edge_id:long,node1:long,node2:long,dir1:boolean,dir2:boolean,overlap:long,diff:long,minimizers:long>").alias("e"))
    e = edges.join(label.withColumnRenamed("node", "node1"), "node1").select(
        "component", F.lit(False).alias("is_node"), F.lit(None).cast(n.schema["n"].dataType).alias("n"),
        F.struct(F.col("edge_id").cast("long").alias("edge_id"), "node1", "node2", "dir1", "dir2", F.col("overlap").cast("long").alias("overlap"), F.col("diff_snpmers").cast("long").alias("diff"), F.col("shared_minimizers").cast("long").alias("minimizers")).alias("e"),
    )

    names = ["component", *[f.split()[0] for f in schema.split(", ")]]
    out = StructType.fromDDL(f"component long, {schema}")

    def run(batches):
        arrow = to_arrow_schema(out)

        def solved(component, at: list, links: list) -> list[tuple]:
            graph = Graph(
                {x["node"]: x["reads"] for x in at}, {x["node"]: tuple(x["depths"]) for x in at}, {x["node"]: x["unique_length"] for x in at},
                {x["edge_id"]: Edge(x["edge_id"], (x["node1"], x["node2"]), (x["dir1"], x["dir2"]), x["overlap"], diff=x["diff"], minimizers=x["minimizers"]) for x in links},
            )
            return [(component, *r) for r in kernel(graph)]

        component, at, links = None, [], []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["component"] != component:
                    done += solved(component, at, links) if at or links else []
                    component, at, links = row["component"], [], []
                (at if row["is_node"] else links).append(row["n"] if row["is_node"] else row["e"])
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], arrow)
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in (solved(component, at, links) if at or links else [])], arrow)

    return n.union(e).repartition("component").sortWithinPartitions("component").mapInArrow(run, out)


def bubbles(sized: DataFrame, edges: DataFrame, longest: int = 50_000, label: DataFrame | None = None) -> DataFrame:
    """(kind, removed): nodes and edges that popping the bubbles of every component takes out; ``sized`` has unique_length."""
    return component_kernel(sized, edges, lambda g: [(k, int(x)) for k, xs in zip(("node", "edge"), g.bubbles(longest)) for x in sorted(xs)], "kind string, removed long", label)


def pop_bubbles(nodes: DataFrame, edges: DataFrame, longest: int = 50_000, rounds: int | None = None, label: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bubbles are popped until there is none (each round removes an edge), or in the stated ``rounds``.

    A bubble lies in one component, so the components of the first round
    (``label``, if known) serve all; those without a bubble stay without and are
    not searched again.
    """
    label = stored(G.components(edges), "labels") if label is None else label
    for _ in count() if rounds is None else range(rounds):
        sized = nodes.join(G.unique_lengths(nodes, edges), "node")
        found = stored(bubbles(sized, edges, longest, label), "bubbles")
        if not found.limit(1).count():
            break
        cut = found.where("kind = 'edge'").select(F.col("removed").alias("edge_id"))
        nodes, edges = without(nodes, edges.join(cut, "edge_id", "left_anti"), found.where("kind = 'node'").select(F.col("removed").alias("node")))
        nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
        label = stored(label.join(found.select("component").distinct(), "component", "left_semi").select("node", "component"), "labels")
    return nodes, edges


def walk_and_cut(nodes: DataFrame, edges: DataFrame, ratio: float, longest: int = 300_000, depth: int = 10, temperature: float = 1.0, c: int = 11, backing: int = 20_000, spared: DataFrame | None = None, label: DataFrame | None = None) -> DataFrame:
    """Edges whose walk weight is under ``ratio`` of the best on both their sides are cut, lightest first.

    Never a side's last edge, none whose cut leaves a side leading nowhere within
    ``backing`` bases, and none in ``spared`` (edge_id), such as strain repeats.
    ``label`` (node, component) may be that of a graph with more edges.
    """

    def kernel(graph: Graph):
        weight = graph.edge_weights(longest, depth, temperature=temperature, c=c)
        cut: set = set()
        for i in sorted(graph.edges, key=lambda e: (weight[e], graph.edges[e].overlap, e)):
            sides = [[r for r in graph.at[key] if r.id not in cut] for key in zip(graph.edges[i].ends, graph.edges[i].sides)]
            if all(len(s) > 1 and weight[i] < ratio * max(weight[r.id] for r in s) for s in sides) and graph.safe(i, cut, backing):
                cut.add(i)
        return [(int(e),) for e in sorted(cut)]

    sized = nodes.join(G.unique_lengths(nodes, edges), "node")
    gone = component_kernel(sized, edges, kernel, "edge_id long", label).select("edge_id")
    if spared is not None:
        gone = gone.join(spared.select("edge_id"), "edge_id", "left_anti")
    return edges.join(gone, "edge_id", "left_anti")


def heavy_clean(nodes: DataFrame, edges: DataFrame, temperatures: tuple[float, ...] = (2.0, 1.5, 1.0, 0.5), ratios: tuple[float, ...] = (0.125, 0.25, 0.5), **options) -> tuple[DataFrame, DataFrame]:
    """Walk cuts from mild to strict, with tips and bubbles taken off after each."""
    for temperature in temperatures:
        for ratio in ratios:
            edges = stored(walk_and_cut(nodes, edges, ratio, temperature=temperature, **options), "walked")
            nodes, edges = remove_tips(nodes, edges)
            nodes, edges = pop_bubbles(nodes, edges)
    return nodes, edges


def progressive_union(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Contigs of several coverage levels, strictest first, each read used once.

    Each level is (contigs with id, members with id and read); a contig is taken
    if none of its reads was used before.
    """
    taken, used = None, None
    for contigs, members in levels:
        if taken is None:
            taken, used = contigs, members.select("read")
            continue
        clash = members.join(used.distinct(), "read", "left_semi").select("id").distinct()
        fresh = contigs.join(clash, "id", "left_anti")
        taken = taken.unionByName(fresh)
        used = stored(used.union(members.join(fresh.select("id"), "id", "left_semi").select("read")), "used")
    return taken


def two_cycles(overlaps: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(read_i, read_j, length): pairs of reads that overlap on both sides, so form a small circle; of circles of like length the one with the smallest hangs.

    ``overlaps`` is the output of ``best_overlaps`` with len1 and len2.
    """
    pair = overlaps.groupBy("read_i", "read_j").agg(
        F.count("*").alias("n"), F.sum("overlap1_len").alias("o"), F.sum(F.col("hang1") + F.col("hang2")).alias("hangs"), F.max("len1").alias("len1"), F.max("len2").alias("len2")
    )
    circles = pair.where("n = 2").withColumn("length", F.col("len1") + F.col("len2") - F.col("o"))
    group = F.floor(F.log(F.greatest("length", F.lit(1))) / F.log(F.lit(1 + tolerance)))
    order = Window.partitionBy(group).orderBy("hangs", "read_i", "read_j")
    return circles.withColumn("place", F.row_number().over(order)).where("place = 1").select("read_i", "read_j", "length")


def circular(edges: DataFrame) -> DataFrame:
    """(node, strict, walk): strict if a node's only edge joins its two sides, walk if some edge does."""
    half = G.half_edges(edges)
    loops = half.where("node = other AND side <> other_side").groupBy("node").agg(F.countDistinct("edge_id").alias("loops"))
    every = half.groupBy("node").agg(F.countDistinct("edge_id").alias("edges"))
    return every.join(loops, "node", "left").select("node", ((F.col("loops") == 1) & (F.col("edges") == 1)).alias("strict"), F.col("loops").isNotNull().alias("walk")).na.fill(False)
