"""Bidirected graphs as tables.

An edge (edge_id, node1, node2, dir1, dir2, ...) touches node1 on side ``dir1``
and node2 on side ``dir2`` (true: outgoing).  Rules about a node's side are
joins on the half-edge table, which has one row for each end of an edge.
Label propagation is iterative and checkpoints every round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import coverage_ratio_levels
from .tables import forget, hot_keys, spread_join, stored


def half_edges(edges: DataFrame) -> DataFrame:
    """(edge columns, node, side, other, other_side): two rows for each edge, and two for a loop."""
    ends = F.array(
        F.struct(F.col("node1").alias("node"), F.col("dir1").alias("side"), F.col("node2").alias("other"), F.col("dir2").alias("other_side")),
        F.struct(F.col("node2").alias("node"), F.col("dir2").alias("side"), F.col("node1").alias("other"), F.col("dir1").alias("other_side")),
    )
    return edges.withColumn("_e", F.explode(ends)).select("*", "_e.*").drop("_e")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree)."""
    return half_edges(edges).groupBy("node").agg(F.count_if("side").alias("out_degree"), F.count_if(~F.col("side")).alias("in_degree"))


def smallest_reachable(arcs: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``arcs`` (src, dst), a stored table with both directions of every link.

    Each round a node takes the lowest label next to it, its label's node (the
    root) takes the lowest that any node of the label saw, and both jump to
    their label's label.  Rounds grow with the logarithm of the longest path in
    whatever order its nodes are; they end only when no label moves.  Every
    round is a written table, and the round before it is removed.  Hubs and the
    labels of large components are dealt in pieces.
    """
    first = arcs.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"), F.count("*").alias("count"))
    first = stored(first, "degrees")
    hubs = hot_keys(first.select(F.col("node").alias("src"), "count"), "src")
    labels = stored(first.select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = spread_join(arcs, labels.select(F.col("node").alias("src"), "label"), "src", hubs, "dst").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("low"))
        seen = labels.select("node", "label").join(near, "node", "left").select("node", "label", F.least("label", "low").alias("mid"))
        hooks = seen.where("mid < label").groupBy(F.col("label").alias("node")).agg(F.min("mid").alias("hook"))
        step = seen.join(hooks, "node", "left").select("node", F.col("label").alias("was"), F.least("mid", "hook").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        large = hot_keys(labels.groupBy(F.col("label").alias("mid")).count(), "mid")
        label = F.least("mid", "far")
        moved = stored(spread_join(step, jump, "mid", large, "node", "left").select("node", label.alias("label"), (label != F.col("was")).alias("moved")), "labels")
        forget(labels)
        labels = moved
        if not labels.where("moved").limit(1).count():
            forget(first)
            return labels.select("node", "label")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable."""
    both = edges.select(F.col("node1").alias("src"), F.col("node2").alias("dst")).union(edges.select("node2", "node1")).distinct()
    return smallest_reachable(stored(both, "arcs")).withColumnRenamed("label", "component")


def prune_low_minimizer(edges: DataFrame, c: int, absolute: float = 8.0, relative: float = 5.0) -> DataFrame:
    """Edges whose bases per shared minimizer are neither too many as such nor against the best edge of their sides."""
    rated = edges.withColumn("rate", F.col("overlap") / F.col("shared_minimizers"))
    best = half_edges(rated).groupBy("node", "side").agg(F.min("rate").alias("best"))
    at1, at2 = best.toDF("node1", "dir1", "best1"), best.toDF("node2", "dir2", "best2")
    joined = rated.join(at1, ["node1", "dir1"]).join(at2, ["node2", "dir2"])
    kept = joined.where((F.col("rate") / c <= absolute) & (F.col("rate") / F.greatest("best1", "best2") <= relative))
    return kept.select(*edges.columns)


def transitive_edges(edges: DataFrame, lengths: DataFrame, fuzz: int = 750) -> DataFrame:
    """(edge_id): edges a-c that a two-step path a-b-c explains.

    The path leaves b on the side opposite to the one it entered, ends at c on
    the edge's own side, starts at a on the edge's own side, and overhangs no
    more than the longest edge on that side of a plus ``fuzz``.  Edge length is
    both node lengths less the overlap; paths are joins of half-edges on the
    middle node.
    """
    size = lengths.toDF("id", "size")
    sized = edges.join(size.toDF("node1", "size1"), "node1").join(size.toDF("node2", "size2"), "node2").withColumn("length", F.col("size1") + F.col("size2") - F.col("overlap"))
    half = half_edges(sized.select("edge_id", "node1", "node2", "dir1", "dir2", "length")).where("node <> other")
    longest = half.groupBy("node", "side").agg(F.max("length").alias("longest"))
    first = half.select(F.col("node").alias("a"), F.col("side").alias("a_side"), F.col("other").alias("b"), F.col("other_side").alias("b_in"), F.col("length").alias("l1"))
    second = half.select(F.col("node").alias("b"), (~F.col("side")).alias("b_in"), F.col("other").alias("c"), F.col("other_side").alias("c_side"), F.col("length").alias("l2"))
    paths = first.join(second, ["b", "b_in"]).where("a <> c").join(size.toDF("b", "b_size"), "b").join(longest.toDF("a", "a_side", "longest"), ["a", "a_side"])
    short = paths.where(F.greatest(F.lit(0), F.col("l1") + F.col("l2") - F.col("b_size")) <= F.col("longest") + fuzz).select("a", "a_side", "c", "c_side").distinct()
    direct = half.select("edge_id", F.col("node").alias("a"), F.col("side").alias("a_side"), F.col("other").alias("c"), F.col("other_side").alias("c_side"))
    return direct.join(short, ["a", "a_side", "c", "c_side"], "left_semi").select("edge_id").distinct()


def unique_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, unique_length): length less the largest overlap with another node on each side, at least 0.

    The larger of both sides' largest overlaps is taken off.
    """
    most = half_edges(edges).where("node <> other").groupBy("node").agg(F.max("overlap").alias("most"))
    return nodes.join(most, "node", "left").select("node", F.greatest(F.lit(0), F.col("length") - F.coalesce("most", F.lit(0))).alias("unique_length"))


def tips(nodes: DataFrame, edges: DataFrame, length: int, reads: int, label: DataFrame | None = None) -> DataFrame:
    """(node): dead ends that are short or of few reads, against both the limits and a tenth of their component.

    ``nodes`` has node, length, reads, unique_length; ``label`` the components, if known.
    """
    placed = nodes.join(components(edges) if label is None else label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("component").agg(F.sum("length").alias("all_length"), F.sum("reads").alias("all_reads"))
    ends = placed.join(degrees(edges), "node", "left").na.fill(0, ["in_degree", "out_degree"]).where("in_degree = 0 OR out_degree = 0").join(sizes, "component")
    tenth = lambda limit, total: F.least(F.lit(limit), F.floor(F.col(total) / 10))
    return ends.where((F.col("unique_length") <= tenth(length, "all_length")) | (F.col("reads") <= tenth(reads, "all_reads"))).select("node")


def z_edges(edges: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(edge_id): middle edges of a Z: both ends branch in two, and both side edges beat it.

    A side edge beats the middle one if its overlap (times ``threshold``) is
    larger, its differing markers are no more and its shared minimizers are more.
    The far end of one side edge has no other edge on its side.
    """
    half = half_edges(edges.select("edge_id", "node1", "node2", "dir1", "dir2", "overlap", "diff_snpmers", "shared_minimizers"))
    sides = half.groupBy("node", "side").agg(F.count("*").alias("degree"))
    at = half.join(sides, ["node", "side"])
    far = sides.toDF("other", "other_side", "other_degree")
    at = at.join(far, ["other", "other_side"])
    middle = at.where("degree = 2 AND other_degree = 2")
    near_side = at.select("node", "side", F.col("edge_id").alias("s1"), F.col("overlap").alias("o1"), F.col("diff_snpmers").alias("d1"), F.col("shared_minimizers").alias("m1"), F.col("other_degree").alias("deg1"))
    far_side = half.select(F.col("node").alias("other"), F.col("side").alias("other_side"), F.col("edge_id").alias("s2"), F.col("overlap").alias("o2"), F.col("diff_snpmers").alias("d2"), F.col("shared_minimizers").alias("m2"))
    z = middle.join(near_side, ["node", "side"]).where("s1 <> edge_id AND deg1 = 1").join(far_side, ["other", "other_side"]).where("s2 <> edge_id AND s1 <> s2")
    beats = lambda o, d, m: (F.col(o) * threshold > F.col("overlap")) & (F.col(d) <= F.col("diff_snpmers")) & (F.col(m) > F.col("shared_minimizers"))
    return z.where(beats("o1", "d1", "m1") & beats("o2", "d2", "m2")).select("edge_id").distinct()


def dominated_edges(edges: DataFrame) -> DataFrame:
    """(edge_id, ratio): imperfect edges that a perfect one on the same side of either node beats in identity, overlap, shared markers and minimizers; ratio is the overlaps' quotient."""
    half = half_edges(edges.select("edge_id", "node1", "node2", "dir1", "dir2", "overlap", "diff_snpmers", "shared_snpmers", "shared_minimizers"))
    good = half.where("diff_snpmers = 0").select("node", "side", F.col("edge_id").alias("g"), F.col("overlap").alias("go"), F.col("shared_snpmers").alias("gs"), F.col("shared_minimizers").alias("gm"))
    beaten = half.where("diff_snpmers > 0").join(good, ["node", "side"]).where("g <> edge_id AND go > overlap AND gs > shared_snpmers AND gm > shared_minimizers")
    return beaten.groupBy("edge_id").agg(F.min(F.col("overlap") / F.col("go")).alias("ratio"))


def simple_links(edges: DataFrame) -> DataFrame:
    """Edges that alone join their two sides: the steps of non-branching paths.  Loops do not count."""
    sides = half_edges(edges).groupBy("node", "side").agg(F.count("*").alias("degree")).where("degree = 1").drop("degree")
    one, two = sides.toDF("node1", "dir1"), sides.toDF("node2", "dir2")
    return edges.where("node1 <> node2").join(one, ["node1", "dir1"], "left_semi").join(two, ["node2", "dir2"], "left_semi").select(*edges.columns)


def unitigs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(unitig, node, at, forward, circular): nodes ordered along maximal non-branching paths.

    Paths are the components of ``simple_links``; each is walked in a grouped
    map from its smallest end, or from its smallest node if it is a circle.
    Nodes without such links are paths of their own.
    """
    links = stored(simple_links(edges).select("node1", "node2", "dir1", "dir2"), "links")
    label = components(links)
    placed = links.join(label.withColumnRenamed("node", "node1"), "node1")
    kind = dict(nodes.dtypes)["node"]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, da, db in rows[["node1", "node2", "dir1", "dir2"]].itertuples(index=False):
            near[(a, bool(da))] = (b, bool(db))
            near[(b, bool(db))] = (a, bool(da))
        names = sorted({n for n, _ in near})
        ends = [n for n in names if ((n, True) in near) != ((n, False) in near)]
        circular = not ends
        node = ends[0] if ends else names[0]
        forward = (node, True) in near
        out, seen = [], set()
        while node not in seen:
            seen.add(node)
            out.append((names[0], node, len(out), forward, circular))
            if (node, forward) not in near:
                break
            node, entered = near[(node, forward)]
            forward = not entered
        return pd.DataFrame(out, columns=["unitig", "node", "at", "forward", "circular"])

    paths = placed.groupBy("component").applyInPandas(walk, f"unitig {kind}, node {kind}, at int, forward boolean, circular boolean")
    alone = nodes.select("node").join(label.select("node"), "node", "left_anti").select(F.col("node").alias("unitig"), "node", F.lit(0).alias("at"), F.lit(True).alias("forward"), F.lit(False).alias("circular"))
    return paths.union(alone)


def passes_abundance(reads: str = "reads", singleton: float = 3.0, secondary: float = 1.0, absolute: float | None = None):
    """Contigs to keep: not single reads of low depth, not two reads of depth 1 unless circular, not under an absolute depth."""
    low = F.when(F.col(reads) == 1, (F.col("dp1") <= singleton) | (F.col("dp3") <= singleton)).when((F.col(reads) <= 2) & ~F.col("circular"), F.col("dp1") <= secondary).otherwise(False)
    return ~low if absolute is None else ~low & (F.col("dp1") >= absolute)


def coverage_safe(half: DataFrame, limit: float) -> DataFrame:
    """Half-edges (node, side, edge_id, depth, other_depth: depths at the three levels) whose coverage ratio is under ``limit`` times the side's smallest."""
    smallest = F.min("ratio").over(Window.partitionBy("node", "side"))
    rated = half.withColumn("ratio", coverage_ratio_levels(F.col("depth"), F.col("other_depth")))
    return rated.withColumn("_least", smallest).where(F.col("ratio") / F.col("_least") < limit).drop("_least")


def passes_output(reads: Column, links: Column, least_reads: int, least_links: int = 1) -> Column:
    """Whether a contig is written: it has enough reads or enough links to others."""
    return (reads >= least_reads) | (links >= least_links)


def numbered(overlaps: DataFrame) -> DataFrame:
    """Overlaps (read_i, read_j, overlap1_len, overlap2_len, hang1, hang2, ...) with edge_id from 0: longest first, hangs counting against, then by reads.

    Rows are range-sorted and stored; an id is a row's place in its partition plus the rows of the partitions
    before, so no task sees all rows.  Equal rows get ids in any order.
    """
    order = [F.col("hang1") + F.col("hang2") - F.col("overlap1_len") - F.col("overlap2_len"), F.col("read_i"), F.col("read_j")]
    placed = stored(overlaps.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_at") - F.shiftleft("_part", 33)
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("edge_id", F.col("_start") + place).drop("_at", "_part", "_start")
