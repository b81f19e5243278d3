"""Seed joins: inverted index, probe, candidates, containment, allele sites, marker screens.

All are equi-joins on packed k-mers.  Keys so frequent that they carry no
information are dropped by the index's own threshold, which is part of the
operator; what is left of the skew is for adaptive execution to split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiplicity_cut(counts: DataFrame, share: int = 100_000, least_keys: int = 500_000) -> DataFrame:
    """One row (cut): keys with at least ``cut`` entries are dropped; null if there are too few keys for a cut.

    The cut is the (n / share)-th largest multiplicity, from the histogram of multiplicities.
    """
    histogram = counts.groupBy(F.col("many").alias("value")).agg(F.count("*").alias("keys"))
    n = histogram.agg(F.sum("keys").alias("n"))
    down = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("run", F.sum("keys").over(down)).join(F.broadcast(n))
    cut = F.max(F.when(F.col("run") > F.floor(F.col("n") / share), F.col("value")))
    return ranked.agg(F.when(F.max("n") > least_keys, cut).alias("cut"))


def seed_index(seeds: DataFrame, share: int = 100_000, least_keys: int = 500_000) -> DataFrame:
    """Seeds (id, pos, kmer, forward) without over-frequent keys, with each key's multiplicity ``many``."""
    counts = seeds.groupBy("kmer").agg(F.count("*").alias("many"))
    cut = multiplicity_cut(counts, share, least_keys)
    kept = counts.join(F.broadcast(cut)).where("cut IS NULL OR many < cut").drop("cut")
    return seeds.join(kept, "kmer")


def anchors(query: DataFrame, index: DataFrame, pair: Column | None = None) -> DataFrame:
    """(query, ref, pos1, pos2, same_strand, many): shared seeds of different sequences; ``pair`` restricts which."""
    q = query.select(F.col("id").alias("query"), F.col("pos").alias("pos1"), F.col("forward").alias("f1"), "kmer")
    r = index.select(F.col("id").alias("ref"), F.col("pos").alias("pos2"), F.col("forward").alias("f2"), "kmer", "many")
    wanted = F.col("query") > F.col("ref") if pair is None else pair
    return q.join(r, "kmer").where(wanted).select("query", "ref", "pos1", "pos2", (F.col("f1") == F.col("f2")).alias("same_strand"), "many")


def candidates(query: DataFrame, index: DataFrame, lengths: DataFrame, slack: int, most: int = 500) -> DataFrame:
    """(query, ref, shared, first, last, rank): longer references that share seeds over nine tenths of the query.

    ``most`` references with the largest span times count are kept, ties by reference id.
    """
    hits = query.select(F.col("id").alias("query"), "pos", "kmer").join(index.select(F.col("id").alias("ref"), "kmer").distinct(), "kmer").where("query <> ref")
    spans = hits.groupBy("query", "ref").agg(F.count("*").alias("shared"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    spans = spans.join(lengths.toDF("query", "query_len"), "query").join(lengths.toDF("ref", "ref_len"), "ref")
    span = F.col("last") - F.col("first")
    fit = spans.where((F.col("ref_len") > F.col("query_len")) & (span + slack > 0.9 * F.col("query_len")))
    order = Window.partitionBy("query").orderBy(F.desc(span * F.col("shared")), "ref")
    return fit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def outer_reads(reads: DataFrame, contained: DataFrame) -> DataFrame:
    """Reads that are contained in no other."""
    return reads.join(contained.select(F.col("query").alias("id")).distinct(), "id", "left_anti")


def shared_sites(query: DataFrame, ref: DataFrame) -> DataFrame:
    """(query, ref, shared, differing): allele sites (id, split, mid) in common, and those with another allele."""
    joined = query.select(F.col("id").alias("query"), "split", F.col("mid").alias("a")).join(ref.select(F.col("id").alias("ref"), "split", F.col("mid").alias("b")), "split").where("query > ref")
    return joined.groupBy("query", "ref").agg(F.count_if(F.col("a") == F.col("b")).alias("shared"), F.count_if(F.col("a") != F.col("b")).alias("differing"))


#: Members of one class of equal sketches that meet all others of it in one task.
CLASS_TILE = 1000


def sketch_classes(markers: DataFrame) -> DataFrame:
    """(id, rep, n): every id with the smallest id that has the same markers, and how many they are."""
    sets = markers.groupBy("id").agg(F.sort_array(F.collect_list("marker")).alias("all"))
    keyed = sets.select("id", F.size("all").cast("long").alias("n"), F.sha2(F.concat_ws(",", F.col("all").cast("array<string>")), 256).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("rep")), "key").select("id", "rep", "n")


def marker_screen(markers: DataFrame, k: int = 21, identity: float = 0.9, most_sketches: int | None = None) -> DataFrame:
    """(ref, query, shared, ref_markers, query_markers) for ref < query: sketch pairs sharing more markers than the identity would leave.

    ``markers`` is (id, marker), distinct.  The cutoff is max(identity^k * smaller sketch, 1).
    No marker is left out.  Ids with equal markers are one class: only classes'
    smallest ids meet on markers, and their pairs are dealt to all members.
    """
    classes = sketch_classes(markers)
    enough = lambda df: df.where(F.col("shared") > F.greatest(F.least("ref_markers", "query_markers") * F.lit(identity**k), F.lit(1.0)))
    heads = classes.where("id = rep").select("id", "n")
    own = markers.join(heads.select("id"), "id", "left_semi")
    left, right = own.toDF("one", "marker"), own.toDF("two", "marker")
    shared = left.join(right, "marker").where("one < two").groupBy("one", "two").agg(F.count("*").alias("shared"))
    sized = enough(shared.join(heads.toDF("one", "ref_markers"), "one").join(heads.toDF("two", "query_markers"), "two"))
    members = classes.select("id", "rep")
    across = sized.join(members.toDF("a", "one"), "one").join(members.toDF("b", "two"), "two")
    turned = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    across = across.select(F.least("a", "b").alias("ref"), F.greatest("a", "b").alias("query"), "shared", pick("ref_markers", "query_markers").alias("ref_markers"), pick("query_markers", "ref_markers").alias("query_markers"))
    tiles = classes.groupBy("rep").agg(F.ceil(F.count("*") / CLASS_TILE).cast("int").alias("tiles"), F.count("*").alias("size")).where("size > 1").drop("size")
    dealt = classes.join(tiles, "rep")
    ref = dealt.select("rep", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"), F.col("id").alias("ref"), "n")
    query = dealt.select("rep", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("id").alias("query"))
    within = ref.join(query, ["rep", "tile"]).where("ref < query").select("ref", "query", F.col("n").alias("shared"), F.col("n").alias("ref_markers"), F.col("n").alias("query_markers"))
    return across.union(enough(within))


def contained(start: Column, end: Column, len1: Column, len2: Column, same: Column, slack: int, c: int) -> Column:
    """Whether read 1 lies within read 2: overlap plus slack over 95 percent of it, same strain, shorter."""
    return (end - start + slack * c > 0.95 * len1) & same & (len1 < len2)


def strain_repeats(members: DataFrame, similar: DataFrame) -> DataFrame:
    """(contig, other): contigs more than half of whose reads have similar reads on another contig.

    ``members`` is (contig, read); ``similar`` is (read, other_read).
    """
    theirs = members.toDF("other", "other_read")
    met = members.join(similar, "read").join(theirs, "other_read").where("contig <> other")
    counts = met.groupBy("contig", "other").agg(F.countDistinct("read").alias("reads"))
    sizes = members.groupBy("contig").agg(F.count("*").alias("size"))
    return counts.join(sizes, "contig").where("reads * 2 > size").select("contig", "other", "reads", "size")


def best_overlaps(overlaps: DataFrame) -> DataFrame:
    """At most two overlaps for each (read_i, read_j): the best of each side, both only if their strands agree.

    ``overlaps`` has forward1, forward2, overlap1_len, overlap2_len, hang1, hang2.  Ties go to the
    larger first overlap, then to the smaller hangs.
    """
    score = F.col("overlap1_len") + F.col("overlap2_len") - F.col("hang1") - F.col("hang2")
    keys = ["read_i", "read_j"]
    best = Window.partitionBy(*keys, "forward1").orderBy(F.desc("score"), F.desc("overlap1_len"), "hang1", "hang2", "forward2")
    sides = overlaps.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    pair = Window.partitionBy(*keys)
    crossed = (F.col("forward1") != F.col("forward2")).cast("int")
    sides = sides.withColumn("agree", F.min(crossed).over(pair) == F.max(crossed).over(pair))
    sides = sides.withColumn("place", F.row_number().over(pair.orderBy(F.desc("score"), F.desc("forward1"))))
    return sides.where("agree OR place = 1").drop("agree", "place")


def informative(seeds: DataFrame, frequent: DataFrame, most: int = 500) -> DataFrame:
    """Seeds (id, kmer, ...) that occur at most ``most`` times in their read and are not among the ``frequent`` (kmer)."""
    own = Window.partitionBy("id", "kmer")
    few = seeds.withColumn("_own", F.count("*").over(own)).where(F.col("_own") <= most).drop("_own")
    return few.join(frequent.select("kmer"), "kmer", "left_anti")


def multiplicities(seeds: DataFrame) -> DataFrame:
    """(id, kmer, n): how often each k-mer occurs in its read."""
    return seeds.groupBy("id", "kmer").agg(F.count("*").alias("n"))


def seed_poor(seeds: Column, bases: Column, c: int) -> Column:
    """Whether a read has under a twentieth of the seeds that one in ``c`` bases would give, rounded down at both steps."""
    return seeds < F.floor(F.floor(bases / c) / 20)


def dovetails(anchors: DataFrame, lengths: DataFrame, reach: int = 350) -> DataFrame:
    """(query, ref, possible): whether some anchor is within ``reach`` of an end of the query, and some within it of an end of the reference."""
    near = lambda pos, size: F.bool_or((F.col(pos) <= reach) | (F.col(pos) >= F.col(size) - reach))
    sized = anchors.join(lengths.toDF("query", "query_len"), "query").join(lengths.toDF("ref", "ref_len"), "ref")
    return sized.groupBy("query", "ref").agg((near("pos1", "query_len") & near("pos2", "ref_len")).alias("possible"))
