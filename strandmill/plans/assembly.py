"""From reads to contigs: seeds, overlaps, graph, paths, drafts, polishing.

Every step is a table; sequential folds (laying reads along a path, consensus of
a window) are grouped maps over one path or window.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as T
from ..functions.sequence import masked, middle, phred_identity
from ..operators import chaining as C
from ..operators import cleaning as L
from ..operators.tables import stored
from ..operators import consensus as P
from ..operators import graph as G
from ..operators import kmers as K
from ..operators import seeding as J
from ..sources.fastx import phred, read_fastx
from ..sources.sinks import resume
from .config import Config

COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def allele_sites(reads: DataFrame, config: Config) -> DataFrame:
    """(split, mid1, mid2, ...): marker sites of the reads."""
    return K.snpmers(K.allele_pairs(K.solid(K.strand_counts(K.extract(reads, config.k))), config.k), config.lax_error)


def overlap_chains(reads: DataFrame, config: Config) -> DataFrame:
    """Chains of every pair of reads that share seeds, with both lengths."""
    seeds = K.extract(reads, config.k, drop_palindromes=False, syncmers=config.c)
    index = J.seed_index(seeds, config.high_frequency_share)
    found = C.chain_pairs(J.anchors(seeds, index), match=config.c, least_score=config.min_chain_score, max_gap=config.chain_gap, double_gap=config.chain_double_gap)
    found = found.withColumn("end1", F.col("end1") + config.k).withColumn("end2", F.col("end2") + config.k)
    size = reads.select("id", F.length("seq").alias("n"))
    return found.join(size.toDF("query", "len1"), "query").join(size.toDF("ref", "len2"), "ref")


def read_alleles(reads: DataFrame, sites: DataFrame, config: Config) -> DataFrame:
    """(id, pos, split, mid): where each read carries one of the two alleles of a marker site."""
    kmers = K.extract(reads, config.k).select("id", "pos", masked(F.col("kmer"), config.k).alias("split"), middle(F.col("kmer"), config.k).alias("mid"))
    return kmers.join(sites.select("split", "mid1", "mid2"), "split").where("mid IN (mid1, mid2)").select("id", "pos", "split", "mid")


def compared(chains: DataFrame, alleles: DataFrame) -> DataFrame:
    """``chains`` with how many marker sites both reads carry within the chain's span, with the same and with another allele."""
    key = ["query", "ref", "chain"]
    span = chains.select(*key, "start1", "end1", "start2", "end2")
    one = alleles.select(F.col("id").alias("query"), F.col("pos").alias("p1"), "split", F.col("mid").alias("a"))
    two = alleles.select(F.col("id").alias("ref"), F.col("pos").alias("p2"), "split", F.col("mid").alias("b"))
    met = span.join(one, "query").where("p1 BETWEEN start1 AND end1").join(two, ["ref", "split"]).where("p2 BETWEEN start2 AND end2")
    counts = met.groupBy(*key).agg(F.count_if(F.col("a") == F.col("b")).alias("shared_snpmers"), F.count_if(F.col("a") != F.col("b")).alias("diff_snpmers"))
    return chains.join(counts, key, "left").na.fill(0, ["shared_snpmers", "diff_snpmers"])


def strain_test(chains: DataFrame, config: Config, strict: bool) -> Column:
    """Whether both reads of a chain are of one strain; true where markers were not compared."""
    if "diff_snpmers" not in chains.columns:
        return F.lit(True)
    percent, error = (config.strict_identity_pct, config.strict_error) if strict else (config.lax_identity_pct, config.lax_error)
    return T.same_strain(F.col("anchors"), F.col("diff_snpmers"), F.col("shared_snpmers"), config.c, percent, error)


def contained_reads(chains: DataFrame, config: Config) -> DataFrame:
    """(id): reads that lie within a longer one of their strain; of two equally long ones with the same ends the larger id goes."""
    slack, ends = config.slack * config.c, 4 * config.c
    chains = chains.where(strain_test(chains, config, strict=True))
    span1, span2 = F.col("end1") - F.col("start1"), F.col("end2") - F.col("start2")
    tie = (F.col("len1") == F.col("len2")) & (F.least(span1, span2) + ends >= F.col("len1"))
    one = chains.where(((span1 + slack > 0.95 * F.col("len1")) & (F.col("len1") < F.col("len2"))) | (tie & (F.col("query") > F.col("ref"))))
    two = chains.where(((span2 + slack > 0.95 * F.col("len2")) & (F.col("len2") < F.col("len1"))) | (tie & (F.col("ref") > F.col("query"))))
    return one.select(F.col("query").alias("id")).union(two.select(F.col("ref").alias("id"))).distinct()


def overlap_edges(chains: DataFrame, contained: DataFrame, config: Config) -> DataFrame:
    """Bidirected dovetail edges of the reads that remain."""
    gone = contained.select("id")
    kept = chains.join(gone.withColumnRenamed("id", "query"), "query", "left_anti").join(gone.withColumnRenamed("id", "ref"), "ref", "left_anti")
    kept = kept.where(strain_test(kept, config, strict=False))
    if "diff_snpmers" not in kept.columns:
        kept = kept.withColumn("diff_snpmers", F.lit(0).cast("long")).withColumn("shared_snpmers", F.lit(0).cast("long"))
    dove = C.dovetails(kept, F.lit(config.hang_limit), config.min_overlap, single=True)
    best = J.best_overlaps(dove.withColumnRenamed("query", "read_i").withColumnRenamed("ref", "read_j"))
    edges = best.select(
        F.monotonically_increasing_id().alias("edge_id"), F.col("read_i").alias("node1"), F.col("read_j").alias("node2"), F.col("forward1").alias("dir1"), (~F.col("forward2")).alias("dir2"),
        F.greatest("overlap1_len", "overlap2_len").alias("overlap"), F.col("anchors").alias("shared_minimizers"), "diff_snpmers", "shared_snpmers", "hang1", "hang2", "overlap1_len", "overlap2_len",
    )
    return stored(edges, "edges")


def without_other_strains(edges: DataFrame) -> DataFrame:
    """Edges without those that differ in some marker and share a side with one that differs in none and shares some."""
    half = G.half_edges(edges.select("edge_id", "node1", "node2", "dir1", "dir2", "diff_snpmers", "shared_snpmers"))
    clean = half.where("diff_snpmers = 0 AND shared_snpmers > 0").select("node", "side").distinct()
    beaten = half.where("diff_snpmers > 0").join(clean, ["node", "side"], "left_semi").select("edge_id").distinct()
    return edges.join(beaten, "edge_id", "left_anti")


def contig_graph(paths: DataFrame, edges: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of paths: (nodes: node, length, reads, depths), and the read edges between their ends.

    ``reads`` is (node, size, mass), mass being the bases of a read and of those contained in it.
    """
    last = Window.partitionBy("unitig")
    placed = paths.withColumn("end", F.max("at").over(last))
    free = F.array(F.when(F.col("at") == 0, F.struct((~F.col("forward")).alias("dir"), F.lit(False).alias("side"))), F.when(F.col("at") == F.col("end"), F.struct(F.col("forward").alias("dir"), F.lit(True).alias("side"))))
    ends = placed.where("NOT circular").withColumn("s", F.explode(F.array_compact(free))).select("node", "s.dir", "s.side", "unitig")
    one, two = ends.toDF("node1", "dir1", "side1", "unitig1"), ends.toDF("node2", "dir2", "side2", "unitig2")
    between = edges.join(one, ["node1", "dir1"]).join(two, ["node2", "dir2"])
    inner = edges.join(between.select("edge_id"), "edge_id", "left_anti").join(paths.select(F.col("node").alias("node1"), "unitig"), "node1").groupBy("unitig").agg(F.sum("overlap").alias("joined"))
    nodes = paths.join(reads, "node").groupBy("unitig").agg(F.sum("size").alias("size"), F.sum("mass").alias("mass"), F.count("*").alias("reads")).join(inner, "unitig", "left")
    length = F.greatest(F.lit(1), F.col("size") - F.coalesce("joined", F.lit(0)))
    depth = (F.col("mass") / length).cast("double")
    nodes = nodes.select(F.col("unitig").alias("node"), length.alias("length"), "reads", F.array(depth, depth, depth).alias("depths"))
    links = between.select("edge_id", F.col("unitig1").alias("node1"), F.col("unitig2").alias("node2"), F.col("side1").alias("dir1"), F.col("side2").alias("dir2"), "overlap", "diff_snpmers", "shared_minimizers")
    return nodes, links


def cleaned_paths(reads: DataFrame, edges: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(paths, edges) when tips, bubbles and the middles of Z shapes are gone.

    Each round takes paths from the read graph, finds what to remove on the
    graph of those paths, and takes its reads and edges out of the read graph;
    it ends when nothing is found, and every round before removes something.
    """
    while True:
        paths = stored(G.unitigs(reads.select("node"), edges), "paths")
        nodes, links = contig_graph(paths, edges, reads)
        nodes, links = stored(nodes, "contigs"), stored(links, "links")
        cut = G.z_edges(links).select("edge_id")
        sized = nodes.join(G.unique_lengths(nodes, links), "node")
        linked = G.half_edges(links).select("node").distinct()
        gone = G.tips(sized, links, config.tip_length, config.tip_reads).join(linked, "node", "left_semi")
        found = stored(L.bubbles(sized, links, config.small_bubble), "bubbles")
        gone = gone.union(found.where("kind = 'node'").select(F.col("removed").alias("node"))).distinct()
        cut = stored(cut.union(found.where("kind = 'edge'").select(F.col("removed").alias("edge_id"))).distinct(), "cut")
        lost = stored(paths.join(gone.withColumnRenamed("node", "unitig"), "unitig", "left_semi").select("node"), "lost")
        if not cut.limit(1).count() and not lost.limit(1).count():
            return paths, edges
        reads, edges = L.without(reads, edges.join(cut, "edge_id", "left_anti"), lost)
        reads, edges = stored(reads, "reads"), stored(edges, "edges")


def read_masses(reads: DataFrame, chains: DataFrame, contained: DataFrame) -> DataFrame:
    """(node, size, mass) of the reads that are contained in none; a contained read adds its bases to the one it chains to best."""
    size = reads.select(F.col("id").alias("node"), F.length("seq").alias("size"))
    inner = contained.select("id")
    pairs = chains.select(F.col("query").alias("id"), F.col("ref").alias("node"), "score").union(chains.select("ref", "query", "score"))
    pairs = pairs.join(inner, "id", "left_semi").join(inner.withColumnRenamed("id", "node"), "node", "left_anti")
    best = pairs.groupBy("id").agg(F.max_by("node", F.struct("score", "node")).alias("node"))
    added = best.join(size.toDF("id", "own"), "id").groupBy("node").agg(F.sum("own").alias("added"))
    return size.join(inner.withColumnRenamed("id", "node"), "node", "left_anti").join(added, "node", "left").select("node", "size", (F.col("size") + F.coalesce("added", F.lit(0))).alias("mass"))


def draft(paths: DataFrame, edges: DataFrame, reads: DataFrame) -> DataFrame:
    """(unitig, seq, circular, reads): reads laid along each path, each adding what its overlap leaves."""
    half = G.half_edges(edges).where("node <> other")
    mine = F.when(F.col("node") == F.col("node1"), F.struct(F.col("hang1").alias("h"), F.col("overlap1_len").alias("o"), F.col("hang2").alias("g"), F.col("overlap2_len").alias("p"))).otherwise(F.struct(F.col("hang2").alias("h"), F.col("overlap2_len").alias("o"), F.col("hang1").alias("g"), F.col("overlap1_len").alias("p")))
    joints = half.select("node", "side", "other", "other_side", mine.alias("m")).select("node", "side", "other", "other_side", "m.*")
    # A read leaves by its end if it lies forward; the next one is entered by its start if it does.
    step = paths.toDF("unitig", "node", "at", "forward", "circular").join(joints.withColumnRenamed("side", "forward"), ["node", "forward"], "left")
    following = paths.select("unitig", F.col("node").alias("other"), F.col("at").alias("next_at"), (~F.col("forward")).alias("other_side"))
    linked = step.join(following, ["unitig", "other", "other_side"], "left").where("other IS NULL OR next_at IS NULL OR next_at = at + 1 OR (circular AND next_at = 0)")
    rows = linked.groupBy("unitig", "node", "at", "forward", "circular").agg(F.max(F.when(F.col("next_at").isNotNull(), F.struct("h", "o", "g", "p"))).alias("m"))
    rows = rows.join(reads.select(F.col("id").alias("node"), "seq"), "node").select("unitig", "node", "at", "forward", "circular", "m.*", "seq")
    kind = dict(paths.dtypes)["unitig"]

    def lay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at", ignore_index=True)
        circular, out, enter = bool(part["circular"].iloc[0]), [], 0
        for i, r in part.iterrows():
            seq = r["seq"] if r["forward"] else r["seq"].translate(COMPLEMENT)[::-1]
            last = i == len(part) - 1
            joined = pd.notna(r["h"]) and (not last or circular)
            out.append(seq[enter : len(seq) - int(r["h"])] if joined else seq[enter:])
            enter = int(r["g"] + r["p"]) if joined else 0
        seq = "".join(out)
        if circular and enter:
            seq = seq[enter:]
        return pd.DataFrame([(part["unitig"].iloc[0], seq, circular, len(part))], columns=["unitig", "seq", "circular", "reads"])

    return rows.groupBy("unitig").applyInPandas(lay, f"unitig {kind}, seq string, circular boolean, reads int")


def polish(contigs: DataFrame, reads: DataFrame, config: Config) -> DataFrame:
    """(contig, seq, windows): window consensus of the reads that chain to each draft."""
    drafts = contigs.select(F.concat(F.lit("contig:"), F.col("unitig").cast("string")).alias("id"), "seq")
    seeds = K.extract(reads.select(F.col("id").cast("string").alias("id"), "seq"), config.k, drop_palindromes=False, syncmers=config.c)
    index = J.seed_index(K.extract(drafts, config.k, drop_palindromes=False, syncmers=config.c))
    hits = J.anchors(seeds, index, pair=F.lit(True))
    both = hits.join(reads.select(F.col("id").cast("string").alias("query"), F.col("seq").alias("read")), "query").join(drafts.select(F.col("id").alias("ref"), F.length("seq").alias("n")), "ref")
    width, overlap, k = config.window, config.window_overlap, config.k

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        p1, p2, same = rows["pos1"].to_numpy(), rows["pos2"].to_numpy(), rows["same_strand"].to_numpy().astype(bool)
        read, n = rows["read"].iloc[0], int(rows["n"].iloc[0])
        out = []
        for score, c, reverse in C.chains(p1, p2, same, match=config.c, band=100)[:1]:
            seq = read.translate(COMPLEMENT)[::-1] if reverse else read
            at = sorted((int(p2[i]), len(read) - k - int(p1[i]) if reverse else int(p1[i])) for i in c)
            begin = 0
            for w, end in enumerate(P.breakpoints(n, width)):
                reach = min(end + overlap, n)
                left = [a for a in at if a[0] <= begin]
                right = [a for a in at if a[0] >= reach - k]
                start = left[-1][1] + begin - left[-1][0] if left else (0 if at[0][0] - at[0][1] >= begin - 5 and at[0][0] < reach else None)
                stop = right[0][1] + reach - right[0][0] if right else None
                if stop is None and end == n:
                    stop = min(len(seq), at[-1][1] + reach - at[-1][0])
                if left and start is not None and stop is not None and stop - start > 0.5 * (reach - begin):
                    out.append((rows["ref"].iloc[0], w, seq[max(0, start) : stop], float(score)))
                elif begin == 0 and stop is not None and at[0][0] < 2 * k:
                    out.append((rows["ref"].iloc[0], w, seq[max(0, at[0][1] - at[0][0]) : stop], float(score)))
                begin = end
        return pd.DataFrame(out, columns=["contig", "window", "seq", "quality"])

    windows = both.groupBy("ref", "query").applyInPandas(cut, "contig string, window int, seq string, quality double")
    return P.polish(windows, overlap)


def assemble(reads: DataFrame, config: Config = Config()) -> DataFrame:
    """(unitig, seq, circular, reads): draft contigs of reads (id, seq, maybe qual) of at least the minimum length and quality."""
    wanted = reads.where(F.length("seq") >= config.min_read_length)
    if "qual" in reads.columns:
        identity = phred_identity(phred(F.col("qual")))
        wanted = wanted.where(F.col("qual").isNull() | identity.isNull() | (identity >= config.quality_cutoff))
    long = stored(wanted.select("id", F.upper("seq").alias("seq")), "reads")
    chains = stored(overlap_chains(long, config), "chains")
    if config.use_snpmers:
        alleles = stored(read_alleles(long, allele_sites(long, config), config), "alleles")
        chains = stored(compared(chains, alleles), "compared")
    contained = stored(contained_reads(chains, config), "contained")
    edges = G.prune_low_minimizer(overlap_edges(chains, contained, config), config.c, config.absolute_cut_ratio, config.relative_cut_ratio)
    edges = stored(without_other_strains(edges), "edges")
    masses = stored(read_masses(long, chains, contained), "masses")
    cut = G.transitive_edges(edges.select("edge_id", "node1", "node2", "dir1", "dir2", "overlap"), masses.select("node", "size"), config.reduction_fuzz)
    edges = stored(edges.join(cut, "edge_id", "left_anti"), "reduced")
    paths, edges = cleaned_paths(masses, edges, config)
    drafts = draft(paths, edges, long.join(contained, "id", "left_anti"))
    # A contig of too few reads stays only if it is linked.
    linked = contig_graph(paths, edges, masses)[1]
    linked = G.half_edges(linked).select(F.col("node").alias("unitig")).distinct()
    few = F.col("reads") < config.min_reads_contig
    return drafts.where(~few).union(drafts.where(few).join(linked, "unitig", "left_semi"))


def run(spark: SparkSession, folder: str, *inputs: str, config: Config = Config()) -> DataFrame:
    """(contig, seq, ...): polished contigs of FASTA and FASTQ files, with drafts and contigs as FASTA under ``folder``.

    Every stage is a table named by the parameters, read again if it is there;
    without ``inputs`` only such tables are used, and a missing one is an error.
    """
    mark = hashlib.sha256(repr((config, sorted(inputs))).encode()).hexdigest()[:16] if inputs else None

    def stage(name: str, make) -> DataFrame:
        path = f"{folder}/{name}"
        if mark is None:
            return spark.read.parquet(f"{path}/last")
        made = resume(spark, path, mark, make)
        made.write.mode("overwrite").parquet(f"{path}/last")
        return made

    reads = stage("reads", lambda: read_fastx(spark, *inputs, least=config.min_read_length).select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("name"), "seq", "qual"))
    drafts = stage("drafts", lambda: assemble(reads, config))
    final = stage("contigs", lambda: polish(drafts, reads.select("id", F.upper("seq").alias("seq")), config))
    if mark is not None:
        write_assembly(drafts, f"{folder}/drafts-{mark}.fa", mode="overwrite")
    return final


def write_assembly(contigs: DataFrame, path: str, least: int = 500, mode: str = "errorifexists") -> None:
    """Draft contigs as FASTA, primary ones first by length."""
    from ..sources.fastx import write_fasta

    header = F.concat(F.lit("u"), F.col("unitig").cast("string"), F.lit("ctg_len-"), F.length("seq").cast("string"), F.when(F.col("circular"), "_circular-yes").otherwise("_circular-no"))
    write_fasta(contigs.where(F.length("seq") >= least), path, header, F.col("seq"), mode=mode)


__all__ = ["allele_sites", "assemble", "cleaned_paths", "compared", "contained_reads", "contig_graph", "draft", "overlap_chains", "overlap_edges", "polish", "read_alleles", "run", "write_assembly"]
