"""Average nucleotide identity by sketches, and dereplication by it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chaining import chains


def markers(reads: DataFrame, k: int, c: int, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """(id, marker), distinct: hashes of the canonical k-mers whose md5 prefix is under 1 / c of its range.

    Column-native: the hash is the first 15 hexadecimal digits of the md5 of the k-mer string.
    """
    from ..functions.sequence import decode_kmer
    from .kmers import extract

    kmers = extract(reads, k, id_col, seq_col, drop_palindromes=False).select("id", "kmer").distinct()
    digest = F.conv(F.substring(F.md5(decode_kmer(F.col("kmer"), k).cast("binary")), 1, 15), 16, 10).cast("long")
    return kmers.select("id", digest.alias("marker")).where(F.col("marker") < (1 << 60) // c).distinct()


def seed_identity(shared: Column, smaller: Column, k: int) -> Column:
    """Identity at which ``shared`` of ``smaller`` k-mers survive."""
    return F.pow(shared / smaller, F.lit(1.0 / k))


def pair_ani(anchors: DataFrame, seeds: DataFrame, k: int, fragment: int = 20_000, min_fraction: float = 0.15, least_anchors: int = 3) -> DataFrame:
    """(query, ref, ani, af_query, af_ref, std, chains) of pairs from chained seed anchors.

    Anchors are chained, chains overlapping kept ones by more than half are
    left out, the kept ones are cut into fragments, and a fragment's identity is
    (anchors / query seeds under it)^(1/k); identities are averaged by seeds
    between the 10th and 90th percentile.  ``seeds`` is (id, n, length).  Pairs
    that align less than ``min_fraction`` of both have ani -1; pairs with fewer
    than ``least_anchors`` anchors have no row.
    """
    kinds = dict(anchors.dtypes)
    pair = Window.partitionBy("query", "ref")
    enough = anchors.withColumn("_n", F.count("*").over(pair)).where(F.col("_n") >= least_anchors).drop("_n")
    sized = enough.join(seeds.toDF("query", "n1", "len1"), "query").join(seeds.toDF("ref", "n2", "len2"), "ref")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p1, p2 = rows["pos1"].to_numpy(), rows["pos2"].to_numpy()
        n1, len1, len2 = int(rows["n1"].iloc[0]), int(rows["len1"].iloc[0]), int(rows["len2"].iloc[0])
        density = n1 / max(1, len1)
        taken: list[tuple[int, int]] = []
        values, weights, cover1, cover2 = [], [], 0, 0
        for _, c, _ in chains(p1, p2, rows["same_strand"].to_numpy().astype(bool), match=20, band=2500, max_gap=2000, least=least_anchors):
            low, high = int(p1[c].min()), int(p1[c].max()) + k
            if sum(max(0, min(high, b) - max(low, a)) for a, b in taken) > 0.5 * (high - low):
                continue
            taken.append((low, high))
            cover1 += high - low
            cover2 += int(p2[c].max() - p2[c].min()) + k
            for at in range(low, high, fragment):
                end = min(at + fragment, high)
                expected = max(1.0, density * (end - at))
                n = int(((p1[c] >= at) & (p1[c] < end)).sum())
                values.append(min(1.0, n / expected) ** (1 / k))
                weights.append(expected)
        af1, af2 = min(1.0, cover1 / max(1, len1)), min(1.0, cover2 / max(1, len2))
        ani, std = -1.0, 0.0
        if values and (af1 >= min_fraction or af2 >= min_fraction):
            v, w = np.array(values), np.array(weights)
            order = np.argsort(v, kind="stable")
            v, w = v[order], w[order]
            cut = len(v) // 10
            v, w = (v[cut : len(v) - cut], w[cut : len(w) - cut]) if cut else (v, w)
            ani, std = float((v * w).sum() / w.sum()), float(v.std())
        return pd.DataFrame([(rows["query"].iloc[0], rows["ref"].iloc[0], ani, af1, af2, std, len(taken))], columns=["query", "ref", "ani", "af_query", "af_ref", "std", "chains"])

    schema = f"query {kinds['query']}, ref {kinds['ref']}, ani double, af_query double, af_ref double, std double, chains int"
    return sized.groupBy("query", "ref").applyInPandas(run, schema)


def classify(contigs: DataFrame, pairs: DataFrame, identity: float = 0.99, length: float = 500_000) -> DataFrame:
    """(id, class): primary, alternate or duplicate; duplicate wins.

    ``contigs``: id, length, circular, multiplicity; ``pairs``: ref, query, ani, af_ref, af_query.
    Pairs of two contigs over 500 kb say nothing.  Ties of length go to the smaller id.
    """
    side = contigs.select("id", "length", "circular", "multiplicity")
    r = side.toDF("ref", "len_r", "circ_r", "mult_r")
    q = side.toDF("query", "len_q", "circ_q", "mult_q")
    p = pairs.join(r, "ref").join(q, "query").where("NOT (len_r > 500000 AND len_q > 500000)")
    query_small = (F.col("len_q") < F.col("len_r")) | ((F.col("len_q") == F.col("len_r")) & (F.col("query") < F.col("ref")))
    pick = lambda cond, a, b: F.when(cond, F.col(a)).otherwise(F.col(b))
    p = p.withColumn("small", pick(query_small, "query", "ref")).withColumn("large", pick(query_small, "ref", "query"))
    p = p.withColumn("small_len", F.least("len_q", "len_r")).withColumn("large_len", F.greatest("len_q", "len_r"))
    p = p.withColumn("large_mult", pick(query_small, "mult_r", "mult_q")).withColumn("small_circ", pick(query_small, "circ_q", "circ_r"))
    either = lambda t: (F.col("af_ref") > t) | (F.col("af_query") > t)
    ratio = F.col("len_q") / F.col("len_r")
    alike = (ratio > 0.66) & (ratio < 1 / 0.66)
    chosen = F.when(alike & F.col("circ_q") & ~F.col("circ_r"), F.col("ref")).when(alike & F.col("circ_r") & ~F.col("circ_q"), F.col("query")).otherwise(F.col("small"))
    chosen_len = F.when(chosen == F.col("query"), F.col("len_q")).otherwise(F.col("len_r"))
    repeated = either(0.9) & (F.col("ani") > 0.98) & (F.col("large_mult") > 1.25) & (F.col("large_len") < 1_000_000)
    equal = either(0.99) & (F.col("ani") > 0.999)
    near = either(0.90) & (F.col("ani") > identity)
    both = (F.col("af_ref") > 0.90) & (F.col("af_query") > 0.90)
    verdict = (
        F.when(repeated, F.struct(F.col("large").alias("id"), F.lit("duplicate").alias("class")))
        .when(equal & (chosen_len < 150_000), F.struct(chosen.alias("id"), F.lit("duplicate").alias("class")))
        .when(equal, F.lit(None))
        .when(near & (((F.col("small_len") < length) & ~F.col("small_circ")) | (both & (F.col("small_len") < 100_000))), F.struct(F.col("small").alias("id"), F.lit("alternate").alias("class")))
    )
    found = p.select(verdict.alias("v")).where("v IS NOT NULL").select("v.*").groupBy("id").agg(F.max("class").alias("class"))
    return contigs.select("id").join(found, "id", "left").select("id", F.coalesce("class", F.lit("primary")).alias("class"))


def triangle_rows(pairs: DataFrame, value: str = "ani") -> DataFrame:
    """(ref, line): one line for each reference of a lower triangular matrix, from (ref, query, value)."""
    cells = pairs.select("ref", F.struct("query", F.col(value).alias("value")).alias("cell"))
    rows = cells.groupBy("ref").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return rows.select("ref", F.concat_ws("\t", F.col("ref").cast("string"), F.array_join(F.transform("cells", lambda c: F.format_string("%.4f", c["value"])), "\t")).alias("line"))


def best_hits(pairs: DataFrame, n: int) -> DataFrame:
    """The n references of highest identity for each query."""
    order = Window.partitionBy("query").orderBy(F.desc("ani"), "ref")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def swaps_roles(median_ref: Column, median_query: Column, seeds_ref: Column, seeds_query: Column, name_ref: Column, name_query: Column) -> Column:
    """Whether query and reference change places: the side of more seeds x median contig length (300 kb at most) is the reference, ties by name."""
    weigh = lambda seeds, median: seeds * F.least(median, F.lit(300_000.0))
    ref, query = weigh(seeds_ref, median_ref), weigh(seeds_query, median_query)
    return (query > ref) | ((query == ref) & (name_query > name_ref))
