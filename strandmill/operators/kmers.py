"""k-mer tables: extraction, two-strand counts, frequency thresholds, allele pairs.

Extraction is a vectorised map over Arrow batches; everything after it is
joins and aggregates on packed longs with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical, middle, masked, open_syncmers, packed_kmers
from ..functions.stats import binomial_tail, fisher_exact

OUT_ROWS = 1 << 17


def _emit(ids: list, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], id_type: pa.DataType) -> pa.RecordBatch:
    sizes = [len(p[1]) for p in parts]
    owner = pa.array(np.repeat(np.arange(len(parts)), sizes))
    names = pa.array([ids[p[0]] for p in parts], id_type).take(owner)
    pos, kmer, forward = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    return pa.RecordBatch.from_arrays([names, pa.array(pos.astype(np.int32)), pa.array(kmer.view(np.int64)), pa.array(forward)], names=["id", "pos", "kmer", "forward"])


def extract(reads: DataFrame, k: int, id_col: str = "id", seq_col: str = "seq", drop_palindromes: bool = True, syncmers: int | None = None) -> DataFrame:
    """(id, pos, kmer, forward): canonical k-mers of every read.

    The strand is chosen with the middle base masked, so both alleles of a
    middle base agree on it; masked palindromes have none and are dropped on
    request.  ``syncmers`` keeps open syncmers of that compression only.
    """
    kind = dict(reads.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, rows = batch.column("id").to_pylist(), [], 0
            for at, seq in enumerate(batch.column("seq")):
                raw = (seq.as_py() or "").encode()
                if len(raw) < k:
                    continue
                kmer, forward, tie = canonical(*packed_kmers(raw, k), k)
                pick = ~tie if drop_palindromes else np.ones(len(kmer), bool)
                if syncmers is not None:
                    chosen = np.zeros(len(kmer), bool)
                    chosen[open_syncmers(raw, k, syncmers)] = True
                    pick &= chosen
                pos = np.flatnonzero(pick)
                parts.append((at, pos, kmer[pick], forward[pick]))
                rows += len(pos)
                if rows >= OUT_ROWS:
                    yield _emit(ids, parts, batch.schema.field("id").type)
                    parts, rows = [], 0
            if parts:
                yield _emit(ids, parts, batch.schema.field("id").type)

    return reads.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq")).mapInArrow(run, f"id {kind}, pos int, kmer long, forward boolean")


def strand_counts(kmers: DataFrame) -> DataFrame:
    """(kmer, n_forward, n_reverse)."""
    return kmers.groupBy("kmer").agg(F.count_if("forward").alias("n_forward"), F.count_if(~F.col("forward")).alias("n_reverse"))


def solid(counts: DataFrame, least: int = 2) -> DataFrame:
    """k-mers seen on both strands and more than ``least`` times."""
    return counts.where(f"n_forward > 0 AND n_reverse > 0 AND n_forward + n_reverse > {least}")


def frequency_threshold(counts: DataFrame, total: Column, share: int = 100_000, floor: int = 100) -> DataFrame:
    """One row (threshold): the count at rank n - n / share - 1 of the ascending counts, at least ``floor``.

    Found on the histogram of counts, which has one row for each distinct count.
    """
    histogram = counts.groupBy(total.alias("value")).agg(F.count("*").alias("many"))
    n = histogram.agg(F.sum("many").alias("n"))
    up = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("run", F.sum("many").over(up)).join(F.broadcast(n))
    rank = F.col("n") - F.floor(F.col("n") / share) - 1
    return ranked.where(F.col("run") > rank).agg(F.greatest(F.min("value"), F.lit(floor)).alias("threshold"))


def allele_pairs(counts: DataFrame, k: int) -> DataFrame:
    """(split, mid1, mid2, strand counts): the two most frequent middle bases of every masked k-mer that has two.

    Alleles are ordered by count, then by base; at most four rows meet in a group.
    """
    rows = counts.select(masked(F.col("kmer"), k).alias("split"), middle(F.col("kmer"), k).alias("mid"), "n_forward", "n_reverse", (F.col("n_forward") + F.col("n_reverse")).alias("n"))
    order = Window.partitionBy("split").orderBy(F.desc("n"), "mid")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    wide = ranked.groupBy("split").agg(*[pick(c, r).alias(f"{c}{r}") for r in (1, 2) for c in ("mid", "n", "n_forward", "n_reverse")])
    return wide.where("mid2 IS NOT NULL")


def snpmers(pairs: DataFrame, error: float = 0.025) -> DataFrame:
    """Allele pairs whose second allele is too frequent for an error and not bound to a strand."""
    tested = pairs.withColumn("p_error", binomial_tail(F.col("n1"), F.col("n2"), F.lit(error))).where("p_error <= 0.05")
    odds = (F.col("n_forward1") * F.col("n_reverse2")) / F.nullif(F.col("n_reverse1") * F.col("n_forward2"), F.lit(0))
    tested = tested.withColumn("p_strand", fisher_exact("n_forward1", "n_reverse1", "n_forward2", "n_reverse2")).withColumn("odds", F.coalesce(odds, F.lit(float("inf"))))
    return tested.where("odds <> 0 AND (p_strand > 0.005 OR (odds > 1 / 1.5 AND odds < 1.5))")


def robust_multiplicity(counts: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of the counts of each group without the lowest and highest tenth (by rank)."""
    order = Window.partitionBy(group).orderBy(value, "kmer")
    ranked = counts.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    return ranked.where("_r >= floor(_n * 0.1) AND _r < _n - floor(_n * 0.1)").groupBy(group).agg(F.avg(value).alias("multiplicity"))
