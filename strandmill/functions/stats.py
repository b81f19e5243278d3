"""Statistics as columns and vectorised UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def binomial_tail_value(n: int, k: int, p: float) -> float:
    """P(X > k) for X binomial(n, p)."""
    if k >= n:
        return 0.0
    if k < 0 or p >= 1:
        return 1.0
    if p <= 0:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, max(0.0, 1.0 - math.fsum(map(math.exp, logs))))


@pandas_udf(DoubleType())
def binomial_tail(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
    """P(X > k); equal arguments are computed once a batch."""
    rows = list(zip(n, k, p))
    known = {r: None if any(x is None or x != x for x in r) else binomial_tail_value(int(r[0]), int(r[1]), float(r[2])) for r in set(rows)}
    return pd.Series([known[r] for r in rows], dtype="float64")


def fisher_value(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p of a 2 x 2 table: tables no likelier than the one seen."""
    row, col, total = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - total), min(row, col)
    x = np.arange(low, high + 1)
    lg = np.array([math.lgamma(i + 1) for i in range(total + 1)])
    logs = lg[row] + lg[total - row] + lg[col] + lg[total - col] - lg[total] - lg[x] - lg[row - x] - lg[col - x] - lg[total - row - col + x]
    p = np.exp(logs)
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


@pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    rows = list(zip(a, b, c, d))
    known = {r: fisher_value(*map(int, r)) for r in set(rows)}
    return pd.Series([known[r] for r in rows], dtype="float64")


def identity_estimate(diff: Column, shared: Column, c: int) -> Column:
    """1 - a / (1 + a) with a = differing markers per sampled base."""
    a = diff / (shared * F.lit(float(c)))
    return 1.0 - a / (1.0 + a)


def same_strain(shared_minimizers: Column, diff: Column, shared: Column, c: int, threshold_pct: float, error: float) -> Column:
    """Identity at the threshold, or differences no more than errors would explain."""
    by_identity = identity_estimate(diff, shared_minimizers, c) * 100.0 >= threshold_pct
    if error <= 0:
        return by_identity
    return by_identity | (binomial_tail(diff + shared, diff, F.lit(error)) > 0.05)


#: Differences must stay under 2, or under one for every 200 shared markers if that is more; the tolerated
#: divergence is 0.00005 and 0.0025 more for every 200 shared markers, the latter up to 0.005 (fixed values).
SPARED_LEAST, SPARED_EVERY, SPARED_BASE, SPARED_SLOPE, SPARED_MOST = 2, 200, 0.00005, 0.0025, 0.005


def rescued(diff: Column, shared: Column, shared_minimizers: Column, c: int) -> Column:
    """Whether an edge is spared by a cut: fewer marker differences than its shared markers allow, and identity above what they tolerate."""
    slack = SPARED_BASE + F.least(shared / SPARED_EVERY * SPARED_SLOPE, F.lit(SPARED_MOST))
    few = diff < F.greatest(F.floor(shared / SPARED_EVERY), F.lit(SPARED_LEAST))
    return few & (identity_estimate(diff, shared_minimizers, c) > 1.0 - slack)


def passes_quality(estimate: Column, least: float = 90.0, inclusive: bool = False) -> Column:
    """Whether a read's estimated identity in percent passes: above ``least`` to be indexed, at least it to be asked; reads without one pass."""
    enough = estimate >= least if inclusive else estimate > least
    return estimate.isNull() | enough


def coverage_ratio(a: Column, b: Column, pseudocount: float = 3.0) -> Column:
    return (F.greatest(a, b) + pseudocount) / (F.least(a, b) + pseudocount)


def coverage_ratio_levels(a: Column, b: Column) -> Column:
    """Mean ratio over the three identity levels of two arrays; the weight is applied once to the sum, so that ratios of equal sums tie alike."""
    first, second, third = (coverage_ratio(F.element_at(a, i), F.element_at(b, i)) for i in (1, 2, 3))
    return 0.333 * (first + second + third)


def poisson_kl_root(a: Column, b: Column) -> Column:
    """Square root of the Poisson Kullback-Leibler divergence of rates a and b."""
    return F.sqrt(F.greatest(F.lit(0.0), a * F.log(a / b) + b - a))


def weighted_quantile(df: DataFrame, group: list[str], value: str, weight: str, q: float, name: str = "quantile") -> DataFrame:
    """First value, in ascending order, whose cumulative weight reaches q of the total.

    Equal values are summed first, so the window sees one row for each distinct value of a group.
    """
    summed = df.groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    up = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = summed.withColumn("_run", F.sum("_w").over(up)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*group)))
    return ranked.where(F.col("_run") >= q * F.col("_all")).groupBy(*group).agg(F.min(value).alias(name))


def weighted_quantile_levels(df: DataFrame, group: list[str], values: str, weight: str, q: float, name: str = "quantile") -> DataFrame:
    """The weighted quantile of every position of an array column, as an array."""
    each = df.select(*group, F.posexplode(values).alias("_level", "_value"), F.col(weight).alias("_weight"))
    found = weighted_quantile(each, [*group, "_level"], "_value", "_weight", q, "_q")
    ordered = F.array_sort(F.collect_list(F.struct("_level", "_q")))
    return found.groupBy(*group).agg(F.transform(ordered, lambda x: x["_q"]).alias(name))


def nx(df: DataFrame, group: list[str], length: str, fractions: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Largest length with at least a fraction of all bases in sequences as long; equal lengths are summed first."""
    summed = df.groupBy(*group, length).agg(F.sum(length).alias("_w"))
    down = Window.partitionBy(*group).orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = summed.withColumn("_run", F.sum("_w").over(down)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*group)))
    return ranked.groupBy(*group).agg(*[F.max(F.when(F.col("_run") >= f * F.col("_all"), F.col(length))).alias(f"n{round(f * 100)}") for f in fractions])


def bootstrap_interval(values: list[float], rounds: int = 100, seed: int = 7) -> tuple[float, float] | None:
    """5th and 95th percentile of resampled means; None under ten values."""
    if len(values) < 10:
        return None
    rng = np.random.default_rng(seed)
    data = np.asarray(values, float)
    means = np.sort(data[rng.integers(0, len(data), (rounds, len(data)))].mean(axis=1))
    return float(means[int(0.05 * rounds)]), float(means[int(0.95 * rounds) - 1])


def log_depth_distance(a: list[tuple[list[float], int]], b: list[tuple[list[float], int]], pseudocount: float = 3.0, least_depth: float = 5.0) -> float | None:
    """Distance of two weighted depth samples, each (depths at the three identity levels, weight).

    At every level: the gap of the log medians plus how much the gaps of the
    upper and lower quartiles differ; three times the smallest level counts.
    Levels after the first at which both medians are under ``least_depth`` are
    left out.  None if a sample is empty.
    """
    if not a or not b:
        return None

    def quartiles(sample: list[tuple[list[float], int]], level: int) -> list[float]:
        rows = sorted((d[level], w) for d, w in sample)
        total, run, out = sum(w for _, w in rows), 0, []
        for depth, w in rows:
            run += w
            while len(out) < 3 and run >= (len(out) + 1) * 0.25 * total:
                out.append(math.log(depth + pseudocount))
        return out

    low = math.log(least_depth + pseudocount)
    gaps = []
    for level in range(3):
        x, y = quartiles(a, level), quartiles(b, level)
        if level == 0 or x[1] >= low or y[1] >= low:
            upper, lower = (math.log((x[q] + pseudocount) / (y[q] + pseudocount)) for q in (2, 0))
            gaps.append(abs(x[1] - y[1]) + abs(upper - lower))
    return 3.0 * min(gaps)


def block_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, mid, most, spread): count, median, largest and interquartile range of each group."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*group).agg(F.count("*").alias("n"), q(0.5).alias("mid"), F.max(value).alias("most"), (q(0.75) - q(0.25)).alias("spread"))


def pooled(value: str, along: Window, width: int = 5) -> Column:
    """The least value among the ``width`` rows around a row in the order of ``along``."""
    return F.min(value).over(along.rowsBetween(-(width // 2), width // 2))
