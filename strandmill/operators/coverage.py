"""Coverage by identity level, adaptive thresholds, read splitting, poor regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import block_depths, breakpoints, depth_segments

#: Identity levels of the three depths (fixed values).
LEVELS = (0.99, 0.9975, 1.0)


def level_depths(intervals: DataFrame, bounds: DataFrame, keys: list[str], levels: tuple[float, ...] = LEVELS, sampling: int = 10, block: int = 50_000) -> DataFrame:
    """(keys, level, min_depth, median_depth): block depths of the intervals with at least each identity.

    All levels are swept at once: an interval counts at the highest level that it
    reaches and is repeated for each level below that some interval reaches as
    its highest.  A level that is nobody's highest has the intervals, so the
    depths, of the next such level above, and none if there is none.
    """
    highest = F.array_max(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: F.col("identity") >= x))
    rows = intervals.withColumn("level", highest).where("level IS NOT NULL")
    reached = sorted(r["level"] for r in rows.select("level").distinct().collect())
    alike = {x: [y for y in levels if min((z for z in reached if z >= y), default=None) == x] for x in [None, *reached]}
    each = lambda xs: F.explode(F.array(*[F.lit(float(x)) for x in xs]))
    zero = F.lit(0).cast("long")
    found = [bounds.select(*keys, each(alike[None]).alias("level"), zero.alias("min_depth"), zero.alias("median_depth"))] if alike[None] else []
    if reached:
        marks = F.array(*[F.lit(x) for x in reached])
        swept = block_depths(rows.withColumn("level", F.explode(F.filter(marks, lambda x: x <= F.col("level")))), bounds.withColumn("level", F.explode(marks)), [*keys, "level"], sampling, block)
        names = F.coalesce(*[F.when(F.col("level") == x, F.array(*[F.lit(float(y)) for y in alike[x]])) for x in reached])
        found.append(swept.select(*keys, F.explode(names).alias("level"), "min_depth", "median_depth"))
    return found[0].union(found[1]) if len(found) > 1 else found[0]


def adaptive_identity(intervals: DataFrame, bounds: DataFrame, keys: list[str], step: float = 0.0005, lowest: float = 0.95, least: float = 5.0, growth: float = 1.5, sampling: int = 10, block: int = 50_000) -> DataFrame:
    """(keys, dp1, dp2, dp3, threshold_pct): where exact depth is thin, the identity before depth stops growing.

    Applies if the depth at the lowest level is over three times that at
    identity 1, at least ``least``, and the latter is under ``least``.  Levels
    go down in ``step``s; the first whose depth is at least ``least`` and at
    most ``growth`` times the one before it ends the search, and the level
    before it counts.  All steps are one sweep, and the search is a window.
    """
    n = round((1.0 - lowest) / step)
    grid = [round(1.0 - i * step, 6) for i in range(n + 1)]
    on_grid = F.col("level").isin(grid)
    down = Window.partitionBy(*keys, on_grid).orderBy(F.desc("level"))
    steps = level_depths(intervals, bounds, keys, tuple({*grid, *LEVELS}), sampling, block)
    steps = steps.withColumn("before", F.lag("min_depth").over(down)).withColumn("above", F.lag("level").over(down))
    ends = on_grid & (F.col("min_depth") <= F.col("before") * growth) & (F.col("min_depth") >= least)
    fixed = [F.max(F.when(F.col("level") == x, F.col("min_depth"))).alias(f"dp{i + 1}") for i, x in enumerate(LEVELS)]
    depths = steps.groupBy(*keys).agg(*fixed, F.max(F.when(ends, F.col("above"))).alias("found"))
    thin = (F.col("dp1") > 3 * F.col("dp3")) & (F.col("dp3") < least) & (F.col("dp1") >= least)
    return depths.select(*keys, "dp1", "dp2", "dp3", F.when(thin, F.coalesce("found", F.lit(lowest)) * 100).otherwise(100.0).alias("threshold_pct"))


def split_segments(intervals: DataFrame, bounds: DataFrame, keys: list[str], least: int = 1000, hifi: bool = False) -> DataFrame:
    """(keys, part, start, stop): what is left of each sequence between its breakpoints, if longer than ``least``.

    Sequences without breakpoints stay whole; parts are numbered from 0 in order.
    """
    cuts = breakpoints(intervals, bounds, keys, hifi).select(*keys, F.col("start").alias("cut_from"), F.col("stop").alias("cut_to"))
    edge = bounds.select(*keys, F.col("length").alias("cut_from"), F.col("length").alias("cut_to"))
    along = Window.partitionBy(*keys).orderBy("cut_from", "cut_to")
    rows = cuts.union(edge).withColumn("start", F.coalesce(F.max("cut_to").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = rows.where(F.col("cut_from") - F.col("start") > least).select(*keys, "start", F.col("cut_from").alias("stop"))
    return parts.withColumn("part", F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1)


def apply_splits(reads: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, seq): reads (id string, seq) cut into their parts (id, part, start, stop); a read of one whole part keeps its name."""
    many = Window.partitionBy("id")
    sized = parts.withColumn("n", F.count("*").over(many))
    cut = reads.join(sized, "id")
    name = F.when((F.col("n") == 1) & (F.col("stop") - F.col("start") == F.length("seq")), F.col("id")).otherwise(F.concat("id", F.lit("+split"), F.col("part").cast("string")))
    return cut.select(name.alias("id"), F.substring("seq", F.col("start") + 1, F.col("stop") - F.col("start")).alias("seq"))


def poor_contigs(intervals: DataFrame, bounds: DataFrame, keys: list[str], fuzz: int = 200, share: float = 0.10, depth: float = 5.0) -> DataFrame:
    """(keys): contigs to drop: more than ``share`` without depth, mean depth at most ``depth``, not circular.

    ``bounds`` has length and circular; end gaps up to ``fuzz`` and all end gaps of circular contigs do not count.
    """
    seg = depth_segments(intervals, keys)
    reach = seg.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("covered"), F.min("start").alias("first"), F.max("stop").alias("last"), F.sum((F.col("stop") - F.col("start")) * F.col("depth")).alias("mass"))
    r = reach.join(bounds, keys)
    inner = F.col("last") - F.col("first") - F.col("covered")
    ends = F.when(F.col("first") > fuzz, F.col("first")).otherwise(0) + F.when(F.col("last") + fuzz < F.col("length"), F.col("length") - F.col("last")).otherwise(0)
    missing = inner + F.when(F.col("circular"), 0).otherwise(ends)
    return r.where(~F.col("circular") & (missing / F.col("length") > share) & (F.col("mass") / F.col("length") <= depth)).select(*keys)
