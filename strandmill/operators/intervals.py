"""Interval algebra on (ref, start, stop) rows, half-open.

Depth is a sweep over endpoints that are summed per position first, so the
sweep sees one row for each distinct endpoint of a reference.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def endpoints(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, step): net change of depth at every endpoint."""
    ends = intervals.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("stop").alias("pos"), F.lit(-1).alias("step")))).alias("e"))
    return ends.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.step").alias("step"))


def depth_segments(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop, depth): maximal stretches of one depth above 0."""
    along = Window.partitionBy(*keys).orderBy("pos")
    steps = endpoints(intervals, keys).where("step <> 0")
    runs = steps.withColumn("depth", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("stop", F.lead("pos").over(along))
    return runs.where("depth > 0").select(*keys, F.col("pos").alias("start"), "stop", "depth")


def depth_at_points(intervals: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, pos) with the depth there: intervals that start at or before and stop after."""
    moves = endpoints(intervals, keys).select(*keys, "pos", "step", F.lit(0).alias("is_point"))
    asked = points.select(*keys, "pos").distinct().select(*keys, "pos", F.lit(0).cast("long").alias("step"), F.lit(1).alias("is_point"))
    along = Window.partitionBy(*keys).orderBy("pos", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    swept = moves.union(asked).withColumn("depth", F.sum("step").over(along))
    return swept.where("is_point = 1").select(*keys, "pos", "depth")


def grid(bounds: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Points low, low + step, ... up to high of every (keys, low, high)."""
    return bounds.where("low <= high").select(*keys, F.explode(F.sequence("low", "high", F.lit(step))).alias("pos"))


def depth_runs(intervals: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop, depth, low): stretches of one depth, 0 too, that cover low to high of every (keys, low, high), one row for each key.

    The bounds are two more events of the sweep, so an axis costs as many rows
    as it has endpoints, however long it is.  Rows without a key or a position
    cover nothing.
    """
    ends = endpoints(intervals.na.drop(subset=keys), keys).where("pos IS NOT NULL AND step <> 0")
    ends = ends.select(*keys, F.col("pos").cast("long").alias("pos"), "step", F.lit(0).alias("mark"), F.lit(None).cast("long").alias("low"))
    low, high = F.col("low").cast("long"), F.col("high").cast("long")
    sides = F.array(F.struct(low.alias("pos"), F.lit(1).alias("mark")), F.struct((high + 1).alias("pos"), F.lit(-1).alias("mark")))
    marks = bounds.where("low <= high").select(*keys, low.alias("low"), F.explode(sides).alias("e")).select(*keys, "e.pos", F.lit(0).cast("long").alias("step"), "e.mark", "low")
    along = Window.partitionBy(*keys).orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    swept = ends.union(marks).select(
        *keys, F.col("pos").alias("start"), F.lead("pos").over(along).alias("stop"), F.sum("step").over(upto).alias("depth"), F.sum("mark").over(upto).alias("inside"), F.last("low", True).over(upto).alias("low")
    )
    return swept.where("inside > 0 AND stop > start").drop("inside")


def depth_on_grid(intervals: DataFrame, bounds: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, pos, depth) at the points of ``grid``: every stretch of one depth is unfolded into its points."""
    first = F.col("low") + F.ceil((F.col("start") - F.col("low")) / step) * step
    runs = depth_runs(intervals, bounds, keys).withColumn("first", first.cast("long")).where("first < stop")
    return runs.select(*keys, F.explode(F.sequence("first", F.col("stop") - 1, F.lit(step).cast("long"))).alias("pos"), "depth")


def stabbing_counts(intervals: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """``queries`` (keys, low, high) with how many intervals they overlap.

    Overlaps are counted as starts before the query's end less stops at or
    before its begin, so no pair is ever formed.
    """
    along = Window.partitionBy(*keys).orderBy("pos", "kind")
    events = endpoint_counts(intervals, keys)
    asked = queries.select(*keys, "low", "high").distinct()
    marks = asked.select(*keys, F.col("high").alias("pos"), F.lit(1).alias("side"), "low", "high").union(asked.select(*keys, F.col("low").alias("pos"), F.lit(2).alias("side"), "low", "high"))
    # Starts strictly before `high`; stops at or before `low`.
    rows = events.select(*keys, "pos", F.when(F.col("what") == "start", 1).otherwise(0).alias("kind"), F.when(F.col("what") == "start", F.col("many")).otherwise(0).alias("starts"), F.when(F.col("what") == "stop", F.col("many")).otherwise(0).alias("stops"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    marks = marks.select(*keys, "pos", F.when(F.col("side") == 1, 0).otherwise(2).alias("kind"), F.lit(0).cast("long").alias("starts"), F.lit(0).cast("long").alias("stops"), "side", "low", "high")
    run = along.rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.union(marks).withColumn("s", F.sum("starts").over(run)).withColumn("e", F.sum("stops").over(run)).where("side > 0")
    return swept.groupBy(*keys, "low", "high").agg((F.max(F.when(F.col("side") == 1, F.col("s"))) - F.max(F.when(F.col("side") == 2, F.col("e")))).alias("hits"))


def endpoint_counts(intervals: DataFrame, keys: list[str]) -> DataFrame:
    ends = intervals.select(*keys, F.explode(F.array(F.struct(F.lit("start").alias("what"), F.col("start").alias("pos")), F.struct(F.lit("stop").alias("what"), F.col("stop").alias("pos")))).alias("e"))
    return ends.groupBy(*keys, F.col("e.what").alias("what"), F.col("e.pos").alias("pos")).agg(F.count("*").alias("many"))


def gaps(intervals: DataFrame, bounds: DataFrame, keys: list[str], fuzz: int = 200) -> DataFrame:
    """Stretches without depth: between segments, and at the ends of (keys, length) beyond ``fuzz``."""
    segments = depth_segments(intervals, keys)
    along = Window.partitionBy(*keys).orderBy("start")
    inner = segments.withColumn("next", F.lead("start").over(along)).where("next > stop").select(*keys, F.col("stop").alias("start"), F.col("next").alias("stop"), F.lit("inner").alias("kind"))
    reach = segments.groupBy(*keys).agg(F.min("start").alias("first"), F.max("stop").alias("last")).join(bounds, keys)
    left = reach.where(F.col("first") > fuzz).select(*keys, F.lit(0).cast("long").alias("start"), F.col("first").alias("stop"), F.lit("left").alias("kind"))
    right = reach.where(F.col("last") + fuzz < F.col("length")).select(*keys, F.col("last").alias("start"), F.col("length").alias("stop"), F.lit("right").alias("kind"))
    return inner.union(left).union(right)


def gap_chimeras(intervals: DataFrame, bounds: DataFrame, keys: list[str], fuzz: int = 200, sampling: int = 5) -> DataFrame:
    """(keys, start, stop, condition): inner gaps at least ``fuzz`` from both ends, by the depth ``fuzz`` off on either side.

    1 if both sides are deeper than 3, else 6 if one is deeper than 5, else 0.  Depths are read at multiples of ``sampling``.
    """
    snap = lambda c: (F.floor(c / sampling) * sampling).cast("long")
    inner = gaps(intervals, bounds, keys, fuzz).where("kind = 'inner'").join(bounds.select(*keys, "length"), keys)
    inner = inner.where((F.col("start") >= fuzz) & (F.col("stop") + fuzz < F.col("length")))
    sides = inner.select(*keys, "start", "stop", F.explode(F.array(snap(F.col("start") - fuzz), snap(F.col("stop") + fuzz))).alias("pos"))
    seen = sides.join(depth_at_points(intervals, sides, keys), [*keys, "pos"]).groupBy(*keys, "start", "stop").agg(F.min("depth").alias("low"), F.max("depth").alias("high"))
    return seen.select(*keys, "start", "stop", F.when(F.col("low") > 3, 1).when(F.col("high") > 5, 6).otherwise(0).alias("condition"))


def block_depths(intervals: DataFrame, bounds: DataFrame, keys: list[str], sampling: int = 10, block: int = 50_000) -> DataFrame:
    """(keys, min_depth, median_depth): over blocks of sampled depths, the upper medians of the blocks' least and upper-median depths.

    The point that reaches a block's boundary closes the block; a full block
    weighs block / sampling, the last one its number of points.  References
    without an interval have 0.
    """
    ends = bounds.select(*keys, F.lit(sampling).cast("long").alias("low"), (F.col("length") - sampling).alias("high"))
    runs = depth_runs(intervals, ends, keys).withColumn("k1", F.ceil(F.col("start") / sampling)).withColumn("k2", F.floor((F.col("stop") - 1) / sampling)).where("k1 <= k2")
    # Points are numbered; a stretch is taken apart into its first and last block and, as one row, the whole blocks between.
    holder = lambda k: F.greatest(F.ceil(k * sampling / block), F.lit(1).cast("long"))
    upto = lambda b: F.floor(b * block / sampling)
    closing = sampling // gcd(sampling, block)
    full = lambda b: F.floor(b / closing)
    k1, k2, b1, b2 = F.col("k1"), F.col("k2"), F.col("b1"), F.col("b2")
    between = upto(b2 - 1) - upto(b1) - (full(b2 - 1) - full(b1)) * (1 if block % sampling else 0)
    nothing = F.lit(None).cast("long")
    piece = lambda b, n, last, w: F.struct(b.alias("block"), n.alias("n"), last.alias("last"), w.alias("w"))
    pieces = F.when(b1 == b2, F.array(piece(b1, k2 - k1 + 1, k2, nothing))).otherwise(
        F.array(piece(b1, upto(b1) - k1 + 1, upto(b1), nothing), piece(b2, k2 - upto(b2 - 1), k2, nothing), piece(-b2, between, nothing, between))
    )
    parts = runs.withColumn("b1", holder(k1)).withColumn("b2", holder(k2)).select(*keys, "depth", F.explode(pieces).alias("p")).select(*keys, "depth", "p.*").where("n > 0")
    counted = parts.groupBy(*keys, "block", "depth").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("w").alias("w"))
    inside = Window.partitionBy(*keys, "block")
    ranked = counted.withColumn("run", F.sum("n").over(inside.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(inside))
    middle = F.min(F.when(F.col("run") > F.floor(F.col("total") / 2), F.col("depth")))
    blocks = ranked.groupBy(*keys, "block").agg(F.min("depth").alias("low"), middle.alias("mid"), F.max("total").alias("n"), F.max("last").alias("last"), F.max("w").alias("w"))
    weight = F.coalesce("w", F.when(F.col("last") * sampling >= F.col("block") * block, F.lit(block // sampling)).otherwise(F.col("n"))).cast("long")
    both = F.array(F.struct(F.lit("min").alias("name"), F.col("low").alias("value")), F.struct(F.lit("median").alias("name"), F.col("mid").alias("value")))
    summed = blocks.select(*keys, weight.alias("w"), F.explode(both).alias("v")).groupBy(*keys, "v.name", "v.value").agg(F.sum("w").alias("w"))
    named = Window.partitionBy(*keys, "name")
    medians = summed.withColumn("run", F.sum("w").over(named.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(named)).where("run > floor(total / 2)")
    found = medians.groupBy(*keys).agg(*[F.min(F.when(F.col("name") == name, F.col("value"))).alias(f"{name}_depth") for name in ("min", "median")])
    return bounds.select(*keys).join(found, keys, "left").na.fill(0, ["min_depth", "median_depth"])


def breakpoints(intervals: DataFrame, bounds: DataFrame, keys: list[str], hifi: bool = False, fuzz: int = 200) -> DataFrame:
    """(keys, start, stop, depth, condition): where depth collapses between well covered neighbours.

    1-8 are inner segments of low depth (next to deep segments, or deep 200
    bases off); -1 and -4 uncovered ends, -2 and -3 thin end segments.  The
    first rule that holds names the segment.  References need three segments.
    """
    along = Window.partitionBy(*keys).orderBy("start")
    every = Window.partitionBy(*keys)
    seg = depth_segments(intervals, keys).join(bounds, keys)
    seg = seg.withColumn("at", F.row_number().over(along)).withColumn("n", F.count("*").over(every)).where("n >= 3")
    seg = seg.withColumn("before", F.lag("depth").over(along)).withColumn("after", F.lead("depth").over(along))
    snap = lambda c: (F.floor(c / 5) * 5).cast("long")
    looks = {"left200": snap(F.col("start") - fuzz), "right200": snap(F.col("start") + fuzz), "past_stop": F.col("stop") + fuzz - 1, "before_start": F.col("start") - fuzz}
    # Each segment asks for four depths; one sweep answers all of them.
    own = F.struct(*[c for c in seg.columns if c not in keys])
    asked = seg.select(*keys, own.alias("s"), F.explode(F.array(*[F.struct(F.lit(name).alias("name"), pos.alias("pos")) for name, pos in looks.items()])).alias("q"))
    asked = asked.select(*keys, F.col("q.pos").alias("pos"), F.lit(0).cast("long").alias("step"), F.lit(1).alias("is_point"), "s", F.col("q.name").alias("name"))
    nothing = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("s", "name")]
    moves = endpoints(intervals, keys).select(*keys, "pos", "step", F.lit(0).alias("is_point"), *nothing)
    sweep = Window.partitionBy(*keys).orderBy("pos", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    swept = moves.union(asked).withColumn("_depth", F.sum("step").over(sweep)).where("is_point = 1")
    seg = swept.groupBy(*keys, "s").agg(*[F.max(F.when(F.col("name") == name, F.col("_depth"))).alias(name) for name in looks]).select(*keys, "s.*", *looks)
    d, b, a = F.col("depth"), F.col("before"), F.col("after")
    wide = (F.col("start") > fuzz) & (F.col("stop") + fuzz < F.col("length"))
    l2, r2 = F.col("left200"), F.col("right200")
    far = lambda times: wide & (l2 > d * times) & (r2 > d * times)
    near = lambda times: (b > d * times) | (a > d * times)
    noisy = F.lit(not hifi)
    inner = (
        F.when((b > 3) & (a > 3) & (d <= 1), 1)
        .when(wide & (l2 > 3) & (r2 > 3) & (d <= 1), 2)
        .when(far(10) & (d <= 2) & noisy, 3)
        .when(far(25) & (d <= 3) & noisy, 5)
        .when(near(5) & (d <= 1), 6)
        .when(near(5) & (d <= 2), 7)
        .when(near(25) & (d <= 3) & noisy, 8)
    )
    within = (F.col("at") > 1) & (F.col("at") < F.col("n")) & (F.col("start") > fuzz) & (F.col("start") + fuzz < F.col("length"))
    out = [seg.where(within).select(*keys, "start", "stop", "depth", inner.alias("condition")).where("condition IS NOT NULL")]
    first, last = seg.where("at = 1"), seg.where("at = n")
    zero = F.lit(0).cast("long")
    out.append(first.where(F.col("start") > fuzz).select(*keys, zero.alias("start"), F.col("start").alias("stop"), zero.alias("depth"), F.lit(-1).alias("condition")))
    deep = (a > 3) | ((F.col("length") > F.col("stop") + fuzz) & (F.col("past_stop") > 3))
    out.append(first.where((F.col("stop") > fuzz) & deep & (d <= 1)).select(*keys, "start", "stop", "depth", F.lit(-2).alias("condition")))
    out.append(last.where((F.col("start") < F.col("length") - fuzz) & (F.col("start") >= fuzz) & ((b > 3) | (F.col("before_start") > 3)) & (d <= 1)).select(*keys, "start", "stop", zero.alias("depth"), F.lit(-3).alias("condition")))
    out.append(last.where(F.col("stop") + fuzz < F.col("length")).select(*keys, F.col("stop").alias("start"), F.col("length").alias("stop"), F.col("depth"), F.lit(-4).alias("condition")))
    found = out[0]
    for part in out[1:]:
        found = found.union(part)
    return found


def maximal_overlap(start1: Column, end1: Column, start2: Column, end2: Column, len1: Column, len2: Column, reverse: Column, fuzz: int = 200) -> Column:
    """Whether an alignment reaches sequence ends on both sides, up to ``fuzz``."""
    l1, r1 = start1 <= fuzz, end1 >= len1 - fuzz
    l2, r2 = start2 <= fuzz, end2 >= len2 - fuzz
    same = (l1 | l2) & (r1 | r2)
    flipped = (l1 | r2) & (r1 | l2)
    return F.when(reverse, flipped).otherwise(same)
