"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by key within
their source; distributed prefix sums of word counts say where each source's
budget ends.  All of it is DataFrame operations on a narrow table without
texts, so one source with a third of all rows is just more ranges.

Defined cases.  Null or empty text: size 0, nothing taken.  Null source: a
source of its own, last in order.  Repeated rows and ties of the key count and
take separately, in an order that does not change the result as a set.  Empty
table: empty result.  All sizes 0: targets 0.  Only the id, source and text
columns are read; other columns of the mixed corpus may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def prefix_sums(df: DataFrame, group: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with the sums of ``values`` (column -> new column) over the earlier rows of the group.

    Rows are range-sorted by group and order; each range is summed; ranges get
    the sum of the ranges before them in the group; rows add what precedes them
    in their range.  No task holds more than one range.
    """
    parts = stored(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*group, "_part").agg(*[F.sum(v).alias(f"_{o}") for v, o in values.items()])
    sums = sums.select(*group, "_part", *[F.coalesce(F.sum(f"_{o}").over(earlier), F.lit(0)).alias(f"_{o}") for o in values.values()])
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(sums, [*group, "_part"])
    return joined.select(*df.columns, *[(F.col(f"_{o}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(o) for v, o in values.items()])


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, source_rank, target) from (source, source_size).

    Water filling in closed form: with sources in order of cap / weight, those
    before some position are at their cap and the rest share what is left by
    weight; the first position whose share is within its own cap gives the level.
    """
    ranked = totals.withColumn("one", F.lit(1)).withColumn("last", F.col("source").isNull())
    ranked = prefix_sums(ranked, [], ["last", "source"], {"one": "source_rank"}).drop("one", "last")
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", choice.cast("long")).withColumn("cap", F.col("source_size") * epochs).withColumn("turn", F.col("cap") / F.col("weight"))
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not whole["size"]:
        return ranked.select("source", "source_size", "source_rank", F.lit(0.0).alias("target"))
    filled = prefix_sums(ranked, [], ["turn", "source_rank"], {"cap": "caps", "weight": "weights"})
    level = (F.lit(whole["size"]) - F.col("caps")) / (F.lit(whole["weight"]) - F.col("weights"))
    filled = filled.withColumn("level", level)
    found = filled.where("level <= turn").agg(F.min_by("level", F.struct("turn", "source_rank")).alias("level")).first()["level"]
    return filled.select("source", "source_size", "source_rank", F.least(F.col("cap").cast("double"), F.lit(found) * F.col("weight")).alias("target"))


def _row_key(id_col: str, source_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """(doc_id, source, row_key, size, source_size, target, taken) of every row: the words that the mix takes of it.

    A source below its budget is repeated whole and then cut; the document at
    the cut is taken in part, so that each source gives exactly the whole words
    of its target.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit(":"), text)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        _row_key(id_col, source_col, text_col).alias("row_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
    )
    narrow = stored(narrow, "sizes")
    totals = stored(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    goals = stored(targets(totals, weights, epochs).withColumnRenamed("source", "goal_source"), "targets")
    rows = narrow.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rows = prefix_sums(rows, ["source_rank"], ["key", "doc_id"], {"size": "before"})
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select("doc_id", "source", "row_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


WORDS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def materialized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """The mixed corpus: ``docs``, all columns, one row for each time that the mix takes a text.

    Repeats are rows of their own, and the text at a source's cut holds just the
    words that are taken.  Size, source_size, target and taken (the words of this
    row) are added, under names that no column of ``docs`` has.  Texts of which
    nothing is taken, those without words included, are left out.
    """
    key, place, copy = (free_name(docs, n) for n in ("_row_key", "_place", "_copy"))
    added = {c: free_name(docs, c) for c in ("size", "source_size", "target", "taken")}
    size, taken = F.col(added["size"]), F.col(added["taken"])
    # Rows of one id, source and text are alike: their whole rounds are equal, and what is left goes to them in turn.
    plan = mix(docs, id_col, source_col, text_col, weights, epochs, seed).groupBy(F.col("row_key").alias(key)).agg(
        *[F.max(c).alias(added[c]) for c in ("size", "source_size", "target")], F.sum("taken").alias(added["taken"]), F.min("taken").alias(copy), F.count("*").alias(place)
    )
    plan = plan.where(taken > 0).withColumn(copy, F.col(copy) - F.col(copy) % size).withColumn(place, taken - F.col(place) * F.col(copy))
    rows = docs.withColumn(key, _row_key(id_col, source_col, text_col)).join(plan, key)
    turn = F.row_number().over(Window.partitionBy(key).orderBy(key)) - 1
    rows = rows.withColumn(added["taken"], F.col(copy) + F.greatest(F.lit(0), F.least(size, F.col(place) - turn * size))).where(taken > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), F.ceil(taken / size).cast("int") - 1))).withColumn(added["taken"], F.least(size, taken - F.col(copy) * size))
    text = F.col(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.lit(1), taken.cast("int")), "")
    return rows.withColumn(text_col, F.when(taken < size, cut).otherwise(text)).select(*docs.columns, *added.values())


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM s),
w AS (SELECT *, [5, 2, 1][1 + source_rank % 3]::BIGINT AS weight, 3 * source_size AS cap FROM r),
f AS (SELECT *, cap / weight AS turn,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, source_rank, least(cap::DOUBLE, weight * coalesce((SELECT arg_min(level, (turn, source_rank)) FROM f WHERE level <= turn), 0.0)) AS target FROM f),
x AS (SELECT d.doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY source_rank ORDER BY key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds FROM x)
SELECT doc_id, size, source_size, target,
  (rounds * size + greatest(0, least(size, budget - rounds * source_size - before)))::BIGINT AS taken
FROM y
"""
