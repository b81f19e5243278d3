"""Queries: coverage levels, splitting, cleaning rules, remaining predicates, text sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as T
from ..functions.stats import bootstrap_interval
from ..operators import cleaning as L
from ..operators.tables import stored
from ..operators import coverage as V
from ..operators import graph as G
from ..sources import fastx, sinks
from .catalog import register
from .relational_queries import BREAKS, SEGMENTS, SQL_SPARSE, sparse
from .stand_ins import SQL_HALF, SQL_INTERVALS, bounds, intervals, reads, table


@register("f_quality_pool", "SELECT l_orderkey, l_linenumber, l_partkey, min(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS pooled FROM lineitem")
def f_quality_pool(spark, d):
    around = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.pooled("l_quantity", around).alias("pooled"))


@register("p_dovetail", "SELECT l_suppkey, l_partkey % 50 AS other, bool_or(l_quantity * 40 <= 350) AND bool_or(l_partkey % 2000 >= 1650) AS possible FROM lineitem GROUP BY 1, 2")
def p_dovetail(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 50).alias("other"))
    return rows.agg((F.bool_or(F.col("l_quantity") * 40 <= 350) & F.bool_or(F.col("l_partkey") % 2000 >= 1650)).alias("possible"))


@register("p_pareto", f"WITH {SQL_SPARSE}, {SQL_HALF} SELECT x.node, x.side, x.edge_id, count(y.edge_id) AS better FROM half x LEFT JOIN half y ON x.node = y.node AND x.side = y.side AND y.overlap > x.overlap AND y.shared_minimizers > x.shared_minimizers AND y.diff_snpmers < x.diff_snpmers GROUP BY 1, 2, 3")
def p_pareto(spark, d):
    half = G.half_edges(sparse(spark, d)).select("node", "side", "edge_id", "overlap", "shared_minimizers", "diff_snpmers")
    y = half.toDF("node", "side", "e2", "o2", "m2", "d2")
    better = F.count_if((F.col("o2") > F.col("overlap")) & (F.col("m2") > F.col("shared_minimizers")) & (F.col("d2") < F.col("diff_snpmers")))
    return half.join(y, ["node", "side"]).groupBy("node", "side", "edge_id").agg(better.alias("better"))


@register("p_set_dominance", "WITH a AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY 1) SELECT x.k, y.k AS other FROM a x JOIN a y ON x.k % 10 = y.k % 10 AND x.k <> y.k WHERE list_has_all(x.s, y.s) AND NOT list_has_all(y.s, x.s)")
def p_set_dominance(spark, d):
    sets = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_linenumber").alias("s")).withColumn("g", F.col("k") % 10)
    pairs = sets.join(sets.toDF("other", "t", "g"), "g").where("k <> other")
    return pairs.where((F.size(F.array_except("t", "s")) == 0) & (F.size(F.array_except("s", "t")) > 0)).select("k", "other")


@register("p_circular", f"WITH {SQL_SPARSE}, {SQL_HALF}, e AS (SELECT node, count(DISTINCT edge_id) AS edges, count(DISTINCT CASE WHEN node = other AND side <> other_side THEN edge_id END) AS loops FROM half GROUP BY 1) SELECT node, loops = 1 AND edges = 1 AS strict, loops > 0 AS walk FROM e")
def p_circular(spark, d):
    return L.circular(sparse(spark, d))


@register("p_duplicate_status", "SELECT o_orderkey, CASE WHEN m < 1.10 THEN 'no' WHEN m < 1.50 THEN 'possibly' ELSE 'yes' END AS duplicated FROM (SELECT o_orderkey, 1 + (o_orderkey % 10) * 0.1::DOUBLE AS m FROM orders)")
def p_duplicate_status(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fastx.duplicate_status(1 + (F.col("o_orderkey") % 10) * F.lit(0.1)).alias("duplicated"))


@register("p_unitig_output", "SELECT l_partkey, count(*) AS reads, count(DISTINCT l_suppkey) AS links FROM lineitem GROUP BY 1 HAVING NOT (count(*) < 25 AND count(DISTINCT l_suppkey) < 20)")
def p_unitig_output(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("reads"), F.countDistinct("l_suppkey").alias("links"))
    return rows.where(G.passes_output(F.col("reads"), F.col("links"), 25, 20))


@register(
    "p_low_coverage_contigs",
    f"""WITH {SEGMENTS}, r AS (SELECT ref, sum(stop - start) AS covered, min(start) AS a, max(stop) AS b, sum((stop - start) * depth) AS mass FROM seg GROUP BY 1)
    SELECT ref FROM r JOIN bounds USING (ref) WHERE ref % 3 > 0 AND ((b - a - covered) + CASE WHEN a > 200 THEN a ELSE 0 END + CASE WHEN b + 200 < length THEN length - b ELSE 0 END) / length > 0.10 AND mass / length <= 9""",
)
def p_low_coverage_contigs(spark, d):
    return V.poor_contigs(intervals(spark, d), bounds(spark, d).withColumn("circular", F.col("ref") % 3 == 0), ["ref"], depth=9.0)


def rated(spark, d):
    rows = table(spark, d, "lineitem")
    share = F.element_at(F.array(F.lit(0.985), F.lit(0.991), F.lit(0.998), F.lit(1.0)), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return rows.select(F.col("l_suppkey").alias("ref"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("stop"), share.alias("identity"))


@register(
    "a_level_depths",
    f"""WITH {SQL_INTERVALS}, b AS (SELECT ref, max(stop) + 500 AS length FROM iv GROUP BY ref),
    r AS (SELECT l_suppkey AS ref, l_partkey AS start, l_partkey + l_quantity::BIGINT AS stop, [0.985, 0.991, 0.998, 1.0][l_orderkey % 4 + 1]::DOUBLE AS identity FROM lineitem),
    lv AS (SELECT ref, length, unnest([0.99, 0.9975, 1.0])::DOUBLE AS level FROM b), p AS (SELECT ref, level, unnest(range(10, length - 9, 10)) AS pos FROM lv),
    e AS (SELECT ref, level, pos, sum(s) AS s FROM (SELECT r.ref, level, start AS pos, 1 AS s FROM r JOIN lv ON r.ref = lv.ref AND identity >= level UNION ALL SELECT r.ref, level, stop, -1 FROM r JOIN lv ON r.ref = lv.ref AND identity >= level) GROUP BY 1, 2, 3),
    c AS (SELECT ref, level, pos, sum(s) OVER (PARTITION BY ref, level ORDER BY pos) AS depth FROM e),
    q AS (SELECT p.ref, p.level, p.pos, coalesce(c.depth, 0) AS depth FROM p ASOF LEFT JOIN c ON p.ref = c.ref AND p.level = c.level AND p.pos >= c.pos),
    o AS (SELECT ref, level, list_sort(list(depth)) AS l FROM q GROUP BY 1, 2)
    SELECT ref, level, l[1]::BIGINT AS min_depth, l[len(l) // 2 + 1]::BIGINT AS median_depth FROM o""",
)
def a_level_depths(spark, d):
    return V.level_depths(rated(spark, d), bounds(spark, d), ["ref"], block=10_000_000)


GRID = [round(1.0 - i * 0.0005, 6) for i in range(31)]


@register(
    "a_adaptive_identity",
    f"""WITH {SQL_INTERVALS}, b AS (SELECT ref, max(stop) + 500 AS length FROM iv GROUP BY ref),
    r AS (SELECT l_suppkey AS ref, l_partkey AS start, l_partkey + l_quantity::BIGINT AS stop, [0.985, 0.991, 0.998, 1.0][l_orderkey % 4 + 1]::DOUBLE AS identity FROM lineitem),
    lv AS (SELECT ref, length, unnest([{', '.join(f'{x!r}e0' for x in GRID)}]) AS level FROM b), p AS (SELECT ref, level, unnest(range(10, length - 9, 10)) AS pos FROM lv),
    e AS (SELECT ref, level, pos, sum(s) AS s FROM (SELECT r.ref, level, start AS pos, 1 AS s FROM r JOIN lv ON r.ref = lv.ref AND identity >= level UNION ALL SELECT r.ref, level, stop, -1 FROM r JOIN lv ON r.ref = lv.ref AND identity >= level) GROUP BY 1, 2, 3),
    c AS (SELECT ref, level, pos, sum(s) OVER (PARTITION BY ref, level ORDER BY pos) AS depth FROM e),
    q AS (SELECT p.ref, p.level, p.pos, coalesce(c.depth, 0) AS depth FROM p ASOF LEFT JOIN c ON p.ref = c.ref AND p.level = c.level AND p.pos >= c.pos),
    k AS (SELECT ref, level, greatest(ceil(pos / 500), 1) AS block, min(depth) AS low, count(*) AS n, max(pos) AS last FROM q GROUP BY 1, 2, 3),
    w AS (SELECT ref, level, low, sum(CASE WHEN last >= block * 500 THEN 50 ELSE n END) AS w FROM k GROUP BY 1, 2, 3),
    v AS (SELECT ref, level, low, sum(w) OVER (PARTITION BY ref, level ORDER BY low) AS run, sum(w) OVER (PARTITION BY ref, level) AS total FROM w),
    m AS (SELECT lv.ref, lv.level, coalesce(min(low), 0)::BIGINT AS depth FROM lv LEFT JOIN v ON lv.ref = v.ref AND lv.level = v.level AND run > total // 2 GROUP BY 1, 2),
    s AS (SELECT *, lag(depth) OVER d AS before, lag(level) OVER d AS above FROM m WINDOW d AS (PARTITION BY ref ORDER BY level DESC)),
    o AS (SELECT ref, max(depth) FILTER (WHERE level = 0.99e0) AS dp1, max(depth) FILTER (WHERE level = 0.9975e0) AS dp2, max(depth) FILTER (WHERE level = 1e0) AS dp3, max(above) FILTER (WHERE depth <= before * 1.5 AND depth >= 5) AS found FROM s GROUP BY 1)
    SELECT ref, dp1, dp2, dp3, CASE WHEN dp1 > 3 * dp3 AND dp3 < 5 AND dp1 >= 5 THEN coalesce(found, 0.985e0) * 100 ELSE 100e0 END AS threshold_pct FROM o""",
)
def a_adaptive_identity(spark, d):
    return V.adaptive_identity(rated(spark, d), bounds(spark, d), ["ref"], lowest=0.985, block=500)


@register(
    "c_split_segments",
    f"""WITH {BREAKS}, cut AS (SELECT ref, start AS a, stop AS b FROM br UNION ALL SELECT ref, length, length FROM bounds),
    g AS (SELECT ref, coalesce(max(b) OVER (PARTITION BY ref ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, a AS stop FROM cut)
    SELECT ref, start, stop, row_number() OVER (PARTITION BY ref ORDER BY start) - 1 AS part FROM g WHERE stop - start > 100""",
)
def c_split_segments(spark, d):
    return V.split_segments(intervals(spark, d), bounds(spark, d), ["ref"], least=100)


@register(
    "j_contig_containment",
    """WITH c AS (SELECT doc_id AS id, lang, n_chars AS n FROM documents), s AS (SELECT id, lang, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, id) AS r FROM c)
    SELECT a.id AS small, b.id AS large FROM s a JOIN s b ON a.lang = b.lang AND b.r = a.r - 1 WHERE a.n * 1.1 <= b.n""",
)
def j_contig_containment(spark, d):
    down = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("small"), "n_chars", F.lag("doc_id").over(down).alias("large"), F.lag("n_chars").over(down).alias("m"))
    return rows.where("large IS NOT NULL AND n_chars * 1.1 <= m").select("small", "large")


@register("a_block_stats", "SELECT l_suppkey AS block, count(*) AS n, median(l_quantity) AS mid, max(l_quantity) AS most, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS spread FROM lineitem GROUP BY 1")
def a_block_stats(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("block"), "l_quantity")
    return T.block_stats(rows, ["block"], "l_quantity").withColumn("spread", F.round("spread", 6))


@register("a_component_stats", "SELECT min(o_orderkey) AS component, count(*) AS nodes, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS bases FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def a_component_stats(spark, d):
    o = table(spark, d, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    label = G.components(o.select(F.col("o_orderkey").alias("node1"), after.alias("node2")).where("node2 IS NOT NULL"))
    sized = label.join(o.select(F.col("o_orderkey").alias("node"), F.col("o_totalprice").cast("decimal(18,2)").alias("b")), "node")
    return sized.groupBy("component").agg(F.count("*").alias("nodes"), F.sum("b").cast("double").alias("bases"))


@register("a_length_quantiles", "SELECT lang, quantile_disc(n_chars, 0.1) AS q10, quantile_disc(n_chars, 0.5) AS q50, quantile_disc(n_chars, 0.9) AS q90 FROM documents GROUP BY 1")
def a_length_quantiles(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT lang, " + ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars) AS q{int(p * 100)}" for p in (0.1, 0.5, 0.9)) + " FROM _documents GROUP BY lang").select("lang", *[F.col(f"q{q}").cast("long").alias(f"q{q}") for q in (10, 50, 90)])


@register("a_bootstrap_ci")
def a_bootstrap_ci(spark, d):
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_interval(sorted(rows["l_discount"])) or (None, None)
        return pd.DataFrame([(rows["l_suppkey"].iloc[0], low, high)], columns=["l_suppkey", "low", "high"])

    return table(spark, d, "lineitem").select("l_suppkey", "l_discount").groupBy("l_suppkey").applyInPandas(run, "l_suppkey long, low double, high double")


@register("g_cut_coverage", f"WITH {SQL_SPARSE}, n AS (SELECT k AS node, ((k % 7) + (k % 5) + (k % 3)) / 3 AS depth FROM o), g AS (SELECT node FROM n WHERE depth < 2) SELECT edge_id FROM edges WHERE node1 NOT IN (SELECT node FROM g) AND node2 NOT IN (SELECT node FROM g)")
def g_cut_coverage(spark, d):
    k = F.col("o_orderkey")
    nodes = table(spark, d, "orders").select(k.alias("node"), F.array((k % 7).cast("double"), (k % 5).cast("double"), (k % 3).cast("double")).alias("depths"))
    return L.cut_coverage(nodes, sparse(spark, d), 2.0)[1].select("edge_id")


@register("u_progressive_union", "WITH a AS (SELECT o_orderkey AS id, o_custkey AS read FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS id, o_custkey AS read FROM orders WHERE o_orderstatus <> 'F') SELECT DISTINCT id FROM a UNION ALL SELECT DISTINCT id FROM b WHERE read NOT IN (SELECT read FROM a)")
def u_progressive_union(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("read"), "o_orderstatus")
    part = lambda cond: (o.where(cond).select("id").distinct(), o.where(cond).select("id", "read"))
    return L.progressive_union([part("o_orderstatus = 'F'"), part("o_orderstatus <> 'F'")])


@register("s_bed_sink", f"WITH {SEGMENTS} SELECT ref || chr(9) || start || chr(9) || stop || chr(9) || (stop - start) || chr(9) || depth || chr(9) || 0 || chr(9) || length || chr(9) || printf('%.4f', (stop - start) / length) AS value FROM seg JOIN bounds USING (ref)")
def s_bed_sink(spark, d):
    from ..operators.intervals import depth_segments

    regions = depth_segments(intervals(spark, d), ["ref"]).join(bounds(spark, d), "ref").withColumn("condition", F.lit(0))
    return sinks.bed(regions)


@register("s_fasta_sink", "SELECT '>' || doc_id || chr(10) || regexp_replace(upper(text), '[^ACGT]', '', 'g') AS value FROM documents")
def s_fasta_sink(spark, d):
    return fastx.fasta_lines(reads(spark, d), F.col("id").cast("string"), F.col("seq"))


@register("g_clean_graph")
def g_clean_graph(spark, d):
    """Tips, bubbles and walk cuts on the graph of consecutive orders with skips."""
    from .kernel_queries import order_graph

    e = order_graph(spark, d).select("edge_id", "node1", "node2", F.lit(True).alias("dir1"), F.lit(False).alias("dir2"), "overlap", F.col("diff").alias("diff_snpmers"), F.col("minimizers").alias("shared_minimizers"))
    k = F.col("node")
    nodes = G.half_edges(e).select("node").distinct().select("node", (1500 + k % 4000).alias("length"), (1 + k % 9).alias("reads"), F.array((3 + k % 20).cast("double"), (2 + k % 10).cast("double"), (1 + k % 5).cast("double")).alias("depths"))
    e = stored(e, "edges")
    label = stored(G.components(e), "labels")
    nodes, e = L.pop_bubbles(stored(nodes, "nodes"), e, label=label)
    nodes, e = L.remove_tips(nodes, e, 2000, 3)
    return L.walk_and_cut(nodes, e, 0.25, label=label).select("edge_id", "node1", "node2")
