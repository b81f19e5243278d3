"""Queries: statistics of an assembly, gap rules, sketches, remaining predicates and graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import stats as T
from ..operators import ani as A
from ..operators import graph as G
from ..operators import intervals as I
from ..operators import kmers as K
from ..operators import reports as R
from ..operators import seeding as J
from ..sources import sketches
from .catalog import register
from .relational_queries import SQL_SPARSE, sparse
from .sequence_queries import MD5
from .stand_ins import SQL_CONTIGS, SQL_HALF, SQL_READS, contigs, reads, sql_kmers, table

#: Documents as contigs of a thousand bases a character.
SQL_SIZED = "c AS (SELECT lang, n_chars * 1000 AS length, doc_id % 4 = 0 AS circular, doc_id % 3 > 0 AS kept, CASE WHEN doc_id % 5 = 0 THEN 'duplicate' WHEN doc_id % 3 = 0 THEN 'alternate' ELSE 'primary' END AS class FROM documents)"


def sized(spark, d):
    kind = F.when(F.col("doc_id") % 5 == 0, "duplicate").when(F.col("doc_id") % 3 == 0, "alternate").otherwise("primary")
    return table(spark, d, "documents").select("lang", (F.col("n_chars") * 1000).alias("length"), (F.col("doc_id") % 4 == 0).alias("circular"), (F.col("doc_id") % 3 > 0).alias("kept"), kind.alias("class"))


@register(
    "a_draft_statistics",
    f"""WITH {SQL_SIZED}, r AS (SELECT lang, length, sum(length) OVER (PARTITION BY lang ORDER BY length DESC) AS run, sum(length) OVER (PARTITION BY lang) // 2 AS half FROM c WHERE kept),
    n AS (SELECT lang, max(length) AS n50 FROM r WHERE run >= half GROUP BY 1)
    SELECT lang, max(length) AS largest, count(*) FILTER (WHERE kept) AS contigs, count(*) FILTER (WHERE circular AND length >= 1000000) AS circular_1m, count(*) FILTER (WHERE length >= 1000000) AS over_1m, count(*) FILTER (WHERE length >= 100000) AS over_100k,
    (coalesce(sum(length) FILTER (WHERE kept), 0) // 2 * 2)::BIGINT AS bases, coalesce(any_value(n50), 0) AS n50 FROM c LEFT JOIN n USING (lang) GROUP BY lang""",
)
def a_draft_statistics(spark, d):
    return R.draft_statistics(sized(spark, d), ["lang"])


@register(
    "a_final_statistics",
    f"""WITH {SQL_SIZED}, t AS (SELECT lang, coalesce(sum(length) FILTER (WHERE class = 'primary'), 0) // 2 AS half FROM c GROUP BY 1),
    r AS (SELECT lang, length, sum(length) OVER (PARTITION BY lang ORDER BY length DESC) AS run FROM c), n AS (SELECT lang, max(length) AS n50 FROM r JOIN t USING (lang) WHERE run > half GROUP BY 1)
    SELECT lang, max(length) AS largest, count(*) FILTER (WHERE class = 'primary') AS "primary", count(*) FILTER (WHERE class = 'alternate') AS alternate, count(*) FILTER (WHERE class = 'duplicate') AS duplicate, count(*) FILTER (WHERE circular AND length > 1000000) AS circular_1m, count(*) FILTER (WHERE length > 1000000) AS over_1m, count(*) FILTER (WHERE length > 100000) AS over_100k,
    coalesce(sum(length) FILTER (WHERE class = 'primary'), 0)::BIGINT AS bases, coalesce(any_value(n50), 0) AS n50 FROM c LEFT JOIN n USING (lang) GROUP BY lang""",
)
def a_final_statistics(spark, d):
    return R.final_statistics(sized(spark, d), ["lang"])


#: Line items as intervals in clumps of up to 2 kb, so that most references have gaps.
SQL_CLUMPS = """iv AS (SELECT l_suppkey AS ref, l_partkey % 97 * 2000 + l_quantity::BIGINT AS start, l_partkey % 97 * 2000 + 1500 + 9 * l_quantity::BIGINT AS stop FROM lineitem),
  bounds AS (SELECT ref, max(stop) + 500 AS length FROM iv GROUP BY ref)"""


def clumps(spark, d):
    at, q = F.col("l_partkey") % 97 * 2000, F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ref"), (at + q).alias("start"), (at + 1500 + 9 * q).alias("stop"))


@register(
    "w_gap_chimeras",
    f"""WITH {SQL_CLUMPS}, m AS (SELECT ref, start, max(stop) OVER (PARTITION BY ref ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
    g AS (SELECT ref, before AS start, start AS stop FROM m WHERE start > before),
    k AS (SELECT ref, g.start, g.stop, (g.start - 200) // 5 * 5 AS l, (g.stop + 200) // 5 * 5 AS r FROM g JOIN bounds USING (ref) WHERE g.start >= 200 AND g.stop + 200 < length),
    n AS (SELECT k.ref, k.start, k.stop, count(*) FILTER (WHERE iv.start <= l AND iv.stop > l) AS left_depth, count(*) FILTER (WHERE iv.start <= r AND iv.stop > r) AS right_depth FROM k JOIN iv ON k.ref = iv.ref GROUP BY 1, 2, 3)
    SELECT ref, start, stop, CASE WHEN left_depth > 3 AND right_depth > 3 THEN 1 WHEN left_depth > 5 OR right_depth > 5 THEN 6 ELSE 0 END AS condition FROM n""",
)
def w_gap_chimeras(spark, d):
    rows = clumps(spark, d)
    return I.gap_chimeras(rows, rows.groupBy("ref").agg((F.max("stop") + 500).alias("length")), ["ref"])


@register("f_cigar_interval", "SELECT l_orderkey, greatest(0, l_orderkey % 300 - sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END))::BIGINT AS start, l_orderkey % 300 AS stop FROM lineitem GROUP BY l_orderkey")
def f_cigar_interval(spark, d):
    op = F.when(F.col("l_returnflag") == "A", "D").when(F.col("l_returnflag") == "R", "I").otherwise("M")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(op.alias("op"), F.col("l_quantity").cast("int").alias("len"))).alias("cigar"))
    return rows.select("l_orderkey", S.cigar_interval(F.col("cigar"), F.col("l_orderkey") % 300).alias("at")).select("l_orderkey", "at.*")


@register(
    "a_weighted_median_levels",
    """WITH e AS (SELECT l_suppkey, l_linenumber AS w, unnest([1, 2, 3]) AS level, unnest([l_quantity, l_quantity * (1 - l_discount), l_quantity * l_tax]) AS v FROM lineitem),
    s AS (SELECT l_suppkey, level, v, sum(w) AS w FROM e GROUP BY 1, 2, 3), r AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey, level ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_suppkey, level) AS total FROM s),
    m AS (SELECT l_suppkey, level, min(v) AS m FROM r WHERE run >= 0.5 * total GROUP BY 1, 2)
    SELECT l_suppkey, round(max(m) FILTER (WHERE level = 1), 6) AS dp1, round(max(m) FILTER (WHERE level = 2), 6) AS dp2, round(max(m) FILTER (WHERE level = 3), 6) AS dp3 FROM m GROUP BY 1""",
)
def a_weighted_median_levels(spark, d):
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.array(q, q * (1 - F.col("l_discount")), q * F.col("l_tax")).alias("depths"))
    found = T.weighted_quantile_levels(rows, ["l_suppkey"], "depths", "l_linenumber", 0.5, "m")
    return found.select("l_suppkey", *[F.round(F.col("m")[i], 6).alias(f"dp{i + 1}") for i in range(3)])


@register(
    "p_rescued",
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS diff, (l_suppkey * 37 + l_partkey) % 1500 AS shared, l_quantity::BIGINT * 40 AS minimizers FROM lineitem),
    i AS (SELECT *, diff / (minimizers * 11.0::DOUBLE) AS a FROM e)
    SELECT l_orderkey, l_linenumber, diff < greatest(shared // 200, 2) AND 1 - a / (1 + a) > 1 - (0.00005::DOUBLE + least(shared / 200 * 0.0025::DOUBLE, 0.005::DOUBLE)) AS rescued FROM i""",
)
def p_rescued(spark, d):
    diff, shared = F.col("l_partkey") % 4, (F.col("l_suppkey") * 37 + F.col("l_partkey")) % 1500
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.rescued(diff, shared, F.col("l_quantity").cast("long") * 40, 11).alias("rescued"))


ESTIMATE = "CASE WHEN l_linenumber < 7 THEN 85 + l_quantity % 11 END"


@register("p_read_quality", f"WITH e AS (SELECT l_orderkey, l_linenumber, {ESTIMATE} AS est FROM lineitem) SELECT l_orderkey, l_linenumber, est IS NULL OR est > 90 AS indexed, est IS NULL OR est >= 90 AS asked FROM e")
def p_read_quality(spark, d):
    estimate = F.expr(ESTIMATE)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.passes_quality(estimate).alias("indexed"), T.passes_quality(estimate, inclusive=True).alias("asked"))


@register(
    "p_switch_roles",
    """WITH s AS (SELECT *, l_suppkey * least(l_extendedprice * 10, 300000) AS r, (l_partkey % 50) * least(l_extendedprice * 10, 300000) AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, q > r OR (q = r AND l_returnflag > l_linestatus) AS switched FROM s""",
)
def p_switch_roles(spark, d):
    median = F.col("l_extendedprice") * 10
    switched = A.swaps_roles(median, median, F.col("l_suppkey"), F.col("l_partkey") % 50, F.col("l_linestatus"), F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", switched.alias("switched"))


SKETCHED = f"""{SQL_CONTIGS}, s AS (SELECT * FROM contigs WHERE length(seq) >= 20), {sql_kmers('s', 'km', 15, True)},
  mk AS (SELECT DISTINCT id, {MD5.format('kmer')} AS marker FROM km), few AS (SELECT id, count(*) AS n FROM mk WHERE marker < 1152921504606846976 // 3 GROUP BY 1),
  sk AS (SELECT id, length(seq) AS length, coalesce(n, 0) AS n FROM s LEFT JOIN few USING (id))"""


def sketched(spark, d):
    return sketches.sketch(contigs(spark, d), 15, 3, least=20)


@register("s_sketch_table", f"WITH {SKETCHED} SELECT id, length, n AS markers FROM sk")
def s_sketch_table(spark, d):
    return sketched(spark, d).select("id", "length", F.size("markers").cast("long").alias("markers"))


@register("a_small_sketches", f"WITH {SKETCHED} SELECT count(*) FILTER (WHERE n < 20) AS small, count(*) FILTER (WHERE n >= 20) AS large, count(*) > 10000 AND count(*) FILTER (WHERE n < 20) > 0.25 * count(*) AS warn FROM sk")
def a_small_sketches(spark, d):
    return sketches.small_sketches(sketched(spark, d))


@register(
    "p_informative_seeds",
    f"""WITH {SQL_READS}, {sql_kmers('reads', 'km', 11)}, own AS (SELECT id, kmer, count(*) AS n, sum(pos) AS places FROM km GROUP BY 1, 2), every AS (SELECT kmer FROM own GROUP BY 1 HAVING sum(n) > 40)
    SELECT id, sum(n)::BIGINT AS seeds, sum(places)::BIGINT AS places FROM own WHERE n <= 2 AND kmer NOT IN (SELECT kmer FROM every) GROUP BY id""",
)
def p_informative_seeds(spark, d):
    seeds = K.extract(reads(spark, d), 11).select("id", "pos", "kmer")
    frequent = seeds.groupBy("kmer").agg(F.count("*").alias("n")).where("n > 40")
    return J.informative(seeds, frequent, 2).groupBy("id").agg(F.count("*").alias("seeds"), F.sum("pos").cast("long").alias("places"))


RATIO = "(greatest({0}, {1}) + 3) / (least({0}, {1}) + 3)"
LEVELS = [("20 + {} % 37", "20 + {} % 37"), ("10 + {} % 37", "10 + {} % 37"), ("{} % 11", "{} % 11")]


@register(
    "g_coverage_safe_edges",
    f"""WITH {SQL_SPARSE}, {SQL_HALF}, r AS (SELECT node, side, edge_id, 0.333::DOUBLE * ({' + '.join(RATIO.format('(' + a.format('node') + ')', '(' + b.format('other') + ')') for a, b in LEVELS)}) AS ratio FROM half)
    SELECT node, side, edge_id FROM (SELECT *, min(ratio) OVER (PARTITION BY node, side) AS best FROM r) WHERE ratio / best < 1.75""",
)
def g_coverage_safe_edges(spark, d):
    depths = lambda n: F.array(20 + F.col(n) % 37, 10 + F.col(n) % 37, F.col(n) % 11)
    half = G.half_edges(sparse(spark, d)).select("node", "side", "edge_id", depths("node").alias("depth"), depths("other").alias("other_depth"))
    return G.coverage_safe(half, 1.75).select("node", "side", "edge_id")


@register(
    "u_concatenate_graphs",
    f"""WITH {SQL_SPARSE}, a AS (SELECT * FROM edges WHERE edge_id % 3 > 0), b AS (SELECT * FROM edges WHERE edge_id % 3 = 0)
    SELECT edge_id, node1, node2 FROM a UNION ALL SELECT edge_id + 1 + (SELECT max(edge_id) FROM a), node1 + 1 + (SELECT max(o_orderkey) FROM orders), node2 + 1 + (SELECT max(o_orderkey) FROM orders) FROM b""",
)
def u_concatenate_graphs(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"))
    edges = sparse(spark, d).select("edge_id", "node1", "node2")
    return R.concatenate(nodes, edges.where("edge_id % 3 > 0"), nodes, edges.where("edge_id % 3 = 0"))[1]


@register(
    "g_broken_edges",
    f"""WITH {SQL_SPARSE}, n AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 11 > 0), e AS (SELECT edge_id // 2 + edge_id % 2 * 1000000 * (edge_id % 10 // 5) AS edge_id, node1, node2 FROM edges)
    SELECT edge_id, 'repeated' AS fault FROM e GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT edge_id, 'loose' FROM e WHERE node1 NOT IN (SELECT node FROM n) OR node2 NOT IN (SELECT node FROM n)""",
)
def g_broken_edges(spark, d):
    e = F.col("edge_id")
    moved = F.floor(e / 2) + e % 2 * 1_000_000 * F.floor(e % 10 / 5)
    nodes = table(spark, d, "orders").where("o_orderkey % 11 > 0").select(F.col("o_orderkey").alias("node"))
    return R.broken_edges(nodes, sparse(spark, d).select(moved.alias("edge_id"), "node1", "node2"))


@register(
    "p_dovetail_ends",
    """WITH a AS (SELECT l_suppkey AS q, l_partkey % 50 AS r, floor(l_extendedprice)::BIGINT % 3000 AS p1, l_orderkey % 3000 AS p2 FROM lineitem)
    SELECT q AS query, r AS ref, bool_or(p1 <= 350 OR p1 >= 1500 + q % 7 * 300 - 350) AND bool_or(p2 <= 350 OR p2 >= 1500 + r % 7 * 300 - 350) AS possible FROM a GROUP BY 1, 2""",
)
def p_dovetail_ends(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query"), (F.col("l_partkey") % 50).alias("ref"), (F.floor("l_extendedprice").cast("long") % 3000).alias("pos1"), (F.col("l_orderkey") % 3000).alias("pos2"))
    ids = rows.select(F.col("query").alias("id")).union(rows.select("ref")).distinct()
    return J.dovetails(rows, ids.select("id", (1500 + F.col("id") % 7 * 300).alias("length")))


@register(
    "o_overlap_ids",
    """WITH o AS (SELECT l_orderkey AS read_i, l_partkey AS read_j, l_linenumber, l_quantity::BIGINT * 100 AS o1, l_quantity::BIGINT * 90 + l_suppkey AS o2, l_linenumber * 7 AS h1, l_suppkey % 350 AS h2 FROM lineitem),
    u AS (SELECT read_i, read_j, min(h1 + h2 - o1 - o2) AS s FROM o GROUP BY 1, 2) SELECT read_i, read_j, row_number() OVER (ORDER BY s, read_i, read_j) - 1 AS edge_id FROM u""",
)
def o_overlap_ids(spark, d):
    q = F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_i"), F.col("l_partkey").alias("read_j"), (q * 100).alias("overlap1_len"), (q * 90 + F.col("l_suppkey")).alias("overlap2_len"), (F.col("l_linenumber") * 7).alias("hang1"), (F.col("l_suppkey") % 350).alias("hang2"))
    score = F.col("hang1") + F.col("hang2") - F.col("overlap1_len") - F.col("overlap2_len")
    best = rows.groupBy("read_i", "read_j").agg(F.min_by(F.struct("overlap1_len", "overlap2_len", "hang1", "hang2"), score).alias("o"))
    return G.numbered(best.select("read_i", "read_j", "o.*")).select("read_i", "read_j", "edge_id")
