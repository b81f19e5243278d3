"""Queries: intervals, seed joins, graphs, set operations, dereplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import ani, graph as G
from ..operators.tables import stored
from ..operators import intervals as I
from ..operators import kmers as K
from ..operators import seeding as J
from . import catalog
from .catalog import register
from .stand_ins import SQL_BOUNDS, SQL_CONTIGS, SQL_EDGES, SQL_HALF, SQL_INTERVALS, SQL_READS, bounds, contigs, edges, intervals, reads, sql_kmers, table

# Intervals ------------------------------------------------------------------------------------------------------------

SEGMENTS = f"""{SQL_INTERVALS}, {SQL_BOUNDS},
ends AS (SELECT ref, pos, sum(step) AS step FROM (SELECT ref, start AS pos, 1 AS step FROM iv UNION ALL SELECT ref, stop, -1 FROM iv) GROUP BY 1, 2 HAVING sum(step) <> 0),
runs AS (SELECT ref, pos AS start, lead(pos) OVER w AS stop, (sum(step) OVER w)::BIGINT AS depth FROM ends WINDOW w AS (PARTITION BY ref ORDER BY pos)),
seg AS (SELECT * FROM runs WHERE depth > 0)"""


@register("w_depth_segments", f"WITH {SEGMENTS} SELECT ref, start, stop, depth FROM seg")
def w_depth_segments(spark, d):
    return I.depth_segments(intervals(spark, d), ["ref"])


POINTS = "pts AS (SELECT ref, unnest(range(0, length + 1, 25)) AS pos FROM bounds)"


@register("w_depth_points", f"WITH {SEGMENTS}, {POINTS} SELECT p.ref, p.pos, coalesce(s.depth, 0) AS depth FROM pts p ASOF LEFT JOIN (SELECT ref, start, stop, depth FROM runs) s ON p.ref = s.ref AND p.pos >= s.start")
def w_depth_points(spark, d):
    ends = bounds(spark, d).select("ref", F.lit(0).cast("long").alias("low"), F.col("length").alias("high"))
    return I.depth_on_grid(intervals(spark, d), ends, ["ref"], 25)


@register(
    "w_gaps",
    f"""WITH {SEGMENTS}, n AS (SELECT ref, stop AS start, lead(start) OVER (PARTITION BY ref ORDER BY start) AS stop FROM seg),
    r AS (SELECT ref, min(start) AS a, max(stop) AS b FROM seg GROUP BY ref)
    SELECT ref, start, stop, 'inner' AS kind FROM n WHERE stop > start UNION ALL SELECT ref, 0, a, 'left' FROM r WHERE a > 200
    UNION ALL SELECT ref, b, length, 'right' FROM r JOIN bounds USING (ref) WHERE b + 200 < length""",
)
def w_gaps(spark, d):
    return I.gaps(intervals(spark, d), bounds(spark, d), ["ref"])


@register(
    "a_gap_fraction",
    f"""WITH {SEGMENTS}, c AS (SELECT ref, sum(stop - start) AS covered FROM seg GROUP BY ref) SELECT ref, round(1 - covered / length, 6) AS missing, 1 - covered / length > 0.10 AS poor FROM c JOIN bounds USING (ref)""",
)
def a_gap_fraction(spark, d):
    covered = I.depth_segments(intervals(spark, d), ["ref"]).groupBy("ref").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
    share = 1 - F.col("covered") / F.col("length")
    return covered.join(bounds(spark, d), "ref").select("ref", F.round(share, 6).alias("missing"), (share > 0.10).alias("poor"))


@register("j_range_stab", f"WITH {SQL_INTERVALS}, q AS (SELECT DISTINCT l_suppkey AS ref, (l_partkey // 50) * 50 AS low, (l_partkey // 50) * 50 + 20 AS high FROM lineitem) SELECT q.ref, low, high, count(iv.ref) AS hits FROM q LEFT JOIN iv ON q.ref = iv.ref AND start < high AND stop > low GROUP BY ALL")
def j_range_stab(spark, d):
    low = (F.floor(F.col("start") / 50) * 50).cast("long")
    asked = intervals(spark, d).select("ref", low.alias("low"), (low + 20).alias("high"))
    return I.stabbing_counts(intervals(spark, d), asked, ["ref"])


@register(
    "w_block_median_depth",
    f"""WITH {SEGMENTS}, pts AS (SELECT ref, unnest(range(10, length - 10 + 1, 10)) AS pos FROM bounds),
    dp AS (SELECT p.ref, p.pos, coalesce(s.depth, 0) AS depth FROM pts p ASOF LEFT JOIN runs s ON p.ref = s.ref AND p.pos >= s.start),
    b AS (SELECT ref, greatest(ceil(pos / 500), 1) AS block, list_sort(list(depth)) AS l, max(pos) AS last FROM dp GROUP BY 1, 2),
    v AS (SELECT ref, l[1] AS low, l[len(l) // 2 + 1] AS mid, CASE WHEN last >= block * 500 THEN 50 ELSE len(l) END AS w FROM b),
    e AS (SELECT ref, unnest(list_transform(range(w), lambda x: low)) AS low, unnest(list_transform(range(w), lambda x: mid)) AS mid FROM v),
    o AS (SELECT ref, list_sort(list(low)) AS a, list_sort(list(mid)) AS b FROM e GROUP BY ref)
    SELECT ref, coalesce(a[len(a) // 2 + 1], 0)::BIGINT AS min_depth, coalesce(b[len(b) // 2 + 1], 0)::BIGINT AS median_depth FROM bounds LEFT JOIN o USING (ref)""",
)
def w_block_median_depth(spark, d):
    return I.block_depths(intervals(spark, d), bounds(spark, d), ["ref"], sampling=10, block=500)


BREAKS = f"""{SEGMENTS}, s AS (SELECT *, row_number() OVER w AS spot, count(*) OVER (PARTITION BY ref) AS n, lag(depth) OVER w AS b, lead(depth) OVER w AS a FROM seg JOIN bounds USING (ref) WINDOW w AS (PARTITION BY ref ORDER BY start)),
    x AS (SELECT s.*, coalesce(p.depth, 0) AS l2, coalesce(q.depth, 0) AS r2, coalesce(u.depth, 0) AS past, coalesce(v.depth, 0) AS before
      FROM s ASOF LEFT JOIN runs p ON s.ref = p.ref AND ((s.start - 200) // 5) * 5 >= p.start ASOF LEFT JOIN runs q ON s.ref = q.ref AND ((s.start + 200) // 5) * 5 >= q.start
      ASOF LEFT JOIN runs u ON s.ref = u.ref AND s.stop + 199 >= u.start ASOF LEFT JOIN runs v ON s.ref = v.ref AND s.start - 200 >= v.start WHERE n >= 3),
    y AS (SELECT *, start > 200 AND stop + 200 < length AS wide FROM x),
    z AS (SELECT ref, start, stop, depth, CASE WHEN b > 3 AND a > 3 AND depth <= 1 THEN 1 WHEN wide AND l2 > 3 AND r2 > 3 AND depth <= 1 THEN 2
      WHEN wide AND l2 > depth * 10 AND r2 > depth * 10 AND depth <= 2 THEN 3 WHEN wide AND l2 > depth * 25 AND r2 > depth * 25 AND depth <= 3 THEN 5
      WHEN (b > depth * 5 OR a > depth * 5) AND depth <= 1 THEN 6 WHEN (b > depth * 5 OR a > depth * 5) AND depth <= 2 THEN 7
      WHEN (b > depth * 25 OR a > depth * 25) AND depth <= 3 THEN 8 END AS condition FROM y WHERE spot > 1 AND spot < n AND start > 200 AND start + 200 < length),
    br AS (SELECT * FROM z WHERE condition IS NOT NULL
    UNION ALL SELECT ref, 0, start, 0, -1 FROM y WHERE spot = 1 AND start > 200
    UNION ALL SELECT ref, start, stop, depth, -2 FROM y WHERE spot = 1 AND stop > 200 AND depth <= 1 AND (a > 3 OR (length > stop + 200 AND past > 3))
    UNION ALL SELECT ref, start, stop, 0, -3 FROM y WHERE spot = n AND start < length - 200 AND start >= 200 AND depth <= 1 AND (b > 3 OR before > 3)
    UNION ALL SELECT ref, stop, length, depth, -4 FROM y WHERE spot = n AND stop + 200 < length)"""


@register(
    "w_breakpoints",
    f"WITH {BREAKS} SELECT * FROM br",
)
def w_breakpoints(spark, d):
    return I.breakpoints(intervals(spark, d), bounds(spark, d), ["ref"])


@register(
    "p_maximal_overlap",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 AS s1, l_partkey % 900 + 800 + l_quantity::BIGINT * 20 AS e1, l_suppkey * 7 % 900 AS s2, l_suppkey * 7 % 900 + 800 + l_quantity::BIGINT * 20 AS e2, 2000 AS n, l_returnflag = 'R' AS rev FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN rev THEN (s1 <= 300 OR e2 >= n - 300) AND (e1 >= n - 300 OR s2 <= 300) ELSE (s1 <= 300 OR s2 <= 300) AND (e1 >= n - 300 OR e2 >= n - 300) END AS maximal FROM a""",
)
def p_maximal_overlap(spark, d):
    span = 800 + F.col("l_quantity").cast("long") * 20
    s1, s2 = F.col("l_partkey") % 900, F.col("l_suppkey") * 7 % 900
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", I.maximal_overlap(s1, s1 + span, s2, s2 + span, F.lit(2000), F.lit(2000), F.col("l_returnflag") == "R", 300).alias("maximal"))


# Seed joins -----------------------------------------------------------------------------------------------------------

BOTH15 = f"{SQL_READS}, {SQL_CONTIGS}, {sql_kmers('reads', 'rk', 15, True)}, {sql_kmers('contigs', 'ck', 15, True)}"


def seeds15(spark, d):
    return K.extract(reads(spark, d), 15, drop_palindromes=False), K.extract(contigs(spark, d), 15, drop_palindromes=False)


@register(
    "j_minimizer_index",
    f"""WITH {SQL_READS}, {sql_kmers('reads', 'km', 15, True)}, c AS MATERIALIZED (SELECT kmer, count(*) AS many FROM km GROUP BY 1),
    h AS (SELECT many, sum(count(*)) OVER (ORDER BY many DESC) AS run, sum(count(*)) OVER () AS n FROM c GROUP BY many)
    SELECT kmer, many FROM c WHERE many < (SELECT max(many) FROM h WHERE run > n // 1000)""",
)
def j_minimizer_index(spark, d):
    index = J.seed_index(seeds15(spark, d)[0], share=1000, least_keys=0)
    return index.groupBy("kmer").agg(F.max("many").alias("many")).select(S.decode_kmer(F.col("kmer"), 15).alias("kmer"), "many")


@register("j_anchor_probe", f"WITH {BOTH15} SELECT rk.id AS query, ck.id AS ref, count(*) AS anchors, min(rk.pos) AS first, max(rk.pos) AS last, count(*) FILTER (WHERE rk.forward = ck.forward) AS same FROM rk JOIN ck USING (kmer) GROUP BY 1, 2")
def j_anchor_probe(spark, d):
    r, c = seeds15(spark, d)
    hits = J.anchors(r, J.seed_index(c), pair=F.lit(True))
    return hits.groupBy("query", "ref").agg(F.count("*").alias("anchors"), F.min("pos1").cast("long").alias("first"), F.max("pos1").cast("long").alias("last"), F.count_if("same_strand").alias("same"))


CANDIDATES = f"""{BOTH15}, len_c AS (SELECT id, length(seq) AS n FROM contigs), len_r AS (SELECT id, length(seq) AS n FROM reads),
  hit AS (SELECT c.id AS query, r.id AS ref, count(*) AS shared, min(c.pos) AS first, max(c.pos) AS last FROM ck c JOIN (SELECT DISTINCT id, kmer FROM rk) r USING (kmer) GROUP BY 1, 2),
  cand AS (SELECT hit.*, row_number() OVER (PARTITION BY query ORDER BY (last - first) * shared DESC, ref) AS rank FROM hit JOIN len_c q ON query = q.id JOIN len_r t ON ref = t.id WHERE t.n > q.n AND last - first + 20 > 0.9 * q.n)"""


def containment(spark, d):
    r, c = seeds15(spark, d)
    shift = 1 << 40
    moved = lambda df: df.withColumn("id", F.col("id") + shift)
    lengths = reads(spark, d).select("id", F.length("seq").alias("n")).union(moved(contigs(spark, d)).select("id", F.length("seq").alias("n")))
    found = J.candidates(moved(c), r, lengths, slack=20)
    return found.withColumn("query", F.col("query") - shift)


@register("j_candidates_span", f"WITH {CANDIDATES} SELECT query, ref, shared, first, last FROM cand WHERE rank <= 500")
def j_candidates_span(spark, d):
    return containment(spark, d).select("query", "ref", "shared", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@register("j_outer_antijoin", f"WITH {CANDIDATES} SELECT id, length(seq) AS bases FROM contigs WHERE id NOT IN (SELECT query FROM cand)")
def j_outer_antijoin(spark, d):
    return J.outer_reads(contigs(spark, d), containment(spark, d)).select("id", F.length("seq").cast("long").alias("bases"))


@register("o_topk_candidates", f"WITH {CANDIDATES} SELECT query, ref, rank FROM cand WHERE rank <= 3")
def o_topk_candidates(spark, d):
    return containment(spark, d).where("rank <= 3").select("query", "ref", F.col("rank").cast("long").alias("rank"))


@register("j_semijoin", f"WITH {BOTH15} SELECT id, count(*) AS hits FROM rk WHERE kmer IN (SELECT kmer FROM ck) GROUP BY id")
def j_semijoin(spark, d):
    r, c = seeds15(spark, d)
    return r.join(c.select("kmer").distinct(), "kmer", "left_semi").groupBy("id").agg(F.count("*").alias("hits"))


@register("j_antijoin", f"WITH {BOTH15} SELECT id, count(*) AS novel FROM rk WHERE kmer NOT IN (SELECT kmer FROM ck) GROUP BY id")
def j_antijoin(spark, d):
    r, c = seeds15(spark, d)
    return r.join(c.select("kmer").distinct(), "kmer", "left_anti").groupBy("id").agg(F.count("*").alias("novel"))


@register(
    "j_snpmer_sites",
    f"""WITH {SQL_CONTIGS}, {SQL_READS}, {sql_kmers('contigs', 'ck', 15)}, {sql_kmers('reads', 'rk', 15)},
    a AS (SELECT DISTINCT id, split, substr(kmer, 8, 1) AS mid FROM ck), b AS (SELECT DISTINCT id, split, substr(kmer, 8, 1) AS mid FROM rk)
    SELECT a.id AS query, b.id AS ref, count(*) FILTER (WHERE a.mid = b.mid) AS shared, count(*) FILTER (WHERE a.mid <> b.mid) AS differing FROM a JOIN b USING (split) GROUP BY 1, 2""",
)
def j_snpmer_sites(spark, d):
    r, c = (K.extract(x, 15).select("id", S.masked(F.col("kmer"), 15).alias("split"), S.middle(F.col("kmer"), 15).alias("mid")).distinct() for x in (reads(spark, d), contigs(spark, d)))
    shift = 1 << 40
    sites = J.shared_sites(c.withColumn("id", F.col("id") + shift), r)
    return sites.withColumn("query", F.col("query") - shift)


MARKERS = f"""{SQL_READS}, {sql_kmers('reads', 'km', 21, True)}, h AS (SELECT DISTINCT id, ('0x' || substr(md5(kmer), 1, 15))::BIGINT AS marker FROM km), m0 AS (SELECT * FROM h WHERE marker < 1152921504606846976 // 20),
  mc AS (SELECT marker, count(*) AS many FROM m0 GROUP BY 1), mo AS (SELECT many, row_number() OVER (ORDER BY many DESC) - 1 AS i, count(*) OVER () AS n FROM mc),
  m AS (SELECT m0.* FROM m0 JOIN mc USING (marker) WHERE many < (SELECT many FROM mo WHERE i = n // 1000)),
  sz AS (SELECT id, count(*) AS n FROM m GROUP BY id),
  tri AS (SELECT a.id AS ref, b.id AS query, count(*) AS shared FROM m a JOIN m b USING (marker) WHERE a.id < b.id GROUP BY 1, 2),
  scr AS (SELECT ref, query, shared, x.n AS ref_markers, y.n AS query_markers FROM tri JOIN sz x ON ref = x.id JOIN sz y ON query = y.id WHERE shared > greatest(least(x.n, y.n) * pow(0.9, 21), 1))"""


CUT = """m AS (SELECT m0.* FROM m0 JOIN mc USING (marker) WHERE many < (SELECT many FROM mo WHERE i = n // 1000))"""


def every_marker(name: str) -> None:
    """The query ``name`` again under its own key, with SQL that leaves no marker out, as the operator does."""
    register(f"{name}_all_markers", catalog.oracle_sql()[name].replace(CUT, "m AS (SELECT * FROM m0)"))(catalog.queries()[name])


def screened(spark, d):
    return J.marker_screen(stored(ani.markers(reads(spark, d), 21, 20), "markers"))


@register("j_triangle", f"WITH {MARKERS} SELECT * FROM scr")
def j_triangle(spark, d):
    return screened(spark, d)


@register("k_pair_identity", f"WITH {MARKERS} SELECT ref, query, round(pow(shared / least(ref_markers, query_markers), 1 / 21.0), 6) AS identity FROM scr")
def k_pair_identity(spark, d):
    return screened(spark, d).select("ref", "query", F.round(ani.seed_identity(F.col("shared"), F.least("ref_markers", "query_markers"), 21), 6).alias("identity"))


def derep_pairs(spark, d):
    shared = F.col("shared")
    return screened(spark, d).select(
        "ref", "query", F.pow(shared / F.least("ref_markers", "query_markers"), F.lit(1 / 21.0)).alias("ani"), (shared / F.col("ref_markers")).alias("af_ref"), (shared / F.col("query_markers")).alias("af_query")
    )


@register(
    "k_dereplicate",
    f"""WITH {MARKERS}, c AS (SELECT id, length(seq) AS length, id % 7 = 0 AS circ, 1 + (id % 5) * 0.1 AS mult FROM reads),
    p AS (SELECT ref, query, pow(shared / least(ref_markers, query_markers), 1 / 21.0) AS ani, shared / ref_markers AS af_r, shared / query_markers AS af_q, r.length AS lr, q.length AS lq, r.circ AS cr, q.circ AS cq, r.mult AS mr, q.mult AS mq
      FROM scr JOIN c r ON ref = r.id JOIN c q ON query = q.id WHERE NOT (r.length > 500000 AND q.length > 500000)),
    s AS (SELECT *, lq < lr OR (lq = lr AND query < ref) AS qs FROM p),
    t AS (SELECT *, CASE WHEN qs THEN query ELSE ref END AS small, CASE WHEN qs THEN ref ELSE query END AS large, CASE WHEN qs THEN mr ELSE mq END AS lmult, CASE WHEN qs THEN cq ELSE cr END AS scirc,
      CASE WHEN lq / lr > 0.66 AND lq / lr < 1 / 0.66 AND cq AND NOT cr THEN ref WHEN lq / lr > 0.66 AND lq / lr < 1 / 0.66 AND cr AND NOT cq THEN query WHEN qs THEN query ELSE ref END AS chosen FROM s),
    v AS (SELECT CASE WHEN (af_r > 0.9 OR af_q > 0.9) AND ani > 0.98 AND lmult > 1.25 AND greatest(lq, lr) < 1000000 THEN [large, 2]
        WHEN (af_r > 0.99 OR af_q > 0.99) AND ani > 0.999 THEN CASE WHEN (CASE WHEN chosen = query THEN lq ELSE lr END) < 150000 THEN [chosen, 2] END
        WHEN (af_r > 0.9 OR af_q > 0.9) AND ani > 0.99 AND ((least(lq, lr) < 500000 AND NOT scirc) OR (af_r > 0.9 AND af_q > 0.9 AND least(lq, lr) < 100000)) THEN [small, 1] END AS v FROM t),
    f AS (SELECT v[1] AS id, max(v[2]) AS k FROM v WHERE v IS NOT NULL GROUP BY 1)
    SELECT c.id, CASE k WHEN 2 THEN 'duplicate' WHEN 1 THEN 'alternate' ELSE 'primary' END AS class FROM c LEFT JOIN f ON c.id = f.id""",
)
def k_dereplicate(spark, d):
    sized = reads(spark, d).select("id", F.length("seq").alias("length"), (F.col("id") % 7 == 0).alias("circular"), (1 + (F.col("id") % 5) * F.lit(0.1)).alias("multiplicity"))
    return ani.classify(sized, derep_pairs(spark, d))


@register("s_triangle_sink", f"WITH {MARKERS} SELECT ref, ref || chr(9) || string_agg(printf('%.4f', pow(shared / least(ref_markers, query_markers), 1 / 21.0)), chr(9) ORDER BY query) AS line FROM scr GROUP BY ref")
def s_triangle_sink(spark, d):
    return ani.triangle_rows(derep_pairs(spark, d))


@register("s_best_hits", f"WITH {MARKERS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pow(shared / least(ref_markers, query_markers), 1 / 21.0) DESC, ref) AS rank FROM scr) SELECT query, ref, rank FROM r WHERE rank <= 2")
def s_best_hits(spark, d):
    return ani.best_hits(derep_pairs(spark, d), 2).select("query", "ref", F.col("rank").cast("long").alias("rank"))


@register(
    "j_strain_repeat",
    """WITH mem AS (SELECT DISTINCT l_suppkey AS contig, l_orderkey AS read FROM lineitem), sim AS (SELECT o_orderkey AS read, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS other FROM orders),
    met AS (SELECT a.contig, b.contig AS other, a.read FROM mem a JOIN sim ON a.read = sim.read JOIN mem b ON b.read = sim.other WHERE a.contig <> b.contig),
    n AS (SELECT contig, other, count(DISTINCT read) AS reads FROM met GROUP BY 1, 2), z AS (SELECT contig, count(*) AS size FROM mem GROUP BY 1)
    SELECT contig, other, reads, size FROM n JOIN z USING (contig) WHERE reads * 2 > size""",
)
def j_strain_repeat(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_orderkey").alias("read")).distinct()
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    similar = table(spark, d, "orders").select(F.col("o_orderkey").alias("read"), after.alias("other_read")).where("other_read IS NOT NULL")
    return J.strain_repeats(members, similar)


OVERLAPS = """ol AS (SELECT l_suppkey AS read_i, l_partkey % 50 AS read_j, l_returnflag = 'N' AS f1, l_linestatus = 'O' AS f2, l_quantity::BIGINT * 100 AS o1, l_quantity::BIGINT * 90 + l_linenumber AS o2, l_partkey % 31 AS h1, l_orderkey % 37 AS h2 FROM lineitem)"""


@register(
    "w_best_overlap",
    f"""WITH {OVERLAPS}, s AS (SELECT *, o1 + o2 - h1 - h2 AS score FROM ol), b AS (SELECT *, row_number() OVER (PARTITION BY read_i, read_j, f1 ORDER BY score DESC, o1 DESC, h1, h2, f2) AS k FROM s),
    c AS (SELECT *, min((f1 <> f2)::INT) OVER p = max((f1 <> f2)::INT) OVER p AS agree, row_number() OVER (PARTITION BY read_i, read_j ORDER BY score DESC, f1 DESC) AS place FROM b WHERE k = 1 WINDOW p AS (PARTITION BY read_i, read_j))
    SELECT read_i, read_j, f1 AS forward1, score FROM c WHERE agree OR place = 1""",
)
def w_best_overlap(spark, d):
    q = F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("read_i"), (F.col("l_partkey") % 50).alias("read_j"), (F.col("l_returnflag") == "N").alias("forward1"), (F.col("l_linestatus") == "O").alias("forward2"),
        (q * 100).alias("overlap1_len"), (q * 90 + F.col("l_linenumber")).alias("overlap2_len"), (F.col("l_partkey") % 31).alias("hang1"), (F.col("l_orderkey") % 37).alias("hang2"),
    )
    return J.best_overlaps(rows).select("read_i", "read_j", "forward1", "score")


@register("p_contained", "SELECT l_orderkey, l_linenumber, l_quantity * 40 + 10 * 11 > 0.95 * (l_partkey % 2000 + 100) AND l_discount < 0.05 AND l_partkey % 2000 + 100 < 1500 AS inside FROM lineitem")
def p_contained(spark, d):
    length = F.col("l_partkey") % 2000 + 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", J.contained(F.lit(0), F.col("l_quantity") * 40, length, F.lit(1500), F.col("l_discount") < 0.05, 10, 11).alias("inside"))


# Graphs ---------------------------------------------------------------------------------------------------------------


@register("g_degree", f"WITH {SQL_EDGES}, {SQL_HALF} SELECT node, count(*) FILTER (WHERE side) AS out_degree, count(*) FILTER (WHERE NOT side) AS in_degree FROM half GROUP BY node")
def g_degree(spark, d):
    return G.degrees(edges(spark, d))


@register("g_components", "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1")
def g_components(spark, d):
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return G.components(table(spark, d, "orders").select(F.col("o_orderkey").alias("node1"), after.alias("node2")).where("node2 IS NOT NULL"))


@register(
    "g_prune_low_minimizer",
    f"""WITH {SQL_EDGES}, {SQL_HALF}, b AS (SELECT node, side, min(overlap / shared_minimizers) AS best FROM half GROUP BY 1, 2)
    SELECT edge_id FROM edges JOIN b x ON node1 = x.node AND dir1 = x.side JOIN b y ON node2 = y.node AND dir2 = y.side WHERE overlap / shared_minimizers / 9 <= 8 AND overlap / shared_minimizers / greatest(x.best, y.best) <= 5""",
)
def g_prune_low_minimizer(spark, d):
    return G.prune_low_minimizer(edges(spark, d), 9).select("edge_id")


@register("g_unique_length", f"WITH {SQL_EDGES}, {SQL_HALF}, m AS (SELECT node, max(overlap) AS most FROM half WHERE node <> other GROUP BY 1), n AS (SELECT DISTINCT node, 3000 + node % 5000 AS length FROM half) SELECT n.node, greatest(0, length - coalesce(most, 0)) AS unique_length FROM n LEFT JOIN m USING (node)")
def g_unique_length(spark, d):
    e = edges(spark, d)
    nodes = G.half_edges(e).select("node", (3000 + F.col("node") % 5000).alias("length")).distinct()
    return G.unique_lengths(nodes, e)


#: A sparse graph of consecutive orders of a customer and of a clerk-like key, so that degrees stay small.
SQL_SPARSE = """o AS (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice)::BIGINT AS p FROM orders),
  links AS (SELECT k AS a, lead(k) OVER (PARTITION BY c ORDER BY k) AS b, p FROM o UNION ALL SELECT k, lead(k) OVER (PARTITION BY p % 997 ORDER BY k), p FROM o WHERE p % 3 = 0),
  edges AS (SELECT row_number() OVER (ORDER BY a, b, p) AS edge_id, a AS node1, b AS node2, p % 5 > 0 AS dir1, p % 7 = 0 AS dir2, 500 + p % 1500 AS overlap, p % 4 AS diff_snpmers, p % 17 AS shared_snpmers, 10 + p % 90 AS shared_minimizers FROM links WHERE b IS NOT NULL)"""


def sparse(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.floor("o_totalprice").cast("long").alias("p"))
    one = o.select(F.col("k").alias("a"), F.lead("k").over(Window.partitionBy("c").orderBy("k")).alias("b"), "p")
    two = o.where("p % 3 = 0").select(F.col("k").alias("a"), F.lead("k").over(Window.partitionBy(F.col("p") % 997).orderBy("k")).alias("b"), "p")
    p = F.col("p")
    links = one.union(two).where("b IS NOT NULL")
    return links.select(
        F.row_number().over(Window.orderBy("a", "b", "p")).cast("long").alias("edge_id"), F.col("a").alias("node1"), F.col("b").alias("node2"), (p % 5 > 0).alias("dir1"), (p % 7 == 0).alias("dir2"),
        (500 + p % 1500).alias("overlap"), (p % 4).alias("diff_snpmers"), (p % 17).alias("shared_snpmers"), (10 + p % 90).alias("shared_minimizers"),
    )


@register(
    "g_transitive_reduction",
    f"""WITH {SQL_SPARSE}, {SQL_HALF}, sz AS (SELECT k AS node, 2000 + k % 1000 AS size FROM o),
    h AS (SELECT half.*, x.size + y.size - overlap AS length FROM half JOIN sz x ON node1 = x.node JOIN sz y ON node2 = y.node WHERE half.node <> other),
    l AS (SELECT node, side, max(length) AS longest FROM h GROUP BY 1, 2),
    p AS (SELECT DISTINCT f.node AS a, f.side AS asd, s.other AS c, s.other_side AS cs FROM h f JOIN h s ON f.other = s.node AND f.other_side <> s.side JOIN sz ON sz.node = f.other JOIN l ON l.node = f.node AND l.side = f.side
      WHERE f.node <> s.other AND greatest(0, f.length + s.length - sz.size) <= longest + 750)
    SELECT DISTINCT edge_id FROM h JOIN p ON h.node = a AND h.side = asd AND h.other = c AND h.other_side = cs""",
)
def g_transitive_reduction(spark, d):
    lengths = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), (2000 + F.col("o_orderkey") % 1000).alias("size"))
    return G.transitive_edges(sparse(spark, d), lengths)


@register(
    "g_z_edges",
    f"""WITH {SQL_SPARSE}, {SQL_HALF}, dg AS (SELECT node, side, count(*) AS n FROM half GROUP BY 1, 2), h AS (SELECT half.*, x.n, y.n AS other_n FROM half JOIN dg x ON half.node = x.node AND half.side = x.side JOIN dg y ON other = y.node AND other_side = y.side)
    SELECT DISTINCT m.edge_id FROM h m JOIN h a ON a.node = m.node AND a.side = m.side AND a.edge_id <> m.edge_id JOIN h b ON b.node = m.other AND b.side = m.other_side AND b.edge_id <> m.edge_id
    WHERE m.n = 2 AND m.other_n = 2 AND a.other_n = 1 AND a.edge_id <> b.edge_id AND a.overlap > m.overlap AND a.diff_snpmers <= m.diff_snpmers AND a.shared_minimizers > m.shared_minimizers
      AND b.overlap > m.overlap AND b.diff_snpmers <= m.diff_snpmers AND b.shared_minimizers > m.shared_minimizers""",
)
def g_z_edges(spark, d):
    return G.z_edges(sparse(spark, d))


@register(
    "g_dominated_edges",
    f"""WITH {SQL_SPARSE}, {SQL_HALF} SELECT x.edge_id, round(min(x.overlap / y.overlap), 6) AS ratio FROM half x JOIN half y ON x.node = y.node AND x.side = y.side AND x.edge_id <> y.edge_id
    WHERE x.diff_snpmers > 0 AND y.diff_snpmers = 0 AND y.overlap > x.overlap AND y.shared_snpmers > x.shared_snpmers AND y.shared_minimizers > x.shared_minimizers GROUP BY 1""",
)
def g_dominated_edges(spark, d):
    return G.dominated_edges(sparse(spark, d)).select("edge_id", F.round("ratio", 6).alias("ratio"))


@register("g_simple_links", f"WITH {SQL_SPARSE}, {SQL_HALF}, s AS (SELECT node, side FROM half GROUP BY 1, 2 HAVING count(*) = 1) SELECT edge_id FROM edges WHERE node1 <> node2 AND (node1, dir1) IN (SELECT (node, side) FROM s) AND (node2, dir2) IN (SELECT (node, side) FROM s)")
def g_simple_links(spark, d):
    return G.simple_links(sparse(spark, d)).select("edge_id")


#: Tips of the graph of a customer's orders, whose components are known without iteration.
@register(
    "g_tips",
    """WITH e AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, 500 + o_orderkey % 4000 AS length, 1 + o_orderkey % 9 AS reads FROM orders),
    t AS (SELECT c, sum(length) AS al, sum(reads) AS ar FROM e GROUP BY c)
    SELECT k AS node FROM e JOIN t USING (c) WHERE (i = 1 OR i = n) AND (length <= least(2000, floor(al / 10)) OR reads <= least(3, floor(ar / 10)))""",
)
def g_tips(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey")
    line = Window.partitionBy("o_custkey").orderBy("node")
    chain = o.select(F.col("node").alias("node1"), F.lead("node").over(line).alias("node2"), F.lit(True).alias("dir1"), F.lit(False).alias("dir2"), F.col("node").alias("edge_id")).where("node2 IS NOT NULL")
    nodes = o.select("node", (500 + F.col("node") % 4000).alias("length"), (1 + F.col("node") % 9).alias("reads"), (500 + F.col("node") % 4000).alias("unique_length"))
    return G.tips(nodes, chain, 2000, 3)


@register("g_unitigs", "SELECT min(o_orderkey) OVER (PARTITION BY o_custkey) AS unitig, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS at FROM orders")
def g_unitigs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey")
    line = Window.partitionBy("o_custkey").orderBy("node")
    chain = o.select(F.col("node").alias("node1"), F.lead("node").over(line).alias("node2"), F.lit(True).alias("dir1"), F.lit(False).alias("dir2"), F.col("node").alias("edge_id")).where("node2 IS NOT NULL")
    return G.unitigs(o.select("node"), chain).select("unitig", "node", F.col("at").cast("long").alias("at"))


@register("p_abundance", "SELECT ref, reads, CASE WHEN reads = 1 THEN NOT (depth <= 3) WHEN reads <= 2 AND ref % 2 = 1 THEN NOT (depth <= 1) ELSE true END AS kept FROM (SELECT l_partkey AS ref, count(*) AS reads, avg(l_quantity) / 10 AS depth FROM lineitem GROUP BY 1)")
def p_abundance(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ref")).agg(F.count("*").alias("reads"), (F.avg("l_quantity") / 10).alias("dp1"))
    rows = rows.withColumn("dp3", F.col("dp1")).withColumn("circular", F.col("ref") % 2 == 0)
    return rows.select("ref", "reads", G.passes_abundance().alias("kept"))


# Orders and sets ------------------------------------------------------------------------------------------------------


@register("o_edge_order", f"WITH {SQL_EDGES} SELECT edge_id, row_number() OVER (PARTITION BY node2 ORDER BY overlap DESC, node1, edge_id) AS place FROM edges")
def o_edge_order(spark, d):
    order = Window.partitionBy("node2").orderBy(F.desc("overlap"), "node1", "edge_id")
    return edges(spark, d).select("edge_id", F.row_number().over(order).cast("long").alias("place"))


@register("u_union_inputs", f"WITH {SQL_READS}, {SQL_CONTIGS} SELECT 'read' AS origin, id, length(seq) AS bases FROM reads UNION ALL SELECT 'contig', id, length(seq) FROM contigs")
def u_union_inputs(spark, d):
    part = lambda df, name: df.select(F.lit(name).alias("origin"), "id", F.length("seq").cast("long").alias("bases"))
    return part(reads(spark, d), "read").unionByName(part(contigs(spark, d), "contig"))


@register("u_set_diff", f"WITH {BOTH15} SELECT kmer FROM ck EXCEPT SELECT kmer FROM rk")
def u_set_diff(spark, d):
    r, c = seeds15(spark, d)
    return c.select("kmer").subtract(r.select("kmer")).select(S.decode_kmer(F.col("kmer"), 15).alias("kmer"))


@register("u_intersect_markers", f"WITH {BOTH15} SELECT kmer FROM ck INTERSECT SELECT kmer FROM rk")
def u_intersect_markers(spark, d):
    r, c = seeds15(spark, d)
    return c.select("kmer").intersect(r.select("kmer")).select(S.decode_kmer(F.col("kmer"), 15).alias("kmer"))


for _name in ("j_triangle", "k_pair_identity", "k_dereplicate", "s_triangle_sink", "s_best_hits"):
    every_marker(_name)
