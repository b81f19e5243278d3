"""Queries: scalar sequence functions, k-mer tables, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import stats as T
from ..operators import kmers as K
from ..operators import seeding as J
from .catalog import register
from .stand_ins import SQL_CONTIGS, SQL_READS, contigs, reads, sql_kmers, table


@register("f_revcomp", f"WITH {SQL_READS} SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def f_revcomp(spark, d):
    return reads(spark, d).select("id", S.revcomp(F.col("seq")).alias("rc"))


@register("f_homopolymer", f"WITH {SQL_READS} SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') AS hpc FROM reads")
def f_homopolymer(spark, d):
    return reads(spark, d).select("id", S.compress_homopolymers(F.col("seq")).alias("hpc"))


@register("f_first_word", r"SELECT conv_id, turn, regexp_extract(text, '^\s*(\S+)', 1) AS word FROM conversations")
def f_first_word(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.first_word(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("word"))


@register("f_length_filter", f"WITH {SQL_READS} SELECT id, length(seq) AS bases FROM reads WHERE length(seq) >= 1000")
def f_length_filter(spark, d):
    return reads(spark, d).select("id", F.length("seq").cast("long").alias("bases")).where("bases >= 1000")


@register("f_split_kmer", f"WITH {SQL_CONTIGS}, {sql_kmers('contigs', 'km', 21)} SELECT id, pos, kmer, forward, split FROM km")
def f_split_kmer(spark, d):
    km = K.extract(contigs(spark, d), 21)
    text = S.decode_kmer(F.col("kmer"), 21)
    return km.select("id", F.col("pos").cast("long"), text.alias("kmer"), "forward", S.mask_string(text, 21).alias("split"))


@register("f_qual_identity", "SELECT l_orderkey, round(100 * (1 - avg(pow(10, -l_quantity / 10))), 6) AS identity FROM lineitem GROUP BY 1")
def f_qual_identity(spark, d):
    quals = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("q"))
    return quals.select("l_orderkey", F.round(S.phred_identity(F.col("q")), 6).alias("identity"))


@register("f_quality_bins", "SELECT l_orderkey, l_linenumber, least(greatest(floor((l_quantity + 33 - 33) / 3.0 + 0.5), 0), 15)::INT AS bin, least(greatest(floor(l_quantity / 3.0 + 0.5), 0), 15)::INT * 3 + 33 AS value FROM lineitem")
def f_quality_bins(spark, d):
    code = S.quality_bin(F.col("l_quantity") + 33)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("bin"), S.bin_quality(code).alias("value"))


@register(
    "f_block_minimum",
    """WITH a AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i FROM lineitem)
    SELECT l_orderkey, i // 4 AS block, min(l_quantity) AS low FROM a GROUP BY 1, 2""",
)
def f_block_minimum(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("a"))
    low = S.block_minimum(F.transform("a", lambda x: x["l_quantity"]))
    return rows.select("l_orderkey", F.posexplode(low).alias("block", "low")).withColumn("block", F.col("block").cast("long"))


ORDER_LISTS = "WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS p FROM orders GROUP BY 1)"


def order_lists(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("p"))


@register("f_delta_positions", ORDER_LISTS + " SELECT o_custkey, array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = 1 THEN p[1] ELSE p[i] - p[i - 1] END), ',') AS steps, array_to_string(p, ',') AS back FROM a")
def f_delta_positions(spark, d):
    steps = order_lists(spark, d).withColumn("s", S.deltas(F.col("p")))
    return steps.select("o_custkey", F.array_join("s", ",").alias("steps"), F.array_join(S.undeltas(F.col("s")), ",").alias("back"))


@register("f_clip_shift", ORDER_LISTS + " SELECT o_custkey, array_to_string(list_transform(list_filter(p, lambda x: x >= 100 AND x < 9000), lambda x: x - 100), ',') AS clipped FROM a")
def f_clip_shift(spark, d):
    return order_lists(spark, d).select("o_custkey", F.array_join(S.clip_shift(F.col("p"), F.lit(100), F.lit(9000)), ",").alias("clipped"))


@register("f_nth_minimizer", ORDER_LISTS + " SELECT o_custkey, coalesce(list_filter(p, lambda x: x >= 50 AND x <= 12000)[3], 50) AS lo, coalesce(list_reverse(list_filter(p, lambda x: x >= 50 AND x <= 12000))[3], 12000) AS hi FROM a")
def f_nth_minimizer(spark, d):
    ends = S.nth_from_ends(F.col("p"), 3, F.lit(50).cast("long"), F.lit(12000).cast("long"))
    return order_lists(spark, d).select("o_custkey", ends["left"].alias("lo"), ends["right"].alias("hi"))


@register("f_keep_indices", ORDER_LISTS + " SELECT o_custkey, array_to_string(list_filter([p[1], p[3], p[4]], lambda x: x IS NOT NULL), ',') AS kept FROM a")
def f_keep_indices(spark, d):
    return order_lists(spark, d).select("o_custkey", F.array_join(S.keep_indices(F.col("p"), F.array(F.lit(0), F.lit(2), F.lit(3))), ",").alias("kept"))


@register("f_rounded_div", "SELECT o_orderkey, (o_custkey + 7 // 2) // 7 AS rounded FROM orders")
def f_rounded_div(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.rounded_div(F.col("o_custkey"), F.lit(7)).alias("rounded"))


@register("f_hang_minimizers", "SELECT o_orderkey, least(100, floor(20 / pow((90 + o_orderkey % 11) / 100.0, 21)))::INT AS n FROM orders")
def f_hang_minimizers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.hang_minimizers(90 + F.col("o_orderkey") % 11, 21).alias("n"))


@register(
    "f_cigar",
    """WITH a AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'D' WHEN 'R' THEN 'I' ELSE 'M' END AS op, l_quantity::INT AS n,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i FROM lineitem),
    b AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey, op ORDER BY i) AS g FROM a),
    c AS (SELECT l_orderkey, op, sum(n) AS n, min(i) AS i FROM b GROUP BY l_orderkey, op, g)
    SELECT l_orderkey, string_agg(n || op, '' ORDER BY i) AS cigar, sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END)::INT AS ref_bases, sum(CASE WHEN op IN ('M', 'I') THEN n ELSE 0 END)::INT AS query_bases
    FROM c GROUP BY 1""",
)
def f_cigar(spark, d):
    op = F.when(F.col("l_returnflag") == "A", "D").when(F.col("l_returnflag") == "R", "I").otherwise(F.when(F.col("l_linenumber") % 2 == 0, "=").otherwise("X"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", op.alias("op"), F.col("l_quantity").cast("int").alias("len")))).alias("a"))
    merged = rows.withColumn("c", S.merge_cigar(F.transform("a", lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len")))))
    size = S.cigar_lengths(F.col("c"))
    return merged.select("l_orderkey", S.cigar_string(F.col("c")).alias("cigar"), size["ref"].alias("ref_bases"), size["query"].alias("query_bases"))


MD5 = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def md5_hash(col):
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, 15), 16, 10).cast("long")


@register(
    "f_minimizer_window",
    f"""WITH {SQL_READS}, {sql_kmers('reads', 'km', 15, True)}, h AS (SELECT id, pos, {MD5.format('kmer')} AS hash FROM km),
    w AS (SELECT id, pos, min(hash) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS low, count(*) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM h)
    SELECT id, count(DISTINCT low) AS minimizers, count(*) AS windows FROM w WHERE n = 10 GROUP BY id""",
)
def f_minimizer_window(spark, d):
    km = K.extract(reads(spark, d), 15, drop_palindromes=False).select("id", "pos", md5_hash(S.decode_kmer(F.col("kmer"), 15)).alias("hash"))
    last = Window.partitionBy("id").orderBy("pos").rowsBetween(-9, 0)
    low = km.select("id", F.min("hash").over(last).alias("low"), F.count("*").over(last).alias("n")).where("n = 10")
    each = low.groupBy("id", "low").agg(F.count("*").alias("w"))
    return each.groupBy("id").agg(F.count("*").alias("minimizers"), F.sum("w").alias("windows"))


@register("f_fracminhash", f"WITH {SQL_READS}, {sql_kmers('reads', 'km', 21, True)}, h AS (SELECT DISTINCT id, {MD5.format('kmer')} AS marker FROM km) SELECT id, marker FROM h WHERE marker < 1152921504606846976 // 30")
def f_fracminhash(spark, d):
    from ..operators.ani import markers

    return markers(reads(spark, d), 21, 30)


@register("f_syncmers")
def f_syncmers(spark, d):
    return K.extract(reads(spark, d), 21, drop_palindromes=False, syncmers=11).groupBy("id").agg(F.count("*").alias("syncmers"), F.min("pos").alias("first"), F.max("pos").alias("last"))


LOG_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"


def sql_fisher(source: str, key: str, a: str, b: str, c: str, d: str, out: str) -> str:
    """CTEs that leave ``out`` (key, p): the two-sided exact test of a 2 x 2 table by summing all tables that are no likelier."""
    n = f"({a} + {b} + {c} + {d})"
    return f"""{out}_x AS (SELECT {key}, {a} AS seen, {a} + {b} AS k, {a} + {c} AS m, {n} AS n, unnest(range(greatest(0, {a} - {d}), least({a} + {b}, {a} + {c}) + 1)) AS x FROM {source}),
{out}_p AS (SELECT {key}, seen, x, exp({LOG_CHOOSE.format('m', 'x')} + {LOG_CHOOSE.format('(n - m)', '(k - x)')} - ({LOG_CHOOSE.format('n', 'k')})) AS p FROM {out}_x),
{out} AS (SELECT q.{key}, least(1.0, sum(q.p)) AS p FROM {out}_p q JOIN {out}_p s ON q.{key} = s.{key} AND s.x = s.seen WHERE q.p <= s.p * (1 + 1e-7) GROUP BY 1)"""


K11 = f"WITH {SQL_READS}, {sql_kmers('reads', 'km', 11)}, c AS (SELECT kmer, split, substr(kmer, 6, 1) AS mid, count(*) FILTER (WHERE forward) AS n_forward, count(*) FILTER (WHERE NOT forward) AS n_reverse FROM km GROUP BY ALL)"


def counts11(spark, d):
    return K.strand_counts(K.extract(reads(spark, d), 11))


@register("a_kmer_count_strands", K11 + " SELECT kmer, n_forward, n_reverse FROM c WHERE n_forward > 0 AND n_reverse > 0 AND n_forward + n_reverse > 2")
def a_kmer_count_strands(spark, d):
    return K.solid(counts11(spark, d)).select(S.decode_kmer(F.col("kmer"), 11).alias("kmer"), "n_forward", "n_reverse")


@register(
    "a_high_freq_threshold",
    K11 + """, t AS (SELECT n_forward + n_reverse AS n, row_number() OVER (ORDER BY n_forward + n_reverse) - 1 AS i, count(*) OVER () AS many FROM c)
    SELECT greatest(100, n) AS threshold FROM t WHERE i = many - many // 1000 - 1""",
)
def a_high_freq_threshold(spark, d):
    return K.frequency_threshold(counts11(spark, d), F.col("n_forward") + F.col("n_reverse"), share=1000)


@register(
    "a_high_freq_kmers",
    K11.replace(", c AS (", ", c AS MATERIALIZED (") + """, t AS (SELECT n_forward + n_reverse AS n, sum(count(*)) OVER (ORDER BY n_forward + n_reverse) AS run, sum(count(*)) OVER () AS many FROM c GROUP BY 1)
    SELECT kmer, n_forward + n_reverse AS n FROM c WHERE n_forward + n_reverse > (SELECT greatest(100, min(n)) FROM t WHERE run > many - many // 1000 - 1)""",
)
def a_high_freq_kmers(spark, d):
    counts = counts11(spark, d).withColumn("n", F.col("n_forward") + F.col("n_reverse"))
    cut = K.frequency_threshold(counts, F.col("n"), share=1000)
    return counts.join(F.broadcast(cut), F.col("n") > F.col("threshold")).select(S.decode_kmer(F.col("kmer"), 11).alias("kmer"), "n")


@register(
    "a_snpmer_top2",
    K11 + """, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n_forward + n_reverse DESC, mid) AS k FROM c)
    SELECT split, max(mid) FILTER (WHERE k = 1) AS mid1, max(mid) FILTER (WHERE k = 2) AS mid2, max(n_forward + n_reverse) FILTER (WHERE k = 1) AS n1, max(n_forward + n_reverse) FILTER (WHERE k = 2) AS n2
    FROM r GROUP BY split HAVING count(*) > 1""",
)
def a_snpmer_top2(spark, d):
    pairs = K.allele_pairs(counts11(spark, d), 11)
    base = lambda c: F.substring(F.lit("ACGT"), F.col(c) + 1, 1)
    split = S.mask_string(S.decode_kmer(F.col("split"), 11), 11)
    letter = lambda c: F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), F.col(c) + 1)
    return pairs.select(split.alias("split"), letter("mid1").alias("mid1"), letter("mid2").alias("mid2"), "n1", "n2")


@register(
    "a_snpmers",
    K11 + """, r AS (SELECT split, strpos('ACGT', mid) - 1 AS mid, n_forward AS f, n_reverse AS r, n_forward + n_reverse AS n, row_number() OVER (PARTITION BY split ORDER BY n_forward + n_reverse DESC, mid) AS k FROM c WHERE n_forward > 0 AND n_reverse > 0 AND n_forward + n_reverse > 2),
    w AS (SELECT replace(x.split, '_', 'A') AS split, x.mid AS mid1, y.mid AS mid2, x.n AS n1, y.n AS n2, x.f AS f1, x.r AS r1, y.f AS f2, y.r AS r2 FROM r x JOIN r y ON x.split = y.split AND x.k = 1 AND y.k = 2),
    i AS (SELECT split, n1, unnest(range(0, n2 + 1)) AS i FROM w WHERE n2 < n1),
    e AS (SELECT split, 1 - sum(exp(lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1) + i * ln(0.025) + (n1 - i) * ln(0.975))) AS p FROM i GROUP BY 1),
    t AS (SELECT w.* FROM w LEFT JOIN e USING (split) WHERE coalesce(p, 0) <= 0.05), """ + sql_fisher("t", "split", "f1", "r1", "f2", "r2", "g") + """,
    o AS (SELECT t.*, g.p, CASE WHEN r1 * f2 = 0 THEN 'inf'::DOUBLE ELSE f1 * r2 / (r1 * f2) END AS odds FROM t JOIN g USING (split))
    SELECT split, mid1, mid2, n1, n2, round(p, 6) AS p_strand FROM o WHERE odds <> 0 AND (p > 0.005 OR (odds > 1 / 1.5 AND odds < 1.5))""",
)
def a_snpmers(spark, d):
    found = K.snpmers(K.allele_pairs(K.solid(counts11(spark, d)), 11))
    return found.select(S.decode_kmer(F.col("split"), 11).alias("split"), "mid1", "mid2", "n1", "n2", F.round("p_strand", 6).alias("p_strand"))


@register(
    "a_kmer_multiplicity",
    f"""WITH {SQL_CONTIGS}, {sql_kmers('contigs', 'km', 11)}, c AS (SELECT id, kmer, count(*) AS n FROM km GROUP BY 1, 2),
    r AS (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY n, kmer) - 1 AS i, count(*) OVER (PARTITION BY id) AS many FROM c)
    SELECT id, round(avg(n), 6) AS multiplicity FROM r WHERE i >= floor(many * 0.1) AND i < many - floor(many * 0.1) GROUP BY id""",
)
def a_kmer_multiplicity(spark, d):
    counts = K.extract(contigs(spark, d), 11).groupBy("id", "kmer").agg(F.count("*").alias("n"))
    return K.robust_multiplicity(counts, "id", "n").select("id", F.round("multiplicity", 6).alias("multiplicity"))


@register("a_read_multiplicity", f"WITH {SQL_READS}, {sql_kmers('reads', 'km', 11)}, c AS (SELECT id, kmer, count(*) AS n FROM km GROUP BY 1, 2) SELECT id, max(n) AS most, count(*) AS kinds FROM c GROUP BY id")
def a_read_multiplicity(spark, d):
    each = J.multiplicities(K.extract(reads(spark, d), 11))
    return each.groupBy("id").agg(F.max("n").alias("most"), F.count("*").alias("kinds"))


@register(
    "a_seed_density",
    f"""WITH {SQL_READS}, {sql_kmers('reads', 'km', 21, True)}, h AS (SELECT id, count(*) FILTER (WHERE {MD5.format('kmer')} < 1152921504606846976 // 11) AS seeds FROM km GROUP BY id)
    SELECT round(avg(seeds / length(seq)), 6) AS density, count(*) FILTER (WHERE seeds < length(seq) // 11 // 20) AS repetitive FROM h JOIN reads USING (id)""",
)
def a_seed_density(spark, d):
    src = reads(spark, d)
    km = K.extract(src, 21, drop_palindromes=False)
    seeds = km.groupBy("id").agg(F.count_if(md5_hash(S.decode_kmer(F.col("kmer"), 21)) < (1 << 60) // 11).alias("seeds"))
    both = seeds.join(src.select("id", F.length("seq").alias("bases")), "id")
    return both.agg(F.round(F.avg(F.col("seeds") / F.col("bases")), 6).alias("density"), F.count_if(J.seed_poor(F.col("seeds"), F.col("bases"), 11)).alias("repetitive"))


@register("p_identity_est", "SELECT l_orderkey, l_linenumber, round(1 - (l_partkey % 7) / (l_quantity * 11.0) / (1 + (l_partkey % 7) / (l_quantity * 11.0)), 6) AS identity FROM lineitem")
def p_identity_est(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.identity_estimate(F.col("l_partkey") % 7, F.col("l_quantity"), 11), 6).alias("identity"))


TAIL = "greatest(0, 1 - list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))))"


@register("p_binomial_tail", f"WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT + 10 AS n, l_linenumber::BIGINT AS k FROM lineitem) SELECT l_orderkey, l_linenumber, round({TAIL.format(p='0.025')}, 6) AS p FROM a")
def p_binomial_tail(spark, d):
    p = T.binomial_tail(F.col("l_quantity").cast("long") + 10, F.col("l_linenumber").cast("long"), F.lit(0.025))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 6).alias("p"))


@register(
    "p_same_strain",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 6 AS k, l_partkey % 6 + l_quantity::BIGINT AS n, 1 - ((l_partkey % 6) / (l_quantity * 11.0)) / (1 + (l_partkey % 6) / (l_quantity * 11.0)) AS i FROM lineitem)
    SELECT l_orderkey, l_linenumber, i * 100 >= 99.0 OR {TAIL.format(p='0.025')} > 0.05 AS same, k = 0 AS strict FROM a""",
)
def p_same_strain(spark, d):
    diff, shared = F.col("l_partkey") % 6, F.col("l_quantity").cast("long")
    lax = T.same_strain(shared, diff, shared, 11, 99.0, 0.025)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lax.alias("same"), T.same_strain(shared, diff, shared, 11, 100.0, 0.0).alias("strict"))


@register(
    "p_fisher_exact",
    "WITH t AS (SELECT l_suppkey, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{r}' AND l_linestatus = '{s}') AS {r}{s}" for r in "NR" for s in "OF")
    + " FROM lineitem GROUP BY 1), " + sql_fisher("t", "l_suppkey", "NO", "NF", "RO", "RF", "f") + " SELECT l_suppkey, round(p, 6) AS p FROM f",
)
def p_fisher_exact(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.count_if((F.col("l_returnflag") == r) & (F.col("l_linestatus") == s)).alias(f"{r}{s}") for r in "NR" for s in "OF"])
    return rows.select("l_suppkey", F.round(T.fisher_exact("NO", "NF", "RO", "RF"), 6).alias("p"))


@register("p_quality_filter", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL OR quality > 0")
def p_quality_filter(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").where("quality IS NULL OR quality > 0")


@register(
    "a_weighted_median",
    """WITH s AS (SELECT l_suppkey, l_discount AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM s)
    SELECT l_suppkey, min(v) AS median FROM r WHERE run >= 0.5 * total GROUP BY 1""",
)
def a_weighted_median(spark, d):
    return T.weighted_quantile(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity", 0.5, "median")


@register("a_median", "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def a_median(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.lit(0.5)).alias("median"))


NX = """WITH s AS (SELECT lang, n_chars AS v, sum(n_chars) AS w FROM documents GROUP BY 1, 2),
  r AS (SELECT *, sum(w) OVER (PARTITION BY lang ORDER BY v DESC) AS run, sum(w) OVER (PARTITION BY lang) AS total FROM s)"""


@register("a_nx", NX + " SELECT lang, max(v) FILTER (WHERE run >= 0.1 * total) AS n10, max(v) FILTER (WHERE run >= 0.5 * total) AS n50, max(v) FILTER (WHERE run >= 0.9 * total) AS n90 FROM r GROUP BY lang")
def a_nx(spark, d):
    return T.nx(table(spark, d, "documents"), ["lang"], "n_chars")


@register("a_assembly_stats", "SELECT lang, count(*) AS contigs, sum(n_chars)::BIGINT AS bases, max(n_chars) AS largest, count(*) FILTER (WHERE n_chars >= 2000) AS over_2k, count(*) FILTER (WHERE n_chars >= 10000) AS over_10k FROM documents GROUP BY lang")
def a_assembly_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("contigs"), F.sum("n_chars").alias("bases"), F.max("n_chars").alias("largest"), F.count_if(F.col("n_chars") >= 2000).alias("over_2k"), F.count_if(F.col("n_chars") >= 10000).alias("over_10k"))


@register("s_cov_ratio", "SELECT l_orderkey, l_linenumber, round((greatest(l_quantity, l_linenumber) + 3) / (least(l_quantity, l_linenumber) + 3), 6) AS ratio FROM lineitem")
def s_cov_ratio(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.coverage_ratio(F.col("l_quantity"), F.col("l_linenumber")), 6).alias("ratio"))


@register("s_poisson_kl", "SELECT l_orderkey, l_linenumber, round(sqrt(greatest(0, l_quantity * ln(l_quantity / l_linenumber) + l_linenumber - l_quantity)), 6) AS kl FROM lineitem")
def s_poisson_kl(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.poisson_kl_root(F.col("l_quantity"), F.col("l_linenumber")), 6).alias("kl"))
