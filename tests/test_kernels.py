"""Known values of the kernels."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.functions import stats as T
from strandmill.operators import chaining as C
from strandmill.operators import consensus as P
from strandmill.operators import graph as G
from strandmill.operators import intervals as I
from strandmill.operators import tables
from strandmill.operators.greedy import Edge, Graph


def code(kmer: str) -> int:
    return int("".join(str("ACGT".index(b)) for b in kmer), 4)


def test_packed_kmers():
    forward, reverse = S.packed_kmers(b"ACGTG", 5)
    assert int(forward[0]) == 0b0001101110
    assert int(reverse[0]) == code("CACGT") == 0b0100011011
    assert len(S.packed_kmers(b"ACG", 5)[0]) == 0


def test_canonical_agrees_between_strands():
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(300))
    other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = (sorted(S.canonical(*S.packed_kmers(s.encode(), 21), 21)[0].tolist()) for s in (seq, other))
    assert a == b


def test_hash_inverse():
    x = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    assert (S.unhash(S.wang_hash(x)) == x).all()
    assert (S.wang_hash(x) != S.wang_hash_variant(x)).all()


def test_syncmers_are_the_same_on_both_strands():
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGT") for _ in range(2000))
    other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = S.open_syncmers(seq.encode(), 21, 11), S.open_syncmers(other.encode(), 21, 11)
    assert 0 < len(a) < 400 and sorted(2000 - 21 - b) == sorted(a)


def test_minimizers():
    assert S.minimizers(np.array([5, 3, 9, 1, 7], np.uint64), 3).tolist() == [1, 3]
    assert len(S.minimizers(np.array([1], np.uint64), 3)) == 0


def test_codon_table():
    assert S.codon("ATG") == "M" and S.codon("TAA") == "*" and S.codon("TGG") == "W" and S.codon("ANG") == "X"
    assert S.open_frames("ATG" * 40, 30)[0] == (0, 0, 40)


@pytest.mark.parametrize("mini,diff,shared,error,expected", [(100, 10, 10, 0.025, False), (100, 1, 0, 0.025, True), (10000, 5, 0, 0.025, True), (10, 1, 0, 0.025, False), (100, 5, 10, 0.5, True)])
def test_same_strain(spark, mini, diff, shared, error, expected):
    row = spark.range(1).select(T.same_strain(F.lit(mini), F.lit(diff), F.lit(shared), 10, 99.9, error).alias("s")).first()
    assert row["s"] is expected


def test_binomial_and_fisher():
    assert T.binomial_tail_value(10, 10, 0.5) == 0
    assert T.binomial_tail_value(2, 0, 0.5) == pytest.approx(0.75)
    assert T.binomial_tail_value(100, 3, 0.025) == pytest.approx(0.2410, abs=1e-3)
    assert T.fisher_value(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-5)
    assert T.fisher_value(0, 5, 5, 0) == pytest.approx(0.007937, abs=1e-5)


@pytest.mark.parametrize("rows,expected", [([(1, 1), (2, 2), (3, 3)], 2), ([(1, 2), (5, 15)], 5), ([(1, 2), (2, 5), (3, 1)], 2), ([], None)])
def test_weighted_quantile(spark, rows, expected):
    df = spark.createDataFrame([(0, float(v), w) for v, w in rows], "g int, v double, w int")
    got = T.weighted_quantile(df, ["g"], "v", "w", 0.5).collect()
    assert (got[0]["quantile"] if got else None) == expected


def test_depth_distance():
    same = [([10.0, 8.0, 6.0], 5), ([12.0, 9.0, 7.0], 3)]
    assert T.log_depth_distance(same, same) == 0
    assert T.log_depth_distance(same, [([100.0, 90.0, 80.0], 1)]) > 1
    assert T.log_depth_distance([], same) is None


def anchors(points, reverse=False):
    p1, p2 = np.array([p for p, _ in points]), np.array([p for _, p in points])
    return p1, p2, np.full(len(points), not reverse)


def test_chain_scores():
    found = C.chains(*anchors([(20 * i, 20 * i) for i in range(5)]))
    assert [(s, len(c), r) for s, c, r in found] == [(50, 5, False)]
    assert C.chains(*anchors([(5, 5)]), least=1)[0][0] == 10
    assert C.chains(*anchors([])) == []
    back = C.chains(*anchors([(20 * i, 500 - 20 * i) for i in range(5)], reverse=True))
    assert [(s, len(c), r) for s, c, r in back] == [(50, 5, True)]


def test_chains_stay_apart():
    points = [(20 * i, 20 * i) for i in range(5)] + [(50_000 + 20 * i, 90_000 + 20 * i) for i in range(4)]
    assert sorted(len(c) for _, c, _ in C.chains(*anchors(points))) == [4, 5]
    p1, p2 = np.array([0, 20, 40, 60]), np.array([0, 20, 40, 60])
    assert C.chains(p1, p2, np.array([True, False, True, False])) == []


@pytest.mark.parametrize(
    "s1,e1,s2,e2,l1,l2,reverse,expected",
    [(0, 3000, 0, 3000, 3000, 3000, False, True), (0, 3000, 0, 3000, 3000, 3000, True, True), (500, 2500, 0, 2000, 3000, 2000, False, True), (1500, 2900, 100, 1500, 3000, 3000, False, True), (100, 1500, 1400, 2900, 3000, 3000, False, True), (100, 500, 2000, 2500, 3000, 3000, False, False), (1500, 3000, 0, 1500, 3000, 3000, True, False)],
)
def test_maximal_overlap(spark, s1, e1, s2, e2, l1, l2, reverse, expected):
    row = spark.range(1).select(I.maximal_overlap(*map(F.lit, (s1, e1, s2, e2, l1, l2, reverse))).alias("m")).first()
    assert row["m"] is expected


def test_depth_points(spark):
    iv = spark.createDataFrame([(1, 0, 10), (1, 5, 15), (1, 10, 20)], "ref int, start int, stop int")
    pts = I.grid(spark.createDataFrame([(1, 0, 20)], "ref int, low int, high int"), ["ref"], 5)
    got = {r["pos"]: r["depth"] for r in I.depth_at_points(iv, pts, ["ref"]).collect()}
    assert got == {0: 1, 5: 2, 10: 2, 15: 1, 20: 0}
    assert [tuple(r) for r in I.depth_segments(iv, ["ref"]).orderBy("start").collect()] == [(1, 0, 5, 1), (1, 5, 15, 2), (1, 15, 20, 1)]


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "edge_id long, node1 long, node2 long, dir1 boolean, dir2 boolean, overlap long")


def reduced(spark, rows, size=3000):
    nodes = sorted({n for r in rows for n in r[1:3]})
    return {r["edge_id"] for r in G.transitive_edges(edge_table(spark, rows), spark.createDataFrame([(n, size) for n in nodes], "node long, size long")).collect()}


def test_transitive_reduction(spark):
    line = [(0, 0, 1, True, False, 2000), (1, 1, 2, True, False, 2000)]
    assert reduced(spark, [*line, (2, 0, 2, True, False, 1000)]) == {2}
    assert reduced(spark, [*line, (2, 0, 2, False, False, 1000)]) == set()
    assert reduced(spark, [*line, (2, 0, 2, True, True, 1000)]) == set()
    assert reduced(spark, [*line, (2, 2, 0, True, False, 2000)]) == set()


def test_components_of_a_long_shuffled_path(spark):
    ids = random.Random(3).sample(range(10**6), 1500)
    rows = [(i, a, b, True, False, 100) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
    edges = edge_table(spark, rows)
    got = G.components(edges).collect()
    assert len(got) == 1500 and {r["component"] for r in got} == {min(ids)}
    paths = G.unitigs(spark.createDataFrame([(n,) for n in ids], "node long"), edges).collect()
    assert {r["unitig"] for r in paths} == {min(ids)} and sorted(r["at"] for r in paths) == list(range(1500))


def test_components_and_unitigs(spark):
    rows = [(i, i, i + 1, True, False, 100) for i in range(6)] + [(10, 20, 21, True, True, 100), (11, 21, 20, False, False, 100)]
    got = {r["node"]: r["component"] for r in G.components(edge_table(spark, rows)).collect()}
    assert {got[n] for n in range(7)} == {0} and got[20] == got[21] == 20
    nodes = spark.createDataFrame([(n,) for n in [*range(7), 20, 21, 99]], "node long")
    paths = G.unitigs(nodes, edge_table(spark, rows)).collect()
    assert [r["node"] for r in sorted(paths, key=lambda r: r["at"]) if r["unitig"] == 0] == list(range(7))
    assert {r["circular"] for r in paths if r["unitig"] == 20} == {True}
    assert [r["at"] for r in paths if r["unitig"] == 99] == [0]


def test_z_edge(spark):
    rows = [(0, 0, 2, True, False, 10_000, 0, 1000), (1, 1, 3, True, False, 10_000, 0, 1000), (2, 0, 3, True, False, 1000, 0, 100)]
    edges = spark.createDataFrame(rows, "edge_id long, node1 long, node2 long, dir1 boolean, dir2 boolean, overlap long, diff_snpmers long, shared_minimizers long")
    assert {r["edge_id"] for r in G.z_edges(edges).collect()} == {2}


def diamond(depth=5.0):
    edges = {i: Edge(i, e, (True, False), 1000) for i, e in enumerate([(0, 1), (0, 2), (1, 3), (2, 3)])}
    return Graph({0: 10, 1: 10, 2: 10, 3: 10}, {0: (10,) * 3, 1: (10,) * 3, 2: (depth,) * 3, 3: (10,) * 3}, dict.fromkeys(range(4), 1000), edges)


def test_bubble_keeps_the_deeper_branch():
    assert diamond().bubbles(50_000) == ({2}, {1, 3})
    assert diamond().bubbles(10) == (set(), set())


def test_a_circle_with_one_bubble_is_popped():
    """Source and sink are one node: 1 leads to 2 or 3, and both lead back into 1 from its other side."""
    edges = {0: Edge(0, (1, 2), (True, False), 500), 1: Edge(1, (1, 3), (True, False), 500), 2: Edge(2, (2, 1), (True, False), 500), 3: Edge(3, (3, 1), (True, False), 500)}
    graph = Graph({1: 9, 2: 1, 3: 5}, {n: (float(d),) * 3 for n, d in ((1, 20), (2, 3), (3, 20))}, {1: 5000, 2: 900, 3: 900}, edges)
    assert graph.bubble(1, True, 50_000) == (1, False, {2}, {0, 2})
    assert graph.bubbles(50_000) == ({2}, {0, 2})
    # Back to the side it left by: no bubble.
    graph = Graph(graph.reads, graph.depths, graph.unique, edges | {3: Edge(3, (3, 1), (True, True), 500)})
    assert graph.bubble(1, True, 50_000) is None


def test_hot_keys_are_dealt_in_pieces(spark):
    rows = spark.range(6000).selectExpr("id", "if(id < 4000, 7, id) AS k")
    lookup = rows.groupBy("k").count().withColumn("v", F.col("k") * 10)
    hot = tables.hot_keys(lookup.select("k", "count"), "k")
    assert [(r["k"], r["_pieces"]) for r in hot.collect()] == [(7, 4)]
    joined = tables.spread_join(rows, lookup.select("k", "v"), "k", hot, "id")
    assert joined.count() == 6000 and joined.where("v <> k * 10").count() == 0
    assert tables.hot_keys(rows.where("id >= 4000").groupBy("k").count(), "k") is None


def test_beam_prefers_alike_depth():
    weights = diamond(40.0).edge_weights(100_000, 3)
    assert weights[0] > weights[1]


def test_alignment_and_windows():
    assert P.align("ACGTACGT", "ACGTTACGT")[:2] == (5, [("M", 3), ("D", 1), ("M", 5)])
    assert P.align("ACGT", "ACGT")[0] == 4
    assert P.breakpoints(100, 10) == list(range(10, 101, 10))
    seq = ("ACGT" * 8)[:29]
    assert [seq[a:b] for _, a, b in P.cut_windows(seq, [("M", 29)], 0, 100, 10)] == ["ACGTACGTAC", "GTACGTACGT", "ACGTACGTA"]
    assert [seq[a:b] for _, a, b in P.cut_windows(seq, [("M", 29)], 0, 100, 10, 2)] == ["ACGTACGTACGT", "GTACGTACGTAC", "ACGTACGTA"]


def noisy(seq, rng, rate=0.05):
    out = []
    for c in seq:
        r = rng.random()
        if r < rate / 3:
            continue
        if r < 2 * rate / 3:
            out.append(rng.choice("ACGT"))
        out.append(rng.choice("ACGT") if r > 1 - rate / 3 else c)
    return "".join(out)


def test_consensus_recovers_the_truth():
    rng = random.Random(2)
    truth = "".join(rng.choice("ACGT") for _ in range(200))
    got = P.window_consensus([noisy(truth, rng) for _ in range(15)], [80.0] * 15)
    assert P.align(got, truth)[0] >= 190
    assert P.window_consensus([], [], "ACGT") == "ACGT" and P.window_consensus(["AC"], [1.0]) == "AC"
    assert P.expand_runs("ACGT", ["AAACGT", "AAACGT", "AACGT"]) == "AAACGT"
    left, right = truth[:120], truth[80:]
    assert P.join_windows([left, right], 40) == truth


def test_alignment_through_seeds():
    rng = random.Random(6)
    ref = "".join(rng.choice("ACGT") for _ in range(300))
    query = ref[20:100] + ref[103:180] + "ACGTT" + ref[180:290]
    points = [(q, q + 20) for q in range(5, 60, 7)] + [(q, q + 23) for q in range(85, 140, 9)] + [(q, q + 18) for q in range(170, 250, 11)]
    cigar, (qs, qe, rs, re) = P.align_chain(query, ref, points, 15)
    used = {op: sum(n for o, n in cigar if o == op) for op in "MID"}
    assert (qs, rs) == (0, 20) and (qe, re) == (len(query), 290)
    assert used["M"] + used["I"] == qe - qs and used["M"] + used["D"] == re - rs
    assert used["I"] - used["D"] == 2
    assert P.align_chain("ACGT", "ACGT", [], 3) == ([], (0, 0, 0, 0))


def test_extension_stops():
    assert P.extend_end("ACGTACGT", "ACGTACGT") == (8, [("M", 8)])
    assert P.extend_end("AAAA" + "C" * 300 + "A" * 400, "AAAA" + "G" * 300 + "A" * 400)[0] == 4
    assert P.extend_end("", "A") == (0, [])


def test_circle_keeps_its_repeat_once():
    rng = random.Random(7)
    repeat = "".join(rng.choice("ACGT") for _ in range(200))
    seq = repeat + "G" * 250 + "A" * 250 + "T" * 250 + "C" * 250 + repeat
    assert len(P.join_circle(seq, len(repeat), 11, 11)) == 1000 + len(repeat)
    assert P.join_circle("ACGT", 100) == "ACGT"


def test_trim_to_median_ends():
    rng = random.Random(8)
    truth = "".join(rng.choice("ACGT") for _ in range(150))
    assert P.trim_by_coverage("T" * 20 + truth, [truth] * 5 + ["T" * 20 + truth]) == truth
    assert P.trim_by_coverage("ACGT", []) == "ACGT"


def test_tips_cycles_and_levels(spark):
    from strandmill.operators import cleaning as L
    from strandmill.operators import coverage as V

    rows = [(0, 0, 1, True, False, 100), (1, 1, 2, True, False, 100), (2, 1, 3, True, False, 100)]
    nodes = spark.createDataFrame([(0, 90_000, 50), (1, 90_000, 50), (2, 90_000, 50), (3, 500, 1)], "node long, length long, reads long")
    left, edges = L.remove_tips(nodes, edge_table(spark, rows), 1000, 2)
    assert {r["node"] for r in left.collect()} == {0, 1, 2} and edges.count() == 2
    two = spark.createDataFrame([(1, 2, 300, 5, 5, 1000, 1000), (1, 2, 400, 1, 1, 1000, 1000), (3, 4, 300, 0, 0, 900, 900)], "read_i long, read_j long, overlap1_len long, hang1 long, hang2 long, len1 long, len2 long")
    assert [tuple(r) for r in L.two_cycles(two).collect()] == [(1, 2, 1300)]
    iv = spark.createDataFrame([(1, 0, 100, 1.0), (1, 0, 100, 0.998), (1, 0, 100, 0.991)], "ref int, start int, stop int, identity double")
    ends = spark.createDataFrame([(1, 100), (2, 100)], "ref int, length int")
    got = {(r["ref"], r["level"]): r["median_depth"] for r in V.level_depths(iv, ends, ["ref"]).collect()}
    assert [got[(1, x)] for x in V.LEVELS] == [3, 2, 1] and got[(2, 1.0)] == 0


def test_splits(spark):
    from strandmill.operators import coverage as V

    reads = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "GGGG")], "id string, seq string")
    parts = spark.createDataFrame([("a", 0, 0, 4), ("a", 1, 6, 10), ("b", 0, 0, 4)], "id string, part int, start int, stop int")
    assert {tuple(r) for r in V.apply_splits(reads, parts).collect()} == {("a+split0", "ACGT"), ("a+split1", "GTAC"), ("b", "GGGG")}


def test_safe_cuts_leave_no_tip():
    line = {i: Edge(i, (i, i + 1), (True, False), 1000) for i in range(5)} | {9: Edge(9, (1, 9), (True, False), 500)}
    g = Graph(dict.fromkeys([*range(6), 9], 5), dict.fromkeys([*range(6), 9], (5.0,) * 3), dict.fromkeys([*range(6), 9], 1000), line)
    assert g.leads_on(1, True, set(), 3000) and not g.leads_on(1, True, {1}, 3000)
    assert g.safe(9, set(), 3000) and not g.safe(1, set(), 3000)


def test_marker_screen_keeps_every_marker(spark, tmp_path):
    """Copies share only markers that many hold; each pair must come out, by count over all markers."""
    from strandmill.plans import catalog

    R = catalog.relational_queries
    rng = random.Random(11)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    other = "".join(rng.choice("ACGT") for _ in range(3000))
    texts = [base] * 12 + [base[:2000] + other[:1000]] * 2 + [other] + ["".join(rng.choice("ACGT") for _ in range(2000)) for _ in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held: dict = {}
    for r in R.ani.markers(R.reads(spark, str(tmp_path)), 21, 20).collect():
        held.setdefault(r["id"], set()).add(r["marker"])
    want = set()
    for a in held:
        for b in held:
            both = len(held[a] & held[b])
            if a < b and both > max(min(len(held[a]), len(held[b])) * 0.9**21, 1):
                want.add((a, b, both, len(held[a]), len(held[b])))
    got = R.screened(spark, str(tmp_path)).collect()
    assert {(0, 1), (10, 11), (0, 12), (12, 13), (12, 14)} <= {w[:2] for w in want}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    kinds = {r["id"]: r["class"] for r in R.k_dereplicate(spark, str(tmp_path)).collect()}
    assert sum(kinds[i] == "primary" for i in range(12)) == 1


def test_deep_windows_are_ranked_over_all_sequences(spark):
    short = [("ACGTACGTAC" * 2, 30.0 + i / 100) for i in range(80)]
    long = [("GATTACAGCC" * 10, 29.0 + i / 100) for i in range(120)]
    rows = [(1, 0, s, q) for s, q in short + long]
    got = P.best_of_windows(spark.createDataFrame(rows, "contig long, window int, seq string, quality double")).collect()
    want = sorted((q for _, q in long), reverse=True)[:75]
    assert sorted((r["quality"] for r in got), reverse=True) == want
    few = spark.createDataFrame([(2, 0, s, q) for s, q in short[:40]], "contig long, window int, seq string, quality double")
    assert P.best_of_windows(few).count() == 38
    whole = P.polish(spark.createDataFrame(rows, "contig long, window int, seq string, quality double")).collect()[0]["seq"]
    assert whole == P.window_consensus([r[2] for r in rows], [r[3] for r in rows]) and len(whole) > 50
