"""Stored sketches, joined graphs, edge numbers and small statistics against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.functions import stats as T
from strandmill.operators import graph as G
from strandmill.operators import intervals as I
from strandmill.operators import reports as R
from strandmill.operators import seeding as J
from strandmill.sources import sketches


def test_sketches_by_record_and_by_file(spark, tmp_path):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (900, 700, 499, 600)]
    records = spark.createDataFrame([("f1", "a", seqs[0]), ("f1", "b", seqs[1]), ("f1", "c", seqs[2]), ("f2", "d", seqs[3])], "file string, id string, seq string")
    each = {r.id: r for r in sketches.sketch(records, 15, 5).collect()}
    assert sorted(each) == ["a", "b", "d"] and each["a"].length == 900
    files = {r.id: r for r in sketches.sketch(records, 15, 5, by="file").collect()}
    assert files["f1"].length == 1600 and set(files["f1"].markers) == set(each["a"].markers) | set(each["b"].markers)
    assert sketches.too_short(records).first().records == 1
    path = str(tmp_path / "sketches")
    sketches.write_sketches(sketches.sketch(records, 15, 5), path)
    stored = sketches.read_sketches(spark, path, 15, 5)
    assert sketches.marker_rows(stored).count() == sum(len(r.markers) for r in each.values())
    with pytest.raises(ValueError):
        sketches.read_sketches(spark, path, 17, 5)


def test_records_without_markers_keep_an_empty_sketch(spark):
    records = spark.createDataFrame([("a", "N" * 600)], "id string, seq string")
    row = sketches.sketch(records, 15, 5).first()
    assert row.length == 600 and row.markers == []


def test_small_sketches_warn_only_in_large_collections(spark):
    rows = spark.range(11_000).select("id", F.when(F.col("id") < 4000, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(30))).alias("markers"))
    assert tuple(sketches.small_sketches(rows).first()) == (4000, 7000, True)
    assert tuple(sketches.small_sketches(rows.where("id < 5000")).first()) == (4000, 1000, False)


def test_concatenated_graph_keeps_both_and_may_start_empty(spark):
    nodes = spark.createDataFrame([(0, "a"), (5, "b")], "node long, name string")
    edges = spark.createDataFrame([(3, 0, 5)], "edge_id long, node1 long, node2 long")
    n, e = R.concatenate(nodes, edges, nodes, edges)
    assert sorted(map(tuple, n.collect())) == [(0, "a"), (5, "b"), (6, "a"), (11, "b")]
    assert sorted(map(tuple, e.collect())) == [(3, 0, 5), (7, 6, 11)]
    assert R.broken_edges(n, e).count() == 0
    n, e = R.concatenate(nodes.limit(0), edges.limit(0), nodes, edges)
    assert sorted(r.node for r in n.collect()) == [0, 5] and e.first().edge_id == 3


def test_edges_are_numbered_in_order_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(50), rng.randrange(900), rng.randrange(900), rng.randrange(99), rng.randrange(99)) for i in range(700)]
    names = ["read_i", "read_j", "overlap1_len", "overlap2_len", "hang1", "hang2"]
    found = {(r.read_i, r.read_j): r.edge_id for r in G.numbered(spark.createDataFrame(rows, names).repartition(7)).collect()}
    ranked = sorted(rows, key=lambda r: (r[4] + r[5] - r[2] - r[3], r[0], r[1]))
    assert found == {(r[0], r[1]): at for at, r in enumerate(ranked)}
    assert G.numbered(spark.createDataFrame(rows, names).limit(0)).count() == 0


def test_half_of_the_bases_that_is_never_passed_gives_zero(spark):
    rows = spark.createDataFrame([("x", 10, False, "alternate", False)], "g string, length long, circular boolean, class string, kept boolean")
    final, draft = R.final_statistics(rows, ["g"]).first(), R.draft_statistics(rows, ["g"]).first()
    assert (final.n50, final.bases, final.alternate) == (10, 0, 1)
    assert (draft.n50, draft.bases, draft.contigs, draft.largest) == (0, 0, 0, 10)


def test_gap_between_deep_and_bare_sides(spark):
    deep = [("r", 0, 1000)] * 6
    bounds = spark.createDataFrame([("r", 3000)], "ref string, length long")
    case = lambda right: I.gap_chimeras(spark.createDataFrame(deep + [("r", 1500, 2600)] * right, "ref string, start long, stop long"), bounds, ["ref"]).first().condition
    assert (case(4), case(3)) == (1, 6)


def test_quantiles_of_levels_and_seed_rules(spark):
    rows = spark.createDataFrame([("x", [1.0, 9.0], 1), ("x", [2.0, 8.0], 5), ("x", [3.0, 7.0], 1)], "g string, d array<double>, w long")
    assert T.weighted_quantile_levels(rows, ["g"], "d", "w", 0.5).first().quantile == [2.0, 8.0]
    seeds = spark.createDataFrame([(1, 7)] * 3 + [(1, 8), (2, 7), (2, 9)], "id long, kmer long")
    kept = J.informative(seeds, spark.createDataFrame([(9,)], "kmer long"), 2)
    assert sorted(map(tuple, kept.select("id", "kmer").collect())) == [(1, 8), (2, 7)]


def test_running_sums_undo_deltas_at_every_length(spark):
    rng = random.Random(8)
    rows = [(n, sorted(rng.choices(range(9999), k=n))) for n in (0, 1, 2, 3, 4, 5, 8, 9, 10, 17, 100, 101, 1500)] + [(-1, None)]
    steps = spark.createDataFrame(rows, "n long, p array<long>").select("n", S.deltas(F.col("p")).alias("s"))
    assert {r.n: r.b for r in steps.select("n", S.undeltas(F.col("s")).alias("b")).collect()} == dict(rows)


def test_ratios_at_the_limit_follow_the_weighted_sum(spark):
    depths = lambda n: [20 + n % 37, 10 + n % 37, n % 11]
    rows = [(1, True, i, depths(124970), depths(n)) for i, n in enumerate((127678, 131856))]
    half = spark.createDataFrame(rows, "node long, side boolean, edge_id long, depth array<long>, other_depth array<long>")
    r = [0.333 * sum((max(a, b) + 3) / (min(a, b) + 3) for a, b in zip(x, y)) for *_, x, y in rows]
    assert {e["edge_id"] for e in G.coverage_safe(half, 1.75).collect()} == {i for i in range(2) if r[i] / min(r) < 1.75}


def plain_depth(iv, at):
    return sum(a <= at < b for a, b in iv)


@pytest.mark.parametrize(("sampling", "block"), [(10, 50), (7, 30), (10, 1000)])
def test_block_depths_equal_those_of_every_point(spark, sampling, block):
    rng = random.Random(sampling * block)
    iv = {r: [(a, a + rng.randint(0, 90)) for a in (rng.randint(-20, 400) for _ in range(12))] for r in (1, 2)} | {3: []}
    length = {1: 433, 2: 300, 3: 60}
    rows = spark.createDataFrame([(r, *x) for r, xs in iv.items() for x in xs], "ref int, start int, stop int")
    got = I.block_depths(rows, spark.createDataFrame(list(length.items()), "ref int, length int"), ["ref"], sampling, block)
    for r in got.collect():
        blocks = {}
        for pos in range(sampling, length[r["ref"]] - sampling + 1, sampling):
            blocks.setdefault(max(1, -(-pos // block)), []).append((pos, plain_depth(iv[r["ref"]], pos)))
        low, mid = [], []
        for b, points in blocks.items():
            depths, w = sorted(d for _, d in points), block // sampling if points[-1][0] >= b * block else len(points)
            low += [depths[0]] * w
            mid += [depths[len(depths) // 2]] * w
        assert (r["min_depth"], r["median_depth"]) == (sorted(low)[len(low) // 2], sorted(mid)[len(mid) // 2])


def test_block_depths_cost_no_row_for_each_point_of_a_long_axis(spark):
    iv = spark.createDataFrame([(1, 10**11, 5 * 10**11), (1, 0, 9 * 10**11)], "ref int, start long, stop long")
    ends = spark.createDataFrame([(1, 10**12)], "ref int, length long")
    assert [tuple(r) for r in I.block_depths(iv, ends, ["ref"]).collect()] == [(1, 1, 1)]


def test_depth_on_a_grid_equals_depth_at_its_points(spark):
    rng = random.Random(5)
    iv = spark.createDataFrame([(r, a, a + rng.randint(0, 60)) for r in (1, 2, 4) for a in (rng.randint(-30, 300) for _ in range(15))], "ref int, start int, stop int")
    ends = spark.createDataFrame([(1, 0, 301), (2, 7, 120), (3, 0, 50), (4, 9, 8)], "ref int, low long, high long")
    rows = lambda df: sorted((r["ref"], r["pos"], r["depth"] or 0) for r in df.collect())
    assert rows(I.depth_on_grid(iv, ends, ["ref"], 25)) == rows(I.depth_at_points(iv, I.grid(ends, ["ref"], 25), ["ref"]))


def test_positions_and_keys_that_are_null_cover_nothing(spark):
    iv = spark.createDataFrame([(1, 0, 10), (1, None, None), (1, 5, None), (None, 0, 50)], "ref int, start int, stop int")
    ends = spark.createDataFrame([(1, 0, 20), (None, 0, 20)], "ref int, low long, high long")
    got = {(r["ref"], r["pos"]): r["depth"] for r in I.depth_on_grid(iv, ends, ["ref"], 10).collect()}
    assert got == {(1, 0): 1, (1, 10): 1, (1, 20): 1, (None, 0): 0, (None, 10): 0, (None, 20): 0}


def test_levels_without_an_identity_of_their_own(spark):
    from strandmill.operators import coverage as V

    iv = spark.createDataFrame([(1, 0, 10**12, 0.995), (1, 0, 10**12, 0.985), (2, 0, 10**12, 0.5)], "ref int, start long, stop long, identity double")
    ends = spark.createDataFrame([(1, 10**12), (2, 10**12), (3, 10**12)], "ref int, length long")
    levels = (1.0, 0.995, 0.99, 0.985, 0.98)
    got = {(r["ref"], r["level"]): (r["min_depth"], r["median_depth"]) for r in V.level_depths(iv, ends, ["ref"], levels).collect()}
    assert got == {(r, x): (n, n) for r in (1, 2, 3) for x, n in zip(levels, (0, 1, 1, 2, 2) if r == 1 else (0,) * 5)}
    bare = V.level_depths(iv.where("identity < 0.9"), ends, ["ref"], levels).collect()
    assert len(bare) == 15 and {(r["min_depth"], r["median_depth"]) for r in bare} == {(0, 0)}


def test_identity_steps_on_a_long_axis(spark):
    from strandmill.operators import coverage as V

    rows = [(1, 0, 10**12, x) for x in [0.991] * 6 + [0.998] * 2 + [0.985]]
    iv = spark.createDataFrame(rows, "ref int, start long, stop long, identity double")
    got = V.adaptive_identity(iv, spark.createDataFrame([(1, 10**12)], "ref int, length long"), ["ref"], lowest=0.985)
    assert [tuple(r) for r in got.collect()] == [(1, 8, 2, 0, 99.1)]


def test_windows_without_gaps_equal_those_of_a_cigar(spark):
    from strandmill.operators import consensus as P

    rng = random.Random(7)
    rows = [(s, s + rng.randint(0, 400), 1000) for s in (rng.randint(0, 990) for _ in range(60))] + [(900, 1000, 1000), (0, 0, 1000), (99, 201, 1000), (10**11 + 50, 10**11 + 250, 10**12)]
    df = spark.createDataFrame(rows, "start long, stop long, length long")
    cut = df.select("*", P.aligned_windows(F.col("start"), F.col("stop"), F.col("length"), 100, 20).alias("w")).collect()
    short = [(r["start"], r["stop"], r["w"]) for r in cut if r["stop"] <= r["length"] == 1000]
    assert len(short) > 20 and all([tuple(x) for x in w] == P.cut_windows("", [("M", b - a)], a, 1000, 100, 20) for a, b, w in short)
    assert [tuple(x) for r in cut for x in r["w"] if r["length"] > 1000] == [(10**9, 0, 70), (10**9 + 1, 50, 170), (10**9 + 2, 150, 200)]


def plain_tips(nodes, edges, length, reads):
    """Rounds of the rule with components found anew each time."""
    size, many = {n: x for n, x, _ in nodes}, {n: r for n, _, r in nodes}
    while True:
        own, top = {}, {}
        for _, a, b, da, db, o in edges:
            for n, s in ((a, da), (b, db)):
                own.setdefault(n, set()).add(s)
                top[n] = max(top.get(n, 0), o if a != b else 0)
        group = {n: n for n in own}
        for _ in own:
            for _, a, b, *_ in edges:
                group[a] = group[b] = min(group[a], group[b])
        members = {c: [n for n in own if group[n] == c] for c in group.values()}
        total = lambda n, v: sum(v[m] for m in members[group[n]]) // 10
        gone = {n for n in own if len(own[n]) == 1 and (max(0, size[n] - top[n]) <= min(length, total(n, size)) or many[n] <= min(reads, total(n, many)))}
        if not gone:
            return set(size), {e[0] for e in edges}
        size = {n: x for n, x in size.items() if n not in gone}
        edges = [e for e in edges if not {e[1], e[2]} & gone]


def test_tips_are_taken_off_without_new_components_each_round(spark, monkeypatch):
    from strandmill.operators import cleaning as L

    rng = random.Random(3)
    chain = [(i, i, i + 1, True, False, 100) for i in range(30)]
    wild = [(100 + i, a, b, rng.random() < 0.5, rng.random() < 0.5, 100) for i, (a, b) in enumerate((rng.randint(50, 75), rng.randint(50, 75)) for _ in range(30))]
    nodes = [(n, 300 + n * 37 % 900, 1 + n % 9) for n in range(80)]
    table = lambda rows: spark.createDataFrame(rows, "edge_id long, node1 long, node2 long, dir1 boolean, dir2 boolean, overlap long")
    found, real = [], G.components
    monkeypatch.setattr(G, "components", lambda e: found.append(1) or real(e))
    for rows, calls in ((chain, 1), (wild, None)):
        found.clear()
        left, edges = L.remove_tips(spark.createDataFrame(nodes, "node long, length long, reads long"), table(rows), 2000, 3)
        assert ({r["node"] for r in left.collect()}, {r["edge_id"] for r in edges.collect()}) == plain_tips(nodes, rows, 2000, 3)
        assert calls is None or len(found) == calls < len(chain) - edges.count()
