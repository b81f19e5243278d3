"""End to end on a synthetic genome."""

from __future__ import annotations

import random

import pytest

from strandmill.operators.consensus import align
from strandmill.plans import assembly
from strandmill.plans.config import Config

FLIP = str.maketrans("ACGT", "TGCA")


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n)), rng


def linear_reads(truth, rng, size=3000, step=900):
    rows = []
    for i, at in enumerate(range(0, len(truth) - size + 1, step)):
        seq = truth[at : at + size]
        rows.append((i, seq if rng.random() < 0.5 else seq.translate(FLIP)[::-1]))
    return rows


@pytest.fixture(scope="module")
def assembled(spark):
    truth, rng = genome(12_000, 4)
    reads = spark.createDataFrame(linear_reads(truth, rng), "id long, seq string")
    return truth, reads, assembly.assemble(reads, Config(chain_gap=200)).toPandas()


def test_linear_genome_is_one_contig(assembled):
    truth, _, contigs = assembled
    assert len(contigs) == 1
    seq = contigs["seq"].iloc[0]
    assert seq in (truth, truth.translate(FLIP)[::-1])


def test_contained_reads_are_left_out(spark, assembled):
    truth, reads, _ = assembled
    inner = spark.createDataFrame([(100, truth[1000:3000])], "id long, seq string")
    chains = assembly.overlap_chains(reads.union(inner), Config())
    assert {r["id"] for r in assembly.contained_reads(chains, Config()).collect()} == {100}


def test_circular_genome_closes(spark):
    truth, rng = genome(9_000, 8)
    rows = [(i, s) for i, s in linear_reads(truth + truth[:3000], rng, step=1000)][:9]
    contigs = assembly.assemble(spark.createDataFrame(rows, "id long, seq string")).toPandas()
    assert len(contigs) == 1 and bool(contigs["circular"].iloc[0])
    seq = contigs["seq"].iloc[0]
    assert len(seq) == len(truth)
    assert seq in truth * 2 or seq in (truth * 2).translate(FLIP)[::-1]


def both_ways(seq):
    return {seq, seq.translate(FLIP)[::-1]}


def strain_reads(first, second, size=3000, step=400):
    rows = []
    for truth in (first, second):
        for i, at in enumerate(range(0, len(truth) - size + 1, step)):
            seq = truth[at : at + size]
            rows.append((len(rows), seq if i % 2 else seq.translate(FLIP)[::-1]))
    return rows


@pytest.fixture(scope="module")
def strains():
    first, rng = genome(9_000, 21)
    second = list(first)
    for at in range(120, 9_000, 250):
        second[at] = {"A": "C", "C": "A", "G": "T", "T": "G"}[second[at]]
    return first, "".join(second)


def test_two_strains_give_two_contigs(spark, strains):
    reads = spark.createDataFrame(strain_reads(*strains), "id long, seq string")
    sites = assembly.allele_sites(reads, Config()).count()
    assert sites > 0
    contigs = assembly.assemble(reads).toPandas()
    long = [c for c in contigs["seq"] if len(c) > 6000]
    assert len(long) == 2
    assert {next(i for i, t in enumerate(strains) if any(c in x for x in both_ways(t))) for c in long} == {0, 1}


def test_a_contained_read_of_another_strain_stays(spark, strains):
    rows = spark.createDataFrame([*strain_reads(*strains), (900, strains[1][1010:2510]), (901, strains[0][1010:2510])], "id long, seq string")
    # Without the second strain's own reads its short read lies only within reads of the other strain.
    reads = rows.where("id < 16 OR id >= 900")
    config = Config()
    chains = assembly.overlap_chains(reads, config)
    alleles = assembly.read_alleles(reads, assembly.allele_sites(rows, config), config)
    gone = {r["id"] for r in assembly.contained_reads(assembly.compared(chains, alleles), config).collect()}
    assert gone == {901}


def test_run_writes_and_resumes(spark, tmp_path):
    truth, rng = genome(4_000, 5)
    rows = [(f"r{i}", truth[at : at + 1500]) for i, at in enumerate(range(0, 2501, 250))]
    (tmp_path / "reads.fa").write_text("".join(f">{n}\n{s}\n" for n, s in rows))
    out = assembly.run(spark, str(tmp_path / "out"), str(tmp_path / "reads.fa")).collect()
    assert len(out) == 1 and abs(len(out[0]["seq"]) - 4_000) < 40
    (tmp_path / "reads.fa").unlink()
    assert assembly.run(spark, str(tmp_path / "out")).collect() == out


def test_polishing_repairs_errors(spark):
    truth, rng = genome(1_200, 9)
    noise = lambda s: "".join(c if rng.random() > 0.01 else rng.choice("ACGT") for c in s)
    reads = spark.createDataFrame([(i, noise(truth)) for i in range(8)], "id long, seq string")
    drafts = spark.createDataFrame([(1, noise(truth))], "unitig long, seq string")
    out = assembly.polish(drafts, reads, Config()).collect()
    assert len(out) == 1
    assert align(out[0]["seq"], truth)[0] >= len(truth) - 12
