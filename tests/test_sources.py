"""File formats: round trips and malformed input."""

from __future__ import annotations

import bz2
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions.sequence import packed_kmers
from strandmill.sources import fastx, kmer_db, sinks
from strandmill.streaming import events

FASTQ = "@r1 extra words\nACGT\n+\nIIII\n@r2\nGGCC\nTT\n+r2\n@@II\nII\n"
FASTA = ">a desc\nACGT\nAC\n\n>b\n\n>c\nTTTT"


@pytest.mark.parametrize("pack,ending", [(bytes, ""), (gzip.compress, ".gz"), (bz2.compress, ".bz2")])
def test_fastx(spark, tmp_path, pack, ending):
    (tmp_path / f"x.fq{ending}").write_bytes(pack(FASTQ.encode()))
    (tmp_path / f"y.fa{ending}").write_bytes(pack(FASTA.encode()))
    got = {r["id"]: (r["seq"], r["qual"]) for r in fastx.read_fastx(spark, str(tmp_path)).collect()}
    assert got == {"r1": ("ACGT", "IIII"), "r2": ("GGCCTT", "@@IIII"), "a": ("ACGTAC", None), "b": ("", None), "c": ("TTTT", None)}
    assert {r["id"] for r in fastx.read_fastx(spark, str(tmp_path), least=5).collect()} == {"r2", "a"}


@pytest.mark.parametrize("kind", ["fa", "fq", "wrapped"])
def test_fastx_in_many_splits(spark, tmp_path, kind):
    """Records across split ends, qualities that look like headers, and a sequence longer than a split."""
    rng = np.random.default_rng(3)
    text = []
    for i in range(120):
        seq = "".join(rng.choice(list("ACGT"), int(rng.integers(1, 90)) if i != 50 else 1500))
        qual = "".join(rng.choice(list("@>+I"), len(seq)))
        if kind == "fa":
            text.append(f">r{i} x\n" + "\n".join(seq[j : j + 30] for j in range(0, len(seq), 30)))
        elif kind == "fq":
            text.append(f"@r{i}\n{seq}\n+\n{qual}")
        else:
            text.append(f"@r{i}\n{seq[:40]}\n{seq[40:]}\n+\n{'I' * len(seq[:40])}\n{'I' * len(seq[40:])}")
    raw = "\n".join(text) + "\n"
    (tmp_path / f"x.{'fa' if kind == 'fa' else 'fq'}").write_text(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500" if kind != "wrapped" else "100000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = fastx.read_fastx(spark, str(tmp_path)).orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["id"], r["seq"], r["qual"]) for r in got] == list(fastx.records(raw.encode()))


def test_bad_fastx():
    assert list(fastx.records(b"")) == []
    for bad in (b"ACGT\n", b"@a\nAC\n", b"@a\nACGT\n+\nII\n"):
        with pytest.raises(ValueError):
            list(fastx.records(bad))


def test_fasta_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "GG")], "id string, seq string")
    fastx.write_fasta(df, str(tmp_path / "out"), F.col("id"), F.col("seq"), "gzip")
    back = {r["id"]: r["seq"] for r in fastx.read_fastx(spark, str(tmp_path / "out" / "*.gz")).collect()}
    assert back == {"a": "ACGTACGTAC", "b": "GG"}
    wrapped = [r["value"] for r in fastx.fasta_lines(df, F.col("id"), F.col("seq"), 4).orderBy("value").collect()]
    assert wrapped == [">a\nACGT\nACGT\nAC", ">b\nGG"]


def test_contig_header(spark):
    df = spark.createDataFrame([(3, 1200, "circular-yes", [10.0, 9.4, 8.0], 1.2)], "id int, length int, circular string, depth array<double>, multiplicity double")
    df = df.withColumn("duplicated", fastx.duplicate_status(F.col("multiplicity")))
    assert df.select(fastx.contig_header().alias("h")).first()["h"] == "u3ctg_len-1200_circular-yes_depth-10-9-8_duplicated-possibly mult=1.20"


def test_kmer_database(spark, tmp_path):
    rng = np.random.default_rng(4)
    kmers = np.unique(packed_kmers("".join(rng.choice(list("ACGT"), 3000)).encode(), 15)[0])
    counts = rng.integers(1, 70_000, len(kmers))
    pre, suf = kmer_db.encode(kmers, counts, 15)
    (tmp_path / "db.kmc_pre").write_bytes(pre)
    (tmp_path / "db.kmc_suf").write_bytes(suf)
    assert kmer_db.read_header(pre).total == len(kmers)
    got = {r["kmer"]: r["count"] for r in kmer_db.read_database(spark, str(tmp_path / "db")).collect()}
    assert got == {int(k): min(int(c), 65535) for k, c in zip(kmers, counts)}
    with pytest.raises(ValueError):
        kmer_db.read_header(b"no" * 40)


def test_gfa(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "ACGT", 1.0, 1.0, 1.0, 1.0), (2, "GG", 2.0, 2.0, 2.0, 2.0)], "node long, seq string, dp1 double, dp2 double, dp3 double, median_dp1 double")
    reads = spark.createDataFrame([(1, 0, "r1", True)], "node long, at int, read string, forward boolean")
    edges = spark.createDataFrame([(1, 2, True, False)], "node1 long, node2 long, dir1 boolean, dir2 boolean")
    sinks.write_lines(sinks.gfa_lines(nodes, reads, edges), str(tmp_path / "g"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert [x[0] for x in lines] == ["H", "S", "S", "a", "L"]
    assert lines[1].startswith("S\tu1\tACGT\tLN:i:4\tDP:f:1.00") and lines[4] == "L\tu1\t+\tu2\t+\t0M"


def test_resume_and_timer(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("x")
    for mark in ("a", "a", "b"):
        assert sinks.resume(spark, str(tmp_path / "stage"), mark, make).count() == 3
    assert len(made) == 2
    timer = sinks.Timer()
    timer.measure("one", lambda: 1)
    assert [r["step"] for r in timer.table(spark).collect()] == ["one", "OTHER", "TOTAL"]


def test_streaming_equals_batch(spark, data, tmp_path):
    (tmp_path / "in").mkdir()
    batch = spark.read.parquet(f"{data}/events.parquet")
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.event_stream(spark, str(tmp_path / "in")), late="10000 days")
    got = events.run_to_table(stream, str(tmp_path / "cp"), "event_windows")
    assert got.agg(F.sum("events")).first()[0] == batch.count()
