"""FASTA and FASTQ: a splitting scan, and text sinks.

Spark's line reader splits plain and bzip2 files and streams gzip ones, so a
file may be of any size.  Each split gives the records that are whole in it;
what is left at its start and end is joined by file and place.
"""

from __future__ import annotations

import bz2
import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import stored

RECORD = "file string, at long, id string, seq string, qual string, rest string, head boolean"
BATCH = 2000
FASTA_NAMES = re.compile(r"\.(fa|fasta|fna|ffn|fas)(\.gz|\.bz2)?$", re.I)
FASTQ_NAMES = re.compile(r"\.(fq|fastq)(\.gz|\.bz2)?$", re.I)


def inflate(raw: bytes) -> bytes:
    """Contents by what the bytes say, not the file name: gzip, bzip2 or plain."""
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if raw[:3] == b"BZh":
        return bz2.decompress(raw)
    return raw


def records(raw: bytes) -> Iterator[tuple[str, str, str | None]]:
    """(id, seq, qual) of a file's records; sequences may span lines, the id is the header's first word."""
    lines = iter(inflate(raw).decode("ascii", "replace").splitlines())
    line = next(lines, None)
    while line is not None:
        if not line.strip():
            line = next(lines, None)
            continue
        mark, name = line[0], (line[1:].split() or [""])[0]
        if mark not in ">@":
            raise ValueError(f"not a FASTA or FASTQ header: {line[:40]!r}")
        parts: list[str] = []
        line = next(lines, None)
        while line is not None and line[:1] not in ((">",) if mark == ">" else ("+",)):
            parts.append(line.strip())
            line = next(lines, None)
        seq, qual = "".join(parts), None
        if mark == "@":
            if line is None:
                raise ValueError(f"record {name} has no qualities")
            got: list[str] = []
            line = next(lines, None)
            while line is not None and sum(map(len, got)) < len(seq):
                got.append(line.rstrip("\r"))
                line = next(lines, None)
            qual = "".join(got)
            if len(qual) != len(seq):
                raise ValueError(f"record {name} has {len(seq)} bases and {len(qual)} qualities")
        yield name, seq, qual


class _Split:
    """Lines of one split of a file: whole records as they come, and the lines before the first and after the last."""

    def __init__(self, name: str, start: int) -> None:
        self.name, self.start, self.made = name, start, 0
        self.kind = ">" if FASTA_NAMES.search(name) else "@" if FASTQ_NAMES.search(name) else None
        self.lines: list[str] = []
        self.head: list[str] | None = [] if start else None

    def synced(self) -> bool:
        """Whether ``lines`` begins with a header; what is before it goes to ``head``."""
        if self.head is None:
            return True
        line = self.lines[-1]
        if self.kind == ">":
            if line[:1] != ">":
                return False
            at = len(self.lines) - 1
        elif self.kind == "@" and len(self.lines) >= 4 and self.lines[-4][:1] == "@" and self.lines[-2][:1] == "+" and len(self.lines[-3]) == len(line):
            at = len(self.lines) - 4
        else:
            return False
        self.kept_head, self.head, self.lines = self.lines[:at], None, self.lines[at:]
        return True

    kept_head: list[str] = []

    def add(self, line: str) -> Iterator[tuple[str, str, str | None]]:
        line = line.rstrip("\r")
        if not self.lines and not line.strip():
            return
        self.lines.append(line)
        if not self.synced():
            return
        first = self.lines[0][:1]
        if first == ">":
            if len(self.lines) > 1 and line[:1] == ">":
                done, self.lines = self.lines[:-1], [line]
                yield from records("\n".join(done).encode())
        elif first != "@":
            raise ValueError(f"not a FASTA or FASTQ header: {self.lines[0][:40]!r}")
        elif len(self.lines) >= 4:
            plus = next((i for i in range(1, len(self.lines)) if self.lines[i][:1] == "+"), None)
            if plus and sum(map(len, self.lines[plus + 1 :])) >= sum(len(x.strip()) for x in self.lines[1:plus]):
                done, self.lines = self.lines, []
                yield from records("\n".join(done).encode())


def read_fastx(spark: SparkSession, *paths: str, least: int = 0) -> DataFrame:
    """(file, at, id, seq, qual) of all records of at least ``least`` bases.

    ``at`` grows with a record's place in its file.  Plain and bzip2 files are
    split, gzip files streamed; a task holds a record, not a file.  The parsed
    records are a stored table, which later steps read column by column.
    Records that span splits are put together from the ends of those splits.
    That is also how multi-line FASTQ, and files whose name does not tell the
    format, are read beyond their first split: rightly, but in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        split, rows = None, []

        def ends(s: _Split) -> list[tuple]:
            head, tail = (s.lines, []) if s.head is not None else (s.kept_head, s.lines)
            pieces = [("\n".join(x), h) for x, h in ((head, True), (tail, False)) if any(y.strip() for y in x)]
            return [(s.name, s.start + s.made, None, None, None, text, h) for text, h in pieces]

        for batch in batches:
            for line, name, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
                if split is None or (split.name, split.start) != (name, start):
                    if split is not None:
                        rows += ends(split)
                    split = _Split(name, start)
                for record in split.add(line):
                    if len(record[1]) >= least:
                        rows.append((name, start + split.made, *record, None, None))
                    split.made += 1
                if len(rows) >= BATCH:
                    yield out(rows)
                    rows = []
        yield out(rows + (ends(split) if split is not None else []))

    lines = spark.read.text(list(paths)).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    parsed = stored(lines.mapInArrow(run, RECORD), "records")
    # A tail begins a record that the heads after it go on with; splits are in order of their place, a head before its split's tail.
    along = Window.partitionBy("file").orderBy("at", F.desc("head")).rowsBetween(Window.unboundedPreceding, 0)
    ends_ = parsed.where("rest IS NOT NULL").withColumn("number", F.count_if(~F.col("head")).over(along))
    order = F.array_sort(F.collect_list(F.struct("at", (~F.col("head")).alias("tail"), "rest")))
    whole = ends_.groupBy("file", "number").agg(F.min("at").alias("at"), order.alias("pieces")).select("file", "at", F.array_join(F.transform("pieces", lambda p: p["rest"]), "\n").alias("text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, at, *r) for name, at, text in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "text"))) for r in records(text.encode()) if len(r[1]) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["file", "at", "id", "seq", "qual"])

    joined = whole.mapInArrow(finish, "file string, at long, id string, seq string, qual string")
    return parsed.where("rest IS NULL").select("file", "at", "id", "seq", "qual").union(joined)


def phred(qual: Column) -> Column:
    """Phred values of a quality string; null if it is null or all the same."""
    values = F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)
    return F.when(F.size(F.array_distinct(values)) > 1, values)


def fasta_lines(df: DataFrame, header: Column, seq: Column, width: int | None = None) -> DataFrame:
    """(value): FASTA records as text lines, sequences in one line or wrapped."""
    body = seq if width is None else F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), body).alias("value"))


def write_fasta(df: DataFrame, path: str, header: Column, seq: Column, compression: str | None = None, mode: str = "errorifexists") -> None:
    lines = fasta_lines(df, header, seq).write.mode(mode)
    (lines.option("compression", compression) if compression else lines).text(path)


def contig_header(name: str = "id", length: str = "length", circular: str = "circular", depth: str = "depth", duplicated: str = "duplicated", multiplicity: str = "multiplicity") -> Column:
    """u{id}ctg_len-{n}_{circular}_depth-{a-b-c}_duplicated-{status} mult={x.xx}"""
    depths = F.array_join(F.transform(depth, lambda d: F.format_string("%.0f", d)), "-")
    return F.concat(F.lit("u"), F.col(name), F.lit("ctg_len-"), F.col(length), F.lit("_"), F.col(circular), F.lit("_depth-"), depths, F.lit("_duplicated-"), F.col(duplicated), F.lit(" mult="), F.format_string("%.2f", multiplicity))


def duplicate_status(multiplicity: Column) -> Column:
    """no below 1.10, possibly below 1.50, yes from there."""
    return F.when(multiplicity < 1.10, "no").when(multiplicity < 1.50, "possibly").otherwise("yes")


def circular_label(strict: Column, walk: Column) -> Column:
    return F.when(strict, "circular-yes").when(walk, "circular-possibly").otherwise("circular-no")


def write_partitioned(df: DataFrame, path: str, header: Column, seq: Column, by: str = "class") -> None:
    """One folder of FASTA lines for each value of ``by``."""
    df.select(F.col(by), F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value")).write.partitionBy(by).text(path)
