"""External k-mer databases: a prefix file with a lookup table and a suffix file of fixed-size records.

Layout (fixed values): both files begin and end with a 4-byte marker, KMCP and
KMCS.  The prefix file's last 8 bytes before the closing marker are the header
offset and the version (0 or 0x200); the header holds k, mode, counter size,
prefix length, lower bound, upper bound and total, as 32-bit integers but for
the total.  Version 0 has one table of 4^prefix_length 64-bit record indices;
version 0x200 has one table for each bin and a signature map.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = (b"KMCP", b"KMCS")
V1, V2 = 0, 0x200


@dataclass
class Header:
    k: int
    mode: int
    counter_size: int
    prefix_length: int
    low: int
    high: int
    total: int
    both_strands: bool
    version: int
    signature_length: int = 0

    @property
    def suffix_bytes(self) -> int:
        return (self.k - self.prefix_length) // 4


def read_header(pre: bytes) -> Header:
    if pre[:4] != MARKS[0] or pre[-4:] != MARKS[0]:
        raise ValueError("not a k-mer prefix file")
    version, offset = struct.unpack("<I", pre[-12:-8])[0], struct.unpack("<I", pre[-8:-4])[0]
    at = len(pre) - 8 - offset
    if version == V2:
        k, mode, counter, prefix, signature, low, high = struct.unpack_from("<7I", pre, at)
        (total,) = struct.unpack_from("<Q", pre, at + 28)
        return Header(k, mode, counter, prefix, low, high, total, not pre[at + 36], V2, signature)
    if version != V1:
        raise ValueError(f"unknown version {version:#x}")
    k, mode, counter, prefix, low, high_low = struct.unpack_from("<6I", pre, at)
    (total,) = struct.unpack_from("<Q", pre, at + 24)
    both, high_top = pre[at + 32], struct.unpack_from("<I", pre, at + 36)[0]
    return Header(k, mode, counter, prefix, low, high_low | (high_top << 32), total, not both, V1)


def decode(pre: bytes, suf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(packed k-mers, counts) of a database."""
    h = read_header(pre)
    if suf[:4] != MARKS[1] or suf[-4:] != MARKS[1]:
        raise ValueError("not a k-mer suffix file")
    width = h.suffix_bytes + h.counter_size
    body = np.frombuffer(suf[4:-4], np.uint8).reshape(-1, width) if width else np.zeros((h.total, 0), np.uint8)
    prefixes = 1 << (2 * h.prefix_length)
    if h.version == V1:
        starts = np.frombuffer(pre, "<u8", prefixes, 4)
        prefix = np.searchsorted(starts, np.arange(len(body)), side="right") - 1
    else:
        signatures = (1 << (2 * h.signature_length)) + 1
        end = len(pre) - 8 - struct.unpack("<I", pre[-8:-4])[0]
        tables = (end - 4 - 4 * signatures) // 8
        starts = np.frombuffer(pre, "<u8", tables, 4)
        prefix = (np.searchsorted(starts, np.arange(len(body)), side="right") - 1) % prefixes
    kmer = prefix.astype(np.uint64)
    for i in range(h.suffix_bytes):
        kmer = (kmer << np.uint64(8)) | body[:, i].astype(np.uint64)
    count = np.zeros(len(body), np.int64)
    for i in range(h.counter_size):
        count |= body[:, h.suffix_bytes + i].astype(np.int64) << (8 * i)
    return kmer, count if h.counter_size else np.ones(len(body), np.int64)


def encode(kmers: np.ndarray, counts: np.ndarray, k: int, prefix_length: int = 3, counter_size: int = 2) -> tuple[bytes, bytes]:
    """A version 0 database of sorted distinct k-mers; (k - prefix_length) must be a multiple of 4."""
    order = np.argsort(kmers)
    kmers, counts = kmers[order].astype(np.uint64), counts[order]
    n = (k - prefix_length) // 4
    prefix = (kmers >> np.uint64(8 * n)).astype(np.int64)
    starts = np.searchsorted(prefix, np.arange(1 << (2 * prefix_length))).astype("<u8")
    rows = [((kmers >> np.uint64(8 * (n - 1 - i))) & np.uint64(255)).astype(np.uint8) for i in range(n)]
    rows += [((np.minimum(counts, (1 << (8 * counter_size)) - 1) >> (8 * i)) & 255).astype(np.uint8) for i in range(counter_size)]
    header = struct.pack("<6I", k, 0, counter_size, prefix_length, 1, 0xFFFFFFFF) + struct.pack("<Q", len(kmers)) + bytes([0, 0, 0, 0]) + struct.pack("<I", 0)
    header += b"\0" * 20
    pre = MARKS[0] + starts.tobytes() + header + struct.pack("<I", V1) + struct.pack("<I", len(header) + 4) + MARKS[0]
    suf = MARKS[1] + (np.stack(rows, axis=1).tobytes() if len(kmers) else b"") + MARKS[1]
    return pre, suf


def read_database(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, count) of the database at ``path`` (without the file endings)."""
    pre = spark.read.format("binaryFile").load(path + ".kmc_pre").select(F.lit(1).alias("one"), F.col("content").alias("pre"))
    suf = spark.read.format("binaryFile").load(path + ".kmc_suf").select(F.lit(1).alias("one"), F.col("content").alias("suf"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, s in zip(frame["pre"], frame["suf"]):
                kmer, count = decode(bytes(p), bytes(s))
                for at in range(0, len(kmer), 1 << 18):
                    yield pd.DataFrame({"kmer": kmer[at : at + (1 << 18)].view(np.int64), "count": count[at : at + (1 << 18)]})

    return pre.join(suf, "one").mapInPandas(run, "kmer long, count long")


def dump(df: DataFrame, path: str, k: int) -> None:
    """k-mer and count as tab-separated text."""
    from ..functions.sequence import decode_kmer

    df.select(decode_kmer(F.col("kmer"), k).alias("kmer"), "count").write.option("sep", "\t").csv(path)
