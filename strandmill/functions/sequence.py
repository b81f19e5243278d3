"""Scalar functions on sequences, as column expressions and as vectorised kernels.

Sequences are strings over ACGT.  A packed k-mer is a long with two bits a base,
the first base in the highest pair (A=0, C=1, G=2, T=3).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
CODE = np.zeros(256, np.uint64)
for _i, _b in enumerate(BASES):
    CODE[ord(_b)] = CODE[ord(_b.lower())] = _i
CODE[ord("U")] = CODE[ord("u")] = 3


def clean_bases(text: Column) -> Column:
    """The A, C, G and T letters of a text, upper-cased, in order."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def revcomp(seq: Column) -> Column:
    """Reverse complement; any other character becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCATGCA"))


def compress_homopolymers(seq: Column) -> Column:
    """Every run of one character as a single one."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def first_word(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), r"\s+"), 1)


def encode_base(base: Column) -> Column:
    """Two-bit code of a base; anything but ACGTU counts as A."""
    return F.coalesce(F.nullif(F.instr(F.lit("ACGT"), F.replace(F.upper(base), F.lit("U"), F.lit("T"))), F.lit(0)) - 1, F.lit(0))


def decode_kmer(kmer: Column, k: int) -> Column:
    """Packed k-mer to string."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", BASES)


def middle_shift(k: int) -> int:
    return 2 * (k // 2)


def masked(kmer: Column, k: int) -> Column:
    """Packed k-mer with its middle base cleared."""
    return kmer.bitwiseAND(F.lit(((1 << 2 * k) - 1) & ~(3 << middle_shift(k))))


def middle(kmer: Column, k: int) -> Column:
    """Two-bit code of the middle base."""
    return F.shiftright(kmer, middle_shift(k)).bitwiseAND(F.lit(3)).cast("int")


def mask_string(kmer: Column, k: int) -> Column:
    return F.overlay(kmer, F.lit("_"), F.lit(k // 2 + 1), F.lit(1))


def phred_identity(quals: Column) -> Column:
    """100 * (1 - mean error) of an array of Phred values; null for a null or empty array."""
    n = F.size(quals)
    errors = F.aggregate(quals, F.lit(0.0), lambda a, q: a + F.pow(F.lit(10.0), -q / 10.0))
    return F.when(n > 0, 100.0 * (1.0 - errors / n))


def quality_bin(q: Column) -> Column:
    """Phred+33 byte to a four-bit bin: the offset rounded to the nearest 3, within 0..15."""
    return F.least(F.greatest(F.floor((q - 33) / 3.0 + 0.5), F.lit(0)), F.lit(15)).cast("int")


def bin_quality(code: Column) -> Column:
    return code * 3 + 33


def block_minimum(values: Column, width: int = 4) -> Column:
    """Minimum of each block of ``width`` values."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(width)))
    return F.coalesce(F.transform(starts, lambda s: F.array_min(F.slice(values, s, width))), F.slice(values, 1, 0))


def deltas(positions: Column) -> Column:
    """Ascending positions as first value and differences."""
    return F.transform(positions, lambda p, i: F.when(i == 0, p).otherwise(p - F.get(positions, i - 1)))


def undeltas(steps: Column) -> Column:
    """Inverse of ``deltas``: running sums, by blocks of about the square root of the length, so that no step adds up a whole prefix."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b)
    # An array of one element binds its value, so that it is computed once and not for every element.
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def sums(s: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(s))).cast("int"), F.lit(1))
        last = F.floor(F.greatest(F.size(s) - 1, F.lit(0)) / width).cast("int")
        each = lambda make: F.transform(F.sequence(F.lit(0), last), make)
        blocks = each(lambda block: total(F.slice(s, block * width + 1, width)))
        starts = lambda b: each(lambda block: total(F.slice(b, F.lit(1), block)))
        place = lambda at, i: F.get(at, F.floor(i / width).cast("int")) + total(F.slice(s, i - i % width + 1, i % width + 1))
        return bind(blocks, lambda b: bind(starts(b), lambda at: F.transform(s, lambda _, i: place(at, i))))

    return bind(steps, sums)


def boundary_pair(start: Column, stop: Column) -> Column:
    return F.struct(start.alias("start"), (stop - start).alias("length"))


def rounded_div(a: Column, b: Column) -> Column:
    """Integer division rounded to nearest, for non-negative a and positive b."""
    return F.floor((a + F.floor(b / 2)) / b).cast("long")


def keep_indices(values: Column, indices: Column) -> Column:
    """The elements whose 0-based index is in ``indices``."""
    return F.filter(values, lambda x, i: F.array_contains(indices, i))


def clip_shift(positions: Column, low: Column, high: Column) -> Column:
    """Positions within [low, high), counted from low."""
    return F.transform(F.filter(positions, lambda p: (p >= low) & (p < high)), lambda p: p - low)


def nth_from_ends(positions: Column, n: int, low: Column, high: Column) -> Column:
    """(left, right): the n-th position from either end within [low, high]; the bounds where there are fewer."""
    inside = F.filter(positions, lambda p: (p >= low) & (p <= high))
    return F.struct(F.coalesce(F.get(inside, F.lit(n - 1)), low).alias("left"), F.coalesce(F.get(F.reverse(inside), F.lit(n - 1)), high).alias("right"))


def hang_minimizers(identity_pct: Column, k: int, most: int = 100, base: float = 20.0) -> Column:
    """How many minimizers from an end an overlap may start: min(100, 20 / identity^k)."""
    return F.least(F.lit(most), F.floor(base / F.pow(identity_pct / 100.0, F.lit(k)))).cast("int")


CIGAR_OPS = "struct<op:string,len:int>"


def merge_cigar(cigar: Column) -> Column:
    """CIGAR runs with = and X as M and equal neighbours merged."""
    zero = F.from_json(F.lit("[]"), f"array<{CIGAR_OPS}>")

    def add(acc: Column, x: Column) -> Column:
        op = F.when(x["op"].isin("=", "X"), "M").otherwise(x["op"])
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["op"].alias("op"), (last["len"] + x["len"]).alias("len"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == op), grown).otherwise(F.concat(acc, F.array(F.struct(op.alias("op"), x["len"].alias("len")))))

    return F.aggregate(cigar, zero, add)


def cigar_lengths(cigar: Column) -> Column:
    """(ref, query) bases that a CIGAR consumes."""
    total = lambda ops: F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ops)), F.lit(0), lambda a, x: a + x["len"])
    return F.struct(total("M=XD").alias("ref"), total("M=XI").alias("query"))


def cigar_interval(cigar: Column, stop: Column) -> Column:
    """(start, stop) on the reference of a CIGAR that ends before ``stop``; starts before 0 are 0."""
    return F.struct(F.greatest(stop - cigar_lengths(cigar)["ref"], F.lit(0)).alias("start"), stop.alias("stop"))


def cigar_string(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


# Vectorised kernels ---------------------------------------------------------------------------------------------------


def packed_kmers(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, reverse complement) packed k-mers at every position."""
    codes = CODE[np.frombuffer(seq, np.uint8)]
    n = len(codes) - k + 1
    if n <= 0:
        z = np.zeros(0, np.uint64)
        return z, z
    forward, reverse = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        forward = (forward << np.uint64(2)) | codes[j : j + n]
        reverse |= (np.uint64(3) - codes[j : j + n]) << np.uint64(2 * j)
    return forward, reverse


def canonical(forward: np.ndarray, reverse: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer, is forward, is masked palindrome): the strand whose k-mer is smaller with the middle base masked."""
    keep = np.uint64(((1 << 2 * k) - 1) & ~(3 << middle_shift(k)))
    a, b = forward & keep, reverse & keep
    return np.where(a <= b, forward, reverse), a < b, a == b


def wang_hash(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit integer mix (Wang's)."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = ~x + (x << u(21))
        x = x ^ (x >> u(24))
        x = x * u(265)
        x = x ^ (x >> u(14))
        x = x * u(21)
        x = x ^ (x >> u(28))
        return x + (x << u(31))


def wang_hash_variant(x: np.ndarray) -> np.ndarray:
    """The same mix with the complement taken after the first sum."""
    with np.errstate(over="ignore"):
        return wang_hash_tail(~(x + (x << np.uint64(21))))


def wang_hash_tail(x: np.ndarray) -> np.ndarray:
    u = np.uint64
    with np.errstate(over="ignore"):
        x = x ^ (x >> u(24))
        x = x * u(265)
        x = x ^ (x >> u(14))
        x = x * u(21)
        x = x ^ (x >> u(28))
        return x + (x << u(31))


def unhash(x: np.ndarray) -> np.ndarray:
    """Inverse of ``wang_hash``: each step undone by modular inverses and repeated shifts."""
    u, m = np.uint64, 1 << 64
    inverse = lambda odd: u(pow(odd, -1, m))

    def unshift(y: np.ndarray, s: int) -> np.ndarray:
        out = y.copy()
        for _ in range(64 // s):
            out = y ^ (out >> u(s))
        return out

    with np.errstate(over="ignore"):
        x = x * inverse(1 + (1 << 31))
        x = unshift(x, 28) * inverse(21)
        x = unshift(x, 14) * inverse(265)
        # x = ~key + (key << 21) = key * (2^21 - 1) - 1
        return (unshift(x, 24) + u(1)) * inverse((1 << 21) - 1)


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the (first) minima of all windows of w hashes, distinct and ascending."""
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def frac_min_hash(hashes: np.ndarray, c: int) -> np.ndarray:
    """Positions whose hash is under 2^64 / c."""
    return np.flatnonzero(hashes < np.uint64(((1 << 64) - 1) // c))


def open_syncmers(seq: bytes, k: int, c: int) -> np.ndarray:
    """Positions of k-mers whose middle s-mer has the strictly smallest hash, s = k - min(c, 11) + 1; larger c subsamples by hash."""
    s = k - min(c, 11) + 1
    forward, reverse = packed_kmers(seq, s)
    smers = wang_hash(np.minimum(forward, reverse))
    span = k - s + 1
    if len(smers) < span:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(smers, span)
    mid = span // 2
    least = windows.min(axis=1)
    picked = np.flatnonzero((windows[:, mid] == least) & ((windows == least[:, None]).sum(axis=1) == 1))
    if c > 11:
        f, r = packed_kmers(seq, k)
        kmers = canonical(f, r, k)[0]
        picked = picked[wang_hash(kmers[picked]) <= np.uint64(int(((1 << 64) - 1) / (c / 11)))]
    return picked


def frames(seq: str) -> list[str]:
    """The six reading frames, three of each strand, as amino acids (* stops, X unknown)."""
    table = str.maketrans("ACGT", "TGCA")
    return ["".join(codon(s[i : i + 3]) for i in range(phase, len(s) - 2, 3)) for s in (seq, seq.translate(table)[::-1]) for phase in range(3)]


#: Standard genetic code, codons in TCAG order (fixed values).
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon(triple: str) -> str:
    place = [("TCAG").find(b) for b in triple]
    return "X" if min(place) < 0 else AMINO[16 * place[0] + 4 * place[1] + place[2]]


def open_frames(seq: str, least: int = 30) -> list[tuple[int, int, int]]:
    """(frame, first, last) amino-acid bounds of stretches of at least ``least`` without a stop."""
    out = []
    for f, protein in enumerate(frames(seq)):
        at = 0
        for part in protein.split("*"):
            if len(part) >= least:
                out.append((f, at, at + len(part)))
            at += len(part) + 1
    return out
