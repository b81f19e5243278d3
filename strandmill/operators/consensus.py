"""Window consensus: alignment, window cutting, partial-order consensus, joining.

Alignment and consensus are dynamic programmes on one window's sequences and
run in grouped maps keyed by (contig, window), which coverage limits bound.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

MATCH, MISMATCH, OPEN, EXTEND = 1, -2, -3, -2


def align(query: str, ref: str, band: int | None = None, local: bool = False) -> tuple[int, list[tuple[str, int]], tuple[int, int, int, int]]:
    """(score, CIGAR, (query start, query end, ref start, ref end)) by affine-gap dynamic programming.

    Global unless ``local``.  A gap of n costs OPEN + (n - 1) * EXTEND.
    """
    n, m = len(query), len(ref)
    if n == 0 or m == 0:
        cigar = [("I", n)] if n else [("D", m)] if m else []
        return (OPEN + EXTEND * (max(n, m) - 1) if max(n, m) and not local else 0), [] if local else cigar, (0, 0 if local else n, 0, 0 if local else m)
    low = -(10**9)
    h = np.full((n + 1, m + 1), low, np.int64)
    e = np.full((n + 1, m + 1), low, np.int64)
    f = np.full((n + 1, m + 1), low, np.int64)
    h[0, 0] = 0
    if local:
        h[0, :] = h[:, 0] = 0
    else:
        h[0, 1:] = e[0, 1:] = OPEN + EXTEND * np.arange(m)
        h[1:, 0] = f[1:, 0] = OPEN + EXTEND * np.arange(n)
    r = np.frombuffer(ref.encode(), np.uint8)
    q = np.frombuffer(query.encode(), np.uint8)
    steps = EXTEND * np.arange(m + 1)
    for i in range(1, n + 1):
        f[i, 1:] = np.maximum(h[i - 1, 1:] + OPEN, f[i - 1, 1:] + EXTEND)
        best = np.maximum(h[i - 1, :-1] + np.where(r == q[i - 1], MATCH, MISMATCH), f[i, 1:])
        if local:
            best = np.maximum(best, 0)
        # Horizontal gaps: a running maximum of what opening at each earlier column would give.
        opened = np.concatenate([[h[i, 0]], best]) + OPEN - EXTEND - steps
        e[i, 1:] = np.maximum.accumulate(opened)[:-1] + steps[1:] + 0
        h[i, 1:] = np.maximum(best, e[i, 1:])
        if band is not None:
            far = np.abs(np.arange(1, m + 1) * n // m - i) > band
            h[i, 1:][far] = low
    i, j = (int(x) for x in np.unravel_index(h.argmax(), h.shape)) if local else (n, m)
    score, end, ops = int(h[i, j]), (i, j), []
    state = "M"
    while (i > 0 or j > 0) and not (local and state == "M" and h[i, j] == 0):
        if state == "M":
            if i > 0 and j > 0 and h[i, j] == h[i - 1, j - 1] + (MATCH if q[i - 1] == r[j - 1] else MISMATCH):
                ops.append("M")
                i, j = i - 1, j - 1
            elif i > 0 and h[i, j] == f[i, j]:
                state = "I"
            else:
                state = "D"
        elif state == "I":
            ops.append("I")
            state = "M" if f[i, j] == h[i - 1, j] + OPEN else "I"
            i -= 1
        else:
            ops.append("D")
            state = "M" if e[i, j] == h[i, j - 1] + OPEN else "D"
            j -= 1
    cigar: list[tuple[str, int]] = []
    for op in reversed(ops):
        cigar = [*cigar[:-1], (op, cigar[-1][1] + 1)] if cigar and cigar[-1][0] == op else [*cigar, (op, 1)]
    return score, cigar, (i, end[0], j, end[1])


def merged(*cigars: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """CIGARs one after the other, equal neighbours joined."""
    out: list[tuple[str, int]] = []
    for op, n in (x for c in cigars for x in c if x[1]):
        out = [*out[:-1], (op, out[-1][1] + n)] if out and out[-1][0] == op else [*out, (op, n)]
    return out


def extend_end(query: str, ref: str, drop: int = 100) -> tuple[int, list[tuple[str, int]]]:
    """(bases of each used, CIGAR) of the best gapless-by-diagonal extension, given up once the score falls ``drop`` under its best."""
    n = min(len(query), len(ref))
    if n == 0:
        return 0, []
    same = np.frombuffer(query[:n].encode(), np.uint8) == np.frombuffer(ref[:n].encode(), np.uint8)
    score = np.cumsum(np.where(same, MATCH, MISMATCH))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > drop)
    score = score[: fallen[0]] if len(fallen) else score
    best = int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0
    return best, [("M", best)] if best else []


def align_chain(query: str, ref: str, points: list[tuple[int, int]], k: int) -> tuple[list[tuple[str, int]], tuple[int, int, int, int]]:
    """(CIGAR, (query start, query end, ref start, ref end)) through colinear seeds (query position, ref position) of length k.

    Seeds that overlap the one before are left out; the stretches between seeds
    are aligned globally, the ends extended.
    """
    kept: list[tuple[int, int]] = []
    for q, r in sorted(points):
        if not kept or (q >= kept[-1][0] + k and r >= kept[-1][1] + k):
            kept.append((q, r))
    if not kept:
        return [], (0, 0, 0, 0)
    (q0, r0), (q1, r1) = kept[0], kept[-1]
    back, head = extend_end(query[:q0][::-1], ref[:r0][::-1])
    on, tail = extend_end(query[q1 + k :], ref[r1 + k :])
    parts = [head]
    for i, (q, r) in enumerate(kept):
        parts.append([("M", k)])
        if i + 1 < len(kept):
            parts.append(align(query[q + k : kept[i + 1][0]], ref[r + k : kept[i + 1][1]])[1])
    return merged(*parts, tail), (q0 - back, q1 + k + on, r0 - back, r1 + k + on)


def trim_by_coverage(consensus: str, seqs: list[str]) -> str:
    """The consensus between the median start and the median end of the sequences that align to it."""
    spans = [s for score, _, s in (align(x, consensus, local=True) for x in seqs) if score >= 10]
    if not spans:
        return consensus
    starts, ends = sorted(s[2] for s in spans), sorted(s[3] for s in spans)
    return consensus[starts[(len(starts) - 1) // 2] : ends[(len(ends) - 1) // 2]]


def join_circle(seq: str, overlap: int, hang_end: int = 0, hang_start: int = 0, slack: int = 50) -> str:
    """A circle's sequence without the repeat of its start at its end; unchanged if the ends do not align."""
    reach = min(overlap + hang_end + hang_start + slack, len(seq) // 2)
    if reach < 10:
        return seq
    tail, head = seq[-reach:], seq[:reach]
    score, _, (a, b, c, d) = align(tail, head, local=True)
    return seq if score < 10 else seq[c : len(seq) - (len(tail) - a)]


def breakpoints(length: int, width: int) -> list[int]:
    """Window ends: width, 2 * width, ... and the contig's end."""
    return [*range(width, length, width), length]


def cut_windows(seq: str, cigar: list[tuple[str, int]], ref_start: int, length: int, width: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(window, query start, query end) of the windows an alignment meets, each window reaching ``overlap`` into the next."""
    at_ref, at_query = [ref_start], [0]
    for op, n in cigar:
        if op in "M=X":
            at_ref += range(at_ref[-1] + 1, at_ref[-1] + n + 1)
            at_query += range(at_query[-1] + 1, at_query[-1] + n + 1)
        elif op == "I":
            at_query[-1] += n
        else:
            at_ref += range(at_ref[-1] + 1, at_ref[-1] + n + 1)
            at_query += [at_query[-1]] * n
    refs, queries = np.array(at_ref), np.array(at_query)
    ends = breakpoints(length, width)
    first = max(0, min(ref_start // width, len(ends) - 1))
    out, begin = [], first * width
    for w, end in enumerate(ends[first : int(refs[-1]) // width + 1], first):
        a, b = max(begin, ref_start), min(end + overlap, int(refs[-1]))
        if a < min(end, int(refs[-1])) and b > a:
            out.append((w, int(queries[np.searchsorted(refs, a, side="right") - 1]) if a > ref_start else 0, int(queries[np.searchsorted(refs, b, side="right") - 1])))
        begin = end
    return out


def aligned_windows(start: Column, stop: Column, length: Column, width: int, overlap: int = 0) -> Column:
    """``cut_windows`` of an alignment without gaps at start to stop, as an array of (window, begin, end); only windows it meets are formed."""
    first = F.greatest(F.floor(start / width), F.lit(0).cast("long"))
    last = F.ceil(F.least(stop, length) / width) - 1
    end = lambda w: F.least((w + 1) * width, length)
    span = lambda w: F.struct(w.cast("int").alias("window"), (F.greatest(w * width, start) - start).cast("int").alias("begin"), (F.least(end(w) + overlap, stop) - start).cast("int").alias("end"))
    met = lambda w: F.greatest(w * width, start) < F.least(end(w), stop)
    return F.when(first <= last, F.transform(F.filter(F.sequence(first, last), met), span)).otherwise(F.array().cast("array<struct<window:int,begin:int,end:int>>"))


def poa(seqs: list[str], weights: list[list[int]] | None = None) -> str:
    """Partial-order consensus: sequences are aligned to a growing graph one by one; the heaviest path is returned.

    Edges carry the weights of the bases they join; ties go to the older node.
    """
    seqs = [s for s in seqs if s]
    if not seqs:
        return ""
    weights = weights or [[1] * len(s) for s in seqs]
    base: list[str] = []
    into: list[dict[int, int]] = []
    rank: list[int] = []

    def order() -> list[int]:
        waiting = [len(x) for x in into]
        outs: list[list[int]] = [[] for _ in base]
        for v, xs in enumerate(into):
            for u in xs:
                outs[u].append(v)
        ready, out = [v for v, k in enumerate(waiting) if k == 0], []
        while ready:
            v = ready.pop()
            out.append(v)
            for u in outs[v]:
                waiting[u] -= 1
                if waiting[u] == 0:
                    ready.append(u)
        return out

    def add(ch: str) -> int:
        base.append(ch)
        into.append({})
        rank.append(0)
        return len(base) - 1

    for seq, weight in zip(seqs, weights):
        if not base:
            prev = -1
            for ch, w in zip(seq, weight):
                node = add(ch)
                if prev >= 0:
                    into[node][prev] = w
                prev = node
            continue
        topo = order()
        n = len(seq)
        q = np.frombuffer(seq.encode(), np.uint8)
        gaps = -2 * np.arange(n + 1)
        rows: dict[int, np.ndarray] = {-1: gaps.copy()}
        for v in topo:
            prevs = list(into[v]) or [-1]
            above = np.max([rows[u] for u in prevs], axis=0)
            fit = np.where(q == ord(base[v]), 5, -2)
            row = np.concatenate([[above[0] - 2], np.maximum(above[:-1] + fit, above[1:] - 2)])
            rows[v] = np.maximum.accumulate(row - gaps) + gaps
        ends = set(range(len(base))) - {u for xs in into for u in xs}
        v = max(sorted(ends), key=lambda u: rows[u][n])
        pairs: list[tuple[int, int]] = []
        j = n
        while v >= 0 or j > 0:
            if v < 0:
                pairs.append((-1, j - 1))
                j -= 1
                continue
            prevs = sorted(into[v]) or [-1]
            here = rows[v][j]
            s = 5 if j and seq[j - 1] == base[v] else -2
            step = next((u for u in prevs if j and rows[u][j - 1] + s == here), None)
            if step is not None:
                pairs.append((v, j - 1))
                v, j = step, j - 1
                continue
            step = next((u for u in prevs if rows[u][j] - 2 == here), None)
            if step is not None:
                v = step
            else:
                pairs.append((-1, j - 1))
                j -= 1
        prev = -1
        for v, j in reversed(pairs):
            node = v if v >= 0 and base[v] == seq[j] else add(seq[j])
            if prev >= 0:
                into[node][prev] = into[node].get(prev, 0) + weight[j]
            prev = node
    topo = order()
    score: dict[int, tuple[int, int]] = {}
    for v in topo:
        best = max(((w, score[u][0], -u) for u, w in into[v].items()), default=None)
        score[v] = (0, -1) if best is None else (best[0] + best[1], -best[2])
    v = max(sorted(score), key=lambda u: score[u][0])
    out = []
    while v >= 0:
        out.append(base[v])
        v = score[v][1]
    return "".join(reversed(out))


def homopolymers(seq: str) -> list[tuple[str, int]]:
    runs: list[tuple[str, int]] = []
    for ch in seq:
        runs = [*runs[:-1], (ch, runs[-1][1] + 1)] if runs and runs[-1][0] == ch else [*runs, (ch, 1)]
    return runs


def expand_runs(consensus: str, seqs: list[str]) -> str:
    """A run-compressed consensus with each run's length voted for by the sequences that align to it."""
    votes: list[Counter] = [Counter() for _ in consensus]
    for seq in seqs:
        runs = homopolymers(seq)
        _, cigar, _ = align("".join(c for c, _ in runs), consensus)
        i = j = 0
        for op, n in cigar:
            for _ in range(n):
                if op == "M" and runs[i][0] == consensus[j]:
                    votes[j][runs[i][1]] += 1
                i += op in "MI"
                j += op in "MD"
    return "".join(ch * (max(v.items(), key=lambda x: (x[1], -x[0]))[0] if v else 1) for ch, v in zip(consensus, votes))


def window_consensus(seqs: list[str], quals: list[float], draft: str = "", top: int = 75, long_run: int = 10) -> str:
    """Consensus of one window: the best sequences by quality and length, trimmed of outliers.

    No sequence gives the draft, one gives itself.  If the best sequence has a
    run of ``long_run``, runs are compressed first and their lengths voted on.
    """
    if len(seqs) < 2:
        return chosen_consensus(seqs, draft, long_run)
    p75 = float(np.percentile([len(s) for s in seqs], 75))
    ranked = sorted(zip(seqs, quals), key=lambda x: (-(x[1] - abs(len(x[0]) - p75)), x[0]))
    if len(ranked) > 20:
        ranked = ranked[: len(ranked) - len(ranked) // 20]
    return chosen_consensus([s for s, _ in ranked[:top]], draft, long_run)


def chosen_consensus(chosen: list[str], draft: str = "", long_run: int = 10) -> str:
    """Consensus of sequences already ranked and trimmed, the best one first."""
    if not chosen:
        return draft
    if len(chosen) == 1:
        return chosen[0]
    if any(n >= long_run for _, n in homopolymers(chosen[0])):
        return expand_runs(poa(["".join(c for c, _ in homopolymers(s)) for s in chosen]), chosen)
    found = poa(chosen)
    return trim_by_coverage(found, chosen) if len(chosen) > 15 else found


def join_windows(parts: list[str], overlap: int) -> str:
    """Consecutive window consensuses joined where their overlaps align best."""
    out = ""
    for part in parts:
        if not out or not part:
            out = out or part
            continue
        tail = out[-2 * overlap :]
        score, _, (a, b, c, d) = align(tail, part[: 2 * overlap], local=True)
        out = out + part if score < 10 else out[: len(out) - len(tail) + b] + part[d:]
    return out


def best_of_windows(windows: DataFrame, top: int = 75) -> DataFrame:
    """(contig, window, seq, quality, rank): the sequences that ``window_consensus`` would choose, so that a deep window is cut before its kernel.

    The 75th percentile of length and the rank are over all sequences of a window; the worst twentieth of all goes before ``top`` are kept.
    """
    keys = ["contig", "window"]
    windows = stored(windows.select(*keys, "seq", "quality"), "windows")
    lengths = windows.groupBy(*keys).agg(F.percentile(F.length("seq"), 0.75).alias("p75"), F.count("*").alias("n"))
    score = F.col("quality") - F.abs(F.length("seq") - F.col("p75"))
    ranked = windows.join(lengths, keys).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "seq")))
    trimmed = F.col("n") - F.when(F.col("n") > 20, F.floor(F.col("n") / 20)).otherwise(0)
    return ranked.where((F.col("rank") <= top) & (F.col("rank") <= trimmed)).select(*keys, "seq", "quality", "rank")


def polish(windows: DataFrame, overlap: int = 205) -> DataFrame:
    """(contig, seq, windows) from (contig, window, seq, quality): consensus of each window, then joined in order."""
    kind = dict(windows.dtypes)["contig"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        return pd.DataFrame([(rows["contig"].iloc[0], rows["window"].iloc[0], chosen_consensus(rows["seq"].tolist()))], columns=["contig", "window", "seq"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window")
        return pd.DataFrame([(rows["contig"].iloc[0], join_windows(rows["seq"].tolist(), overlap), len(rows))], columns=["contig", "seq", "windows"])

    each = best_of_windows(windows).groupBy("contig", "window").applyInPandas(one, f"contig {kind}, window int, seq string")
    return each.groupBy("contig").applyInPandas(whole, f"contig {kind}, seq string, windows int")
