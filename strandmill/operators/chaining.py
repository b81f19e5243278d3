"""Colinear chaining of anchors, chain selection and overlap geometry.

The chain kernel works on the anchors of one (query, ref) pair, which seed
multiplicity bounds; pairs are grouped maps, so a deep reference is many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_predecessors(x: np.ndarray, y: np.ndarray, match: int, gap: int, band: int, double_gap: int, max_gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, predecessor) of anchors sorted by x: each continues the best of at most ``band`` earlier anchors within reach.

    A continuation adds min(dx, dy, match) and pays ``gap`` for each unit of
    abs(dx - dy), which may be ``max_gap`` at most.  All predecessors of an
    anchor are scored at once; equal scores go to the nearest.
    """
    n = len(x)
    score, back = np.full(n, match, np.int64), np.full(n, -1, np.int64)
    low = np.searchsorted(x, x - double_gap, side="left")
    for i in range(1, n):
        a = max(low[i], i - band)
        if a == i:
            continue
        dx, dy = x[i] - x[a:i], y[i] - y[a:i]
        bend = np.abs(dx - dy)
        total = score[a:i] + np.minimum(np.minimum(dx, dy), match) - gap * bend
        total[(dx <= 0) | (dy <= 0) | (dy > double_gap) | (bend > max_gap)] = -1
        j = len(total) - 1 - int(total[::-1].argmax())
        if total[j] > match:
            score[i], back[i] = total[j], a + j
    return score, back


def chains(pos1: np.ndarray, pos2: np.ndarray, same_strand: np.ndarray, match: int = 10, gap: int = 1, band: int = 20, double_gap: int = 10_000, max_gap: int = 200, least: int = 3) -> list[tuple[int, np.ndarray, bool]]:
    """[(score, anchor indices in order, reverse)], best first; an anchor belongs to one chain.

    Strands are chained apart; on the reverse strand pos2 descends.
    """
    found = []
    for reverse in (False, True):
        own = np.flatnonzero(same_strand != reverse)
        if len(own) == 0:
            continue
        order = own[np.lexsort((-pos2[own] if reverse else pos2[own], pos1[own]))]
        x = pos1[order].astype(np.int64)
        y = (-pos2[order] if reverse else pos2[order]).astype(np.int64)
        score, back = best_predecessors(x, y, match, gap, band, double_gap, max_gap)
        used = np.zeros(len(x), bool)
        for end in np.lexsort((np.arange(len(x)), -score)):
            if score[end] <= least * match / 2:
                break
            path, at = [], int(end)
            while at >= 0 and not used[at]:
                used[at] = True
                path.append(at)
                at = int(back[at])
            if at < 0 and len(path) >= least:
                found.append((int(score[end]), order[path[::-1]], reverse))
    return sorted(found, key=lambda c: (-c[0], c[2], int(c[1][0])))


def select_chains(found: list[tuple[int, np.ndarray, bool]], pos1: np.ndarray, pos2: np.ndarray, share: float = 0.25, enough: int = 500, overlap: float = 0.25, secondary: float = 0.5) -> list[int]:
    """Indices of chains that are strong enough and overlap better ones by less than ``overlap``.

    A chain on the same stretch of the query may stay if its score is at least
    ``secondary`` of the best; on the same stretch of the reference never.
    """
    kept: list[int] = []
    spans = [((pos1[c].min(), pos1[c].max()), (pos2[c].min(), pos2[c].max())) for _, c, _ in found]

    def covered(a: tuple, b: tuple) -> float:
        return max(0, min(a[1], b[1]) - max(a[0], b[0])) / max(1, a[1] - a[0])

    for i, (score, _, _) in enumerate(found):
        if score <= share * found[0][0] and score <= enough:
            continue
        if any(covered(spans[i][1], spans[j][1]) > overlap for j in kept):
            continue
        if score < secondary * found[0][0] and any(covered(spans[i][0], spans[j][0]) > overlap for j in kept):
            continue
        kept.append(i)
    return kept


def chain_pairs(anchors: DataFrame, match: int, least_score: int = 0, **options) -> DataFrame:
    """(query, ref, chain, score, anchors, start1, end1, start2, end2, reverse) of selected chains of every pair."""
    kinds = dict(anchors.dtypes)
    columns = [c for c in ("query", "ref", "pos1", "pos2", "same_strand", "many") if c in anchors.columns]
    # Pairs with fewer anchors than a chain needs never leave the JVM; the count shares the grouping's shuffle.
    pair = Window.partitionBy("query", "ref")
    enough = anchors.select(*columns, F.count("*").over(pair).alias("_n")).where(F.col("_n") >= options.get("least", 3)).drop("_n")
    names = ["query", "ref", "chain", "score", "anchors", "start1", "end1", "start2", "end2", "reverse"]

    def run(rows: pa.Table) -> pa.Table:
        p1, p2, same = (rows.column(c).to_numpy() for c in ("pos1", "pos2", "same_strand"))
        band = options.get("band", min(20 * int(pc.max(rows.column("many")).as_py()), 2000) if "many" in columns else 20)
        found = chains(p1, p2, same.astype(bool), match=match, **(options | {"band": band}))
        kept = [found[i] for i in select_chains(found, p1, p2) if found[i][0] >= least_score]
        n = len(kept)
        spans = [(int(p1[c].min()), int(p1[c].max()), int(p2[c].min()), int(p2[c].max())) for _, c, _ in kept]
        ends = [pa.array([s[i] for s in spans], pa.int32()) for i in range(4)]
        first = [pa.array([rows.column(c)[0].as_py()] * n, rows.schema.field(c).type) for c in ("query", "ref")]
        data = [*first, pa.array(range(n), pa.int32()), pa.array([s for s, _, _ in kept], pa.int32()), pa.array([len(c) for _, c, _ in kept], pa.int32()), *ends, pa.array([r for _, _, r in kept], pa.bool_())]
        return pa.table(data, names=names)

    schema = f"query {kinds['query']}, ref {kinds['ref']}, chain int, score int, anchors int, start1 int, end1 int, start2 int, end2 int, reverse boolean"
    return enough.groupBy("query", "ref").applyInArrow(run, schema)


def dovetails(overlaps: DataFrame, hang: Column, least: int = 500, single: bool = False) -> DataFrame:
    """Overlaps as dovetails: hangs, overlap lengths and the side of each read that is joined.

    ``overlaps`` has start1, end1, start2, end2, len1, len2, reverse.  Read 1 is
    left by its end if the alignment reaches that, by its start otherwise; the
    other read must be reached at the matching end.  ``hang`` bounds both hangs.
    Reads that lie close to each other may fit both ways; ``single`` keeps the
    way with the smaller hangs.
    """
    s1, e1, s2, e2 = (F.col(c) for c in ("start1", "end1", "start2", "end2"))
    l1, l2 = F.col("len1"), F.col("len2")
    right1, left1, right2, left2 = l1 - e1, s1, l2 - e2, s2
    reverse = F.col("reverse")
    out = F.when(reverse, F.struct(right1.alias("hang1"), right2.alias("hang2"))).otherwise(F.struct(right1.alias("hang1"), left2.alias("hang2")))
    back = F.when(reverse, F.struct(left1.alias("hang1"), left2.alias("hang2"))).otherwise(F.struct(left1.alias("hang1"), right2.alias("hang2")))
    options = F.array(
        F.struct(F.lit(True).alias("forward1"), (~reverse).alias("forward2"), out["hang1"].alias("hang1"), out["hang2"].alias("hang2")),
        F.struct(F.lit(False).alias("forward1"), reverse.alias("forward2"), back["hang1"].alias("hang1"), back["hang2"].alias("hang2")),
    )
    fit = F.filter(options, lambda o: (o["hang1"] <= hang) & (o["hang2"] <= hang))
    if single:
        fit = F.slice(F.array_sort(fit, lambda a, b: (a["hang1"] + a["hang2"] - b["hang1"] - b["hang2"]).cast("int")), 1, 1)
    rows = overlaps.withColumn("overlap1_len", e1 - s1).withColumn("overlap2_len", e2 - s2).where(F.greatest("overlap1_len", "overlap2_len") >= least)
    return rows.withColumn("_o", F.explode(fit)).select("*", "_o.*").drop("_o")


def multi_hits(hits: DataFrame, slack: float = 0.33, overlap: float = 0.25, share: float = 0.7) -> DataFrame:
    """Read-to-contig hits that count: all perfect ones, then the best of the others in turn.

    Other hits are taken by identity and score while their identity exceeds the
    best imperfect one less ``slack`` of its shortfall; a hit on a stretch of
    the read that a kept one covers and with less than ``share`` of the best
    score ends the scan.  Needs query, ref, start1, end1, score, identity.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["identity", "score", "ref"], ascending=[False, False, True], ignore_index=True)
        perfect = rows["identity"] >= 1
        kept = list(np.flatnonzero(perfect))
        rest = rows[~perfect]
        if len(rest):
            cutoff = rest["identity"].max() - slack * (1 - rest["identity"].max())
            best = rows["score"].max()
            for i, r in rest.iterrows():
                if r["identity"] <= cutoff:
                    break
                length = max(1, r["end1"] - r["start1"])
                crossed = any(min(r["end1"], rows.at[j, "end1"]) - max(r["start1"], rows.at[j, "start1"]) > overlap * length for j in kept)
                if crossed and r["score"] < share * best:
                    break
                kept.append(i)
        return rows.loc[kept]

    return hits.groupBy("query").applyInPandas(run, hits.schema)
