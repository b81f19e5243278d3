"""Order-dependent graph kernels on one component: bubbles, beam search, greedy pruning.

Each works on plain dictionaries of one component and is run by a grouped map
keyed by component, with an explicit total order.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from ..functions.stats import log_depth_distance


@dataclass
class Edge:
    id: int
    ends: tuple
    sides: tuple
    overlap: int
    shared: int = 0
    diff: int = 0
    minimizers: int = 1

    def across(self, node, side: bool | None = None) -> tuple:
        """(other node, side on which the edge touches it)."""
        if self.ends[0] == self.ends[1]:
            return self.ends[1], self.sides[1] if side is None or side == self.sides[0] else self.sides[0]
        i = 0 if self.ends[0] == node else 1
        return self.ends[1 - i], self.sides[1 - i]

    def identity(self, c: int) -> float:
        a = self.diff / max(self.minimizers * c, 1)
        return 1 - a / (1 + a)


@dataclass
class Graph:
    reads: dict
    depths: dict
    unique: dict
    edges: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.at = defaultdict(list)
        for e in sorted(self.edges.values(), key=lambda e: e.id):
            for node, side in set(zip(e.ends, e.sides)):
                self.at[(node, side)].append(e)

    def bubble(self, source, side: bool, longest: int, most_nodes: int = 1000) -> tuple | None:
        """(sink, side at the sink, nodes to remove, edges to remove) of the superbubble that opens at ``source``.

        A vertex is a node with the side it is left by, ready once every edge
        into it was seen; the bubble closes where one vertex is ready and none
        waits.  The walk may come round to the source on its other side, which
        then is the sink (a circle with one bubble); coming back on the side it
        left by, or passing a node both ways, ends the search.  Of all paths the
        one with the largest sum of depth times reads stays.
        """
        start, home = (source, side), (source, side, "again")
        if len(self.at[start]) < 2:
            return None
        parents = lambda v: len(self.at[(v[0], not v[1])])
        gain, reach, last = {start: 0.0}, {start: 0}, {}
        missing, ready, edges, ways = {}, [start], set(), {}
        while ready and len(reach) <= most_nodes:
            vertex = ready.pop()
            if vertex == home or reach[vertex] > longest:
                return None
            for e in self.at[vertex[:2]]:
                edges.add(e.id)
                node, into = e.across(*vertex[:2])
                if (node == source and into == side) or ways.setdefault(node, into) != into:
                    return None
                child = home if node == source else (node, not into)
                worth = gain[vertex] + (0.0 if child == home else sum(self.depths[node]) * self.reads[node])
                far = reach[vertex] + (0 if child == home else self.unique[node])
                missing[child] = missing.get(child, parents(child)) - 1
                reach[child] = min(reach.get(child, far), far)
                if worth > gain.get(child, -1.0):
                    gain[child], last[child] = worth, (vertex, e.id)
                if not missing[child]:
                    ready.append(child)
            if len(ready) == 1 and not any(missing.values()) and parents(ready[0]) > 1:
                sink, step, path, used = ready[0], ready[0], {source}, set()
                while step in last:
                    path.add(step[0])
                    step, edge = last[step]
                    used.add(edge)
                return sink[0], not sink[1], {v[0] for v in missing} - path, edges - used
        return None

    def bubbles(self, longest: int) -> tuple[set, set]:
        """Nodes and edges to remove: bubbles on which the searches from both ends agree, larger nodes first."""
        nodes, edges = set(), set()
        for source in sorted(self.reads, key=lambda n: (-self.reads[n], n)):
            for side in (False, True):
                found = self.bubble(source, side, longest)
                if not found or found[0] in nodes or source in nodes:
                    continue
                again = self.bubble(found[0], found[1], longest)
                if again and again[0] == source and again[3] == found[3]:
                    nodes |= found[2]
                    edges |= found[3]
        return nodes, edges

    def step_score(self, node, side: bool, e: Edge, carried: list, temperature: float, c: int) -> float:
        """Log score of leaving a node by an edge: alike depths, few differing markers, long overlap."""
        rivals = self.at[(node, side)]
        other, _ = e.across(node, side)
        gap = log_depth_distance(carried, [(list(self.depths[other]), self.reads[other])])
        if gap is None:
            return -100.0
        best = max(r.identity(c) for r in rivals)
        length = max(r.overlap for r in rivals)
        return max(-100.0, (-gap + 200 * (e.identity(c) - best) + 0.5 * math.log2(e.overlap / length)) / temperature)

    def beam(self, start, longest: int, depth: int, temperature: float = 1.0, c: int = 9, width: int = 10) -> dict:
        """{(edge, node it was left from): weight} of the walks from a node, soft-max over their end scores, weighted by root reads."""
        weights: dict = defaultdict(float)
        for side in (False, True):
            if not self.at[(start, side)]:
                continue
            live = [(0.0, 0, [(start, side)], [], [(list(self.depths[start]), self.reads[start])])]
            done = []
            for _ in range(depth):
                grown = []
                for walk in live:
                    score, length, stops, path, carried = walk
                    node, out = stops[-1]
                    if length > longest or not self.at[(node, out)]:
                        done.append(walk)
                        continue
                    for e in self.at[(node, out)]:
                        other, into = e.across(node, out)
                        grown.append((score + self.step_score(node, out, e, carried, temperature, c), length + self.unique[other], [*stops, (other, not into)], [*path, e.id], [*carried, (list(self.depths[other]), self.reads[other])]))
                grown.sort(key=lambda w: (-w[0], w[3]))
                live = grown[:width]
                if not live:
                    break
            done += live
            top = max(w[0] for w in done)
            total = sum(math.exp(w[0] - top) for w in done)
            for score, _, stops, path, _ in done:
                share = math.sqrt(self.reads[start]) * math.exp(score - top) / total
                for edge, (node, _) in zip(path, stops):
                    weights[(edge, node)] += share
        return dict(weights)

    def edge_weights(self, longest: int, depth: int, **options) -> dict:
        """{edge: weight}: beam weights summed over all starts, the smaller of an edge's two ends."""
        total: dict = defaultdict(float)
        for start in sorted(self.reads):
            for key, w in self.beam(start, longest, depth, **options).items():
                total[key] += w
        return {e.id: min(total.get((e.id, n), 0.0) for n in e.ends) for e in self.edges.values()}

    def leads_on(self, node, side: bool, cut: set, far: int, most: int = 25) -> bool:
        """Whether a node's side still leads on for ``far`` bases, or further than ``most`` steps, without the edges in ``cut``."""
        reach, frontier, steps = {(node, side): 0}, [(node, side)], 0
        while frontier:
            at = frontier.pop(0)
            for e in self.at[at]:
                if e.id in cut:
                    continue
                other, into = e.across(*at)
                length = reach[at] + self.unique[other]
                steps += 1
                if length >= far or steps >= most or other == node:
                    return True
                if (other, not into) not in reach:
                    reach[(other, not into)] = length
                    frontier.append((other, not into))
        return False

    def safe(self, i: int, cut: set, far: int) -> bool:
        """Whether cutting edge ``i`` makes no tip: both its sides still lead on, or are dead ends even with it."""
        e = self.edges[i]
        more = cut | {i}
        return all(self.leads_on(n, s, more, far) or not self.leads_on(n, s, cut, far) for n, s in zip(e.ends, e.sides))

    def lax_cuts(self, same: dict, order: list) -> set:
        """Edges to cut, in ``order``: not of one strain, while both their sides still have an edge that is."""
        cut: set = set()
        for i in order:
            e = self.edges[i]
            if same[i]:
                continue
            if all(any(same[r.id] and r.id not in cut for r in self.at[(n, s)]) for n, s in zip(e.ends, e.sides)):
                cut.add(i)
        return cut

    def bridged_cuts(self, order: list, ratio: float) -> set:
        """Edges to cut, in ``order``: overlap under ``ratio`` of the best left on both their sides, never a side's last edge."""
        cut: set = set()
        for i in order:
            e = self.edges[i]
            sides = [[r for r in self.at[(n, s)] if r.id not in cut] for n, s in zip(e.ends, e.sides)]
            if all(len(s) > 1 and e.overlap < ratio * max(r.overlap for r in s) for s in sides):
                cut.add(i)
        return cut
