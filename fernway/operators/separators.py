"""Separators of a network: few nodes that every way between two sides of it passes, side by side and again within each side.

Nodes are dealt into layers by the number of edges, of either direction, to a node at the rim; edges join a layer with itself and the next
alone, so that a layer parts those before it from those behind it. The smallest layer near the middle is taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np

from fernway.operators.ordered import Network

#: Nodes of a part that is divided, at least, and levels of parts at most.
LEAST_PART, MOST_LEVELS = 2000, 16


@dataclass
class Parts:
    """``of``: by level the part of each node, -1 for none. ``nodes``, ``between``: of each part its nodes and separator, None if it is not divided."""

    of: list[np.ndarray]
    nodes: list[np.ndarray]
    between: list[np.ndarray | None]
    level: list[int]


def _neighbours(net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Of each node where its neighbours begin, and the neighbours, in either direction."""
    a, b = np.concatenate((net.u, net.v)), np.concatenate((net.v, net.u))
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(len(net.ids) + 1)), b[order]


def _layers(first: np.ndarray, ends: np.ndarray, nodes: np.ndarray, start: int, todo: np.ndarray) -> tuple[np.ndarray, int]:
    """The layer of each of the nodes and the last one reached; what is not joined follows, with an empty layer between. ``todo`` is used up."""
    layer, at, depth, next_ = np.full(len(todo), -1, dtype=np.int64), np.array([start]), 0, 0
    todo[nodes] = True
    while True:
        while len(at):
            todo[at], layer[at] = False, depth
            last, depth = int(at[-1]), depth + 1
            sizes = first[at + 1] - first[at]
            reached = ends[np.repeat(first[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            at = np.unique(reached[todo[reached]])
        while next_ < len(nodes) and not todo[nodes[next_]]:
            next_ += 1
        if next_ == len(nodes):
            return layer[nodes], last
        at, depth = nodes[next_ : next_ + 1], depth + 1


def rim(net: Network) -> int:
    """A node of the layer that is farthest from the first node."""
    first, ends = _neighbours(net)
    return _layers(first, ends, np.arange(len(net.ids)), 0, np.zeros(len(net.ids), dtype=bool))[1]


def parts(net: Network, n_queries: int) -> Parts:
    """Parts in which searches from their separators are fewer than the queries that are likely to have both ends there."""
    first, ends = _neighbours(net)
    n, todo = len(net.ids), np.zeros(len(net.ids), dtype=bool)
    found = Parts([], [], [], [])
    now = [np.arange(n)]
    for level in range(MOST_LEVELS):
        of, after = np.full(n, -1, dtype=np.int32), []
        for nodes in now:
            of[nodes] = len(found.nodes)
            found.nodes.append(nodes)
            found.level.append(level)
            between = None
            if len(nodes) >= LEAST_PART and level + 1 < MOST_LEVELS:
                _, rim = _layers(first, ends, nodes, int(nodes[0]), todo)
                layer, _ = _layers(first, ends, nodes, rim, todo)
                sizes = np.bincount(layer)
                before = np.cumsum(sizes) - sizes
                middle = np.flatnonzero((before >= 0.3 * len(nodes)) & (before + sizes <= 0.7 * len(nodes)))
                if len(middle):
                    best = middle[sizes[middle].argmin()]
                    if 2 * sizes[best] < n_queries * (len(nodes) / n) ** 2:
                        between = nodes[layer == best]
                        after += [nodes[layer < best], nodes[layer > best]]
            found.between.append(between)
        found.of.append(of)
        now = [x for x in after if len(x)]
        if not now:
            break
    return found


def reached(near: list, start: int, inside: bytearray) -> np.ndarray:
    """What it costs from ``start`` to each node, within a part of the network; infinite where it can't be reached."""
    cost, heap = [math.inf] * len(inside), [(0.0, start)]
    cost[start] = 0.0
    while heap:
        spent, node = heappop(heap)
        if spent > cost[node]:
            continue
        for _, end, free in near[node]:
            if inside[end]:
                total = spent + free
                if total < cost[end]:
                    cost[end] = total
                    heappush(heap, (total, end))
    return np.array(cost)
