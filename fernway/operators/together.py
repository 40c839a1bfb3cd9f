"""Costs from many origins at once, by edge costs that do not change with time: a row of numbers for each node, one for each origin.

Nodes whose row fell are followed by the least number that fell, many at a time, and again if others fall later. An edge adds to and compares
whole rows, so that the more origins lie near one another, the less an origin takes. The costs are, to the last bit, those of
searches in order of cost (:mod:`.ordered`), as both are the least sums along paths from the origin; how many nodes such a search settles is
read from them, and so are the routes, which holds where every edge raises the cost (:func:`rises`).
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np

from fernway.functions.scalar import MPH, RADIUS_M
from fernway.operators.ordered import Network, Ready

#: Numbers that a task holds of the costs of a batch, and origins of a batch at most.
HELD, MOST = 16_000_000, 128
#: Of the median cost of an edge: nodes whose numbers lie as near are followed at a time.
WIDTH = 0.2


def origins_at_a_time(net: Network, n_queries: int, tasks: int) -> int:
    """Of a batch."""
    return max(1, min(MOST, HELD // max(1, len(net.ids)), -(-n_queries // tasks)))


def rises(net: Network, blocked: float = 0.0) -> bool:
    """Whether every edge adds something to the cost of any route, as far as doubles tell."""
    free = net.free
    return not len(free) or bool(np.isfinite(free).all() and free.min() * 2.0**40 > len(net.ids) * max(free.max(), blocked))


def bound_holds(net: Network, max_mph: float) -> bool:
    """Whether the lower bound by the line never falls along an edge by more than the edge costs, so that it never settles a node by a dear way."""
    if net.lat is None or np.isnan(net.lat).any() or np.isnan(net.lon).any():
        return not len(net.ids)
    lat, lon = np.radians(net.lat), np.radians(net.lon)
    return bool((net.free >= _line(lat[net.u], lon[net.u], lat[net.v], lon[net.v], max_mph) * (1 + 1e-9)).all())


def _line(lat: np.ndarray, lon: np.ndarray, to_lat: np.ndarray, to_lon: np.ndarray, max_mph: float) -> np.ndarray:
    a = np.sin((to_lat - lat) / 2) ** 2 + np.cos(to_lat) * np.cos(lat) * np.sin((to_lon - lon) / 2) ** 2
    return 2 * RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0))) / (max_mph * MPH)


class Rows:
    """The edges that leave each node, and those that enter it, side by side."""

    def __init__(self, net: Network):
        self.first = np.searchsorted(net.u, np.arange(len(net.ids) + 1))
        self.into = np.argsort(net.v, kind="stable")
        self.first_into = np.searchsorted(net.v[self.into], np.arange(len(net.ids) + 1))
        self.width = WIDTH * float(np.median(net.free)) if len(net.free) else 0.0


def _of(first: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from ``first`` of each place up to that of the next, and how many each has."""
    low, sizes = first[places], first[places + 1] - first[places]
    ends = np.cumsum(sizes)
    return np.repeat(low - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


def rank(ready: Ready, start: int) -> list[int]:
    """Of each node its place in the order of cost from ``start``, by which near nodes lie together; nodes that it doesn't reach are last."""
    place, heap, done = [len(ready.ahead)] * len(ready.ahead), [(0.0, start)], 0
    while heap:
        spent, node = heappop(heap)
        if place[node] < len(place):
            continue
        place[node], done = done, done + 1
        for _, end, free in ready.ahead[node]:
            if place[end] == len(place):
                heappush(heap, (spent + free, end))
    return place


class Barred:
    """Edges that cost something else for some of the origins. ``own``: the edges of each origin."""

    def __init__(self, net: Network, own: list[np.ndarray]):
        edge, column = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.lexsort((column, edge))
        edge, self.column, self.many = edge[order], column[order], len(own)
        self.first = np.searchsorted(edge, np.arange(len(net.u) + 1))
        self.keys = edge * self.many + self.column

    def has(self, edge: np.ndarray, column: np.ndarray) -> np.ndarray:
        return np.isin(edge * self.many + column, self.keys)


def costs(net: Network, rows: Rows, origins: list[int], own: list | None = None, blocked: float = 0.0) -> np.ndarray:
    """What it costs from each origin (by column) to each node, infinite where none leads. ``own``: of each origin the edges that cost ``blocked``.

    Of the nodes whose row fell those with the least numbers are followed at a time, all that lie within a part of an edge's cost.
    """
    u, v, free = net.u, net.v, net.free
    cost = np.full((len(net.ids), len(origins)), math.inf)
    if not origins:
        return cost
    cost[origins, range(len(origins))] = 0.0
    barred = Barred(net, [np.asarray(x, dtype=np.int64) for x in own]) if own and any(len(x) for x in own) else None
    fallen = np.full(len(net.ids), math.inf)
    fallen[origins] = 0.0
    while (least := fallen.min()) < math.inf:
        now = np.flatnonzero(fallen <= least + rows.width)
        fallen[now] = math.inf
        edges, _ = _of(rows.first, now)
        if not len(edges):
            continue
        edges = edges[np.argsort(v[edges], kind="stable")]
        tried = cost[u[edges]]
        if barred is None:
            tried += free[edges][:, None]
        else:
            at, sizes = _of(barred.first, edges)
            line, column = np.repeat(np.arange(len(edges)), sizes), barred.column[at]
            instead = tried[line, column] + blocked
            tried += free[edges][:, None]
            tried[line, column] = instead
        heads = v[edges]
        starts = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
        ends = heads[starts]
        best, old = np.minimum.reduceat(tried, starts, axis=0), cost[ends]
        lower = best < old
        fell = np.flatnonzero(lower.any(axis=1))
        if not len(fell):
            continue
        best, old, lower, ends = best[fell], old[fell], lower[fell], ends[fell]
        cost[ends] = np.minimum(best, old)
        np.copyto(best, math.inf, where=~lower)
        fallen[ends] = np.minimum(fallen[ends], best.min(axis=1))
    return cost


def trails(net: Network, rows: Rows, cost: np.ndarray, origins: list[int], dests: list[int], own: list | None = None, blocked: float = 0.0) -> list[np.ndarray]:
    """The edges from each origin to its destination that a search in order of cost takes, none where there is no route.

    Of the edges into a node by which it costs the least that of the node settled first: by cost, then number, then the edge's place.
    """
    start, here, columns = np.array(origins, dtype=np.int64), np.array(dests, dtype=np.int64), np.arange(len(origins))
    barred = Barred(net, [np.asarray(x, dtype=np.int64) for x in own]) if own and any(len(x) for x in own) else None
    going = columns[(here >= 0) & (here != start)]
    going = going[np.isfinite(cost[here[going], going])]
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    while len(going):
        at, sizes = _of(rows.first_into, here[going])
        edge, column = rows.into[at], np.repeat(going, sizes)
        before, step = cost[net.u[edge], column], net.free[edge]
        if barred is not None:
            step = np.where(barred.has(edge, column), blocked, step)
        same = np.flatnonzero(before + step == cost[net.v[edge], column])
        edge, column, before = edge[same], column[same], before[same]
        order = np.lexsort((edge, net.u[edge], before, column))
        edge, column = edge[order], column[order]
        first = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        going, edge = column[first], edge[first]
        taken.append((going, edge))
        here[going] = net.u[edge]
        going = going[here[going] != start[going]]
    if not taken:
        return [np.zeros(0, dtype=np.int64) for _ in origins]
    # The last edges of the routes come first.
    column, edge = (np.concatenate(x[::-1]) for x in zip(*taken, strict=True))
    order = np.argsort(column, kind="stable")
    return np.split(edge[order], np.searchsorted(column[order], np.arange(1, len(origins))))


def settled(net: Network, cost: np.ndarray, dests: list[int], max_mph: float | None = None) -> np.ndarray:
    """How many nodes a search in order of cost, and of the bound by the line, settles from each origin up to its destination, -1 for one without edges."""
    dest, columns = np.array(dests), np.arange(len(dests))
    goal = np.where(dest >= 0, cost[dest, columns], math.inf)
    found = np.zeros(len(dests), dtype=np.int64)
    step = max(1, 1_000_000 // max(1, len(dests)))
    if max_mph is not None:
        lat, lon = np.radians(net.lat), np.radians(net.lon)
    for low in range(0, len(net.ids), step):
        part = cost[low : low + step]
        numbers = np.arange(low, low + len(part))[:, None]
        reached = np.isfinite(part)
        if max_mph is not None:
            line = _line(lat[low : low + step, None], lon[low : low + step, None], lat[dest], lon[dest], max_mph)
            part = part + np.where(dest >= 0, line, 0.0)
        found += (reached & ((part < goal) | ((part == goal) & (numbers <= dest)))).sum(axis=0)
        # Without a route all that is reached is settled.
    none = np.isinf(goal)
    found[none] = np.isfinite(cost[:, none]).sum(axis=0)
    return found
