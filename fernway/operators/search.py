"""Shortest paths of many queries at once.

Each query is a search in order of cost (:mod:`.ordered`) in some task: nodes are settled once, ties by the text of their ids, each edge at the
cost of the time at which it is entered. A network of few enough edges and told times (``MAX_EDGES``, ``MAX_TIMED``, counted before they are
collected) is broadcast and the queries are dealt among the tasks. Of a larger one the cells that the queries come to are brought to
them (:mod:`.cells`). The code of the searches is the same, and so are their rows.

* ``dijkstra``: up to the destination; ``astar``: by cost and lower bound to the destination;
* ``bidirectional``: from both ends with costs that do not change;
* ``guided``: by cost and a blend of the lower bound and the learned cost to go, which may miss the optimum; a guard makes that good.

A time at which an edge is entered later may be cheaper than an earlier one; no one waits for it.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernway.functions import scalar as S
from fernway.operators import cells as C
from fernway.operators import ordered as N
from fernway.operators import separators as P
from fernway.operators import together as M
from fernway.operators.rounds import cut, remove, shared_path, written, written_at

#: What is broadcast at most: edges (about 60 bytes each) and rows of a time table (32 bytes each).
MAX_EDGES, MAX_TIMED = 500_000, 4_000_000
#: Tasks for each core that queries with several rows are dealt to by their ends.
DEALT = 4
#: Queries that a task holds at most, about, with what it finds from nodes of a separator.
HELD = 500_000


@dataclass(frozen=True)
class Costs:
    """What edges cost: ``column``, or by bucket of arrival what ``told`` (edge_id, timestamp, eta_s, sigma_s) says where it says something.

    ``real`` likewise gives the true costs of the path that is found; without it they are the told ones. ``planned``: whether told
    times are planned by, or free flow alone. ``noise_seed``: of the numbers drawn for queries with noise, where they have no column of that name.
    """

    column: str = "free_flow_s"
    told: DataFrame | None = None
    real: DataFrame | None = None
    minutes: int = 5
    planned: bool = True
    noise_seed: str = ""


def static_costs(column: str = "free_flow_s") -> Costs:
    """Edge costs that do not change with time."""
    return Costs(column)


def timed_costs(predicted: DataFrame, minutes: int, realized: DataFrame | None = None) -> Costs:
    """Costs by edge and bucket of arrival, free flow where there are none; ``realized`` likewise for the true cost of the same path."""
    return Costs(told=predicted, real=realized, minutes=minutes)


def free_flow_plans(realized: DataFrame, minutes: int) -> Costs:
    """Plan by free flow, with the true cost of the same path under ``realized``."""
    return Costs(told=realized, real=realized, minutes=minutes, planned=False)


def lower_bound_s(lat: Column, lon: Column, to_lat: Column, to_lon: Column, max_mph: Column) -> Column:
    """Seconds as the crow flies at the largest speed limit."""
    return S.haversine_m(lat, lon, to_lat, to_lon) / (max_mph * F.lit(S.MPH))


# --- networks --------------------------------------------------------------------------------------------------------


class Roads:
    """A network that several searches share: what was broadcast, or dealt into cells, for one is used by the next.

    ``edges``: edge_id, u, v and costs; ``nodes``: node, lat, lon; ``since``: the time from which told times are kept, for searches that
    depart at different times; without it that of the first departure of a search. :meth:`close` gives the memory of broadcasts back once
    the rows of all searches have been read.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, since=None):
        self.edges, self.nodes, self.since = edges, nodes, since
        self._few: bool | None = None
        self._known: dict[tuple, object] = {}

    @property
    def few(self) -> bool:
        if self._few is None:
            self._few = self.edges.count() <= MAX_EDGES
        return self._few

    def once(self, key: tuple, make: Callable):
        """What ``make`` gives, for as long as this network is used."""
        if key not in self._known:
            self._known[key] = make()
        return self._known[key]

    def close(self) -> None:
        for found in self._known.values():
            if hasattr(found, "unpersist"):
                found.unpersist()
        self._known.clear()


def _roads(edges: DataFrame | Roads, nodes: DataFrame | None = None) -> Roads:
    return edges if isinstance(edges, Roads) else Roads(edges, nodes)


def first_bucket(queries: DataFrame, minutes: int):
    """The bucket of the first departure; None where there is none."""
    return queries.agg(F.min("depart_time").alias("t")).select(S.bucket_floor(F.col("t").cast("timestamp_ntz"), minutes)).first()[0]


def _times(rows: DataFrame, after) -> DataFrame:
    """edge_id, when_s, eta_s and sigma_s of the rows from a time on."""
    sigma = F.col("sigma_s").cast("double") if "sigma_s" in rows.columns else F.lit(0.0)
    wanted = rows.where(F.col("timestamp") >= F.lit(after)) if after is not None else rows.limit(0)
    return wanted.select("edge_id", _seconds(F.col("timestamp")).alias("when_s"), F.col("eta_s").cast("double").alias("eta_s"), sigma.alias("sigma_s"))


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pa.compute.fill_null(column, math.nan).to_numpy() if isinstance(column, pa.ChunkedArray) else pa.compute.fill_null(column, math.nan).to_numpy(zero_copy_only=False)


def _whole(array: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return array.to_numpy() if isinstance(array, pa.ChunkedArray) else array.to_numpy(zero_copy_only=False)


def _network(found: pa.Table) -> N.Network:
    return N.Network(_whole(found["edge_id"]), _whole(found["u"]), _whole(found["v"]), _numbers(found["free"]))


def broadcast_network(roads: Roads, column: str = "free_flow_s", with_places: bool = False):
    """The network's edges and the places of their ends, broadcast."""
    net = _network(roads.edges.select("edge_id", "u", "v", F.col(column).cast("double").alias("free")).toArrow())
    if with_places:
        # Ends of edges alone are looked up, so that there are not more places than twice the edges.
        ends = roads.edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        places = roads.nodes.join(ends, "node", "left_semi").select("node", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).toArrow()
        _place(net, _whole(places["node"]), _numbers(places["lat"]), _numbers(places["lon"]))
    return roads.edges.sparkSession.sparkContext.broadcast(net)


def _place(net: N.Network, nodes: np.ndarray, lat: np.ndarray, lon: np.ndarray, cell: np.ndarray | None = None) -> None:
    at = np.array(net.places(nodes.tolist()), dtype=np.int64)
    known = at >= 0
    net.lat, net.lon = (np.full(len(net.ids), np.nan) for _ in range(2))
    net.lat[at[known]], net.lon[at[known]] = lat[known], lon[known]
    if cell is not None:
        net.cells = np.full(len(net.ids), -1, dtype=np.int64)
        net.cells[at[known]] = cell[known]
    net._ready = None


def _broadcast_times(roads: Roads, net: N.Network, rows: DataFrame, minutes: int):
    found = rows.toArrow()
    edge = pa.compute.index_in(found["edge_id"].combine_chunks(), value_set=pa.array(net.edge_ids.tolist(), found["edge_id"].type))
    known = np.flatnonzero(edge.is_valid().to_numpy(zero_copy_only=False))
    at = edge.take(pa.array(known)).to_numpy().astype(np.int64)
    return roads.edges.sparkSession.sparkContext.broadcast(N.TimeTable.of(len(net.edge_ids), at, *(_whole(found[c])[known] for c in ("when_s", "eta_s", "sigma_s")), minutes))


# --- searches --------------------------------------------------------------------------------------------------------

#: What one search gives: its fields, and their values for a query, which has the columns of its row.
Search = tuple[list[T.StructField], Callable[[N.Network, N.Query, dict], dict]]

_CARRIED = ("weight", "modulated", "own", "share", "noise", "noise_seed")


def _epoch_s(column: pa.ChunkedArray | pa.Array) -> list[float]:
    return (_whole(column.cast(pa.timestamp("us")).cast(pa.int64())) / 1e6).tolist()


def _own(ready: N.Ready, edges: list | None) -> dict[int, tuple[float | None, float]]:
    return {at: (e["cost"], e["factor"] or 1.0) for e in edges or () if (at := ready.edge(e["edge_id"])) >= 0}


def _searched(net: N.Network, rows: pa.Table | pa.RecordBatch, search: Callable, names: list[str]) -> tuple[dict[str, list], list[list[int]]]:
    """The search's values for each row, and the cells that it misses."""
    ready, found, missing = net.ready, {n: [] for n in names}, []
    ends = [net.places(rows.column(c).to_pylist()) for c in ("origin", "dest")]
    columns = {c: rows.column(c).to_pylist() for c in rows.schema.names if c in ("origin", "dest", *_CARRIED)}
    last, shared = None, {}
    for i, (origin, dest, depart) in enumerate(zip(*ends, _epoch_s(rows.column("depart_time")), strict=True)):
        row = {c: x[i] for c, x in columns.items()}
        if last != (row["origin"], row["dest"], depart):
            last, shared = (row["origin"], row["dest"], depart), {}
        query = N.Query(origin, dest, depart, _own(ready, row.get("own")), row.get("share", 1.0), row.get("noise", 0.0), shared=shared, noise_seed=row.get("noise_seed"))
        values = search(net, query, row)
        for n in names:
            found[n].append(values[n])
        missing.append(sorted(query.missing))
    return found, missing


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def parts(batch: pa.RecordBatch, most: int | None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows; whole without a number."""
    most = most or max(1, batch.num_rows)
    for low in range(0, batch.num_rows, most):
        yield batch.slice(low, most)


def _run(roads: Roads, queries: DataFrame, costs: Costs, search: Search, keys: tuple[str, ...] = (), *, places: bool = False, at_a_time: int | None = None) -> DataFrame:
    """The queries' query_id, origin, dest, depart_time and ``keys`` with the fields of the search.

    ``at_a_time``: of how many queries a task of a broadcast network holds what was found, where that is much.
    """
    spark, (fields, one) = queries.sparkSession, search
    plain = ["query_id", "origin", "dest", "depart_time", *keys]
    carried = [c for c in _CARRIED if c in queries.columns and c not in keys]
    rows = queries.select("query_id", "origin", "dest", F.col("depart_time").cast("timestamp_ntz").alias("depart_time"), *keys, *carried)
    timed = {name: t for name, t in (("told", costs.told), ("real", costs.real)) if t is not None}
    after = None if not timed else roads.since if roads.since is not None else first_bucket(queries, costs.minutes)
    tables = {name: roads.once((id(t), after, "rows"), lambda t=t: (_times(t, after), t)) for name, t in timed.items()}
    names, types, seed = [f.name for f in fields], _arrow(T.StructType(fields)), costs.noise_seed

    def columns(net: N.Network, batch) -> tuple[list[pa.Array], list[list[int]]]:
        net.noise_seed = seed
        found, missing = _searched(net, batch, one, names)
        return [pa.array(found[n], types.field(n).type) for n in names], missing

    few = roads.few and all(roads.once((id(t), after, "few"), lambda name=name: tables[name][0].count() <= MAX_TIMED) for name, t in timed.items())
    if few:
        shared = roads.once((costs.column, places, "net"), lambda: broadcast_network(roads, costs.column, places))
        times = {name: roads.once((id(t), after, costs.column, "times"), lambda name=name: _broadcast_times(roads, shared.value, tables[name][0], costs.minutes)) for name, t in timed.items()}
        schema = T.StructType([*rows.select(*plain).schema.fields, *fields])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = shared.value
            net.told, net.real = (times[n].value if n in times else None for n in ("told", "real"))
            for batch in (p for b in batches for p in parts(b, at_a_time)):
                found, _ = columns(net, batch)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], *found], names=schema.names)

        dealt = rows.repartition(spark.sparkContext.defaultParallelism)
        if told_apart := [c for c in ("noise_seed", "noise", "share", "weight") if c in rows.columns]:
            # Queries that differ in what they are told lie one after another, and share what they find alike.
            same = ["origin", "dest", "depart_time"]
            dealt = rows.repartition(DEALT * spark.sparkContext.defaultParallelism, *same).sortWithinPartitions(*same, *told_apart)
        return dealt.mapInArrow(task, schema)

    # Each cell has about as many edges, whatever their number.
    of = roads.once((places, "cells"), lambda: C.node_cells(roads.edges, roads.nodes if places else None, max(1, -(-roads.edges.count() // C.CELL_EDGES))))
    key = (costs.column, places, after, *[id(t) for t in timed.values()], "pages")
    plain_edges = roads.edges.select("edge_id", "u", "v", F.col(costs.column).cast("double").alias("free"))
    page = roads.once(key, lambda: C.pages(plain_edges, of, *(tables[n][0] if n in tables else None for n in ("told", "real"))))
    minutes, told = costs.minutes, frozenset(timed)

    def work(batch: pa.Table, edges: pa.Table, held: frozenset[int]) -> pa.Table:
        found, missing = columns(_held_network(edges, held, minutes, told), batch)
        return pa.table([*found, pa.array(missing, pa.list_(pa.int32()))], names=[*names, "missing"])

    return C.in_rounds(rows, of, page, work, fields).select(*plain, *names)


def _held_network(edges: pa.Table, held: frozenset[int], minutes: int, timed: frozenset[str]) -> N.Network:
    """The network of the cells' edges, each once."""
    key = list(zip(*(edges.column(c).to_pylist() for c in ("edge_id", "u", "v")), strict=True))
    once = pa.array(sorted({k: i for i, k in enumerate(key)}.values()), pa.int64())
    edges = edges.take(once).combine_chunks()
    net = _network(edges)
    both = {c: np.concatenate([_numbers(edges.column(f"{end}_{c}")) if c != "cell" else _whole(edges.column(f"{end}_{c}")) for end in "uv"]) for c in ("lat", "lon", "cell")}
    nodes = np.concatenate([_whole(edges.column(end)) for end in "uv"]) if edges.num_rows else np.zeros(0, dtype=np.int64)
    _place(net, nodes, both["lat"], both["lon"], both["cell"])
    net.held = held
    place = np.empty(edges.num_rows, dtype=np.int64)
    place[net.order] = np.arange(edges.num_rows)
    for name in timed:
        lists = edges.column(name)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        setattr(net, name, N.TimeTable.of(edges.num_rows, np.repeat(place, sizes), *(flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("when_s", "eta_s", "sigma_s")), minutes))
    net._ready = None
    return net


def _path(net: N.Network, origin, trail: list[int] | None) -> list | None:
    if trail is None:
        return None
    ids, head = net.ids, net.ready.head
    return [origin, *[x.item() if hasattr(x, "item") else x for x in (ids[head[e]] for e in trail)]]


def _route_fields(queries: DataFrame) -> list[T.StructField]:
    node = queries.schema["origin"].dataType
    return [T.StructField("cost", T.DoubleType()), T.StructField("true_cost", T.DoubleType()), T.StructField("path", T.ArrayType(node)), T.StructField("work", T.LongType()), T.StructField("latency_ms", T.DoubleType())]


def _found(ready: N.Ready, query: N.Query, row: dict, step: N.Step | None, bound=None) -> tuple[list[int] | None, float | None, int]:
    """Edges, cost and nodes settled of a route in order of cost and bound; None without one."""
    if row["origin"] == row["dest"]:
        return [], 0.0, 1
    if query.origin < 0:
        return None, None, 1
    found = N.settle(ready, query, query.origin, query.dest, step, bound)
    if query.dest not in found.cost:
        return None, None, found.work
    return found.trail(ready, query.dest), found.cost[query.dest], found.work


def _route_search(queries: DataFrame, costs: Costs, *, both_ends: bool = False, max_mph: float | None = None) -> Search:
    planned = costs.planned

    def one(net: N.Network, query: N.Query, row: dict) -> dict:
        began, ready = time.perf_counter(), net.ready
        step = N.steps(ready, query, net.told if planned else None, frozen=both_ends)
        if both_ends and row["origin"] != row["dest"] and min(query.origin, query.dest) >= 0:
            cost, trail, work = N.meet(ready, query, step)
        else:
            trail, cost, work = _found(ready, query, row, step, query.once(("line",), lambda: N.line_bound(ready, query.dest, max_mph)) if max_mph else None)
        cost = None if trail is None else cost
        true = cost if trail is None or net.real is None else N.along(ready, trail, N.steps(ready, query, net.real, bent=False))
        return {"cost": cost, "true_cost": true, "path": _path(net, row["origin"], trail), "work": work, "latency_ms": 1000 * (time.perf_counter() - began)}

    return _route_fields(queries), one


def _with_hops(found: DataFrame) -> DataFrame:
    return found.withColumn("hops", F.when(F.col("path").isNotNull(), (F.size("path") - 1).cast("long")))


def distances(queries: DataFrame, edges: DataFrame | Roads, costs: Costs | None = None) -> DataFrame:
    """query_id, node, cost of every node that each query's origin reaches."""
    roads, costs = _roads(edges), costs or static_costs()
    if costs.told is None:
        if not roads.few:
            return reached_by_joins(queries, roads.edges, costs.column)
        told_apart = any(c in queries.columns for c in _CARRIED)
        if not told_apart and (shared := _shared_network(roads, costs.column)) is not None:
            return _reached_together(queries, shared)
    planned = costs.planned
    fields = [T.StructField("reached", T.ArrayType(T.StructType([T.StructField("node", queries.schema["origin"].dataType), T.StructField("cost", T.DoubleType())])))]

    def one(net: N.Network, query: N.Query, row: dict) -> dict:
        if query.origin < 0:
            return {"reached": [(row["origin"], 0.0)]}
        found = N.settle(net.ready, query, query.origin, step=N.steps(net.ready, query, net.told if planned else None))
        ids = net.ids.tolist()
        return {"reached": [(ids[i], c) for i, c in found.cost.items()]}

    # One query's nodes at a time, as all those of a batch of queries are as many as both together.
    return _run(roads, queries, costs, (fields, one), at_a_time=1).select("query_id", F.explode("reached").alias("r")).select("query_id", "r.node", "r.cost")


def _reached_together(queries: DataFrame, shared) -> DataFrame:
    names, schema = ["query_id", "origin"], T.StructType([queries.schema["query_id"], T.StructField("node", queries.schema["origin"].dataType), T.StructField("cost", T.DoubleType())])
    dealt, most = _near_one_another(queries, shared, names)
    types = _arrow(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, rows = shared.value, None
        for batch in (p for b in batches for p in parts(b, most)):
            rows = rows or M.Rows(net)
            ids, origins = batch.column("query_id"), batch.column("origin")
            o = net.places(origins.to_pylist())
            known = [i for i, x in enumerate(o) if x >= 0]
            cost = np.ascontiguousarray(M.costs(net, rows, [o[i] for i in known]).T)
            line = {i: k for k, i in enumerate(known)}
            for i in range(len(o)):
                # A query whose origin has no edge reaches its origin alone.
                at = np.flatnonzero(np.isfinite(cost[line[i]])) if i in line else None
                node, found = (origins.slice(i, 1), [0.0]) if at is None else (pa.array(net.ids[at]).cast(types.field("node").type), cost[line[i], at])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(found), i))), node, pa.array(found, pa.float64())], schema=types)

    return dealt.mapInArrow(task, schema)


def reached_by_joins(queries: DataFrame, edges: DataFrame, column: str, most_rounds: int = 100_000) -> DataFrame:
    """query_id, node, cost of every node that each query's origin reaches, by rounds of joins, for networks larger than a task.

    A round joins the labels that improved in the last with the edges, which are written once, and their heads' labels with the settled table;
    what improved replaces the older labels there.
    """
    spark, key = queries.sparkSession, ["query_id", "node"]
    hops = written(edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.col(column).cast("double").alias("step")).groupBy("node", "to").agg(F.min("step").alias("step")), "hops")
    labels = written(queries.select("query_id", F.col("origin").alias("node"), F.lit(0.0).alias("cost")).distinct(), "labels")
    frontier, old = labels, None
    for _ in range(most_rounds):
        tried = frontier.join(hops, "node").groupBy("query_id", F.col("to").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("cost"))
        better = tried.join(labels.withColumnRenamed("cost", "_known"), key, "left").where(F.col("_known").isNull() | (F.col("cost") < F.col("_known"))).select(*key, "cost")
        frontier = written(better, "frontier")
        if frontier.isEmpty():
            return labels
        path = shared_path(spark, "labels")
        labels = written_at(labels.join(frontier, key, "left_anti").unionByName(frontier), path)
        if old:
            remove(spark, old)
        old = path
    raise RuntimeError(f"labels still improve after {most_rounds} rounds")


def dijkstra(queries: DataFrame, edges: DataFrame | Roads, costs: Costs | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Routes without a bound: query_id, origin, dest, depart_time, cost, true_cost, path, hops and work; null without a route.

    ``work`` is how many nodes were settled, the destination included; ``latency_ms`` what the search took in its task. Columns of the queries
    named by ``keys`` go along, and edges, shares and noise of the queries' own count.
    """
    costs = costs or static_costs()
    return _with_hops(_run(_roads(edges), queries, costs, _route_search(queries, costs), keys))


def astar(queries: DataFrame, edges: DataFrame | Roads, nodes: DataFrame | None, max_mph: float, costs: Costs | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`dijkstra`, with the lower bound to the destination."""
    costs = costs or static_costs()
    return _with_hops(_run(_roads(edges, nodes), queries, costs, _route_search(queries, costs, max_mph=max_mph), keys, places=True))


def bidirectional(queries: DataFrame, edges: DataFrame | Roads, costs: Costs | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`dijkstra`, from both ends by free flow."""
    costs = costs or static_costs()
    if costs.planned and costs.told is not None:
        raise ValueError("a search from both ends plans by costs that do not change with time")
    return _with_hops(_run(_roads(edges), queries, costs, _route_search(queries, costs, both_ends=True), keys))


def guided(queries: DataFrame, edges: DataFrame | Roads, nodes: DataFrame | None, max_mph: float, costs: Costs, keys: tuple[str, ...] = ()) -> DataFrame:
    """query_id, classical_cost, classical_path, candidate_cost, candidate_path, weight_used and work of every query, and ``keys``.

    ``queries`` have a ``weight`` from 0 to 1 and perhaps ``modulated``: whether the weight is divided by one and the mean doubt on the classical
    route. The classical route is planned by free flow with the lower bound, the candidate by the told times with the blended bound; both
    cost what they do under the real times. ``latency_ms`` has what a search takes alone, what was found by another for both included.
    """
    path, planned = T.ArrayType(queries.schema["origin"].dataType), costs.planned
    fields = [T.StructField(x, T.DoubleType()) for x in ("classical_cost", "candidate_cost", "weight_used")]
    fields += [T.StructField("classical_path", path), T.StructField("candidate_path", path), T.StructField("work", T.LongType()), T.StructField("latency_ms", T.DoubleType())]

    def one(net: N.Network, query: N.Query, row: dict) -> dict:
        began, ready = time.perf_counter(), net.ready
        told = net.told if planned else None
        real = N.steps(ready, query, net.real, bent=False) if net.real is not None else N.steps(ready, query, told)
        # Planned by free flow, both are the same whatever the query is told.
        line = query.once(("line",), lambda: N.line_bound(ready, query.dest, max_mph))
        classical, _, _ = query.once(("classical",), lambda: _found(ready, query, row, None, line))
        weight = row["weight"]
        if not 0 <= weight <= 1:
            raise ValueError("the weight is from 0 to 1")
        if row.get("modulated"):
            weight /= 1 + N.mean_doubt(ready, query, classical or [], net.told)
        bound = N.blended_bound(ready, query, line, told, weight) if min(query.origin, query.dest) >= 0 else line
        candidate, _, work = _found(ready, query, row, N.steps(ready, query, told), bound)
        costs_of = [None if t is None else N.along(ready, t, real) for t in (classical, candidate)]
        return {
            "classical_cost": costs_of[0],
            "candidate_cost": costs_of[1],
            "weight_used": weight,
            "classical_path": _path(net, row["origin"], classical),
            "candidate_path": _path(net, row["origin"], candidate),
            "work": work,
            "latency_ms": 1000 * (time.perf_counter() - began + query.spared_s),
        }

    return _run(_roads(edges, nodes), queries, costs, (fields, one), keys, places=True).drop("origin", "dest", "depart_time")


def route_costs(queries: DataFrame, edges: DataFrame | Roads, nodes: DataFrame | None = None, max_mph: float | None = None, *, both_ends: bool = False) -> DataFrame:
    """query_id, origin, dest and cost by free flow of many queries' routes: as :func:`dijkstra`, with ``max_mph`` :func:`astar`, or :func:`bidirectional`.

    Where separators (:mod:`.separators`) part the ends of more queries than they have nodes, costs are searched from each of their nodes, to and fro and
    within the part, and a query costs the least over the nodes of its ends' separators. Queries whose ends no separator parts are searched one by one.
    """
    roads, costs, spark = _roads(edges, nodes), static_costs(), queries.sparkSession
    plain = ["query_id", "origin", "dest"]

    def one_by_one(some: DataFrame) -> DataFrame:
        return _run(roads, some, costs, _route_search(queries, costs, both_ends=both_ends, max_mph=max_mph), places=max_mph is not None).select(*plain, "cost")

    if not roads.few:
        return one_by_one(queries)
    shared = roads.once((costs.column, max_mph is not None, "net"), lambda: broadcast_network(roads, costs.column, max_mph is not None))
    n_queries = queries.count()
    made = P.parts(shared.value, n_queries)
    if all(x is None for x in made.between):
        return one_by_one(queries)
    divided, tasks = spark.sparkContext.broadcast(made), DEALT * spark.sparkContext.defaultParallelism
    slices = -(-n_queries // HELD)
    asked = T.StructType([queries.schema[c] for c in plain])
    dealt = T.StructType([*asked.fields, *[T.StructField(c, T.IntegerType()) for c in ("_o", "_d", "_part", "_share")]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query for every share of the separators of its ends' common parts; part -1 where the smallest is not divided."""
        net, found = shared.value, divided.value
        for batch in batches:
            o, d = (np.array(net.places(batch.column(c).to_pylist()), dtype=np.int64) for c in ("origin", "dest"))
            rows, last = [], np.full(len(o), -1)
            for of in found.of:
                both = np.flatnonzero((o >= 0) & (d >= 0) & (of[o] == of[d]) & (of[o] >= 0) & (o != d))
                last[both] = of[o[both]]
            whole = np.array([x is None for x in found.between])
            alone = (last >= 0) & whole[last]
            rows.append((np.flatnonzero(alone), np.full(alone.sum(), -1), np.zeros(alone.sum(), dtype=np.int64)))
            for level, of in enumerate(found.of):
                both = np.flatnonzero((last >= 0) & ~alone & (of[o] == of[d]) & (of[o] >= 0))
                for share in range(max(1, tasks >> level)):
                    rows.append((both, of[o[both]], np.full(len(both), share)))
            at, part, share = (np.concatenate(x) for x in zip(*rows, strict=True))
            told = batch.select(plain).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*told.columns, *[pa.array(x.astype(np.int32)) for x in (o[at], d[at], part, share)]], names=dealt.names)

    def task(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found, ready = divided.value, shared.value.ready
        part, share = key[0].as_py(), key[1].as_py()
        inside = bytearray(len(ready.ahead))
        for node in found.nodes[part].tolist():
            inside[node] = 1
        o, d = (_whole(group.column(c)) for c in ("_o", "_d"))
        best = np.full(len(o), math.inf)
        for node in found.between[part][share :: max(1, tasks >> found.level[part])].tolist():
            best = np.minimum(best, P.reached(ready.behind, node, inside)[o] + P.reached(ready.ahead, node, inside)[d])
        return pa.table([*[group.column(c) for c in plain], pa.array(best)], names=[*plain, "cost"])

    rows = cut(queries.select(*plain).repartition(spark.sparkContext.defaultParallelism).mapInArrow(deal, dealt))
    through = rows.where("_part >= 0").withColumn("_slice", F.pmod(F.xxhash64(*plain), F.lit(slices)))
    schema = T.StructType([*asked.fields, T.StructField("cost", T.DoubleType())])
    between = through.repartition(4 * tasks, "_part", "_share", "_slice").groupBy("_part", "_share", "_slice").applyInArrow(task, schema)
    near = queries.join(rows.where("_part < 0").select(*plain).distinct(), plain, "left_semi")
    least = between.unionByName(one_by_one(near)).groupBy(*plain).agg(F.min("cost").alias("_cost"))
    cost = F.when(F.col("origin") == F.col("dest"), F.lit(0.0)).when(F.col("_cost") < float("inf"), F.col("_cost"))
    return queries.join(least, plain, "left").select(*plain, cost.alias("cost"))


def path_edges(paths: DataFrame, edges: DataFrame, column: str = "free_flow_s") -> DataFrame:
    """query_id, pos, u, v, edge_id and cost of each step of the paths; of parallel edges the cheapest, ties by name."""
    hops = F.expr("transform(slice(path, 1, greatest(size(path) - 1, 0)), (x, i) -> struct(x AS u, get(path, i + 1) AS v))")
    steps = paths.select("query_id", F.posexplode(hops).alias("pos", "s")).select("query_id", "pos", F.col("s.u").alias("u"), F.col("s.v").alias("v"))
    cheapest = edges.groupBy("u", "v").agg(F.min(F.struct(F.col(column).alias("cost"), "edge_id")).alias("e"))
    return steps.join(cheapest, ["u", "v"], "left").select("query_id", "pos", "u", "v", F.col("e.edge_id").alias("edge_id"), F.col("e.cost").alias("cost"))


def path_edges_at_departure(paths: DataFrame, edges: DataFrame, told: DataFrame, minutes: int) -> DataFrame:
    """As :func:`path_edges`, for paths with a ``depart_time``: of parallel edges the one told to be cheapest in its bucket."""
    hops = F.expr("transform(slice(path, 1, greatest(size(path) - 1, 0)), (x, i) -> struct(x AS u, get(path, i + 1) AS v))")
    steps = paths.select("query_id", S.bucket_floor(F.col("depart_time"), minutes).alias("timestamp"), F.posexplode(hops).alias("pos", "s")).select("query_id", "timestamp", "pos", F.col("s.u").alias("u"), F.col("s.v").alias("v"))
    timed = steps.join(edges.select("u", "v", "edge_id", "free_flow_s"), ["u", "v"], "left").join(told.select("edge_id", "timestamp", "eta_s"), ["edge_id", "timestamp"], "left")
    best = timed.groupBy("query_id", "pos", "u", "v").agg(F.min(F.struct(F.coalesce("eta_s", "free_flow_s").alias("cost"), "edge_id")).alias("e"))
    return best.select("query_id", "pos", "u", "v", F.col("e.edge_id").alias("edge_id"), F.when(F.col("e.edge_id").isNotNull(), F.col("e.cost")).alias("cost"))


def realized_static(paths: DataFrame, edges: DataFrame, column: str = "free_flow_s") -> DataFrame:
    """query_id, realized: the summed cost of each path; infinite for no path or a missing edge, 0 for one node."""
    summed = path_edges(paths, edges, column).groupBy("query_id").agg(F.sum("cost").alias("s"), F.count_if(F.col("cost").isNull()).alias("gaps"))
    none = F.lit(float("inf"))
    cost = F.when(F.col("path").isNull() | (F.coalesce("gaps", F.lit(0)) > 0), none).when(F.size("path") <= 1, F.lit(0.0)).otherwise(F.col("s"))
    return paths.join(summed, "query_id", "left").select("query_id", cost.alias("realized"))


def realized(paths: DataFrame, edges: DataFrame, real: DataFrame, minutes: int) -> DataFrame:
    """query_id, realized, of paths (query_id, path, depart_time): each edge costs what it does in the bucket in which it is entered.

    Of parallel edges the cheapest then. Infinite for no path or a missing edge, 0 for one node. Each step of a path gets the times of its
    edges from the departure on, by bucket, and one fold over the steps adds up what they cost, so that there is one join and one grouping,
    whatever the length of the paths.
    """
    return folded(paths, edges, real, minutes).select("query_id", F.col("fold.spent").alias("realized"))


def _bucket_number(when_s: Column, minutes: int) -> Column:
    """The number of a time's bucket; buckets count from midnight, those of a day after those of the day before."""
    day = F.floor(when_s / 86400)
    return day * -(-1440 // minutes) + F.floor((when_s - day * 86400) / (60 * minutes))


def _seconds(column: Column) -> Column:
    """Seconds since 1970 of a time without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz")) / 1e6


def folded(paths: DataFrame, edges: DataFrame, told: DataFrame, minutes: int, sigma: bool = False) -> DataFrame:
    """The paths with ``fold``: spent (seconds; infinite for no path or a missing edge), doubt (summed relative doubt) and known (steps told of).

    ``sigma``: of parallel edges the first by name counts, as doubt is asked of it; else the cheapest.
    """
    steps = F.expr("transform(sequence(1, size(path) - 1), i -> struct(i AS pos, path[i - 1] AS u, path[i] AS v))")
    long = paths.where(F.size("path") > 1)
    asked = long.select("query_id", F.col("depart_time").cast("timestamp_ntz").alias("depart_time"), F.explode(steps).alias("s")).select("query_id", "depart_time", "s.*")
    doubt = F.col("sigma_s").cast("double") if "sigma_s" in told.columns else F.lit(0.0)
    entry = F.struct(_bucket_number(_seconds(F.col("timestamp")), minutes).alias("bucket"), F.struct(F.col("eta_s").cast("double").alias("eta"), doubt.alias("sigma")).alias("said"))
    profiles = told.groupBy("edge_id").agg(F.map_from_entries(F.collect_list(entry)).alias("told"))
    # Maps are larger than their estimates, so that none of these tables may be broadcast.
    known = edges.select("u", "v", "edge_id", F.col("free_flow_s").cast("double").alias("free")).join(profiles.hint("merge"), "edge_id", "left")
    between = known.groupBy("u", "v").agg(F.collect_list(F.struct("edge_id", "free", "told")).alias("edges"))
    taken = asked.join(between.hint("merge"), ["u", "v"], "left").groupBy("query_id").agg(F.first("depart_time").alias("_depart"), F.collect_list(F.struct("pos", "edges")).alias("_steps"))
    rows = paths.join(taken.hint("merge"), "query_id", "left")
    ordered = F.array_sort("_steps", lambda a, b: a["pos"] - b["pos"])

    def cost(edge: Column, bucket: Column) -> Column:
        return F.coalesce(F.try_element_at(edge["told"], bucket)["eta"], edge["free"])

    def add(state: Column, step: Column) -> Column:
        bucket = _bucket_number(_seconds(F.col("_depart")) + F.least(state["spent"], F.lit(1e8)), minutes)
        if sigma:
            edge = F.array_min(F.transform(step["edges"], lambda e: e["edge_id"]))
            first = F.get(F.filter(step["edges"], lambda e: e["edge_id"] == edge), F.lit(0))
            said = F.try_element_at(first["told"], bucket)
            doubt = F.coalesce(said["sigma"] / F.greatest(said["eta"], F.lit(1e-6)), F.lit(0.0))
            return F.struct((state["spent"] + F.coalesce(cost(first, bucket), F.lit(0.0))).alias("spent"), (state["doubt"] + doubt).alias("doubt"), (state["known"] + said.isNotNull().cast("int")).alias("known"))
        least = F.array_min(F.transform(step["edges"], lambda e: cost(e, bucket)))
        return F.struct((state["spent"] + F.coalesce(least, F.lit(float("inf")))).alias("spent"), state["doubt"].alias("doubt"), state["known"].alias("known"))

    start = F.struct(F.when(F.col("path").isNull(), F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("spent"), F.lit(0.0).alias("doubt"), F.lit(0).alias("known"))
    fold = F.when(F.col("_steps").isNull(), start).otherwise(F.aggregate(ordered, start, add))
    return rows.withColumn("fold", fold).drop("_depart", "_steps")


def _near_one_another(queries: DataFrame, shared, names: list[str]) -> tuple[DataFrame, int]:
    """The columns ``names`` of the queries, dealt in the order of what it costs to their origins from a node at the rim, and how many are a batch."""
    spark, n_queries = queries.sparkSession, queries.count()
    cores = spark.sparkContext.defaultParallelism
    most = M.origins_at_a_time(shared.value, n_queries, cores)
    near = spark.sparkContext.broadcast(np.array(M.rank(shared.value.ready, P.rim(shared.value)) if len(shared.value.ids) else [], dtype=np.int64))
    plain = queries.select(*names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            at = np.array(net.places(batch.column("origin").to_pylist()), dtype=np.int64)
            of = np.where(at >= 0, near.value[at], -1) if len(net.ids) else at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of)], names=[*names, "_near"])

    placed = cut(plain.repartition(cores).mapInArrow(place, T.StructType([*plain.schema.fields, T.StructField("_near", T.LongType())])))
    dealt = placed.repartitionByRange(max(1, min(DEALT * cores, -(-n_queries // most))), "_near", "origin", *names).sortWithinPartitions("_near", "origin")
    return dealt, most


#: Of a batch of queries near one another (their rows, origins and destinations) the values of each field.
Batch = Callable[[N.Network, M.Rows, pa.RecordBatch, list[int], list[int]], list[list]]


def _together(queries: DataFrame, shared, names: list[str], fields: list[T.StructField], work: Batch, times=None) -> DataFrame:
    """The columns ``names`` of the queries with the fields that ``work`` gives for a batch of queries near one another.

    ``times``: told times, broadcast. Queries whose origin has no edge get None.
    """
    types = _arrow(T.StructType(fields))
    schema = T.StructType([*queries.select(*names).schema.fields, *fields])
    dealt, most = _near_one_another(queries, shared, names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, rows = shared.value, None
        net.told = times.value if times is not None else None
        for batch in (p for b in batches for p in parts(b, most)):
            rows = rows or M.Rows(net)
            o, d = (net.places(batch.column(c).to_pylist()) for c in ("origin", "dest"))
            known = [i for i, x in enumerate(o) if x >= 0]
            found = [[None] * len(o) for _ in fields]
            for column, values in zip(found, work(net, rows, batch.take(pa.array(known, pa.int64())), [o[i] for i in known], [d[i] for i in known]), strict=True):
                for i, value in zip(known, values, strict=True):
                    column[i] = value
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(x, t.type) for x, t in zip(found, types, strict=True)]], names=schema.names)

    return dealt.mapInArrow(task, schema)


def _shared_network(roads: Roads, column: str = "free_flow_s", blocked: float = 0.0):
    """The network, broadcast, if it is one in which the costs of many queries can be found at once (:mod:`.together`)."""
    if not roads.few:
        return None
    shared = roads.once((column, False, "net"), lambda: broadcast_network(roads, column))
    return shared if M.rises(shared.value, blocked) else None


def mean_doubts(queries: DataFrame, edges: DataFrame | Roads, told: DataFrame, minutes: int) -> DataFrame | None:
    """query_id, doubt: the mean relative doubt on the edges of each query's route by free flow, each at the time at which it is entered by what is told.

    Edges of which nothing is told are left out; with none at all there is no doubt. None where routes are not found for many queries at once.
    """
    roads = _roads(edges)
    after = roads.since if roads.since is not None else first_bucket(queries, minutes)
    shared, rows = _shared_network(roads), _times(told, after)
    if shared is None or rows.count() > MAX_TIMED:
        return None
    times = _broadcast_times(roads, shared.value, rows, minutes)

    def work(net: N.Network, rows: M.Rows, batch: pa.RecordBatch, origins: list[int], dests: list[int]) -> list[list]:
        found = M.trails(net, rows, M.costs(net, rows, origins), origins, dests)
        departs = _epoch_s(batch.column("depart_time"))
        return [[N.mean_doubt(net.ready, N.Query(o, d, at), t.tolist(), net.told) for o, d, at, t in zip(origins, dests, departs, found, strict=True)]]

    asked = queries.withColumn("depart_time", F.col("depart_time").cast("timestamp_ntz"))
    found = _together(asked, shared, ["query_id", "origin", "dest", "depart_time"], [T.StructField("doubt", T.DoubleType())], work, times)
    return found.select("query_id", F.coalesce("doubt", F.lit(0.0)).alias("doubt"))


def efforts(queries: DataFrame, edges: DataFrame | Roads, nodes: DataFrame, max_mph: float) -> DataFrame:
    """query_id, dijkstra_work and astar_work: how many nodes :func:`dijkstra` and :func:`astar` settle by free flow.

    Where the bound never settles a node by a dear way, both follow from the costs of all nodes, which are found for many queries at once
    (:mod:`.together`); else, and on a network that is not broadcast, each query is searched twice.
    """
    roads = _roads(edges, nodes)
    shared = roads.once(("free_flow_s", True, "net"), lambda: broadcast_network(roads, "free_flow_s", True)) if roads.few else None
    if shared is None or not (M.rises(shared.value) and M.bound_holds(shared.value, max_mph)):
        plain = dijkstra(queries, roads).select("query_id", F.col("work").alias("dijkstra_work"))
        return plain.join(astar(queries, roads, None, max_mph).select("query_id", F.col("work").alias("astar_work")), "query_id")

    def work(net: N.Network, rows: M.Rows, _: pa.RecordBatch, origins: list[int], dests: list[int]) -> list[list]:
        cost = M.costs(net, rows, origins)
        return [M.settled(net, cost, dests).tolist(), M.settled(net, cost, dests, max_mph).tolist()]

    found = _together(queries, shared, ["query_id", "origin", "dest"], [T.StructField(c, T.LongType()) for c in ("dijkstra_work", "astar_work")], work)
    # A search from a node without edges settles that node.
    return found.select("query_id", *[F.coalesce(c, F.lit(1).cast("long")).alias(c) for c in ("dijkstra_work", "astar_work")])


def corridor_and_trap(queries: DataFrame, edges: DataFrame | Roads, costs: Costs | None = None, blocked: float = 1e7, keys: tuple[str, ...] = ()) -> DataFrame:
    """query_id, ``keys``, corridor and trap as arrays of edge_id: the best route's edges, and those of the best route that avoids them.

    Corridor edges cost ``blocked`` in the second search, so that a route through them remains where there is no other. Of parallel
    edges the cheapest at departure counts.
    """
    roads, costs, none, key = _roads(edges), costs or static_costs(), F.array().cast("array<string>"), ["query_id", *keys]
    if costs.told is None and not any(c in queries.columns for c in _CARRIED) and (shared := _shared_network(roads, costs.column, blocked)) is not None:
        return _corridor_and_trap_together(queries, shared, blocked, key)

    def edges_of(routes: DataFrame, name: str) -> DataFrame:
        whole = routes.withColumn("_key", F.struct(*key)).select(F.col("_key").alias("query_id"), "path", "depart_time")
        steps = path_edges(whole, roads.edges, costs.column) if costs.told is None else path_edges_at_departure(whole, roads.edges, costs.told, costs.minutes)
        return steps.groupBy("query_id").agg(F.array_sort(F.collect_set("edge_id")).alias(name)).select("query_id.*", name)

    corridor = cut(queries.join(edges_of(dijkstra(queries, roads, costs, keys), "corridor"), key, "left").withColumn("corridor", F.coalesce("corridor", none)))
    own = F.transform("corridor", lambda e: F.struct(e.alias("edge_id"), F.lit(float(blocked)).alias("cost"), F.lit(None).cast("double").alias("factor")))
    second = edges_of(dijkstra(corridor.withColumn("own", own), roads, costs, keys), "trap")
    return corridor.join(second, key, "left").select(*key, "corridor", F.coalesce("trap", none).alias("trap"))


def _corridor_and_trap_together(queries: DataFrame, shared, blocked: float, key: list[str]) -> DataFrame:
    names = list(dict.fromkeys([*key, "origin", "dest"]))

    def work(net: N.Network, rows: M.Rows, _: pa.RecordBatch, origins: list[int], dests: list[int]) -> list[list]:
        # Of parallel edges the cheapest counts, ties by name, which is their order.
        pair = net.u * len(net.ids) + net.v
        order = np.lexsort((np.arange(len(pair)), net.free, pair))
        cheapest = np.empty(len(pair), dtype=np.int64)
        cheapest[order] = order[np.searchsorted(pair[order], pair[order])]
        first = [cheapest[t] for t in M.trails(net, rows, M.costs(net, rows, origins), origins, dests)]
        second = M.trails(net, rows, M.costs(net, rows, origins, first, blocked), origins, dests, first, blocked)
        return [[net.edge_ids[np.unique(t)].tolist() for t in found] for found in (first, [cheapest[t] for t in second])]

    found = _together(queries, shared, names, [T.StructField(c, T.ArrayType(T.StringType())) for c in ("corridor", "trap")], work)
    return found.select(*key, *[F.array_sort(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in ("corridor", "trap")])


def lured(corridor: Column, trap: Column, budget: Column) -> Column:
    """Edges of a query's own, as an adversary tells them: the trap's look fast and the corridor's slow; an edge in both is of the trap."""

    def edge(factor: Column) -> Callable[[Column], Column]:
        return lambda e: F.struct(e.alias("edge_id"), F.lit(None).cast("double").alias("cost"), factor.alias("factor"))

    return F.concat(F.transform(trap, edge(1 / (1 + budget))), F.transform(F.array_except(corridor, trap), edge(1 + budget)))


__all__ = ["Costs", "Roads", "astar", "bidirectional", "corridor_and_trap", "dijkstra", "distances", "efforts", "first_bucket", "folded", "free_flow_plans", "guided", "lured", "mean_doubts", "path_edges", "realized", "realized_static", "route_costs", "static_costs", "timed_costs"]
