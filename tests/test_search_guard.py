"""Routes on hand-built graphs, the guard's decisions and the adversaries."""

import heapq
import math
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernway.operators import ordered as N
from fernway.operators import guard, predictors, roads, search
from fernway.plans import service

DEPART = datetime(2012, 6, 4, 8)
# Two graphs in one: a diamond A B C D = 1 2 3 4, and 5 -> 6 with 7 apart.
EDGES = [("AB", 1, 2, 10.0), ("AC", 1, 3, 5.0), ("CB", 3, 2, 3.0), ("BD", 2, 4, 2.0), ("CD", 3, 4, 20.0), ("EF", 5, 6, 5.0), ("EF2", 5, 6, 7.0)]
QUERIES = [(0, 1, 4), (1, 1, 2), (2, 1, 1), (3, 5, 7), (4, 5, 6), (5, 4, 1)]
COSTS = {0: 10.0, 1: 8.0, 2: 0.0, 3: None, 4: 5.0, 5: None}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "edge_id string, u long, v long, free_flow_s double")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, 0.0, 0.0) for i in range(1, 8)], "node long, lat double, lon double")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(*q, DEPART) for q in QUERIES], "query_id long, origin long, dest long, depart_time timestamp_ntz")


def test_all_methods_agree(queries, edges, nodes):
    plain = {r.query_id: r for r in search.dijkstra(queries, edges).collect()}
    assert {k: r.cost for k, r in plain.items()} == COSTS
    assert plain[0].path == [1, 3, 2, 4] and plain[2].path == [1] and plain[3].path is None
    assert {r.query_id: r.cost for r in search.astar(queries, edges, nodes, 65.0).collect()} == COSTS
    both = {r.query_id: r for r in search.bidirectional(queries, edges).collect()}
    assert {k: r.cost for k, r in both.items()} == COSTS
    assert both[0].path == [1, 3, 2, 4] and both[2].path == [1]


def test_bound_saves_work(spark):
    step = 0.01
    grid = spark.createDataFrame([(10 * i + j, i * step, j * step) for i in range(5) for j in range(5)], "node long, lat double, lon double")
    pairs = [(10 * i + j, 10 * (i + a) + j + b) for i in range(5) for j in range(5) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < 5 and 0 <= j + b < 5]
    raw = spark.createDataFrame([(u, v, ["primary"], ["1 mph"], None) for u, v in pairs], "u long, v long, highway array<string>, maxspeed array<string>, lanes array<string>")
    edges = roads.free_flow(roads.build_edges(raw, grid))
    one = spark.createDataFrame([(0, 0, 44, DEPART), (1, 22, 23, DEPART)], "query_id long, origin long, dest long, depart_time timestamp_ntz")
    plain, guided = search.dijkstra(one, edges).orderBy("query_id").collect(), search.astar(one, edges, grid, 1.0).orderBy("query_id").collect()
    for a, b in zip(plain, guided, strict=True):
        assert math.isclose(a.cost, b.cost, rel_tol=1e-9)
    assert all(b.work <= a.work for a, b in zip(plain, guided, strict=True)) and guided[1].work < plain[0].work
    degree = {r.node: r.out_degree for r in roads.adjacency(edges).collect()}
    assert (degree[0], degree[22]) == (2, 4)
    assert roads.largest_strong_share(edges, grid).first().largest_share == 1.0


def test_coverage_and_blind_trust(spark, queries, edges):
    two = queries.where("query_id = 0")
    nothing = spark.createDataFrame([], "edge_id string, timestamp timestamp_ntz, eta_s double, sigma_s double")
    assert search.dijkstra(two, edges, search.timed_costs(nothing, 5)).first().cost == 10.0
    slow = spark.createDataFrame([("CB", DEPART, 100.0, 0.0)], "edge_id string, timestamp timestamp_ntz, eta_s double, sigma_s double")
    r = search.dijkstra(two, edges, search.timed_costs(slow, 5)).first()
    assert (r.cost, r.path) == (12.0, [1, 2, 4])


def test_arrival_decides_the_bucket(spark, queries, edges):
    late = edges.where("edge_id IN ('AC', 'CB')").withColumn("free_flow_s", F.when(F.col("edge_id") == "AC", 301.0).otherwise(F.col("free_flow_s")))
    told = spark.createDataFrame([("CB", DEPART, 1.0, 0.0), ("CB", datetime(2012, 6, 4, 8, 5), 50.0, 0.0)], "edge_id string, timestamp timestamp_ntz, eta_s double, sigma_s double")
    one = queries.where("query_id = 1")
    assert search.dijkstra(one, late, search.timed_costs(told, 5)).first().cost == 351.0


def test_realized(spark, edges):
    paths = spark.createDataFrame([(0, [1, 3, 2, 4]), (1, None), (2, [1]), (3, [1, 4]), (4, [5, 6])], "query_id long, path array<long>")
    assert {r.query_id: r.realized for r in search.realized_static(paths, edges).collect()} == {0: 10.0, 1: math.inf, 2: 0.0, 3: math.inf, 4: 5.0}


def _random_case(spark, seed, name=lambda i: i, kind="long"):
    rnd = random.Random(seed)
    places = {i: (rnd.random() / 50, rnd.random() / 50) for i in range(40)}
    edges = [(f"e{k}", name(u), name(v), round(rnd.random() * 300 + 60, 3)) for k in range(130) if (u := rnd.randrange(40)) != (v := rnd.randrange(40))]
    queries = [(q, name(rnd.randrange(41)), name(rnd.randrange(41)), datetime(2012, 6, 4, 8, rnd.randrange(60))) for q in range(60)]
    told = [(e, datetime(2012, 6, 4, 8 + k // 12, 5 * (k % 12)), round(rnd.random() * 400 + 1, 3), 1.0) for e, *_ in edges for k in range(24) if rnd.random() < 0.6]
    frames = (
        spark.createDataFrame(queries, f"query_id long, origin {kind}, dest {kind}, depart_time timestamp_ntz"),
        spark.createDataFrame(edges, f"edge_id string, u {kind}, v {kind}, free_flow_s double"),
        spark.createDataFrame([(name(i), *p) for i, p in places.items()], f"node {kind}, lat double, lon double"),
        spark.createDataFrame(told, "edge_id string, timestamp timestamp_ntz, eta_s double, sigma_s double"),
    )
    return queries, edges, frames


def _cheapest(edges, origin, dest):
    todo, done = [(0.0, origin)], {}
    while todo:
        cost, node = heapq.heappop(todo)
        if node in done:
            continue
        done[node] = cost
        for _, u, v, w in edges:
            if u == node and v not in done:
                heapq.heappush(todo, (cost + w, v))
    return done.get(dest), done


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_of_random_networks(spark, seed, monkeypatch):
    """All methods, with numbers or names as nodes, broadcast or joined, against a search one by one."""
    queries, rows, (q, e, n, _) = _random_case(spark, seed)
    want = {i: _cheapest(rows, o, d) for i, o, d, _ in queries}
    plain, line, both = (r.collect() for r in (search.dijkstra(q, e), search.astar(q, e, n, 1000.0), search.bidirectional(q, e)))
    weight = {(u, v): min(w for _, a, b, w in rows if (a, b) == (u, v)) for _, u, v, _ in rows}
    for found in (plain, line, both):
        assert len(found) == len(queries)
        for r in found:
            cost = want[r.query_id][0]
            assert r.cost == cost or math.isclose(r.cost, cost, rel_tol=1e-9)
            if cost is not None:
                assert (r.path[0], r.path[-1], r.hops) == (r.origin, r.dest, len(r.path) - 1)
                assert math.isclose(sum(weight[x] for x in zip(r.path, r.path[1:], strict=False)), cost, rel_tol=1e-9, abs_tol=1e-9)
    for r in plain:
        cost, done = want[r.query_id]
        known = any(r.origin in (u, v) for _, u, v, _ in rows)
        assert not known or r.work == sum(c <= (math.inf if cost is None else cost + 1e-6) for c in done.values())
    assert sum(r.work for r in line) < sum(r.work for r in plain)
    labels = {(r.query_id, r.node): r.cost for r in search.distances(q, e).collect()}
    assert {k: round(c, 6) for k, c in labels.items()} == {(i, v): round(c, 6) for i, (_, done) in want.items() for v, c in done.items()}
    names = {r.query_id: r.cost for r in search.dijkstra(*_random_case(spark, seed, lambda i: f"n{i}", "string")[2][:2]).collect()}
    assert names == {r.query_id: r.cost for r in plain}
    monkeypatch.setattr(search, "MAX_EDGES", 0)
    few = {(r.query_id, r.node): r.cost for r in search.distances(q.where("query_id < 5"), e).collect()}
    assert few == {k: c for k, c in labels.items() if k[0] < 5}


@pytest.mark.parametrize("seed", [1, 3])
def test_costs_through_separators(spark, seed, monkeypatch):
    """A long network in pieces, also of two unjoined ones: costs of all methods as one by one, and few searches from the separators' nodes."""
    rnd = random.Random(seed)
    pairs = {(k + p, k + p + rnd.choice((-5, -3, -1, 1, 2, 4, 6))) for k in (0, 1000) for p in range(300) for _ in range(3)}
    rows = [(f"{u}_{v}", u, v, float(rnd.randint(1, 90)) / 7) for u, v in sorted(pairs) if u // 1000 == v // 1000 and 0 <= v % 1000 < 300]
    e = spark.createDataFrame(rows, "edge_id string, u long, v long, free_flow_s double")
    n = spark.createDataFrame([(k + p, 34.0, -118.0 + p / 1e6) for k in (0, 1000) for p in range(300)], "node long, lat double, lon double")
    ends = [(i, rnd.choice((0, 0, 0, 1000)) + rnd.randrange(300), rnd.choice((0, 0, 1000)) + rnd.randrange(300)) for i in range(150)] + [(150, 7, 7), (151, 5000, 5000), (152, 5000, 3), (153, 3, 5000), (0, 1, 290)]
    q = spark.createDataFrame([(*x, DEPART) for x in ends], "query_id long, origin long, dest long, depart_time timestamp_ntz")
    want = {(r.query_id, r.origin, r.dest): r.cost for r in search.dijkstra(q, e).collect()}
    net = search.broadcast_network(search.Roads(e)).value
    monkeypatch.setattr(search.P, "LEAST_PART", 40)
    made = search.P.parts(net, len(ends))
    assert sum(b is not None for b in made.between) >= 3 and all(len(b) < 30 for b in made.between if b is not None)
    for found in (search.route_costs(q, e), search.route_costs(q, e, n, 1000.0), search.route_costs(q, e, both_ends=True)):
        got = {(r.query_id, r.origin, r.dest): r.cost for r in found.collect()}
        assert set(got) == set(want)
        assert all(got[k] == want[k] or math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def _settled(out, text, start, goal, cost, bound, most=math.inf, back=False):
    """A plain search in order: label of every node, nodes before and how many were taken."""
    best, before, done, todo = {start: 0.0}, {}, [], [(bound(start), text(start), start)]
    while todo:
        rank, _, u = heapq.heappop(todo)
        if u in done:
            continue
        if rank > most:
            break
        done.append(u)
        if u == goal:
            break
        for e, v in sorted(out.get(u, [])):
            c = best[u] + cost(e, best[u])
            if v not in done and c < best.get(v, math.inf):
                best[v], before[v] = c, u
                heapq.heappush(todo, (c + bound(v), text(v), v))
    path = [goal]
    while path[-1] in before and path[-1] != start:
        path.append(before[path[-1]])
    return best, (path[::-1] if goal in best else None), len(done)


def _plain(edges, places, told, mph):
    """The methods of :mod:`fernway.operators.search`, a query at a time with plain dictionaries."""
    free = {e: w for e, _, _, w in edges}
    out, into = {}, {}
    for e, u, v, _ in edges:
        out.setdefault(u, []).append((e, v))
        into.setdefault(v, []).append((e, u))
    said = {(e, t): (c, s) for e, t, c, s in told}

    def at(depart, spent):
        when = depart + timedelta(seconds=spent)
        return when.replace(minute=when.minute - when.minute % 5, second=0, microsecond=0)

    def line(dest):
        def h(n):
            if n not in places or dest not in places:
                return 0.0
            (a, b), (c, d) = (tuple(map(math.radians, places[x])) for x in (n, dest))
            x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
            return 2 * 6371000.0 * math.asin(math.sqrt(x)) / (mph * 0.44704)

        return h

    def guided(origin, dest, depart, weight, modulated, share=1.0, own=None):
        def tell(e, spent):
            c, there = free[e], said.get((e, at(depart, spent)))
            if there:
                c = max(there[0] * share, 0.001) if share != 1 else there[0]
            cost, factor = (own or {}).get(e, (None, 1.0))
            return cost if cost is not None else max(c * factor, 0.001) if there and own and e in own else c

        def real(e, spent):
            return said.get((e, at(depart, spent)), (free[e],))[0]

        def walk(path):
            spent = 0.0
            for u, v in zip(path, path[1:], strict=False):
                spent += min(real(e, spent) for e, w in out[u] if w == v)
            return spent

        h = line(dest)
        _, safe, _ = _settled(out, str, origin, dest, lambda e, s: free[e], h)
        if modulated:
            spent, doubts = 0.0, []
            for u, v in zip(safe or [], (safe or [])[1:], strict=False):
                e = min(e for e, w in out[u] if w == v)
                if (e, at(depart, spent)) in said:
                    doubts.append(0.0 if own or share < 1 else said[e, at(depart, spent)][1] / max(tell(e, spent), 1e-6))
                spent += tell(e, spent)
            weight /= 1 + (sum(doubts) / len(doubts) if doubts else 0.0)
        go, _, _ = _settled(into, str, dest, None, lambda e, s: tell(e, 0.0), lambda n: 0.0, most=3 * h(origin), back=True)
        _, path, work = _settled(out, str, origin, dest, tell, lambda n: h(n) + weight * (go.get(n, h(n)) - h(n)))
        if origin == dest:
            path, safe, work = [origin], [origin], 1
        return safe and walk(safe), path and walk(path), weight, safe, path, work

    return guided


@pytest.mark.parametrize("ties", [False, True])
def test_every_method_at_any_size(spark, ties, monkeypatch):
    """Rows of searches on a broadcast network, on cells of it and of plain ones, with told times, doubt, shares and edges of a query's own.

    With ties all edges cost the same, by which the bound is too high in many places."""
    queries, rows, (q, e, n, told) = _random_case(spark, 4)
    if ties:
        rows = [(k, u, v, 60.0) for k, u, v, _ in rows]
        e = e.withColumn("free_flow_s", F.lit(60.0))
        told = told.withColumn("eta_s", F.lit(30.0) + 30 * (F.minute("timestamp") / 5 % 2))
    told = told.withColumn("sigma_s", F.col("eta_s") * (F.hash("edge_id") % 3 + 3) / 4)
    places = {r.node: (r.lat, r.lon) for r in n.collect()}
    plain = _plain(rows, places, [tuple(r) for r in told.select("edge_id", "timestamp", "eta_s", "sigma_s").collect()], 20.0)
    own = F.when(F.col("query_id") % 3 == 0, F.transform(F.array(F.lit("e1"), F.lit("e2"), F.lit("e7"), F.lit("e9")), lambda k: F.struct(k.alias("edge_id"), F.when(k == "e1", F.lit(1e7)).alias("cost"), F.lit(0.25).alias("factor"))))
    asked = q.where("query_id < 30").withColumns({"weight": F.lit(0.25) * (F.col("query_id") % 5), "modulated": F.col("query_id") % 2 == 0, "share": F.when(F.col("query_id") % 7 == 0, 0.5).otherwise(1.0), "own": own})
    costs = search.timed_costs(told, 5, told)

    def every():
        noisy = search.Costs(told=told, real=told, minutes=5, noise_seed="7")
        tables = {
            "plain": search.dijkstra(asked, e, costs),
            "line": search.astar(asked, e, n, 20.0, costs),
            "noisy": search.astar(asked.withColumn("noise", F.lit(0.3)), e, n, 20.0, noisy),
            "both": search.bidirectional(q, e),
            "guided": search.guided(asked, e, n, 20.0, costs),
            "reached": search.distances(asked.where("query_id < 4"), e, costs),
        }
        trap = search.corridor_and_trap(q.where("query_id < 8"), e, costs)
        found = {k: sorted(map(str, t.drop("latency_ms").collect())) for k, t in tables.items()}
        return found | {"trap": sorted(map(str, trap.collect()))}, tables["guided"].collect()

    whole, rows_of = every()
    fixed = {"e1": (1e7, 0.25), **{k: (None, 0.25) for k in ("e2", "e7", "e9")}}
    for r in rows_of:
        i, o, d, depart = queries[r.query_id]
        want = plain(o, d, depart, 0.25 * (i % 5), i % 2 == 0, 0.5 if i % 7 == 0 else 1.0, fixed if i % 3 == 0 else None)
        if o in places and any(o in x[1:3] for x in rows):
            assert (r.classical_path, r.candidate_path, r.work) == want[3:]
            assert all(a == b or math.isclose(a, b, rel_tol=1e-9) for a, b in zip((r.classical_cost, r.candidate_cost, r.weight_used), want[:3], strict=True))
    monkeypatch.setattr(search, "MAX_EDGES", 0)
    monkeypatch.setattr(search.C, "CELL_EDGES", 9)
    monkeypatch.setattr(search.C, "BATCH", 3)
    assert every()[0] == whole


def test_noise_is_drawn_as_in_columns(spark):
    rows = [("e1", DEPART), ("e2", datetime(2012, 6, 4, 8, 0, 59))]
    df = spark.createDataFrame(rows, "edge_id string, timestamp timestamp_ntz").withColumns({"eta_s": F.lit(10.0), "sigma_s": F.lit(0.0)})
    for r in predictors.noisy(df, 0.5, seed=7).collect():
        z = search.N.drawn_normal("7", r.edge_id, (r.timestamp - datetime(1970, 1, 1)).total_seconds())
        assert math.isclose(r.eta_s, max(10 * (1 + 0.5 * z), 0.001), rel_tol=1e-9)
    assert search.N.drawn_normal("7", "e1", 0.25) != search.N.drawn_normal("7", "e1", 0.0)


def test_timed_costs_along_paths(spark):
    _, _, (q, e, _, told) = _random_case(spark, 3)
    costs = search.timed_costs(told, 5, told)
    one = {r.query_id: r for r in search.dijkstra(q, e, costs).collect()}
    paths = spark.createDataFrame([(i, r.path) for i, r in one.items()] + [(-1, [1, 1]), (-2, [0])], "query_id long, path array<long>").join(q.select("query_id", "depart_time"), "query_id", "left")
    walked = {r.query_id: r.realized for r in search.realized(paths.withColumn("depart_time", F.coalesce("depart_time", F.lit(DEPART).cast("timestamp_ntz"))), e, told, 5).collect()}
    assert (walked.pop(-1), walked.pop(-2)) == (math.inf, 0.0)
    for i, r in one.items():
        assert r.cost == r.true_cost and (math.isinf(walked[i]) if r.path is None else math.isclose(walked[i], r.cost, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize(
    ("alpha", "classical", "candidate", "taken", "invoked", "ratio"),
    [
        (0.5, 10.0, 12.0, "candidate", False, 1.2),
        (0.2, 10.0, 25.0, "classical", True, 1.0),
        (0.2, 10.0, 12.0, "candidate", False, 1.2),
        (0.5, 10.0, None, "classical", True, 1.0),
        (0.5, None, 12.0, "none", False, None),
        (0.5, 0.0, 0.0, "candidate", False, 1.0),
        (0.5, 0.0, None, "classical", True, 1.0),
    ],
)
def test_guard(spark, alpha, classical, candidate, taken, invoked, ratio):
    rows = spark.createDataFrame([(classical, candidate)], "classical_cost double, candidate_cost double")
    r = guard.guard(rows, alpha).first()
    assert (r.taken, r.guard_invoked, r.ratio) == (taken, invoked, ratio)


def test_arguments(spark, queries, edges):
    rows = spark.createDataFrame([(1.0, 1.0)], "classical_cost double, candidate_cost double")
    with pytest.raises(ValueError):
        guard.guard(rows, -0.1)
    for weight in (-0.1, 1.1):
        with pytest.raises(ValueError):
            guard.effective_weight(queries, edges, edges, weight, 5)
    with pytest.raises(ValueError):
        predictors.adversarial(rows, 1.0)
    with pytest.raises(ValueError):
        predictors.noisy(rows, -1.0)
    with pytest.raises(Exception, match="guarded ratio"):
        guard.check_floor(rows.withColumn("ratio", F.lit(1.4)), 0.3).collect()


def test_weight_follows_doubt(spark, queries, edges):
    one = queries.where("query_id = 0").withColumn("path", F.array(*[F.lit(x).cast("long") for x in (1, 3, 2, 4)]))
    for sigma, want in ((0.0, 0.8), (10.0, 0.8 / 11)):
        told = spark.createDataFrame([(e, DEPART, 5.0, 5.0 * sigma) for e in ("AC", "CB", "BD")], "edge_id string, timestamp timestamp_ntz, eta_s double, sigma_s double")
        assert math.isclose(guard.effective_weight(one, edges, told, 0.8, 5).first().weight_used, want)
    assert guard.effective_weight(one, edges, told.limit(0), 0.6, 5).first().weight_used == 0.6


def test_lured_route_is_guarded(spark):
    edges = spark.createDataFrame([("AB", 1, 2, 5.0), ("BD", 2, 4, 5.0), ("AC", 1, 3, 8.0), ("CD", 3, 4, 8.0)], "edge_id string, u long, v long, free_flow_s double")
    nodes = spark.createDataFrame([(i, 0.0, 0.0) for i in range(1, 5)], "node long, lat double, lon double")
    one = spark.createDataFrame([(0, 1, 4, DEPART)], "query_id long, origin long, dest long, depart_time timestamp_ntz")
    lured = search.corridor_and_trap(one, edges).first()
    assert (lured.corridor, lured.trap) == (["AB", "BD"], ["AC", "CD"])
    real = spark.createDataFrame([(e, DEPART, c, 0.0) for e, c in (("AB", 5.0), ("BD", 5.0), ("AC", 8.0), ("CD", 8.0))], "edge_id string, timestamp timestamp_ntz, eta_s double, sigma_s double")
    told = real.withColumn("eta_s", F.when(F.col("edge_id").isin("AC", "CD"), F.col("eta_s") / 2).otherwise(F.col("eta_s") * 2))
    used = one.select("query_id", F.lit(1.0).alias("weight_used"))

    def robust(alpha, guarded=True):
        return guard.robust_routes(one, edges, nodes, 65.0, search.timed_costs(told, 5, real), weight=used, alpha=alpha, guarded=guarded).first()

    r = robust(0.1)
    assert (r.candidate_cost, r.classical_cost, r.realized_cost, r.taken, r.guard_invoked) == (16.0, 10.0, 10.0, "classical", True)
    r = robust(0.1, guarded=False)
    assert (r.realized_cost, r.ratio, r.guard_invoked) == (16.0, 1.6, False)


def test_service(spark, edges, nodes):
    told = spark.createDataFrame([("CB", DEPART, 3.0, 0.0)], "edge_id string, timestamp timestamp_ntz, eta_s double, sigma_s double")
    loaded = service.Service(nodes, edges, told, 65.0, 5)
    assert service.health(loaded)["status"] == "ok" and service.health(service.Service())["status"] == "not loaded"
    r = service.route(spark, loaded, 1, 4, DEPART, weight=0.0, alpha=0.3)
    assert (r.path, r.cost_s, r.arrival, r.node_expansions) == ([1, 3, 2, 4], 10.0, datetime(2012, 6, 4, 8, 0, 10), 4) and r.latency_ms > 0
    # All nodes are at one place, so that the cost to go of C is known by its own edge to D alone, and the candidate goes by B; the guard lets it.
    r = service.route(spark, loaded, 1, 4, DEPART, alpha=0.3)
    assert (r.path, r.cost_s, r.guard_invoked) == ([1, 2, 4], 12.0, False)
    r = service.route(spark, loaded, 1, 4, DEPART, alpha=0.1)
    assert (r.path, r.cost_s, r.guard_invoked) == ([1, 3, 2, 4], 10.0, True)
    kept = loaded.roads
    for modulated, used in ((False, 0.6), (True, 0.6 / (1 + 2.0))):
        doubtful = service.Service(nodes, edges, told.withColumn("sigma_s", F.lit(6.0)).withColumn("timestamp", F.lit(DEPART).cast("timestamp_ntz")), 65.0, 5)
        assert math.isclose(service.route(spark, doubtful, 1, 4, DEPART, weight=0.6, confidence_modulated=modulated).weight_used, used)
    assert service.route(spark, loaded, 1, 2, DEPART, weight=0.0).path == [1, 3, 2] and loaded.roads is kept
    named = service.Service(nodes.withColumn("node", F.concat(F.lit("n"), "node")), edges.withColumns({c: F.concat(F.lit("n"), c) for c in "uv"}), told, 65.0, 5)
    assert service.route(spark, named, "n1", "n4", DEPART, weight=0.0).path == ["n1", "n3", "n2", "n4"]
    with pytest.raises(service.Unprocessable):
        service.route(spark, named, 1, 4, DEPART)
    with pytest.raises(service.NotLoaded):
        service.route(spark, service.Service(), 1, 4, DEPART)
    for bad in ({"dest": 99}, {"weight": 2.0}, {"alpha": -1.0}):
        args = {"origin": 1, "dest": 4, "depart": DEPART, **bad}
        with pytest.raises(service.Unprocessable):
            service.route(spark, loaded, **args)


def test_a_task_holds_what_one_query_reaches_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"query_id": list(range(5))})
    assert [p.column(0).to_pylist() for p in search.parts(batch, 1)] == [[k] for k in range(5)]
    assert [p.num_rows for p in search.parts(batch, None)] == [5]


def test_walks_along_told_times_broadcast_no_table(spark):
    """Maps and arrays of told times have estimates far below their size."""
    from datetime import datetime

    at = datetime(2024, 1, 25)
    edges = spark.createDataFrame([("e", 1, 2, 5.0), ("f", 2, 3, 7.0)], "edge_id string, u long, v long, free_flow_s double")
    told = spark.createDataFrame([("e", at, 4.0, 1.0)], "edge_id string, timestamp timestamp_ntz, eta_s double, sigma_s double")
    paths = spark.createDataFrame([(1, [1, 2, 3], at), (2, None, at)], "query_id long, path array<long>, depart_time timestamp_ntz")
    found = search.folded(paths, edges, told, 60)
    assert {r.query_id: r.fold.spent for r in found.collect()} == {1: 11.0, 2: math.inf}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_points_of_a_query_share_what_they_find_alike(monkeypatch):
    n = 30
    pairs = [(a, b) for a in range(n) for b in (a - 1, a + 1, a + 3) if 0 <= b < n]
    u, v = (np.array(x) for x in zip(*pairs, strict=True))
    net = N.Network(np.array([f"{a}_{b}" for a, b in pairs], dtype=object), u, v, np.array([10.0 + (7 * a + b) % 5 for a, b in pairs]))
    net.noise_seed, m = "5", len(pairs)
    net.told = N.TimeTable.of(m, np.arange(m), np.zeros(m), net.free * 2, np.zeros(m), 60)
    net.lat, net.lon = 34 + net.ids / 1000, np.full(n, -118.0)
    ready, drawn, real = net.ready, [], N.drawn_normal
    start, goal = net.places([0, n - 1])
    monkeypatch.setattr(N, "drawn_normal", lambda *key: drawn.append(key) or real(*key))

    def costs(shared):
        found = []
        for weight in (0.0, 0.5, 1.0):
            query = N.Query(start, goal, 60.0, {}, 1.0, 0.5, shared=shared if shared is not None else {})
            line = query.once(("line",), lambda: N.line_bound(ready, goal, 65.0))
            bound = N.blended_bound(ready, query, line, net.told, weight)
            found.append(N.settle(ready, query, start, goal, N.steps(ready, query, net.told), bound).cost[goal])
        return found

    alone, n_alone = costs(None), len(drawn)
    drawn.clear()
    assert costs({}) == alone and len(drawn) == len(set(drawn)) < n_alone
    # Cells that the first query misses are missed by those that share with it.
    shared = {}
    for _ in range(2):
        query = N.Query(start, goal, 0.0, shared=shared)
        query.once(("x",), lambda query=query: query.missing.add(4))
        assert query.missing == {4}


@pytest.mark.parametrize("seed", [1, 2])
def test_queries_near_one_another_are_searched_together(spark, seed, monkeypatch):
    """Nodes settled, corridors and traps as by a search of each query, with parallel edges, unjoined pieces, ties and nodes without edges."""
    rnd = random.Random(seed)
    pairs = [(k + p, k + p + rnd.choice((-5, -3, -1, 1, 2, 4, 6))) for k in (0, 1000) for p in range(120) for _ in range(3)]
    pairs = [x for x in pairs if x[0] // 1000 == x[1] // 1000 and 0 <= x[1] % 1000 < 120]
    rows = [(f"{u}_{v}_{i}", u, v, float(rnd.randint(2, 9))) for i, (u, v) in enumerate([*pairs, *pairs[::9]])]
    e = spark.createDataFrame(rows, "edge_id string, u long, v long, free_flow_s double")
    n = spark.createDataFrame([(k + p, 34.0, -118.0 + p / 1e6) for k in (0, 1000) for p in range(120)] + [(5000, 34.0, -118.0)], "node long, lat double, lon double")
    ends = [(i, rnd.choice((0, 0, 0, 1000)) + rnd.randrange(120), rnd.choice((0, 0, 1000)) + rnd.randrange(120)) for i in range(90)] + [(90, 7, 7), (91, 5000, 5000), (92, 5000, 3), (93, 3, 5000)]
    q = spark.createDataFrame([(*x, DEPART) for x in ends], "query_id long, origin long, dest long, depart_time timestamp_ntz")
    net = search.broadcast_network(search.Roads(e, n), with_places=True).value
    assert search.M.rises(net, 1e7) and search.M.bound_holds(net, 1000.0) and not search.M.bound_holds(net, 0.01)
    origins = net.places([1, 2, 3, 50, 1004])
    cost = search.M.costs(net, search.M.Rows(net), origins)
    for k, origin in enumerate(origins):
        assert {i: c for i, c in enumerate(cost[:, k].tolist()) if c < math.inf} == search.N.settle(net.ready, search.N.Query(origin, -1, 0.0), origin).cost

    def found():
        work, luring = search.efforts(q, e, n, 1000.0).collect(), search.corridor_and_trap(q, e).collect()
        return {(r.query_id, r.dijkstra_work, r.astar_work) for r in work}, {(r.query_id, tuple(r.corridor), tuple(r.trap)) for r in luring}

    together = found()
    monkeypatch.setattr(search.M, "rises", lambda *_: False)
    assert together == found() and len(together[0]) == len(together[1]) == len(ends)
    assert any(a and b and set(a) & set(b) for _, a, b in together[1]) and any(a != b for _, a, b in together[0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_shortest_path_of_a_network_too_large_to_broadcast(spark, monkeypatch):
    from fernway.plans import catalogue

    d = "/root/testdata/sf0.001"
    small = sorted(map(tuple, catalogue.shortest_path_function(spark, d).collect()))
    monkeypatch.setattr(search, "MAX_EDGES", 0)
    assert small and sorted(map(tuple, catalogue.shortest_path_function(spark, d).collect())) == small


def _refuse(*_, **__):
    raise AssertionError("a search for each query")


def _bits(rows):
    return sorted((tuple(x) for x in rows), key=repr)


def test_doubt_of_many_routes_at_once(spark, monkeypatch):
    _, _, (q, e, _, told) = _random_case(spark, 6)
    told = told.withColumn("sigma_s", F.col("eta_s") * (F.hash("edge_id") % 3 + 3) / 4)
    alone = _bits(guard.effective_weight(search.dijkstra(q, e), e, told, 0.8, 5).select("query_id", F.round("weight_used", 9)).collect())
    monkeypatch.setattr(guard.R, "dijkstra", _refuse)
    found = _bits(guard.effective_weights(q, e, told, 0.8, 5).select("query_id", F.round("weight_used", 9)).collect())
    assert found == alone and len({w for _, w in found}) > 2


def test_corridors_of_many_queries_at_once(spark, monkeypatch):
    _, _, (q, e, _, _) = _random_case(spark, 6)
    # Parallel edges and ties.
    e = e.unionByName(e.where("hash(edge_id) % 3 = 0").withColumn("edge_id", F.concat("edge_id", F.lit("x")))).withColumn("free_flow_s", 1 + F.round("free_flow_s", -2))
    monkeypatch.setattr(search.M, "rises", lambda *_: False)
    alone = _bits(search.corridor_and_trap(q, e).collect())
    monkeypatch.undo()
    monkeypatch.setattr(search, "dijkstra", _refuse)
    found = _bits(search.corridor_and_trap(q, e).collect())
    assert found == alone and any(a and b for _, a, b in found)


def test_costs_to_all_nodes_of_many_queries_at_once(spark, monkeypatch):
    _, _, (q, e, _, _) = _random_case(spark, 6)
    monkeypatch.setattr(search.M, "rises", lambda *_: False)
    alone = _bits(search.distances(q, e).collect())
    monkeypatch.undo()
    monkeypatch.setattr(search, "_run", _refuse)
    assert _bits(search.distances(q, e).collect()) == alone and alone
