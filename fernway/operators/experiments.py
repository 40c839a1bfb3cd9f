"""The experiments: every sweep's methods run on the same queries, one row a query, method and point, judged by the real costs.

Points that differ only in what a query is told (a share of the true time, noise by seed, edges of an adversary, a weight) are searched
together: each is a copy of the queries with columns of its own. So there is one search for each table of told times and kind of method.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernway.functions import scalar as S
from fernway.operators import guard, search
from fernway.operators.evaluation import CLASSICAL, provenance, reachable_queries, sampled_queries, stratified
from fernway.operators.roads import breadth_first, induced
from fernway.operators.rounds import cut

# The sweeps, with their seeds, methods and points.
ALPHA = 0.3
EVERY = ("dijkstra", "astar", "bidirectional", "pure_ml_astar", "robust_astar")
WEIGHTS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


@dataclass(frozen=True)
class Point:
    """What one point of a sweep tells: a predictor with its parameter, and how far it is trusted."""

    predictor: str
    parameter: float | None = None
    weight: float = 1.0
    mode: str = "fixed"
    swept: float | None = None

    @property
    def value(self) -> float | None:
        return self.parameter if self.swept is None else self.swept


@dataclass(frozen=True)
class Run:
    name: str
    seed: int
    methods: tuple[str, ...]
    points: tuple[Point, ...]


RUNS = (
    Run("consistency_sweep", 1001, EVERY, (Point("oracle"), Point("quantile"), Point("noisy", 1.0))),
    Run("robustness_sweep", 2002, EVERY, tuple(Point("adversarial", b) for b in (0.0, 0.2, 0.4, 0.6, 0.8, 0.95))),
    Run("smoothness_sweep", 3003, EVERY, tuple(Point("noisy", s) for s in (0.0, 0.1, 0.2, 0.5, 1.0, 2.0))),
    Run("ablation_guard", 4004, ("robust_astar", "robust_astar_no_guard"), (Point("adversarial", 0.95), Point("noisy", 1.0))),
    Run("ablation_lambda_mode", 5005, ("robust_astar",), (Point("quantile"), Point("quantile", mode="confidence_modulated"))),
    Run("ablation_lambda_sweep", 6006, ("robust_astar",), tuple(Point("quantile", weight=w, swept=w) for w in WEIGHTS)),
    Run("ablation_feature", 7007, ("pure_ml_astar", "robust_astar"), (Point("quantile"), Point("quantile_ablation"))),
    *(Run(f"lambda_sweep_degraded_sigma_{s}", 8001 + k, ("robust_astar",), tuple(Point("noisy", s, weight=w, swept=w) for w in WEIGHTS)) for k, s in enumerate((0.5, 1.0, 2.0))),
    Run("adversarial_budget_sweep", 9001, ("pure_ml_astar", "robust_astar", "robust_astar_no_guard"), tuple(Point("routing_aware", b) for b in (0.25, 0.5, 1.0, 2.0))),
    Run("adversary_lambda_diagnosis", 9001, ("robust_astar",), tuple(Point("routing_aware", 1.0, weight=w, swept=w) for w in WEIGHTS)),
)


def sweep_points(spark: SparkSession, runs: tuple[Run, ...] = RUNS) -> DataFrame:
    """run_id, predictor, sweep_value, lambda_base and lambda_mode: every point of every sweep."""
    return spark.createDataFrame([(r.name, p.predictor, p.value, p.weight, p.mode) for r in runs for p in r.points], "run_id string, predictor string, sweep_value double, lambda_base double, lambda_mode string")


def planned_runs(queries: DataFrame, runs: tuple[Run, ...] = RUNS) -> DataFrame:
    """queries with each run's methods and points, a row each; classical methods have one row per query and run."""
    plan = [(r.name, m, None if m in CLASSICAL else p.predictor, None if m in CLASSICAL else p.value) for r in runs for m in r.methods for p in (r.points[:1] if m in CLASSICAL else r.points)]
    literal = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(m).alias("method"), F.lit(p).cast("string").alias("predictor"), F.lit(v).cast("double").alias("sweep_value")) for r, m, p, v in plan])
    return queries.withColumn("_plan", F.explode(literal)).select(*queries.columns, "_plan.*")


def point_id(run: Run, k: int) -> str:
    return f"{run.name}/{k}"


def source(run: Run, point: Point) -> str:
    """What the point is told: predictions by name, or the true times, with noise drawn by seed."""
    if point.predictor in ("quantile", "quantile_ablation"):
        return point.predictor
    return f"noise {run.seed}" if point.predictor == "noisy" else "true"


@dataclass(frozen=True)
class World:
    """What the experiments run on. ``predicted``: tables (edge_id, timestamp, eta_s, sigma_s) by name; ``real``: the true times."""

    edges: DataFrame
    nodes: DataFrame
    max_mph: float
    real: DataFrame
    predicted: dict[str, DataFrame]
    minutes: int

    def roads(self, since=None) -> search.Roads:
        """The network for searches that share it, none of which departs before ``since``."""
        return search.Roads(self.edges, self.nodes, since)

    def told(self, name: str) -> search.Costs:
        """The costs of a source; the seed of noise is a column of the queries."""
        return search.Costs(told=self.predicted.get(name, self.real), real=self.real, minutes=self.minutes)


def _swept(queries: DataFrame, points: list[tuple[str, Run, Point]]) -> DataFrame:
    """A copy of the queries for each point, with its weight, share, noise and its seed, and edges of an adversary."""
    fields = [
        F.struct(
            F.lit(key).alias("point"),
            F.lit(p.weight).alias("weight"),
            F.lit(p.mode == "confidence_modulated").alias("modulated"),
            F.lit(1 - p.parameter if p.predictor == "adversarial" else 1.0).alias("share"),
            F.lit(p.parameter if p.predictor == "noisy" else 0.0).alias("noise"),
            F.lit(str(run.seed) if p.predictor == "noisy" else None).cast("string").alias("noise_seed"),
            F.lit(p.parameter if p.predictor == "routing_aware" else None).cast("double").alias("budget"),
        )
        for key, run, p in points
    ]
    rows = queries.withColumn("_p", F.explode(F.array(*fields))).select(*queries.columns, "_p.*")
    own = F.when(F.col("budget").isNotNull(), search.lured(F.col("corridor"), F.col("trap"), F.col("budget")))
    return rows.withColumn("own", own) if any(p.predictor == "routing_aware" for *_, p in points) else rows


def optimal_costs(queries: DataFrame, world: World, roads: search.Roads | None = None) -> DataFrame:
    """query_seed, query_id, oracle_optimal_cost: the cost of the best route by the true times."""
    best = search.astar(queries, roads or world.roads(), None, world.max_mph, world.told("true"), keys=("query_seed",))
    return best.select("query_seed", "query_id", F.coalesce("cost", F.lit(float("inf"))).alias("oracle_optimal_cost"))


def run_all(queries: DataFrame, world: World, runs: tuple[Run, ...] = RUNS, alpha: float = ALPHA) -> DataFrame:
    """One row for each query (query_seed, query_id, origin, dest, depart_time and strata), run, method and point.

    cost is what the path taken costs by the true times, infinite without one. A guarded row above one plus alpha is an error.
    """
    queries = cut(queries)
    roads = world.roads(search.first_bucket(queries, world.minutes))
    key = ("query_seed",)
    free = search.free_flow_plans(world.real, world.minutes)
    rows: list[DataFrame] = []

    def outcome(method: str, cost: str, invoked: Column | None = None, ratio: Column | None = None) -> Column:
        null = F.lit(None)
        named = {"method": F.lit(method), "cost": F.coalesce(cost, F.lit(float("inf"))), "guard_invoked": null.cast("boolean") if invoked is None else invoked, "robustness_bound_ratio": null.cast("double") if ratio is None else ratio}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    def put(found: DataFrame, *outcomes: Column, point: Column | None = None) -> None:
        """A row for each of the outcomes of a search, which is made once for all of them."""
        place = F.lit(None).cast("string") if point is None else point
        each = found.select(*key, "query_id", place.alias("point"), F.col("work").alias("node_expansions"), "latency_ms", F.explode(F.array(*outcomes)).alias("_o"))
        rows.append(each.select(*key, "query_id", "point", "_o.method", "_o.cost", "node_expansions", "latency_ms", "_o.guard_invoked", "_o.robustness_bound_ratio"))

    wanted = {m for run in runs for m in run.methods}
    for method in CLASSICAL:
        if method in wanted:
            bound = (None, world.max_mph) if method == "astar" else ()
            found = getattr(search, method)(queries, roads, *bound, costs=free, keys=key)
            put(found, outcome(method, "true_cost"))
    by_source: dict[str, list[tuple[str, Run, Point]]] = {}
    for run in runs:
        for k, point in enumerate(run.points):
            # Noise is added to the true times by each query, so that one search has all seeds.
            name = source(run, point)
            by_source.setdefault(name if name in world.predicted else "true", []).append((point_id(run, k), run, point))
    luring = any(p.predictor == "routing_aware" for run in runs for p in run.points)
    if luring:
        lured = cut(queries.join(search.corridor_and_trap(queries, roads, world.told("true"), keys=key), ["query_seed", "query_id"]))
    for name, points in by_source.items():
        costs, keys = world.told(name), (*key, "point")
        base = lured if any(p.predictor == "routing_aware" for *_, p in points) else queries
        pure = [(i, run, p) for i, run, p in points if "pure_ml_astar" in run.methods]
        if pure:
            found = search.astar(_swept(base, pure), roads, None, world.max_mph, costs, keys=keys)
            put(found, outcome("pure_ml_astar", "true_cost"), point=F.col("point"))
        robust = [(i, run, p) for i, run, p in points if any(m.startswith("robust") for m in run.methods)]
        if robust:
            found = guard.robust_routes(_swept(base, robust), roads, None, world.max_mph, costs, alpha=alpha, keys=keys)
            put(found, outcome("robust_astar", "realized_cost", F.col("guard_invoked"), F.col("ratio")), outcome("robust_astar_no_guard", "candidate_cost"), point=F.col("point"))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return _named(every, queries, optimal_costs(queries, world, roads), runs, alpha)


def _named(rows: DataFrame, queries: DataFrame, optimum: DataFrame, runs: tuple[Run, ...], alpha: float) -> DataFrame:
    """The rows of each run's methods, with the columns of the result table."""
    plan = []
    for run in runs:
        for method in run.methods:
            points = [(None, Point("none"))] if method in CLASSICAL else [(point_id(run, k), p) for k, p in enumerate(run.points)]
            for place, p in points:
                guided = method.startswith("robust")
                parameters = {} if p.parameter is None else {"value": p.parameter}
                plan.append((run.name, run.seed, method, place, p.predictor, json.dumps(parameters, sort_keys=True), p.value, p.weight if guided else None, p.mode if guided else None, alpha if guided else None, method == "robust_astar" if guided else None))
    names = "run_id string, seed long, method string, _point string, predictor_type string, predictor_params string, sweep_value double, lambda_base double, lambda_mode string, alpha double, guard_enabled boolean"
    planned = F.broadcast(rows.sparkSession.createDataFrame(plan, names))  # some hundred rows, fixed by the sweeps
    named = rows.withColumnRenamed("method", "_method").join(planned, (F.col("_method") == F.col("method")) & F.col("point").eqNullSafe(F.col("_point"))).drop("_method", "_point", "point")
    placed = named.join(queries, ["query_seed", "query_id"]).join(optimum, ["query_seed", "query_id"])
    same = (F.col("oracle_optimal_cost") == 0) & (F.col("cost") == 0)
    ratio = F.when(same, F.lit(1.0)).when(F.col("oracle_optimal_cost") == 0, F.lit(float("inf"))).otherwise(F.try_divide("cost", "oracle_optimal_cost"))
    return placed.withColumns({"experiment": F.col("run_id"), "competitive_ratio": ratio})


def results(queries: DataFrame, world: World, runs: tuple[Run, ...] = RUNS, alpha: float = ALPHA) -> DataFrame:
    """As :func:`run_all`, with the versions it was made by."""
    return provenance(run_all(queries, world, runs, alpha))


def query_sets(endpoints: DataFrame, times: DataFrame, nodes: DataFrame, max_mph: float, strata, *, seeds: tuple[int, ...], n: int) -> DataFrame:
    """query_seed, query_id, origin, dest, depart_time, distance_stratum and time_stratum: ``n`` sampled queries for each seed."""
    every = None
    for seed in seeds:
        one = stratified(sampled_queries(endpoints, times, n, seed=seed), nodes, max_mph, strata).withColumn("query_seed", F.lit(seed).cast("long"))
        every = one if every is None else every.unionByName(one)
    return every.select("query_seed", "query_id", "origin", "dest", "depart_time", "distance_stratum", "time_stratum")


def scaling(edges: DataFrame, root: DataFrame, sizes: tuple[int, ...], world: World, times: DataFrame, *, n: int, seed: int, point: Point) -> DataFrame:
    """The result table with ``graph_size``: every method on the first so many nodes around a root, for queries with a route there."""
    every, levels = None, cut(breadth_first(edges, root))
    for size in sizes:
        part = cut(induced(edges, levels.orderBy("level", "node").limit(size)))
        queries = reachable_queries(part, times, part, n, seed=seed).withColumns({"query_seed": F.lit(seed).cast("long"), "distance_stratum": F.lit("all"), "time_stratum": F.lit("all")})
        here = replace(world, edges=part)
        one = run_all(queries, here, (Run("scaling", seed, EVERY, (point,)),)).withColumn("graph_size", F.lit(size).cast("long"))
        every = one if every is None else every.unionByName(one)
    return every
