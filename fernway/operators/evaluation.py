"""Query sets, sweeps, ratios and the tables and figure data made from result rows."""

from __future__ import annotations

import json
import platform
from collections.abc import Mapping

import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernway.functions import scalar as S
from fernway.functions import statistics as stats
from fernway.operators import search as R
from fernway.operators.rounds import cut, numbered

CLASSICAL = ("dijkstra", "astar", "bidirectional")


def stratified(queries: DataFrame, nodes: DataFrame, max_mph: float, strata: Mapping[str, tuple[int, int]]) -> DataFrame:
    """The queries with lower_bound_s, distance_stratum (cut at the thirds, inclusive) and time_stratum."""
    ends = [nodes.select(F.col("node").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}")) for x in ("origin", "dest")]
    placed = queries.join(ends[0], "origin").join(ends[1], "dest")
    bound = F.round(S.haversine_m(F.col("lat_origin"), F.col("lon_origin"), F.col("lat_dest"), F.col("lon_dest")) / F.lit(max_mph * S.MPH), 6)
    bounded = placed.withColumn("lower_bound_s", bound).drop("lat_origin", "lon_origin", "lat_dest", "lon_dest")
    cuts = bounded.agg(F.percentile("lower_bound_s", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_cuts")).withColumn("_one", F.lit(1))
    cut = bounded.withColumn("_one", F.lit(1)).join(F.broadcast(cuts), "_one")
    b, c = F.col("lower_bound_s"), F.col("_cuts")
    distance = F.when(b <= c[0], "short").when(b <= c[1], "medium").otherwise("long")
    return cut.withColumns({"distance_stratum": distance, "time_stratum": S.stratum_of(F.hour("depart_time"), strata)}).drop("_cuts", "_one")


def sampled_queries(endpoints: DataFrame, times: DataFrame, n: int, *, seed: int, direct: float = 0.85) -> DataFrame:
    """query_id, origin, dest, depart_time: drawn by hash, the same for the same seed.

    The first ``direct`` share have both ends of one edge (u, v); the others those of two. Of both tables the rows are numbered in
    order, and a draw is the place of a number in (0, 1) from the SHA-256 of seed, purpose and query.
    """
    e = numbered(endpoints.select("u", "v").distinct(), "u", "v", into="i")
    t = numbered(times.select("timestamp").distinct(), "timestamp", into="k")
    n_edges, n_times = e.count(), t.count()
    if not n_edges or not n_times:
        raise ValueError("queries need edges and times")

    def draw(what: str, most: int) -> Column:
        return F.floor(S.hashed_unit(F.lit(str(seed)), F.lit(what), F.col("query_id").cast("string")) * most)

    drawn = endpoints.sparkSession.range(n).withColumnRenamed("id", "query_id").withColumns({"i": draw("origin", n_edges), "j": F.when(F.col("query_id") < round(n * direct), draw("origin", n_edges)).otherwise(draw("dest", n_edges)), "k": draw("time", n_times)})
    joined = drawn.join(e.select("i", F.col("u").alias("origin")), "i").join(e.select(F.col("i").alias("j"), F.col("v").alias("dest")), "j").join(t, "k")
    return joined.select("query_id", "origin", "dest", F.col("timestamp").alias("depart_time"))


def reachable_queries(endpoints: DataFrame, times: DataFrame, edges: DataFrame, n: int, *, seed: int, tries: int = 20) -> DataFrame:
    """As :func:`sampled_queries`, of ends that differ and where the second is reached from the first.

    So many are drawn anew, by further seeds, until there are enough; an error if ``tries`` draws do not give them.
    """
    found = None
    for k in range(tries):
        drawn = cut(sampled_queries(endpoints, times, n, seed=seed + 7919 * k, direct=0.0).where("origin <> dest"))
        good = R.dijkstra(drawn, edges).where(F.col("path").isNotNull()).select((F.col("query_id") + F.lit(k * n)).alias("query_id"), "origin", "dest", "depart_time")
        found = cut(good if found is None else found.unionByName(good))
        if found.count() >= n:
            return found.orderBy("query_id").limit(n)
    raise ValueError(f"{tries} draws gave too few queries with a route")


def competitive_ratio(results: DataFrame, optimum: DataFrame) -> DataFrame:
    """results (query_id, realized_cost) with competitive_ratio against optimum (query_id, optimal_cost)."""
    return results.join(optimum, "query_id", "left").withColumn("competitive_ratio", F.when((F.col("optimal_cost") == 0) & (F.col("realized_cost") == 0), F.lit(1.0)).otherwise(F.try_divide("realized_cost", "optimal_cost")))


def ratio_vs_classical(results: DataFrame, classical: str = "astar") -> DataFrame:
    """The rows with classical_cost (of the query of the seed) and ratio_vs_classical."""
    base = results.where(F.col("method") == classical).groupBy("query_seed", "query_id").agg(F.min("realized_cost").alias("classical_cost"))
    return results.join(base, ["query_seed", "query_id"], "left").withColumn("ratio_vs_classical", S.guard_ratio(F.col("realized_cost"), F.col("classical_cost")))


def guard_rate(results: DataFrame, groups: list[str]) -> DataFrame:
    """groups, guard_rate, n: the share of rows in which the guard was invoked, nulls left out."""
    return results.groupBy(*groups).agg(F.avg(F.col("guard_invoked").cast("double")).alias("guard_rate"), F.count("guard_invoked").alias("n"))


def pareto(results: DataFrame, weight: str) -> DataFrame:
    """By weight: the means over seeds of expansions and of the competitive ratio."""
    a = stats.seed_summary(results, [weight], "node_expansions").select(weight, F.col("mean_of_seeds").alias("mean_expansions"))
    b = stats.seed_summary(results, [weight], "competitive_ratio").select(F.col(weight).alias("_w"), F.col("mean_of_seeds").alias("mean_ratio"))
    return a.join(b, a[weight].eqNullSafe(b["_w"])).drop("_w")


def robust_against(results: DataFrame, value: str, *, by_point: bool = True, robust: str = "robust_astar") -> DataFrame:
    """Pairs of the robust method's rows with those of each other method: baseline, a, b and the keys.

    By default rows pair at the same sweep point (classical methods, which have none, at every point); else at every point.
    """
    keys = ["query_seed", "query_id"]
    own = results.where(F.col("method") == robust).select(*keys, F.col("sweep_value").alias("point"), F.col(value).alias("a"))
    other = results.where(F.col("method") != robust).select(*keys, F.col("sweep_value").alias("_point"), F.col("method").alias("baseline"), F.col(value).alias("b"))
    pairs = own.join(other, keys)
    if by_point:
        pairs = pairs.where(F.col("_point").isNull() | F.col("_point").eqNullSafe(F.col("point")))
    return pairs.drop("_point")


def mean_differences(results: DataFrame, value: str, *, robust: str = "robust_astar") -> DataFrame:
    """baseline, point, n and mean_difference of the pairs of :func:`robust_against`, by sums of each side, as a query may have many rows of both.

    ``n`` counts all pairs; those without both values are left out of the mean.
    """
    keys, v = ["query_seed", "query_id"], stats.clean(value)

    def sums(rows: DataFrame, groups: list[Column], x: str) -> DataFrame:
        return rows.groupBy(*keys, *groups).agg(F.count("*").alias(f"n_{x}"), F.count(v).alias(f"k_{x}"), F.sum(v).alias(f"s_{x}"))

    own = sums(results.where(F.col("method") == robust), [F.col("sweep_value").alias("point")], "a")
    other = sums(results.where(F.col("method") != robust), [F.col("sweep_value").alias("_point"), F.col("method").alias("baseline")], "b")
    pairs = own.join(other, keys).where(F.col("_point").isNull() | F.col("_point").eqNullSafe(F.col("point")))
    k = F.col("k_a") * F.col("k_b")
    total = F.sum(F.when(k > 0, F.col("s_a") * F.col("k_b") - F.col("s_b") * F.col("k_a")))
    return pairs.groupBy("baseline", "point").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"), F.try_divide(total, F.sum(k)).alias("mean_difference"))


def headline(results: DataFrame, value: str = "competitive_ratio") -> DataFrame:
    """method, mean_of_seeds, n_seeds, ci_low, ci_high, p, p_adjusted (Holm over the baselines), reject and stars by the adjusted p."""
    per_seed = results.groupBy("method", "query_seed").agg(F.avg(stats.clean(value)).alias("m"))
    summary = stats.bootstrap(per_seed, ["method"], "m").select("method", F.col("point").alias("mean_of_seeds"), "ci_low", "ci_high", F.col("n").alias("n_seeds"))
    tests = stats.wilcoxon(robust_against(results, value), ["baseline"], "a", "b").select(F.col("baseline").alias("method"), "p").withColumn("family", F.lit(1))
    # Tests without a p are set aside: they are no tests of the family.
    adjusted = stats.holm(tests.where(F.col("p").isNotNull() & ~F.isnan("p")), ["family"], "p", order="method").select("method", "p_adjusted", "reject")
    joined = summary.join(tests.drop("family"), "method", "left").join(adjusted, "method", "left")
    return joined.withColumn("stars", S.stars(F.col("p_adjusted")))


def ablations(results: DataFrame, groups: list[str]) -> DataFrame:
    """By the groups that are not null throughout: mean ratio over seeds and guard rate."""
    present = results.agg(*[F.count(g).alias(g) for g in groups]).first()
    used = [g for g in groups if present[g]]
    a = stats.seed_summary(results, used, "competitive_ratio").select(*used, F.col("mean_of_seeds").alias("mean_ratio"), "n_seeds")
    b = guard_rate(results, used).select(*[F.col(g).alias(f"_{g}") for g in used], "guard_rate")
    same = None
    for g in used:
        same = F.col(g).eqNullSafe(F.col(f"_{g}")) if same is None else same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return a.join(b, same).drop(*[f"_{g}" for g in used])


def latency_by_size(results: DataFrame) -> DataFrame:
    """graph_size with the mean latency of each method as a column."""
    return results.groupBy("graph_size").pivot("method").agg(F.avg("latency_ms"))


def provenance(df: DataFrame, **values) -> DataFrame:
    """The rows with the values given, the versions they were made with and the time."""
    versions = json.dumps({"pyspark": pyspark.__version__, "python": platform.python_version()}, sort_keys=True)
    return df.withColumns({**{k: F.lit(v) for k, v in values.items()}, "library_versions": F.lit(versions), "run_timestamp": F.current_timestamp()})


def improvement_summary(budget_rows: DataFrame, weight_rows: DataFrame) -> DataFrame:
    """The two diagnoses in one table: mean realized cost by budget and mean competitive ratio by weight, each under its own name."""
    a = stats.seed_summary(budget_rows, ["method", "sweep_value"], "realized_cost").select(F.lit("budget").alias("part"), "method", "sweep_value", F.col("mean_of_seeds").alias("mean_realized_cost"))
    b = stats.seed_summary(weight_rows, ["method", "sweep_value"], "competitive_ratio").select(F.lit("weight").alias("part"), "method", "sweep_value", F.col("mean_of_seeds").alias("mean_competitive_ratio"))
    return a.unionByName(b, allowMissingColumns=True)
