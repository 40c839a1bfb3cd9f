"""The guard: a guided route is taken only if its realized cost is at most (1 + alpha) times the classical route's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernway.functions import scalar as S
from fernway.operators import search as R
from fernway.operators.search import Costs, Roads, folded

FLOOR_SLACK = 1e-6


def guard(rows: DataFrame, alpha: float | Column) -> DataFrame:
    """Rows (classical_cost, candidate_cost, null if there is none) with taken, realized_cost, ratio and guard_invoked.

    No classical route: nothing is taken and the guard is silent. No candidate: the classical route. The bound is inclusive. A cost
    over a classical one of nothing is an infinite ratio.
    """
    if not isinstance(alpha, Column):
        if alpha < 0:
            raise ValueError("alpha is not below 0")
        alpha = F.lit(float(alpha))
    classical, candidate = F.col("classical_cost"), F.col("candidate_cost")
    within = candidate.isNotNull() & (candidate <= (1 + alpha) * classical)
    realized = F.when(classical.isNull(), F.lit(None).cast("double")).when(within, candidate).otherwise(classical)
    return rows.withColumns(
        {
            "taken": F.when(classical.isNull(), F.lit("none")).when(within, F.lit("candidate")).otherwise(F.lit("classical")),
            "realized_cost": realized,
            "ratio": S.guard_ratio(realized, classical),
            "guard_invoked": classical.isNotNull() & ~within,
        }
    )


def check_floor(rows: DataFrame, alpha: float) -> DataFrame:
    """The rows; reading one whose ratio is above 1 + alpha fails."""
    broken = F.col("ratio") > 1 + alpha + FLOOR_SLACK
    return rows.withColumn("ratio", F.when(broken, F.raise_error(F.concat(F.lit("a guarded ratio is "), F.col("ratio").cast("string")))).otherwise(F.col("ratio")))


def effective_weight(classical: DataFrame, edges: DataFrame, predicted: DataFrame, weight: float, minutes: int) -> DataFrame:
    """query_id, weight_used: the weight over one and the mean relative doubt on the classical route's edges, each at the time at which it is
    entered by what is predicted.

    Edges without a prediction are left out, and pass in their free-flow time; with none at all the weight stays.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the weight is from 0 to 1")
    fold = F.col("fold")
    doubt = F.coalesce(F.try_divide(fold["doubt"], fold["known"]), F.lit(0.0))
    return folded(classical, edges, predicted, minutes, sigma=True).select("query_id", (F.lit(float(weight)) / (1 + doubt)).alias("weight_used"))


def effective_weights(queries: DataFrame, edges: DataFrame | Roads, predicted: DataFrame, weight: float, minutes: int) -> DataFrame:
    """As :func:`effective_weight`, of the queries' routes by free flow: many at once where the network allows it, else one by one and by a fold."""
    if not 0 <= weight <= 1:
        raise ValueError("the weight is from 0 to 1")
    roads = edges if isinstance(edges, Roads) else Roads(edges)
    found = R.mean_doubts(queries, roads, predicted, minutes)
    if found is None:
        return effective_weight(R.dijkstra(queries, roads), roads.edges, predicted, weight, minutes)
    return found.select("query_id", (F.lit(float(weight)) / (1 + F.col("doubt"))).alias("weight_used"))


def robust_routes(
    queries: DataFrame,
    edges: DataFrame | Roads,
    nodes: DataFrame | None,
    max_mph: float,
    costs: Costs,
    *,
    weight: DataFrame | None = None,
    alpha: float = 0.3,
    guarded: bool = True,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """query_id with classical and candidate costs under ``costs.real``, their paths, weight_used, work, the taken route and the verdict.

    The classical route is planned by free flow, the candidate by what is told, with the blended bound. The weight is that of
    ``weight`` (query_id, weight_used), else the queries' ``weight``, over one and the mean doubt where ``modulated``. ``keys`` are columns
    of the queries that go along.
    """
    if weight is not None:
        queries = queries.join(weight, "query_id", "left").withColumns({"weight": F.coalesce("weight_used", F.lit(0.0)), "modulated": F.lit(False)}).drop("weight_used")
    rows = R.guided(queries, edges, nodes, max_mph, costs, keys)
    if guarded:
        return check_floor(guard(rows, alpha), alpha)
    return rows.withColumns({"taken": F.lit("candidate"), "realized_cost": F.col("candidate_cost"), "ratio": S.guard_ratio(F.col("candidate_cost"), F.col("classical_cost")), "guard_invoked": F.lit(False)})
