"""One route on request, and the health of what it needs: plain functions for a server to call."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta

from pyspark.errors import PySparkTypeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernway.operators import guard, search


class Unprocessable(ValueError):
    """The request names an unknown node or a parameter out of range."""


class NotLoaded(RuntimeError):
    """The service has no graph or predictor."""


@dataclass
class Service:
    """What is loaded: nodes, free-flow edges, predicted costs and their bucket's minutes. The network is broadcast once for all requests."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    predicted: DataFrame | None = None
    max_mph: float = 0.0
    minutes: int = 5
    _roads: search.Roads | None = field(default=None, repr=False)

    @property
    def roads(self) -> search.Roads:
        if self._roads is None:
            self._roads = search.Roads(self.edges, self.nodes, self.predicted.agg(F.min("timestamp")).first()[0] or datetime(1970, 1, 1))
        return self._roads


@dataclass
class Route:
    path: list | None
    cost_s: float | None
    arrival: datetime | None
    weight_used: float
    classical_cost_s: float | None
    candidate_cost_s: float | None
    ratio: float | None
    guard_invoked: bool
    node_expansions: int
    latency_ms: float

    def as_dict(self) -> dict:
        return asdict(self)


def health(service: Service) -> dict:
    """Whether everything is loaded."""
    loaded = None not in (service.nodes, service.edges, service.predicted)
    return {"status": "ok" if loaded else "not loaded", "bucket_minutes": service.minutes}


def route(
    spark: SparkSession, service: Service, origin, dest, depart: datetime, *, weight: float = 1.0, alpha: float = 0.3, confidence_modulated: bool = False, judged: DataFrame | None = None
) -> Route:
    """A guarded route between nodes of whatever type the service's are.

    Routes are judged by the times ``judged``; without them by the predictor itself, and no more than consistent with it. The weight is
    divided by one and the mean doubt on the classical route if ``confidence_modulated``. ``latency_ms`` is that of both searches.
    """
    if health(service)["status"] != "ok":
        raise NotLoaded("no graph or predictor is loaded")
    if not 0 <= weight <= 1 or alpha < 0:
        raise Unprocessable("the weight is from 0 to 1 and alpha is not below 0")
    kind = service.nodes.schema["node"].dataType
    try:
        query = spark.createDataFrame([(0, origin, dest, depart)], T.StructType().add("query_id", "long").add("origin", kind).add("dest", kind).add("depart_time", "timestamp_ntz"))
    except PySparkTypeError:
        raise Unprocessable(f"nodes are of type {kind.simpleString()}") from None
    known = {r["node"] for r in service.nodes.where(F.col("node").isin([F.lit(x).cast(kind) for x in (origin, dest)])).select("node").distinct().collect()}
    if {origin, dest} - known:
        raise Unprocessable(f"unknown node: {', '.join(map(str, {origin, dest} - known))}")
    costs = search.timed_costs(service.predicted, service.minutes, service.predicted if judged is None else judged)
    asked = query.withColumns({"weight": F.lit(float(weight)), "modulated": F.lit(confidence_modulated)})
    row = guard.robust_routes(asked, service.roads, None, service.max_mph, costs, alpha=alpha).first()
    path = {"candidate": row["candidate_path"], "classical": row["classical_path"], "none": None}[row["taken"]]
    cost = row["realized_cost"]
    arrival = None if cost is None else depart + timedelta(seconds=cost)
    return Route(path, cost, arrival, row["weight_used"], row["classical_cost"], row["candidate_cost"], row["ratio"], row["guard_invoked"], row["work"], row["latency_ms"])
