"""Predictors of travel time: each adds ``eta_s`` and ``sigma_s`` to rows (edge_id, timestamp, length_m, ...).

A predictor covers what it has rows for; :func:`with_fallback` falls back to free flow elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernway.functions import scalar as S
from fernway.functions.statistics import percentiles

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Distance of the quantiles 0.1 and 0.9 of the standard normal distribution.
SPREAD = 2.5631031310892007
LEAST_SHARE = 1e-6


def oracle(features: DataFrame) -> DataFrame:
    """edge_id, timestamp, eta_s, sigma_s: the realized time of the bucket, and no doubt."""
    return features.select("edge_id", "timestamp", S.travel_seconds(F.col("length_m"), F.col("speed_mph")).alias("eta_s"), F.lit(0.0).alias("sigma_s"))


def adversarial(predicted: DataFrame, budget: float) -> DataFrame:
    """Times always too short by the budget, a share below one."""
    if not 0 <= budget < 1:
        raise ValueError("the budget is a share from 0 to below 1")
    return predicted.withColumns({"eta_s": F.greatest(F.col("eta_s") * (1 - budget), F.lit(S.LEAST_SECONDS)), "sigma_s": F.lit(0.0)})


def noisy(predicted: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """Times with normal noise in proportion, drawn from a hash of seed, edge and time; none for sigma 0."""
    if sigma < 0:
        raise ValueError("sigma is not below 0")
    if sigma == 0:
        return predicted.withColumn("sigma_s", F.lit(0.0))
    drawn = S.hashed_normal(F.lit(str(seed)), F.col("edge_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    return predicted.withColumns({"eta_s": F.greatest(F.col("eta_s") * (1 + F.lit(float(sigma)) * drawn), F.lit(S.LEAST_SECONDS)), "sigma_s": F.col("eta_s") * F.lit(float(sigma))})


def noisy_generated(predicted: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """As :func:`noisy`, drawn from a PCG64 generator seeded by eight bytes of the SHA-256 of the key, for each row."""
    if sigma < 0:
        raise ValueError("sigma is not below 0")

    @F.pandas_udf("double")
    def draw(digest: pd.Series) -> pd.Series:
        return digest.map(lambda h: np.random.default_rng(int(h[:16], 16)).standard_normal())

    key = F.concat_ws(":", F.lit(str(seed)), F.col("edge_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    drawn = draw(F.sha2(key.cast("binary"), 256)) if sigma else F.lit(0.0)
    return predicted.withColumns({"eta_s": F.greatest(F.col("eta_s") * (1 + F.lit(float(sigma)) * drawn), F.lit(S.LEAST_SECONDS)), "sigma_s": F.col("eta_s") * F.lit(float(sigma))})


def routing_aware(predicted: DataFrame, lured: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per query and budget: the trap's edges look fast and the corridor's slow; an edge in both is of the trap.

    ``lured``: query_id, corridor and trap as arrays of edge_id. ``budgets``: a short list, budget at least 0.
    """
    b = F.col("budget")
    told = (
        F.when(F.array_contains("trap", F.col("edge_id")), F.greatest(F.col("eta_s") / (1 + b), F.lit(S.LEAST_SECONDS)))
        .when(F.array_contains("corridor", F.col("edge_id")), F.col("eta_s") * (1 + b))
        .otherwise(F.col("eta_s"))
    )
    # The budgets of a sweep are an array of each query, not a join.
    values = [float(r["budget"]) for r in budgets.limit(1001).collect()]
    if len(values) > 1000 or min(values, default=0) < 0:
        raise ValueError("budgets are at most 1000 numbers from 0")
    swept = lured.select("query_id", "corridor", "trap", F.explode(F.array_sort(F.array(*[F.lit(v) for v in values]))).alias("budget"))
    touched = swept.select("*", F.explode(F.array_distinct(F.concat("corridor", "trap"))).alias("edge_id"))
    return touched.join(predicted, "edge_id").withColumn("told_s", told).select("query_id", "budget", "edge_id", "timestamp", "eta_s", "told_s")


def quantile_model(features: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Speed quantiles of the training rows by edge and hour, road class and hour, and over all: level, keys and q.

    The back-off levels are 0, 1 and 2. Exact percentiles; no row outside the training split is looked at.
    """
    train = features.where("split = 'train'")
    by_edge = percentiles(train, ["edge_id", "hour_of_day"], "speed_mph", quantiles).select(F.lit(0).alias("level"), F.col("edge_id").alias("place"), F.col("hour_of_day").alias("hour"), "q")
    by_class = percentiles(train, ["road_class", "hour_of_day"], "speed_mph", quantiles).select(F.lit(1).alias("level"), F.col("road_class").alias("place"), F.col("hour_of_day").alias("hour"), "q")
    overall = percentiles(train, [], "speed_mph", quantiles).select(F.lit(2).alias("level"), F.lit("*").alias("place"), F.lit(-1).alias("hour"), "q")
    return by_edge.unionByName(by_class).unionByName(overall)


def predict_quantiles(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The rows with ``q``, from the finest level that has them, each at least 1 mph."""

    def level(n: int, place: str, name: str) -> DataFrame:
        return model.where(F.col("level") == n).select(F.col("place").alias(place), F.col("hour").alias("hour_of_day"), F.col("q").alias(name))

    joined = rows.join(level(0, "edge_id", "_q0"), ["edge_id", "hour_of_day"], "left").join(level(1, "road_class", "_q1"), ["road_class", "hour_of_day"], "left")
    overall = model.where("level = 2").select(F.lit("*").alias("_all"), F.col("q").alias("_q2"))
    joined = joined.withColumn("_all", F.lit("*")).join(F.broadcast(overall), "_all", "left")
    return joined.withColumn("q", F.transform(F.coalesce("_q0", "_q1", "_q2"), lambda x: F.greatest(x, F.lit(S.LEAST_MPH)))).drop("_q0", "_q1", "_q2", "_all")


def times_and_sigma(predicted: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``eta_s`` from the median and ``sigma_s`` from the spread of the outer quantiles."""
    place = {x: i for i, x in enumerate(quantiles)}

    def seconds(x: float) -> F.Column:
        return S.travel_seconds(F.col("length_m"), F.get("q", F.lit(place[x])))

    return predicted.withColumns({"eta_s": seconds(0.5), "sigma_s": F.greatest(seconds(min(place)) - seconds(max(place)), F.lit(0.0)) / F.lit(SPREAD)})


def evaluate(predicted: DataFrame) -> DataFrame:
    """One row: MAE, RMSE and MAPE of ``eta_s`` against the realized time."""
    true = S.travel_seconds(F.col("length_m"), F.col("speed_mph"))
    error = F.col("eta_s") - true
    return predicted.agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"), F.round(F.avg(F.abs(error) / F.greatest(true, F.lit(LEAST_SHARE))) * 100, 6).alias("mape")
    )


def calibration(predicted: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """quantile, coverage: the share of rows whose speed is not above the predicted quantile."""
    rows = predicted.select("speed_mph", F.posexplode("q").alias("i", "q"))
    names = F.array(*[F.lit(float(x)) for x in quantiles])
    return rows.groupBy(F.get(names, F.col("i")).alias("quantile")).agg(F.round(F.avg((F.col("speed_mph") <= F.col("q")).cast("double")), 6).alias("coverage"), F.count("*").alias("n"))


def with_fallback(edge_times: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rows (edge_id, timestamp, free_flow_s) with ``cost_s``: the prediction where there is one, else free flow."""
    return edge_times.join(predicted.select("edge_id", "timestamp", "eta_s"), ["edge_id", "timestamp"], "left").withColumn("cost_s", F.coalesce("eta_s", "free_flow_s"))
