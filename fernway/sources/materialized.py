"""Predicted costs kept as a table: a row for each edge and day with the day's buckets, partitioned by day and bucketed by edge.

New predictions are merged into the days that they touch; other days' files stay as they are. A look-up joins by edge alone, so that the
table is never shuffled, and reads the days asked for; rows asked of a table bucketed alike are not shuffled either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernway.operators.rounds import remove, shared_path, written_at

#: Buckets of edges.
PARTS = 64
#: Days that a look-up names one by one to the scan; more are given to it as a range.
DAYS = 1000


def _profiles(costs: DataFrame) -> DataFrame:
    """edge_id, costs (a map from time to eta_s and sigma_s) and day; of rows alike in edge and time one counts."""
    rows = costs.select("edge_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("eta_s").cast("double").alias("eta_s"), F.col("sigma_s").cast("double").alias("sigma_s"))
    one = rows.groupBy("edge_id", "timestamp").agg(F.min(F.struct("eta_s", "sigma_s")).alias("c"))
    return one.groupBy("edge_id", F.to_date("timestamp").alias("day")).agg(F.map_from_entries(F.collect_list(F.struct("timestamp", "c"))).alias("costs")).select("edge_id", "costs", "day")


def create(costs: DataFrame, name: str, path: str, parts: int = PARTS) -> None:
    """Keep the costs (edge_id, timestamp, eta_s, sigma_s) as the table ``name`` in the folder ``path``."""
    _profiles(costs).repartition(parts, "edge_id").write.partitionBy("day").bucketBy(parts, "edge_id").sortBy("edge_id").option("path", path).saveAsTable(name)


def refresh(spark: SparkSession, name: str, fresh: DataFrame) -> list:
    """Merge new costs: times told anew replace the old ones. Gives the days that were rewritten, as many as the calendar has."""
    table, part = spark.table(name), shared_path(spark, "merged")
    new = _profiles(fresh)
    days = [r["day"] for r in new.select("day").distinct().collect()]
    if not days:
        return []
    old = table.where(F.col("day").isin(days)).select("edge_id", F.col("costs").alias("_old"), "day")
    none = F.create_map().cast(dict(new.dtypes)["costs"])
    was, now = F.coalesce("_old", none), F.coalesce("costs", none)
    both = F.map_concat(F.map_filter(was, lambda k, _: ~F.map_contains_key(now, k)), now)
    merged = written_at(old.join(new, ["edge_id", "day"], "full").select("edge_id", both.alias("costs"), "day"), part)
    mode, setting = "spark.sql.sources.partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set(mode, "dynamic")  # the partitions of the rows alone are replaced
    try:
        merged.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, setting)
    remove(spark, part)
    spark.catalog.refreshTable(name)
    return sorted(days)


def look_up(asked: DataFrame, name: str, fallback: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows asked (edge_id, timestamp, ...) with eta_s and sigma_s, null where the table has none.

    ``fallback``: a predictor that adds eta_s and sigma_s to rows; it gets those that the table doesn't cover, and no others.
    """
    spark, day = asked.sparkSession, F.to_date("timestamp")
    days = [r[0] for r in asked.select(day.alias("d")).distinct().limit(DAYS + 1).collect() if r[0] is not None]
    table = spark.table(name)
    if len(days) <= DAYS:
        table = table.where(F.col("day").isin(days))
    else:
        low, high = asked.agg(F.min(day), F.max(day)).first()
        table = table.where(F.col("day").between(low, high))
    # One equal key, the edge, is what the table is bucketed by; the day is looked at in the joined rows.
    named = table.select(F.col("edge_id").alias("_edge"), "day", "costs")
    same = (F.col("edge_id") == F.col("_edge")) & (F.col("day") >= day) & (F.col("day") <= day)
    told = F.try_element_at("costs", F.col("timestamp").cast("timestamp_ntz"))
    found = asked.join(named, same, "left").withColumns({"eta_s": told["eta_s"], "sigma_s": told["sigma_s"]}).select(*asked.columns, "eta_s", "sigma_s")
    if fallback is None:
        return found
    return found.where(F.col("eta_s").isNotNull()).unionByName(fallback(found.where(F.col("eta_s").isNull()).drop("eta_s", "sigma_s")).select(*found.columns))
