"""Readings as a stream: mean speed per sensor and bucket, with late rows up to a watermark, and the edge costs made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernway.functions import scalar as S


def bucketed(readings: DataFrame, *, bucket: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """sensor_id, timestamp (the bucket's start), speed_mph and n of a stream of sensor_id, ts, speed_mph."""
    windowed = readings.withWatermark("ts", late).groupBy(F.window("ts", bucket).alias("w"), "sensor_id")
    return windowed.agg(F.avg("speed_mph").alias("speed_mph"), F.count("*").alias("n")).select("sensor_id", F.col("w.start").alias("timestamp"), "speed_mph", "n")


def edge_costs(stream: DataFrame, matches: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id, timestamp, eta_s of a stream of buckets, joined with the static tables."""
    known = matches.where("matched").join(edges.select("edge_id", "length_m"), "edge_id").select("sensor_id", "edge_id", "length_m")
    return stream.join(known, "sensor_id").select("edge_id", "timestamp", S.travel_seconds(F.col("length_m"), F.col("speed_mph")).alias("eta_s"))


def refresh(costs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the costs to Parquet files as their buckets close."""
    return costs.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
