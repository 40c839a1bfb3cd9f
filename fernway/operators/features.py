"""The feature pipeline: sensors matched to edges, congestion of neighbours, history without leakage, calendar and split."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernway.functions import scalar as S
from fernway.operators.rounds import cut, numbered

#: Metres beyond which a match is not one, and within which sensors are neighbours; neighbours at most.
MATCH_M, NEIGHBOUR_M, NEIGHBOURS = 200.0, 3000.0, 5
_METRES_PER_DEGREE = S.RADIUS_M * 3.141592653589793 / 180
#: Places of a segment's ends; sensors of a batch, about; pairs measured at a time; metres by which arrays and columns may differ, and a rounding.
ENDS, CROWD, PAIRS, SLACK_M = ["lat_u", "lon_u", "lat_v", "lon_v"], 2000, 500_000, 0.01


def unpivot_speeds(wide: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """timestamp, sensor_id, speed_mph from one column per sensor; nulls are dropped."""
    sensors = [c for c in wide.columns if c != timestamp]
    return wide.unpivot(timestamp, sensors, "sensor_id", "speed_mph").dropna(subset=["speed_mph"])


def widened(readings: DataFrame, sensors: DataFrame, columns: int) -> tuple[DataFrame, DataFrame]:
    """The readings as tables of so many columns, one below the other, and the place of each sensor in them.

    Tables: table, timestamp and ``c0``, ``c1``, ...; places: table, place (the column's name) and sensor_id. All tables are made by one pass.
    """
    number = F.col("number")
    places = cut(numbered(sensors.select("sensor_id").distinct(), "sensor_id").select(F.floor(number / columns).cast("int").alias("table"), F.concat(F.lit("c"), number % columns).alias("place"), "sensor_id"))
    placed = readings.join(places, "sensor_id")
    return placed.groupBy("table", "timestamp").pivot("place", [f"c{k}" for k in range(columns)]).agg(F.first("speed_mph", ignorenulls=True)), places


def lengthened(wide: DataFrame, places: DataFrame) -> DataFrame:
    """timestamp, sensor_id, speed_mph of the tables made by :func:`widened`; nulls are dropped."""
    long = wide.unpivot(["table", "timestamp"], [c for c in wide.columns if c not in ("table", "timestamp")], "place", "speed_mph").dropna(subset=["speed_mph"])
    return long.join(places, ["table", "place"]).select("timestamp", "sensor_id", "speed_mph")


def match_sensors(sensors: DataFrame, edges: DataFrame, nodes: DataFrame, *, radius_m: float = 1000.0, most_m: float = MATCH_M, projected: bool = False) -> DataFrame:
    """sensor_id, edge_id, match_distance_m and matched: each sensor's nearest edge (ties: the first edge_id).

    Distances are those of a plane that touches the earth at the sensor, or, ``projected``, of the transverse Mercator projection of its zone.

    Sensors and edges meet in cells as wide as the search radius, or as edges are long on average, so that an edge lies in few of them; a
    sensor looks at those that its radius touches, so that all edges within it are seen. In a cell numpy measures batches of sensors and leaves
    of each sensor's edges those as near as the nearest, which are measured again by Spark. Sensors without an edge within the radius look again
    with four times the radius, until all have one. Those without a place have no edge and are not matched. A segment lies in the cells that it
    crosses, not in all of its bounding box.
    """
    a, b = (nodes.select(F.col("node").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}")) for x in "uv")
    segments = edges.select("edge_id", "u", "v").join(a, "u").join(b, "v")
    sensors = sensors.select("sensor_id", "latitude", "longitude")
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude")
    lost = sensors.where(~placed).select("sensor_id", F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("double").alias("match_distance_m"))
    left, found = cut(sensors.where(placed)), lost
    # Of edges between the same places the first by name counts.
    segments = cut(segments.dropna(subset=ENDS).groupBy(*ENDS).agg(F.min("edge_id").alias("edge_id")))
    widest, tall, broad = segments.agg(F.max(F.greatest(F.abs("lat_u"), F.abs("lat_v"))), F.avg(F.abs(F.col("lat_u") - F.col("lat_v"))), F.avg(F.abs(F.col("lon_u") - F.col("lon_v")))).first()
    if widest is None:
        return sensors.select("sensor_id", F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("double").alias("match_distance_m"), F.lit(False).alias("matched"))
    while True:
        # Metres of the projection and of the sphere by which cells are laid out differ by less than a hundredth.
        size = radius_m * (1.01 if projected else 1.0) / _METRES_PER_DEGREE
        wide = size / max(0.01, math.cos(math.radians(min(89.0, widest + 1))))

        times = max(1, math.ceil(max(tall / size, broad / wide)))
        cell, cell_wide = times * size, times * wide

        def cells(lat: Column, lon: Column, lat2: Column, lon2: Column, cell=cell, cell_wide=cell_wide) -> Column:
            rows = F.sequence(F.floor(F.least(lat, lat2) / cell), F.floor(F.greatest(lat, lat2) / cell))
            columns = F.sequence(F.floor(F.least(lon, lon2) / cell_wide), F.floor(F.greatest(lon, lon2) / cell_wide))
            return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: F.struct(r.alias("r"), c.alias("c")))))

        lying = F.when(*crossed(cell, cell_wide)).otherwise(cells(F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v")))
        around = cells(F.col("latitude") - size, F.col("longitude") - wide, F.col("latitude") + size, F.col("longitude") + wide)
        seen = _near(left.select("*", F.explode(around).alias("cell")), segments.select("*", F.explode(lying).alias("cell")), projected)
        apart = (S.projected_m if projected else S.planar_m)(F.col("latitude"), F.col("longitude"), *[F.col(c) for c in ENDS])
        nearest = seen.groupBy("sensor_id").agg(F.min(F.struct(F.round(apart, 3).alias("d"), "edge_id")).alias("m")).where(F.col("m.d") <= radius_m)
        new = cut(nearest.select("sensor_id", F.col("m.edge_id").alias("edge_id"), F.col("m.d").alias("match_distance_m")))
        found = found.unionByName(new)
        left = cut(left.join(new, "sensor_id", "left_anti"))
        if left.isEmpty():
            return found.withColumn("matched", F.coalesce(F.col("match_distance_m") <= most_m, F.lit(False)))
        radius_m *= 4
        if radius_m > 8 * S.RADIUS_M:
            raise RuntimeError("sensors have no edge on Earth")


def _near(sensors: DataFrame, segments: DataFrame, projected: bool) -> DataFrame:
    """Each sensor of a cell with those of the cell's segments whose distance is within ``SLACK_M`` of the least there.

    The sensors of a full cell are dealt to several batches, and a batch is measured a part at a time.
    """
    crowd = sensors.groupBy("cell").agg(F.ceil(F.count("*") / CROWD).alias("_n"))
    batch = F.pmod(F.xxhash64("sensor_id"), F.col("_n"))
    rows = sensors.join(crowd, "cell").select("sensor_id", "latitude", "longitude", F.concat_ws("/", "cell.r", "cell.c", batch).alias("batch"))
    lying = segments.join(crowd, "cell").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select("edge_id", *ENDS, F.concat_ws("/", "cell.r", "cell.c", "_k").alias("batch"))
    out = T.StructType([*rows.drop("batch").schema.fields, *lying.drop("batch").schema.fields])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        lat, lon = (left.column(c).to_numpy().astype(float) for c in ("latitude", "longitude"))
        ends = [right.column(c).to_numpy().astype(float) for c in ENDS]
        kept = [[np.zeros(0, dtype=np.int64)] * 2]
        zones = np.minimum(np.floor((lon + 180) / 6), 59) if projected else np.zeros(len(lon))
        for zone in np.unique(zones) if len(ends[0]) else ():
            which = np.flatnonzero(zones == zone)
            if projected:
                central = zone * 6 - 177
                (x, y), (ax, ay), (bx, by) = (S.mercator_numpy(a, b, central) for a, b in ((lat[which], lon[which]), (ends[0], ends[1]), (ends[2], ends[3])))
                scale = np.ones(len(which))
            else:
                (y, x, ay, ax, by, bx), scale = (v * _METRES_PER_DEGREE for v in (lat[which], lon[which], *ends)), np.cos(np.radians(lat[which]))
            some = max(1, PAIRS // len(ax))
            for low in range(0, len(which), some):
                part = slice(low, low + some)
                px, py, k = x[part, None], y[part, None], scale[part, None]
                ux, uy = (ax - px) * k, ay - py
                dx, dy = (bx - ax) * k, np.broadcast_to(by - ay, ux.shape)
                whole = dx * dx + dy * dy
                t = np.clip(-(ux * dx + uy * dy) / np.where(whole == 0, 1.0, whole), 0.0, 1.0)
                d = np.nan_to_num(np.hypot(ux + t * dx, uy + t * dy), nan=np.inf)
                i, j = np.nonzero((d <= d.min(axis=1, keepdims=True) + SLACK_M) & np.isfinite(d))
                kept.append([which[low + i], j])
        i, j = (pa.array(np.concatenate(k)) for k in zip(*kept, strict=True))
        one, other = left.select(out.names[:3]).take(i), right.select(out.names[3:]).take(j)
        return pa.table([*one.columns, *other.columns], names=out.names)

    return rows.groupBy("batch").cogroup(lying.groupBy("batch")).applyInArrow(task, out)


def crossed(size: float, wide: float) -> tuple[Column, Column]:
    """Whether a segment (lat_u, lon_u, lat_v, lon_v) is long, and the cells that it then lies in.

    It is cut into steps of at most half a cell, and each step's end has its cell and the eight around it.
    """
    steps = F.ceil(2 * F.greatest(F.abs(F.col("lat_v") - F.col("lat_u")) / size, F.abs(F.col("lon_v") - F.col("lon_u")) / wide)).cast("int")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])

    def at(k: Column) -> Column:
        part = k / steps
        row = F.floor((F.col("lat_u") + part * (F.col("lat_v") - F.col("lat_u"))) / size)
        column = F.floor((F.col("lon_u") + part * (F.col("lon_v") - F.col("lon_u"))) / wide)
        return F.transform(around, lambda x: F.struct((row + x["a"]).alias("r"), (column + x["b"]).alias("c")))

    return steps > 6, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), steps), at)))


def match_quality(matches: DataFrame) -> DataFrame:
    """One row about the matches."""
    d = F.col("match_distance_m")
    return matches.agg(F.count("*").alias("n_sensors"), F.count_if("matched").alias("n_matched"), F.round(F.avg(d), 4).alias("mean_m"), F.round(F.median(d), 4).alias("median_m"), F.round(F.percentile(d, F.lit(0.9)), 4).alias("p90_m"), F.max(d).alias("max_m"))


def top_neighbours(distances: DataFrame, sensors: DataFrame, *, radius_m: float = NEIGHBOUR_M, most: int = NEIGHBOURS) -> DataFrame:
    """from, to, cost, rank: the nearest other sensors within the radius, ties by name."""
    ends = [sensors.select(F.col("sensor_id").alias(x)).distinct() for x in ("from", "to")]
    known = distances.where((F.col("from") != F.col("to")) & (F.col("cost") <= radius_m)).join(ends[0], "from", "left_semi").join(ends[1], "to", "left_semi")
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("from").orderBy("cost", "to")))
    return ranked.where(F.col("rank") <= most).select("from", "to", "cost", "rank")


def neighbour_congestion(speeds: DataFrame, limits: DataFrame, neighbours: DataFrame) -> DataFrame:
    """timestamp, sensor_id, neighbor_congestion_proxy at every time of any reading and sensor with readings.

    The mean over neighbours of congestion one row of the common time grid earlier; null where none has it.
    """
    times = numbered(speeds.select("timestamp").distinct(), "timestamp")
    grid = times.join(times.select((F.col("number") + 1).alias("number"), F.col("timestamp").alias("before")), "number").select("timestamp", "before")
    congested = speeds.join(limits, "sensor_id").select(F.col("sensor_id").alias("to"), F.col("timestamp").alias("before"), S.congestion(F.col("speed_mph"), F.col("speed_limit_mph")).alias("c"))
    lagged = grid.join(congested, "before").select("timestamp", "to", "c")
    means = neighbours.select(F.col("from").alias("sensor_id"), "to").join(lagged, "to").groupBy("timestamp", "sensor_id").agg(F.avg("c").alias("neighbor_congestion_proxy"))
    return speeds.select("timestamp", "sensor_id").distinct().join(means, ["timestamp", "sensor_id"], "left")


def collapse(readings: DataFrame, statics: list[str]) -> DataFrame:
    """One row per edge and time: means, names and number of the sensors, and the edge's own columns."""
    return readings.groupBy("edge_id", "timestamp").agg(
        F.array_join(F.array_sort(F.collect_set("sensor_id")), ";").alias("sensor_ids"),
        F.countDistinct("sensor_id").alias("n_sensors"),
        F.avg("speed_mph").alias("speed_mph"),
        F.avg("neighbor_congestion_proxy").alias("neighbor_congestion_proxy"),
        *[F.first(c, ignorenulls=True).alias(c) for c in statics],
    )


def expanding_history(edge_speeds: DataFrame) -> DataFrame:
    """The rows with hist_mean_speed and hist_var_speed over the edge's earlier rows only."""
    before = Window.partitionBy("edge_id").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    return edge_speeds.withColumns({"hist_mean_speed": F.avg("speed_mph").over(before), "hist_var_speed": F.var_samp("speed_mph").over(before)})


def build_features(
    readings: DataFrame,
    matches: DataFrame,
    edges: DataFrame,
    neighbours: DataFrame,
    *,
    holidays: list[str],
    splits: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """The feature table of matched sensors' readings; fails when a row has no split."""
    statics = ["road_class", "length_m", "lanes", "speed_limit_mph"]
    known = matches.where("matched").select("sensor_id", "edge_id").join(edges.select("edge_id", *statics), "edge_id", "left")
    speeds = readings.dropna(subset=["speed_mph"]).join(known.select("sensor_id"), "sensor_id", "left_semi")
    proxy = neighbour_congestion(speeds, known.select("sensor_id", "speed_limit_mph"), neighbours)
    rows = collapse(speeds.join(known, "sensor_id").join(proxy, ["timestamp", "sensor_id"], "left"), statics)
    rows = expanding_history(rows).withColumns(S.day_features(F.col("timestamp"), holidays)).withColumn("split", S.split_of(F.col("timestamp"), splits))
    checked = F.when(F.col("split") == "unassigned", F.raise_error(F.concat(F.lit("no split for "), F.col("timestamp").cast("string")))).otherwise(F.col("split"))
    return rows.withColumn("split", checked).select(
        "edge_id", "sensor_ids", "n_sensors", "timestamp", "speed_mph", "hist_mean_speed", "hist_var_speed", "hour_of_day", "day_of_week", "is_holiday", "neighbor_congestion_proxy", *statics, "split"
    )


def features_quality(features: DataFrame) -> DataFrame:
    """By split: rows, edges, time span, speed and missing history."""
    return features.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("edge_id").alias("n_edges"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        F.round(F.avg("speed_mph"), 4).alias("mean_speed"),
        F.count_if(F.col("hist_mean_speed").isNull()).alias("n_no_history"),
        F.count_if(F.col("neighbor_congestion_proxy").isNull()).alias("n_no_proxy"),
        F.countDistinct(F.when(F.col("n_sensors") > 1, F.col("edge_id"))).alias("n_multi_sensor"),
    )
