"""Roads, sensors, readings and queries derived from the test tables, as DataFrames and as DuckDB statements.

The tables hold no roads. Suppliers stand on a grid of ten columns, an edge leads from a line's supplier to that of the order's next
line, users of events are sensors and their values speeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernway.functions import scalar as S
from fernway.operators.roads import build_edges
from fernway.operators.rounds import written

HOLIDAYS = ["2024-01-15"]
SPLITS = {"train": ("2024-01-01", "2024-01-20"), "val": ("2024-01-21", "2024-01-24"), "test": ("2024-01-25", "2024-01-30")}
STRATA = {"night": (0, 6), "morning_peak": (6, 10), "midday": (10, 16), "evening_peak": (16, 20), "evening": (20, 24)}
BUCKET_MINUTES = 60
CLASSES = ["motorway", "primary", "secondary", "tertiary", "residential", "service"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, lat, lon."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("node"),
        (F.lit(34.0) + F.floor(k / 10).cast("double") / 100).alias("lat"),
        (F.lit(-118.5) + (k % 10).cast("double") / 100).alias("lon"),
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, highway, maxspeed and lanes tags: the four nearest of the suppliers that follow one another in an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    a = lines.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_suppkey").alias("u"))
    b = lines.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("v"))
    pairs = a.join(b, ["o", "n"]).where("u <> v").select("u", "v").distinct()
    apart = F.expr("(u div 10 - v div 10) * (u div 10 - v div 10) + (u % 10 - v % 10) * (u % 10 - v % 10)")
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(apart, "v"))).where("r <= 4")
    classes = F.array(*[F.lit(c) for c in CLASSES])
    speed = (F.col("u") * 7 + F.col("v")) % 4
    lane = (F.col("u") + F.col("v") * 2) % 3
    return near.select(
        "u",
        "v",
        F.array(F.get(classes, ((F.col("u") + F.col("v")) % 6).cast("int"))).alias("highway"),
        F.when(speed == 0, F.array(F.lit("55 mph"))).when(speed == 1, F.array(F.lit("signals"), F.lit("80 km/h"))).when(speed == 2, F.array(F.lit("none"))).alias("maxspeed"),
        F.when(lane == 0, F.array(F.lit("2"))).when(lane == 1, F.array(F.lit("x"), F.lit("3"), F.lit("1.5"))).alias("lanes"),
    )


_written: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What ``make`` gives, written to the shared folder once for each application and folder of tables, and read from there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = written(make(), name)
    return _written[key]


def known(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether :func:`once` has written the table."""
    return (spark.sparkContext.applicationId, sf_dir, name) in _written


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, u, v, length_m, road_class, speed_limit_mph, lanes; built once."""
    return once(spark, sf_dir, "edges", lambda: build_edges(raw_edges(spark, sf_dir), nodes(spark, sf_dir)))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor_id, latitude, longitude: every user of events beside a node."""
    count = table(spark, sf_dir, "supplier").agg(F.count("*").alias("count"))
    users = table(spark, sf_dir, "events").select("user_id").distinct().join(F.broadcast(count))
    k = (F.col("user_id") * 7) % F.col("count")
    return users.select(
        F.concat(F.lit("s"), F.col("user_id")).alias("sensor_id"),
        (F.lit(34.0) + F.floor(k / 10).cast("double") / 100 + (F.col("user_id") % 5).cast("double") / 2000).alias("latitude"),
        (F.lit(-118.5) + (k % 10).cast("double") / 100 + (F.col("user_id") % 3).cast("double") / 2000).alias("longitude"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timestamp, sensor_id, speed_mph by hour."""
    value = F.col("value") - F.floor(F.col("value") / 60) * 60 + 5
    return (
        table(spark, sf_dir, "events")
        .groupBy(S.bucket_floor(F.col("ts"), BUCKET_MINUTES).alias("timestamp"), F.concat(F.lit("s"), F.col("user_id")).alias("sensor_id"))
        .agg(F.round(F.avg(value), 4).alias("speed_mph"))
    )


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from, to, cost: metres between a sensor and those 1, 4, 9, ... 64 places on."""
    place = sensors(spark, sf_dir).withColumn("i", F.substring("sensor_id", 2, 9).cast("long"))
    a = place.select(F.col("sensor_id").alias("from"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"), F.explode(F.array(*[F.col("i") + j * j for j in range(1, 9)])).alias("i"))
    b = place.select(F.col("sensor_id").alias("to"), F.col("latitude").alias("lb"), F.col("longitude").alias("lp"), "i")
    return a.join(b, "i").select("from", "to", F.round(S.haversine_m(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), 3).alias("cost"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, origin, dest, depart_time: one for each node."""
    count = table(spark, sf_dir, "supplier").agg(F.count("*").alias("count"))
    q = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(count))
        .select(
            q.alias("query_id"),
            ((q * 7) % F.col("count")).alias("origin"),
            ((q * 13 + 5) % F.col("count")).alias("dest"),
            (F.lit("2024-01-25 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(q % 5).cast("int"), hours=((q * 3) % 24).cast("int"))).alias("depart_time"),
        )
    )


def hav(a: str, b: str, c: str, d: str) -> str:
    """Great-circle metres in SQL."""
    return f"(12742000.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_LIMITS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.DEFAULT_MPH.items())

#: DuckDB: nodes, raw_edges and edges as common table expressions.
ROADS_SQL = f"""nodes AS (
    SELECT s_suppkey AS node, 34.0::DOUBLE + (s_suppkey // 10)::DOUBLE / 100 AS lat, -118.5::DOUBLE + (s_suppkey % 10)::DOUBLE / 100 AS lon FROM supplier
), pairs AS (
    SELECT DISTINCT a.l_suppkey AS u, b.l_suppkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE a.l_suppkey <> b.l_suppkey
), near AS (
    SELECT u, v FROM pairs QUALIFY row_number() OVER (PARTITION BY u ORDER BY (u // 10 - v // 10) * (u // 10 - v // 10) + (u % 10 - v % 10) * (u % 10 - v % 10), v) <= 4
), raw_edges AS (
    SELECT u, v, {str(CLASSES)}[((u + v) % 6 + 1)::INT] AS road_class,
        CASE (u * 7 + v) % 4 WHEN 0 THEN 55.0::DOUBLE WHEN 1 THEN 80.0::DOUBLE * 0.621371::DOUBLE END AS tagged_mph,
        CASE (u + v * 2) % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS lanes FROM near
), edges AS (
    SELECT e.u || '_' || e.v || '_0' AS edge_id, u, v, round({hav("a.lat", "a.lon", "b.lat", "b.lon")}, 3) AS length_m, road_class,
        coalesce(tagged_mph, (CASE road_class {_LIMITS} ELSE {S.OTHER_MPH} END)::DOUBLE) AS speed_limit_mph, lanes
    FROM raw_edges e JOIN nodes a ON a.node = u JOIN nodes b ON b.node = v
)"""

#: DuckDB: sensors, readings and distances.
SENSORS_SQL = f"""users AS (SELECT DISTINCT user_id, (user_id * 7) % (SELECT count(*) FROM supplier) AS k FROM events), sensors AS (
    SELECT 's' || user_id AS sensor_id, user_id, 34.0::DOUBLE + (k // 10)::DOUBLE / 100 + (user_id % 5)::DOUBLE / 2000 AS latitude,
        -118.5::DOUBLE + (k % 10)::DOUBLE / 100 + (user_id % 3)::DOUBLE / 2000 AS longitude FROM users
), readings AS (
    SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, 's' || user_id AS sensor_id, round(avg(value - floor(value / 60) * 60 + 5), 4) AS speed_mph FROM events GROUP BY ALL
), distances AS (
    SELECT a.sensor_id AS "from", b.sensor_id AS "to", round({hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")}, 3) AS cost
    FROM sensors a, generate_series(1, 8) AS g(j) JOIN sensors b ON b.user_id = a.user_id + j * j
)"""

QUERIES_SQL = """queries AS (
    SELECT i AS query_id, (i * 7) % n AS origin, (i * 13 + 5) % n AS dest,
        TIMESTAMP '2024-01-25 00:00:00' + to_days((i % 5)::INT) + to_hours((i * 3) % 24) AS depart_time
    FROM (SELECT s_suppkey AS i, (SELECT count(*) FROM supplier) AS n FROM supplier)
)"""
