"""All queries of the routing library by name, with their DuckDB counterparts over the same derived inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernway.functions import scalar as S
from fernway.functions import statistics as stats
from fernway.operators import evaluation, experiments, features, guard, predictors, regression, roads, search, trees
from fernway.operators.rounds import written
from fernway.plans import inputs as I
from fernway.plans.table_functions import register_shortest_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the statement that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


ROADS = f"WITH {I.ROADS_SQL}"
FREE = f"{ROADS}, free AS (SELECT *, length_m / (greatest(speed_limit_mph, 1.0::DOUBLE) * 0.44704::DOUBLE) AS free_flow_s FROM edges)"
MAX_MPH = 65.0


def _free(spark: SparkSession, d: str) -> DataFrame:
    return roads.free_flow(I.edges(spark, d))


def _once(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    return I.once(spark, d, name, make)


# --- roads -----------------------------------------------------------------------------------------------------------


@query(f"{FREE} SELECT edge_id, length_m, speed_limit_mph, round(free_flow_s, 6) AS free_flow_s FROM free")
def free_flow_cost(spark, d):
    return _free(spark, d).select("edge_id", "length_m", "speed_limit_mph", F.round("free_flow_s", 6).alias("free_flow_s"))


@query(f"{ROADS} SELECT edge_id, road_class, speed_limit_mph, lanes::BIGINT AS lanes FROM edges")
def road_tags(spark, d):
    return I.edges(spark, d).select("edge_id", "road_class", "speed_limit_mph", F.col("lanes").cast("long").alias("lanes"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || ' mph' WHEN 1 THEN p_size || ' km/h' WHEN 2 THEN p_size || ';40' WHEN 3 THEN ' ' || p_size || '.5 KPH ' WHEN 4 THEN 'none' ELSE '' END AS tag FROM part)
    SELECT p_partkey, tag, CASE WHEN regexp_extract(lower(trim(tag)), '(\\d+(?:\\.\\d+)?)', 1) = '' THEN NULL
    ELSE regexp_extract(lower(trim(tag)), '(\\d+(?:\\.\\d+)?)', 1)::DOUBLE * (CASE WHEN regexp_matches(lower(tag), 'km/h|kmh|kph') THEN 0.621371::DOUBLE ELSE 1 END) END AS mph FROM t""")
def parse_speed_tag(spark, d):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    tag = F.when(k == 0, F.concat(size, F.lit(" mph"))).when(k == 1, F.concat(size, F.lit(" km/h"))).when(k == 2, F.concat(size, F.lit(";40"))).when(k == 3, F.concat(F.lit(" "), size, F.lit(".5 KPH "))).when(k == 4, F.lit("none")).otherwise(F.lit(""))
    return I.table(spark, d, "part").select("p_partkey", tag.alias("tag")).withColumn("mph", S.speed_tag_mph(F.col("tag")))


@query(f"{ROADS} SELECT a.node AS node, b.node AS other, round({I.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS metres, round({I.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / (65.0 * 0.44704), 6) AS bound_s FROM nodes a JOIN nodes b ON b.node = a.node * 3 % (SELECT count(*) FROM nodes)")
def heuristic_bound(spark, d):
    n = I.nodes(spark, d)
    count = n.agg(F.count("*").alias("count"))
    a = n.join(F.broadcast(count)).select("node", "lat", "lon", (F.col("node") * 3 % F.col("count")).alias("other"))
    b = n.select(F.col("node").alias("other"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    ends = [F.col(x) for x in ("lat", "lon", "lat_b", "lon_b")]
    return a.join(b, "other").select("node", "other", F.round(S.haversine_m(*ends), 4).alias("metres"), F.round(search.lower_bound_s(*ends, F.lit(65.0)), 6).alias("bound_s"))


@query(f"""{ROADS}, o AS (SELECT u AS node, count(*) AS out_degree, string_agg(DISTINCT v::VARCHAR, ',' ORDER BY v::VARCHAR) AS neighbours FROM edges GROUP BY u),
    i AS (SELECT v AS node, count(*) AS in_degree FROM edges GROUP BY v)
    SELECT node, coalesce(out_degree, 0)::BIGINT AS out_degree, coalesce(in_degree, 0)::BIGINT AS in_degree, coalesce(neighbours, '') AS neighbours FROM o FULL JOIN i USING (node)""")
def adjacency_degree(spark, d):
    found = roads.adjacency(I.edges(spark, d))
    names = F.array_join(F.array_sort(F.transform("neighbours", lambda x: x.cast("string"))), ",")
    return found.select("node", "out_degree", "in_degree", F.coalesce(names, F.lit("")).alias("neighbours"))


@query(f"{ROADS} SELECT edge_id, v AS u, u AS v FROM edges")
def reverse_edges(spark, d):
    return roads.reverse(I.edges(spark, d)).select("edge_id", "u", "v")


@query(f"{ROADS} SELECT max(speed_limit_mph) AS max_speed_mph FROM edges")
def graph_max_speed(spark, d):
    return roads.max_speed(I.edges(spark, d))


_LEVELS = f"""WITH RECURSIVE {I.ROADS_SQL}, level(node, level) USING KEY (node) AS (
    SELECT 0::BIGINT, 0 UNION SELECT e.v, min(l.level + 1) FROM level l JOIN edges e ON e.u = l.node
    WHERE NOT EXISTS (SELECT 1 FROM recurring.level r WHERE r.node = e.v) GROUP BY e.v)"""


@query(f"{_LEVELS} SELECT node, level::BIGINT AS level FROM level")
def bfs_levels(spark, d):
    root = spark.createDataFrame([(0,)], "node long")
    return roads.breadth_first(I.edges(spark, d), root).select("node", F.col("level").cast("long").alias("level"))


@query(f"{_LEVELS}, first AS (SELECT node FROM level ORDER BY level, node LIMIT 50) SELECT edge_id, u, v FROM edges WHERE u IN (FROM first) AND v IN (FROM first)")
def induced_subgraph(spark, d):
    e = I.edges(spark, d)
    return roads.induced(e, roads.first_nodes(e, spark.createDataFrame([(0,)], "node long"), 50)).select("edge_id", "u", "v")


@query(f"""WITH RECURSIVE {I.ROADS_SQL}, reach(a, b) AS (SELECT u, v FROM edges UNION SELECT a, e.v FROM reach JOIN edges e ON e.u = b),
    sizes AS (SELECT r.a, count(DISTINCT r.b) AS n FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY r.a)
    SELECT greatest((SELECT max(n) FROM sizes), 1)::DOUBLE / count(*) AS largest_share, count(*) AS n_nodes FROM nodes""")
def scc_fraction(spark, d):
    return roads.largest_strong_share(I.edges(spark, d).select("u", "v"), I.nodes(spark, d))


# --- features --------------------------------------------------------------------------------------------------------

_K = "(6371000.0::DOUBLE * 3.141592653589793::DOUBLE / 180)"
MATCH = f"""{ROADS}, {I.SENSORS_SQL}, placed AS (
    SELECT sensor_id, edge_id, (b.lon - longitude) * cos(radians(latitude)) * {_K} AS ax, (b.lat - latitude) * {_K} AS ay,
        (c.lon - longitude) * cos(radians(latitude)) * {_K} AS bx, (c.lat - latitude) * {_K} AS by_
    FROM sensors, edges e JOIN nodes b ON b.node = e.u JOIN nodes c ON c.node = e.v
), along AS (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0))) AS t FROM placed),
apart AS (SELECT sensor_id, edge_id, round(sqrt(pow(ax + coalesce(t, 0) * (bx - ax), 2) + pow(ay + coalesce(t, 0) * (by_ - ay), 2)), 3) AS match_distance_m FROM along),
matches AS (SELECT *, match_distance_m <= 1000 AS matched FROM apart QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY match_distance_m, edge_id) = 1)"""
TOP = f"""{MATCH}, top AS (SELECT "from", "to", cost, row_number() OVER (PARTITION BY "from" ORDER BY cost, "to") AS rank FROM distances WHERE "from" <> "to" AND cost <= 30000 QUALIFY rank <= 5)"""
PROXY = f"""{TOP}, limits AS (SELECT sensor_id, speed_limit_mph FROM matches JOIN edges USING (edge_id) WHERE matched), known AS (SELECT r.*, speed_limit_mph FROM readings r JOIN limits USING (sensor_id)),
grid AS (SELECT timestamp, lag(timestamp) OVER (ORDER BY timestamp) AS before FROM (SELECT DISTINCT timestamp FROM known)),
lagged AS (SELECT g.timestamp, sensor_id, 1 - speed_mph / speed_limit_mph AS c FROM grid g JOIN known k ON k.timestamp = g.before),
means AS (SELECT l.timestamp, t."from" AS sensor_id, avg(c) AS proxy FROM top t JOIN lagged l ON l.sensor_id = t."to" GROUP BY ALL),
proxied AS (SELECT k.timestamp, k.sensor_id, proxy AS neighbor_congestion_proxy FROM known k LEFT JOIN means m ON m.timestamp = k.timestamp AND m.sensor_id = k.sensor_id)"""
COLLAPSED = f"""{PROXY}, collapsed AS (
    SELECT edge_id, r.timestamp, string_agg(DISTINCT r.sensor_id, ';' ORDER BY r.sensor_id) AS sensor_ids, count(DISTINCT r.sensor_id) AS n_sensors, avg(speed_mph) AS speed_mph,
        avg(neighbor_congestion_proxy) AS neighbor_congestion_proxy FROM known r JOIN matches m USING (sensor_id) JOIN proxied p ON p.timestamp = r.timestamp AND p.sensor_id = r.sensor_id GROUP BY ALL
), history AS (
    SELECT *, avg(speed_mph) OVER w AS hist_mean_speed, var_samp(speed_mph) OVER w AS hist_var_speed FROM collapsed
    WINDOW w AS (PARTITION BY edge_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), dated AS (
    SELECT *, hour(timestamp)::BIGINT AS hour_of_day, (isodow(timestamp) - 1)::BIGINT AS day_of_week, timestamp::DATE = DATE '2024-01-15' AS is_holiday,
        CASE WHEN timestamp::DATE <= DATE '2024-01-20' THEN 'train' WHEN timestamp::DATE <= DATE '2024-01-24' THEN 'val' ELSE 'test' END AS split
    FROM history
), features AS (SELECT d.*, road_class, length_m, lanes, speed_limit_mph FROM dated d JOIN edges USING (edge_id))"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "matches", lambda: features.match_sensors(I.sensors(spark, d), I.edges(spark, d), I.nodes(spark, d), most_m=1000.0))


def _top(spark: SparkSession, d: str) -> DataFrame:
    return features.top_neighbours(I.distances(spark, d), I.sensors(spark, d), radius_m=30000.0)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "features", lambda: features.build_features(I.readings(spark, d), _matches(spark, d), I.edges(spark, d), _top(spark, d), holidays=I.HOLIDAYS, splits=I.SPLITS))


#: Columns of a wide table of speeds.
COLUMNS = 300


@query("SELECT event_id, (date_trunc('day', ts) + to_minutes((hour(ts) * 60 + minute(ts)) // 5 * 5))::TIMESTAMP AS bucket FROM events")
def bucket_floor(spark, d):
    return I.table(spark, d, "events").select("event_id", S.bucket_floor(F.col("ts"), 5).alias("bucket"))


@query(f"WITH {I.SENSORS_SQL} SELECT timestamp, sensor_id, speed_mph FROM readings WHERE speed_mph IS NOT NULL")
def unpivot_speeds(spark, d):
    """A column for each sensor, in tables of a few hundred columns, made long again."""
    return features.lengthened(*features.widened(I.readings(spark, d), I.sensors(spark, d), COLUMNS))


@query(f"{MATCH} SELECT * FROM matches")
def sensor_nearest_edge(spark, d):
    return _matches(spark, d)


def _mercator(lat: str, lon: str) -> str:
    """Two SQL columns, x and y, of places in the zone whose central meridian is ``central``."""
    radius, e, factors = S.mercator_terms()
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians({lat}))))"
    away = f"radians({lon} - central)"
    north, east = f"atan2({t}, cos({away}))", f"atanh(sin({away}) / sqrt(1 + {t} * {t}))"
    y = " + ".join([north, *[f"{f!r}::DOUBLE * sin({2 * j} * {north}) * cosh({2 * j} * {east})" for j, f in enumerate(factors, 1)]])
    x = " + ".join([east, *[f"{f!r}::DOUBLE * cos({2 * j} * {north}) * sinh({2 * j} * {east})" for j, f in enumerate(factors, 1)]])
    scale = f"{S.ZONE_SCALE * radius!r}::DOUBLE"
    return f"{scale} * ({x}) AS x, {scale} * ({y}) AS y"


@query(f"""{ROADS}, {I.SENSORS_SQL}, zones AS (SELECT sensor_id, latitude, longitude, floor((longitude + 180) / 6) * 6 - 177 AS central FROM sensors), meridians AS (SELECT DISTINCT central FROM zones),
    own AS (SELECT sensor_id, central, {_mercator("latitude", "longitude")} FROM zones), ends AS (SELECT node, central, {_mercator("lat", "lon")} FROM nodes, meridians),
    placed AS (SELECT sensor_id, edge_id, a.x - o.x AS ax, a.y - o.y AS ay, b.x - o.x AS bx, b.y - o.y AS by_ FROM own o, edges e JOIN ends a ON a.node = e.u JOIN ends b ON b.node = e.v WHERE a.central = o.central AND b.central = o.central),
    along AS (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0))) AS t FROM placed),
    apart AS (SELECT sensor_id, edge_id, round(sqrt(pow(ax + coalesce(t, 0) * (bx - ax), 2) + pow(ay + coalesce(t, 0) * (by_ - ay), 2)), 3) AS match_distance_m FROM along)
    SELECT *, match_distance_m <= 1000 AS matched FROM apart QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY match_distance_m, edge_id) = 1""")
def sensor_nearest_edge_projected(spark, d):
    """As sensor_nearest_edge, in the metres of a map projection."""
    return features.match_sensors(I.sensors(spark, d), I.edges(spark, d), I.nodes(spark, d), most_m=1000.0, projected=True)


@query(f"""{MATCH} SELECT count(*) AS n_sensors, count(*) FILTER (matched) AS n_matched, round(avg(match_distance_m), 4) AS mean_m, round(median(match_distance_m), 4) AS median_m,
    round(quantile_cont(match_distance_m, 0.9), 4) AS p90_m, max(match_distance_m) AS max_m FROM matches""")
def sensor_match_quality(spark, d):
    return features.match_quality(_matches(spark, d))


@query(f"{TOP} SELECT * FROM top")
def neighbor_topk(spark, d):
    return _top(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(f"{PROXY} SELECT timestamp, sensor_id, round(neighbor_congestion_proxy, 6) AS neighbor_congestion_proxy FROM proxied")
def neighbor_congestion_proxy(spark, d):
    known = _matches(spark, d).where("matched").join(I.edges(spark, d), "edge_id").select("sensor_id", "speed_limit_mph")
    speeds = I.readings(spark, d).join(known.select("sensor_id"), "sensor_id", "left_semi")
    found = features.neighbour_congestion(speeds, known, _top(spark, d))
    return found.select("timestamp", "sensor_id", F.round("neighbor_congestion_proxy", 6).alias("neighbor_congestion_proxy"))


@query(f"{COLLAPSED} SELECT edge_id, timestamp, sensor_ids, n_sensors, round(speed_mph, 6) AS speed_mph FROM collapsed")
def collapse_edge_level(spark, d):
    return _features(spark, d).select("edge_id", "timestamp", "sensor_ids", "n_sensors", F.round("speed_mph", 6).alias("speed_mph"))


@query(f"{COLLAPSED} SELECT edge_id, timestamp, round(hist_mean_speed + 0.0000003, 4) AS hist_mean_speed, round(hist_var_speed + 0.0000003, 2) AS hist_var_speed FROM history")
def expanding_mean_var(spark, d):
    return _features(spark, d).select("edge_id", "timestamp", F.round(F.col("hist_mean_speed") + 0.0000003, 4).alias("hist_mean_speed"), F.round(F.col("hist_var_speed") + 0.0000003, 2).alias("hist_var_speed"))


@query("""SELECT event_id, hour(ts)::BIGINT AS hour_of_day, (isodow(ts) - 1)::BIGINT AS day_of_week, ts::DATE = DATE '2024-01-15' AS is_holiday,
    CASE WHEN ts::DATE <= DATE '2024-01-20' THEN 'train' WHEN ts::DATE <= DATE '2024-01-24' THEN 'val' WHEN ts::DATE <= DATE '2024-01-30' THEN 'test' ELSE 'unassigned' END AS split,
    CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 10 THEN 'morning_peak' WHEN hour(ts) < 16 THEN 'midday' WHEN hour(ts) < 20 THEN 'evening_peak' ELSE 'evening' END AS time_stratum FROM events""")
def calendar_and_split(spark, d):
    e = I.table(spark, d, "events")
    day = S.day_features(F.col("ts"), I.HOLIDAYS)
    longs = {k: v.cast("long") if k != "is_holiday" else v for k, v in day.items()}
    return e.withColumns({**longs, "split": S.split_of(F.col("ts"), I.SPLITS), "time_stratum": S.stratum_of(F.hour("ts"), I.STRATA)}).select("event_id", *day, "split", "time_stratum")


@query(f"""{COLLAPSED} SELECT edge_id, sensor_ids, n_sensors, timestamp, round(speed_mph, 5) AS speed_mph, round(hist_mean_speed + 0.0000003, 4) AS hist_mean_speed, round(hist_var_speed + 0.0000003, 2) AS hist_var_speed,
    hour_of_day, day_of_week, is_holiday, round(neighbor_congestion_proxy, 5) AS neighbor_congestion_proxy, road_class, length_m, lanes::BIGINT AS lanes, speed_limit_mph, split FROM features""")
def features_full(spark, d):
    rounded = {"speed_mph": F.round("speed_mph", 5), "hist_mean_speed": F.round(F.col("hist_mean_speed") + 0.0000003, 4), "hist_var_speed": F.round(F.col("hist_var_speed") + 0.0000003, 2), "neighbor_congestion_proxy": F.round("neighbor_congestion_proxy", 5)}
    return _features(spark, d).withColumns({**rounded, **{c: F.col(c).cast("long") for c in ("hour_of_day", "day_of_week", "lanes")}})


@query(f"""{COLLAPSED} SELECT split, count(*) AS n_rows, count(DISTINCT edge_id) AS n_edges, min(timestamp) AS first_time, max(timestamp) AS last_time, round(avg(speed_mph), 4) AS mean_speed,
    count(*) FILTER (hist_mean_speed IS NULL) AS n_no_history, count(*) FILTER (neighbor_congestion_proxy IS NULL) AS n_no_proxy, count(DISTINCT edge_id) FILTER (n_sensors > 1) AS n_multi_sensor FROM features GROUP BY split""")
def features_quality(spark, d):
    return features.features_quality(_features(spark, d))


# --- predictors ------------------------------------------------------------------------------------------------------

TIMES = f"{COLLAPSED}, times AS (SELECT *, length_m / (greatest(speed_mph, 1.0) * 0.44704) AS true_s FROM features)"


def _oracle(spark: SparkSession, d: str) -> DataFrame:
    return predictors.oracle(_features(spark, d))


@query(f"{TIMES} SELECT edge_id, timestamp, round(true_s, 6) AS eta_s, 0.0::DOUBLE AS sigma_s FROM times")
def oracle_eta(spark, d):
    return _oracle(spark, d).withColumn("eta_s", F.round("eta_s", 6))


@query(f"{TIMES} SELECT edge_id, timestamp, round(greatest(true_s * 0.6, 0.001), 6) AS eta_s, 0.0::DOUBLE AS sigma_s FROM times")
def adversarial_eta(spark, d):
    return predictors.adversarial(_oracle(spark, d), 0.4).withColumn("eta_s", F.round("eta_s", 6))


_UNIT = "((('0x' || substr(sha256('7|' || edge_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '|{0}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


@query(f"""{TIMES}, drawn AS (SELECT *, sqrt(-2 * ln({_UNIT.format('u')})) * cos(6.283185307179586 * {_UNIT.format('v')}) AS z FROM times)
    SELECT edge_id, timestamp, round(greatest(true_s * (1 + 0.5 * z), 0.001), 4) AS eta_s, round(true_s * 0.5, 6) AS sigma_s FROM drawn""")
def hash_noise_eta(spark, d):
    return predictors.noisy(_oracle(spark, d), 0.5, seed=7).withColumns({"eta_s": F.round("eta_s", 4), "sigma_s": F.round("sigma_s", 6)})


@query()
def generated_noise_eta(spark, d):
    return predictors.noisy_generated(_oracle(spark, d), 0.5, seed=7)


@query(f"""{TIMES}, hours AS (SELECT DISTINCT timestamp FROM features WHERE split = 'test'), asked AS (SELECT e.edge_id, h.timestamp, length_m / (greatest(speed_limit_mph, 1.0) * 0.44704) AS free_flow_s FROM edges e, hours h)
    SELECT a.edge_id, a.timestamp, round(coalesce(true_s, free_flow_s), 6) AS cost_s, true_s IS NOT NULL AS covered FROM asked a LEFT JOIN times t ON t.edge_id = a.edge_id AND t.timestamp = a.timestamp""")
def coverage_fallback_cost(spark, d):
    f = _features(spark, d)
    # One row: the hours of the test days, as many as the calendar has.
    hours = f.where("split = 'test'").agg(F.collect_set("timestamp").alias("hours")).withColumn("_one", F.lit(1))
    asked = _free(spark, d).withColumn("_one", F.lit(1)).join(F.broadcast(hours), "_one").select("edge_id", "free_flow_s", F.explode("hours").alias("timestamp"))
    found = predictors.with_fallback(asked, predictors.oracle(f))
    return found.select("edge_id", "timestamp", F.round("cost_s", 6).alias("cost_s"), F.col("eta_s").isNotNull().alias("covered"))


_Q = "[0.1, 0.25, 0.5, 0.75, 0.9]"
MODEL = f"""{TIMES}, train AS (SELECT * FROM features WHERE split = 'train'), q0 AS (SELECT edge_id, hour_of_day, quantile_cont(speed_mph, {_Q}) AS q FROM train GROUP BY ALL),
q1 AS (SELECT road_class, hour_of_day, quantile_cont(speed_mph, {_Q}) AS q FROM train GROUP BY ALL), q2 AS (SELECT quantile_cont(speed_mph, {_Q}) AS q FROM train),
predicted AS (SELECT t.*, list_transform(coalesce(q0.q, q1.q, q2.q), lambda x: greatest(x, 1.0)) AS q FROM times t LEFT JOIN q0 ON q0.edge_id = t.edge_id AND q0.hour_of_day = t.hour_of_day
    LEFT JOIN q1 ON q1.road_class = t.road_class AND q1.hour_of_day = t.hour_of_day CROSS JOIN q2 WHERE split = 'test'),
timed AS (SELECT *, length_m / (q[3] * 0.44704) AS eta_s, greatest(length_m / (q[1] * 0.44704) - length_m / (q[5] * 0.44704), 0) / 2.5631031310892007 AS sigma_s FROM predicted)"""


def _quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "quantile-model", lambda: predictors.quantile_model(_features(spark, d)))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return predictors.times_and_sigma(predictors.predict_quantiles(_features(spark, d).where("split = 'test'"), _quantiles(spark, d)))


@query(f"{MODEL} SELECT edge_id, timestamp, round(eta_s, 5) AS eta_s, round(sigma_s, 5) AS sigma_s FROM timed")
def quantile_sigma(spark, d):
    return _predicted(spark, d).select("edge_id", "timestamp", F.round("eta_s", 5).alias("eta_s"), F.round("sigma_s", 5).alias("sigma_s"))


@query(f"""{MODEL} SELECT count(*) AS n, round(avg(abs(eta_s - true_s)), 4) AS mae, round(sqrt(avg((eta_s - true_s) * (eta_s - true_s))), 4) AS rmse,
    round(avg(abs(eta_s - true_s) / greatest(true_s, 0.000001)) * 100, 4) AS mape FROM timed""")
def predictor_eval(spark, d):
    found = predictors.evaluate(_predicted(spark, d))
    return found.select("n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape")])


@query(f"""{MODEL}, flat AS (SELECT speed_mph, unnest({_Q})::DOUBLE AS quantile, unnest(q) AS q FROM predicted)
    SELECT quantile, round(avg((round(speed_mph, 9) <= round(q, 9))::INT), 6) AS coverage, count(*) AS n FROM flat GROUP BY quantile""")
def calibration(spark, d):
    rows = _predicted(spark, d).withColumns({"speed_mph": F.round("speed_mph", 9), "q": F.transform("q", lambda x: F.round(x, 9))})
    return predictors.calibration(rows)


@query(f"""{MODEL}, hourly AS (SELECT edge_id, road_class, length_m, h FROM edges, range(24) r(h))
    SELECT p.edge_id, h::BIGINT AS hour_of_day, round(length_m / (list_transform(coalesce(q0.q, q1.q, q2.q), lambda x: greatest(x, 1.0))[3] * 0.44704), 5) AS eta_s
    FROM hourly p LEFT JOIN q0 ON q0.edge_id = p.edge_id AND q0.hour_of_day = h LEFT JOIN q1 ON q1.road_class = p.road_class AND q1.hour_of_day = h CROSS JOIN q2""")
def materialized_edge_cost(spark, d):
    rows = I.edges(spark, d).withColumn("hour_of_day", F.explode(F.sequence(F.lit(0), F.lit(23))))
    found = predictors.times_and_sigma(predictors.predict_quantiles(rows, _quantiles(spark, d)))
    return found.select("edge_id", F.col("hour_of_day").cast("long").alias("hour_of_day"), F.round("eta_s", 5).alias("eta_s"))


# --- search ----------------------------------------------------------------------------------------------------------

DIST = f"""WITH RECURSIVE {I.ROADS_SQL}, {I.QUERIES_SQL}, free AS (SELECT *, length_m / (greatest(speed_limit_mph, 1.0::DOUBLE) * 0.44704::DOUBLE) AS free_flow_s FROM edges),
dist(query_id, node, cost) USING KEY (query_id, node) AS (
    SELECT query_id, origin, 0.0::DOUBLE FROM queries
    UNION SELECT l.query_id, e.v, min(l.cost + e.free_flow_s) FROM dist l JOIN free e ON e.u = l.node LEFT JOIN recurring.dist r ON r.query_id = l.query_id AND r.node = e.v
    WHERE r.cost IS NULL OR l.cost + e.free_flow_s < r.cost GROUP BY l.query_id, e.v)"""
ROUTED = f"{DIST} SELECT q.query_id, origin, dest, round(cost, 6) AS cost FROM queries q LEFT JOIN dist d ON d.query_id = q.query_id AND d.node = dest"


def _costs_of(found: DataFrame) -> DataFrame:
    return found.select("query_id", "origin", "dest", F.round("cost", 6).alias("cost"))


@query(f"{DIST} SELECT query_id, node, round(cost, 6) AS cost FROM dist")
def sssp_static(spark, d):
    return search.distances(I.queries(spark, d), _free(spark, d)).select("query_id", "node", F.round("cost", 6).alias("cost"))


@query(ROUTED)
def dijkstra_cost(spark, d):
    return _costs_of(search.route_costs(I.queries(spark, d), _free(spark, d)))


@query(ROUTED)
def astar_cost(spark, d):
    return _costs_of(search.route_costs(I.queries(spark, d), _free(spark, d), I.nodes(spark, d), 65.0))


@query(ROUTED)
def bidirectional_cost(spark, d):
    return _costs_of(search.route_costs(I.queries(spark, d), _free(spark, d), both_ends=True))


@query(ROUTED)
def shortest_path_function(spark, d):
    """The routes by SQL alone, with a function in FROM."""
    register_shortest_path(spark, search.Roads(_free(spark, d)), asked=I.queries(spark, d))
    # A small file is one task, in which all searches would be made.
    I.queries(spark, d).repartition(search.DEALT * spark.sparkContext.defaultParallelism).createOrReplaceTempView("fernway_queries")
    return spark.sql("SELECT query_id, origin, dest, round(cost, 6) AS cost FROM fernway_queries, LATERAL shortest_path(origin, dest)")


@query(f"""{DIST}, goals AS (SELECT q.query_id, dest, coalesce(cost, 'infinity'::DOUBLE) AS goal FROM queries q LEFT JOIN dist d ON d.query_id = q.query_id AND d.node = dest)
    SELECT g.query_id, count(*) FILTER (cost < goal OR cost = goal AND d.node::VARCHAR <= dest::VARCHAR) AS dijkstra_work,
        count(*) FILTER (cost + h < goal OR cost + h = goal AND d.node::VARCHAR <= dest::VARCHAR) AS astar_work
    FROM goals g JOIN dist d ON d.query_id = g.query_id JOIN nodes n ON n.node = d.node JOIN nodes m ON m.node = g.dest,
        LATERAL (SELECT {I.hav("n.lat", "n.lon", "m.lat", "m.lon")} / (66.0::DOUBLE * 0.44704::DOUBLE) AS h) GROUP BY g.query_id""")
def search_effort(spark, d):
    # A little above the largest limit: lengths are rounded, and a bound that is too high by that settles another number of nodes.
    return search.efforts(I.queries(spark, d), _free(spark, d), I.nodes(spark, d), 66.0)


_AT = "date_trunc('hour', {0} + to_microseconds(floor({1} * 1000000)::BIGINT))"


def _seek(name: str, bound: str, told: str | None, *, asks: str = "queries", bounds: str = "bounds", bent=None) -> str:
    """The search in order of cost and bound as keyed recursion: a round settles the next node of every query and follows its edges.

    ``bound`` is a column of ``bounds``; ``told`` a table of seconds, null for free flow; ``bent`` what a query is told instead, by its time
    of departure and what it has spent. Then the edges of the routes, counted from their ends.
    """
    eta = bent("q.depart_time", "n.cost") if bent else "t.eta"
    cost, timed = ("e.free_flow_s", "") if told is None else (f"coalesce({eta}, e.free_flow_s)", f"LEFT JOIN {told} t ON t.edge_id = e.edge_id AND t.timestamp = {_AT.format('q.depart_time', 'n.cost')}")
    return f"""{name}(query_id, node, cost, rank, came, done) USING KEY (query_id, node) AS (
    SELECT q.query_id, q.origin, 0.0::DOUBLE, b.{bound}, NULL::VARCHAR, FALSE FROM {asks} q JOIN {bounds} b ON b.query_id = q.query_id AND b.node = q.origin
    UNION (WITH ended AS (SELECT s.query_id FROM recurring.{name} s JOIN {asks} q ON q.query_id = s.query_id AND q.dest = s.node WHERE s.done),
        next AS (SELECT * FROM recurring.{name} WHERE NOT done AND query_id NOT IN (FROM ended) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, node::VARCHAR) = 1),
        tried AS (SELECT n.query_id, e.v AS node, n.cost + {cost} AS cost, e.edge_id FROM next n JOIN {asks} q ON q.query_id = n.query_id JOIN free e ON e.u = n.node {timed} WHERE n.node <> q.dest)
        SELECT query_id, node, cost, rank, came, TRUE FROM next UNION ALL
        SELECT t.query_id, t.node, t.cost, t.cost + b.{bound}, t.edge_id, FALSE FROM tried t JOIN {bounds} b ON b.query_id = t.query_id AND b.node = t.node
        LEFT JOIN recurring.{name} r ON r.query_id = t.query_id AND r.node = t.node WHERE r.cost IS NULL OR NOT r.done AND t.cost < r.cost)
), {name}_back(query_id, node, edge_id, far) AS (
    SELECT q.query_id, e.u, e.edge_id, 0 FROM {asks} q JOIN {name} s ON s.query_id = q.query_id AND s.node = q.dest JOIN free e ON e.edge_id = s.came UNION ALL
    SELECT k.query_id, e.u, e.edge_id, far + 1 FROM {name}_back k JOIN {name} s ON s.query_id = k.query_id AND s.node = k.node JOIN free e ON e.edge_id = s.came)"""


def _walked(name: str, told: str, *, asks: str = "queries") -> str:
    """What each route of :func:`_seek` costs by time, null for none, its hops and how many nodes were settled."""
    return f"""{name}_steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far DESC) AS k FROM {name}_back), {name}_walk(query_id, k, spent) AS (
    SELECT query_id, 0, 0.0::DOUBLE FROM {asks} UNION ALL
    SELECT w.query_id, s.k, spent + coalesce(t.eta, e.free_flow_s) FROM {name}_walk w JOIN {asks} q ON q.query_id = w.query_id JOIN {name}_steps s ON s.query_id = w.query_id AND s.k = w.k + 1
    JOIN free e ON e.edge_id = s.edge_id LEFT JOIN {told} t ON t.edge_id = s.edge_id AND t.timestamp = {_AT.format('q.depart_time', 'w.spent')}
), {name}_work AS (SELECT query_id, count(*) FILTER (done) AS work FROM {name} GROUP BY query_id), {name}_cost AS (
    SELECT q.query_id, any_value(s.cost) AS cost, CASE WHEN any_value(s.node) IS NOT NULL THEN max(spent) END AS true_cost, CASE WHEN any_value(s.node) IS NOT NULL THEN max(k) END AS hops, any_value(work) AS work
    FROM {asks} q JOIN {name}_walk w ON w.query_id = q.query_id JOIN {name}_work o ON o.query_id = q.query_id LEFT JOIN {name} s ON s.query_id = q.query_id AND s.node = q.dest GROUP BY q.query_id)"""


def _sought(asks: str, name: str = "queries") -> str:
    """The network, the real times and the bound of every node to the destination of every query."""
    return f"""{TIMES.replace("WITH", "WITH RECURSIVE", 1)}, {asks}, free AS MATERIALIZED (SELECT *, length_m / (greatest(speed_limit_mph, 1.0::DOUBLE) * 0.44704::DOUBLE) AS free_flow_s FROM edges),
    really AS MATERIALIZED (SELECT edge_id, timestamp, true_s AS eta FROM times), placed_nodes AS (SELECT node, radians(lat) AS la, radians(lon) AS lo FROM nodes),
    lines AS MATERIALIZED (SELECT query_id, n.node, 0.0::DOUBLE AS nothing, 12742000.0::DOUBLE * asin(sqrt(least(pow(sin((m.la - n.la) / 2), 2) + cos(m.la) * cos(n.la) * pow(sin((m.lo - n.lo) / 2), 2), 1.0))) / (65.0::DOUBLE * 0.44704::DOUBLE) AS line
        FROM {name} q JOIN placed_nodes m ON m.node = q.dest, placed_nodes n)"""


SOUGHT = _sought(I.QUERIES_SQL)


@query(f"""{SOUGHT}, told AS MATERIALIZED (SELECT edge_id, timestamp, greatest(eta * (1 - 0.4::DOUBLE), 0.001) AS eta FROM really),
    {_seek("found", "line", "told", bounds="lines")}, {_walked("found", "really")}, via AS (SELECT query_id, string_agg(node::VARCHAR, ',' ORDER BY far DESC) AS nodes FROM found_back GROUP BY query_id)
    SELECT q.query_id, round(cost, 6) AS cost, round(true_cost, 6) AS true_cost, hops, CASE WHEN cost IS NOT NULL THEN concat_ws(',', nodes, dest) END AS path, work
    FROM queries q JOIN found_cost c ON c.query_id = q.query_id LEFT JOIN via ON via.query_id = q.query_id""")
def pure_ml_cost(spark, d):
    real = _oracle(spark, d)
    found = search.astar(I.queries(spark, d), _free(spark, d), I.nodes(spark, d), 65.0, search.timed_costs(predictors.adversarial(real, 0.4), I.BUCKET_MINUTES, real))
    return found.select("query_id", F.round("cost", 6).alias("cost"), F.round("true_cost", 6).alias("true_cost"), "hops", F.array_join("path", ",").alias("path"), "work")


@query(f"""{FREE}, paths AS (SELECT '' AS query_id, [0, 1, 2] AS path UNION ALL SELECT a.u || '_' || a.v || '_' || b.v, [a.u, a.v, b.v] FROM edges a JOIN edges b ON b.u = a.v),
    steps AS (SELECT query_id, unnest(range(1, len(path))) AS i, path FROM paths)
    SELECT p.query_id, (i - 1)::BIGINT AS pos, path[i] AS u, path[i + 1] AS v, edge_id, round(free_flow_s, 6) AS cost FROM steps p LEFT JOIN free e ON e.u = path[i] AND e.v = path[i + 1]""")
def path_edges(spark, d):
    found = search.path_edges(_two_hops(spark, d), _free(spark, d))
    return found.select("query_id", F.col("pos").cast("long").alias("pos"), "u", "v", "edge_id", F.round("cost", 6).alias("cost"))


def _two_hops(spark: SparkSession, d: str) -> DataFrame:
    e = I.edges(spark, d)
    two = e.select("u", F.col("v").alias("m")).join(e.select(F.col("u").alias("m"), F.col("v").alias("w")), "m")
    paths = two.select(F.concat_ws("_", "u", "m", "w").alias("query_id"), F.array("u", "m", "w").alias("path"))
    return paths.unionByName(spark.createDataFrame([("", [0, 1, 2])], "query_id string, path array<long>"))


@query(f"""{FREE}, paths AS (SELECT '' AS query_id, [0, 1, 2] AS path UNION ALL SELECT a.u || '_' || a.v || '_' || b.v, [a.u, a.v, b.v] FROM edges a JOIN edges b ON b.u = a.v),
    steps AS (SELECT query_id, unnest(range(1, len(path))) AS i, path FROM paths), costs AS (SELECT query_id, free_flow_s FROM steps p LEFT JOIN free e ON e.u = path[i] AND e.v = path[i + 1])
    SELECT query_id, CASE WHEN count(*) = count(free_flow_s) THEN round(sum(free_flow_s), 5) END AS realized FROM costs GROUP BY query_id""")
def path_realized_cost_static(spark, d):
    found = search.realized_static(_two_hops(spark, d), _free(spark, d))
    return found.select("query_id", F.round(F.nullif("realized", F.lit(float("inf"))), 5).alias("realized"))


#: Hops of the walks whose costs are asked for.
WALK = 12


@query(f"""{TIMES.replace("WITH", "WITH RECURSIVE", 1)}, following AS (SELECT u, min(v) AS v FROM edges GROUP BY u), {I.QUERIES_SQL},
    free AS (SELECT *, length_m / (greatest(speed_limit_mph, 1.0::DOUBLE) * 0.44704::DOUBLE) AS free_flow_s FROM edges),
    walk(query_id, node, depart_time, spent, hops) AS (
        SELECT query_id, origin, depart_time, 0.0::DOUBLE, 0 FROM queries UNION ALL
        SELECT w.query_id, f.v, w.depart_time, w.spent + coalesce(t.true_s, e.free_flow_s), hops + 1 FROM walk w JOIN following f ON f.u = w.node JOIN free e ON e.u = f.u AND e.v = f.v
        LEFT JOIN times t ON t.edge_id = e.edge_id AND t.timestamp = date_trunc('hour', w.depart_time + to_microseconds(floor(w.spent * 1000000)::BIGINT)) WHERE hops < {WALK})
    SELECT query_id, max(hops)::BIGINT AS hops, round(max(spent), 4) AS realized FROM walk GROUP BY query_id""")
def path_realized_cost_timed(spark, d):
    e, q = _free(spark, d), I.queries(spark, d)
    after = e.groupBy(F.col("u").alias("_at")).agg(F.min("v").alias("_next"))
    walks = q.select("query_id", "depart_time", F.array("origin").alias("path"))
    for _ in range(WALK):
        walks = walks.withColumn("_at", F.element_at("path", -1)).join(after, "_at", "left").select("query_id", "depart_time", F.when(F.col("_next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("_next"))).alias("path"))
    found = search.folded(walks, e, _oracle(spark, d), I.BUCKET_MINUTES)
    return found.select("query_id", (F.size("path") - 1).cast("long").alias("hops"), F.round("fold.spent", 4).alias("realized"))


@query("""WITH g AS (SELECT o_orderkey AS id, (o_orderkey % 7)::DOUBLE / 10 AS alpha, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 0 ELSE round(o_totalprice, 2) END AS c,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 13 = 0 AND o_orderkey % 2 = 0 THEN 0 ELSE round(o_totalprice, 2) * (1 + (o_orderkey % 10)::DOUBLE / 10) END AS x FROM orders),
    v AS (SELECT *, coalesce(x <= (1 + alpha) * c, FALSE) AS ok FROM g), r AS (SELECT *, CASE WHEN c IS NULL THEN NULL WHEN ok THEN x ELSE c END AS y FROM v)
    SELECT id, CASE WHEN c IS NULL THEN 'none' WHEN ok THEN 'candidate' ELSE 'classical' END AS taken, round(y, 4) AS realized_cost,
        round(CASE WHEN c = 0 AND y = 0 THEN 1 WHEN c = 0 AND y > 0 THEN 'infinity'::DOUBLE ELSE y / c END, 6) AS ratio, c IS NOT NULL AND NOT ok AS guard_invoked FROM r""")
def guard_apply(spark, d):
    k, price = F.col("o_orderkey"), F.round("o_totalprice", 2)
    rows = I.table(spark, d, "orders").select(
        k.alias("id"),
        ((k % 7).cast("double") / 10).alias("alpha"),
        F.when(k % 11 == 0, None).when(k % 13 == 0, F.lit(0.0)).otherwise(price).alias("classical_cost"),
        F.when(k % 5 == 0, None).when((k % 13 == 0) & (k % 2 == 0), F.lit(0.0)).otherwise(price * (1 + (k % 10).cast("double") / 10)).alias("candidate_cost"),
    )
    found = guard.guard(rows, F.col("alpha"))
    return found.select("id", "taken", F.round("realized_cost", 4).alias("realized_cost"), F.round("ratio", 6).alias("ratio"), "guard_invoked")


def _robust(spark: SparkSession, d: str, told: DataFrame, weight: float, guarded: bool = True) -> DataFrame:
    q = I.queries(spark, d).withColumns({"weight": F.lit(weight), "modulated": F.lit(True)})
    costs = search.timed_costs(told, I.BUCKET_MINUTES, _oracle(spark, d))
    return guard.robust_routes(q, _free(spark, d), I.nodes(spark, d), 65.0, costs, alpha=0.3, guarded=guarded)


#: The routes of DIST from their ends: of several nodes before one the first that is settled.
BACK = """before AS (
    SELECT d.query_id, d.node, e.u, e.edge_id FROM dist d JOIN free e ON e.v = d.node JOIN dist p ON p.query_id = d.query_id AND p.node = e.u AND p.cost + e.free_flow_s = d.cost
    QUALIFY row_number() OVER (PARTITION BY d.query_id, d.node ORDER BY p.cost, e.u::VARCHAR, e.edge_id) = 1
), back(query_id, node, edge_id, far) AS (
    SELECT q.query_id, b.u, b.edge_id, 0 FROM queries q JOIN before b ON b.query_id = q.query_id AND b.node = q.dest WHERE origin <> dest UNION ALL
    SELECT k.query_id, b.u, b.edge_id, far + 1 FROM back k JOIN queries q USING (query_id) JOIN before b ON b.query_id = k.query_id AND b.node = k.node WHERE k.node <> q.origin
)"""


@query(f"""{DIST}, {BACK}, {TIMES.split("WITH ", 1)[1].split(I.ROADS_SQL + ", ", 1)[1]}, drawn AS (SELECT edge_id, timestamp, true_s, sqrt(-2 * ln({_UNIT.format('u')})) * cos(6.283185307179586 * {_UNIT.format('v')}) AS z FROM times),
    told AS (SELECT edge_id, timestamp, greatest(true_s * (1 + 0.5 * z), 0.001) AS eta, true_s * 0.5 AS sigma FROM drawn),
    steps AS (SELECT query_id, edge_id, row_number() OVER (PARTITION BY query_id ORDER BY far DESC) AS k FROM back),
    walked(query_id, k, spent, doubt, n) AS (
        SELECT query_id, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM queries UNION ALL
        SELECT w.query_id, s.k, spent + coalesce(t.eta, e.free_flow_s), doubt + coalesce(t.sigma / greatest(t.eta, 0.000001), 0), n + (t.eta IS NOT NULL)::INT
        FROM walked w JOIN queries q USING (query_id) JOIN steps s ON s.query_id = w.query_id AND s.k = w.k + 1 JOIN free e ON e.edge_id = s.edge_id
        LEFT JOIN told t ON t.edge_id = s.edge_id AND t.timestamp = date_trunc('hour', q.depart_time + to_microseconds(floor(w.spent * 1000000)::BIGINT)))
    SELECT query_id, round(0.8 / (1 + coalesce(doubt / nullif(n, 0), 0)), 6) AS weight_used FROM walked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1""")
def lambda_effective(spark, d):
    told = predictors.noisy(_oracle(spark, d), 0.5, seed=7)
    found = guard.effective_weights(I.queries(spark, d), _free(spark, d), told, 0.8, I.BUCKET_MINUTES)
    return found.select("query_id", F.round("weight_used", 6).alias("weight_used"))


#: What is learned to be left to the destination at departure, told by {0} as {1} and followed up to three times the bound's reach, and the bound between both by the weight {2}.
LEARNED = """frozen AS MATERIALIZED (SELECT q.query_id, e.u, e.v, coalesce({1}, e.free_flow_s) AS step FROM queries q, free e LEFT JOIN {0} t ON t.edge_id = e.edge_id AND t.timestamp = date_trunc('hour', q.depart_time)),
    reach AS MATERIALIZED (SELECT q.query_id, 3.0::DOUBLE * l.line AS most FROM queries q JOIN lines l ON l.query_id = q.query_id AND l.node = q.origin),
    to_go(query_id, node, cost) USING KEY (query_id, node) AS (
        SELECT query_id, dest, 0.0::DOUBLE FROM queries
        UNION SELECT l.query_id, f.u, min(l.cost + f.step) FROM to_go l JOIN reach a ON a.query_id = l.query_id JOIN frozen f ON f.query_id = l.query_id AND f.v = l.node LEFT JOIN recurring.to_go r ON r.query_id = l.query_id AND r.node = f.u
        WHERE l.cost <= most AND (r.cost IS NULL OR l.cost + f.step < r.cost) GROUP BY l.query_id, f.u),
    bounds AS MATERIALIZED (SELECT l.query_id, l.node, line, line + {2} * (coalesce(cost, line) - line) AS blend FROM lines l JOIN queries q ON q.query_id = l.query_id LEFT JOIN to_go g ON g.query_id = l.query_id AND g.node = l.node)"""

GUARDED = """verdict AS (SELECT q.query_id, c.true_cost AS c, x.true_cost AS x, coalesce(x.true_cost <= (1 + 0.3::DOUBLE) * c.true_cost, FALSE) AS ok, x.work
        FROM queries q JOIN classical_cost c ON c.query_id = q.query_id JOIN candidate_cost x ON x.query_id = q.query_id)
    SELECT query_id, round(c, 6) AS classical_cost, round(x, 6) AS candidate_cost, CASE WHEN c IS NULL THEN 'none' WHEN ok THEN 'candidate' ELSE 'classical' END AS taken,
        round(CASE WHEN c IS NOT NULL THEN CASE WHEN ok THEN x ELSE c END END, 6) AS realized_cost,
        round(CASE WHEN c = 0 AND (NOT ok OR x = 0) THEN 1 WHEN c = 0 THEN 'infinity'::DOUBLE WHEN ok THEN x / c ELSE c / c END, 6) AS ratio, c IS NOT NULL AND NOT ok AS guard_invoked, work FROM verdict"""


@query(f"""{SOUGHT}, told AS MATERIALIZED (SELECT edge_id, timestamp, greatest(eta * (1 - 0.95::DOUBLE), 0.001) AS eta FROM really), {LEARNED.format("told", "t.eta", "1.0")},
    {_seek("classical", "line", None, bounds="lines")}, {_walked("classical", "really")}, {_seek("candidate", "blend", "told")}, {_walked("candidate", "really")}, {GUARDED}""")
def robust_route(spark, d):
    found = _robust(spark, d, predictors.adversarial(_oracle(spark, d), 0.95), 1.0)
    rounded = [F.round(c, 6).alias(c) for c in ("classical_cost", "candidate_cost", "realized_cost", "ratio")]
    return found.select("query_id", *rounded, "taken", "guard_invoked", "work")


@query(f"""{DIST}, {BACK}, corridor AS (SELECT DISTINCT query_id, edge_id FROM back),
    other(query_id, node, cost) USING KEY (query_id, node) AS (
        SELECT query_id, origin, 0.0::DOUBLE FROM queries
        UNION SELECT l.query_id, e.v, min(l.cost + CASE WHEN c.edge_id IS NULL THEN e.free_flow_s ELSE 10000000.0 END) FROM other l JOIN free e ON e.u = l.node
        LEFT JOIN corridor c ON c.query_id = l.query_id AND c.edge_id = e.edge_id LEFT JOIN recurring.other r ON r.query_id = l.query_id AND r.node = e.v
        WHERE r.cost IS NULL OR l.cost + CASE WHEN c.edge_id IS NULL THEN e.free_flow_s ELSE 10000000.0 END < r.cost GROUP BY l.query_id, e.v),
    previous AS (
        SELECT d.query_id, d.node, e.u, e.edge_id FROM other d JOIN free e ON e.v = d.node LEFT JOIN corridor c ON c.query_id = d.query_id AND c.edge_id = e.edge_id
        JOIN other p ON p.query_id = d.query_id AND p.node = e.u AND p.cost + CASE WHEN c.edge_id IS NULL THEN e.free_flow_s ELSE 10000000.0 END = d.cost
        QUALIFY row_number() OVER (PARTITION BY d.query_id, d.node ORDER BY p.cost, e.u::VARCHAR, e.edge_id) = 1),
    away(query_id, node, edge_id) AS (
        SELECT q.query_id, b.u, b.edge_id FROM queries q JOIN previous b ON b.query_id = q.query_id AND b.node = q.dest WHERE origin <> dest UNION ALL
        SELECT k.query_id, b.u, b.edge_id FROM away k JOIN queries q USING (query_id) JOIN previous b ON b.query_id = k.query_id AND b.node = k.node WHERE k.node <> q.origin)
    SELECT query_id, coalesce((SELECT string_agg(edge_id, ',' ORDER BY edge_id) FROM corridor c WHERE c.query_id = q.query_id), '') AS corridor,
        coalesce((SELECT string_agg(DISTINCT edge_id, ',' ORDER BY edge_id) FROM away a WHERE a.query_id = q.query_id), '') AS trap FROM queries q""")
def corridor_trap(spark, d):
    found = search.corridor_and_trap(I.queries(spark, d), _free(spark, d))
    return found.select("query_id", F.array_join("corridor", ",").alias("corridor"), F.array_join("trap", ",").alias("trap"))


@query(f"""{FREE}, lured AS (SELECT node AS query_id, (node * 3 + 1) % (SELECT count(*) FROM nodes) AS other FROM nodes), b(budget) AS (VALUES (0.0::DOUBLE), (0.25), (1.0), (2.0))
    SELECT query_id, budget, edge_id, round(free_flow_s, 6) AS eta_s, round(CASE WHEN u = other THEN greatest(free_flow_s / (1 + budget), 0.001) ELSE free_flow_s * (1 + budget) END, 6) AS told_s
    FROM lured JOIN free ON u = query_id OR u = other, b""")
def routing_aware_eta(spark, d):
    """Of each node the edges that leave it are a corridor, and those of another node a trap."""
    e = _free(spark, d)
    leaving = e.groupBy(F.col("u").alias("node")).agg(F.collect_list("edge_id").alias("edges"))
    count = I.nodes(spark, d).agg(F.count("*").alias("count"))
    pairs = I.nodes(spark, d).join(F.broadcast(count)).select(F.col("node").alias("query_id"), ((F.col("node") * 3 + 1) % F.col("count")).alias("other"))
    none = F.array().cast("array<string>")
    lured = pairs.join(leaving.select(F.col("node").alias("query_id"), F.col("edges").alias("corridor")), "query_id", "left").join(leaving.select(F.col("node").alias("other"), F.col("edges").alias("trap")), "other", "left")
    lured = lured.select("query_id", F.coalesce("corridor", none).alias("corridor"), F.coalesce("trap", none).alias("trap"))
    predicted = e.select("edge_id", F.col("free_flow_s").alias("eta_s"), F.lit("2024-01-25 08:00:00").cast("timestamp_ntz").alias("timestamp"))
    budgets = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (2.0,)], "budget double")
    return predictors.routing_aware(predicted, lured, budgets).select("query_id", "budget", "edge_id", F.round("eta_s", 6).alias("eta_s"), F.round("told_s", 6).alias("told_s"))


# --- evaluation ------------------------------------------------------------------------------------------------------

RESULTS = """WITH results AS (
    SELECT l_orderkey % 5 AS query_seed, l_partkey % 80 AS query_id, ['astar', 'pure_ml_astar', 'robust_astar'][(l_suppkey % 3 + 1)::INT] AS method,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE (l_linenumber % 4)::DOUBLE / 2 END AS sweep_value,
        round(l_extendedprice, 2) AS realized_cost, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 1 + (l_partkey % 100)::DOUBLE / 64 + l_discount END AS competitive_ratio,
        (l_quantity * 10)::BIGINT AS node_expansions, CASE WHEN l_suppkey % 3 = 2 THEN l_tax > 0.05 END AS guard_invoked, l_quantity AS latency_ms, (l_linenumber % 3 + 1) * 1000 AS graph_size, l_orderkey || '-' || l_linenumber AS row_key FROM lineitem)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("l_suppkey") % 3
    return I.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("query_seed"),
        (F.col("l_partkey") % 80).alias("query_id"),
        F.get(F.array(F.lit("astar"), F.lit("pure_ml_astar"), F.lit("robust_astar")), m.cast("int")).alias("method"),
        F.when(m != 0, (F.col("l_linenumber") % 4).cast("double") / 2).alias("sweep_value"),
        F.round("l_extendedprice", 2).alias("realized_cost"),
        F.when(F.col("l_orderkey") % 17 == 0, F.lit(float("nan"))).otherwise(1 + (F.col("l_partkey") % 100).cast("double") / 64 + F.col("l_discount")).alias("competitive_ratio"),
        (F.col("l_quantity") * 10).cast("long").alias("node_expansions"),
        F.when(m == 2, F.col("l_tax") > 0.05).alias("guard_invoked"),
        F.col("l_quantity").alias("latency_ms"),
        ((F.col("l_linenumber") % 3 + 1) * 1000).alias("graph_size"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"),
    )


@query(f"""{ROADS}, {I.QUERIES_SQL}, bounds AS (SELECT q.*, round({I.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / (65.0::DOUBLE * 0.44704::DOUBLE), 6) AS lower_bound_s FROM queries q JOIN nodes a ON a.node = origin JOIN nodes b ON b.node = dest),
    cuts AS (SELECT quantile_cont(lower_bound_s, 1.0::DOUBLE / 3) AS c1, quantile_cont(lower_bound_s, 2.0::DOUBLE / 3) AS c2 FROM bounds)
    SELECT query_id, lower_bound_s, CASE WHEN lower_bound_s <= c1 THEN 'short' WHEN lower_bound_s <= c2 THEN 'medium' ELSE 'long' END AS distance_stratum,
        CASE WHEN hour(depart_time) < 6 THEN 'night' WHEN hour(depart_time) < 10 THEN 'morning_peak' WHEN hour(depart_time) < 16 THEN 'midday' WHEN hour(depart_time) < 20 THEN 'evening_peak' ELSE 'evening' END AS time_stratum
    FROM bounds, cuts""")
def query_strata(spark, d):
    found = evaluation.stratified(I.queries(spark, d), I.nodes(spark, d), 65.0, I.STRATA)
    return found.select("query_id", "lower_bound_s", "distance_stratum", "time_stratum")


_DRAW = "((('0x' || substr(sha256('20120604|{0}|' || query_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


@query(f"""{COLLAPSED}, e AS (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS i FROM (SELECT DISTINCT u, v FROM edges JOIN matches USING (edge_id) WHERE matched)),
    t AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS k FROM (SELECT DISTINCT timestamp FROM features WHERE split = 'test')),
    sizes AS (SELECT (SELECT count(*) FROM e) AS ne, (SELECT count(*) FROM t) AS nt),
    drawn AS (SELECT query_id, floor({_DRAW.format("origin")} * ne) AS i, floor(CASE WHEN query_id < 68 THEN {_DRAW.format("origin")} ELSE {_DRAW.format("dest")} END * ne) AS j,
        floor({_DRAW.format("time")} * nt) AS k FROM range(80) r(query_id), sizes)
    SELECT query_id, a.u AS origin, b.v AS dest, timestamp AS depart_time FROM drawn JOIN e a ON a.i = drawn.i JOIN e b ON b.i = drawn.j JOIN t ON t.k = drawn.k""")
def sampled_query_set(spark, d):
    return evaluation.sampled_queries(_instrumented(spark, d), _features(spark, d).where("split = 'test'"), 80, seed=20120604)


def _instrumented(spark: SparkSession, d: str) -> DataFrame:
    """Edges that a sensor is matched to."""
    return I.edges(spark, d).join(_matches(spark, d).where("matched").select("edge_id"), "edge_id", "left_semi")


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"


_POINTS = ", ".join(f"({', '.join(map(_literal, (r.name, p.predictor, p.value, p.weight, p.mode, p.parameter)))})" for r in experiments.RUNS for p in r.points)


@query(f"""{FREE} SELECT edge_id, run_id, predictor, sweep_value, lambda_base, lambda_mode, round(CASE WHEN predictor = 'adversarial' THEN greatest(free_flow_s * (1 - parameter), 0.001) ELSE free_flow_s END, 6) AS told_s
    FROM free, (VALUES {_POINTS}) t(run_id, predictor, sweep_value, lambda_base, lambda_mode, parameter)""")
def sweep_points(spark, d):
    """What each point of the sweeps tells of each edge whose free-flow time is the prediction; only lies change it here."""
    points = F.broadcast(experiments.sweep_points(spark))  # some dozen rows, fixed by the sweeps
    told = F.when(F.col("predictor") == "adversarial", F.greatest(F.col("free_flow_s") * (1 - F.col("sweep_value")), F.lit(S.LEAST_SECONDS))).otherwise(F.col("free_flow_s"))
    return _free(spark, d).crossJoin(points).select("edge_id", "run_id", "predictor", "sweep_value", "lambda_base", "lambda_mode", F.round(told, 6).alias("told_s"))


@query(f"""WITH {I.QUERIES_SQL} SELECT run_id, method, count(*) AS n FROM queries, (VALUES """ + ", ".join(f"('{r.name}', '{m}', {1 if m in evaluation.CLASSICAL else len(r.points)})" for r in experiments.RUNS for m in r.methods) + ") t(run_id, method, points), range(points) GROUP BY ALL")
def planned_runs(spark, d):
    return experiments.planned_runs(I.queries(spark, d)).groupBy("run_id", "method").agg(F.count("*").alias("n"))


@query(f"""{RESULTS}, optimum AS (SELECT query_id, min(realized_cost) AS optimal_cost FROM results GROUP BY query_id)
    SELECT method, count(*) AS n, round(avg(realized_cost / optimal_cost), 6) AS mean_ratio, round(max(realized_cost / optimal_cost), 6) AS worst FROM results JOIN optimum USING (query_id) GROUP BY method""")
def competitive_ratio(spark, d):
    r = _results(spark, d)
    optimum = r.groupBy("query_id").agg(F.min("realized_cost").alias("optimal_cost"))
    found = evaluation.competitive_ratio(r.drop("competitive_ratio"), optimum)
    return found.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("competitive_ratio"), 6).alias("mean_ratio"), F.round(F.max("competitive_ratio"), 6).alias("worst"))


@query(f"""{RESULTS}, base AS (SELECT query_seed, query_id, min(realized_cost) AS c FROM results WHERE method = 'astar' GROUP BY ALL)
    SELECT query_seed, method, count(*) AS n, round(max(realized_cost / c), 6) AS worst FROM results LEFT JOIN base USING (query_seed, query_id) GROUP BY ALL""")
def ratio_vs_classical(spark, d):
    found = evaluation.ratio_vs_classical(_results(spark, d))
    return found.groupBy("query_seed", "method").agg(F.count("*").alias("n"), F.round(F.max("ratio_vs_classical"), 6).alias("worst"))


@query(f"{RESULTS} SELECT method, sweep_value, round(avg(guard_invoked::INT), 6) AS guard_rate, count(guard_invoked) AS n FROM results GROUP BY ALL")
def guard_rate(spark, d):
    return evaluation.guard_rate(_results(spark, d), ["method", "sweep_value"]).withColumn("guard_rate", F.round("guard_rate", 6))


@query(f"""{RESULTS}, s AS (SELECT method, sweep_value, query_seed, avg(competitive_ratio) AS m FROM results GROUP BY ALL)
    SELECT method, sweep_value, count(m) AS n_seeds, round(avg(m), 6) AS mean_of_seeds FROM s GROUP BY ALL""")
def seed_summary(spark, d):
    return stats.seed_summary(_results(spark, d), ["method", "sweep_value"], "competitive_ratio").withColumn("mean_of_seeds", F.round("mean_of_seeds", 6))


@query(f"""{RESULTS}, s AS (SELECT method, sweep_value, query_seed, max(competitive_ratio) AS m FROM results GROUP BY ALL)
    SELECT method, sweep_value, count(m) AS n_seeds, round(avg(m), 6) AS mean_worst FROM s GROUP BY ALL""")
def worst_case_by_point(spark, d):
    return stats.worst_of_seeds(_results(spark, d), ["method", "sweep_value"], "competitive_ratio").withColumn("mean_worst", F.round("mean_worst", 6))


@query(f"""{RESULTS}, s AS (SELECT sweep_value, query_seed, avg(node_expansions) AS x, avg(competitive_ratio) AS m FROM results WHERE method = 'robust_astar' GROUP BY ALL)
    SELECT sweep_value, round(avg(x), 6) AS mean_expansions, round(avg(m), 6) AS mean_ratio FROM s GROUP BY ALL""")
def pareto_front(spark, d):
    found = evaluation.pareto(_results(spark, d).where("method = 'robust_astar'"), "sweep_value")
    return found.select("sweep_value", F.round("mean_expansions", 6).alias("mean_expansions"), F.round("mean_ratio", 6).alias("mean_ratio"))


@query()
def bootstrap_ci(spark, d):
    per_seed = _results(spark, d).groupBy("method", "query_seed").agg(F.avg(stats.clean("competitive_ratio")).alias("m"))
    return stats.bootstrap(per_seed, ["method"], "m", draws=2000)


_POISSON = "CASE " + " ".join(f"WHEN u < {b!r}::DOUBLE THEN {k}" for b, k in stats.poisson_steps()) + " ELSE 9 END"


@query(f"""{RESULTS}, v AS (SELECT method, competitive_ratio AS v, row_key FROM results WHERE competitive_ratio IS NOT NULL),
    drawn AS (SELECT method, v, d, (('0x' || substr(sha256(row_key || '|' || d), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM v, range(1, 51) r(d)),
    means AS (SELECT method, d, sum(v * t) / sum(t) AS m FROM (SELECT *, {_POISSON} AS t FROM drawn) GROUP BY method, d)
    SELECT method, round((SELECT avg(v) FROM v w WHERE w.method = means.method), 6) AS point, (SELECT count(*) FROM v w WHERE w.method = means.method) AS n,
        round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM means GROUP BY method""")
def bootstrap_ci_hashed(spark, d):
    found = stats.bootstrap_hashed(_results(spark, d), ["method"], "competitive_ratio", key="row_key", draws=50)
    return found.select("method", F.round("point", 6).alias("point"), "n", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


PAIRS = f"""{RESULTS}, own AS (SELECT query_seed, query_id, sweep_value, median(realized_cost) AS a FROM results WHERE method = 'robust_astar' GROUP BY ALL),
other AS (SELECT query_seed, query_id, sweep_value, median(realized_cost) AS b FROM results WHERE method = 'pure_ml_astar' GROUP BY ALL),
d AS (SELECT o.query_seed, sweep_value, round(a - b, 2) AS diff FROM own o JOIN other USING (query_seed, query_id, sweep_value)),
ranked AS (SELECT *, rank() OVER (PARTITION BY query_seed ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY query_seed, abs(diff)) - 1) / 2 AS mid_rank FROM d WHERE diff <> 0)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d).groupBy("query_seed", "query_id", "sweep_value", "method").agg(F.median("realized_cost").alias("m"))
    a = r.where("method = 'robust_astar'").select("query_seed", "query_id", "sweep_value", F.col("m").alias("a"))
    b = r.where("method = 'pure_ml_astar'").select("query_seed", "query_id", "sweep_value", F.col("m").alias("b"))
    return a.join(b, ["query_seed", "query_id", "sweep_value"]).select("query_seed", F.round(F.col("a") - F.col("b"), 2).alias("a"), F.lit(0.0).alias("b"))


@query(f"""{PAIRS} SELECT query_seed, count(*) AS n_pairs, round(sum(CASE WHEN diff > 0 THEN mid_rank ELSE 0 END), 2) AS w_plus, round(sum(CASE WHEN diff < 0 THEN mid_rank ELSE 0 END), 2) AS w_minus,
    round((sum(CASE WHEN diff > 0 THEN mid_rank ELSE -mid_rank END)) / sum(mid_rank), 6) AS effect FROM ranked GROUP BY query_seed""")
def wilcoxon_ranks(spark, d):
    found = stats.wilcoxon(_pairs(spark, d), ["query_seed"], "a", "b")
    return found.select("query_seed", "n_pairs", F.round("w_plus", 2).alias("w_plus"), F.round("w_minus", 2).alias("w_minus"), F.round("effect", 6).alias("effect"))


@query()
def wilcoxon_p(spark, d):
    return stats.wilcoxon(_pairs(spark, d), ["query_seed"], "a", "b")


@query("""WITH p AS (SELECT o_custkey % 50 AS family, o_orderkey AS id, round(((o_orderkey * 37) % 1000 + 1)::DOUBLE / 20000, 9) AS p FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) - 1 AS i, count(*) OVER (PARTITION BY family) AS m FROM p)
    SELECT family, id, round(max(least(1.0, p * (m - i))) OVER w, 6) AS p_adjusted, bool_and(p <= 0.05::DOUBLE / (m - i)) OVER w AS reject FROM r WINDOW w AS (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING)""")
def holm_adjust(spark, d):
    k = F.col("o_orderkey")
    rows = I.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("family"), k.alias("id"), F.round(((k * 37) % 1000 + 1).cast("double") / 20000, 9).alias("p"))
    return stats.holm(rows, ["family"], "p", order="id").select("family", "id", F.round("p_adjusted", 6).alias("p_adjusted"), "reject")


@query()
def headline_table(spark, d):
    r = _results(spark, d).groupBy("query_seed", "query_id", "method", "sweep_value").agg(F.avg(stats.clean("competitive_ratio")).alias("competitive_ratio"))
    return evaluation.headline(r.dropna(subset=["competitive_ratio"]))


@query(f"""{RESULTS}, s AS (SELECT method, sweep_value, query_seed, avg(competitive_ratio) AS m FROM results GROUP BY ALL), a AS (SELECT method, sweep_value, round(avg(m), 6) AS mean_ratio, count(m) AS n_seeds FROM s GROUP BY ALL),
    b AS (SELECT method, sweep_value, round(avg(guard_invoked::INT), 6) AS guard_rate FROM results GROUP BY ALL)
    SELECT a.*, guard_rate FROM a JOIN b ON a.method = b.method AND a.sweep_value IS NOT DISTINCT FROM b.sweep_value""")
def table2_ablation(spark, d):
    rows = _results(spark, d).withColumn("lambda_mode", F.lit(None).cast("string"))
    found = evaluation.ablations(rows, ["method", "lambda_mode", "sweep_value"])
    return found.withColumns({"mean_ratio": F.round("mean_ratio", 6), "guard_rate": F.round("guard_rate", 6)})


@query(f"""{RESULTS} SELECT graph_size, round(avg(latency_ms) FILTER (method = 'astar'), 6) AS astar, round(avg(latency_ms) FILTER (method = 'pure_ml_astar'), 6) AS pure_ml_astar,
    round(avg(latency_ms) FILTER (method = 'robust_astar'), 6) AS robust_astar FROM results GROUP BY graph_size""")
def latency_pivot(spark, d):
    found = evaluation.latency_by_size(_results(spark, d))
    return found.select("graph_size", *[F.round(c, 6).alias(c) for c in found.columns if c != "graph_size"])


@query(f"""{RESULTS}, s AS (SELECT method, sweep_value, query_seed, avg(realized_cost) AS c, avg(competitive_ratio) AS r FROM results GROUP BY ALL)
    SELECT 'budget' AS part, method, sweep_value, round(avg(c), 4) AS mean_realized_cost, NULL::DOUBLE AS mean_competitive_ratio FROM s GROUP BY ALL
    UNION ALL SELECT 'weight', method, sweep_value, NULL, round(avg(r), 6) FROM s WHERE method = 'robust_astar' GROUP BY ALL""")
def improvement_summary(spark, d):
    r = _results(spark, d)
    found = evaluation.improvement_summary(r, r.where("method = 'robust_astar'"))
    return found.withColumns({"mean_realized_cost": F.round("mean_realized_cost", 4), "mean_competitive_ratio": F.round("mean_competitive_ratio", 6)})


# --- experiments -----------------------------------------------------------------------------------------------------

SEEDS = (20120604, 20120605, 20120606, 20120607, 20120608)
PER_SEED = 80


def _regressed(spark: SparkSession, d: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles that the regression predicts for the test split; trained once."""
    f = _features(spark, d)
    name = "regressed-without-" + "-".join(excluded) if excluded else "regressed"
    return _once(spark, d, name, lambda: regression.predict(f.where("split = 'test'"), regression.fit(f, excluded=excluded)))


def _boosted(spark: SparkSession, d: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles that the trees predict for the test split; grown once."""
    f = _features(spark, d)
    name = "boosted-without-" + "-".join(excluded) if excluded else "boosted"
    return _once(spark, d, name, lambda: trees.predict(f.where("split = 'test'"), trees.as_table(spark, trees.fit(f, excluded=excluded))))


#: What the trees predict without these inputs, by the name of the source.
PREDICTED = {"quantile": (), "quantile_ablation": ("neighbor_congestion_proxy",)}


def _world(spark: SparkSession, d: str, *sources: str) -> experiments.World:
    """The world with the predictions of these sources alone, as each is grown from all features."""
    predicted = {n: predictors.times_and_sigma(_boosted(spark, d, x)).select("edge_id", "timestamp", "eta_s", "sigma_s") for n, x in PREDICTED.items() if n in sources}
    return experiments.World(_free(spark, d), I.nodes(spark, d), 65.0, _oracle(spark, d), predicted, I.BUCKET_MINUTES)


def _experiments(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """The result table of the sweeps named, or of all; each sweep is run once, those that are asked for together at one time."""
    asked = [r for r in experiments.RUNS if not names or r.name in names]
    todo = tuple(r for r in asked if not I.known(spark, d, f"experiment-{r.name}"))
    if todo:
        q = experiments.query_sets(_instrumented(spark, d), _features(spark, d).where("split = 'test'"), I.nodes(spark, d), 65.0, I.STRATA, seeds=SEEDS, n=PER_SEED)
        made = written(experiments.results(q, _world(spark, d, *{experiments.source(r, p) for r in todo for p in r.points}), todo), "experiments")
        for r in todo:
            _once(spark, d, f"experiment-{r.name}", lambda r=r: made.where(F.col("run_id") == r.name))
    found = [_once(spark, d, f"experiment-{r.name}", lambda: None) for r in asked]
    return reduce(DataFrame.unionByName, found)


@query()
def regression_eval(spark, d):
    found = predictors.evaluate(predictors.times_and_sigma(_regressed(spark, d)))
    return found.select("n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape")])


@query()
def regression_calibration(spark, d):
    return predictors.calibration(_regressed(spark, d))


@query()
def tree_eval(spark, d):
    found = predictors.evaluate(predictors.times_and_sigma(_boosted(spark, d)))
    return found.select("n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape")])


@query()
def tree_calibration(spark, d):
    return predictors.calibration(_boosted(spark, d))


@query()
def experiment_results(spark, d):
    return _experiments(spark, d).drop("latency_ms", "library_versions", "run_timestamp")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r.name}', '{m}', {len(SEEDS) * PER_SEED * (1 if m in evaluation.CLASSICAL else len(r.points))}::BIGINT)" for r in experiments.RUNS for m in r.methods) + ") t(run_id, method, n)")
def experiment_counts(spark, d):
    return _experiments(spark, d).groupBy("run_id", "method").agg(F.count("*").alias("n"))


#: The sweeps whose predictions are functions of the true times, and trust in noise by its doubt, on the queries of every node.
TOLD_RUNS = tuple(
    r
    for run in experiments.RUNS
    if (r := replace(run, points=tuple(p for p in run.points if p.predictor in ("oracle", "adversarial", "noisy")))).points
) + (experiments.Run("ablation_lambda_mode", 5005, ("robust_astar",), tuple(experiments.Point("noisy", 1.0, mode=m) for m in ("fixed", "confidence_modulated"))),)


def _points_sql() -> str:
    rows = []
    for run in TOLD_RUNS:
        for k, p in enumerate(run.points):
            share, noise = 1 - p.parameter if p.predictor == "adversarial" else 1.0, p.parameter if p.predictor == "noisy" else 0.0
            value = "NULL" if p.value is None else f"'{p.value!r}'"
            rows.append(f"('{experiments.point_id(run, k)}', '{run.name}', '{run.seed}', '{p.predictor}', {value}::DOUBLE, '{p.weight!r}'::DOUBLE, '{p.mode}', '{share!r}'::DOUBLE, '{noise!r}'::DOUBLE)")
    return "points(point, run_id, seed, predictor_type, sweep_value, weight, mode, share, noise) AS (VALUES " + ", ".join(rows) + ")"


def _bent(depart: str, spent: str) -> str:
    """What a query is told of the time t.eta of an edge entered after so many seconds: with noise drawn for that time, or a share of it."""
    when = f"replace(strftime(make_timestamp(round_even((epoch({depart}) + {spent}) * 1000000, 0)::BIGINT), '%Y-%m-%d %H:%M:%S.%f'), '.000000', '')"
    u, v = (f"((('0x' || substr(sha256(q.seed || '|' || e.edge_id || '|' || {when} || '|{x}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)" for x in "uv")
    noisy = f"greatest(t.eta * (1 + q.noise * (sqrt(-2 * ln({u})) * cos(6.283185307179586 * {v}))), 0.001)"
    return f"CASE WHEN t.eta IS NULL THEN NULL WHEN q.noise > 0 THEN {noisy} WHEN q.share < 1 THEN greatest(t.eta * q.share, 0.001) ELSE t.eta END"


_ASKED = I.QUERIES_SQL.replace("queries AS", "asked AS", 1)
_METHODS = "methods(run_id, method) AS (VALUES " + ", ".join(f"('{r.name}', '{m}')" for r in TOLD_RUNS for m in r.methods) + ")"


@query(f"""{_sought(f"{_ASKED}, {_points_sql()}, {_METHODS}, queries AS MATERIALIZED (SELECT point || '|' || query_id AS query_id, query_id AS id, origin, dest, depart_time, points.* FROM asked, points)")},
    ahead AS MATERIALIZED (SELECT * REPLACE (id AS query_id) FROM (SELECT l.*, q.id, q.point FROM lines l JOIN queries q ON q.query_id = l.query_id) WHERE point = 'consistency_sweep/0'),
    {_seek("plain", "nothing", None, asks="asked", bounds="ahead")}, {_walked("plain", "really", asks="asked")},
    {_seek("classical", "line", None, asks="asked", bounds="ahead")}, {_walked("classical", "really", asks="asked")},
    doubtful(query_id, k, spent, doubt, n) AS (
        SELECT query_id, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM queries WHERE mode <> 'fixed' UNION ALL
        SELECT query_id, k, spent + coalesce(told, free_flow_s), doubt + coalesce(eta * noise / greatest(told, 0.000001), 0), n + (told IS NOT NULL)::INT FROM (
            SELECT w.query_id, s.k, spent, doubt, n, e.free_flow_s, t.eta, q.noise, {_bent("q.depart_time", "w.spent")} AS told FROM doubtful w JOIN queries q ON q.query_id = w.query_id JOIN classical_steps s ON s.query_id = q.id AND s.k = w.k + 1
            JOIN free e ON e.edge_id = s.edge_id LEFT JOIN really t ON t.edge_id = s.edge_id AND t.timestamp = {_AT.format("q.depart_time", "w.spent")})),
    doubts AS MATERIALIZED (SELECT query_id, arg_max(doubt, k) / nullif(arg_max(n, k), 0) AS doubt FROM doubtful GROUP BY query_id),
    {LEARNED.format("really", _bent("q.depart_time", "0.0"), "(weight / (1 + coalesce((SELECT doubt FROM doubts o WHERE o.query_id = q.query_id), 0)))")},
    {_seek("pure", "line", "really", bounds="bounds", bent=_bent)}, {_walked("pure", "really")}, {_seek("candidate", "blend", "really", bent=_bent)}, {_walked("candidate", "really")},
    best AS (SELECT id, coalesce(cost, 'infinity'::DOUBLE) AS oracle_optimal_cost FROM queries JOIN pure_cost USING (query_id) WHERE point = 'consistency_sweep/0'),
    judged AS (SELECT q.*, c.true_cost AS c, x.true_cost AS x, coalesce(x.true_cost <= (1 + 0.3::DOUBLE) * c.true_cost, FALSE) AS ok, x.work FROM queries q JOIN classical_cost c ON c.query_id = q.id JOIN candidate_cost x ON x.query_id = q.query_id),
    outcome AS (
        SELECT query_id AS id, run_id, method, 'none' AS predictor_type, NULL::DOUBLE AS sweep_value, NULL::DOUBLE AS lambda_base, NULL::VARCHAR AS lambda_mode, CASE method WHEN 'astar' THEN c.true_cost ELSE p.true_cost END AS cost,
            CASE method WHEN 'astar' THEN c.work WHEN 'dijkstra' THEN p.work END AS node_expansions, NULL::BOOLEAN AS guard_invoked, NULL::DOUBLE AS bound_ratio
        FROM methods, plain_cost p JOIN classical_cost c USING (query_id) WHERE method IN ('dijkstra', 'astar', 'bidirectional')
        UNION ALL SELECT id, run_id, method, predictor_type, sweep_value, NULL, NULL, true_cost, work, NULL, NULL FROM queries JOIN methods USING (run_id) JOIN pure_cost USING (query_id) WHERE method = 'pure_ml_astar'
        UNION ALL SELECT id, run_id, method, predictor_type, sweep_value, weight, mode, CASE WHEN method <> 'robust_astar' OR ok THEN x ELSE c END, work,
            CASE WHEN method = 'robust_astar' THEN c IS NOT NULL AND NOT ok END, CASE WHEN method = 'robust_astar' THEN CASE WHEN c = 0 AND (NOT ok OR x = 0) THEN 1 WHEN c = 0 THEN 'infinity'::DOUBLE WHEN ok THEN x / c ELSE c / c END END
        FROM judged JOIN methods USING (run_id) WHERE method LIKE 'robust%')
    SELECT run_id, method, predictor_type, sweep_value, lambda_base, lambda_mode, 20120604 + id % 5 AS query_seed, id AS query_id, round(coalesce(cost, 'infinity'::DOUBLE), 5) AS cost, node_expansions, guard_invoked, round(bound_ratio, 6) AS robustness_bound_ratio,
        round(oracle_optimal_cost, 5) AS oracle_optimal_cost, CASE WHEN oracle_optimal_cost = 0 AND cost = 0 THEN 1 WHEN oracle_optimal_cost = 0 THEN 'infinity'::DOUBLE ELSE round(cost / oracle_optimal_cost, 6) END AS competitive_ratio
    FROM outcome JOIN best USING (id)""")
def experiment_values(spark, d):
    """The result table of the sweeps that SQL can follow, with a query for each node; a search from both ends settles what its sides meet, which is left out."""

    def make() -> DataFrame:
        q = I.queries(spark, d).withColumns({"query_seed": F.lit(SEEDS[0]) + F.col("query_id") % len(SEEDS), "distance_stratum": F.lit("all"), "time_stratum": F.lit("all")})
        world = experiments.World(_free(spark, d), I.nodes(spark, d), 65.0, _oracle(spark, d), {}, I.BUCKET_MINUTES)
        return experiments.run_all(q, world, TOLD_RUNS)

    settled = F.when(F.col("method") != "bidirectional", F.col("node_expansions")).alias("node_expansions")
    names = ("run_id", "method", "predictor_type", "sweep_value", "lambda_base", "lambda_mode", "query_seed", "query_id", "guard_invoked")
    costs = [F.round("cost", 5).alias("cost"), F.round("oracle_optimal_cost", 5).alias("oracle_optimal_cost"), F.round("robustness_bound_ratio", 6).alias("robustness_bound_ratio"), F.round("competitive_ratio", 6).alias("competitive_ratio")]
    return _once(spark, d, "experiment-values", make).select(*names, settled, *costs)


#: Of each point of the sweeps the means of the seeds' worst and mean ratios, and how often the guard was invoked.
VALUES = f"""WITH results AS MATERIALIZED (FROM ({ORACLE_SQL["experiment_values"]})), keys AS (SELECT *, CASE WHEN NOT isnan(competitive_ratio) THEN competitive_ratio END AS r FROM results)"""


@query(f"""{VALUES}, s AS (SELECT run_id, method, predictor_type, lambda_mode, sweep_value, query_seed, max(r) AS worst, avg(r) AS mean FROM keys GROUP BY ALL),
    a AS (SELECT run_id, method, predictor_type, lambda_mode, sweep_value, count(mean) AS n_seeds, round(avg(worst), 4) AS mean_worst, round(avg(mean), 4) AS mean_ratio FROM s GROUP BY ALL),
    b AS (SELECT run_id, method, predictor_type, lambda_mode, sweep_value, round(avg(guard_invoked::INT), 6) AS guard_rate FROM keys GROUP BY ALL)
    SELECT a.*, guard_rate FROM a JOIN b ON a.run_id = b.run_id AND a.method = b.method AND a.predictor_type = b.predictor_type AND a.lambda_mode IS NOT DISTINCT FROM b.lambda_mode AND a.sweep_value IS NOT DISTINCT FROM b.sweep_value""")
def experiment_values_summary(spark, d):
    keys = ["run_id", "method", "predictor_type", "lambda_mode", "sweep_value"]
    rows = experiment_values(spark, d)
    worst = stats.worst_of_seeds(rows, keys, "competitive_ratio").select(*[F.col(k).alias(f"_{k}") for k in keys], F.round("mean_worst", 4).alias("mean_worst"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = evaluation.ablations(rows, keys).join(worst, same)
    return found.select(*keys, "n_seeds", "mean_worst", F.round("mean_ratio", 4).alias("mean_ratio"), F.round("guard_rate", 6).alias("guard_rate"))


@query(f"""{VALUES}, s AS (SELECT sweep_value, query_seed, avg(node_expansions) AS x, avg(r) AS m FROM keys WHERE run_id LIKE 'lambda_sweep_degraded%' GROUP BY ALL)
    SELECT sweep_value, round(avg(x), 4) AS mean_expansions, round(avg(m), 4) AS mean_ratio FROM s GROUP BY ALL""")
def experiment_values_pareto(spark, d):
    """What trust in noise costs and saves."""
    found = evaluation.pareto(experiment_values(spark, d).where("run_id LIKE 'lambda_sweep_degraded%'"), "sweep_value")
    return found.select("sweep_value", F.round("mean_expansions", 4).alias("mean_expansions"), F.round("mean_ratio", 4).alias("mean_ratio"))


@query()
def experiment_worst_case(spark, d):
    rows = _experiments(spark, d, "robustness_sweep", "adversarial_budget_sweep")
    return stats.worst_of_seeds(rows, ["run_id", "method", "sweep_value"], "competitive_ratio")


@query()
def experiment_guard_rate(spark, d):
    rows = _experiments(spark, d).where("method = 'robust_astar' AND lambda_base IS NOT NULL")
    return evaluation.guard_rate(rows, ["run_id", "lambda_base", "sweep_value"])


@query()
def experiment_headline(spark, d):
    return evaluation.headline(_experiments(spark, d, "consistency_sweep"))


@query()
def experiment_ablations(spark, d):
    rows = _experiments(spark, d, *[r.name for r in experiments.RUNS if r.name.startswith("ablation")])
    return evaluation.ablations(rows, ["run_id", "method", "predictor_type", "lambda_mode", "sweep_value"])


@query()
def experiment_improvement(spark, d):
    r = _experiments(spark, d, "adversarial_budget_sweep", "adversary_lambda_diagnosis").withColumn("realized_cost", F.col("cost"))
    return evaluation.improvement_summary(r.where("run_id = 'adversarial_budget_sweep'"), r.where("run_id = 'adversary_lambda_diagnosis'"))


@query()
def experiment_latency(spark, d):
    return _experiments(spark, d, "consistency_sweep").groupBy("method").agg(F.count("latency_ms").alias("n"), F.avg("node_expansions").alias("mean_expansions"), F.avg("latency_ms").alias("mean_latency_ms"))


def _scaling(spark: SparkSession, d: str, predictor: str) -> DataFrame:
    """Every method on a quarter, a half and all of the nodes."""

    def make() -> DataFrame:
        count = I.nodes(spark, d).count()
        root = spark.createDataFrame([(0,)], "node long")
        times = _features(spark, d).where("split = 'test'")
        return experiments.scaling(_free(spark, d), root, (count // 4, count // 2, count), _world(spark, d, predictor), times, n=40, seed=20120604, point=experiments.Point(predictor))

    return _once(spark, d, f"scaling-{predictor}", make)


@query()
def scaling_oracle(spark, d):
    return _scaling(spark, d, "oracle").groupBy("graph_size", "method").agg(F.count("*").alias("n"), F.avg("node_expansions").alias("mean_expansions"), F.avg("latency_ms").alias("mean_latency_ms"), F.avg("competitive_ratio").alias("mean_ratio"))


@query()
def scaling_quantile(spark, d):
    return _scaling(spark, d, "quantile").groupBy("graph_size", "method").agg(F.count("*").alias("n"), F.avg("node_expansions").alias("mean_expansions"), F.avg("latency_ms").alias("mean_latency_ms"), F.avg("competitive_ratio").alias("mean_ratio"))
