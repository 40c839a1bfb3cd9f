"""Features without leakage, tags, statistics, files and streams."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernway.functions import scalar as S
from fernway.functions import statistics as stats
from fernway.operators import evaluation, features, predictors, roads
from fernway.sources import files, materialized
from fernway.streaming import costs, history

T0 = datetime(2012, 3, 1)


def times(n):
    return [T0 + timedelta(minutes=5 * i) for i in range(n)]


def test_history_looks_back_only(spark):
    rows = [("e1", t, v) for t, v in zip(times(4), (60.0, 50.0, 40.0, 30.0), strict=True)] + [("e2", t, v) for t, v in zip(times(4), (10.0, 20.0, 30.0, 40.0), strict=True)]
    schema = "edge_id string, timestamp timestamp_ntz, speed_mph double"
    got = features.expanding_history(spark.createDataFrame(rows, schema)).orderBy("edge_id", "timestamp").collect()
    assert [r.hist_mean_speed for r in got] == [None, 60, 55, 50, None, 10, 15, 20]
    assert [r.hist_var_speed for r in got[:4]] == [None, None, 50, 100]
    changed = [(e, t, v if t < T0 + timedelta(minutes=10) else 999.0) for e, t, v in rows]
    again = features.expanding_history(spark.createDataFrame(changed, schema)).orderBy("edge_id", "timestamp").collect()
    assert [(r.hist_mean_speed, r.hist_var_speed) for r in got[:3]] == [(r.hist_mean_speed, r.hist_var_speed) for r in again[:3]]


def test_congestion_of_neighbours(spark):
    speeds = [(t, s, v) for s, vs in (("A", (50.0, 40.0, 30.0)), ("B", (20.0, 10.0, 0.0))) for t, v in zip(times(3), vs, strict=True)]
    speeds = spark.createDataFrame(speeds, "timestamp timestamp_ntz, sensor_id string, speed_mph double")
    limits = spark.createDataFrame([("A", 50.0), ("B", 50.0)], "sensor_id string, speed_limit_mph double")
    near = spark.createDataFrame([("A", "B"), ("B", "A")], "from string, to string")
    got = features.neighbour_congestion(speeds, limits, near).where("sensor_id = 'A'").orderBy("timestamp").collect()
    assert [r.neighbor_congestion_proxy for r in got] == [None, 0.6, 0.8]
    alone = features.neighbour_congestion(speeds.where("sensor_id = 'A'"), limits, near.limit(0)).collect()
    assert [r.neighbor_congestion_proxy for r in alone] == [None] * 3


def test_nearest_edge_far_and_near(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.01), (2, 1.0, 1.0), (3, 1.0, 1.01)], "node long, lat double, lon double")
    edges = spark.createDataFrame([("a", 0, 1), ("b", 1, 0), ("c", 2, 3)], "edge_id string, u long, v long")
    sensors = spark.createDataFrame([("s", 0.001, 0.005), ("t", 0.9, 0.9), ("u", 1.0, 1.005)], "sensor_id string, latitude double, longitude double")
    got = {r.sensor_id: r for r in features.match_sensors(sensors, edges, nodes).collect()}
    assert (got["s"].edge_id, got["t"].edge_id, got["u"].edge_id) == ("a", "c", "c")
    assert got["s"].matched and not got["t"].matched and abs(got["s"].match_distance_m - 111.19) < 0.1
    assert features.match_quality(features.match_sensors(sensors, edges, nodes)).first().n_matched == 2


def test_tags(spark):
    rows = spark.createDataFrame(
        [(["motorway", "trunk"], ["signals", "50 km/h"], ["2", "3.9", "x"]), (None, None, None), (["cycleway"], ["none"], [])], "highway array<string>, maxspeed array<string>, lanes array<string>"
    )
    got = rows.select(S.road_class(F.col("highway")), S.speed_limit_mph(F.col("maxspeed"), F.col("highway")), S.lanes(F.col("lanes"))).collect()
    assert [tuple(r) for r in got] == [("motorway", 50 * 0.621371, 3), ("unclassified", 25.0, 1), ("cycleway", 25.0, 1)]


def test_scalars(spark):
    one = spark.range(1)
    r = one.select(
        S.travel_seconds(F.lit(0.44704), F.lit(0.0)).alias("slow"),
        S.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("degree"),
        S.bucket_floor(F.lit("2012-06-04 14:07:11").cast("timestamp_ntz"), 5).alias("bucket"),
        S.split_of(F.lit("2012-05-30").cast("date"), {"a": ("2012-05-01", "2012-06-01"), "b": ("2012-05-30", "2012-06-02")}).alias("split"),
        S.stars(F.lit(float("nan"))).alias("none"),
        S.stars(F.lit(0.004)).alias("two"),
        S.blended(F.lit(2.0), F.lit(None).cast("double"), F.lit(0.5)).alias("blend"),
    ).first()
    assert (r.slow, r.split, r.none, r.two, r.blend, r.bucket) == (1.0, "b", "", "**", 2.0, datetime(2012, 6, 4, 14, 5))
    assert abs(r.degree - 111_320) < 1113


def test_unassigned_split_fails(spark):
    day = [("s", datetime(2024, 1, 1, 1), 30.0)]
    readings = spark.createDataFrame(day, "sensor_id string, timestamp timestamp_ntz, speed_mph double")
    matches = spark.createDataFrame([("s", "e", True)], "sensor_id string, edge_id string, matched boolean")
    edges = spark.createDataFrame([("e", "primary", 100.0, 1, 45.0)], "edge_id string, road_class string, length_m double, lanes int, speed_limit_mph double")
    none = spark.createDataFrame([], "from string, to string")
    build = lambda splits: features.build_features(readings, matches, edges, none, holidays=[], splits=splits)
    assert build({"train": ("2024-01-01", "2024-01-01")}).first().split == "train"
    with pytest.raises(Exception, match="no split"):
        build({"train": ("2023-01-01", "2023-01-02")}).collect()


def test_model_ignores_the_test_split(spark):
    rows = [("e", "primary", h, float(20 + i), "train") for h in (7, 8) for i in range(5)] + [("e", "primary", 7, 500.0, "test")]
    table = spark.createDataFrame(rows, "edge_id string, road_class string, hour_of_day int, speed_mph double, split string")
    a = sorted(map(str, predictors.quantile_model(table).collect()))
    b = sorted(map(str, predictors.quantile_model(table.where("split = 'train'")).collect()))
    assert a == b
    asked = spark.createDataFrame([("e", "primary", 7, 100.0), ("x", "primary", 8, 100.0), ("x", "other", 3, 100.0)], "edge_id string, road_class string, hour_of_day int, length_m double")
    got = predictors.times_and_sigma(predictors.predict_quantiles(asked, predictors.quantile_model(table))).collect()
    assert all(abs(r.eta_s - 100 / (22 * 0.44704)) < 1e-9 and r.sigma_s > 0 for r in got)


def test_bootstrap(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", 7.0)] * 20 + [("c", 42.0), ("d", None), ("e", 1.0), ("e", 2.0), ("e", 3.0), ("e", float("nan"))]
    got = {r.g: r for r in stats.bootstrap(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", draws=500).collect()}
    assert got["a"].point == 3 and got["a"].ci_low <= 3 <= got["a"].ci_high and got["a"].n == 5
    assert (got["b"].point, got["b"].ci_low, got["b"].ci_high) == (7, 7, 7)
    assert (got["c"].point, got["c"].ci_low, got["c"].n) == (42, 42, 1) and (got["e"].point, got["e"].n) == (2, 3)
    assert got["d"].point is None and got["d"].n == 0
    keyed = spark.createDataFrame(rows, "g string, v double").withColumn("k", F.monotonically_increasing_id())
    hashed = {r.g: r for r in stats.bootstrap_hashed(keyed, ["g"], "v", key="k").collect()}
    assert hashed["a"].ci_low <= 3 <= hashed["a"].ci_high and hashed["b"].ci_low == 7


def test_hashed_bootstrap_takes_a_digest_once(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 100).cast("double").alias("v"), "id")
    digits, unit = S.hashed_digits(F.col("id").cast("string"), F.lit("7")), S.hashed_unit(F.col("id").cast("string"), F.lit("7"))
    bounds = [b for b, _ in stats.poisson_steps()]
    same = rows.select(*[((digits < S.first_digits(b)) == (unit < b)).alias(f"s{i}") for i, b in enumerate(bounds)]).distinct().collect()
    assert [tuple(r) for r in same] == [(True,) * len(bounds)]
    found = stats.bootstrap_hashed(rows, ["g"], "v", key="id", draws=20)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    # A bound that lies on a number, and its neighbours.
    for h in (0, 1, 12345, (1 << 52) - 2):
        at = (h + 0.5) / (1 << 52)
        assert [int(S.first_digits(b), 16) for b in (at, math.nextafter(at, 1))] == [h, h + 1]


def test_wilcoxon(spark):
    cases = {"up": ([1, 2, 3, 4, 5], [2, 3, 4, 5, 6]), "down": ([5, 5, 5], [1, 1, 1]), "zeros": ([1, 2, 3, 10], [1, 2, 3, 1]), "same": ([1, 2], [1, 2]), "mixed": ([1.5, 2.0, -3.0, 4.0, 9.0, -1.0], [0.0] * 6)}
    rows = [(k, float(x), float(y)) for k, (a, b) in cases.items() for x, y in zip(a, b, strict=True)]
    got = {r.g: r for r in stats.wilcoxon(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", "b").collect()}
    assert (got["up"].effect, got["up"].n_pairs, got["up"].n_zero) == (-1, 5, 0)
    assert got["down"].effect == 1 and (got["zeros"].n_zero, got["zeros"].n_pairs) == (3, 1)
    assert (got["same"].n_pairs, got["same"].effect, got["same"].p) == (0, 0, None)
    # Ranks 2, 3, -4, 5, 6, -1: ten of the 64 sign patterns have a negative sum of at most 5.
    assert got["mixed"].statistic == 5 and math.isclose(got["mixed"].p, 2 * 10 / 64)


@pytest.mark.parametrize(
    ("p", "adjusted", "reject"),
    [
        ([0.01, 0.02, 0.03, 0.04, 0.05], [0.05, 0.08, 0.09, 0.09, 0.09], [True, False, False, False, False]),
        ([0.03, 0.01, 0.05, 0.02, 0.04], [0.09, 0.05, 0.09, 0.08, 0.09], [False, True, False, False, False]),
        ([0.03], [0.03], [True]),
        ([], [], []),
    ],
)
def test_holm(spark, p, adjusted, reject):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = stats.holm(rows, [], "p", order="i").orderBy("i").collect()
    assert [round(r.p_adjusted, 9) for r in got] == adjusted and [r.reject for r in got] == reject


def test_holm_refuses_nan(spark):
    with pytest.raises(Exception, match="p-value"):
        stats.holm(spark.createDataFrame([(0, float("nan"))], "i int, p double"), [], "p", order="i").collect()


def test_seed_summary(spark):
    rows = [(1, x) for x in (1.0, 2.0, 3.0)] + [(2, x) for x in (4.0, 6.0, 5.0, float("nan"))] + [(3, 10.0)] * 4
    r = stats.seed_summary(spark.createDataFrame(rows, "query_seed int, v double"), [], "v").first()
    assert r.n_seeds == 3 and math.isclose(r.mean_of_seeds, 17 / 3)


def test_pairs_at_the_same_point(spark):
    rows = [(1, 1, "robust_astar", 0.5, 1.0), (1, 1, "robust_astar", 1.0, 2.0), (1, 1, "pure_ml_astar", 0.5, 3.0), (1, 1, "pure_ml_astar", 1.0, 4.0), (1, 1, "astar", None, 5.0)]
    results = spark.createDataFrame(rows, "query_seed int, query_id int, method string, sweep_value double, x double")
    assert evaluation.robust_against(results, "x").count() == 4
    assert evaluation.robust_against(results, "x", by_point=False).count() == 6


def test_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("time,1,2\n2012-03-01 00:00:00,60.5,\n2012-03-01 00:05:00,50,40\n")
    got = files.read_speeds(spark, str(tmp_path / "v.csv"), ["1", "2"]).collect()
    assert sorted((r.sensor_id, r.speed_mph) for r in got) == [("1", 50.0), ("1", 60.5), ("2", 40.0)]
    assert files.read_speeds(spark, str(tmp_path / "v.csv"), ["2"]).count() == 1
    (tmp_path / "l.csv").write_text("index,sensor_id,latitude,longitude\n0,773869,34.1,-118.3\n")
    assert files.read_locations(spark, str(tmp_path / "l.csv")).first().sensor_id == "773869"
    (tmp_path / "d.csv").write_text("from,to,cost\n1,2,3.5\n")
    assert files.read_distances(spark, str(tmp_path / "d.csv")).first().cost == 3.5
    nodes = spark.createDataFrame([(0, 1.0, 2.0)], "node long, lat double, lon double")
    files.write_graph(nodes, nodes, str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g"))[0].collect() == nodes.collect()
    model = spark.createDataFrame([(2, "*", -1, [1.0])], "level int, place string, hour int, q array<double>")
    files.save_model(model, str(tmp_path / "m"), "v1")
    files.save_model(model.withColumn("level", F.lit(1)), str(tmp_path / "m"), "v2")
    assert files.load_model(spark, str(tmp_path / "m")).first().level == 1
    assert files.load_model(spark, str(tmp_path / "m"), "v1").first().level == 2


def test_geometries(spark, tmp_path):
    import struct

    def line(order, *points):
        return struct.pack(order + "BII", order == "<", 2, len(points)) + b"".join(struct.pack(order + "dd", *p) for p in points)

    shapes = [("bent", line("<", (-118.0, 34.0), (-118.0, 34.1), (-117.9, 34.1))), ("straight", line(">", (-118.0, 34.0), (-117.9, 34.0))), ("none", None), ("dot", struct.pack("<BIdd", 1, 1, 3.0, 4.0))]
    spark.createDataFrame(shapes, "edge_id string, geometry binary").write.parquet(str(tmp_path / "g"))
    read = files.read_geometries(spark, str(tmp_path / "g"))
    found = {r.edge_id: r.points and [tuple(p) for p in r.points] for r in read.collect()}
    assert found == {"bent": [(-118.0, 34.0), (-118.0, 34.1), (-117.9, 34.1)], "straight": [(-118.0, 34.0), (-117.9, 34.0)], "none": None, "dot": [(3.0, 4.0)]}
    parts, nodes = files.line_segments(read.where("edge_id IN ('bent', 'straight')"))
    places = spark.createDataFrame([("a", 34.0995, -117.95), ("b", 34.0005, -117.95), ("c", 34.07, -118.0005)], "sensor_id string, latitude double, longitude double")
    assert {r.sensor_id: r.edge_id for r in features.match_sensors(places, parts, nodes).collect()} == {"a": "bent", "b": "straight", "c": "bent"}


def test_sinks_and_empty_graphs(spark, tmp_path):
    rows = spark.createDataFrame([("e1", T0, 1.0, "train"), ("e2", T0, 2.0, "val")], "edge_id string, timestamp timestamp_ntz, speed_mph double, split string")
    files.write_features(rows, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("split = 'val'").first().edge_id == "e2"
    results = evaluation.provenance(rows.withColumn("run_id", F.lit("r")), config="c")
    files.write_results(results, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r")).where("run_id = 'r'").collect()
    assert len(back) == 2 and back[0].config == "c" and "pyspark" in back[0].library_versions and back[0].run_timestamp is not None
    files.write_figure(rows.select("edge_id", "speed_mph"), str(tmp_path / "fig"))
    assert spark.read.option("header", True).csv(str(tmp_path / "fig")).count() == 2
    nodes = spark.createDataFrame([(0, 1.0, 2.0)], "node long, lat double, lon double")
    files.write_graph(nodes, nodes.limit(0), str(tmp_path / "g"))
    with pytest.raises(ValueError, match="empty"):
        files.read_graph(spark, str(tmp_path / "g"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_graph(spark, str(tmp_path / "nowhere"))


def test_stream(spark, tmp_path):
    rows = [("s", T0 + timedelta(minutes=m), float(v)) for m, v in ((0, 10), (1, 20), (6, 30), (30, 40))]
    spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, speed_mph double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sensor_id string, ts timestamp, speed_mph double").parquet(str(tmp_path / "in"))
    matches = spark.createDataFrame([("s", "e", True)], "sensor_id string, edge_id string, matched boolean")
    edges = spark.createDataFrame([("e", 100.0)], "edge_id string, length_m double")
    costs.refresh(costs.edge_costs(costs.bucketed(stream), matches, edges), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("timestamp").collect()
    assert [round(r.eta_s, 6) for r in got] == [round(100 / (v * 0.44704), 6) for v in (15.0, 30.0)]


def test_levels(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "u long, v long")
    root = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.level for r in roads.breadth_first(edges, root).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    assert roads.largest_strong_share(edges, nodes).first().largest_share == 0.75
    assert roads.induced(edges, roads.first_nodes(edges, root, 3)).count() == 3


def test_strong_components(spark):
    import random

    rnd = random.Random(2)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)] + [(50, 51), (51, 52), (52, 50), (52, 60), (60, 60)]
    nodes = sorted({x for p in pairs for x in p} | {99})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for u, v in pairs:
            for n in nodes:
                if u in reach[n]:
                    reach[n].add(v)
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    got = roads.strong_components(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_strong_components_need_no_round_for_each_hop(spark):
    n = 600
    ring = spark.range(n).select(F.col("id").alias("u"), ((F.col("id") + 1) % n).alias("v")).unionByName(spark.createDataFrame([(5, 1000), (1000, 1001)], "u long, v long"))
    nodes = ring.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    want = {k: 0 for k in range(n)} | {1000: 1000, 1001: 1001}
    assert {r.node: r.component for r in roads.strong_components(ring, nodes, most_rounds=20).collect()} == want
    pairs = [(0, 1), (1, 0), (2, 3), (3, 2), (1, 2), (3, 9), (9, 0), (9, 8), (4, 5), (5, 6), (6, 4), (6, 9)]
    small = spark.createDataFrame(pairs, "u long, v long")
    found = roads.strong_components(small, spark.range(10).withColumnRenamed("id", "node"), cell_edges=4)
    assert {r.node: r.component for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 0, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}


def test_sensors_without_a_place_or_near_a_long_edge(spark):
    nodes = spark.createDataFrame([(0, 34.0, -118.0), (1, 34.5, -117.0), (2, 34.0, -117.0)], "node long, lat double, lon double")
    edges = spark.createDataFrame([("long", 0, 1), ("flat", 0, 2)], "edge_id string, u long, v long")
    places = [("a", 34.25, -117.5), ("b", 34.001, -117.4), ("c", None, -117.0), ("d", float("nan"), 1.0), ("e", 34.6, -116.9)]
    got = {r.sensor_id: r for r in features.match_sensors(spark.createDataFrame(places, "sensor_id string, latitude double, longitude double"), edges, nodes).collect()}
    assert (got["a"].edge_id, got["b"].edge_id, got["e"].edge_id) == ("long", "flat", "long")
    assert got["a"].matched and not got["e"].matched
    assert all(got[x].edge_id is None and not got[x].matched for x in "cd")


def test_noise_of_the_generator(spark):
    """The draws of a generator seeded by the first eight bytes of the SHA-256 of seed, edge and time."""
    import hashlib

    import numpy as np

    rows = spark.createDataFrame([("e1", datetime(2012, 6, 4, 8), 10.0), ("e2", datetime(2012, 6, 4, 8, 5), 20.0)], "edge_id string, timestamp timestamp_ntz, eta_s double")
    for r in predictors.noisy_generated(rows, 0.5, seed=42).collect():
        eta = {"e1": 10.0, "e2": 20.0}[r.edge_id]
        digest = hashlib.sha256(f"42:{r.edge_id}:{r.timestamp.isoformat()}".encode()).digest()
        want = max(eta + np.random.default_rng(int.from_bytes(digest[:8], "big")).normal(0.0, 0.5 * eta), 1e-3)
        assert math.isclose(r.eta_s, want, rel_tol=1e-12)


def test_numbers_follow_the_order(spark):
    from fernway.operators.rounds import numbered

    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(5)
    assert all(r.k == r.number for r in numbered(rows, "k").collect())


def test_headline_adjusts_its_tests(spark):
    rows = [(s, q, m, 1.0 + q / 100 + {"robust_astar": 0.0, "astar": 0.5, "pure_ml_astar": 0.001 * (-1) ** q}[m]) for s in (1, 2, 3) for q in range(12) for m in ("robust_astar", "astar", "pure_ml_astar")]
    results = spark.createDataFrame(rows, "query_seed int, query_id int, method string, competitive_ratio double").withColumn("sweep_value", F.lit(None).cast("double"))
    got = {r.method: r for r in evaluation.headline(results).collect()}
    assert got["astar"].p_adjusted == min(1.0, 2 * got["astar"].p) and got["astar"].stars == "***" and got["astar"].reject
    assert got["pure_ml_astar"].p_adjusted >= got["pure_ml_astar"].p and got["pure_ml_astar"].stars == "ns"
    assert got["robust_astar"].p is None and got["robust_astar"].stars == ""


def test_breadth_first_does_not_end_silently(spark):
    chain, root = spark.range(6).selectExpr("id AS u", "id + 1 AS v"), spark.range(1).selectExpr("id AS node")
    with pytest.raises(RuntimeError, match="levels"):
        roads.breadth_first(chain, root, most_levels=3)
    assert roads.breadth_first(chain, root, most_levels=8).count() == 7


def test_percentiles_of_groups_of_any_size(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rnd.normal(0, 5, 4000)] + [("b", float(x)) for x in rnd.integers(0, 4, 3000)] + [(None, 1.0), (None, 2.5), ("c", 7.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    shares = (0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0)
    for small in (10**6, 1500):
        found = {r.g: r.q for r in stats.percentiles(df, ["g"], "v", shares, small=small).collect()}
        assert set(found) == set(want)
        for g, q in found.items():
            assert np.allclose(q, np.quantile(want[g], shares))
        assert np.allclose(stats.percentiles(df, [], "v", shares, small=small).first().q, np.quantile(sum(want.values(), []), shares))
    assert stats.percentiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_ranks_of_a_group_in_many_tasks(spark):
    rnd = np.random.default_rng(4)
    rows = [(g, float(x)) for g, n in (("a", 900), (None, 300), ("b", 1)) for x in rnd.integers(-40, 40, n)]
    found = stats.signed_ranks(spark.createDataFrame(rows, "g string, x double").withColumn("zero", F.lit(0.0)).repartition(6), ["g"], "x", "zero").collect()
    for g in ("a", "b", None):
        sizes = sorted(abs(x) for h, x in rows if h == g and x)
        mid = {s: (2 * sizes.index(s) + sizes.count(s) + 1) / 2 for s in sizes}
        assert sorted((r.diff, r.mid_rank) for r in found if r.g == g) == sorted((x, mid[abs(x)]) for h, x in rows if h == g and x)


def test_history_of_a_stream(spark, tmp_path):
    rnd = np.random.default_rng(6)
    rows = [(f"e{k}", T0 + timedelta(minutes=5 * i), None if rnd.random() < 0.05 else float(rnd.uniform(5, 60))) for i in range(60) for k in range(4) if rnd.random() < 0.7]
    for part in range(3):
        mine = [r for r in rows if (r[1] - T0).seconds // 6000 == part]
        if part == 2:
            mine.append(("e1", T0, 9.0))  # too late
        spark.createDataFrame(mine, "edge_id string, timestamp timestamp, speed_mph double").repartition(2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("edge_id string, timestamp timestamp, speed_mph double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    history.expanding_history(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    late = found.where("late").collect()
    assert [(r.edge_id, r.timestamp, r.hist_mean_speed) for r in late] == [("e1", T0, None)]
    want = features.expanding_history(spark.createDataFrame(rows, "edge_id string, timestamp timestamp, speed_mph double"))
    got = {(r.edge_id, r.timestamp): r for r in found.where("NOT late").collect()}
    assert len(got) == len(rows)
    for r in want.collect():
        for c in ("speed_mph", "hist_mean_speed", "hist_var_speed"):
            assert r[c] == got[r.edge_id, r.timestamp][c] or math.isclose(r[c], got[r.edge_id, r.timestamp][c], rel_tol=1e-9)


GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d5" for="node" attr.name="y" attr.type="string"/><key id="d4" for="node" attr.name="x" attr.type="string"/>
  <key id="d9" for="edge" attr.name="highway" attr.type="string"/><key id="d8" for="edge" attr.name="lanes" attr.type="string"/>
  <graph edgedefault="directed">
    <node id="10"><data key="d5">34.5</data><data key="d4">-118.25</data></node>
    <node id="20"><data key="d5">34.75</data></node>
    <edge source="10" target="20" id="0"><data key="d9">['primary', "o'ne", 3]</data><data key="d8">2</data></edge>
    <edge source="20" target="10" id="0"><data key="d9">residential</data></edge>
  </graph>
</graphml>"""


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(map(tuple, nodes.collect())) == [("10", 34.5, -118.25), ("20", 34.75, None)]
    assert sorted((r.u, r.v, r.length, r.highway, r.maxspeed, r.lanes) for r in edges.collect()) == [("10", "20", None, ["primary", "o'ne", "3"], None, ["2"]), ("20", "10", None, ["residential"], None, None)]
    nodes = spark.createDataFrame([(i, 34.0 + i / 8, -118.0 - i / 8) for i in range(30)], "node long, lat double, lon double")
    edges = spark.createDataFrame([(i, (i * 7) % 30, i / 4, ["primary", "a & <b>"] if i % 2 else ["service"], ["30 mph"] if i % 3 else None, None) for i in range(30)], "u long, v long, length double, highway array<string>, maxspeed array<string>, lanes array<string>")
    back = files.read_graphml(spark, *files.write_graphml(nodes, edges, str(tmp_path / "out")))
    for a, b in zip((nodes, edges), back, strict=True):
        texts = a.select(*[F.col(c).cast("string").alias(c) if c in ("node", "u", "v") else F.col(c) for c in a.columns])
        assert sorted(map(str, texts.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError, match="empty"):
        files.read_graphml(spark, str(tmp_path / "out" / "nodes"))


def test_results_by_run(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "run_id string, x int").write.partitionBy("run_id").parquet(str(tmp_path / "r"))
    assert files.read_results(spark, str(tmp_path / "r"), "b").count() == 2 and files.read_results(spark, str(tmp_path / "r")).count() == 3
    with pytest.raises(ValueError, match="c"):
        files.read_results(spark, str(tmp_path / "r"), "c")


def test_materialized_costs(spark, tmp_path):
    schema, day = "edge_id string, timestamp timestamp_ntz, eta_s double, sigma_s double", timedelta(days=1)
    rows = [(f"e{k}", T0 + d * day + timedelta(hours=h), 100.0 * k + h, 1.0) for k in range(9) for d in range(4) for h in range(0, 24, 3)]
    spark.sql("DROP TABLE IF EXISTS fernway_costs")
    materialized.create(spark.createDataFrame(rows, schema), "fernway_costs", str(tmp_path / "t"), parts=4)
    try:
        files_of = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
        before = files_of()
        fresh = [("e1", T0 + 2 * day, 7.0, 0.5), ("e1", T0 + 2 * day + timedelta(hours=1), 8.0, 0.5), ("new", T0 + 2 * day, 9.0, 0.5), ("e2", T0 + 9 * day, 5.0, 0.0)]
        assert materialized.refresh(spark, "fernway_costs", spark.createDataFrame(fresh, schema)) == [(T0 + 2 * day).date(), (T0 + 9 * day).date()]
        after = files_of()
        touched = {p.split("/")[1] for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
        assert touched == {f"day={(T0 + d * day).date()}" for d in (2, 9)}
        want = {(e, t): (c, s) for e, t, c, s in rows + fresh}
        asked = spark.createDataFrame([(e, t, "x") for e, t in want] + [("e1", T0 + timedelta(minutes=5), "x"), ("none", T0, "x")], "edge_id string, timestamp timestamp_ntz, own string")
        found = {(r.edge_id, r.timestamp): (r.eta_s, r.sigma_s) for r in materialized.look_up(asked, "fernway_costs").collect()}
        assert found == want | {("e1", T0 + timedelta(minutes=5)): (None, None), ("none", T0): (None, None)}
        filled = materialized.look_up(asked, "fernway_costs", lambda r: r.withColumns({"eta_s": F.lit(-1.0), "sigma_s": F.lit(0.0)})).where("eta_s = -1").count()
        assert filled == 2
        # Of rows bucketed alike nothing is shuffled.
        spark.sql("DROP TABLE IF EXISTS fernway_asked")
        asked.write.bucketBy(4, "edge_id").option("path", str(tmp_path / "a")).saveAsTable("fernway_asked")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = materialized.look_up(spark.table("fernway_asked"), "fernway_costs")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("fernway_costs", "fernway_asked"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def _snyder(lat, lon, central):
    """The projection by another series: powers of the difference in longitude, with the arc of the meridian."""
    a, f, k0 = S.ELLIPSOID_A, S.ELLIPSOID_F, S.ZONE_SCALE
    e2 = f * (2 - f)
    p, e_ = math.radians(lat), e2 / (1 - e2)
    n, t, c, d = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, e_ * math.cos(p) ** 2, math.cos(p) * math.radians(lon - central)
    arc = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
    x = k0 * n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * e_) * d**5 / 120)
    y = k0 * (arc + n * math.tan(p) * (d**2 / 2 + (5 - t + 9 * c + 4 * c**2) * d**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * e_) * d**6 / 720))
    return x, y


def test_projection(spark):
    places = [(lat, lon) for lat in (-70.0, -33.4, 0.0, 34.05, 64.2) for lon in (-179.5, -118.25, -120.0, 0.0, 5.999, 151.2, 180.0)]
    df = spark.createDataFrame(places, "lat double, lon double").withColumn("central", S.central_meridian(F.col("lon")))
    for r in df.select("*", *[c.alias(n) for c, n in zip(S.mercator_xy(F.col("lat"), F.col("lon"), F.col("central")), "xy", strict=True)]).collect():
        assert abs(r.lon - r.central) <= 3 and (r.central - 3) % 6 == 0
        assert np.allclose((r.x, r.y), _snyder(r.lat, r.lon, r.central), atol=0.01)
    ends = spark.createDataFrame([("s", 34.05, -118.25, "e", 34.06, -118.26, 34.07, -118.23)], "sensor_id string, latitude double, longitude double, edge_id string, a double, b double, c double, d double").first()
    central = -117.0
    (px, py), (ax, ay), (bx, by) = (_snyder(*x, central) for x in ((ends.latitude, ends.longitude), (ends.a, ends.b), (ends.c, ends.d)))
    t = min(1, max(0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    want = math.hypot(ax + t * (bx - ax) - px, ay + t * (by - ay) - py)
    sensors = spark.createDataFrame([("s", ends.latitude, ends.longitude)], "sensor_id string, latitude double, longitude double")
    nodes, edges = spark.createDataFrame([(1, ends.a, ends.b), (2, ends.c, ends.d)], "node long, lat double, lon double"), spark.createDataFrame([("e", 1, 2)], "edge_id string, u long, v long")
    for radius in (100.0, 5000.0):
        found = features.match_sensors(sensors, edges, nodes, radius_m=radius, projected=True).first()
        assert found.edge_id == "e" and abs(found.match_distance_m - want) < 0.01


def test_wide_tables_of_speeds_are_made_and_read_in_one_pass(spark, tmp_path):
    """As many jobs for forty tables as for two; every table has its header."""
    from datetime import datetime

    def told(n, name):
        rows = [(datetime(2024, 1, 1, h), f"s{k}", float(k + h)) for k in range(n) for h in (1, 2) if (k + h) % 3]
        readings = spark.createDataFrame(rows, "timestamp timestamp_ntz, sensor_id string, speed_mph double")
        wide, places = features.widened(readings, readings, 3)
        assert wide.select("table").distinct().count() == -(-n // 3)
        path = str(tmp_path / name)
        group = f"wide {name}"
        spark.sparkContext.setJobGroup(group, group)
        files.write_speeds(wide, places, path)
        got = [files.read_speed_files(spark, path, 3), features.lengthened(wide, places)]
        assert all(sorted(map(tuple, x.collect())) == sorted(rows) for x in got)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return jobs

    assert told(118, "many") <= told(5, "few") + 10


def test_mean_differences_are_those_of_the_pairs_without_forming_them(spark):
    rows = [(1, q, m, p, v) for q in (1, 2) for m, p, v in (("robust_astar", 0.5, 3.0), ("robust_astar", 0.5, float("nan")), ("robust_astar", 1.0, 2.0), ("astar", None, 1.0 + q), ("astar", None, 1.5), ("pure", 0.5, None), ("pure", 1.0, 4.0))]
    results = spark.createDataFrame(rows, "query_seed int, query_id int, method string, sweep_value double, x double")
    pairs = {}
    for r in evaluation.robust_against(results, "x").collect():
        pairs.setdefault((r.baseline, r.point), []).append(None if r.a != r.a or r.b is None else r.a - r.b)
    means = {k: (len(v), sum(w) / len(w) if (w := [x for x in v if x is not None]) else None) for k, v in pairs.items()}
    assert {(r.baseline, r.point): (r.n, r.mean_difference) for r in evaluation.mean_differences(results, "x").collect()} == means
    # A query with twenty thousand rows of each side has 4 * 10^8 pairs.
    many = spark.range(40000).selectExpr("1 AS query_seed", "1 AS query_id", "IF(id % 2 = 0, 'robust_astar', 'pure') AS method", "0.5D AS sweep_value", "CAST(id % 2 AS DOUBLE) AS x")
    assert [tuple(r) for r in evaluation.mean_differences(many, "x").collect()] == [("pure", 0.5, 400000000, -1.0)]


@pytest.mark.parametrize("projected", [False, True])
def test_sensors_under_many_long_edges_are_matched_as_by_all_pairs(spark, monkeypatch, projected):
    """Every edge passes most sensors, so that all pairs would leave the cells; only the nearest do, and batches are cut."""
    import random

    monkeypatch.setattr(features, "CROWD", 7)
    monkeypatch.setattr(features, "PAIRS", 500)
    kept, near = [], features._near
    monkeypatch.setattr(features, "_near", lambda *a: kept.append(near(*a)) or kept[-1])
    draw = random.Random(5)
    nodes = spark.createDataFrame([(i, 34 + draw.random(), -118.5 + draw.random() / 10) for i in range(80)], "node long, lat double, lon double")
    edges = spark.createDataFrame([(f"e{i}", draw.randrange(80), draw.randrange(80)) for i in range(300)] + [("a", 3, 4), ("b", 3, 4)], "edge_id string, u long, v long")
    sensors = spark.createDataFrame([(f"s{i}", 34 + draw.random(), -118.5 + draw.random() / 10) for i in range(60)] + [("far", 36.0, -118.0)], "sensor_id string, latitude double, longitude double")
    got = {r.sensor_id: (r.edge_id, r.match_distance_m) for r in features.match_sensors(sensors, edges, nodes, projected=projected).collect()}
    a, b = (nodes.select(F.col("node").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}")) for x in "uv")
    apart = (S.projected_m if projected else S.planar_m)(F.col("latitude"), F.col("longitude"), F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v"))
    every = sensors.crossJoin(edges.join(a, "u").join(b, "v")).groupBy("sensor_id").agg(F.min(F.struct(F.round(apart, 3).alias("d"), "edge_id")).alias("m"))
    assert got == {r.sensor_id: (r.m.edge_id, r.m.d) for r in every.collect()}
    assert sum(k.count() for k in kept) < 1000
