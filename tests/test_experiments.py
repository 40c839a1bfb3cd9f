"""Sweeps on a random network and the quantile regression, against plain Python."""

import math
import os
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernway.operators import experiments as X
from fernway.operators import predictors, regression, search, trees
from tests.test_search_guard import _random_case


@pytest.fixture(scope="module")
def table(spark):
    queries, _, (q, e, n, told) = _random_case(spark, 5)
    q = q.where("query_id < 25").withColumns({"query_seed": F.lit(1).cast("long"), "distance_stratum": F.lit("short"), "time_stratum": F.lit("night")})
    rough = told.withColumns({"eta_s": F.round("eta_s", -2) + 1, "sigma_s": F.col("eta_s")})
    world = X.World(e, n, 1000.0, told, {"quantile": rough, "quantile_ablation": rough}, 5)
    real = {(r.edge_id, r.timestamp): r.eta_s for r in told.collect()}
    edges = {r.edge_id: (r.u, r.v, r.free_flow_s) for r in e.collect()}
    return q, world, real, edges, X.run_all(q, world).collect()


def test_every_planned_row_is_there(table):
    q, *_, rows = table
    want = {(r["run_id"], r["method"], r["sweep_value"], r["query_id"]): 0 for r in X.planned_runs(q).collect()}
    assert len(rows) == X.planned_runs(q).count()
    assert {(r.run_id, r.method, r.sweep_value if r.method not in X.CLASSICAL else None, r.query_id) for r in rows} == set(want)


def test_rows_keep_their_promises(table):
    *_, rows = table
    classical = {r.query_id: r.cost for r in rows if r.method == "astar" and r.run_id == "consistency_sweep"}
    by = {(r.run_id, r.method, r.predictor_type, r.sweep_value, r.lambda_base, r.lambda_mode, r.query_id): r for r in rows}
    for r in rows:
        assert r.cost == r.oracle_optimal_cost or r.cost >= r.oracle_optimal_cost * (1 - 1e-9) or r.predictor_type != "oracle"
        if r.method == "robust_astar" and math.isfinite(classical[r.query_id]):
            assert r.cost <= classical[r.query_id] * 1.3 + 1e-6 and r.guard_enabled
        if r.method == "pure_ml_astar" and r.predictor_type == "oracle":
            assert math.isclose(r.cost, r.oracle_optimal_cost, rel_tol=1e-9) or r.cost == r.oracle_optimal_cost
        if r.method == "robust_astar_no_guard":
            guarded = by[r.run_id, "robust_astar", r.predictor_type, r.sweep_value, r.lambda_base, r.lambda_mode, r.query_id]
            assert guarded.guard_invoked or r.cost == guarded.cost
    quiet = {(r.query_id, r.method): r.cost for r in rows if r.run_id == "smoothness_sweep" and r.sweep_value == 0.0}
    loud = {(r.query_id, r.method): r.cost for r in rows if r.run_id == "smoothness_sweep" and r.sweep_value == 2.0}
    honest = {(r.query_id, r.method): r.cost for r in rows if r.run_id == "robustness_sweep" and r.sweep_value == 0.0}
    assert quiet == honest != loud


def test_adversary_bends_only_its_edges(table):
    q, world, real, edges, rows = table
    luring = {r.query_id: (set(r.corridor), set(r.trap)) for r in search.corridor_and_trap(q, world.edges, world.told("true")).collect()}
    assert any(a and b for a, b in luring.values())
    one = q.where("query_id < 12").withColumns({"corridor": F.array(F.lit("e1")), "trap": F.array(F.lit("e1"), F.lit("e2"))})
    own = one.select(search.lured(F.col("corridor"), F.col("trap"), F.lit(1.0)).alias("o")).first().o
    assert {(x.edge_id, x.factor, x.cost) for x in own} == {("e1", 0.5, None), ("e2", 0.5, None)}
    # Costs of the routes found by the true times are what the path costs, edge after edge.
    for r in search.dijkstra(q, world.edges, world.told("true")).collect():
        if r.path is None:
            continue
        spent = 0.0
        for u, v in zip(r.path, r.path[1:], strict=False):
            when = r.depart_time + timedelta(seconds=spent)
            at = datetime(when.year, when.month, when.day, when.hour, when.minute - when.minute % 5)
            spent += min(real.get((k, at), free) for k, (a, b, free) in edges.items() if (a, b) == (u, v))
        assert spent <= r.cost + 1e-6


def _features(spark, n=1500):
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(n):
        hour, mean = int(rnd.integers(0, 24)), float(rnd.uniform(10, 50))
        speed = 5 + 0.8 * mean + (6 if hour < 12 else 0) + float(rnd.exponential(8))
        rows.append((f"e{i % 7}", datetime(2024, 1, 1) + timedelta(hours=i), speed, None if i % 9 == 0 else mean, 4.0, hour, i % 7, False, None, "primary" if i % 2 else "service", 100.0, 2, 30.0, ("train", "train", "train", "val", "test")[i % 5]))
    schema = "edge_id string, timestamp timestamp_ntz, speed_mph double, hist_mean_speed double, hist_var_speed double, hour_of_day int, day_of_week int, is_holiday boolean, neighbor_congestion_proxy double, road_class string, length_m double, lanes int, speed_limit_mph double, split string"
    return spark.createDataFrame(rows, schema).repartition(3)


def test_regression_learns_quantiles(spark):
    rows = _features(spark)
    model = regression.fit(rows)
    test = regression.predict(rows.where("split = 'test'"), model)
    found = {r.quantile: r.coverage for r in predictors.calibration(test).collect()}
    assert all(abs(c - q) < 0.09 for q, c in found.items())
    table = predictors.predict_quantiles(rows.where("split = 'test'"), predictors.quantile_model(rows))
    assert predictors.evaluate(predictors.times_and_sigma(test)).first().mae < predictors.evaluate(predictors.times_and_sigma(table)).first().mae
    assert model.losses[-1] < model.losses[0]
    again = regression.from_table(regression.as_table(spark, model))
    assert again.weights == model.weights and again.names == model.names
    train = rows.where("split = 'train'").select(regression.inputs(model).alias("x"), "speed_mph").collect()
    x, y = np.array([r.x for r in train]), np.array([r.speed_mph for r in train])
    # No nearby weights do better on the training rows, by more than a trifle.
    loss = regression.check_loss(y - x @ np.array(model.weights[2]), 0.5).mean()
    rnd = np.random.default_rng(1)
    for _ in range(200):
        other = np.array(model.weights[2]) + rnd.normal(0, 0.2, x.shape[1])
        assert loss < regression.check_loss(y - x @ other, 0.5).mean() + 0.02


def test_regression_refuses_what_it_cannot_do(spark):
    rows = _features(spark, 60)
    for split in ("train", "val"):
        with pytest.raises(ValueError, match=split):
            regression.fit(rows.where(F.col("split") != split))
    with pytest.raises(ValueError, match="inputs"):
        regression.fit(rows, excluded=("nonsense",))
    assert "neighbor_congestion_proxy" not in regression.fit(rows, excluded=("neighbor_congestion_proxy",), most_passes=3).names


def _crossed(spark, n=3000):
    """Speeds that follow the hour and the history only together, with missing histories of their own."""
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(n):
        hour, mean = int(rnd.integers(0, 24)), float(rnd.uniform(10, 50))
        low = (hour < 8) != (mean > 30)
        missing = i % 9 == 0
        speed = (50 if missing else 20 if low else 40) + (5 if i % 2 else 0) + float(rnd.exponential(4))
        rows.append((f"e{i % 7}", datetime(2024, 1, 1) + timedelta(hours=i), speed, None if missing else mean, float("nan"), hour, i % 7, False, None, "primary" if i % 2 else None if i % 4 else "service", 100.0, 2, 30.0, ("train", "train", "train", "val", "test")[i % 5]))
    return spark.createDataFrame(rows, _features(spark, 1).schema).repartition(3)


def test_trees_learn_what_inputs_say_together(spark, monkeypatch):
    import duckdb

    rows = _crossed(spark)
    test = rows.where("split = 'test'")
    monkeypatch.setattr(trees, "STAGE", 4)
    model = trees.fit(rows, most_rounds=14, depth=3)
    table = trees.as_table(spark, model)
    found = trees.predict(test, table)
    assert all(abs(r.coverage - r.quantile) < 0.12 for r in predictors.calibration(found).collect())
    mae = {name: predictors.evaluate(predictors.times_and_sigma(p)).first().mae for name, p in (("trees", found), ("line", regression.predict(test.withColumn("hist_var_speed", F.lit(4.0)), regression.fit(rows.withColumn("hist_var_speed", F.lit(4.0)), most_passes=12))))}
    assert mae["trees"] < 0.7 * mae["line"]
    losses = [sum(x) for x in model.losses]
    assert losses[-1] < 0.6 * losses[0]
    # The same quantiles by SQL over the table of nodes, a level at a time.
    con = duckdb.connect()
    con.register("nodes", table.toArrow())
    con.register("rows", test.withColumn("id", F.date_format("timestamp", "yyyyMMddHH").cast("long")).select("id", *trees.EVERY).toArrow())
    inputs = " UNION ALL ".join(f"SELECT id, '{c}' AS input, nullif(CAST({c} AS DOUBLE), 'nan') AS x FROM rows" for c in trees.EVERY if c != trees.CLASS)
    sql = f"""WITH RECURSIVE x AS ({inputs} UNION ALL SELECT id, 'road_class', n.node FROM rows LEFT JOIN nodes n ON n.tree = -2 AND n.input = road_class),
        stand(id, quantile, tree, node) AS (
            SELECT id, quantile, tree, 0 FROM rows, (SELECT DISTINCT quantile, tree FROM nodes WHERE tree >= 0) UNION ALL
            SELECT a.id, a.quantile, a.tree, 2 * a.node + 1 + coalesce(x.x > n.threshold, FALSE)::INT FROM stand a JOIN nodes n USING (quantile, tree, node) JOIN x ON x.id = a.id AND x.input = n.input)
        SELECT id, quantile, any_value(b.value) + coalesce(sum(n.value), 0) AS q FROM rows CROSS JOIN (SELECT quantile, value FROM nodes WHERE tree = -1) b LEFT JOIN stand a USING (id, quantile) LEFT JOIN nodes n USING (quantile, tree, node) GROUP BY ALL"""
    want = {}
    for i, _, q in con.execute(sql).fetchall():
        want.setdefault(i, []).append(max(q, 1.0))
    got = {r.id: r.q for r in trees.predict(test.withColumn("id", F.date_format("timestamp", "yyyyMMddHH").cast("long")), table).collect()}
    assert set(got) == set(want) and all(np.allclose(got[i], sorted(want[i])) for i in got)


def test_trees_refuse_what_they_cannot_do(spark):
    rows = _features(spark, 60)
    for split in ("train", "val"):
        with pytest.raises(ValueError, match=split):
            trees.fit(rows.where(F.col("split") != split))
    with pytest.raises(ValueError, match="inputs"):
        trees.fit(rows, excluded=("nonsense",))
    few = trees.fit(rows, excluded=("neighbor_congestion_proxy",), most_rounds=1, depth=1)
    assert "neighbor_congestion_proxy" not in few.inputs and trees.predict(rows, trees.as_table(spark, few)).where("size(q) = 5").count() == 60


def test_trees_are_followed_by_columns():
    """Nodes of rows as when each row goes down by itself, and packed rows as they were; rows are looked at column by column, never gathered."""
    rnd = np.random.default_rng(3)
    x, features, bins = rnd.integers(0, 33, (500, 10)).astype(np.uint8), rnd.integers(0, 10, 15), rnd.integers(0, 33, 15)
    want = []
    for row in x:
        node = 0
        for _ in range(4):
            node = 2 * node + 1 + int(row[features[node]] > bins[node])
        want.append(node - 15)
    packed = trees._packed(x).slice(7, 400)
    assert trees._unpacked(packed, np.uint8, 10).T.tolist() == x[7:407].tolist()
    assert trees._leaves(np.ascontiguousarray(x.T), features, bins, 4).tolist() == want


def test_sweeps_are_run_alone_as_together(table):
    """Rows of some sweeps, for which no predictions are there, are those of the table of all."""
    q, world, _, _, rows = table
    some = tuple(r for r in X.RUNS if r.name in ("adversarial_budget_sweep", "adversary_lambda_diagnosis"))
    alone = X.run_all(q, replace(world, predicted={}), some).drop("latency_ms").collect()
    names = [c for c in alone[0].asDict()]
    want = [[r[c] for c in names] for r in rows if r.run_id in {x.name for x in some}]
    assert alone and sorted(map(repr, map(list, alone))) == sorted(map(repr, want))


def test_seeds_of_noise_are_searched_together(table, monkeypatch):
    """One search for each kind of method, however many seeds, with the rows of the table of all."""
    q, world, _, _, rows = table
    some, made = tuple(r for r in X.RUNS if "degraded" in r.name or r.name in ("smoothness_sweep", "robustness_sweep")), []
    for where, name in ((X.search, "astar"), (X.guard, "robust_routes")):
        monkeypatch.setattr(where, name, lambda *a, _f=getattr(where, name), _n=name, **k: made.append(_n) or _f(*a, **k))
    alone = X.run_all(q, replace(world, predicted={}), some).drop("latency_ms").collect()
    # The classical search, that of told times and that of the best routes.
    assert sorted(made) == ["astar", "astar", "astar", "robust_routes"]
    want = [[r[c] for c in alone[0].asDict()] for r in rows if r.run_id in {x.name for x in some}]
    assert sorted(map(repr, map(list, alone))) == sorted(map(repr, want))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_queries_run_the_sweeps_that_they_ask_for(spark, monkeypatch):
    from fernway.plans import catalogue

    def refuse(*_, **__):
        raise AssertionError("no sweep asks for predictions")

    monkeypatch.setattr(trees, "fit", refuse)
    rows = catalogue.experiment_improvement(spark, "/root/testdata/sf0.001").collect()
    assert {r.method for r in rows} == {"pure_ml_astar", "robust_astar", "robust_astar_no_guard"} and {r.part for r in rows} == {"budget", "weight"}


def test_headline_runs_its_sweep_alone(spark, monkeypatch):
    from fernway.plans import catalogue, inputs

    asked = []
    names = ("_features", "_instrumented", "_oracle", "_free")
    for n in names:
        monkeypatch.setattr(catalogue, n, lambda *_: spark.range(0).withColumn("split", F.lit("test")))
    monkeypatch.setattr(inputs, "nodes", lambda *_: None)
    monkeypatch.setattr(X, "query_sets", lambda *_, **__: None)
    monkeypatch.setattr(catalogue, "_world", lambda _, __, *sources: sources)

    def results(queries, sources, runs):
        asked.append(({r.name for r in runs}, set(sources)))
        raise InterruptedError

    monkeypatch.setattr(X, "results", results)
    with pytest.raises(InterruptedError):
        catalogue.experiment_headline(spark, "nowhere")
    assert asked == [({"consistency_sweep"}, {"true", "quantile", "noise 1001"})]
