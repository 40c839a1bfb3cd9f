"""The road graph as two tables, and set-based graph operators on them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernway.functions import scalar as S
from fernway.operators.rounds import cut, shared_path

#: Rounds of joins between checkpoints.
STRIDE = 4
#: Edges of a cell, about, whose strongly connected nodes a task finds.
CELL_EDGES = 20_000


def build_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id, u, v, length_m, road_class, speed_limit_mph and lanes, from tagged node pairs and the nodes' places.

    Without a ``key`` column, parallel edges are told apart by their order of highway tags.
    """
    if "key" not in raw.columns:
        raw = raw.withColumn("key", F.row_number().over(Window.partitionBy("u", "v").orderBy("highway")) - 1)
    a, b = (nodes.select(F.col("node").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}")) for x in "uv")
    placed = raw.join(a, "u").join(b, "v")
    return placed.select(
        F.concat_ws("_", "u", "v", "key").alias("edge_id"),
        "u",
        "v",
        F.round(S.haversine_m(F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v")), 3).alias("length_m"),
        S.road_class(F.col("highway")).alias("road_class"),
        S.speed_limit_mph(F.col("maxspeed"), F.col("highway")).alias("speed_limit_mph"),
        S.lanes(F.col("lanes")).alias("lanes"),
    )


def free_flow(edges: DataFrame) -> DataFrame:
    """The edges with ``free_flow_s``, the seconds at the speed limit."""
    return edges.withColumn("free_flow_s", S.travel_seconds(F.col("length_m"), F.col("speed_limit_mph")))


def max_speed(edges: DataFrame) -> DataFrame:
    """One row: the largest speed limit."""
    return edges.agg(F.max("speed_limit_mph").alias("max_speed_mph"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree and neighbours in order, of every node with an edge."""
    out = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("out_degree"), F.array_sort(F.collect_set("v")).alias("neighbours"))
    into = edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "neighbours")


def reverse(edges: DataFrame) -> DataFrame:
    """The edges the other way round."""
    return edges.withColumns({"u": F.col("v"), "v": F.col("u")})


def _spread(labels: DataFrame, steps: DataFrame, onward: Column, most_rounds: int) -> DataFrame:
    """(node, label, round): the least label that reaches each node along steps (node, v), and the round in which it came.

    A round takes the labels that improved last; rows are written and looked at every ``STRIDE`` rounds.
    """
    for k in range(1, most_rounds):
        moved = labels.where(F.col("round") == k - 1).join(steps, "node").select(F.col("v").alias("node"), onward.alias("label"), F.lit(k).alias("round"))
        labels = labels.unionByName(moved).groupBy("node").agg(F.min(F.struct("label", "round")).alias("b")).select("node", "b.label", "b.round")
        if k % STRIDE == 0 or k == most_rounds - 1:
            labels = cut(labels)
            if labels.where(F.col("round") == k).isEmpty():
                return labels
    raise RuntimeError(f"nodes are still met after {most_rounds - 1} levels")


def breadth_first(edges: DataFrame, roots: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """(node, level): the fewest edges from any root (node), by rounds of joins until nothing new is met.

    A round joins the nodes met last with their edges, leaves out those met before, and appends the rest to the table of nodes met.
    """
    spark, steps = edges.sparkSession, cut(edges.select(F.col("u").alias("node"), "v").distinct())
    path = shared_path(spark, "levels")
    new, schema = roots.select("node").distinct(), "node {}, level int".format(roots.schema["node"].dataType.simpleString())
    for level in range(most_levels):
        new.select("node", F.lit(level).alias("level")).write.mode("append").parquet(f"{path}/{level}")
        last = spark.read.schema(schema).parquet(f"{path}/{level}")
        if level and last.isEmpty():
            return met
        met = spark.read.schema(schema).parquet(*[f"{path}/{k}" for k in range(level + 1)])
        new = last.join(steps, "node").select(F.col("v").alias("node")).distinct().join(met.select("node"), "node", "left_anti")
    raise RuntimeError(f"nodes are still met after {most_levels - 1} levels")


def first_nodes(edges: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """The first ``n`` nodes met breadth-first, ties of a level by node."""
    return breadth_first(edges, roots).orderBy("level", "node").limit(n).select("node")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose two ends are among the nodes (node)."""
    u, v = (nodes.select(F.col("node").alias(x)).distinct() for x in "uv")
    return edges.join(u, "u", "left_semi").join(v, "v", "left_semi")


def _joined_within(pairs: pa.Table) -> pa.Table:
    """(node, rep): of the ends of edges (u, v) the smallest node of their strongly connected component, by depth-first search."""
    out: dict = {}
    for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True):
        out.setdefault(u, []).append(v)
        out.setdefault(v, [])
    place, low, rep, open_, path = {}, {}, {}, [], []
    for root in out:
        if root in place:
            continue
        path.append((root, iter(out[root])))
        place[root] = low[root] = len(place)
        open_.append(root)
        while path:
            node, onward = path[-1]
            for end in onward:
                if end not in place:
                    place[end] = low[end] = len(place)
                    open_.append(end)
                    path.append((end, iter(out[end])))
                    break
                if end not in rep:
                    low[node] = min(low[node], place[end])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == place[node]:
                    at = len(open_) - 1
                    while open_[at] != node:
                        at -= 1
                    members, first = open_[at:], min(open_[at:])
                    del open_[at:]
                    rep.update((m, first) for m in members)
    kind = pairs.schema.field("u").type
    return pa.table([pa.array(list(rep), kind), pa.array(list(rep.values()), kind)], names=["node", "rep"])


def strong_components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 10_000, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(node, component): the strongly connected component of every node, named by its smallest node.

    Nodes are dealt into cells by ranges, of about ``cell_edges`` edges; nodes that are strongly connected within a cell, which a task finds,
    become one, and so on with what is left, until it is one cell. What cells do not lessen by a fifth is found by rounds of joins.
    """
    every = nodes.select("node").distinct()
    kind = every.schema["node"].dataType.simpleString()
    names, kept = cut(every.withColumn("rep", F.col("node"))), cut(edges.select("u", "v").where("u <> v").distinct())
    count = kept.count()
    while count:
        cells = -(-count // cell_edges)
        dealt = cut(names.select("rep").distinct().repartitionByRange(cells, "rep").withColumn("cell", F.spark_partition_id()))
        ends = [dealt.select(F.col("rep").alias(x), F.col("cell").alias(f"c{x}")) for x in "uv"]
        within = kept.join(ends[0], "u").join(ends[1], "v").where("cu = cv").select("u", "v", F.col("cu").alias("cell"))
        found = within.groupBy("cell").applyInArrow(lambda pairs: _joined_within(pairs), f"node {kind}, rep {kind}")
        found = cut(found.where("node <> rep").withColumnRenamed("node", "old").withColumnRenamed("rep", "new"))
        names = cut(names.join(found, F.col("rep") == F.col("old"), "left").select("node", F.coalesce("new", "rep").alias("rep")))
        if cells == 1:
            break
        for end in "uv":
            kept = kept.join(found, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
        kept = cut(kept.where("u <> v").distinct())
        before, count = count, kept.count()
        if count > before * 4 // 5:
            rest = _strong_components_by_rounds(kept, names.select(F.col("rep").alias("node")), most_rounds)
            return names.join(rest.withColumnRenamed("node", "rep"), "rep").select("node", "component")
    return names.withColumnRenamed("rep", "component")


def _strong_components_by_rounds(edges: DataFrame, nodes: DataFrame, most_rounds: int) -> DataFrame:
    """As :func:`strong_components`, all side by side.

    Each pass gives every node the smallest one that reaches it as its colour, by rounds of joins. A node of its own colour then
    has for component those of its colour that reach it. What is found is removed, and so are nodes without an edge in or out.
    """
    left, kept, found = cut(nodes.select("node").distinct()), cut(edges.select("u", "v").where("u <> v").distinct()), None
    for _ in range(most_rounds):
        ends = kept.select(F.col("u").alias("node")).intersect(kept.select(F.col("v").alias("node")))
        alone = left.join(ends, "node", "left_anti").select("node", F.col("node").alias("component"))
        among = left.join(ends, "node", "left_semi")
        steps = cut(induced(kept, among).select(F.col("u").alias("node"), "v"))
        start = cut(among.select("node", F.col("node").alias("label"), F.lit(0).alias("round")))
        colours = _spread(start, steps, F.col("label"), most_rounds).select("node", F.col("label").alias("colour"))
        # Edges within a colour, to be followed back from the node that gave it.
        own = [colours.select(F.col("node").alias(x), F.col("colour").alias(f"c{x}")) for x in "uv"]
        back = cut(kept.join(own[0], "u").join(own[1], "v").where("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v")))
        met = breadth_first(back, colours.where("node = colour").select("node"), most_rounds).select("node")
        new = cut(alone.unionByName(colours.join(met, "node", "left_semi").select("node", F.col("colour").alias("component"))))
        found = new if found is None else found.unionByName(new)
        left = cut(left.join(new, "node", "left_anti"))
        if left.isEmpty():
            return found
        kept = cut(induced(kept, left))
    raise RuntimeError(f"components are still found after {most_rounds} passes")


def largest_strong_share(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: the share of the nodes in the largest strongly connected component; null without nodes."""
    sizes = strong_components(edges, nodes).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") / F.sum("n")).alias("largest_share"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_nodes"))
