"""Searches on networks too large to be broadcast: cells of the network are brought to the queries that come to them.

The nodes are dealt into cells of about as many edges each, by place along a curve that keeps near nodes together, or by id where places are not
known. The edges of each cell, with their times, are written once, sorted by cell. Queries that begin in one cell are searched in batches, each in
a task of its own with the cells it needs, at first those of the ends. A search that settles a node of a cell that is not there goes on without
it, so that one round finds a whole ring of cells that are wanted; its query is run again with these, until it needs no other. What it finds then
is what it would find on the whole network, to the last tie, as the code is the same.

A round reads the unfinished queries and the cells they want. A query's searched part of the network must fit a task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernway.operators.rounds import written

#: Edges of a cell, about, and queries of a batch at most.
CELL_EDGES, BATCH = 20_000, 32
#: Cells by number in a filter that the scan of the cells gets; beyond it gets their range alone.
NAMED = 1000
MOST_ROUNDS = 10_000


def _curve(lat: Column, lon: Column) -> Column:
    """The place along a curve of cells within cells: the bits of both coordinates in turn."""
    x, y = (F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 32767).cast("long") for c in ((lon + 180) / 360, (lat + 90) / 180))
    total = F.lit(0).cast("long")
    for bit in range(15):
        total = total + F.shiftleft(F.shiftright(x, bit).bitwiseAND(F.lit(1)), 2 * bit) + F.shiftleft(F.shiftright(y, bit).bitwiseAND(F.lit(1)), 2 * bit + 1)
    return total


def node_cells(edges: DataFrame, nodes: DataFrame | None, count: int) -> DataFrame:
    """node, lat, lon and cell of every end of an edge. ``count``: of cells, about."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if nodes is None:
        placed = ends.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
        ranged = placed.repartitionByRange(count, "node")
    else:
        placed = ends.join(nodes.select("node", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropDuplicates(["node"]), "node", "left")
        ranged = placed.withColumn("_at", F.coalesce(_curve(F.col("lat"), F.col("lon")), F.lit(-1))).repartitionByRange(count, "_at", "node").drop("_at")
    return written(ranged.withColumn("cell", F.spark_partition_id()), "node-cells")


def _profiles(times: DataFrame | None, name: str) -> DataFrame | None:
    """edge_id and the times told of it as an array."""
    if times is None:
        return None
    return times.groupBy("edge_id").agg(F.collect_list(F.struct("when_s", "eta_s", "sigma_s")).alias(name))


TIMES = "array<struct<when_s: double, eta_s: double, sigma_s: double>>"


def pages(edges: DataFrame, cells: DataFrame, told: DataFrame | None, real: DataFrame | None) -> DataFrame:
    """The edges (edge_id, u, v, free) of each cell that has an end of theirs, with the ends' cells and places and the times told."""
    for end in "uv":
        edges = edges.join(cells.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("cell", "lat", "lon")]), end)
    for name, times in (("told", told), ("real", real)):
        found = _profiles(times, name)
        edges = edges.withColumn(name, F.lit(None).cast(TIMES)) if found is None else edges.join(found, "edge_id", "left")
    each = edges.withColumn("cell", F.explode(F.array_distinct(F.array("u_cell", "v_cell"))))
    return written(each.repartitionByRange("cell").sortWithinPartitions("cell"), "cells")


def _wanted(page: DataFrame, want: DataFrame) -> DataFrame:
    """The edges of the cells that each batch (batch, held) wants."""
    want = want.select("batch", F.explode("held").alias("cell"))
    few = [r[0] for r in want.select("cell").distinct().limit(NAMED + 1).collect()]
    if not few:
        return page.limit(0).withColumn("batch", F.lit(None).cast("string"))
    if len(few) <= NAMED:
        page = page.where(F.col("cell").isin(few))
    else:
        low, high = want.agg(F.min("cell"), F.max("cell")).first()
        page = page.where(F.col("cell").between(low, high))
    return page.join(want, "cell").drop("cell")


def in_rounds(queries: DataFrame, cells: DataFrame, page: DataFrame, work: Callable[[pa.Table, pa.Table, frozenset[int]], pa.Table], result: list[T.StructField]) -> DataFrame:
    """The columns ``result`` and those of the queries (query_id, origin, dest, ...), each query searched where its cells are.

    ``work`` gets the queries and the edges of a batch and the cells it has, and gives the result columns and ``missing``, the cells that
    each query wants besides.
    """
    spark, names = queries.sparkSession, queries.columns
    home = [cells.select(F.col("node").alias(end), F.col("cell").alias(f"_{end}")) for end in ("origin", "dest")]
    rows = queries.join(home[0], "origin", "left").join(home[1], "dest", "left")
    # A cell in which many queries begin is dealt to several batches.
    rows = rows.withColumn("_cell", F.coalesce("_origin", F.lit(-1)))
    crowd = rows.groupBy("_cell").agg(F.ceil(F.count("*") / BATCH).alias("_n"))
    salt = F.pmod(F.xxhash64("query_id", "dest"), F.col("_n"))
    rows = rows.join(crowd, "_cell").select(*queries.columns, F.concat_ws("/", "_cell", salt).alias("batch"), F.array_compact(F.array("_origin", "_dest")).alias("missing"))
    todo = written(rows, "searched")
    types = T.StructType([*todo.select(*names).schema.fields, *result, T.StructField("missing", T.ArrayType(T.IntegerType()))])
    batch_types = T.StructType([*types.fields, T.StructField("batch", T.StringType()), T.StructField("held", T.ArrayType(T.IntegerType()))])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        held = left.column("held")[0].as_py()
        found = work(left.select(names), right, frozenset(held))
        return pa.table([*[left.column(n) for n in names], *[found.column(f.name) for f in types.fields[len(names) :]], left.column("batch"), left.column("held")], names=batch_types.names)

    done, held = [], None
    for _ in range(MOST_ROUNDS):
        more = todo.groupBy("batch").agg(F.array_distinct(F.flatten(F.collect_list("missing"))).alias("more"))
        held = more.withColumnRenamed("more", "held") if held is None else more.join(held, "batch").select("batch", F.array_union("held", "more").alias("held"))
        held = written(held, "held")
        left = todo.select(*names, "batch").join(held, "batch")
        found = left.groupBy("batch").cogroup(_wanted(page, held).groupBy("batch")).applyInArrow(task, batch_types)
        found = written(found, "found")
        done.append(found.where(F.size("missing") == 0).select(*types.names[:-1]))
        todo = found.where(F.size("missing") > 0).select(*names, "batch", "missing")
        if todo.isEmpty():
            every = done[0]
            for some in done[1:]:
                every = every.unionByName(some)
            return every
        held = held.join(todo.select("batch").distinct(), "batch", "left_semi")
    raise RuntimeError(f"queries still want cells after {MOST_ROUNDS} rounds of {spark.sparkContext.applicationId}")
