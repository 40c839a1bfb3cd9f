"""Sources and sinks: CSV with fixed schemas, graph and feature tables as Parquet, figure data as CSV, versioned models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_speeds(spark: SparkSession, path: str, sensors: list[str] | None = None) -> DataFrame:
    """timestamp, sensor_id, speed_mph from a wide CSV file: time first, then a column for each sensor; only those listed."""
    from fernway.operators.features import unpivot_speeds

    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join([f"`{names[0]}` TIMESTAMP_NTZ", *[f"`{n}` DOUBLE" for n in names[1:]]])
    wide = spark.read.schema(schema).option("header", True).csv(path).withColumnRenamed(names[0], "timestamp")
    kept = [n for n in names[1:] if sensors is None or n in sensors]
    return unpivot_speeds(wide.select("timestamp", *[F.col(f"`{n}`") for n in kept]))


def write_speeds(wide: DataFrame, places: DataFrame, path: str) -> None:
    """The tables of :func:`fernway.operators.features.widened` as CSV files, one for each, with a header of its own sensors.

    All are of one width; the columns that the last table doesn't need have no name.
    """
    columns = [c for c in wide.columns if c not in ("table", "timestamp")]
    heads = places.groupBy("table").agg(F.map_from_entries(F.collect_list(F.struct("place", "sensor_id"))).alias("of"))
    head = heads.select("table", F.lit(0).alias("_line"), F.lit("timestamp").alias("timestamp"), *[F.try_element_at("of", F.lit(c)).alias(c) for c in columns])
    body = wide.select("table", F.lit(1).alias("_line"), *[F.col(c).cast("string").alias(c) for c in ("timestamp", *columns)])
    rows = head.unionByName(body).repartition("table").sortWithinPartitions("table", "_line", "timestamp")
    rows.drop("_line").write.partitionBy("table").csv(path)


def read_speed_files(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """timestamp, sensor_id, speed_mph from all wide CSV files below a path, each with a header of its own and ``columns`` sensors, in one pass.

    A file of another width is an error.
    """
    names = [f"c{k}" for k in range(columns)]
    schema = ", ".join(f"{c} STRING" for c in ("time", *names))
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), "time", F.array(*names).alias("values"))
    head = rows.where("time = 'timestamp'").select("file", F.col("values").alias("names"))
    long = rows.where("time <> 'timestamp'").join(head, "file").select(F.col("time").cast("timestamp_ntz").alias("timestamp"), F.explode(F.arrays_zip("names", "values")).alias("s"))
    return long.where("s.values IS NOT NULL").select("timestamp", F.col("s.names").alias("sensor_id"), F.col("s.values").cast("double").alias("speed_mph"))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """sensor_id, latitude, longitude."""
    rows = spark.read.option("header", True).schema("`index` STRING, sensor_id STRING, latitude DOUBLE, longitude DOUBLE").option("enforceSchema", False).csv(path)
    return rows.select("sensor_id", "latitude", "longitude")


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """from, to, cost."""
    return spark.read.option("header", True).schema("`from` STRING, `to` STRING, cost DOUBLE").csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as Parquet below the folder."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as written by :func:`write_graph`; no such folder is an error, and so is a graph without nodes or edges."""
    nodes, edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    if nodes.isEmpty() or edges.isEmpty():
        raise ValueError(f"the graph in {folder} is empty")
    return nodes, edges


#: The data of a GraphML graph that are read and written: kind, name and type.
GRAPHML = (("node", "y", "double"), ("node", "x", "double"), ("edge", "length", "double"), ("edge", "highway", "string"), ("edge", "maxspeed", "string"), ("edge", "lanes", "string"))
_DATA = "data array<struct<_key string, _VALUE string>>"


def _xml(spark: SparkSession, paths: tuple[str, ...], tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(list(paths))


def _listed(text: Column) -> Column:
    """A tag as an array of texts: one text, or the items of a list as Python writes it; null for null."""
    items = F.transform(F.regexp_extract_all(text, F.lit(r"""'([^']*)'|"([^"]*)"|([^\s,\[\]'"]+)"""), 0), lambda t: F.regexp_replace(t, "^['\"]|['\"]$", ""))
    return F.when(text.startswith("["), items).when(text.isNotNull(), F.array(text))


def read_graphml(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, lat, lon) and raw edges (u, v, length, highway, maxspeed, lanes; the tags as arrays) of a graph, read by row tags.

    The files hold keys, nodes and edges, together or apart. No nodes or no edges is an error.
    """
    keys = {(r["_for"], r["_attr.name"]): r["_id"] for r in _xml(spark, paths, "key", "_id string, _for string, `_attr.name` string").limit(1000).collect()}

    def value(kind: str, name: str) -> Column:
        wanted = keys.get((kind, name)) or keys.get(("all", name))
        return F.get(F.filter("data", lambda d: d["_key"] == F.lit(wanted)), F.lit(0))["_VALUE"] if wanted else F.lit(None).cast("string")

    nodes = _xml(spark, paths, "node", f"_id string, {_DATA}").select(F.col("_id").alias("node"), value("node", "y").cast("double").alias("lat"), value("node", "x").cast("double").alias("lon"))
    tags = [_listed(value("edge", t)).alias(t) for t in ("highway", "maxspeed", "lanes")]
    edges = _xml(spark, paths, "edge", f"_source string, _target string, {_DATA}").select(F.col("_source").alias("u"), F.col("_target").alias("v"), value("edge", "length").cast("double").alias("length"), *tags)
    if nodes.isEmpty() or edges.isEmpty():
        raise ValueError(f"the graph in {', '.join(paths)} is empty")
    return nodes, edges


def write_graphml(nodes: DataFrame, edges: DataFrame, folder: str) -> tuple[str, str, str]:
    """Keys, nodes and raw edges as GraphML files below the folder; gives the paths that :func:`read_graphml` takes."""
    spark = nodes.sparkSession
    ids = {(kind, name): f"d{i}" for i, (kind, name, _) in enumerate(GRAPHML)}
    keys = spark.createDataFrame([(ids[k, n], k, n, t) for k, n, t in GRAPHML], "_id string, _for string, `_attr.name` string, `_attr.type` string")

    def data(kind: str, values: dict[str, Column]) -> Column:
        """The values that are there, with their keys."""
        each = F.array(*[F.struct(F.lit(ids[kind, n]).alias("_key"), v.cast("string").alias("_VALUE")) for n, v in values.items()])
        return F.filter(each, lambda d: d["_VALUE"].isNotNull()).alias("data")

    def text(tag: str) -> Column:
        items = F.array_join(F.transform(tag, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
        return F.when(F.size(tag) == 1, F.get(tag, F.lit(0))).when(F.col(tag).isNotNull(), F.concat(F.lit("["), items, F.lit("]")))

    rows = {
        "key": keys,
        "node": nodes.select(F.col("node").cast("string").alias("_id"), data("node", {"y": F.col("lat"), "x": F.col("lon")})),
        "edge": edges.select(F.col("u").cast("string").alias("_source"), F.col("v").cast("string").alias("_target"), data("edge", {"length": F.col("length"), **{t: text(t) for t in ("highway", "maxspeed", "lanes")}})),
    }
    for tag, df in rows.items():
        df.write.mode("overwrite").format("xml").option("rootTag", "graphml").option("rowTag", tag).save(f"{folder}/{tag}s")
    return tuple(f"{folder}/{tag}s" for tag in rows)


def wkb_points(geometry: pa.Array) -> pa.Array:
    """The points (x, y) of points and lines in well-known binary, of two dimensions, as lists; null for null. All are parsed at once."""
    column = geometry.cast(pa.large_binary())
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    start, size = ends[:-1][there], np.diff(ends)[there]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    if (size < 5).any():
        raise ValueError("a geometry is cut short")
    little = data[start] == 1
    four = data[start[:, None] + np.arange(1, 5)].astype(np.int64)
    weights = np.where(little[:, None], 256 ** np.arange(4), 256 ** np.arange(3, -1, -1))
    kind = (four * weights).sum(axis=1)
    if len(other := kind[(kind != 1) & (kind != 2)]):
        raise ValueError(f"a geometry of kind {other[0]} is neither a point nor a line")
    head = np.where(kind == 1, 5, 9)
    count = (size - head) // 16
    numbers = 2 * count
    first = np.repeat(start + head, numbers) + 8 * (np.arange(int(numbers.sum())) - np.repeat(np.cumsum(numbers) - numbers, numbers))
    order = np.where(np.repeat(little, numbers)[:, None], np.arange(8), np.arange(7, -1, -1))
    places = np.ascontiguousarray(data[first[:, None] + order]).view("<f8").reshape(-1, 2)
    each = np.zeros(len(column), dtype=np.int64)
    each[there] = count
    points = pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))), pa.int32()), points, mask=column.is_null())


def read_geometries(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """The rows of a GeoParquet file of points or lines, with ``points``, an array of (x, y), in place of the geometry."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], wkb_points(batch.columns[-1])], names=[*batch.schema.names[:-1], "points"])

    rows = spark.read.parquet(path)
    kept = rows.drop(column)
    points = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    return rows.select(*kept.columns, column).mapInArrow(parse, T.StructType([*kept.schema.fields, T.StructField("points", points)]))


def line_segments(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (edge_id, u, v) and nodes (node, lat, lon) of the straight parts of lines (edge_id, points), to match sensors to.

    Each part has its line's edge_id, so that the nearest edge is that with the nearest part.
    """
    vertices = edges.select("edge_id", F.posexplode("points").alias("k", "p")).withColumn("node", F.concat_ws("#", "edge_id", "k"))
    parts = vertices.where("k > 0").select("edge_id", F.concat_ws("#", "edge_id", F.col("k") - 1).alias("u"), F.col("node").alias("v"))
    return parts, vertices.select("node", F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))


def write_features(features: DataFrame, folder: str) -> None:
    """Partitioned by split, sorted by edge and time, so that a reader of one split skips the others."""
    features.repartition("split", "edge_id").sortWithinPartitions("edge_id", "timestamp").write.mode("overwrite").partitionBy("split").parquet(folder)


def write_results(results: DataFrame, folder: str) -> None:
    """Partitioned by run."""
    results.write.mode("overwrite").partitionBy("run_id").parquet(folder)


def read_results(spark: SparkSession, folder: str, *runs: str) -> DataFrame:
    """The rows of those runs, or of all; other runs' files are not read. A run that isn't there is an error."""
    rows = spark.read.parquet(folder)
    if not runs:
        return rows
    known = {r["run_id"] for r in rows.select("run_id").distinct().collect()}
    if missing := set(runs) - known:
        raise ValueError(f"no such runs: {', '.join(sorted(missing))}")
    return rows.where(F.col("run_id").isin(*runs))


def write_figure(data: DataFrame, folder: str) -> None:
    """A figure's few rows as one CSV file with a header."""
    data.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def save_model(model: DataFrame, folder: str, version: str) -> None:
    """A version of a quantile model, and the pointer to it as the newest."""
    model.write.mode("overwrite").parquet(f"{folder}/version={version}")
    model.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder}/_latest")


def load_model(spark: SparkSession, folder: str, version: str = "latest") -> DataFrame:
    """The model of that version."""
    if version == "latest":
        version = spark.read.schema("version string").json(f"{folder}/_latest").first()["version"]
    return spark.read.parquet(f"{folder}/version={version}")
