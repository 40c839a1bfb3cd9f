"""Cutting the lineage between the rounds of an iteration, in a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="fernway-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without that setting gets a temporary folder, a cluster an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local()
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage cut, columns prunable."""
    return written_at(df, shared_path(df.sparkSession, name), codec)


def written_at(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """As :func:`written`, at a path of the caller's."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, into: str = "number") -> DataFrame:
    """The rows with their place, from 0, in the order of columns that tell all rows apart.

    Rows are dealt by ranges and counted in each partition; only one count a partition goes to the driver, so that no task holds all.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    ranged = cut(ranged)
    counts = dict(ranged.groupBy("_part").count().collect())
    offsets, held = [F.lit(-1), F.lit(0).cast("long")], 0
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(held).cast("long")]
        held += counts[part]
    return ranged.withColumn(into, F.try_element_at(F.create_map(*offsets), F.col("_part")) + F.col("_place")).drop("_part", "_place")


def sum_before(df: DataFrame, groups: list[str], order: list[str], amount: str, into: str) -> DataFrame:
    """The rows with the sum of ``amount`` over those before them in their group, in an order that tells the rows of a group apart.

    Rows are dealt by ranges of group and order, so that a large group lies in many tasks; a group has one sum for each of them.
    """
    ranged = cut(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", *groups).agg(F.sum(amount).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    keys = ["_part", *groups]
    named = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_base")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    placed = ranged.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(named, same)
    return placed.withColumn(into, F.col("_base") + F.col("_within")).select(*df.columns, into)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
