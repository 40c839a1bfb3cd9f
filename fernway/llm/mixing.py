"""Mixing of sources to target weights, in shards.

Sources share the words of the corpus by weight; none is given more than ``MOST`` times what it holds, and what is over goes to the others.
The documents of a source, in an order drawn from their ids, one such order after another for each time the source is repeated, are a
stream, of which the target's words are taken; the document at its end is taken in part, so that the target is met to the word. A stream
is cut into blocks of equal numbers of words; a document belongs to the block in which it begins.

A tree splits the blocks of all sources among the shards: each node deals its quotas, whole numbers of blocks by source, to its two halves by
a draw from the multivariate hypergeometric distribution, with a generator seeded by the node, so that every block goes to exactly one
shard and any task can draw any subtree again. A shard takes its quotas from the permuted blocks of each source and is shuffled for itself.

Places in a stream are sums over histograms of the order's first bits, twice over, and within buckets of about ``BUCKET`` documents, so that no
task sorts a whole source.

Defined results: a null text has no words; a document without words, and a source without any, is never taken; a null source is one of its own,
the last one; null ids share one place in the order; repeated rows are taken each for itself; an empty table gives no rows; other columns are
not looked at. The same table gives the same mix, but for which of several rows alike in id and size is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernway.llm.common import slices
from fernway.llm.words import word_counts
from fernway.operators.rounds import numbered, written

#: Weights of the sources in the order of their names, again and again; how often a source may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block and of a shard; blocks at most (a draw may have not more than 10^9), beyond which blocks are larger.
BLOCK_WORDS, SHARD_WORDS, MOST_BLOCKS = 1 << 13, 1 << 24, 1 << 28
#: Documents of a bucket, about, and bits of an order that one of the two histograms tells apart.
BUCKET, BITS = 1000, 12
SUBTREES = 64


@dataclass(frozen=True)
class Sized:
    """Documents (row, doc_id, source_key, size) and sources (source_key, number, source_size, docs, target, goal: its words as a whole number)."""

    rows: DataFrame
    sources: DataFrame


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(word_counts(some.column("text")))], names=[*some.schema.names[:-1], "size"])


def sized(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> Sized:
    """Words of the documents and targets of the sources of ``docs`` (doc_id, source, text)."""
    key = F.when(F.col("source").isNotNull(), F.concat(F.lit("="), "source")).otherwise(F.lit("~"))
    sizes = docs.select(F.col("doc_id"), key.alias("source_key"), F.col("text")).mapInArrow(_sizes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source_key string, size long")
    rows = written(sizes.withColumn("row", F.monotonically_increasing_id()), "sized")
    totals = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    named = numbered(totals, "source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = written(named.withColumn("weight", weight.cast("long")), "sources")
    level, cap = _level(sources, most), F.col("source_size") * most
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return Sized(rows, sources.withColumns({"target": target, "goal": F.floor(target + 0.5)}))


def _level(sources: DataFrame, most: int) -> float:
    """Words for each unit of weight: sources that would be above their cap stop there, and the others share the rest, until none is above."""
    cap = F.col("source_size") * most
    level = -1.0
    while True:
        stopped = cap <= F.lit(level) * F.col("weight")
        total, given, left = sources.agg(F.sum("source_size"), F.sum(F.when(stopped, cap).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("weight")))).first()
        rest = (total - given) / left if left else max(level, 0.0)
        if rest <= level or not left:
            return rest
        level = rest


def _before(amount: Column, part: list[str], *order: str) -> Column:
    """The sum of ``amount`` over the rows before in the window."""
    window = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(window), F.lit(0))


def streams(found: Sized, seed: int = 0) -> DataFrame:
    """row, doc_id, size, number, copy, start and words (taken) of every document for each time its source is repeated."""
    given = found.sources.where("goal > 0").select("source_key", "number", "source_size", "docs", "goal")
    rows = found.rows.where("size > 0").join(given, "source_key").withColumn("copy", F.explode(F.expr("sequence(0L, (goal - 1) div source_size)")))
    order = F.md5(F.concat_ws(":", F.lit(seed), "copy", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("docs") / BUCKET)), F.lit(0)), F.lit(2 * BITS)).cast("int")
    rows = rows.withColumns({"order": order, "bits": bits})
    bucket = F.call_function("div", F.conv(F.substring("order", 1, 2 * BITS // 4), 16, 10).cast("long"), F.pow(F.lit(2), 2 * BITS - F.col("bits")).cast("long"))
    coarse = F.call_function("div", F.col("bucket"), F.pow(F.lit(2), F.greatest(F.col("bits") - BITS, F.lit(0))).cast("long"))
    rows = rows.withColumn("bucket", bucket).withColumn("coarse", coarse)
    stream = ["number", "copy"]
    fine = rows.groupBy(*stream, "coarse", "bucket").agg(F.sum("size").alias("held"))
    high = fine.groupBy(*stream, "coarse").agg(F.sum("held").alias("held")).select(*stream, "coarse", _before(F.col("held"), stream, "coarse").alias("base"))
    fine = fine.join(high, [*stream, "coarse"]).select(*stream, "bucket", (F.col("base") + _before(F.col("held"), [*stream, "coarse"], "bucket")).alias("base"))
    placed = rows.join(fine, [*stream, "bucket"])
    start = F.col("copy") * F.col("source_size") + F.col("base") + _before(F.col("size"), [*stream, "bucket"], "order", "doc_id", "size", "row")
    placed = placed.withColumn("start", start)
    return placed.select("row", "doc_id", "size", *stream, "goal", "start", F.greatest(F.least("size", F.col("goal") - F.col("start")), F.lit(0)).alias("words"))


# --- the tree --------------------------------------------------------------------------------------------------------


def _halves(first: int, shards: int, quotas: np.ndarray, offsets: np.ndarray, seed: int):
    """The two children of a node, as (first shard, shards, quotas, offsets)."""
    left = shards // 2
    draw = np.random.default_rng([seed, first, shards]).multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return (first, left, draw, offsets), (first + left, shards - left, quotas - draw, offsets + draw)


_NODE = "first long, shards long, quotas array<long>, offsets array<long>"


def _expand(down_to: int, seed: int):
    """Nodes of more shards than ``down_to`` are replaced by their children until none is left."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node in batch.to_pylist():
                open_ = [(node["first"], node["shards"], np.array(node["quotas"], dtype=np.int64), np.array(node["offsets"], dtype=np.int64))]
                while open_:
                    some = open_.pop()
                    if some[1] > down_to:
                        open_ += _halves(*some, seed)
                    else:
                        columns = [pa.array([some[0]]), pa.array([some[1]]), pa.array([some[2].tolist()], pa.list_(pa.int64())), pa.array([some[3].tolist()], pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["first", "shards", "quotas", "offsets"])

    return task


def split_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """shard, number, first_block, blocks: which of the permuted blocks of each source (number, blocks) a shard has."""
    named = F.array_sort(F.collect_list(F.struct("number", "blocks")))
    root = quotas.agg(named.alias("q"))
    numbers = root.select(F.col("q.number").alias("numbers"))
    root = root.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("shards"), F.col("q.blocks").alias("quotas"), F.transform("q", lambda x: F.lit(0).cast("long")).alias("offsets"))
    top = root.mapInArrow(_expand(-(-shards // SUBTREES), seed), _NODE)
    leaves = top.repartition(SUBTREES, "first").mapInArrow(_expand(1, seed), _NODE)
    each = leaves.crossJoin(F.broadcast(numbers)).select(F.col("first").alias("shard"), F.explode(F.arrays_zip("numbers", "offsets", "quotas")).alias("x"))
    return each.select("shard", F.col("x.numbers").alias("number"), F.col("x.offsets").alias("first_block"), F.col("x.quotas").alias("blocks")).where("blocks > 0")


def mix(found: Sized, seed: int = 0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """row, doc_id, number (of the source), copy, words, shard and position of every draw.

    ``words`` are all of the document's but for the last document of a source. Each shard has a whole number of blocks of each source.
    """
    total = found.sources.agg(F.sum("goal")).first()[0] or 0
    block = max(block_words, -(-total // MOST_BLOCKS))
    quotas = found.sources.where("goal > 0").select("number", F.expr(f"(goal + {block - 1}) div {block}").alias("blocks"))
    dealt = split_tree(quotas, max(1, -(-total // shard_words)), seed).select("shard", "number", F.explode(F.expr("sequence(first_block, first_block + blocks - 1)")).alias("block"))
    # A prime that does not divide the number of blocks permutes them; no number of blocks is divided by both.
    prime = F.when(F.col("blocks") % 1_000_003 != 0, F.lit(1_000_003)).otherwise(F.lit(998_244_353)).cast("long")
    drawn = streams(found, seed).where("words > 0").withColumn("blocks", F.expr(f"(goal + {block - 1}) div {block}"))
    drawn = drawn.withColumn("block", (F.expr(f"start div {block}") * (prime % F.col("blocks")) + seed) % F.col("blocks"))
    placed = drawn.join(dealt, ["number", "block"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "doc_id", "copy"), "row")
    return placed.select("row", "doc_id", "number", "copy", "words", "shard", F.row_number().over(local).alias("position"))


def taken(found: Sized, draws: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    words = draws.groupBy("row").agg(F.sum("words").alias("taken"))
    rows = found.rows.join(found.sources.select("source_key", "source_size", "target"), "source_key").join(words, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
