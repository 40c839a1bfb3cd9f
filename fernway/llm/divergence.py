"""Audit of sources: which terms set a source apart from its language, and how far the sources of a language lie from each other.

Terms are counted by (language, source) in Arrow batches, in as many rows as a slice has distinct terms, and summed by Spark. A term
that at least ``LEAST_DOCS`` documents of a language hold is kept. Frequencies are whole numbers, parts of a thousand million with one
added to each count, so that every value is exact.

*Pairs*. A sum over all kept terms for each pair of sources starts from what a term that neither has gives, times all kept terms. Two
corrections follow: for each source by its distinct frequencies (as if the other had none of its terms), and for terms of both.
Terms that a pair lacks cost nothing.

*Ranks*. The ``k``-th largest value of every group is selected by radix: histograms of 16 bits of the values, from the highest down, each
only over the values that share the threshold's bits so far. Ties at the threshold are refined likewise by the bytes of the terms, two
at a time after those that all tied terms share. No group is ever sorted but its first ``k``; histograms have 65,793 rows a group at most.

Defined results: null texts, languages and sources are empty ones; documents without terms count as members of their group alone; a
repeated row counts as a document of its own; other columns are not looked at; an empty table gives no rows. The pairs of a language, and
the sources that share a term, are held side by side: a language of 10,000 sources has a hundred million pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fernway.llm.common import slices
from fernway.llm.runs import _changes, _ranges
from fernway.llm.words import translated, words_of
from fernway.operators.rounds import written

LEAST_DOCS, TOP = 3, 200
#: Bits of a value, and bytes of a term, that one histogram tells apart.
BITS, BYTES = 16, 2
#: Pairs of sources that are looked at side by side.
PAIRS = 1 << 20

#: A-Z to a-z; bytes that are neither letters nor parts of longer characters to a space.
LETTER_TABLE = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

GROUP = ["lang", "source"]
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents of each term by language and source."""
    words, first = words_of(translated(batch.column("text"), LETTER_TABLE))
    encoded = words.dictionary_encode()
    kinds = max(1, len(encoded.dictionary))
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
    keys, n = np.unique(doc * kinds + encoded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    keys = group[keys // kinds] * kinds + keys % kinds
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    heads = np.flatnonzero(_changes(keys))
    summed = np.add.reduceat(n, heads) if len(heads) else n
    docs, keys = np.diff(heads, append=len(keys)), keys[heads]
    of, names = keys // kinds, max(1, len(source.dictionary))
    columns = [lang.dictionary.take(pa.array(of // names)), source.dictionary.take(pa.array(of % names)), encoded.dictionary.take(pa.array(keys % kinds)).cast(pa.string()), pa.array(summed, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 8 << 20):
                yield _counted(some)

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(task, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + terms)), in two steps that stay below 2^63 for 9 * 10^13 words."""
    of, scaled = total + terms, (n + 1) * F.lit(100_000)
    return F.lit(1) + _div(scaled, of) * 10_000 + _div((scaled % of) * 10_000, of)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


@dataclass(frozen=True)
class Audit:
    """Kept terms of the groups (lang, source, term, n, total: occurrences in the language) and the groups with terms, total and base frequency."""

    kept: DataFrame
    groups: DataFrame


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> Audit:
    """Count once and keep the tables for the ranks and the pairs."""
    counts = written(term_counts(docs), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(counts.drop("docs").join(terms, ["lang", "term"]), "kept-terms")
    languages = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    every = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in GROUP]).distinct()
    groups = every.join(kept.groupBy(*GROUP).agg(F.sum("n").alias("group_total")), GROUP, "left").join(languages, "lang", "left").na.fill(0, ["group_total", "terms", "lang_total"])
    base = F.when(F.col("terms") > 0, frequency(F.lit(0), F.col("group_total"), F.col("terms")))
    return Audit(kept, written(groups.withColumn("base", base), "audit-groups"))


# --- ranks -----------------------------------------------------------------------------------------------------------


def telling_terms(found: Audit) -> DataFrame:
    """lang, source, item, value of every kept term that is more frequent in a group than in its language."""
    p, q = frequency(F.col("n"), F.col("group_total"), F.col("terms")), frequency(F.col("total"), F.col("lang_total"), F.col("terms"))
    rows = found.kept.join(found.groups, GROUP).select(*GROUP, F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    return rows.where("p > q").select(*GROUP, "item", distance(F.col("p"), F.col("q")).alias("value"))


def _cut(histogram: DataFrame, digit: Column) -> DataFrame:
    """Of each group's histogram the bucket in which the ``need``-th row lies, in the order of ``digit``, and what is needed from it."""
    running = Window.partitionBy(*GROUP).orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = histogram.withColumn("upto", F.sum("count").over(running))
    return rows.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("count") < F.col("need"))).withColumn("need", F.col("need") - F.col("upto") + F.col("count"))


def _shared(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of bytes that begin both ``low`` and ``high``."""
    for batch in pairs:
        lengths = []
        for a, b in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
            n = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
            lengths.append(int(differ[0]) if len(differ) else n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int32())], names=[*batch.schema.names, "skip"])


def thresholds(rows: DataFrame, k: int) -> DataFrame:
    """lang, source, threshold, width, tie: the first ``k`` of a group are those above the threshold, and of those at it the ones whose first
    ``width`` bytes are not above ``tie`` (null: all). Groups of not more than ``k`` rows are left out. ``rows``: lang, source, item, value
    (>= 0), written."""
    state = rows.groupBy(*GROUP).count().where(F.col("count") > k).select(*GROUP, F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
    values = rows.select(*GROUP, "value")
    for shift in range(64 - BITS, -1, -BITS):
        live = values.join(state, GROUP)
        if shift + BITS < 64:
            live = live.where(F.shiftright("value", shift + BITS) == F.col("prefix"))
        digit = F.shiftright("value", shift).bitwiseAND(F.lit((1 << BITS) - 1))
        histogram = live.groupBy(*GROUP, "prefix", "need", digit.alias("digit")).count()
        state = written(_cut(histogram, F.desc("digit")).select(*GROUP, (F.shiftleft("prefix", BITS) + F.col("digit")).alias("prefix"), "need", "count"), "threshold")
    state = state.withColumnRenamed("prefix", "threshold")
    done = state.where(F.col("count") == F.col("need")).select(*GROUP, "threshold", F.lit(None).cast("int").alias("width"), F.lit(None).cast("binary").alias("tie"))
    open_ = state.where(F.col("count") > F.col("need"))
    if open_.isEmpty():
        return done
    item = F.col("item").cast("binary")
    ties = rows.join(open_.select(*GROUP, "threshold", F.col("need").alias("_need")), GROUP).where("value = threshold")
    ties = written(ties.select(*GROUP, "threshold", item.alias("item")), "ties")
    open_ = open_.join(ties.groupBy(*GROUP).agg(F.min("item").alias("low"), F.max("item").alias("high")), GROUP).drop("count")
    while True:
        # All that are still tied begin with the same bytes, which are skipped.
        schema = T.StructType([*open_.schema.fields, T.StructField("skip", T.IntegerType())])
        at = open_.mapInArrow(_shared, schema).withColumn("prefix", F.expr("substring(low, 1, skip)")).drop("low", "high")
        live = ties.join(at.drop("threshold"), GROUP).where(F.expr("substring(item, 1, skip) = prefix"))
        width = (F.col("skip") + BYTES).alias("width")
        histogram = live.groupBy(*GROUP, "threshold", "need", width, F.expr(f"substring(item, 1, skip + {BYTES})").alias("tie")).agg(F.count("*").alias("count"), F.min("item").alias("low"), F.max("item").alias("high"))
        state = written(_cut(histogram, F.asc("tie")), "tie")
        done = done.unionByName(state.where(F.col("count") == F.col("need")).select(*GROUP, "threshold", "width", "tie"))
        open_ = state.where(F.col("count") > F.col("need")).select(*GROUP, "threshold", "need", "low", "high")
        if open_.isEmpty():
            return done


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` from 1 in each group, by value, largest first, then by the bytes of the item."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def top_terms(found: Audit, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the ``k`` terms of each group that set it apart most."""
    rows = written(telling_terms(found), "telling-terms")
    limits = thresholds(rows, k)
    within = F.col("threshold").isNull() | (F.col("value") > F.col("threshold")) | ((F.col("value") == F.col("threshold")) & (F.col("tie").isNull() | (F.expr("substring(cast(item AS binary), 1, width)") <= F.col("tie"))))
    return ranked(rows.join(limits, GROUP, "left").where(within).select(*GROUP, "item", "value"))


# --- pairs -----------------------------------------------------------------------------------------------------------


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources share add to the pair beyond the corrections for each alone, summed over a stretch of terms."""

    def value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    for batch in batches:
        holders = batch.column("holders")
        size = pa.compute.list_value_length(holders).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = holders.flatten()
        names, p, base = flat.field("source").dictionary_encode(), flat.field("p").to_numpy(), flat.field("base").to_numpy()
        langs = batch.column("lang").dictionary_encode()
        source, width = names.indices.to_numpy().astype(np.int64), max(1, len(names.dictionary))
        lang = np.repeat(langs.indices.to_numpy().astype(np.int64), size)
        begin, partners = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
        upto = np.cumsum(partners)
        low = 0
        while low < len(partners):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, side="right")))
            s = np.repeat(np.arange(low, high), partners[low:high])
            t = _ranges(begin[low:high], partners[low:high])
            s, t = s[s != t], t[s != t]
            more = value(p[s], p[t]) - value(p[s], base[t]) - value(base[s], p[t]) + value(base[s], base[t])
            key = (lang[s] * width + source[s]) * width + source[t]
            order = np.argsort(key, kind="stable")
            key, more = key[order], more[order]
            heads = np.flatnonzero(_changes(key))
            total, key = np.add.reduceat(more, heads) if len(heads) else more, key[heads]
            columns = [langs.dictionary.take(pa.array(key // width // width)), names.dictionary.take(pa.array(key // width % width)), names.dictionary.take(pa.array(key % width)), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])
            low = high


def source_pairs(found: Audit) -> DataFrame:
    """lang, source, item (another source of the language), value (summed over all kept terms), rank."""
    groups = found.groups
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
    neither = distance(F.col("base"), F.col("other_base"))
    every = groups.join(other, "lang").where("source <> item").select(*GROUP, "item", F.coalesce(F.col("terms") * neither, F.lit(0)).alias("value"))
    p = frequency(F.col("n"), F.col("group_total"), F.col("terms"))
    terms = found.kept.join(groups, GROUP).select(*GROUP, "term", "base", p.alias("p"))
    by_frequency = terms.groupBy(*GROUP, "base", "p").agg(F.count("*").alias("m")).join(other, "lang").where("source <> item")
    own = by_frequency.select(*GROUP, "item", (F.col("m") * (distance(F.col("p"), F.col("other_base")) - neither)).alias("value"))
    of_other = by_frequency.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (distance(F.col("other_base"), F.col("p")) - distance(F.col("other_base"), F.col("base")))).alias("value"))
    holders = terms.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("holders")).where(F.size("holders") > 1).select("lang", "holders")
    both = holders.mapInArrow(_shared_terms, "lang string, source string, item string, value long")
    summed = every.unionByName(own).unionByName(of_other).unionByName(both).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    return ranked(summed)
