"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised word windows.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is 13 consecutive words of an
item; an item with fewer words, but not none, is one window. The windows, as rows of word numbers with one 64-bit hash
each, are broadcast; each document is turned into word numbers (0: not a benchmark word), its windows of known words are
hashed, looked up and verified word by word. One pass, no shuffle.

The broadcast holds at most ``max_windows`` windows. A larger benchmark is scanned in as many passes as it takes, each with
its own part of the windows, with the hits of earlier passes carried along in the rows.

Defined results: a null text has no words; an empty benchmark hits nothing; items without words or without id are
skipped; repeated items and rows count once per distinct id; a column with the name of the result is replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernway.llm.common import ALNUM_TABLE, fresh, slices
from fernway.operators.rounds import cut

WINDOW = 13
#: Windows in one broadcast. 100,000 of 13 words, of 50,000 distinct ones, took 14 MB, and 32 MB while they were built.
MAX_WINDOWS = 500_000

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


class WindowSet:
    """Distinct windows by length: word numbers, sorted hashes and the places of the items that hold each window."""

    def __init__(self, table: pa.Table):
        """``table``: window (words joined by a space) and item, pairs of them once each."""
        windows, items = (table.column(c).combine_chunks().dictionary_encode() for c in ("window", "item"))
        self.items: list[str] = items.dictionary.to_pylist()
        of_window, of_item = windows.indices.to_numpy(), items.indices.to_numpy()
        order = np.argsort(of_window, kind="stable")
        self.holders = of_item[order].astype(np.int32)
        first = np.searchsorted(of_window[order], np.arange(len(windows.dictionary) + 1))
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        numbers, lengths = array("i"), np.zeros(len(windows.dictionary), dtype=np.int64)
        for i, window in enumerate(windows.dictionary):
            words = window.as_py().split()
            numbers.extend([number(w, len(self.vocabulary) + 1) for w in words])
            lengths[i] = len(words)
        flat, begins = np.frombuffer(numbers, dtype=np.int32), np.cumsum(lengths) - lengths
        self.by_length = []
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            words = flat[begins[mine][:, None] + np.arange(length)]
            seed = length
            while True:
                factors = np.random.default_rng(seed).integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
                hashes = np.zeros(len(words), dtype=np.uint64)
                for j in range(length):
                    hashes += words[:, j].astype(np.uint64) * factors[j]
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1000
            order = np.argsort(hashes)
            self.by_length.append((length, factors, hashes[order], words[order], first[mine][order], first[mine + 1][order]))

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: number of words, which words are hit, items with occurring windows."""
        get = self.vocabulary.get
        lists = [[] if t is None else t.translate(ALNUM_TABLE).split() for t in texts]
        starts = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum([len(x) + 1 for x in lists], out=starts[1:])
        ids = np.zeros(starts[-1], dtype=np.int32)
        for at, words in zip(starts[:-1].tolist(), lists, strict=True):
            if words:
                ids[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        unknown = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(ids == 0, out=unknown[1:])
        hit = np.zeros(len(ids) + 1, dtype=np.int32)
        items: dict[int, set[str]] = {}
        for length, factors, hashes, known, first, past in self.by_length:
            if len(ids) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            value = np.zeros(len(at), dtype=np.uint64)
            for j in range(length):
                value += ids[at + j].astype(np.uint64) * factors[j]
            place = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            found = np.flatnonzero(hashes[place] == value)
            if not len(found):
                continue
            at, place = at[found], place[found]
            same = (ids[at[:, None] + np.arange(length)] == known[place]).all(axis=1)
            at, place = at[same], place[same]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
            document = np.searchsorted(starts, at, side="right") - 1
            for d, p in set(zip(document.tolist(), place.tolist(), strict=True)):
                items.setdefault(d, set()).update(self.items[i] for i in self.holders[first[p] : past[p]].tolist())
        covered = np.cumsum(hit[:-1]) > 0
        return [(len(w), covered[s : s + len(w)], items.get(d, set())) for d, (s, w) in enumerate(zip(starts[:-1].tolist(), lists, strict=True))]


def spans_of(mask: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true values, alternating."""
    if not mask.any():
        return []
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()


def benchmark_windows(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window, item_id as string): the windows of each item, words joined by a space."""

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = raw.translate(ALNUM_TABLE).split()
                out += {(b" ".join(words[i : i + window]), item) for i in range(max(1, len(words) - window + 1)) if words}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["window", "item"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("raw")).dropna()
    return rows.mapInArrow(cut_windows, "window binary, item string").distinct()


def _scan_pass(docs: DataFrame, windows: WindowSet, text: str, into: str) -> tuple[DataFrame, Broadcast]:
    raw_name = fresh(docs, "_raw")
    schema = T.StructType([f for f in docs.schema.fields if f.name != into] + [T.StructField(into, RESULT)])
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    carried = into in docs.columns
    kept = [f.name for f in schema.fields[:-1]]
    result_type = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_spans", pa.list_(pa.int64())), ("item_ids", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, raw_name):
                before = batch.column(into).to_pylist() if carried else [None] * batch.num_rows
                out = []
                for (n, mask, items), old in zip(shared.value.scan(batch.column(raw_name).to_pylist()), before, strict=True):
                    if old:
                        mask = mask.copy()
                        for a, b in zip(old["hit_spans"][::2], old["hit_spans"][1::2], strict=True):
                            mask[a:b] = True
                        items = items.union(old["item_ids"])
                    out.append({"n_words": n, "n_hit": int(mask.sum()), "hit_spans": spans_of(mask), "item_ids": sorted(items)})
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, result_type)], [*kept, into])

    return docs.withColumn(raw_name, F.col(text).cast("binary")).mapInArrow(scan, schema), shared


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    into: str = "decontamination",
) -> DataFrame:
    """Every row of ``docs`` with a struct: n_words, n_hit, hit_spans (word starts and ends, alternating) and item_ids."""
    windows = benchmark_windows(benchmark, item_id=item_id, text=item_text, window=window)
    docs = docs.drop(into)
    first = windows.limit(max_windows + 1).toArrow()
    if first.num_rows <= max_windows:
        return _scan_pass(docs, WindowSet(first), text, into)[0]
    windows = cut(windows)
    parts = -(-2 * windows.count() // max_windows)
    for k in range(parts):
        part = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == k).toArrow()
        found, shared = _scan_pass(docs, WindowSet(part), text, into)
        docs = cut(found)
        shared.destroy()
    return docs


def is_contaminated(into: str = "decontamination", share: int = 20) -> F.Column:
    """At least one word in ``share`` is hit."""
    return (F.col(f"{into}.n_hit") > 0) & (F.lit(share) * F.col(f"{into}.n_hit") >= F.col(f"{into}.n_words"))
