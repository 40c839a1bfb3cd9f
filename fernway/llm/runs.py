"""Periodic runs of words, found by refining classes of equal factors.

A class holds the places of a text at which the same ``level`` words begin. From level to level a class splits by the classes of the
places one word on, and only members of small classes, all parts of a split but its largest, are looked at (Crochemore's smaller
half), so a place is looked at a logarithmic number of times. The members of a class are linked in order of place. Two neighbours at a
distance equal to the level are a square whose root is no repetition itself; squares of one period at consecutive places are one run.

All texts of a slice are refined side by side in arrays: each text ends with a symbol of its own, so that no class reaches beyond it.
A text is refined in one task, which takes about 100 bytes a word.

Defined results: null and blank texts have no words and no runs; repeated rows are treated alike; ids are not looked at; a
column named as the result is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernway.llm.common import fresh, slices
from fernway.llm.words import joined, words_of

#: Words that a run has at least.
LEAST = 12
#: Bytes of texts refined side by side: a step costs the same time for one text and for many.
SLICE = 8 << 20

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def _changes(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where a group begins: True at the first element and wherever one of the arrays differs from the element before."""
    first = np.ones(len(sorted_arrays[0]), dtype=bool)
    first[1:] = False
    for a in sorted_arrays:
        first[1:] |= a[1:] != a[:-1]
    return first


def _lengths(heads: np.ndarray, end: int) -> np.ndarray:
    """The lengths of groups that begin at ``heads``; the last one ends at ``end``."""
    lengths = np.empty_like(heads)
    np.subtract(heads[1:], heads[:-1], out=lengths[:-1])
    if len(heads):
        lengths[-1] = end - heads[-1]
    return lengths


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] of them) for each i, one after another."""
    begins = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(begins - start, count)


class Classes:
    """Places by the factor that begins there. A class is a stretch of ``members``; its places are linked in order by ``after`` and ``before``."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.members = np.argsort(symbols, kind="stable")
        first = _changes(symbols[self.members])
        begins = np.flatnonzero(first)
        self.count = len(begins)
        self.begin = np.zeros(2 * n + 16, dtype=np.int64)
        self.size = np.zeros(2 * n + 16, dtype=np.int64)
        self.begin[: self.count] = begins
        self.size[: self.count] = _lengths(begins, n)
        self.of = np.empty(n, dtype=np.int64)
        self.of[self.members] = np.cumsum(first) - 1
        self.at = np.empty(n, dtype=np.int64)
        self.at[self.members] = np.arange(n)
        self.after, self.before = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        linked = np.flatnonzero(~first)
        self.after[self.members[linked - 1]] = self.members[linked]
        self.before[self.members[linked]] = self.members[linked - 1]
        #: Places in the small classes, in order.
        self.small = np.arange(n)

    def _named(self, more: int) -> int:
        """Room for as many new classes; the number of the first."""
        if self.count + more > len(self.begin):
            self.begin, self.size = (np.concatenate((a, np.zeros(max(more, len(a)), dtype=np.int64))) for a in (self.begin, self.size))
        self.count += more
        return self.count - more

    def refine(self) -> np.ndarray:
        """Classes of factors one word longer; the places whose next neighbour is another now."""
        by = self.small[self.small > 0]
        place = by - 1
        worth = self.size[self.of[place]] > 1
        place, by = place[worth], self.of[by[worth]]
        old = self.of[place]
        order = np.argsort((old << 32) + by, kind="stable")
        place, old, by = place[order], old[order], by[order]
        heads = np.flatnonzero(_changes(old, by))
        part_size, part_old = _lengths(heads, len(place)), old[heads]
        splits = np.flatnonzero(_changes(part_old))
        split_of = np.repeat(np.arange(len(splits)), _lengths(splits, len(heads)))
        split_old = part_old[splits]
        rest = self.size[split_old] - np.add.reduceat(part_size, splits) if len(splits) else np.zeros(0, dtype=np.int64)
        largest = np.maximum.reduceat(part_size, splits) if len(splits) else rest
        # The first of the largest parts: it keeps the old name where nothing else does, and is not looked at again if it is larger than the rest.
        is_largest = part_size == largest[split_of]
        is_largest &= _first_true(is_largest, split_of)
        stays = is_largest & (rest[split_of] == 0)
        moves = ~stays
        again = moves & ~(is_largest & (part_size > rest[split_of]))
        rest_again = split_old[(rest > 0) & (largest > rest)]
        element_moves = np.repeat(moves, part_size)
        place, old = place[element_moves], old[element_moves]
        sizes, again = part_size[moves], again[moves]
        if not len(place):
            self.small = np.zeros(0, dtype=np.int64)
            return self.small
        changed = self._unlink(place, old)
        name = self._named(len(sizes)) + np.arange(len(sizes))
        self._move(place, old, name, sizes)
        first = np.zeros(len(place), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        linked = np.flatnonzero(~first)
        self.after[place], self.before[place] = -1, -1
        self.after[place[linked - 1]] = place[linked]
        self.before[place[linked]] = place[linked - 1]
        stayed = self.members[_ranges(self.begin[rest_again], self.size[rest_again])]
        self.small = np.sort(np.concatenate((place[np.repeat(again, sizes)], stayed)))
        return np.concatenate((changed, place[linked - 1]))

    def _unlink(self, place: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Take the places out of the lists of their classes; those before them whose next neighbour is another now."""
        order = np.lexsort((place, old))
        place, old = place[order], old[order]
        breaks = np.ones(len(place), dtype=bool)
        breaks[1:] = self.before[place[1:]] != place[:-1]
        heads = np.flatnonzero(breaks)
        left, right = self.before[place[heads]], self.after[place[np.append(heads[1:], len(place)) - 1]]
        self.after[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        return left[(left >= 0) & (right >= 0)]

    def _move(self, place: np.ndarray, old: np.ndarray, name: np.ndarray, sizes: np.ndarray) -> None:
        """The places, sorted by class and part, go to the end of their class's stretch, which becomes the stretches of the parts."""
        heads = np.flatnonzero(_changes(old))
        moved, olds = _lengths(heads, len(place)), old[heads]
        tail = self.begin[olds] + self.size[olds] - moved
        slots = _ranges(tail, moved)
        # Members at the end that stay change places with those that move from further ahead.
        self.of[place] = -1
        ousted = self.members[slots]
        ousted = ousted[self.of[ousted] >= 0]
        at = self.at[place]
        vacant = at[at < np.repeat(tail, moved)]
        self.members[vacant], self.at[ousted] = ousted, vacant
        self.members[slots], self.at[place] = place, slots
        self.size[olds] -= moved
        self.of[place] = np.repeat(name, sizes)
        self.begin[name], self.size[name] = slots[np.cumsum(sizes) - sizes], sizes


def _first_true(flags: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True where a flag is the first of its group; groups lie side by side."""
    at = np.flatnonzero(flags)
    first = np.zeros(len(flags), dtype=bool)
    first[at[_changes(group[at])]] = True
    return first


class Gaps:
    """Places by the distance to the next of their class, ready for the level that equals it.

    Distances up to the next power of two are sorted when a level reaches a power of two; those that come meanwhile are kept by distance.
    """

    def __init__(self, classes: Classes):
        self.classes, self.top = classes, 1

    def _sort(self, level: int) -> None:
        after, self.low, self.top = self.classes.after, level, 2 * level
        place = np.flatnonzero(after >= 0)
        gap = after[place] - place
        near = (gap >= level) & (gap < self.top)
        place, gap = place[near], gap[near]
        order = np.argsort(gap, kind="stable")
        self.places, self.first = place[order], np.searchsorted(gap[order], np.arange(level, self.top + 1))
        self.late: dict[int, list[np.ndarray]] = defaultdict(list)

    def note(self, place: np.ndarray, level: int) -> None:
        """Places whose next neighbour is another from this level on."""
        if level >= self.top:
            return
        gap = self.classes.after[place] - place
        near = (gap >= level) & (gap < self.top)
        if near.any():
            place, gap = place[near], gap[near]
            order = np.argsort(gap, kind="stable")
            place, gap = place[order], gap[order]
            heads = np.flatnonzero(_changes(gap))
            for g, some in zip(gap[heads].tolist(), np.split(place, heads[1:]), strict=True):
                self.late[g].append(some)

    def at(self, level: int) -> np.ndarray:
        """The places, in order, whose next neighbour is as far as the level."""
        if level >= self.top:
            self._sort(level)
        found = self.places[self.first[level - self.low] : self.first[level - self.low + 1]]
        if late := self.late.pop(level, None):
            found = np.unique(np.concatenate((found, *late)))
        return found[self.classes.after[found] - found == level] if len(found) else found


def runs_of(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Start, length and period of every run, by start and period; ``longest``: words of the longest text.

    ``symbols``: numbers of the words, different for different words and different texts, each text with a number of its own at its end.
    """
    classes, found = Classes(symbols), []
    gaps = Gaps(classes)
    for level in range(1, longest // 2 + 1):
        if level > 1:
            gaps.note(classes.refine(), level)
        square = gaps.at(level)
        if len(square):
            heads = np.flatnonzero(_changes(square - np.arange(len(square))))
            length = _lengths(heads, len(square)) - 1 + 2 * level
            start = square[heads]
            long = length >= LEAST
            found.append(np.stack((start[long], length[long], np.full(int(long.sum()), level)), axis=1))
        if not len(classes.small):
            break
    runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _symbols(words: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word and, at the end of each text, one of its own; where the texts begin."""
    texts, encoded = len(first) - 1, words.dictionary_encode()
    kinds = len(encoded.dictionary) + 1
    text = np.repeat(np.arange(texts), np.diff(first))
    symbols = np.empty(len(words) + texts, dtype=np.int64)
    symbols[np.arange(len(words)) + text] = text * kinds + encoded.indices.to_numpy(zero_copy_only=False)
    symbols[first[1:] + np.arange(texts)] = np.arange(texts) * kinds + kinds - 1
    return symbols, first[:-1] + np.arange(texts)


def _of_slice(texts: pa.Array) -> pa.StructArray:
    words, first = words_of(texts)
    n = np.diff(first)
    symbols, begins = _symbols(words, first)
    runs = runs_of(symbols, int(n.max(initial=0)))
    text = np.searchsorted(begins, runs[:, 0], side="right") - 1
    # Dropped words: those of a run after its first period.
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = runs[:, 0] - text
    np.add.at(edge, at + runs[:, 2], 1)
    np.add.at(edge, at + runs[:, 1], -1)
    stays = np.cumsum(edge)[:-1] == 0
    collapsed = joined(words.filter(pa.array(stays)), np.concatenate(([0], np.cumsum(stays)))[first])
    fields = [pa.array(c) for c in (runs[:, 0] - begins[text], runs[:, 1], runs[:, 2])]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(n) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.StructArray.from_arrays([pa.array(n), lists, collapsed], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", into: str = "periodic") -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start and period) and collapsed in a column ``into``.

    A run is a stretch of words with its smallest period, of at least ``LEAST`` words and two periods, that reaches as far as the period
    holds. ``collapsed`` is the text, with one space between words, without the words of a run after its first period.
    """
    docs = docs.drop(into) if into != text else docs
    key = fresh(docs, "_text")
    rows = docs.withColumn(key, F.col(text))
    schema = T.StructType([*docs.schema.fields, T.StructField(into, RESULT)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, key, SLICE):
                found = _of_slice(some.column(key))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], found], names=schema.names)

    return rows.mapInArrow(task, schema)


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with texts of words one space apart, of which about each tenth repeats a part of itself up to its end.

    Let h be the crc32 of the id as a decimal and g = h / 10. Where h is divisible by ten, word i from a = g % n on becomes word
    a + (i - a) % p of the text, with p = 1 + (n - a) / (3 + g % 8), rounded down. A null id leaves the words as they are.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE):
                words, first = words_of(some.column("text"))
                n, h = np.diff(first), some.column("_h").to_numpy(zero_copy_only=False)
                g, turned = h // 10, (h % 10 == 0) & (n > 0)
                a = np.where(turned, g % np.maximum(n, 1), n)
                p = 1 + (n - a) // (3 + g % 8)
                place = np.arange(len(words)) - np.repeat(first[:-1], n)
                from_, period = np.repeat(a, n), np.repeat(p, n)
                place = np.where(place >= from_, from_ + (place - from_) % period, place) + np.repeat(first[:-1], n)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), joined(words.take(pa.array(place)), first)], names=["doc_id", "text"])

    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1)).alias("_h")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType())])
    return docs.select("doc_id", "text", h).mapInArrow(task, schema)
