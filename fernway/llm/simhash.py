"""SimHash near-duplicates: segment popcounts, a grid join under Manhattan distance, exact verification, components.

Fingerprint: lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``, all 4-word shingles, XXH64 (seed 42) of each, a bit is set if it is
set in over half of them. Equal fingerprints are one class; classes link at 4 or fewer differing bits.

Candidates: the 64 bits are 32 segments of two; the embedding holds the number of set bits of each (0 to 2). The Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints. A range join in all 32 dimensions would have to
look into every cell within distance 4, some 10^6 of them; but a pair at distance 4 or less differs in at most 4 dimensions. So the
segments form 8 bands, at most 4 of which can differ; each fingerprint goes to the 70 cells of the grids over the subspaces
of four bands, in which such a pair lies at distance 0, and all pairs within the range meet in at least one cell. With 35,873
fingerprints of the check tool's 0.1 GB a cell held 1.006 on average and 13 at most. Four bands of popcounts agree by chance at
(3/8)^16, so that with more than ``WIDE`` fingerprints the segments are of one bit, 64 of them: then four bands agree by chance at
2^-32, and a cell holds some 23 of 10^11 where it would hold 15,000. The proof and the links are the same. Within a cell, sorted by Spark and streamed, pairs pass the Manhattan
bound and then the exact distance. A crowded cell emits a spanning forest, found by breadth-first search over what is still
unvisited, not its pairs; it is held in memory, 8 bytes a fingerprint.

Components are found among the smallest ids of the classes, so that a component's root is its id. Classes of very many rows are
named by broadcast, all others by a join.

Defined results: a text without words, or null, has fingerprint zero and links like any other; repeated rows are one class; an
empty table gives no rows; null ids get the smallest id of their component, null if it has none; other columns are ignored; ids
must be numbers or texts of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernway.llm.common import LOWER_TABLE, fresh, slices
from fernway.llm.components import connected_components
from fernway.operators.rounds import cut, written

SHINGLE, SEED, MOST_BITS = 4, 42, 4
BANDS, EQUAL = 8, 4
#: A class has very many rows if it has more than this and more than one of ``SHARE`` of all, which fewer than ``SHARE`` classes can have.
MANY, SHARE = 1000, 10_000
#: With more fingerprints than this the segments are of one bit, where two-bit ones would share a cell with more than one other by chance.
WIDE = 5_000_000
#: Cells with up to so many fingerprints have their pairs tested all at once, in arrays.
SMALL_CELL = 8

_TABLES = list(combinations(range(BANDS), EQUAL))
_ODD = 0x5555555555555555


def fingerprint_of(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    import xxhash

    words = raw.translate(LOWER_TABLE).split() if raw else []
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint as a signed long) for every row, and the long columns ``carried``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "raw"):
                found = np.array([fingerprint_of(t, shingle) for t in batch.column("raw").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *[batch.column(c) for c in carried]], ["doc_id", "fp", *carried])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw"), *carried)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{c} long" for c in carried]]))


def popcounts(fp: Column, width: int = 2) -> Column:
    """The embedding: the number of set bits of each segment, 32 two-bit numbers, or the bits themselves with segments of one bit."""
    if width == 1:
        return fp
    odd, high = F.lit(_ODD), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(high.bitwiseAND(fp).bitwiseAND(odd), 1).bitwiseOR(high.bitwiseXOR(fp).bitwiseAND(odd))


def _embedding(fp: np.ndarray) -> np.ndarray:
    odd = np.uint64(_ODD)
    return fp - ((fp >> np.uint64(1)) & odd)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of the embeddings of two arrays of fingerprints (unsigned)."""
    x, y = _embedding(a), _embedding(b)
    pairs = np.uint64(0x3333333333333333)
    total = np.zeros(np.broadcast(x, y).shape, dtype=np.int64)
    for shift in (0, 2):
        p, q = (x >> np.uint64(shift)) & pairs, (y >> np.uint64(shift)) & pairs
        high = np.uint64(0x8888888888888888)
        # Per 4-bit field 8 + p - q, from which the absolute difference is read off.
        d = (p | high) - q
        for k in range(0, 64, 4):
            total += np.abs(((d >> np.uint64(k)) & np.uint64(15)).astype(np.int64) - 8)
    return total


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs link: first the lower bound, then exactly."""
    # Fields differ by the bound's rule; the cheap form of it compares the summed bits, the full one follows for what is left.
    near = np.abs(np.bitwise_count(a).astype(np.int64) - np.bitwise_count(b).astype(np.int64)) <= most
    near = np.flatnonzero(near)
    near = near[manhattan(a[near], b[near]) <= most]
    near = near[np.bitwise_count(a[near] ^ b[near]) <= most]
    out = np.zeros(len(a), dtype=bool)
    out[near] = True
    return out


def _forest(points: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect what the points' own links connect, without listing all of them."""
    links, left = [], points
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _close(np.full(len(left), at, dtype=np.uint64), left, most)
            links += [(at, x) for x in left[near]]
            todo += list(left[near])
            left = left[~near]
    return links


def _cell_links(cells: np.ndarray, points: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal cells."""
    out = []
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cells)])))
    small = np.repeat((sizes > 1) & (sizes <= SMALL_CELL), sizes)
    for step in range(1, min(SMALL_CELL, int(sizes.max(initial=0)))):
        at = np.flatnonzero(small[:-step] & (cells[:-step] == cells[step:]))
        a, b = points[at], points[at + step]
        near = _close(a, b, most)
        out.append((a[near], b[near]))
    for s, n in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
        if links := _forest(points[s : s + n], most):
            pairs = np.array(links, dtype=np.uint64)
            out.append((pairs[:, 0], pairs[:, 1]))
    return out


def links(distinct: DataFrame, most: int = MOST_BITS, width: int = 2) -> DataFrame:
    """Edges (u, v) between different fingerprints of ``distinct`` (fp) whose components are those of all links; ``width``: bits of a segment."""
    masks = [sum(0xFF << (8 * band) for band in bands) for bands in _TABLES]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    grid = distinct.withColumn("e", popcounts(F.col("fp"), width)).select("fp", F.posexplode(F.transform(signed, lambda m: F.col("e").bitwiseAND(m))).alias("t", "k"))
    grid = grid.select(F.xxhash64("t", "k").alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, points = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def out(found) -> pa.RecordBatch:
            pairs = [np.concatenate(x).view(np.int64) if found else np.zeros(0, dtype=np.int64) for x in (zip(*found, strict=True) if found else ([], []))]
            unique = np.unique(np.column_stack(pairs), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(unique[:, 0]), pa.array(unique[:, 1])], ["u", "v"])

        for batch in batches:
            cells = np.concatenate((cells, batch.column(0).to_numpy()))
            points = np.concatenate((points, batch.column(1).to_numpy().view(np.uint64)))
            if not len(cells) or cells[0] == cells[-1]:
                continue
            whole = int(np.searchsorted(cells, cells[-1]))
            yield out(_cell_links(cells[:whole], points[:whole], most))
            cells, points = cells[whole:], points[whole:]
        if len(cells) > 1:
            yield out(_cell_links(cells, points, most))

    return grid.mapInArrow(run, "u long, v long")


def _named(classes: DataFrame, most: int) -> DataFrame:
    """(fp, n, root, component_id) from classes (fp, first, n), first null if no row has an id; component_id is the least ``first``.

    Where classes have an id each, and none twice, these are the nodes; else nodes are told by id, null last, and fingerprint.
    """
    classes = cut(classes)
    every, with_id, ids = classes.agg(F.count("*"), F.count("first"), F.countDistinct("first")).first()
    plain = every == ids and with_id == ids
    node = F.col("first") if plain else F.struct(F.col("first").isNull().alias("no_id"), "first", "fp")
    ends = classes.select("fp", node.alias("node"))
    pairs = links(classes.select("fp"), most, 1 if every > WIDE else 2)
    pairs = pairs.join(ends.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(ends.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    roots = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.select("fp", "n", "root", (F.col("root") if plain else F.col("root.first")).alias("component_id"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id that links reach, itself included."""
    prints = written(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    named = cut(_named(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), most))
    limit = max(MANY, prints.count() // SHARE)
    many = F.broadcast(named.where(F.col("n") > limit).select("fp", "component_id"))
    few = named.where(F.col("n") <= limit).select("fp", "component_id")
    return prints.join(many, "fp").unionByName(prints.join(many.select("fp"), "fp", "left_anti").join(few, "fp")).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last), then the smallest hash of its text.

    Of rows alike in both one stays. Rows are told by id and hash, so that ids that repeat with other texts do no harm.
    """
    key, id_name = fresh(docs, "_key"), fresh(docs, "_id")
    hashed = docs.withColumns({key: F.xxhash64(text), id_name: F.col(doc_id).cast("long")})
    rows = hashed.select(F.col(id_name).alias("doc_id"), F.col(text).cast("binary").alias("raw"), F.col(key).alias("key"))
    prints = written(fingerprints(rows, text="raw", carried=("key",)), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    own = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(order).alias("row"), F.count("*").alias("n")))
    named = _named(own.drop("row"), MOST_BITS).select("fp", "root")
    stays = named.join(own.select("fp", "row"), "fp").groupBy("root").agg(F.min("row").alias("row"))
    stays = cut(stays.select(F.col("row.doc_id").alias("_stay_id"), F.col("row.key").alias("_stay_key")))
    same = hashed[id_name].eqNullSafe(stays["_stay_id"]) & (hashed[key] == stays["_stay_key"])
    kept = hashed.join(stays, same, "left_semi")
    twice = prints.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_stay_id"), F.col("key").alias("_stay_key"))
    if not twice.isEmpty():
        twice = cut(twice)
        again = hashed[id_name].eqNullSafe(twice["_stay_id"]) & (hashed[key] == twice["_stay_key"])
        kept = kept.join(twice, again, "left_anti").unionByName(kept.join(twice, again, "left_semi").dropDuplicates([id_name, key]))
    return kept.select(*docs.columns)
