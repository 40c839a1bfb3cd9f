"""A hidden Markov language model over words, trained by Baum-Welch, with exact likelihoods by the scaled forward recursion.

Tokens: lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and one end for each text. The counts of all training words are summed by
Spark. The ``OWN`` most frequent words are symbols of their own; every other word has the symbol of its last three bytes (one of
``SUFFIXES``) and, given that, its share of the symbol's counts (half a count more for each word and for all unknown ones). Counts
of at most ``KNOWN`` words, the most frequent ones, are broadcast; those of the rest are joined, word by word.

Training: each round runs the forward and backward recursions over every training text, in arrays over many texts at a time; the
expected counts are summed in each partition and then by Spark, and what returns to the driver is one number per symbol and
state. The rounds start from the symbols' shares with seeded random factors and end when a round raises the log-likelihood of the
training texts by less than ``SETTLED`` of it.

Defined results: a null or empty text has the end token alone; null ids are neither learned from nor held out; with nothing to learn
from every token is unknown and the base score 0; repeated rows are counted and scored each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernway.llm.common import LOWER_TABLE, crc_mod, longest_first, slices
from fernway.llm.lockstep import Lockstep
from fernway.operators.rounds import written

STATES = 8
OWN, SUFFIXES, KNOWN = 8192, 4096, 1 << 17
#: The last round's gain, as a share of the log-likelihood.
SETTLED = 1e-3
PSEUDO = 200.0
#: Distinct words that a task counts before it hands them on.
TASK_WORDS = 300_000

END = 0
SYMBOLS = 1 + OWN + SUFFIXES


def _words(raw: bytes | None) -> list[bytes]:
    return raw.translate(LOWER_TABLE).split() if raw else []


def suffix_symbol(word: bytes) -> int:
    """The symbol of a word that has none of its own."""
    return 1 + OWN + zlib.crc32(word[-3:]) % SUFFIXES


def suffix_column(word: Column) -> Column:
    """As :func:`suffix_symbol`, of a binary column."""
    return (F.lit(1 + OWN) + F.crc32(F.substring(word, -3, 3)) % F.lit(SUFFIXES)).cast("int")


def word_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(word, n) over all rows; the empty word stands for the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in slices(whole, "raw"):
                for raw in batch.column("raw").to_pylist():
                    counts.update(_words(raw))
                counts[b""] += batch.num_rows
                if len(counts) > TASK_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(F.col(text).cast("binary").alias("raw")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What is broadcast: the most frequent words with their counts, and the counts of symbols; its size is bounded."""

    number: dict[bytes, int]
    counts: np.ndarray  # of the words, most frequent first
    symbol: np.ndarray  # of the words
    tokens: int  # N
    distinct: int  # V
    ends: int
    symbol_counts: np.ndarray
    suffix_words: np.ndarray  # distinct words of a symbol that are not its own

    def __post_init__(self):
        self.base_below = math.log10(self.tokens + 0.5 * (self.distinct + 1))
        self.below = np.log10(self.symbol_counts + 0.5 * (self.suffix_words + 1))
        self.base = np.log10(self.counts + 0.5)
        #: log10 of the word's share of its symbol: nothing for a symbol of its own.
        self.share = np.where(self.symbol > OWN, self.base - self.below[self.symbol], 0.0)


def vocabulary(counted: DataFrame) -> Vocabulary:
    """From (word, n), which is read again and so should be written."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    # A training set without texts still counts one empty batch per task.
    distinct = total["v"] if total["ends"] else 0
    # The counts in steps of one part in sixty-four, a few thousand rows at most, tell from which count on the words are few enough.
    steps = counted.where("octet_length(word) > 0").groupBy(F.floor(F.log("n") * 64).alias("step")).agg(F.count("*").alias("v"), F.min("n").alias("least"))
    held, least = 0, None
    for r in steps.orderBy(F.desc("step")).collect():
        if held + r.v > KNOWN:
            break
        held, least = held + r.v, r.least
    found = counted.where((F.octet_length("word") > 0) & (F.col("n") >= F.lit(least))).select("word", "n").toArrow().to_pydict() if least else {"word": [], "n": []}
    top = sorted(zip(found["n"], found["word"], strict=True), key=lambda x: (-x[0], x[1]))
    words = [w for _, w in top]
    counts = np.array([n for n, _ in top], dtype=np.int64)
    symbol = np.array([1 + i if i < OWN else suffix_symbol(w) for i, w in enumerate(words)], dtype=np.int64)
    by_suffix = counted.where("octet_length(word) > 0").groupBy(suffix_column(F.col("word")).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    symbol_counts, suffix_words = np.zeros(SYMBOLS, dtype=np.int64), np.zeros(SYMBOLS, dtype=np.int64)
    for r in by_suffix:
        symbol_counts[r.s], suffix_words[r.s] = r.n, r.v
    for i, w in enumerate(words[:OWN]):
        s = suffix_symbol(w)
        symbol_counts[s] -= counts[i]
        suffix_words[s] -= 1
        symbol_counts[1 + i] = counts[i]
    symbol_counts[END] = total["ends"]
    return Vocabulary({w: i for i, w in enumerate(words)}, counts, symbol, int(total["n"]), int(distinct), int(total["ends"]), symbol_counts, suffix_words)


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, share_sum double, symbols binary, rare array<struct<word:binary,n:int>>"


def encode(docs: DataFrame, held_out: Column, words: Vocabulary, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as symbols (16 bits each), with what the known words add to the scores and the other words by count."""
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "share_sum", "symbols", "rare"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        get = v.number.get
        known = len(v.number)
        base, share, symbol = np.append(v.base, 0.0), np.append(v.share, 0.0), np.append(v.symbol, 0)
        end = math.log10(v.ends + 0.5)
        next_row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in slices(whole, "raw"):
                out, rare_words, rare_counts, ends_at = [], [], [], [0]
                for raw in batch.column("raw").to_pylist():
                    tokens = _words(raw)
                    n = len(tokens)
                    at = np.fromiter(map(get, tokens, repeat(known)), np.int64, n)
                    symbols = np.append(symbol[at], END)
                    rare = np.flatnonzero(at == known)
                    if len(rare):
                        words = [tokens[i] for i in rare.tolist()]
                        symbols[rare] = [suffix_symbol(w) for w in words]
                        counts = Counter(words)
                        rare_words += counts.keys()
                        rare_counts += counts.values()
                    ends_at.append(len(rare_words))
                    out.append((n + 1, n - len(rare) + (v.ends > 0), float(base[at].sum()) + end - (n + 1) * v.base_below, float(share[at].sum()), symbols.astype("<u2").tobytes()))
                numbers = pa.array(range(next_row, next_row + len(out)), pa.int64())
                next_row += len(out)
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types[3:8], strict=True)]
                rare = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int32())], ["word", "n"]))
                yield pa.RecordBatch.from_arrays([numbers, batch.column("doc_id"), batch.column("held_out"), *columns, rare], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(run, ENCODED)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol, state

    @staticmethod
    def of(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        """From expected counts: smoothed with the symbols' shares and half a count for each move."""
        s = len(start)
        return Model(
            (start + 0.5) / (start.sum() + 0.5 * s),
            (move + 0.5) / (move.sum(axis=1, keepdims=True) + 0.5 * s),
            (emit + PSEUDO * unigram[:, None]) / (emit.sum(axis=0) + PSEUDO),
        )


def forward(lanes: Lockstep, model: Model) -> np.ndarray:
    """log10 likelihood of each sequence, in the order given."""
    now, total = np.tile(model.start, (len(lanes.order), 1)), np.zeros(len(lanes.order))
    for step, n in enumerate(lanes.active):
        state = (now[:n] @ model.move if step else now[:n]) * model.emit[lanes.flat[lanes.run(step)]]
        scale = state.sum(axis=1)
        now[:n] = state / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.zeros(len(total))
    out[lanes.order] = total
    return out


def expected(sequences: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions, by the forward and backward recursions."""
    return counts_and_likelihood(sequences, model)[:3]


def counts_and_likelihood(sequences: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """As :func:`expected`, and the summed log10 likelihood. Probabilities of states have 32 bits, sums over texts 64."""
    s = len(model.start)
    if not sequences:
        return np.zeros(s), np.zeros((s, s)), np.zeros((SYMBOLS, s)), 0.0
    lanes = Lockstep(sequences)
    move, ones = model.move.astype(np.float32), np.ones(s, dtype=np.float32)
    emit = model.emit.astype(np.float32)[lanes.flat]
    alpha, scales = np.empty_like(emit), np.empty(len(emit), dtype=np.float32)
    before = None
    for step, n in enumerate(lanes.active):
        at = lanes.run(step)
        state = alpha[at]
        state[:] = model.start if before is None else before[:n] @ move
        state *= emit[at]
        np.matmul(state, ones, out=scales[at])
        state /= scales[at][:, None]
        before = state
    emit /= scales[:, None]
    moves, beta = np.zeros((s, s)), np.ones((len(lanes.order), s), dtype=np.float32)
    back = np.ascontiguousarray(move.T)
    for step in range(len(lanes.active) - 1, -1, -1):
        n, at = lanes.active[step], lanes.run(step)
        alpha[at] *= beta[:n]
        if step:
            onward = emit[at]
            onward *= beta[:n]
            moves += alpha[lanes.run(step - 1)][:n].T @ onward
            beta[:n] = onward @ back
    emits = np.column_stack([np.bincount(lanes.flat, weights=alpha[:, k], minlength=SYMBOLS) for k in range(s)])
    return alpha[lanes.run(0)].sum(axis=0, dtype=float), moves * model.move, emits, float(np.log10(scales, dtype=float).sum())


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2").astype(np.int32) for x in column.to_pylist()]


def starting_model(unigram: np.ndarray, states: int = STATES) -> Model:
    """The symbols' shares with random factors for each state, from a fixed seed; states tend to stay."""
    random = np.random.default_rng(8)
    move = np.full((states, states), 0.02 / max(1, states - 1))
    np.fill_diagonal(move, 0.98)
    emit = unigram[:, None] * random.uniform(0.5, 1.5, (len(unigram), states))
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def baum_welch(encoded: DataFrame, model: Model, unigram: np.ndarray) -> tuple[Model, float]:
    """One round over every training text: expected counts summed in each partition, then by Spark; with the log10 likelihood before it."""
    states = len(model.start)
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    columns = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, emits, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((SYMBOLS, states)), np.zeros((1, states))
        for whole in batches:
            for batch in slices(longest_first(whole, "symbols"), "symbols", 2 << 20):
                a, b, c, total = counts_and_likelihood(_sequences(batch.column("symbols")), shared.value)
                start, moves, emits = start + a, moves + b, emits + c
                likelihood[0, 0] += total
        # Rows by symbol; those of starts, moves and the likelihood come after the symbols.
        every = np.vstack((emits, start[None, :], moves, likelihood))
        used = np.flatnonzero(every.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(every[used, k]) for k in range(states)]], ["at", *columns])

    parts = encoded.where("NOT held_out").select("symbols").mapInArrow(run, ", ".join(["at long", *[f"{c} double" for c in columns]]))
    found = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    every = np.zeros((SYMBOLS + 2 + states, states))
    every[found["at"].to_numpy(dtype=np.int64)] = found[columns].to_numpy(dtype=float)
    shared.destroy()
    return Model.of(every[SYMBOLS], every[SYMBOLS + 1 : -1], every[:SYMBOLS], unigram), float(every[-1, 0])


def train(encoded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int | None = None) -> Model:
    """So many rounds over all training texts, or as many as it takes until the likelihood settles."""
    model, before, done = starting_model(unigram, states), -math.inf, 0
    while done != rounds:
        model, now = baum_welch(encoded, model, unigram)
        done += 1
        if rounds is None and not now - before > SETTLED * abs(now):
            break
        before = now
    return model


def score(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None, states: int = STATES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows not held out are learned from.

    ``held_out`` is null for rows that are scored but not learned from. Without ``rounds`` they go on until the likelihood settles.
    """
    counted = written(word_counts(docs.where(~held_out), text=text), "words")
    words = vocabulary(counted)
    encoded = written(encode(docs, held_out, words, doc_id=doc_id, text=text), "symbols")
    unigram = (words.symbol_counts + 0.5) / (words.symbol_counts.sum() + 0.5 * SYMBOLS)
    model = train(encoded, unigram, states, rounds if words.ends else 0)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "share_sum"]
        for whole in batches:
            for batch in slices(longest_first(whole, "symbols"), "symbols", 2 << 20):
                found = forward(Lockstep(_sequences(batch.column("symbols"))), shared.value)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found)], [*kept, "hidden"])

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "share_sum", "symbols").mapInArrow(
        likelihood, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, share_sum double, hidden double"
    )
    below = F.from_json(F.lit(str([round(x, 12) for x in words.below.tolist()])), "array<double>")
    rare = encoded.where("size(rare) > 0").select("row", F.explode_outer("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
    joined = rare.join(counted.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10(F.col("c") + F.lit(0.5))
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(F.lit(0))).alias("more_known"),
        F.sum(F.col("k") * log).alias("more_base"),
        F.sum(F.col("k") * (log - F.get(below, suffix_column(F.col("word"))))).alias("more_share"),
    )
    return scored.join(sums, "row", "left").select(
        "doc_id",
        F.coalesce("held_out", F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("hidden") + F.col("share_sum") + F.coalesce("more_share", F.lit(0.0))).alias("score"),
    )


def held_out(doc_id: str = "doc_id", modulus: int = 5) -> Column:
    """Rows that nothing is learned from; null for null ids, which are not learned from either."""
    return crc_mod(doc_id, modulus) == 1
