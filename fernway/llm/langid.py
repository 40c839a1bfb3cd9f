"""Language ID: script ranges narrow the candidates, then Viterbi over word scores labels the words of mixed-language texts.

Learning (documents with a language, crc32(doc_id as text) mod 3 not 1): of every language the numbers of words, of their hashed
character n-grams (with the word's borders, 1 to 4 characters) and of letters by script, counted in each partition and summed by Spark.
The model is an array of log probabilities by n-gram bucket and language; its size depends on ``BUCKETS`` and the languages alone.
Every language found is learned.

Words over ``WORD_PART`` characters, such as lines of text without spaces, are counted and labelled in consecutive parts of so many;
no n-gram is lost at the cuts and none made up, as each is counted with the part in which it begins.

Prediction: a word's candidates are the languages that have its script in at least ``SCRIPT_SHARE`` of their letters (all, if none
has). Its score for a language is the sum of its n-grams' log probabilities; words without letters score alike. Viterbi with
a penalty for each switch labels every word (or part); the text's language is the one with most letters (ties: the first by name), its
score that share of the letters. Spans are runs with one label, by word: one that ends within a long word and the next share it.

Defined results: bytes that are not UTF-8 are read as U+FFFD; a text that is null or has no letter is ``und`` with score 0 and no spans; with nothing to learn from, every text is;
null languages and ids are not learned from; repeated rows are counted and judged each; an empty table gives no rows; columns with
the names of results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernway.llm.common import crc_mod, fresh, slices
from fernway.llm.lockstep import Lockstep
from fernway.operators.rounds import written

BUCKETS = 1 << 16
LONGEST = 4
SWITCH = 12.0
SCRIPT_SHARE = 0.001
#: Languages whose counts are sent to the driver at once; with more of them, fewer words are held or scored together.
MAX_LANGUAGES = 64
CACHE_ENTRIES = 300_000
#: Bytes of texts that are looked at together.
SLICE = 2 << 20
#: Characters of a word that are scored together; longer ones are scored in parts.
WORD_PART = 64

# First code points of blocks of scripts, in order; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"),
    (0x0B80, "Tamil"),
    (0x0C00, "Telugu"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2C00, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Han"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Other"),
    (0x20000, "Han"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = list(dict.fromkeys(n for _, n in SCRIPTS))
_NUMBERS = np.array([_NAMES.index(n) for _, n in SCRIPTS])

#: Multipliers of the n-grams' hashes: odd, with bits spread over the whole word.
_STEP, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Words whose features are found together.
BLOCK = 20_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def parts_of(word: str) -> list[str]:
    """The word, or its parts if it is long.

    Words have no spaces. A part that does not begin the word has a space before it, one that does not end it a space after it and
    then the LONGEST - 1 characters that follow, which are there for the n-grams that begin in the part.
    """
    if len(word) <= WORD_PART:
        return [word]
    fenced = f"{word}>"
    return [(" " if i else "") + word[i : i + WORD_PART] + (f" {fenced[i + WORD_PART : i + WORD_PART + LONGEST - 1]}" if i + WORD_PART < len(word) else "") for i in range(0, len(word), WORD_PART)]


def _own(word: str) -> str:
    """The word, or the part of one without what follows it."""
    return word.removeprefix(" ").partition(" ")[0] if " " in word else word


def _fenced(word: str) -> tuple[str, int]:
    """The word between borders, or the part of one with those it has, and the number of characters in which its n-grams begin."""
    if " " not in word:
        return (whole := f"<{word[:WORD_PART]}>"), len(whole)
    own, more, after = word.removeprefix(" ").partition(" ")
    own = ("" if word[0] == " " else "<") + own + ("" if more else ">")
    return own + after, len(own)


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points one after another, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4"), np.fromiter(map(len, words), np.int64, len(words))


def scripts_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the script of most of its letters, as a place in ``_NAMES`` (ties: the first there; -1 without letters), and the number of letters."""
    chars, lengths = _code_points([_own(w) for w in words])
    letter = _letters()[chars]
    of_word = np.repeat(np.arange(len(words)), lengths)[letter]
    script = _NUMBERS[np.searchsorted(_STARTS, chars[letter], side="right") - 1]
    counts = np.bincount(of_word * len(_NAMES) + script, minlength=len(words) * len(_NAMES)).reshape(len(words), len(_NAMES))
    total = counts.sum(axis=1)
    return np.where(total > 0, counts.argmax(axis=1), -1), total


def grams_of(words: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams, the buckets of those of all words between borders, word after word, and how many each word has.

    Words longer than ``WORD_PART`` are given as :func:`parts_of` them.
    """
    fenced = [_fenced(w) for w in words]
    chars, lengths = _code_points([w for w, _ in fenced])
    own = np.fromiter((n for _, n in fenced), np.int64, len(fenced))
    each = [np.maximum(np.minimum(lengths - k + 1, own), 0) for k in range(1, LONGEST + 1)]
    begins = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at, codes = np.arange(len(chars)) - begins, chars.astype(np.uint64) + np.uint64(1)
    hashed = np.zeros(len(chars), dtype=np.uint64)
    for k in range(1, LONGEST + 1):
        hashed = hashed[: len(chars) - k + 1] * _STEP + codes[k - 1 :]
        inside = at[: len(hashed)] < np.repeat(each[k - 1], lengths)[: len(hashed)]
        yield (((hashed[inside] * _MIX) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), each[k - 1]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket, language
    candidates: dict[str, np.ndarray]  # script: 0 for its languages, else a large loss

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word by language, and the numbers of letters."""
        script, letters = scripts_of(words)
        scores = np.zeros((len(words), len(self.languages)))
        for buckets, each in grams_of(words, len(self.scores)):
            some = np.flatnonzero(each)
            scores[some] += np.add.reduceat(self.scores[buckets], (np.cumsum(each) - each)[some], axis=0)
        scores -= scores.max(axis=1, keepdims=True)
        losses = np.array([np.zeros(len(self.languages)) + self.candidates.get(name, 0.0) for name in _NAMES])
        scores += losses[script]
        scores[script < 0] = 0.0
        return scores, letters


def _words(raw: bytes | None) -> list[str]:
    return raw.decode(errors="replace").lower().split() if raw else []


def _parts(words: list[str]) -> list[str]:
    """The words, long ones in parts."""
    return [p for w in words for p in parts_of(w)] if any(len(w) > WORD_PART for w in words) else words


def _word_numbers(words: list[str]) -> np.ndarray:
    """Of each of the words' parts the place of the word."""
    return np.repeat(np.arange(len(words)), np.fromiter((max(1, -(-len(w) // WORD_PART)) for w in words), np.int64, len(words)))


def count_features(docs: DataFrame, *, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """(lang, kind, key, n): n-grams by bucket, letters by script and words, summed over all rows that have a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        grams: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}

        def fold() -> None:
            for language, found in words.items():
                into = grams.setdefault(language, np.zeros(buckets, dtype=np.int64))
                every = list(found)
                for low in range(0, len(every), BLOCK):
                    script, _ = scripts_of(every[low : low + BLOCK])
                    block = [w for w, s in zip(every[low : low + BLOCK], script.tolist(), strict=True) if s >= 0]
                    if not block:
                        continue
                    times = np.fromiter((found[w] for w in block), np.int64, len(block))
                    for at, each in grams_of(block, buckets):
                        into += np.bincount(at, weights=np.repeat(times, each), minlength=buckets).astype(np.int64)
                    script = script[script >= 0]
                    sizes = times * np.fromiter((len(_own(w)) for w in block), np.int64, len(block))
                    for s in np.unique(script).tolist():
                        key = (language, _NAMES[s])
                        scripts[key] = scripts.get(key, 0) + int(sizes[script == s].sum())
                    scripts[language, "#"] = scripts.get((language, "#"), 0) + int(times.sum())
            words.clear()

        for whole in batches:
            for batch in slices(whole, "raw", SLICE):
                for language, raw in zip(batch.column("lang").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                    words.setdefault(language, Counter()).update(_parts(_words(raw)))
                if sum(map(len, words.values())) > CACHE_ENTRIES:
                    fold()
        fold()
        for language, counts in grams.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(used), pa.string()), pa.array(["gram"] * len(used), pa.string()), pa.array([str(b) for b in used.tolist()], pa.string()), pa.array(counts[used])], ["lang", "kind", "key", "n"])
        if scripts:
            keys = list(scripts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array(["script"] * len(keys), pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([scripts[k] for k in keys], pa.int64())], ["lang", "kind", "key", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(run, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """A model of the rows' languages; what reaches the driver is bounded by buckets and languages."""
    counted = written(count_features(docs, text=text, lang=lang, buckets=buckets), "language-counts")
    languages = sorted(r.lang for r in counted.where("kind = 'script' AND key = '#' AND n > 0").select("lang").collect())
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((buckets, len(languages)))
    letters: dict[str, np.ndarray] = {}
    for low in range(0, len(languages), MAX_LANGUAGES):
        found = counted.where(F.col("lang").isin(languages[low : low + MAX_LANGUAGES])).toPandas()
        for language, kind, key, n in found.itertuples(index=False):
            if kind == "gram":
                counts[int(key), place[language]] = n
            elif key != "#":
                letters.setdefault(key, np.zeros(len(languages)))[place[language]] = n
    total = sum(letters.values()) if letters else np.ones(len(languages))
    candidates = {}
    for script, n in letters.items():
        there = n >= SCRIPT_SHARE * np.maximum(total, 1)
        candidates[script] = np.where(there | ~there.any(), 0.0, -1e4)
    # An n-gram is worth the log of its share, so that a language's word scores compare over the same n-grams.
    return Model(languages, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * buckets)), candidates)


def viterbi(sequences: list[np.ndarray], scores: np.ndarray, switch: float) -> list[np.ndarray]:
    """The best language of each word; ``sequences`` hold rows of ``scores``. Ties: stay, then the first language."""
    lanes = Lockstep(sequences)
    k = scores.shape[1]
    stayed = np.zeros((len(lanes.flat), k), dtype=bool)
    switched_from = np.zeros(len(lanes.flat), dtype=np.int32)
    best = np.zeros((len(lanes.order), k))
    for step, n in enumerate(lanes.active):
        at = lanes.run(step)
        now = best[:n]
        if step:
            top = now.argmax(axis=1)
            moved = now[np.arange(n), top] - switch
            stay = now >= moved[:, None]
            stayed[at], switched_from[at] = stay, top
            now = np.where(stay, now, moved[:, None])
        best[:n] = now + scores[lanes.flat[at]]
    label = np.zeros(len(lanes.flat), dtype=np.int32)
    state = best.argmax(axis=1) if len(best) else np.zeros(0, dtype=np.int64)
    for step in range(len(lanes.active) - 1, -1, -1):
        n, at = lanes.active[step], lanes.run(step)
        label[at] = state[:n]
        if step:
            keep = stayed[at][np.arange(n), state[:n]]
            state[:n] = np.where(keep, state[:n], switched_from[at])
    bounds = np.cumsum([len(s) for s in sequences])[:-1] if sequences else []
    return np.split(label[lanes.place], bounds)


RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("lang", T.StringType())]))),
    ]
)


def predict(docs: DataFrame, model: Model, *, text: str = "text", into: str = "language", switch: float = SWITCH) -> DataFrame:
    """Every row with a struct: lang_pred, score and spans of words by language."""
    raw_name = fresh(docs, "_raw")
    schema = T.StructType([f for f in docs.schema.fields if f.name != into] + [T.StructField(into, RESULT)])
    kept = [f.name for f in schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("lang", pa.string())])
    result = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    unknown = {"lang_pred": "und", "score": 0.0, "spans": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.languages)
        # What is held at once grows with the languages.
        fold = max(1, -(-k // MAX_LANGUAGES))
        number: dict[str, int] = {}
        scores, letters = np.zeros((1024, k)), np.zeros(1024, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, raw_name, SLICE // fold):
                if len(number) > CACHE_ENTRIES // fold:
                    number.clear()
                split = [_words(raw) for raw in batch.column(raw_name).to_pylist()]
                texts = [_parts(words) for words in split]
                new = list({w for words in texts for w in words}.difference(number))
                need = len(number) + len(new)
                if need > len(scores):
                    more = need + need // 4 - len(scores)
                    scores, letters = np.concatenate((scores, np.zeros((more, k)))), np.concatenate((letters, np.zeros(more, dtype=np.int64)))
                for low in range(0, len(new), step := max(1, BLOCK // fold)):
                    block, i = new[low : low + step], len(number)
                    number.update(zip(block, range(i, i + len(block)), strict=True))
                    if k:
                        scores[i : i + len(block)], letters[i : i + len(block)] = model.words(block)
                get = number.__getitem__
                rows = [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]
                labels = viterbi(rows, scores, switch) if k else [None] * len(rows)
                out = []
                for words, row, label in zip(split, rows, labels, strict=True):
                    n = letters[row].sum() if k and len(row) else 0
                    if not n:
                        out.append(unknown)
                        continue
                    weight = np.bincount(label, weights=letters[row], minlength=k)
                    top = int(weight.argmax())
                    cuts = np.flatnonzero(np.diff(label)) + 1
                    firsts, lasts = [0, *cuts.tolist()], [*(cuts - 1).tolist(), len(row) - 1]
                    word = range(len(row)) if len(row) == len(words) else _word_numbers(words).tolist()
                    spans = [{"first_word": word[a], "last_word": word[b], "lang": model.languages[label[a]]} for a, b in zip(firsts, lasts, strict=True)]
                    out.append({"lang_pred": model.languages[top], "score": float(weight[top] / n), "spans": spans})
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, result)], [*kept, into])

    return docs.drop(into).withColumn(raw_name, F.col(text).cast("binary")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", modulus: int = 3) -> Column:
    """Rows that nothing is learned from; false for null ids, which are not learned from either."""
    return F.coalesce(crc_mod(doc_id, modulus) == 1, F.lit(False))


def learned_from(doc_id: str = "doc_id", modulus: int = 3) -> Column:
    """Rows that may be learned from."""
    return F.coalesce(crc_mod(doc_id, modulus) != 1, F.lit(False))
