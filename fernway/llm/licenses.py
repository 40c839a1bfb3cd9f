"""License scans: short notices with a few edits, by exact seeds and bounded-error matching.

Texts are lower-cased (A-Z), cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` and joined by single spaces. Base phrases count where
their words stand consecutively. For each notice with at most k edits, its wording is split into k + 1 pieces: a match
with k edits leaves one piece whole. All pieces are found in one Aho-Corasick pass; around each, the ``regex`` library looks for
the best match within the bound, then in what is left on either side of it, and gives their places and edits.

Defined results: bytes that are not UTF-8 are read as U+FFFD; a null text is an empty one and has no words; repeated rows are scanned each; an empty table gives no rows; a
column with the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernway.llm.common import ALNUM_TABLE, fresh, slices

# Phrases and labels of the base.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


@dataclass(frozen=True)
class Notice:
    """``wording`` may have up to ``edits`` edits; ``after`` must follow as it is."""

    label: str
    wording: str
    edits: int
    after: str = ""


NOTICES = (
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("apache-2", "licensed under the apache license version", 3, " 2"),
    Notice("cc-by-nc", "licensed under cc by", 1, " nc"),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("gpl", "gnu general public license", 2),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("mpl-2", "mozilla public license version", 2, " 2"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    Notice("unlicense", "free and unencumbered software released into the public domain", 4),
    Notice("artistic-2", "the artistic license", 1, " 2"),
    Notice("epl", "eclipse public license", 2),
    Notice("zlib", "provided as is without any express or implied warranty in no event will the authors", 5),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("spdx", "spdx license identifier", 2),
)

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("base", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("first_word", T.LongType()),
                        T.StructField("last_word", T.LongType()),
                        T.StructField("edits", T.IntegerType()),
                        T.StructField("score", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


def pieces(notice: Notice) -> list[tuple[str, int]]:
    """The wording in ``edits`` + 1 pieces of about the same length, with their places."""
    n, parts = len(notice.wording), notice.edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(notice.wording[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def _matcher(notices: tuple[Notice, ...]):
    import ahocorasick
    import regex

    seeds = ahocorasick.Automaton()
    held: dict[str, list[tuple[int, int]]] = {}
    for k, notice in enumerate(notices):
        for piece, at in pieces(notice):
            held.setdefault(piece, []).append((k, at))
    for piece, where in held.items():
        seeds.add_word(piece, (len(piece), where))
    seeds.make_automaton()
    patterns = [regex.compile(rf"(?be)(?<![^ ])(?:{regex.escape(n.wording, literal_spaces=True)}){{e<={n.edits}}}{regex.escape(n.after, literal_spaces=True)}(?![^ ])") for n in notices]
    return seeds, patterns


def fuzzy_matches(line: str, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[str, int, int, int, float]]:
    """(label, first word, last word, edits, score) of the matches in a line of words, in order of notice and place."""
    seeds, patterns = _matcher(notices)
    windows: dict[int, list[list[int]]] = {}
    for last, (size, where) in seeds.iter(line):
        for k, at in where:
            notice = notices[k]
            begin = last + 1 - size - at
            low = max(0, begin - notice.edits - 1)
            high = min(len(line), begin + len(notice.wording) + len(notice.after) + notice.edits + 1)
            held = windows.setdefault(k, [])
            if held and low <= held[-1][1]:
                held[-1][1] = max(high, held[-1][1])
            else:
                held.append([low, high])
    matches = [(start, end, k, edits) for k in windows for low, high in windows[k] for start, end, edits in _best_first(patterns[k], line, low, high)]
    found, words, at = [], 0, 0
    # By place, so that the spaces before each match are counted once.
    for start, end, k, edits in sorted(matches):
        notice, text = notices[k], line[start:end]
        words, at = words + line.count(" ", at, start), start
        first = words + (text[:1] == " ")
        found.append((k, (notice.label, first, first + text.strip(" ").count(" "), edits, round(1 - edits / len(notice.wording), 6))))
    return [match for _, match in sorted(found, key=lambda x: x[0])]


def _best_first(pattern, line: str, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the best match, of the best before and after it, and so on, in order of place.

    The pattern looks at the characters before and after a match, so it searches in the line and not in a part.
    """
    found, todo = [], [(low, high)]
    while todo:
        a, b = todo.pop()
        if a < b and (m := pattern.search(line, a, b)) and m.end() > m.start():
            found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            todo += [(a, m.start()), (m.end(), b)]
    return sorted(found)


def base_places(line: str, base=BASE) -> list[tuple[str, int]]:
    """(label, first word) of every place where a base phrase's words stand consecutively, overlaps included."""
    found = []
    for phrase, label in base:
        if phrase not in line:
            continue
        fenced_line, needle = f" {line} ", f" {phrase} "
        words, before, at = 0, 0, fenced_line.find(needle)
        while at >= 0:
            words, before = words + fenced_line.count(" ", before, at), at
            found.append((label, words))
            at = fenced_line.find(needle, at + 1)
    return found


def scan_licenses(docs: DataFrame, *, text: str = "text", notices: tuple[Notice, ...] = NOTICES, into: str = "licenses") -> DataFrame:
    """Every row of ``docs`` with a struct: n_words, base places and matches with edits."""
    raw_name = fresh(docs, "_raw")
    schema = T.StructType([f for f in docs.schema.fields if f.name != into] + [T.StructField(into, RESULT)])
    kept = [f.name for f in schema.fields[:-1]]
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    match = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])
    result = pa.struct([("n_words", pa.int64()), ("base", pa.list_(place)), ("matches", pa.list_(match))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, raw_name):
                out = []
                for raw in batch.column(raw_name).to_pylist():
                    words = raw.translate(ALNUM_TABLE).split()
                    line = b" ".join(words).decode(errors="replace")
                    base = [{"label": a, "word": w} for a, w in base_places(line)]
                    fuzzy = [{"label": a, "first_word": f, "last_word": w, "edits": e, "score": s} for a, f, w, e, s in fuzzy_matches(line, notices)]
                    out.append({"n_words": len(words), "base": base, "matches": fuzzy})
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, result)], [*kept, into])

    return docs.drop(into).withColumn(raw_name, F.coalesce(F.col(text), F.lit("")).cast("binary")).mapInArrow(scan, schema)
