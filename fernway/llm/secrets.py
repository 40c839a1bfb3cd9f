"""Secret scans: every rule in one minimised deterministic automaton, one pass over the bytes of each text.

The pass gives every place where a match of any rule ends. From such a place the rule's own reversed automaton finds where the
match begins, and its anchored one how far the match goes: leftmost and longest, non-overlapping per kind. Rules are compiled once,
on the driver, and broadcast as arrays; their size depends on the rules alone. Of two matches of a rule that overlap, the one that
begins first must not be the one whose shortest form ends last; the rules here are of that kind.

A private key's span goes from its BEGIN line to its END line, or without one to the end of its base64 lines.

Defined results: a null text is an empty one and has no spans; spans are in code points; repeated rows are scanned each; an empty
table gives no rows; a column with the name of the result is replaced. A text without commas and line breaks is one lane of the
automaton, which takes its bytes one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernway.llm.automaton import Automaton
from fernway.llm.common import fresh, slices


@dataclass(frozen=True)
class Rule:
    """``search`` finds the spans; those with ``least`` bytes after the longest match of ``lead`` at their start count."""

    kind: str
    search: str
    least: int = 0
    lead: str = ""
    key: bool = False  # the rest of a private key belongs to the span


# The base kinds, in the order in which they are listed.
_KEY = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_IS = _KEY + r"""["']?\x20*[:=]\x20*["']?"""
BASE_RULES = (
    Rule("assign", _IS + r"[A-Za-z0-9+/_.=-]+", 8, _IS),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    # A run of these is found whole, so that short ones may be left out from the start; that keeps the automaton from stopping in every word.
    Rule("hex", r"[0-9a-f]{32,}"),
)

#: Kinds that the method adds: published shapes of tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", key=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+", 23),
)

RULES = BASE_RULES + MORE_RULES

_BREAK = r"(?:[ \t\n\r\x0b\x0c]|\\[nr])"
#: Header fields and base64 lines of a key; then perhaps a shorter line.
_LINES = rf"(?:{_BREAK}+[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*)*(?:{_BREAK}*[A-Za-z0-9+/]{{16,}}=?=?)+"
_KEY_PARTS = (r"-----END [A-Z ]*PRIVATE KEY-----", _LINES, rf"{_LINES}{_BREAK}+[A-Za-z0-9+/]{{1,15}}=?=?")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Scanner:
    """The automata of the rules, all in one and each by itself."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.every = Automaton([r.search for r in rules])  # their bits are a 64-bit number
        self.ahead = [Automaton([r.search], search=False) for r in rules]
        self.back = [Automaton([r.search], search=False, reverse=True) for r in rules]
        self.leads = [Automaton([r.lead], search=False) if r.lead else None for r in rules]
        self.key_parts = [Automaton([x], search=False) for x in _KEY_PARTS]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Of each text (start, place of the rule, end) of every span, in code points, sorted."""
        number, ends, bits = self.every.scan(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        cuts = np.flatnonzero(np.diff(number)) + 1
        for at, past in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True) if len(number) else ():
            text = texts[number[at]]
            spans = []
            for k in range(len(self.rules)):
                spans += self._spans_of(k, text, ends[at:past][bits[at:past] >> k & 1 > 0])
            if not text.isascii():
                points = np.concatenate(([0], np.cumsum(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80))).tolist()
                spans = [(points[a], k, points[b]) for a, k, b in spans]
            found[number[at]] = sorted(spans)
        return found

    def _spans_of(self, k: int, text: bytes, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """A rule's spans, from the places in which its matches end."""
        rule, lead, out, past, i = self.rules[k], self.leads[k], [], 0, 0
        while i < len(ends):
            start = self.back[k].longest_back(text, int(ends[i]), past)
            if start < 0:
                i += 1
                continue
            past = self.ahead[k].longest(text, start, len(text))
            counted = lead.longest(text, start, past) if lead else start
            if rule.key:
                past = self._key_end(text, past)
            if past - counted >= rule.least:
                out.append((start, k, past))
            i = int(np.searchsorted(ends, past, side="right"))
        return out

    def _key_end(self, text: bytes, past: int) -> int:
        """Where a private key ends whose BEGIN line ends at ``past``; before the next block begins."""
        closing, lines, more = self.key_parts
        block = text.find(b"-----BEGIN ", past)
        stop = block if block >= 0 else len(text)
        end = text.find(b"-----END ", past, stop)
        if end >= 0 and (found := closing.longest(text, end, len(text))) >= 0:
            return found
        whole = max(past, lines.longest(text, past, stop))
        short = more.longest(text, past, stop)
        # A shorter line counts if nothing but quotes or an escape follows on it.
        at = short
        while 0 <= at < len(text) and text[at] in b" \t":
            at += 1
        return short if short > whole and text[at : at + 1] in (b"", b"\n", b"\r", b"\x0b", b"\x0c", b'"', b"'", b"\\") else whole


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The rules, at most 63, compiled."""
    if len(rules) > 63:
        raise ValueError("at most 63 rules fit an automaton")
    return Scanner(rules)


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one in brackets."""
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out += [text[at:start], f"[{rules[k].kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secrets", redact: bool = False) -> DataFrame:
    """Every row of ``docs`` with the spans of secrets, sorted by start and then by the order of the rules.

    ``redact``: the text itself has each secret replaced by ``[kind]``; null texts stay null.
    """
    raw_name = fresh(docs, "_raw")
    schema = T.StructType([f for f in docs.schema.fields if f.name != into] + [T.StructField(into, SPANS)])
    kept = [f.name for f in schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, raw_name):
                spans = shared.value.spans(batch.column(raw_name).to_pylist())
                columns = {c: batch.column(c) for c in kept}
                if redact and any(spans):
                    texts = [redacted(t, s, rules) if s else t for t, s in zip(columns[text].to_pylist(), spans, strict=True)]
                    columns[text] = pa.array(texts, columns[text].type)
                out = pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in spans], _SPANS)
                yield pa.RecordBatch.from_arrays([*columns.values(), out], [*kept, into])

    return docs.drop(into).withColumn(raw_name, F.coalesce(F.col(text), F.lit("")).cast("binary")).mapInArrow(scan, schema)
