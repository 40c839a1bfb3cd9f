"""Sum-of-squares packing of tokenized documents into sequences of 2,048 tokens.

Each task packs the documents of its partition as they come. A document gives whole sequences while it is long enough; what
remains is placed online: of all fill levels at which it fits, and a new sequence, the one that makes the sum over levels of
the squared number of partially filled sequences smallest (ties: the fullest level). The numbers stand in an array by level.

At most ``MAX_OPEN`` sequences are open. When no more may be opened and a piece fits none of them, it is cut to fill one exactly:
the one for which the fill and the rest, as a sequence of its own, make that sum smallest; the rest is placed again. So a sequence is
closed when it is full and never before. At the end of a partition the emptiest open sequence is taken apart, again and again, and its
pieces are placed among the others by the same rule, without new sequences; the last one is cut at powers of two, which need no
padding. Memory: the tokens of the open sequences (4 MiB) and one Arrow batch.

Where a tokenizer's pre-tokenizer drops white space, as that of ``word_bpe_49k`` does, the tokens of a text are those of its
space-separated chunks, kept in a bounded cache. With any other tokenizer whole texts are tokenized.

Defined results: bytes that are not UTF-8 are read as U+FFFD; a null text is an empty one and gives the end token alone; repeated rows are packed each; an empty table
gives no rows; other columns are ignored; ids must be numbers or texts of numbers, and null ids stay null.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernway.llm.common import slices

CAPACITY = 2048
END_ID = 1
MAX_OPEN = 512
CACHE_ENTRIES = 600_000
SEQUENCES_PER_TASK = 1 << 36

#: How a tokenizer that can be given chunks of texts makes them alike and cuts them.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_CUTS = {"pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The installed vocabulary file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, chunk by chunk.

    Chunks seen lately are kept in two generations of at most ``entries`` each: when the young one is full it becomes the old one,
    and what is used again moves back. Where all characters are Latin-1, the text is lower-cased, as the tokenizer does, and a
    comma or full stop between a letter and white space is set apart, which is a pre-token by itself; so more chunks are alike.
    """

    #: Words tokenized together: each is one pre-token, and the last of its tokens is marked as the end of a word.
    together = 2000
    _letters = re.compile("[a-zß-öø-ÿ]+")
    _mark = re.compile(r"(?<=[a-zß-öø-ÿ])([.,])(?=\s)")

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        spec = json.loads(self.tokenizer.to_str())
        cuts = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        normalizers = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_chunk = normalizers == _NORMALIZERS and {k: v for k, v in cuts.items() if k != "type"} == _CUTS
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def chunks(self, text: str) -> list[str]:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = self._mark.sub(r" \1", text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def learn(self, chunks: list[str]) -> None:
        words, rest = [], []
        for c in chunks:
            (words if self._letters.fullmatch(c) else rest).append(c)
        for k in range(0, len(words), self.together):
            block = words[k : k + self.together]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * np.flatnonzero(self.ends[ids]) + 4
            if len(ends) != len(block):  # a word of this vocabulary need not be one pre-token
                rest += block
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(block, ends.tolist(), strict=True):
                self.young[word] = data[at:end]
                at = end
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.young[c] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, all in one go so that unknown chunks are tokenized together."""
        if not self.by_chunk:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [self.chunks(t) for t in texts]
        young, old = self.young, self.old
        missing = {c for chunks in split for c in chunks if c not in young}
        if old:
            for c in missing & old.keys():
                young[c] = old[c]
        self.learn([c for c in missing if c not in young])
        out = [b"".join(map(young.__getitem__, chunks)) for chunks in split]
        if len(young) > self.entries:
            self.old, self.young = young, {}
        return out


_tokenizers: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Sum-of-squares packing of one partition. A piece: (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_sequence: int, max_open: int = MAX_OPEN):
        self.capacity, self.next_sequence, self.max_open = capacity, first_sequence, max_open
        #: Open sequences by fill level.
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.out: list[tuple] = []
        #: Sequences of several pieces that the rule closed, and those that were laid out at the end.
        self.by_rule, self.laid = 0, 0

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_sequence, at))
            at += len(ids)
        self.next_sequence += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        total = len(ids)
        for start in range(0, total - self.capacity + 1, self.capacity):
            self.close([(doc, start, ids[start : start + self.capacity], total)])
        rest = total % self.capacity
        piece = (doc, total - rest, ids[total - rest :].copy(), total)
        while len(piece[2]):
            piece = self.place(piece)

    def level_for(self, size: int, may_open: bool) -> int:
        """The level at which the sum of squares is least with the piece; 0 is a new sequence. Where it fits none, one that it fills if cut.

        A full sequence is no longer counted; the rest of a piece that is cut is, as a sequence of its own.
        """
        count, capacity = self.count, self.capacity
        levels = np.flatnonzero(count[1 : capacity - size + 1]) + 1
        if may_open:
            levels = np.append(levels, 0)
        elif not len(levels):
            levels = np.flatnonzero(count)
        then = (levels + size) % capacity
        change = np.where(levels > 0, 1 - 2 * count[levels], 0) + np.where(then > 0, 2 * count[then] + 1, 0)
        change[then == levels] = 0
        return int(levels[change == change.min()].max())

    def place(self, piece: tuple, may_open: bool | None = None) -> tuple:
        """Put the piece, or as much of it as fills a sequence, where the rule says; what is left of it."""
        doc, start, ids, total = piece
        size, capacity = len(ids), self.capacity
        level = self.level_for(size, self.n_open < self.max_open if may_open is None else may_open or not self.n_open)
        sequence = self._take(level) if level else []
        n = min(size, capacity - level)
        sequence.append((doc, start, ids[:n], total))
        if level + n == capacity:
            self.by_rule += len(sequence) > 1
            self.close(sequence)
        else:
            self._put(level + n, sequence)
        return doc, start + n, ids[n:], total

    def _take(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, level: int, sequence: list[tuple]) -> None:
        self.open.setdefault(level, []).append(sequence)
        self.count[level] += 1
        self.n_open += 1

    def finish(self) -> None:
        """Take the emptiest open sequence apart and place its pieces among the others until one is left, and cut that one."""
        while self.n_open > 1:
            for piece in self._take(int(np.flatnonzero(self.count)[0])):
                while len(piece[2]):
                    piece = self.place(piece, may_open=False)
        if not self.n_open:
            return
        level = int(np.flatnonzero(self.count)[0])
        pieces, left = self._take(level), level
        row, held, room = [], 0, 1 << left.bit_length() >> 1
        for doc, start, ids, total in pieces:
            while len(ids):
                n = min(len(ids), room - held)
                row.append((doc, start, ids[:n], total))
                held, start, ids = held + n, start + n, ids[n:]
                if held == room:
                    left -= held
                    self.laid += len(row) > 1
                    self.close(row)
                    row, held, room = [], 0, 1 << left.bit_length() >> 1

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: where it stands in its document and in which sequence it lies at which offset."""
    path = tokenizer or tokenizer_path()
    names = [x.split()[0] for x in PIECES.split(", ")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_tokenizer(path)
        packer = Packer(capacity, TaskContext.get().partitionId() * SEQUENCES_PER_TASK, max_open)
        for whole in batches:
            for batch in slices(whole, "raw"):
                ids, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc, encoded in zip(ids, tokens.encode([r.decode(errors="replace") for r in raws]), strict=True):
                    packer.add(doc, np.frombuffer(encoded + end, dtype="<u4"))
                yield rows(packer.drain())
        packer.finish()
        yield rows(packer.drain())

    whole = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    return whole.mapInArrow(run, PIECES)
