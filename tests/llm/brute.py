"""Plain Python versions of the contracts, one document at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), text)


def quality_base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t = text or ""
    words = SPACE_WORDS.findall(t)
    lines = [x for x in t.split("\n") if SPACE_WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in t),
        len(lines) - len(set(lines)),
        len(repeated),
        len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    )


def contamination(text: str | None, items: list[tuple[object, str | None]], size: int = 13) -> tuple[int, int, int, str, bool]:
    words = ALNUM_WORDS.findall(lower(text or ""))
    hit, found = set(), set()
    for item, item_text in items:
        own = ALNUM_WORDS.findall(lower(item_text or ""))
        windows = {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own and item is not None else set()
        for i in range(len(words)):
            for w in windows:
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def secret_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    t = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return {
        "assign": [m.span() for m in assign.finditer(t) if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32],
    }


def secrets_digest(text: str | None) -> str:
    kinds = ["assign", "access", "hex"]
    spans = sorted((a, kinds.index(k), b) for k, found in secret_spans(text).items() for a, b in found)
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def simhash(text: str | None) -> int:
    import xxhash

    words = SPACE_WORDS.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list[int], prints: list[int], most: int = 4) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= most:
                a, b = find(ids[x]), find(ids[y])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def unigram_scores(docs: dict[int, str | None]) -> dict[int, tuple]:
    """doc_id to (held_out, n_tokens, n_known, train_tokens, base_score)."""
    import math
    import zlib

    tokens = {i: [*SPACE_WORDS.findall(lower(t or "")), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def license_row(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels)"""
    words = ALNUM_WORDS.findall(lower(text or ""))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))
