"""Divergence of sources, periodic runs and mixing against plain Python, on small tables and on the smallest given one."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernway.llm import divergence, mixing, runs
from fernway.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- runs ------------------------------------------------------------------------------------------------------------


def runs_in(words):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(12, 2 * q) and not any(words[i : i + n - r] == words[i + r : i + n] for r in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found)


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check_runs(text, row):
    words = brute.SPACE_WORDS.findall(text or "")
    want = runs_in(words)
    assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == want
    assert (row["n_words"], row["collapsed"]) == (len(words), collapsed(words, want))


def test_runs_of_made_up_texts():
    rnd = random.Random(1)
    for _ in range(150):
        texts = [None]
        for _ in range(rnd.randint(0, 6)):
            n, letters = rnd.choice([0, 1, 5, 30, 90, 150]), "abcd"[: rnd.randint(1, 4)]
            words = [rnd.choice(letters) for _ in range(n)]
            if n > 30 and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = rnd.randint(1, max(1, (n - a) // 2))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(rnd.choice(["", " "]) + rnd.choice([" ", "\n\t"]).join(words))
        for text, row in zip(texts, runs._of_slice(pa.array(texts, pa.string())).to_pylist(), strict=True):
            check_runs(text, row)


def test_runs_of_long_texts():
    """Fibonacci words have the most runs; a long run of one word must not take a step for each of its words and places."""
    a, b = "a", "a b"
    while b.count(" ") < 600:
        a, b = b, f"{b} {a}"
    check_runs(b, runs._of_slice(pa.array([b])).to_pylist()[0])
    row = runs._of_slice(pa.array(["x " * 30_000 + "y"])).to_pylist()[0]
    assert (row["runs"], row["collapsed"]) == ([{"start": 0, "length": 30_000, "period": 1}], "x y")
    words = [f"w{i}" for i in range(9_000)] * 3 + ["w0"]
    row = runs._of_slice(pa.array([" ".join(words)])).to_pylist()[0]
    assert (row["runs"], row["collapsed"]) == ([{"start": 0, "length": 27_001, "period": 9_000}], " ".join(words[:9_000]))


def test_runs_of_tables(spark, docs, empty, clashing):
    for r in runs.periodic_runs(docs).collect():
        check_runs(r.text, r.periodic.asDict(True))
    again = docs.unionByName(docs)
    assert runs.periodic_runs(again).count() == 2 * docs.count()
    assert runs.periodic_runs(empty).count() == 0
    mine = runs.periodic_runs(clashing.withColumn("periodic", F.lit("mine")))
    assert mine.columns == [*clashing.columns, "periodic"] and mine.where("kept = 'mine' AND periodic.n_words >= 0").count() == docs.count()


def turned(doc_id, text):
    words = brute.SPACE_WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@needs_tables
def test_op12(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and any(r.n_runs for r in rows)
    for r in rows:
        words = turned(r.doc_id, texts[r.doc_id])
        # Squares need words that recur; long texts are looked at through their periods with many equal pairs alone.
        found = runs_in(words) if len(words) < 1500 else None
        if found is None:
            found = sorted((x["start"], x["length"], x["period"]) for x in runs._of_slice(pa.array([" ".join(words)])).to_pylist()[0]["runs"])
            for s, n, q in found:
                assert words[s : s + n - q] == words[s + q : s + n] and (s == 0 or words[s - 1] != words[s - 1 + q]) and (s + n == len(words) or words[s + n] != words[s + n - q])
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(best or (None, None, None)))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()


def test_ends_of_null_ids_stay(spark):
    rows = [(None, "a b c d"), (None, None), (3, " a\tb ")]
    assert {(r.doc_id, r.text) for r in runs.with_periodic_ends(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(None, "a b c d"), (None, ""), (3, "a b")}


# --- divergence ------------------------------------------------------------------------------------------------------


def audited(rows, k=divergence.TOP, least=divergence.LEAST_DOCS):
    """Rows of both parts; ``rows``: lang, source, text."""
    rows = [tuple(x or "" for x in r) for r in rows]
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [w for w in "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in brute.lower(text)).split(" ") if w]
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    groups, out = sorted({r[:2] for r in rows}), []
    kept = {lang: sorted(t for t, d in docs[lang].items() if d >= least) for lang, _ in groups}

    def frequencies(count, terms):
        total = sum(count[t] for t in terms)
        return {t: 1 + 10**9 * (count[t] + 1) // (total + len(terms)) for t in terms}

    p = {g: frequencies(n[g], kept[g[0]]) for g in groups}
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(sum((mine[t] - q) ** 2 // q for t, q in p[lang, other].items()), other) for x, other in groups if x == lang and other != source]
        whole = frequencies(sum((n[g] for g in groups if g[0] == lang), Counter()), kept[lang])
        terms = [((mine[t] - q) ** 2 // q, t) for t, q in whole.items() if n[lang, source][t] and mine[t] > q]
        for part, found, most in (("pair", pairs, None), ("term", terms, k)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def audit_of(spark, docs, k=divergence.TOP, least=divergence.LEAST_DOCS):
    found = divergence.audit(docs, least)
    pairs, terms = divergence.source_pairs(found).collect(), divergence.top_terms(found, k).collect()
    return sorted((r.lang, r.source, part, r["item"], r.value, r["rank"]) for part, rows in (("pair", pairs), ("term", terms)) for r in rows)


SCHEMA = "lang string, source string, text string"


def test_divergence_of_made_up_sources(spark):
    rnd = random.Random(5)
    # Many terms of equal counts, with long common beginnings, and terms that end where others go on.
    words = [stem + tail for stem in ("é" * 9, "long" * 20, "", "ab") for tail in ("a", "aa", "aaa", "aab", "b", "ba", "ü", "z", "zz", "q")]
    rows = [(rnd.choice(["en", None, "", "de"]), rnd.choice(["s1", "s2", "s3", None, "é"]), " ".join(rnd.choices(words, k=rnd.choice([0, 3, 30])))) for _ in range(120)]
    rows += [("fr", "alone", "one TWO three"), ("it", "x", None), ("it", "y", "1 2 3"), ("en", "s9", None), ("en", "s1", "ab12ab-AB\tAB\x00zz")]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for k in (3, 7):
        assert audit_of(spark, docs, k) == audited(rows, k)
    assert audit_of(spark, docs, least=1) == audited(rows, least=1)


def test_thresholds_of_ties(spark):
    """Equal values, told apart by bytes alone, many of them nested."""
    items = ["a" * i for i in range(1, 40)] + ["a" * 39 + c for c in "bcdé"] + ["zz", "z"]
    rows = [("g", "1", i, 5) for i in items] + [("g", "2", i, 1 << 60) for i in items[:9]] + [("g", "2", i, (1 << 60) - 1) for i in items[9:]] + [("g", "3", "only", 0)]
    df = spark.createDataFrame(rows, "lang string, source string, item string, value long").repartition(3)
    for k in (1, 10, 44):
        limits = {r.source: r for r in divergence.thresholds(df, k).collect()}
        for source in "123":
            own = sorted(((v, i) for _, s, i, v in rows if s == source), key=lambda x: (-x[0], x[1].encode()))
            r = limits.get(source)
            kept = own if r is None else [(v, i) for v, i in own if v > r.threshold or v == r.threshold and (r.tie is None or i.encode()[: r.width] <= bytes(r.tie))]
            assert kept == own[: max(k, 0)] and (r is None) == (len(own) <= k)


def test_divergence_of_other_tables(spark, docs, empty, clashing):
    assert audit_of(spark, empty) == []
    want = audited([(r.lang, r.source, r.text) for r in docs.collect()])
    assert audit_of(spark, docs) == want == audit_of(spark, clashing.withColumn("term", F.lit("mine")))


# --- mixing ----------------------------------------------------------------------------------------------------------


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped = set()
    while True:
        left = [s for s in names if s not in stopped]
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        out = {s: 3.0 * sizes[s] if s in stopped else rest / sum(weight[x] for x in left) * weight[s] for s in names}
        more = {s for s in left if out[s] > 3 * sizes[s]}
        if not more:
            return out
        stopped |= more


def mixed_rows():
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", "b", "b", "b", "b", "c", None, "é"]), " ".join(["w"] * rnd.choice([0, 1, 3, 40, 700]))) for i in range(300)]
    rows += [(1000, "d", "one two"), (1001, "e", None), (1002, "f", " \n"), (None, "b", "null id"), (None, "b", "null id"), (5, "b", "again and again"), (5, "b", "again and again")]
    return rows


def test_mix(spark):
    rows = mixed_rows()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).withColumn("size", F.lit("mine")).withColumn("row", F.lit(1))
    found = mixing.sized(docs)
    draws = mixing.mix(found, block_words=64, shard_words=1000)
    out = mixing.taken(found, draws).collect()
    assert len(out) == len(rows) and sorted((r.doc_id is not None, r.doc_id, r["size"]) for r in out if r.doc_id is not None) == sorted((True, i, len((t or "").split())) for i, _, t in rows if i is not None)
    source_of = {i: s for i, s, _ in rows}
    got = Counter()
    for r in out:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        got[s] += r.taken
    assert all(abs(got[s] - want[s]) <= 0.5 for s in sizes)
    # Each document is taken a whole number of times, but for one of a source.
    assert sum(r["size"] > 0 and r.taken % r["size"] > 0 for r in out) <= len(sizes)
    cells = draws.collect()
    blocks = defaultdict(set)
    for r in cells:
        blocks[r.shard].add(r.number)
    assert set(blocks) <= set(range(-(-round(sum(want.values())) // 1000))) and len(blocks) > 30
    assert all(sorted(r.position for r in cells if r.shard == s) == list(range(1, 1 + sum(r.shard == s for r in cells))) for s in blocks)
    key = lambda r: (r.doc_id or -1, r["size"], r.taken)
    again = mixing.sized(docs.repartition(3))
    assert sorted(map(key, out)) == sorted(map(key, mixing.taken(again, mixing.mix(again)).collect()))


def test_tree_deals_every_block_once(spark):
    quotas = {0: 1000, 1: 3, 2: 0, 5: 77}
    df = spark.createDataFrame(list(quotas.items()), "number long, blocks long")
    for shards in (1, 7, 200):
        leaves = mixing.split_tree(df, shards).collect()
        per_shard, dealt = Counter(), defaultdict(list)
        for r in leaves:
            per_shard[r.shard] += r.blocks
            dealt[r.number] += range(r.first_block, r.first_block + r.blocks)
        assert {n: sorted(b) for n, b in dealt.items()} == {n: list(range(b)) for n, b in quotas.items() if b}
        assert max(per_shard.values()) - min(per_shard.values()) <= 1 + int(np.log2(shards))


def test_buckets_do_not_change_the_mix(spark, monkeypatch):
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, source string, text string")
    found = mixing.sized(docs)

    def starts():
        return sorted((r.copy, r.number, r.start, r.words) for r in mixing.streams(found).collect())

    whole = starts()
    monkeypatch.setattr(mixing, "BUCKET", 4)
    assert starts() == whole
    monkeypatch.setattr(mixing, "BITS", 4)
    assert starts() == whole


def test_mix_of_nothing(spark):
    for rows in ([], [(1, "a", None), (2, None, " ")]):
        found = mixing.sized(spark.createDataFrame(rows, "doc_id long, source string, text string"))
        assert [(r["size"], r.target, r.taken) for r in mixing.taken(found, mixing.mix(found)).collect()] == [(0, 0.0, 0)] * len(rows)
