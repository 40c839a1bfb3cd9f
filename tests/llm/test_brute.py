"""Queries without a statement against plain Python, on the whole smallest table; models on made-up texts, number by number."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from fernway.llm import hmm, langid, quality
from fernway.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_text_models import _check_packing

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def _rows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    return rows, {r.doc_id: r for r in rows}


@needs_tables
def test_op3(spark, documents):
    rows, _ = _rows(spark, "op3_packing")
    ids = sorted(documents)
    place = {i: k for k, i in enumerate(ids)}

    class Piece:
        def __init__(self, r):
            self.__dict__.update(r.asDict())
            self.doc_id = place[r.doc_id]

    assert _check_packing([Piece(r) for r in rows], [documents[i] for i in ids], 2048) == 0


@needs_tables
def test_op5(spark, documents):
    import xxhash

    rows, found = _rows(spark, "op5_quality_rules")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}

    def buckets(text):
        words = [w.encode() for w in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", text or "")]
        one = [xxhash.xxh64_intdigest(w, 42) for w in words]
        two = [xxhash.xxh64_intdigest(w, h) for h, w in zip(one, words[1:], strict=False)]
        return [(h - (1 << 64) if h >> 63 else h) % quality.BUCKETS for h in one + two]

    own = {i: buckets(t) for i, t in documents.items()}
    trusted, raw = Counter(b for i in good if i in own for b in own[i]), Counter(b for x in own.values() for b in x)
    n, m = trusted.total() + 0.5 * quality.BUCKETS, raw.total() + 0.5 * quality.BUCKETS
    assert len(rows) == len(documents)
    for i, t in documents.items():
        r, base = found[i], brute.quality_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        llr = sum(math.log((trusted[b] + 0.5) / n) - math.log((raw[b] + 0.5) / m) for b in own[i]) / max(1, len(own[i]))
        assert abs(r.llr - llr) < 1e-4
        assert abs(llr - quality.THRESHOLD) < 1e-4 or r.kept == (not base[5] and llr >= quality.THRESHOLD)


@needs_tables
def test_op6_and_op7(spark, documents):
    _, licenses = _rows(spark, "op6_license_scans")
    _, secrets = _rows(spark, "op7_secret_scans")
    assert set(licenses) == set(secrets) == set(documents)
    for i, t in documents.items():
        r = licenses[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_row(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        r, want = secrets[i], brute.secret_spans(t)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*map(len, want.values()), brute.secrets_digest(t))
        base = [x for x in r.spans.split(",") if x.split(":")[0] in want]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


@needs_tables
def test_op8_base(spark, documents):
    _, found = _rows(spark, "op8_hmm_scoring")
    for i, (held, n, known, train, score) in brute.unigram_scores(documents).items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert math.isclose(r.base_score, score, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0


@needs_tables
def test_op9(spark, documents):
    _, found = _rows(spark, "op9_simhash")
    ids = sorted(documents)
    prints = [brute.simhash(documents[i]) for i in ids]
    want = brute.components(ids, prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {i: (f"{p:016x}", want[i]) for i, p in zip(ids, prints, strict=True)}


def test_score_of_the_hidden_model(spark):
    """Symbols, shares, two Baum-Welch rounds and likelihoods, text by text."""
    rnd = random.Random(4)
    vocabulary = [f"w{i:05d}" + "abcdefg"[i % 7] for i in range(9500)]
    texts = {k: " ".join(vocabulary[k * 500 : k * 500 + 500] + rnd.choices(vocabulary[:300], k=200)) for k in range(19)}
    texts |= {100: "", 101: None, 102: "unknown words here", 103: vocabulary[0]}
    held = {i: i in (3, 102) for i in texts}
    words = {i: brute.SPACE_WORDS.findall(brute.lower(t or "")) for i, t in texts.items()}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    top = sorted(counts, key=lambda w: (-counts[w], w))
    own = {w: 1 + k for k, w in enumerate(top[: hmm.OWN])}

    def symbol(w):
        return own.get(w, hmm.suffix_symbol(w.encode()))

    assert len(top) > hmm.OWN
    sums, kinds = Counter({0: sum(not h for h in held.values())}), Counter()
    for w, c in counts.items():
        sums[symbol(w)] += c
        kinds[symbol(w)] += w not in own
    unigram = np.array([(sums[s] + 0.5) / (sums.total() + 0.5 * hmm.SYMBOLS) for s in range(hmm.SYMBOLS)])
    rows = {i: [symbol(w) for w in ws] + [0] for i, ws in words.items()}
    model = hmm.starting_model(unigram)
    start, move, emit = model.start, model.move, model.emit

    def forward(row):
        alphas, scales, a = [], [], None
        for s in row:
            a = (start if a is None else a @ move) * emit[s]
            scales.append(a.sum())
            a = a / scales[-1]
            alphas.append(a)
        return alphas, scales

    for _ in range(2):
        first, moves, emits = np.zeros(8), np.zeros((8, 8)), np.zeros((hmm.SYMBOLS, 8))
        for i, row in rows.items():
            if held[i]:
                continue
            alphas, scales = forward(row)
            beta = np.ones(8)
            for t in range(len(row) - 1, -1, -1):
                emits[row[t]] += alphas[t] * beta
                if t:
                    onward = emit[row[t]] * beta / scales[t]
                    moves += np.outer(alphas[t - 1], onward) * move
                    beta = move @ onward
                else:
                    first += alphas[0] * beta
        start = (first + 0.5) / (first.sum() + 4)
        move = (moves + 0.5) / (moves.sum(axis=1, keepdims=True) + 4)
        emit = (emits + hmm.PSEUDO * unigram[:, None]) / (emits.sum(axis=0) + hmm.PSEUDO)
    docs = spark.createDataFrame([(i, t, held[i]) for i, t in texts.items()], "doc_id long, text string, held boolean").repartition(3)
    for r in hmm.score(docs, F.col("held"), rounds=2).collect():
        want = sum(map(math.log10, forward(rows[r.doc_id])[1]))
        for w in words[r.doc_id]:
            if w not in own:
                want += math.log10((counts[w] + 0.5) / (sums[symbol(w)] + 0.5 * (kinds[symbol(w)] + 1)))
        assert math.isclose(r.score, want, rel_tol=1e-5, abs_tol=1e-5), (r.doc_id, r.score, want)


def _grams(word):
    fenced, whole = f"<{word}>", (1 << 64) - 1
    for k in range(1, langid.LONGEST + 1):
        for at in range(len(fenced) - k + 1):
            h = 0
            for c in fenced[at : at + k]:
                h = (h * int(langid._STEP) + ord(c) + 1) & whole
            yield ((h * int(langid._MIX) & whole) >> 40) % langid.BUCKETS


def _script(word):
    names = [langid._NAMES[langid._NUMBERS[np.searchsorted(langid._STARTS, ord(c), side="right") - 1]] for c in word if c.isalpha()]
    counts = Counter(names)
    return max(counts, key=lambda n: (counts[n], -langid._NAMES.index(n))) if counts else None, len(names)


def test_predictions_of_languages(spark):
    """Learning, candidates by script, Viterbi and verdict, word by word."""
    rnd = random.Random(9)
    stems = {"en": ["th", "ing", "wh", "and"], "de": ["sch", "ung", "ü", "lich"], "ru": ["жд", "ов", "ый"], "uk": ["їв", "ов", "ий"], "el": ["λο", "γος", "και"]}
    langs = list(stems)

    def prose(lang, n):
        return " ".join("".join(rnd.choices(stems[lang], k=3)) + rnd.choice(["", "", ".", " 12"]) for _ in range(n))

    rows = [(i, prose(lang, 12), lang) for i, lang in enumerate(langs * 6)]
    rows += [(100 + i, " ".join(prose(rnd.choice(langs), rnd.randint(1, 9)) for _ in range(4)), None) for i in range(25)]
    rows += [(200, None, "en"), (201, "12 ... 7", "de"), (202, "a", None), (203, "ов th", None), (204, "日本 ов", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = [(t, lang) for i, t, lang in rows if lang and t and i % 4]
    model = langid.learn(docs.where("doc_id % 4 <> 0"))
    counts, letters = defaultdict(Counter), defaultdict(Counter)
    for t, lang in learned:
        for w in t.lower().split():
            script, n = _script(w)
            if script:
                counts[lang].update(_grams(w))
                letters[script][lang] += len(w)
    names = sorted(counts)
    assert model.languages == names
    total = {x: max(1, sum(letters[s][x] for s in letters)) for x in names}

    def scores(word):
        script, n = _script(word)
        if not script:
            return [0.0] * len(names), 0
        grams = list(_grams(word))
        found = [sum(math.log((counts[x][g] + 0.5) / (counts[x].total() + 0.5 * langid.BUCKETS)) for g in grams) for x in names]
        there = [letters[script][x] >= langid.SCRIPT_SHARE * total[x] for x in names] if script in letters else [True] * len(names)
        top = max(found)
        return [f - top - (0 if ok or not any(there) else 1e4) for f, ok in zip(found, there, strict=True)], n

    def predicted(text):
        found = [scores(w) for w in (text or "").lower().split()]
        if not sum(n for _, n in found):
            return "und", 0.0
        best, back = list(found[0][0]), []
        for s, _ in found[1:]:
            top = max(range(len(names)), key=lambda k: (best[k], -k))
            back.append([k if best[k] >= best[top] - langid.SWITCH else top for k in range(len(names))])
            best = [max(best[k], best[top] - langid.SWITCH) + s[k] for k in range(len(names))]
        state = max(range(len(names)), key=lambda k: (best[k], -k))
        path = [state]
        for step in reversed(back):
            path.append(state := step[state])
        weight = Counter()
        for k, (_, n) in zip(reversed(path), found, strict=True):
            weight[k] += n
        top = max(range(len(names)), key=lambda k: (weight[k], -k))
        return names[top], weight[top] / sum(weight.values())

    for r in langid.predict(docs, model).collect():
        lang, score = predicted(r.text)
        assert (r.language.lang_pred, round(r.language.score, 9)) == (lang, round(score, 9)), r.text
