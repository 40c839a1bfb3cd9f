"""The queries at the smallest scale: oracles, the pipeline against plain Python, and the entry."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernway.llm import langid, quality
from fernway.llm.queries import QUERIES
from fernway.llm.sql import ORACLE_SQL
from tests.llm import brute
from tests.llm.test_text_models import _check_packing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_all_are_registered():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in QUERIES
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_language_of_held_out_documents(spark):
    found = QUERIES["op10_language_id"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    assert isinstance(langid.MAX_LANGUAGES, int)


def test_model_beats_the_base_on_held_out_documents(spark):
    r = QUERIES["op8_hmm_scoring"](spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verdicts = {r.doc_id: r.llr for r in quality.judge(docs, labels).collect()}
    left = {i: t for i, t in texts.items() if not brute.quality_base(t)[5] and verdicts[i] >= quality.THRESHOLD}
    prints = {i: brute.simhash(t) for i, t in left.items()}
    root = brute.components(sorted(left), [prints[i] for i in sorted(left)])
    left = {i: t for i, t in left.items() if root[i] == i}
    windows = defaultdict(set)
    for item, text in items:
        words = brute.ALNUM_WORDS.findall(brute.lower(text or ""))
        for i in range(max(1, len(words) - 12)):
            if words:
                windows[tuple(words[i : i + 13])].add(item)

    def contaminated(text):
        words = brute.ALNUM_WORDS.findall(brute.lower(text or ""))
        hit = set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        return bool(hit) and 20 * len(hit) >= len(words)

    left = {i: t for i, t in left.items() if not contaminated(t)}

    def clean(text):
        spans = sorted((a, b, k) for k, found in brute.secret_spans(text).items() for a, b in found)
        out, at = "", 0
        for a, b, k in spans:
            if a >= at:
                out += text[at:a] + f"[{k}]"
            at = max(at, b)
        return out + text[at:]

    left = {i: clean(t) for i, t in left.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left)

    by_place = sorted(left)

    class Row:
        def __init__(self, r):
            self.__dict__.update(r.asDict())
            self.doc_id = by_place.index(r.doc_id)

    assert _check_packing([Row(r) for r in rows], [left[i] for i in by_place], 2048) == 0


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
