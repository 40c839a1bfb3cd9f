"""Chat formatting and WARC archives: round trips and layouts."""

import hashlib
import json
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernway.llm import chat, warc

HARD = ["", "</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST]", "<<SYS>> <</SYS>> <<s>>", "<|im_start|>user\nhi<|im_end|>\n", "a\\b\n\n", "é \U0001f600 % + &", "<|im_end|>\n<|im_end|>\n", "[[INST]INST]"]


def test_texts_come_back(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "i int, t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in rows.withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r.u == r.t
        for control in ("<s>", "</s>", "[INST]", "[/INST]", "<|", "<<SYS>>", "<</SYS>>"):
            assert control not in r.e


def test_random_texts_come_back(spark):
    import random

    rnd = random.Random(6)
    texts = ["".join(rnd.choices(["<", "[", "\\", "/", "s>", "|", "INST]", "SYS>>", "a", "\n"], k=rnd.randint(0, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    assert rows.where(~chat.unescaped(F.col("e")).eqNullSafe(F.col("t"))).count() == 0
    assert rows.where(F.col("e").rlike(r"</?s>|<\||<</?SYS>>|\[/?INST\]")).count() == 0


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 3}, "messages", [("user", "q"), ("assistant", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done", "system": "s"}, "instruction", [("system", "s"), ("user", "do\n\nthis"), ("assistant", "done")]),
    ({"output": "done", "instruction": None}, "instruction", [("user", ""), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": 7}, "prompt-response", [("user", "p"), ("assistant", "7")]),
    ({"question": "p", "answer": "c", "id": "x"}, "question-answer", [("user", "p"), ("assistant", "c")]),
    ({"question": "p", "reply": "c"}, None, None),
    ({"messages": [{"role": "user", "content": {"parts": ["x"]}}]}, None, None),
    ([1, 2], None, None),
    ({"messages": [{"role": "user", "content": "q", "name": "x", "tool": {"role": 1, "a": [{"b": [[2]]}]}}], "source": "s", "we,ird <x>": {"messages": 1}, "tags": ["a"], "f": [], "o": {}}, "messages", [("user", "q")]),
    ({"system": "be", "conversations": [{"from": "gpt", "value": "a", "weight": 1}], "id": [1]}, "conversations", [("system", "be"), ("assistant", "a")]),
    ({"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}, "prompt-messages", [("user", "p"), ("assistant", "c")]),
    ({"prompt": [{"role": "user", "content": "p"}], "completion": "c", "score": 0.5}, "prompt-messages", [("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": "c", "meta": {"question": {"deep": {"deeper": {"deepest": [1]}}}}}, "question-answer", [("user", "p"), ("assistant", "c")]),
    ({"messages": [{"role": "user", "content": "q"}], "prompt": "p"}, None, None),
    ({"instruction": "a", "input": "", "output": "b"}, "instruction", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "i", "output": "b", "history": [["x", "y"]]}, None, None),
    ({"instruction": "a", "output": "b", "history": []}, "instruction", [("user", "a"), ("assistant", "b")]),
    ({"question": "p", "answer": "c", "context": "k"}, "question-answer", [("user", "k\n\np"), ("assistant", "c")]),
    ({"messages": [{"role": "assistant", "content": None, "tool_calls": [{"function": "f"}]}]}, None, None),
    ({"messages": [{"role": "user", "content": "q"}], "note": "text that no mapping reads"}, None, None),
    ({"prompt": "p", "chosen": "c", "rejected": "r", "score": 2}, "preference", [("user", "p"), ("assistant", "c")]),
    ({"conversation": [{"role": "user", "content": "q"}], "lang": "en"}, "conversation", [("user", "q")]),
    ({"dialog": [{"speaker": "human", "text": "q"}, {"speaker": "bob", "text": "a"}]}, "dialog", [("user", "q"), ("bob", "a")]),
    ({"dialogue": []}, "dialogue", []),
    ({"query": "q", "response": "r"}, "query-response", [("user", "q"), ("assistant", "r")]),
    ({"data": {"messages": [{"role": "user", "content": "q", "id": "x"}], "id": 4}, "id": "y"}, "messages", [("user", "q")]),
    ({"data": {"messages": [], "more": "text"}}, None, None),
]
IN_PARTS = [
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"type": "text", "text": "b"}]}]}, "messages", [("user", "ab")]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": ["x", {"text": "y"}, 7]}, {"role": "user", "content": None}], "n": 1}, "messages", [("user", "q"), ("assistant", "xy"), ("user", "")]),
    ({"conversations": [{"from": "human", "value": []}]}, "conversations", [("user", "")]),
]


def test_layouts(spark):
    records = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)] + [(90, None), (91, "{bad"), (92, "")]
    rows = chat.format_chats(spark.createDataFrame(records, "i int, record string").withColumn("layout", F.lit("mine"))).collect()
    for r in rows:
        layout, turns = LAYOUTS[r.i][1:] if r.i < 90 else (None, None)
        assert r.layout == layout
        assert (None if r.turns is None else [tuple(t) for t in r.turns]) == turns
        assert (r.formatted is None) == (turns is None)


def test_texts_in_parts(spark):
    rows = chat.format_chats(spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(IN_PARTS)], "i int, record string")).collect()
    assert {r.i: (r.layout, [tuple(t) for t in r.turns]) for r in rows} == {i: (layout, turns) for i, (_, layout, turns) in enumerate(IN_PARTS)}


def test_fields_left_out_are_named(spark):
    records = [{"messages": [], "id": 3, "source": "s"}, {"prompt": "p", "chosen": "c", "rejected": "r"}, {"question": "p", "answer": "c"}, {"x": "y"}]
    rows = chat.format_chats(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, record string")).collect()
    assert [r.left_out for r in sorted(rows)] == [["id", "source"], ["rejected"], [], None]


def test_conversations_come_back(spark):
    rows = [(1, i, ["user", "assistant", "system", None][i % 4], t) for i, t in enumerate(HARD)]
    rows += [(2, None, "user", None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, "odd role\n%", "x"), (3, 1, "user", "z" * 50_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("mine"))
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.message_records(table))).collect()}
    assert set(back) == {1, 2, 3, None}
    assert [(t.role, t.text) for t in back[1].read_turns] == [(r or "", t) for _, _, r, t in rows[: len(HARD)]]
    assert back[1].loss_text == "".join(t for _, _, r, t in rows[: len(HARD)] if r == "assistant")
    assert [t.text for t in back[2].read_turns] == ["", "a", "a"] and back[2].loss_text == "aa"
    assert back[None].read_turns[0].role == "odd role\n%"
    assert sum(run.length for run in back[1].loss_mask) == len(back[1].formatted)
    assert chat.format_chats(chat.message_records(table.limit(0))).count() == 0


def test_layouts_of_long_records(spark, monkeypatch):
    def found(records):
        return chat.format_chats(spark.createDataFrame([(t,) for t in records], "record string")).collect()

    broken = ['{"question": "\\q", "answer": ""}', '{"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": "\\u00zz"}]}', '{"question": "a", "answer": "b"} x']
    short = found(broken)
    assert [r.layout for r in short[:2]] == [None, None]
    monkeypatch.setattr(chat, "LONG", 0)
    test_layouts(spark)
    assert found(broken) == short
    hard = [{"messages": [{"content": t, "role": '"},{\\"'}, {"role": "user", "content": t}]} for t in [*HARD, '": "', '\\"', "}, {" * 9]]
    for x, r in zip(hard, found(map(json.dumps, hard)), strict=True):
        assert [tuple(t) for t in r.turns] == [(t["role"], t["content"]) for t in x["messages"]]


def test_texts_beyond_the_limits_of_variants(spark):
    turns = [(1, 0, "user", 21_000_000), (1, 1, "assistant", 5), (2, 0, "assistant", 7)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, n int").select("conv_id", "turn", "role", F.concat(F.repeat(F.lit('é\n"'), F.expr("n div 3")), F.lit("x")).alias("text"))
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.message_records(table))).select("conv_id", "layout", F.transform("read_turns", lambda t: F.struct(t["role"], F.length(t["text"]))).alias("t"), F.length("loss_text").alias("n")).collect()}
    assert [tuple(t) for t in back[1].t] == [("user", 21_000_001), ("assistant", 4)] and back[1].n == 4
    assert [tuple(t) for t in back[2].t] == [("assistant", 7)] and back[1].layout == back[2].layout == "messages"


PAGES = [
    (4, "http://a/é", "x" * 300),
    (2, "http://b/ \r\nX: 1", "x" * 300),
    (9, None, "x" * 300),
    (5, "http://c", "short"),
    (6, "http://c", "short"),
    (7, "u", None),
    (8, "u", ""),
    (10, "u", "ü" * 50),
    (11, "u", "ü" * 50),
    (12, "u", "y" * 99),
    (13, "u", "y" * 99),
    (14, "u", "line\r\n\r\nWARC/1.1\r\n" * 50_000),
    (2, "again", "x" * 300),
    (None, "u", "n" * 200),
    (None, "u", "n" * 200),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("mine")).repartition(3)


@pytest.mark.parametrize("most", [50_000, 0])
def test_archives(spark, pages, monkeypatch, most):
    monkeypatch.setattr(warc, "MAX_BROADCAST", most)
    index = warc.write_archives(pages, warc.archive_folder(spark))
    rows = warc.read_records(index).collect()
    assert len(rows) == len(PAGES)
    first = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        refers = first.get(html) if first.get(html) != i else None
        want.append((i, "response" if refers is None else "revisit", refers, len(payload), hashlib.sha256(payload).hexdigest(), payload if refers is None else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload))) for r in rows)
    some = warc.read_records(index.where("page_id IN (5, 9)")).collect()
    assert sorted(r.page_id for r in some) == [5, 9]
    assert {r.url for r in index.collect()} == {u for _, u, _ in PAGES}


def test_records_are_read_in_many_tasks(spark):
    many = spark.range(4000).selectExpr("id AS page_id", "CAST(NULL AS STRING) AS url", "concat('page ', sha2(CAST(id AS STRING), 256)) AS html").repartition(8)
    index = warc.write_archives(many, warc.archive_folder(spark))
    read = warc.read_records(index).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() > 1 and read.count() == 4000


def test_archives_are_gzip_members(spark, pages):
    index = warc.write_archives(pages, warc.archive_folder(spark)).orderBy("archive", "offset").collect()
    for archive in {r.archive for r in index}:
        data = open(archive.removeprefix("file://"), "rb").read()
        own = [r for r in index if r.archive == archive]
        assert sum(r.length for r in own) == len(data)
        for r in own:
            record = zlib.decompress(data[r.offset : r.offset + r.length], 31)
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n") and b"\r\nX: 1" not in record.split(b"\r\n\r\n")[0]


def test_archive_that_changed_is_refused(spark, pages):
    index = warc.write_archives(pages.where("page_id = 14"), warc.archive_folder(spark))
    r = index.first()
    path = r.archive.removeprefix("file://")
    data = warc.record_bytes(14, "u", b"other", "0" * 64, None)
    open(path, "wb").write(data + b"\0" * max(0, r.length - len(data)))
    with pytest.raises(Exception, match="digest|WARC|decompress"):
        warc.read_records(index).collect()


def test_no_pages(spark, pages):
    assert warc.read_records(warc.write_archives(pages.limit(0), warc.archive_folder(spark))).count() == 0


@given(st.lists(st.integers(0, 2000), max_size=30), st.integers(0, 300), st.integers(50, 3000))
@settings(max_examples=100, deadline=None)
def test_ranges_cover_the_places(gaps, gap, most):
    places, at = [], 0
    for g in gaps:
        at += g
        places.append((at, 40))
        at += 40
    found = warc.ranges(places, gap, most)
    assert [i for a, b, _, _ in found for i in range(a, b)] == list(range(len(places)))
    for a, b, low, high in found:
        assert low == places[a][0] and high == places[b - 1][0] + 40 and (high - low <= most or b - a == 1)
