"""Work that stays bounded on awkward texts: long benchmark items, lines without letters, impossible lengths, other threads."""

import random
import threading
import time

from boreflow.llm import decontaminate, licenses, warc
from boreflow.llm.shared import Scratch, cleaned


def hits(doc, items, window=10):
    w, hit, found = doc.split(), set(), set()
    for i, t in items:
        t = t.split()
        m = min(window, len(t))
        known = {tuple(t[s : s + m]) for s in range(len(t) - m + 1)}
        for s in range(len(w) - m + 1):
            if tuple(w[s : s + m]) in known:
                hit.update(range(s, s + m))
                found.add(i)
    return len(hit), found


def test_items_over_several_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", 4)
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["a", "b", "c", "d1"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((9, 10, 11, 13, 14, 15, 40, 200))]
    docs = [(i, say(80)) for i in range(30)] + [(30 + i, f"x {t} y {t[: len(t) // 2]}") for i, t in items]
    got = decontaminate.find(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), Scratch(spark, "t")
    ).withColumn("n", decontaminate.hit_words("spans"))
    assert {r.doc_id: (r.n, set(r.item_ids or [])) for r in got.collect()} == {i: hits(t, items) for i, t in docs}


def test_a_very_long_item(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(100_000)]
    docs = [(1, " ".join(words[500:600])), (2, " ".join(words[99_000:99_009])), (3, " ".join(words))]
    found = decontaminate.find(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string"), Scratch(spark, "t"), distance=10
    ).withColumn("n", decontaminate.hit_words("spans"))
    assert {r.doc_id: r.n for r in found.collect()} == {1: 100, 2: 0, 3: 100_000}


def test_a_megabyte_of_lines_without_letters(spark):
    rule = "-----------\n" * 90_000
    texts = ["ISC License\n" + rule, rule + "Copyright 2020 A. B.\n" + rule, "all rights reserved\n" + rule * 2 + "x", rule + "(c) 2020\nend " + rule, "©\n" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.time()
    got = licenses.scan(docs, licenses.known_licenses(spark)).select("doc_id", "license").collect()
    assert len(got) == len(texts) and not any(r.license for r in got)
    assert licenses.notices(docs.where("doc_id < 2"), licenses.known_licenses(spark)).count() == 0
    assert time.time() - began < 120


def test_a_length_of_5000_digits():
    whole = b"WARC/1.1\r\nWARC-Target-URI: u\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    broken = b"WARC/1.1\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\nab\r\n\r\n"
    data = broken + whole
    assert [(data[a:b], uri) for a, b, uri in warc._records(data)] == [(broken, None), (whole, "u")]


def test_scratch_of_another_thread_stays(spark):
    df, made = spark.range(3), {}

    def other():
        made["x"] = Scratch(spark, "other").save(df, "t")

    with cleaned():
        mine = Scratch(spark, "mine")
        mine.save(df, "t")
        t = threading.Thread(target=other)
        t.start()
        t.join()
        with cleaned():
            inner = Scratch(spark, "inner").save(df, "t")
            assert inner.count() == 3
    assert made["x"].count() == 3
    fs = spark._jvm.org.apache.hadoop.fs.Path(mine.base)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
