"""Decontamination, toxicity, licences and WARC audits on small tables."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreflow.llm import decontaminate, licenses, toxicity, warc
from boreflow.llm.shared import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def leaks(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        m = min(10, len(b))
        windows = {tuple(b[s : s + m]) for s in range(len(b) - m + 1)} if b else set()
        for s in range(len(w) - m + 1):
            if b and tuple(w[s : s + m]) in windows:
                hit.update(range(s, s + m))
                found.add(i)
    return len(w), len(hit), sorted(map(str, found))


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 37)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(14)] + [(90, None), (91, " ,"), (3, say(12)), (92, "W1 w1")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)] + [(70, None), (71, ""), (71, items[5][1]), (71, items[5][1]), (None, items[4][1])]
    docs += [(80 + i, f"{say(4)}, {t}! {say(3)} {t}") for i, t in enumerate(t for _, t in items if t)]
    a = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, words string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find(a, b, Scratch(spark, "t")).withColumn("n", decontaminate.hit_words("spans")).collect()
    order = lambda r: tuple(map(str, r))
    mine = sorted(((r.doc_id, r.n_words, r.n, sorted(map(str, r.item_ids or []))) for r in got), key=order)
    assert mine == sorted(((i, *leaks(t, items)) for i, t in docs), key=order)
    none = decontaminate.find(a, b.where("false"), Scratch(spark, "t"))
    assert none.where("spans is not null").count() == 0 and none.count() == len(docs)
    assert decontaminate.find(a.where("false"), b, Scratch(spark, "t")).count() == 0


def test_proximity_on_stored_lists(spark):
    """Two rarest terms of a window by hand: counts over all words of the documents, then any two places close enough."""
    from collections import Counter

    rng = random.Random(9)
    say = lambda n: [rng.choice("abcdefghijkl") + str(rng.randint(0, 3)) for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate((1, 2, 5, 10, 14, 30))]
    docs = [(i, say(rng.randint(0, 50))) for i in range(40)]
    docs.append((40, ["x"] * 5000 + items[3][1]))
    total, want = Counter(w for _, ws in docs for w in ws), {}
    a = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    for i, ws in items:
        m = min(10, len(ws))
        for s in range(len(ws) - m + 1):
            best = sorted((total[w], w, j) for j, w in enumerate(ws[s : s + m]))
            for d, dw in docs if len(best) > 1 and best[0][0] else []:
                at = [[p for p, w in enumerate(dw) if w == x[1]] for x in best[:2]]
                if any(0 < abs(p - q) <= 4 for p in at[0] for q in at[1]):
                    want.setdefault(d, set()).add(i)
    got = decontaminate.find(a, b, Scratch(spark, "t"), distance=4).collect()
    assert {r.doc_id: set(r.near_ids) for r in got if r.near_ids} == want and len(got) == len(docs)


def test_leaks_in_long_and_repeated_rows(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = [(1, "w " * 200_000 + item), (2, item), (2, item), (2, "W"), (None, item), (3, None)]
    a = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, n_words int, item_ids int")
    b = spark.createDataFrame([(None, item), (7, None), (8, item)], "item_id bigint, text string")
    got = decontaminate.find(a, b, Scratch(spark, "t"), distance=10).withColumn("n", decontaminate.hit_words("spans")).collect()
    want = [(1, 200_012, 12), (2, 1, 0), (2, 12, 12), (2, 12, 12), (3, 0, 0), (None, 12, 12)]
    assert sorted(((r.doc_id, r.n_words, r.n) for r in got), key=str) == sorted(want, key=str)


def test_near(spark):
    docs = decontaminate.tokenized(spark.createDataFrame([(1, "a x b x x x x a"), (2, "b a")], "doc_id bigint, text string"))
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    got = decontaminate.near(docs, pairs, Scratch(spark, "t"), 2).collect()
    assert {(r.doc_id, r.pos_a, r.pos_b) for r in got} == {(1, 0, 2), (2, 1, 0)}


def test_toxicity(spark):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in ("tor", "mel", "sun", "val", "kir") for b in ("an", "en", "ith", "os", "um")]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        ws = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        ws += [rng.choice(["grobnik", "grobnikel", "Zluk!"])] * bad
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), 0.5))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (5000, None, 0.5), (5001, "", 0.5), (1, rows[1][1], 0.5)], "doc_id bigint, text string, score double")
    lab = spark.createDataFrame([*labels, (9999, 1), (7, None)], "doc_id bigint, toxic int")
    # labels of held-out rows are turned round: they must not be read
    turned = lab.withColumn("toxic", F.when(toxicity.in_training("doc_id"), F.col("toxic")).otherwise(1 - F.col("toxic")))
    model = toxicity.fit(docs, turned, Scratch(spark, "t"))
    got = toxicity.score(docs, model).withColumn("held_out", ~toxicity.in_training("doc_id")).collect()
    assert len(got) == 1503
    truth = dict(labels)
    held = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(held) > 0.97
    assert all(0 <= r.score < 0.5 for r in got if not r.text)
    assert toxicity.fit(docs, lab.where("false"), Scratch(spark, "t")).weights == {}
    assert toxicity.fit(docs.where("false"), lab, Scratch(spark, "t")).weights == {}
    long = model.score("grobnikel"), *(model.score("a" * n + "grobnikel" + "a" * n) for n in (20, 245, 246, 4090, 50_000))
    assert min(long) >= 0.5 and len(set(long[1:])) == 1
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_no_ngram_of_a_long_word_is_lost(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 7)
    for n in (1, 2, 4, 5, 6, 7, 12, 13, 61, 100):
        word = "".join(chr(97 + i * i % 26) for i in range(n))
        marked = f"<{word}>"
        want = {marked[i : i + k] for k in (4, 5, 6) for i in range(len(marked) - k + 1)} | ({marked} if n <= toxicity.WHOLE else set())
        assert set().union(*toxicity.features_of(word)) == want


def test_nnpu_separates_with_a_rough_prior():
    rows = [np.array([0]) for _ in range(50)] + [np.array([0] if i % 10 == 0 else [1]) for i in range(500)]
    w, b = toxicity.train_nnpu(rows, np.arange(550) < 50, 2, 0.12)
    assert b + w[0] > 0 > b + w[1]


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"][0]
    docs = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,")), (2, mit + " extra"), (3, None), (4, "  \n"),
        (5, "text\nreleased under the MIT licence\n(c) me"), (6, "SPDX-License-Identifier: Apache-2.0"), (5, "Zeile"),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, license string")
    known = licenses.known_licenses(spark, spark.createDataFrame([("mine", "a b"), (None, "c"), ("none", "!")], "license string, text string"))
    whole = {(r.doc_id, r.license) for r in licenses.scan(frame, known).collect()}
    assert whole == {(1, "MIT"), (2, None), (3, None), (4, None), (5, None), (6, "Apache-2.0-notice")}
    lines = {(r.doc_id, r.line, r.license) for r in licenses.notices(frame, known).collect()}
    assert lines == {(5, 1, "MIT-notice"), (6, 0, "Apache-2.0-notice")}
    assert licenses.scan(frame, known.where("false")).where("license is not null").count() == 0


PAGES = [(i, f"http://h/{i}", "<p>é" + "x" * (i * 977 % 30000)) for i in range(300)] + [(None, None, None), (7, "http://h/7", "again"), (7, "http://h/7", "again")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, offset int")


def test_audit_finds_planted_damage(spark, pages):
    a = warc.pack(pages, 100)
    assert a.count() == len(PAGES)
    s = Scratch(spark, "t")
    a = s.save(a, "first")
    assert warc.audit(a, a, Scratch(spark, "t")).count() == 0
    hurt = F.when(F.col("page_id") == 42, F.concat(F.col("record"), F.lit("!").cast("binary"))).otherwise(F.col("record"))
    b = a.where("page_id is null or page_id <> 250").withColumn("record", hurt)
    b = b.union(a.where("page_id = 9").withColumn("archive", F.lit("new")))
    got = {(r.archive, r.offset, r.status) for r in warc.audit(a, b, Scratch(spark, "t")).collect()}
    at = {r.page_id: r.offset for r in a.where("page_id in (42, 250, 9)").collect()}
    assert got == {("0", at[42], "corrupt"), ("2", at[250], "missing"), ("new", at[9], "extra")}
    assert warc.audit(a, a.where("false"), Scratch(spark, "t")).where("status = 'missing'").count() == len(PAGES)
    assert warc.audit(a.where("false"), a.where("false"), Scratch(spark, "t")).count() == 0


def test_files_round_trip(spark, pages):
    path = Scratch(spark, "t").path("warc")
    warc.write(pages, path)
    got = warc.read(spark, path + "/*.txt")
    want = pages.select(warc.record_of(F.col("page_id"), F.col("url"), F.col("html")).cast("binary").alias("r"))
    assert sorted(bytes(r.record) for r in got.collect()) == sorted(bytes(r.r) for r in want.collect())


def test_damaged_files_are_read_on(spark, tmp_path):
    import gzip

    one = lambda i, n="3": f"WARC/1.1\r\nWARC-Target-URI: u{i}\r\nContent-Length: {n}\r\n\r\nabc\r\n\r\n".encode()
    files = {
        "a": one(1) + one(2, "x") + one(3), "b": one(1) + one(2)[:-3], "c": b"", "d": b"rubbish", "e": one(1, "9") + one(2),
        "f": gzip.compress(one(1)) + gzip.compress(one(2)), "g": gzip.compress(one(1))[:-9], "h": one(1, "-3") + one(4),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    got = {}
    for r in warc.read(spark, f"file://{tmp_path}").orderBy("archive", "offset").collect():
        got.setdefault(r.archive[-6], []).append((r.uri, r.damaged, len(r.record)))
    n = len(one(1))
    assert got == {
        "a": [("u1", False, n), (None, True, n), ("u3", False, n)], "b": [("u1", False, n), (None, True, n - 3)], "d": [(None, True, 7)],
        "e": [(None, True, n), ("u2", False, n)], "f": [("u1", False, n), ("u2", False, n)], "g": [(None, True, len(files["g"]))],
        "h": [(None, True, n + 1), ("u4", False, n)],
    }


TITLES = {"MIT": ["MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "ISC License (ISC)"]}
TITLES |= {f"BSD-{n}-Clause": [f"BSD {n}-Clause License", f'BSD {n}-Clause "{w}" License'] for n, w in ((2, "Simplified"), (3, "New"))}
SHARED = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def wrapped(text, width):
    """Other line breaks within paragraphs, but not in those of a copyright line."""
    import textwrap

    parts = re.split(r"\n[ \t]*\n", text)
    keep = lambda p: re.search(r"(?im)copyright \(c\)|^\W*copyright[^\n]*(©|\d{4}|\[yyyy\])|^\W*-{5,}", p)
    return "\n\n".join(p if keep(p) else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in parts)


def test_licenses_with_titles_and_wrapping(spark):
    rows = []
    for name, titles in TITLES.items():
        for head in (t + "\n\n" + c for t in titles for c in ("Copyright (c) 2020 Some One\n\n", "Copyright Some One\n(c) Other\nAll rights reserved.\n\n", "")):
            rows += [(name, head + wrapped(licenses.KNOWN[name][0], w)) for w in (23, 50, 79, 10000)]
    for name, file in SHARED.items():
        path = f"/usr/share/common-licenses/{file}"
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                text = f.read()
            rows += [(name, text), (name, "Copyright 2020 Some One\n\n" + text)]
            first, rest = re.split(r"\n[ \t]*\n", text.strip("\n"), maxsplit=1)
            rows += [(name, first + "\n\n" + wrapped(rest, w)) for w in (37, 60, 100)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, want string, text string")
    got = licenses.scan(docs, licenses.known_licenses(spark)).collect()
    assert [(r.doc_id, r.want, r.text[:200]) for r in got if r.license != r.want] == []
    none = [(1, "MIT License"), (2, "MIT License\n"), (3, "Apache License\n\nother words")]
    frame = spark.createDataFrame(none, "doc_id bigint, text string")
    assert licenses.scan(frame, licenses.known_licenses(spark)).where("license is not null").count() == 0


def test_licence_query_counts_lines_of_each_row(spark, tmp_path):
    from boreflow.llm import queries

    two = "Licensed under the MIT License.\ntext\nReleased under the MIT License."
    rows = [(1, two), (1, two), (1, "Licensed under CC BY-NC 4.0."), (None, two), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_lines, r.line_licenses) for r in queries.op7_licenses(spark, str(tmp_path)).collect()), key=str)
    mit = "MIT-notice"
    assert got == sorted([(1, 2, mit), (1, 2, mit), (1, 1, "CC-BY-NC-4.0-notice"), (None, 2, mit), (2, 0, None), (3, 0, None)], key=str)
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op7_licenses(spark, f"{tmp_path}/none").count() == 0


def test_every_licence_line_of_the_documents_is_known(spark):
    docs = spark.createDataFrame([(1, "text\nLicensed under CC BY-NC 4.0.\nmore")], "doc_id bigint, text string")
    assert [tuple(r) for r in licenses.notices(docs, licenses.known_licenses(spark)).collect()] == [(1, 1, "CC-BY-NC-4.0-notice")]
