"""Quality rules and URL filters against plain Python."""

import re
from collections import Counter

import pytest
import xxhash

from boreflow.llm import quality, url_filter
from boreflow.llm.components import connected_components
from boreflow.llm.shared import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "  \n\t", "one", "a b", "a b c a b c", "x " * 60, "line one\nline one\n\n \nline one\nother",
    "été # * $ % & | < > ü", "same words here " * 30, " ".join(f"w{i}" for i in range(80)),
    "p q r s p q r t q r s\x0bu\x0cv w", "🎉 " * 3 + "\x1c z", " ".join(f"w{i % 40}" for i in range(70)) + "\n###",
    "long" * 20000,
]


def base(text):
    w = WORD.findall(text or "")
    runs = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words int")
    got = quality.base_counts(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text), r.text


def bucket(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return (h - (1 << 64) if h >= 1 << 63 else h) % quality.BUCKETS


def test_score_is_the_ratio(spark):
    import math

    good = [f"the well of the {'abcdefgh'[i % 8]} is deep and the water of it is clear " * 5 for i in range(30)]
    rows = [(i, t) for i, t in enumerate(good + TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    trusted = spark.createDataFrame([(i,) for i in range(20)] + [(3,), (None,)], "doc_id bigint")
    model = quality.ratio_model(docs, trusted)
    grams = {i: [bucket(a) for a in w] + [bucket(*p) for p in zip(w, w[1:])] for i, t in rows for w in [WORD.findall(t or "")]}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if i < 20 else [])
    share = sum(target.values()) / sum(raw.values())
    llr = [math.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR)) for b in range(quality.BUCKETS)]
    for r in quality.judge(docs, model).collect():
        g = grams[r.doc_id]
        want = sum(llr[b] for b in g) / max(1, len(g))
        assert r.score == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_every_trusted_document_counts(spark):
    import math

    n, rare = 30_000, 50
    rows = [(i, f"rare{i % 7}" if i < rare else "plain") for i in range(n)] + [(n + i, "junk") for i in range(n)]
    docs = spark.createDataFrame([*rows, (None, "junk")], "doc_id bigint, text string")
    trusted = spark.range(n).toDF("doc_id")
    model = quality.ratio_model(docs, trusted.union(trusted))
    share = n / (2 * n + 1)
    for w, good, raw in [("plain", n - rare, n - rare), ("junk", 0, n + 1), ("rare0", 8, 8), ("rare6", 7, 7)]:
        want = math.log((good + quality.PRIOR) / (raw * share + quality.PRIOR))
        assert model[bucket(w)] == pytest.approx(want, abs=1e-12), w


def test_no_trusted_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = docs.where("false")
    assert set(quality.ratio_model(docs, none)) == {0.0} == set(quality.ratio_model(none, docs))
    assert quality.judge(none, [0.0] * quality.BUCKETS).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    host, rest = re.match(r"[^/?#]*", (a := url.split("://", 1)[1])).group(), None
    rest = a[len(host) :]
    path, host = re.match(r"[^?#]*", rest).group(), "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


URLS = [
    None, "", "no scheme", "http://", "http://NET/x", "http://a.NET", "https://x.example.net/en/1?q#f", "http://example.com/de/",
    "http://xexample.com/de/", "http://A.example.COM/de/x?y", "ftp://w.org/fr/", "http://org#/fr/", "a://b://net/", "http://É.net/",
    "http://example.net/en", "http://example.net?/en/", "http://h.net/\n/x",
]


@pytest.mark.parametrize("joined", [False, True])
def test_rules(spark, monkeypatch, joined):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, html string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if joined else RULES
    monkeypatch.setattr(url_filter, "INLINE_RULES", 1)
    got = url_filter.judge(pages, rules, Scratch(spark, "t")).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = judged(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r.url


def test_aliases(spark):
    link = '<html><head><link rel="canonical" href="{}"></head>'
    jump = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.com/1", jump.format("http://bad.net/x")), (2, "http://a.com/2", link.format("/1")),
        (3, "http://c.com/", link.format("http://d.org/fr/1")), (4, "http://e.com/", link.format("//c.com/")),
        (5, "http://e.com/f", jump.format("https://bad.net/y")), (6, "http://e.com/f#top", link.format("http://c.com")),
        (7, "http://z.com/", "canonical"), (8, "http://bad.net/q", link.format("http://d.org/fr/1")), (9, None, link.format("/x")),
    ]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), RULES, Scratch(spark, "t"))
    verdicts = {r.page_id: r.verdict for r in got.collect()}
    # 1 and 2 reach a blocked url; 3 to 6 and 8 are one component with an allowed member, but 8 has a rule of its own
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow"}
    more = spark.createDataFrame([("http://z.com/", "http://q.net/")], "from_url string, to_url string")
    got = url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), RULES, Scratch(spark, "t"), more_edges=more)
    assert {r.page_id: r.verdict for r in got.collect()}[7] == "block"


def test_one_form_of_an_alias(spark):
    link = '<base href="{}"><link rel="canonical" href="{}">'
    jump = '<meta http-equiv="refresh" content="0; url={}">'
    pages = [
        (1, "http://a.com/x//y?p=1&q=2", None), (2, "http://b.com/", jump.format("http://a.com/x//y?p=1&amp;q=2")),
        (3, "http://c.com/d/e", link.format("../f/", "./g/../h")), (4, "https://c.com/f/h#z", jump.format("http://bad.net/;v=1")),
        (5, "http://a.com/x/y?p=1&q=2", None), (6, "http://e.com/k?m", jump.format("?n")), (7, "http://e.com/k?n", jump.format("//bad.net")),
    ]
    more = spark.createDataFrame([("http://a.com/x//y?p=1&q=2", "http://bad.net/")], "from_url string, to_url string")
    got = url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), RULES, Scratch(spark, "t"), more_edges=more)
    assert {r.page_id for r in got.collect() if r.verdict == "block"} == {1, 2, 3, 4, 6, 7}
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter.judge(none, RULES, Scratch(spark, "t"), more_edges=more).count() == 0


@pytest.mark.parametrize("most", [1, 200])
def test_allow_goes_before_block_in_one_rule(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "INLINE_RULES", most)
    pages = spark.createDataFrame([(1, "http://a.com/x", None)], "page_id bigint, url string, html string")
    both = [("a.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block"), ("a.com", None, "block")]
    for rules in (both, both[::-1]):
        known = spark.createDataFrame(rules, "host string, path string, verdict string")
        assert [r.verdict for r in url_filter.judge(pages, known, Scratch(spark, "t")).collect()] == ["allow"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 3), (None, 4), (50, 49), (49, 50)]
    got = connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"), Scratch(spark, "t")).collect()
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)} | {3: 3, 49: 49, 50: 49}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint"), Scratch(spark, "t")).count() == 0
