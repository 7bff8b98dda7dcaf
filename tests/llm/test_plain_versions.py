"""Toxicity and licences against plain Python that recomputes every score, risk and digest."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
import regex

from boreflow.llm import licenses, toxicity
from boreflow.llm.queries import op7_licenses

SF = "/root/testdata/sf0.001"


def plain_features(text):
    """All marked 4- to 6-grams of all words, and the words of up to 60 letters."""
    out = set()
    for word in regex.findall(r"[^\W\d_]+", (text or "").lower()):
        marked = f"<{word}>"
        out |= {marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)}
        if len(word) <= 60:
            out.add(marked)
    return out


def test_scores_by_hand(spark):
    rng = random.Random(8)
    parts = ["grob", "nik", "tor", "mel", "sun", "Ätz", "val"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", "12 34", "grob" * 3000, "x" + "nik" * 40]
    features = sorted(set().union(*map(plain_features, texts)))
    weights = {f: rng.uniform(-1, 1) for f in rng.sample(features, 300)}
    model = toxicity.Model(weights, -0.4)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    for i, t in enumerate(texts):
        g = -0.4 + sum(w for f, w in weights.items() if f in plain_features(t))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-g)), abs=1e-9)


def plain_nnpu(rows, positive, n, prior, steps, rate=0.3, decay=1e-5):
    """The same risk by sums over single documents, its slope by differences, and the same step rule."""

    def parts(w):
        score = [w[-1] + sum(w[j] for j in r) for r in rows]
        loss = [1 / (1 + math.exp(g)) for g in score]  # of a positive label; the other one is 1 - loss
        pos, unl = [x for x, p in zip(loss, positive, strict=True) if p], [x for x, p in zip(loss, positive, strict=True) if not p]
        first = prior * sum(pos) / len(pos)
        second = sum(1 - x for x in unl) / len(unl) - prior * sum(1 - x for x in pos) / len(pos)
        return first, second

    def slope(f, w):
        out = []
        for j in range(n + 1):
            up, down = list(w), list(w)
            up[j] += 1e-5
            down[j] -= 1e-5
            out.append((f(up) - f(down)) / 2e-5)
        return np.array(out)

    w, m, v, backward = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0
    for step in range(1, steps + 1):
        if parts(w)[1] >= 0:
            g = slope(lambda x: sum(parts(x)), w)
        else:
            g, backward = -slope(lambda x: parts(x)[1], w), backward + 1
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, backward


@pytest.mark.parametrize("prior", [0.2, 0.6])
def test_risk_by_hand(prior):
    rng = np.random.default_rng(2)
    positive = np.arange(24) < 8
    rows = [np.flatnonzero(rng.random(4) < (0.8 if p else 0.3)) for p in positive]
    want, backward = plain_nnpu([r.tolist() for r in rows], positive.tolist(), 4, prior, 25)
    w, b = toxicity.train_nnpu(rows, positive, 4, prior, steps=25)
    assert np.allclose([*w, b], want, atol=1e-4)
    assert backward > 0 or prior < 0.5  # a prior too high makes the estimate negative, and the step goes back


def plain_form(text):
    """Canonical form by plain Python."""
    flags = regex.ASCII
    t = regex.sub(licenses._HEADER.replace(r"\z", r"\Z"), "", (text or "").lower(), flags=flags)
    t = regex.sub(licenses._COPYRIGHT.replace(r"\z", r"\Z"), "", t, flags=flags)
    t = regex.sub(r"(?<=\p{L})-(?=\p{L})", "", t)
    return " ".join(licenses.EQUIVALENT.get(w, w) for w in regex.split(r"[^\p{L}\p{N}]+", t) if w)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_license_scan_of_the_tables(spark):
    known = {}
    for name, texts in licenses.KNOWN.items():
        for t in texts:
            known.setdefault(sha(plain_form(t)), set()).add(name)
    for name, given in licenses.KNOWN_DIGESTS.items():
        for d in given:
            known.setdefault(d, set()).add(name)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, lines = {}, 0
    for r in docs:
        digest = sha(plain_form(r.text))
        found = [known[d] for d in (sha(plain_form(x)) for x in (r.text or "").split("\n") if regex.search(r"[\p{L}\p{N}]", x)) if d in known]
        lines += len(found)
        names = ",".join(sorted({",".join(sorted(f)) for f in found})) if found else None
        want[r.doc_id] = (digest, ",".join(sorted(known[digest])) if digest in known else None, len(found), names)
    got = {r.doc_id: (r.digest, r.license, r.n_lines, r.line_licenses) for r in op7_licenses(spark, SF).collect()}
    assert got == want and len(docs) == len(got)
