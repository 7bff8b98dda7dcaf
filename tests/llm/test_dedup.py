"""Near and exact duplicates against brute force."""

import random
import re

import pytest

from boreflow.llm import minmax_dedup
from boreflow.llm.shared import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def groups(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed, docs=150):
    rng = random.Random(seed)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(n)]
    bases = [say(rng.choice([3, 20, 60, 150])) for _ in range(12)]
    out = []
    for _ in range(docs):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 3)}"
        out.append(rng.choice(["  ", " ", "\n"]).join(w).replace("a1", "A1"))
    return out + [None, "", " \t\n", "one", "ONE", "two\x0bwords", "two words", "\x00", "\x01", "É é", "long " * 3000]


@pytest.mark.parametrize("block", [512, 7])
def test_near_groups(spark, monkeypatch, block):
    monkeypatch.setattr(minmax_dedup, "BLOCK", block)
    texts = corpus(3)
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id bigint, text string, cls binary")
    got = minmax_dedup.near_groups(docs, Scratch(spark, "t")).collect()
    assert sorted(tuple(r)[:4] for r in got) == groups(rows)


def test_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (9, "A b c d e f"), (4, None)], "doc_id bigint, text string")
    got = sorted(tuple(r)[:4] for r in minmax_dedup.near_groups(docs, Scratch(spark, "t")).collect())
    assert got == [(4, 0, 4, True), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False)]
    assert minmax_dedup.near_groups(docs.where("false"), Scratch(spark, "t")).count() == 0


def test_rows_without_an_id_are_linked(spark):
    say = " ".join(f"w{i}" for i in range(60))
    rows = [(None, say), (5, say + " end"), (9, say + " stop"), (None, "a b c d e f g"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r)[:4] for r in minmax_dedup.near_groups(docs, Scratch(spark, "t")).collect()]
    assert sorted(got, key=str) == sorted(
        [(None, 56, 5, False), (5, 57, 5, True), (9, 57, 5, False), (None, 3, None, True), (None, 0, None, True), (None, 0, None, True)], key=str
    )


def test_recall_at_the_threshold():
    """Pairs at the least similarity that links: share of them that meet in a band and pass the signature test."""
    import numpy as np

    rng = np.random.default_rng(7)
    for percent in (85, 80):
        n, met = 2000, 0
        for at in range(0, n, 250):
            sets = []
            for _ in range(250):
                total = int(rng.integers(60, 400)) * 20
                both = -(-total * percent // 100)
                pool = rng.integers(1, 1 << 63, total, dtype=np.uint64)
                half = both + (total - both) // 2
                sets += [np.sort(pool[:half]), np.sort(np.concatenate([pool[:both], pool[half:]]))]
            sig = minmax_dedup.signatures(sets)
            keys = minmax_dedup.band_keys(sig)
            s, values = percent / 100, sig.shape[1]
            least = (s - minmax_dedup.SLACK * (s * (1 - s) / values) ** 0.5) * values
            met += int(((keys[::2] == keys[1::2]).any(axis=1) & ((sig[::2] == sig[1::2]).sum(axis=1) >= least)).sum())
        assert met / n >= 0.999, (percent, met)


def test_signature_is_unbiased():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(1, 1 << 63, 3000, dtype=np.uint64)
    sig = minmax_dedup.signatures([np.unique(pool[:2000]), np.unique(pool[400:2400])])
    assert abs((sig[0] == sig[1]).mean() - 1600 / 2400) < 0.12


def cut(rows, length):
    import hashlib
    from collections import Counter

    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, raw, strict=True):
        gone = [False] * len(t)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,part,piece", [(1, 256, 1 << 24), (4, 256, 1 << 24), (5, 2, 70)])
def test_repeats_are_removed(spark, monkeypatch, batches, part, piece):
    from pyspark.sql import functions as F

    from boreflow.llm import suffix_index

    monkeypatch.setattr(suffix_index, "PART", part)
    monkeypatch.setattr(suffix_index, "PIECE", piece)
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["été", "ab", "cdefg", "hij", "k", "lmnopq", "rs"]) + str(rng.randint(0, 99)) for _ in range(n))
    shared = [say(n) for n in (20, 39, 40, 41, 60, 100)]
    rows = [(i, " ".join(rng.choice([say(rng.randint(1, 60)), rng.choice(shared)]) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 199), (103, "y" * 200), (104, "y" * 200), (105, "z" * 201), (106, "pq" * 300)]
    rows += [(107, shared[4]), (107, shared[4]), (107, shared[5]), (None, shared[3]), (108, shared[0] * 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, version int")
    got = suffix_index.remove_repeats(docs, Scratch(spark, "t"), batches=batches).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")), F.size("spans"), F.sha2("kept", 256)
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == cut(rows, suffix_index.LENGTH)
    assert suffix_index.remove_repeats(docs.where("false"), Scratch(spark, "t")).count() == 0


def test_a_new_batch_is_scanned_against_every_level(spark):
    from boreflow.llm import suffix_index

    rng = random.Random(4)
    say = lambda: "".join(rng.choice("abcdefghijkl ") for _ in range(300))
    old = [say() for _ in range(3)]
    family, noted = suffix_index.SuffixFamily(Scratch(spark, "t")), []
    for texts in ([old[0]], [old[1]], [old[2]], [old[0], say()], [old[2] + say()]):
        if len(noted) == 3:  # goes on from its tables
            family = suffix_index.SuffixFamily.resume(Scratch(spark, "t"), family.state())
        rows = spark.createDataFrame([(i + 10 * len(noted), t) for i, t in enumerate(texts)], "doc_id bigint, text string")
        family.add(suffix_index.versioned(rows))
        noted.append(family.noted[-1][1].count() > 0)
    assert noted == [False, False, False, True, True]
    reps = {r.rep.doc_id for r in family.scan().collect()}
    assert reps <= {0, 20, 30, 40} and {0, 20} <= reps


def test_suffixes_are_in_the_order_of_their_bytes():
    import numpy as np

    from boreflow.llm import suffix_index

    text = "é".encode() * 150 + b"".join(bytes([97 + i * i % 26]) for i in range(400))
    (x,) = suffix_index._pieces([text])
    heads = [text[i : i + 8] for i in range(len(text) - 7)]
    by_k = {int(k): None for k in x.k}
    known = {int((int.from_bytes(h, "big") ^ (1 << 63)) - (1 << 64 if int.from_bytes(h, "big") ^ (1 << 63) >= 1 << 63 else 0)): h for h in heads}
    assert set(by_k) <= set(known)
    ordered = [known[int(k)] for k in np.sort(x.k)]
    assert ordered == sorted(ordered)


def test_levels_merge_geometrically(spark):
    from boreflow.llm import suffix_index

    family = suffix_index.SuffixFamily(Scratch(spark, "t"))
    docs = suffix_index.versioned(spark.createDataFrame([(1, "abc" * 100)], "doc_id bigint, text string"))
    ranks = []
    for _ in range(5):
        family.add(docs)
        ranks.append([r for r, _, _ in family.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0]]
