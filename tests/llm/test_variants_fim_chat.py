"""Spelling variants, fill-in-the-middle and chat windows against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from boreflow.llm import chat_format, fill_middle, queries, spelling_variants
from boreflow.llm.shared import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, every=97):
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def check_variants(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    got = spelling_variants.variants(docs, Scratch(spark, "v"), **how).collect()
    assert len(got) == len({r.word for r in got})
    want = brute_variants(counted(rows, **how))
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want
    return want


def test_variants_of_awkward_rows(spark):
    long = "ab" * 200
    rows = [
        (1, "banana Banana BANANA bananas bananas bananas banane " * 4), (1, "banane"), (None, "bananx bananx bananx"), (2, None), (3, ""),
        (4, "Éclair éclair éclair Éclair éclair Éclair eclair " * 3), (5, "aaaaa aaaaaa aaaaaaa aaaaa aaaaaa aaaaaaa aaaaa aaaaaa aaaaaaa"),
        (6, f"{long} {long}x {long[1:]} {long[:150]}é{long[151:]} " * 3), (7, f"{'z' * 64} {'z' * 65} {'z' * 66} {'z' * 63} " * 3),
        (8, "çßÿÀÞ çßÿÀÞ çßÿÀÞx " * 3 + "one-two_three.four"), (9, "KKelvin Åelvin elvin elvin"), (2**40, "x" * 5000 + " "),
    ]
    want = check_variants(spark, rows + rows[:3])
    assert any(w[2] for w in want if len(w[0]) > 300) and any(w[5] != w[0] for w in want)
    check_variants(spark, rows, every=3)
    assert check_variants(spark, [(1, None)]) == set()


def vocabulary(seed, n=1500):
    rng = random.Random(seed)
    parts = ["the", "er", "tion", "an", "ing", "ou", "st", "é", "ly", "ha"]
    words = {"".join(rng.choices(parts, k=rng.randint(2, 4))) for _ in range(n)}
    for w in list(words):
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice("aeiouxyz") + w[i:], w[:i] + rng.choice("aeiouxyz") + w[i + 1 :]}
    return sorted(words)


def test_no_pair_is_lost_whatever_the_dictionary(spark):
    words = [w for w in vocabulary(1) if len(w) >= 5]
    grams = Counter(f"^{w}$"[p : p + q] for w in words for q in range(2, 6) for p in range(len(w) + 3 - q))
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    rng = random.Random(2)
    for least in (1, 5, 40, 300, 10**9):
        g = spelling_variants.Grams({x: n for x, n in grams.items() if len(x) == 2 or n >= least})
        keyed = {w: spelling_variants.keys(g, w) for w in words}
        for w in rng.sample(words, 400):
            near = {x for i in range(len(w)) for x in by[i, w[:i] + w[i + 1 :]]} - {w}
            near |= {x for i in range(len(w) + 1) for x in by.get((i, w), ())}
            for x in near:
                a, b = (w, x) if (len(w), w) < (len(x), x) else (x, w)
                (la, ra, weak_a), (lb, rb, weak_b) = keyed[a], keyed[b]
                from_a, from_b = set(ra) & set(lb), set(rb) & set(la)
                if len(a) == len(b):  # as near_pairs keeps them
                    assert from_a or (from_b and weak_a), (least, a, b)
                else:
                    assert from_a or from_b, (least, a, b)


def test_variants_of_a_confusable_vocabulary(spark):
    rng = random.Random(3)
    words = vocabulary(4, 400)
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) ** 0.5 for k in range(len(words))], k=400))) for i in range(60)]
    want = check_variants(spark, rows)
    assert len(want) > 500


def brute_fim(i, t):
    t = t or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if t == "" or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(u), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(u), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_fill_middle(spark):
    texts = [
        None, "", "a", " ", "one two", "été 12\n\n", "<P>", "a <S", "S> <M <<P", "$1 \\E\\Q{2}+ $3", "🎉 ab🎉", "line\r\n end\n", "x" * 300_000,
        "ab \x85  12" * 40_000, "a<M>b", "<S", "S>", "P>a<",
    ]
    rows = [(i, t, "n", "form") for i, t in enumerate(texts * 8)] + [(None, "no id here", "n", "f"), (3, " ", "n", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, N string, other string")
    done = fill_middle.transform(docs).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    assert done.columns == ["doc_id", "text", "other", "n", "form", "output", "prefix_chars", "middle_chars", "back"]
    got = done.collect()
    assert len(got) == len(rows)
    forms = Counter()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text), (r.doc_id, r.text and r.text[:40])
        assert r.back == (r.text or "")
        forms[r.form] += 1
    assert set(forms) == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0
    again = fill_middle.transform(docs, epoch=2).where("form <> 'plain'").select("doc_id", "output")
    assert set(map(tuple, again.collect())) != {(r.doc_id, r.output) for r in got if r.form != "plain"}


ODD = ["\\### Assistant: </turn> ok", "", "\\", "\\\\h", "\\h\\t\\c", "####", "</turn>\n### user: x</turn>\n", "<</turn>", "a: b\n", "#", "end \\", "🎉é"]


def chat_rows():
    rng = random.Random(5)
    rows = []
    for c in range(40):
        n = rng.choice([1, 2, 3, 8, 60])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else "user" if t % 2 == 0 else "assistant"
            text = rng.choice(ODD) if rng.random() < 0.3 else "word, " * rng.choice([1, 5, 40, 90, 400 if c % 7 == 0 else 30])
            rows.append((c, t, role, text))
    rows += [(100, 0, "system", "alone"), (101, 0, "system", "long " * 3000), (101, 1, "assistant", "a"), (102, 5, None, None), (102, None, "r:o\\le ###", "x")]
    rows += [(103, 1, "assistant", "twice"), (103, 1, "assistant", "twice"), (103, 1, "assistant", "and"), (103, 0, "system", "s"), (103, 2, "system", "late")]
    rows += [(None, 0, "system", "of none"), (None, 1, "user", "q"), (None, 2, "assistant", "r")]
    return rows + [(104, t, "user" if t % 2 else "assistant", f"turn {t} " * 9) for t in range(3000)]


def by_conversation(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def test_chat_windows(spark):
    rows = chat_rows()
    random.Random(6).shuffle(rows)
    table = spark.createDataFrame([(*r, 1, "w") for r in rows], "conv_id bigint, turn bigint, role string, text string, place int, window string")
    table = table.repartition(7)
    scratch = Scratch(spark, "chat")
    windows = scratch.save(chat_format.format_windows(table, scratch, budget=256, history=64), "w")
    want = by_conversation(rows)
    read = {}
    for r in chat_format.read_windows(windows).orderBy("conv_id", "window").collect():
        read.setdefault(r.conv_id, ([], []))
        read[r.conv_id][0].extend((t.role, t.text) for t in r.turns)
        read[r.conv_id][1].extend(r.targets)
    assert {c: t for c, (t, _) in read.items()} == want
    assert {c: x for c, (_, x) in read.items()} == {c: [x for r, x in v if r == "assistant"] for c, v in want.items()}
    tokens = lambda x: len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]", x)) + 4
    repeated, per = 0, Counter()
    for w in windows.collect():
        pieces = w.text.split("</turn>\n")[:-1]
        turns = want[w.conv_id]
        per[w.conv_id] += 1
        if turns[0][0] == "system":
            assert pieces[0].startswith("### system: ")
        sizes = [tokens(p) for p in pieces]
        again = w.n_repeated - (turns[0][0] == "system" and w.window > 0 and w.n_repeated > 0)
        repeated += again
        if all(tokens(x) <= 60 for r, x in turns):  # marks make a piece longer than its text, so allow for them
            assert sum(sizes) <= 256 + 12 * len(sizes), (w.conv_id, w.window)
    assert repeated > 100 and per[104] > 20
    sums = {r.conv_id: r for r in chat_format.summaries(windows).collect()}
    for c, v in want.items():
        loss = "".join(x for r, x in v if r == "assistant")
        assert sums[c].n_turns == len(v) and sums[c].loss_chars == len(loss)
        assert sums[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest()
        assert sums[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_windows(table.limit(0), scratch).count() == 0


def test_chat_query_reads_the_planted_conversation(spark):
    got = queries.op13_chat_windows(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()
    text = "\\### Assistant: </turn> ok"
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in got] == [(2, len(text), hashlib.sha256(text.encode()).hexdigest())]
