"""Token store and byte BPE against the tokenizer libraries themselves."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boreflow.llm import byte_bpe, token_store
from boreflow.llm.shared import Scratch

TEXTS = [
    (7, "It's 12 o'clock,  isn't it?\n\nYes.\n"), (1, ""), (3, None), (5, "ÉCOLE naïve　x\x1cy\x85z\t\ttab "),
    (5, "ÉCOLE"), (9, "a" * 5000 + " " + "xyz" * 3000), (2, "🎉🎉 漢字かな <|endoftext|> ok"), (8, " \n \n"),
]
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash") for r in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.bpe_of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_store_round_trip(spark, docs):
    path = Scratch(spark, "t").path("store")
    token_store.write(docs, path, P.path("word_bpe_49k.json"), 2)
    got = token_store.read(spark, path).select("*", F.crc32("ids").alias("crc")).orderBy("start").collect()
    tok, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for row, (i, t) in zip(got, sorted(TEXTS, key=lambda r: (r[0], r[1] or "")), strict=True):
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (i, start, len(want) // 4, want)
        assert row.crc == zlib.crc32(want)
        start += len(want) // 4
    assert {r.doc_id for r in token_store.lookup(spark, path, [9, 1]).collect()} == {1, 9}


def store_ids(spark, docs, tokenizer):
    path = Scratch(spark, "t").path("store")
    token_store.write(docs, path, tokenizer, 2)
    return [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.read(spark, path).orderBy("start").collect()]


def test_store_with_other_tokenizers(spark, docs, tmp_path):
    """A file that keeps white space, one that keeps capitals, one whose special token takes the space before it, and one that cuts."""
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec["normalizer"]["normalizers"]
    assert token_store.by_words(spec)
    changed = {
        "capitals": spec | {"normalizer": spec["normalizer"] | {"normalizers": [x for x in steps if x["type"] != "Lowercase"]}},
        "strips": spec | {"added_tokens": [t | {"lstrip": True} for t in spec["added_tokens"]]},
        "cuts": spec | {"truncation": {"max_length": 3, "strategy": "LongestFirst", "stride": 0, "direction": "Right"}},
    }
    files = {"bytes": P.path("byte_bpe_50k.json")}
    for name, x in changed.items():
        files[name] = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(x), encoding="utf-8")
    for name, file in files.items():
        tok = Tokenizer.from_file(file)
        tok.no_truncation()
        want = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in sorted(TEXTS, key=lambda r: (r[0], r[1] or ""))]
        assert token_store.encoder_of(file).words == (name == "cuts"), name
        assert store_ids(spark, docs, file) == want, name
    dropped = tmp_path / "dropout.json"
    dropped.write_text(json.dumps(spec | {"model": spec["model"] | {"dropout": 0.5}}), encoding="utf-8")
    with pytest.raises(ValueError, match="dropout"):
        token_store.encoder_of(str(dropped))


def test_store_of_long_and_equal_rows(spark):
    rng = np.random.default_rng(4)
    long = " ".join(rng.choice(["Alpha", "beta", "gam-ma", "d'Or", "42"], 300_000).tolist())
    rows = [(None, "a b")] * 3 + [(5, long)] + [(5, "same")] * 4
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [(i, [*tok.encode(t, add_special_tokens=False).ids, 2]) for i, t in sorted(rows, key=lambda r: (r[0] or 0, r[1]))]
    assert store_ids(spark, df, P.path("word_bpe_49k.json")) == want


def test_store_of_nothing(spark, docs):
    path = Scratch(spark, "t").path("store")
    token_store.write(docs.where("false"), path, P.path("word_bpe_49k.json"), 2)
    assert token_store.read(spark, path).count() == 0


def test_byte_bpe_frame(docs, library):
    how = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got = byte_bpe.decode(byte_bpe.encode(docs, *how), *how).collect()
    assert len(got) == len(TEXTS)
    for row in got:
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
        assert hashlib.sha256(row.decoded).hexdigest()


def test_byte_bpe_of_repeated_and_long_rows_and_of_nothing(spark, library):
    how = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    texts = ["the same", "the same", "it's " * 200_000, "漢" * 20_000]
    docs = spark.createDataFrame([(1, t, "x") for t in texts], "doc_id bigint, text string, decoded string")
    got = byte_bpe.decode(byte_bpe.encode(docs, *how), *how).collect()
    assert sorted(len(r.ids) for r in got) == sorted(len(library.encode_ordinary(t)) for t in texts)
    assert sorted(bytes(r.decoded) for r in got) == sorted(t.encode() for t in texts)
    assert byte_bpe.decode(byte_bpe.encode(docs.where("false"), *how), *how).count() == 0


def test_decoding_in_the_same_pass_and_texts_of_many_portions(spark, docs, bpe, library, monkeypatch):
    how = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    other = docs.withColumn("decoded", F.lit(1))
    for row in byte_bpe.encode(other, *how, out="Ids2", decoded="decoded").collect():
        assert row.Ids2 == library.encode_ordinary(row.text or "") and row.ids == "clash"
        assert bytes(row.decoded) == (row.text or "").encode()
    monkeypatch.setattr(byte_bpe, "TEXT_CHARS", 7)
    monkeypatch.setattr(byte_bpe, "IDS", 3)
    for _, text in TEXTS:
        ids = np.frombuffer(bpe.encode((text or "") * 3), "<u4")
        assert ids.tolist() == library.encode_ordinary((text or "") * 3)
        assert bpe.decode(ids).decode() == (text or "") * 3
    texts = [t or "" for _, t in TEXTS] * 2
    assert [len(x) // 4 for x in bpe.encode_texts(texts)] == [len(library.encode_ordinary(t)) for t in texts]


@pytest.mark.parametrize("pattern", [r"\p{L}+|\s+|[^\s\p{L}]", r"(?s).{1,7}", r"\S+\s*|\s+"])
def test_other_patterns_are_those_of_the_library(bpe, pattern):
    own = byte_bpe.PrefixBpe(bpe.ranks, pattern)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    for text in ("", "It's  a test of\n\nsome  patterns, isn't it? ", "abcdefghij klm" * 9):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode_ordinary(text)
        kept = byte_bpe.PrefixText(own, text)
        kept.edit(min(3, len(text)), min(4, len(text)), " new")
        assert kept.ids == other.encode_ordinary(kept.text)


ALPHABET = st.text(st.sampled_from("ab é'sdrt 12\n\t\x1c\x85 漢字🎉-=_.."), max_size=40)


@settings(max_examples=300, deadline=None)
@given(text=ALPHABET)
def test_encoding_is_that_of_the_library(bpe, library, text):
    ids = np.frombuffer(bpe.encode(text), "<u4")
    assert ids.tolist() == library.encode_ordinary(text)
    assert bpe.decode(ids).decode() == text


@settings(max_examples=150, deadline=None)
@given(text=ALPHABET, edits=st.lists(st.tuples(st.integers(0, 40), st.integers(0, 5), ALPHABET), max_size=4))
def test_edits_and_appends(bpe, library, text, edits):
    kept = byte_bpe.PrefixText(bpe, text)
    for at, n, new in edits:
        at = min(at, len(kept.text))
        kept.edit(at, min(at + n, len(kept.text)), new)
        assert kept.ids == library.encode_ordinary(kept.text)
    kept.append("more of it")
    assert kept.ids == library.encode_ordinary(kept.text)


def test_edit_encodes_few_pieces(bpe):
    kept = byte_bpe.PrefixText(bpe, "word " * 2000)
    assert kept.edit(5000, 5001, "W") < 10


def test_prefix_table_grows_by_append(bpe):
    last = bpe.prefixes(b"thereby")
    assert bpe.prefixes(b"thereby, not", list(last)) == bpe.prefixes(b"thereby, not")
