"""Forced-boundary BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from funnelyard.llm.bpe_codec import Codec, decode_documents, encode_documents
from funnelyard.llm.queries import QUERIES
from funnelyard.llm.words import column_bytes

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", "re", "st", "K", "X", "z", "0", "19", "'", "'s", "'re", "'ll", "'ve", "don't", '"', "-", "--", "...", "!?", "(", "#", " ", "  ", "\n", "\t", "\r", "\x00", "\x0b",
          "\x1c", "\x85", " ", " ", "　", "é", "É", "ß", "İ", "ſ", "K", "Σ", "ς", "é", "́", "≮", "≠", "中", "文字", "😀", "‍", "½", "²", "٣", "ŉ",
          "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for _ in range(6000)]
    whole, codec = Tokenizer.from_file(public_tokenizers.path(name)), Codec(public_tokenizers.path(name))
    got = codec.encode(*column_bytes(pa.array(texts)))
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_changes_nothing():
    codec, texts = Codec(WORDS), pa.array(["some words of a text " * 50, "other words", "<|endoftext|> some"])
    once = codec.encode(*column_bytes(texts))
    codec.held = 1 << 60
    more = pa.array([*texts.to_pylist(), "a fragment that is new"])
    assert codec.encode(*column_bytes(more))[:3] == once and codec.held < 1 << 20


def test_letters_are_cut_inside_words():
    codec = Codec(WORDS)
    starts, ends, kind, raw = codec.cuts(*column_bytes(pa.array(["xqzjv word"])))
    assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == b"xqzjvword" and (kind[:-1] == 1).any()


def expected(text):
    ids = whole().encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(whole().decode(ids, skip_special_tokens=False).encode()).hexdigest())


def whole(kept=[]):  # noqa: B006
    if not kept:
        kept.append(Tokenizer.from_file(WORDS))
        kept[0].no_truncation()
        kept[0].no_padding()
    return kept[0]


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_forced_boundary_bpe"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {d: expected(t) for d, t in texts.items()} and len(rows) == len(texts)


def test_nulls_long_texts_and_clashing_names(spark):
    r = random.Random(1)
    texts = [None, "", " \n", "é" * 300_000, "".join(r.choice("qxzjv'") for _ in range(200_000)), "a <|endoftext|>b", "a <|endoftext|>b"]
    df = spark.createDataFrame([(None if i == 1 else i % 5, t, 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string")
    found = decode_documents(encode_documents(df, WORDS), WORDS).collect()
    assert sorted((str(f.doc_id), f.n_tokens, hashlib.sha256(f.ids).hexdigest(), hashlib.sha256(f.decoded.encode()).hexdigest()) for f in found) == sorted(
        (str(d[0]), *expected(t)) for d, t in zip([(None if i == 1 else i % 5,) for i in range(7)], texts))
    assert encode_documents(df.limit(0), WORDS).count() == 0
    odd = spark.createDataFrame([(bytearray(np.array([0, 1 << 31, 49407], "<u4").tobytes()), "old"), (None, "old")], "ids binary, Decoded string")
    assert [r.decoded for r in decode_documents(odd, WORDS).collect()] == [whole().decode([0, 1 << 31, 49407], skip_special_tokens=False), ""]


def test_general_vocabulary_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Any text, l'été — 中文 😀\n\tkept as it is.", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.decoded for r in decode_documents(encode_documents(df, path), path).collect()) == sorted(texts)
