"""Encoding against an independent implementation of the same vocabulary."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import tokenize
from weftline.sources.tables import table

public = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


VOCABULARY = tokenize.vocabulary(tokenize.vocabulary_path())


def ids(text):
    return np.frombuffer(VOCABULARY.pack(text), dtype=np.int32).tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="abcdeilnorstu '<|>", max_size=400), st.lists(st.sampled_from(["<|endoftext|>", "'ll", "  ", "\n\n", "ção", "😀", "123", "Ａ"])).map("".join)))
def test_equals_reference(text):
    found = Tokenizer.from_file(public.path("byte_bpe_50k.json")) if not hasattr(test_equals_reference, "t") else test_equals_reference.t
    found.encode_special_tokens = True
    test_equals_reference.t = found
    assert ids(text) == found.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 5_000, "é😀" * 3_000, "\0", "<|endoftext|>", "ababab" * 500])
def test_long_and_odd(reference, text):
    assert ids(text) == reference(text)


def test_round_trip():
    text = "Ação — 😀 naïve 漢字\r\n\t x"
    assert b"".join(VOCABULARY.bytes_of[i] for i in ids(text)).decode() == text


def test_edges(spark, reference):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "olá"), (3, "olá")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = tokenize.encode(df).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == [[], [], reference("olá"), reference("olá")]
    assert tokenize.encode(df.limit(0)).count() == 0
    assert [r[0] for r in df.select(tokenize.token_count("text").alias("n")).collect()] == [0, 0, len(reference("olá")), len(reference("olá"))]


def test_whole_table(spark, data, reference):
    rows = {r["doc_id"]: r["ids"] for r in tokenize.p6_ids(spark, data).collect()}
    texts = table(spark, data, "documents").select("doc_id", "text").collect()
    assert rows == {r["doc_id"]: reference(r["text"]) if r["text"] else [] for r in texts}
