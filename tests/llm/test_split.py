"""Splitting against a sequential splitter, and its properties."""

from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions.chunking import spans_of
from weftline.llm import split

TEXT = st.lists(st.sampled_from(["a", "é", "😀", " ", "\n", "\n\n", "\n#", "palavra ", "\f", "x" * 30]), max_size=400).map("".join)


def pieces(texts, limit, overlap):
    return [[(p["start"], p["end"], p["page"]) for p in row] for row in split._pieces(pa.array(texts, type=pa.string()), limit, overlap).to_pylist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.sampled_from([(1200, 120), (40, 10), (17, 5)]))
def test_equals_sequential_cuts(texts, sizes):
    for text, found in zip(texts, pieces(texts, *sizes)):
        raw = text.encode()
        if raw.strip(b" \t\n\r\v\f"):
            assert found == spans_of(raw, *sizes)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.sampled_from([(1200, 120), (40, 10), (17, 5)]))
def test_properties(text, sizes):
    raw, (limit, overlap) = text.encode(), sizes
    (found,) = pieces([text], *sizes)
    covered = bytearray(len(raw))
    for start, end, page in found:
        assert 0 < end - start <= limit and raw[start:end].decode() is not None
        assert page == 1 + raw[:start].count(b"\f") or not raw.strip()
        covered[start:end] = b"\1" * (end - start)
    if raw.strip():
        assert all(c or raw[i : i + 1].isspace() for i, c in enumerate(covered))
        assert all(b"\f" not in raw[s:e] for s, e, _ in found)
    for (a, b, p), (c, d, q) in zip(found, found[1:]):
        assert a < c and b < d and (p != q or b - overlap <= c <= b)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 1200), (4, "x" * 1201), (4, "x" * 1201), (5, "\f" * 1300), (6, "á" * 700), (7, "w " * 50_000)]
    df = spark.createDataFrame(rows, "record_id long, content string").withColumn("pieces", F.lit("clash")).withColumn("n_bytes", F.lit(0))
    found = split.split_oversized(df)
    assert sorted(r["record_id"] for r in found.collect()) == [4, 4, 5, 6, 7]
    exploded = split.explode_pieces(found)
    assert exploded.where("octet_length(piece) > 1200").count() == 0
    assert exploded.where("record_id = 7").count() > 80 and exploded.where("record_id = 5").count() == 1
    assert split.split_oversized(df.limit(0)).count() == 0


def test_whole_data(spark, data):
    from weftline.sources.tables import table

    assert split.p4_found(spark, data).count() == table(spark, data, "records").where("octet_length(content) > 1200").count()


@pytest.mark.parametrize("n", [1, 5, 200_000])
def test_text_without_borders(n):
    (found,) = pieces(["é" * n], 1200, 120)
    assert found[-1][1] == 2 * n and all(e - s <= 1200 for s, e, _ in found)


def test_texts_of_blanks_alone_are_cut_whole():
    found = pieces([" " * 5000, "\n" * 3000, " " * 100 + "\f" + " " * 2000], 1200, 120)
    for text, spans in zip((" " * 5000, "\n" * 3000, " " * 100 + "\f" + " " * 2000), found):
        covered = {i for start, end, _ in spans for i in range(start, end)}
        assert covered == {i for i, c in enumerate(text) if c != "\f"} and all(end - start <= 1200 for start, end, _ in spans)
