"""Shared spans against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import spans


def brute(rows, length=spans.LENGTH):
    places = defaultdict(set)
    for doc, text in rows:
        if text is not None and doc is not None:
            for i in range(len(text) - length + 1):
                places[text[i : i + length]].add(doc)
    pairs = {(a, b) for docs in places.values() for a in docs for b in docs if a < b}
    shared = {doc: len({j for i in range(len(text) - length + 1) if len(places[text[i : i + length]]) > 1 for j in range(i, i + length)}) for doc, text in rows if text and doc is not None}
    return pairs, shared


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij é😀") for _ in range(n))
    pool = [word(n) for n in (199, 200, 201, 260, 500, 900)]
    out = []
    for i in range(160):
        parts = [word(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            piece = rng.choice(pool)
            at = rng.randrange(0, len(piece) // 3) if rng.random() < 0.4 else 0
            parts += [piece[at:], word(rng.randrange(0, 150))]
        out.append((i, "".join(parts)))
    hot = word(230)
    out += [(200 + i, word(50) + hot + word(20)) for i in range(150)]
    out += [(400, out[3][1]), (401, out[3][1]), (402, None), (403, ""), (404, "x" * 1000), (405, "x" * 1500), (None, hot)]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_pairs(df, rows):
    found = [tuple(r) for r in spans.document_pairs(*spans.shared_spans(df)).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)[0]


def test_coverage(df, rows):
    told, copies = spans.windows(df)
    found = {r["text_id"]: r["shared_chars"] for r in spans.coverage(told).collect()}
    copied = {r["doc_id"] for r in copies.collect()}
    expected = {doc: n for doc, n in brute(rows)[1].items() if n and doc not in copied and doc not in (404, 405)}
    assert {doc: n for doc, n in found.items() if doc in expected} == expected
    counted = {r["text_id"]: r["shared_chars"] for r in spans.coverage(told, most=1).collect()}  # by stretches, as in hot windows
    assert {doc: n for doc, n in counted.items() if doc in expected} == expected


def test_edges(spark, df):
    assert spans.document_pairs(*spans.shared_spans(df.limit(0))).count() == 0
    short = spark.createDataFrame([(1, "a" * 199), (2, "a" * 199)], "doc_id long, text string")
    assert spans.document_pairs(*spans.shared_spans(short)).count() == 0
    clash = df.withColumn("window", F.lit(1)).withColumn("text_id", F.lit("x")).withColumn("blocks", F.lit(0))
    assert spans.document_pairs(*spans.shared_spans(clash)).count() == spans.document_pairs(*spans.shared_spans(df)).count()


def test_a_hot_window_in_blocks(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    hot = word(210)
    rows = [(i, word(30) + hot + word(30)) for i in range(3 * spans.OCCURRENCES)]
    found = spans.document_pairs(*spans.shared_spans(spark.createDataFrame(rows, "doc_id long, text string"))).count()
    assert found == len(rows) * (len(rows) - 1) // 2


def test_anchors_depend_on_the_stretch_alone():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    stretch = word(spans.LENGTH)
    for _ in range(50):
        texts = [word(rng.randrange(60)) + stretch + word(rng.randrange(60)) for _ in range(2)]
        found = []
        for text in texts:
            _, start, hashes = spans.anchors([text])
            at = text.index(stretch)
            found.append({(s - at, h) for s, h in zip(start.tolist(), hashes.tolist()) if 0 <= s - at <= spans.LENGTH - spans.WINDOW})
        assert found[0] & found[1]


@pytest.mark.parametrize(("most_cells", "block"), [(1 << 27, 1 << 16), (1 << 11, 1 << 9)])
def test_the_prefilter_holds_whatever_the_input(spark, most_cells, block):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    piece = word(400)
    rows = [(i, word(900) + piece[: 400 if i in (3, 77) else 0] + word(100)) for i in range(200)]
    long = spark.createDataFrame(rows, "text_id long, text string").repartition(3)
    every = [h for _, text in rows for h in spans.anchors([text])[2].tolist()]
    cells, ranges = spans.sketch_size(len(every), most_cells, block)
    assert (ranges > 1) == (cells < len(every)) and cells <= most_cells
    kept = spans.repeated_places(long, most_cells=most_cells, block=block).collect()
    repeated = {h for h in every if every.count(h) > 1}
    windows = {r["window"] % 2**64 for r in kept}
    assert repeated and repeated <= windows and len(windows - repeated) < 0.1 * len(set(every))


def test_sketches_are_merged_in_a_tree(spark):
    hashes = [i * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for i in range(3000)]
    places = spark.createDataFrame([(h,) for h in hashes + hashes[:100]], "window long").repartition(9)
    flat = spans.merged_sketch(places, 1 << 14, 1 << 10)
    assert flat == spans.merged_sketch(places, 1 << 14, 1 << 10, fan_in=2) and any(flat)
    seen = {}
    for h in hashes + hashes[:100]:
        for row in range(spans.ROWS):
            cell = row * (1 << 14) + ((h % 2**64) >> (32 * row)) % (1 << 14)
            seen[cell] = seen.get(cell, 0) + 1
    assert {8 * i + j for i, b in enumerate(flat) for j in range(8) if b >> (7 - j) & 1} == {cell for cell, n in seen.items() if n > 1}
