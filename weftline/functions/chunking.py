"""Spans in which long texts are indexed: at most `limit` bytes, cut at headings, paragraphs, lines, spaces."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T

from weftline.functions.arrow import arrow_column

LIMIT, OVERLAP = 1200, 120
#: Strongest first: where to look, and how many bytes of the mark stay with the piece before the cut.
BORDERS = ((b"\n#", 1), (b"\n\n", 2), (b"\n", 1), (b" ", 1))

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "page")]))
_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "page")]))


def spans_of(raw: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, page) of a text's chunks, each page by itself; a text of blank pages has one chunk."""
    out: list[tuple[int, int, int]] = []
    base = 0
    pages = raw.split(b"\f")
    for number, page in enumerate(pages, 1):
        start = 0
        while (len(pages) == 1 or page.strip()) and (start < len(page) or not page):
            stop = start + limit
            if stop >= len(page):
                end = len(page)
            else:
                cuts = (page.rfind(mark, start, stop) + keep for mark, keep in BORDERS if page.rfind(mark, start, stop) - start > limit // 2)
                end = next(cuts, None) or _character_start(page, stop)
            out.append((base + start, base + end, number))
            if end == len(page):
                break
            back = _character_start(page, max(end - overlap, start + 1))
            space = page.find(b" ", back, end)
            start = space + 1 if space >= 0 else end
        base += len(page) + 1
    return out or [(0, len(raw), 1)]


def _character_start(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _chunks(texts: pa.Array, limit: int, overlap: int) -> pa.Array:
    out = [[dict(zip(("start", "end", "page"), s)) for s in spans_of(t.encode(), limit, overlap)] if t is not None else None for t in texts.to_pylist()]
    return pa.array(out, type=_SPANS)


def chunk_spans(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """ARRAY of (start, end, page) byte offsets; null for a null text."""
    return arrow_column(functools.partial(_chunks, limit=limit, overlap=overlap), SPANS, text)
