"""Splitting of oversized texts at natural boundaries, with overlap (problem 4).

A piece starts at some byte and ends at the farthest legal boundary under the limit: before a heading, after a paragraph,
after a line or after a space, in this order of strength, as long as the boundary lies past half the limit; else at the
last character border under the limit. The next piece starts up to `overlap` bytes before that end, behind a space, so
the end of one piece is repeated at the start of the next. Pages (form feeds) are split on their own.

The cuts of one text depend on each other, so they are derived by pointer doubling instead of a scan: every byte is
joined to the start of the piece that would follow a piece starting there, which is one table for all texts of an Arrow
batch; the table is then squared again and again (successor of successor), and after k rounds the first 2^k starts of
every page of every text are known at once. All steps are array operations over a whole group of texts.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrow import arrow_column
from weftline.sources.tables import table

LIMIT, OVERLAP = 1200, 120
#: Texts are handled in groups of about so many bytes, to bound a worker's memory; a longer text is a group of its own.
GROUP_BYTES = 1 << 20

PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("page", T.IntegerType())]))
_PIECES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("page", pa.int32())]))

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def _last_before(at: np.ndarray) -> np.ndarray:
    """For each byte the last marked byte up to it, or -1."""
    return np.maximum.accumulate(np.where(at, np.arange(len(at), dtype=np.int32), np.int32(-1)))


def _next_after(at: np.ndarray) -> np.ndarray:
    """For each byte the next marked byte from it on, or the length."""
    n = len(at)
    return np.minimum.accumulate(np.where(at, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]


def successors(raw: np.ndarray, ends: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: where a piece starting there ends, and where the piece after it starts (itself: none follows).

    `ends` has for each byte the end of its page. A byte inside a character never becomes a start.
    """
    n = len(raw)
    here = np.arange(n, dtype=np.int32)
    stop = here + np.int32(limit)
    last = stop >= ends  # the rest of the page fits
    border = (raw & 0xC0) != 0x80
    before = _last_before(border)
    cut = np.minimum(stop, n - 1)
    end = np.where(border[cut], cut, before[cut])
    newline, space, heading = raw == 10, raw == 32, raw == 35
    pair = lambda a, b: np.append(a[:-1] & b[1:], False)
    for mark, width, keeps in ((space, 1, 1), (newline, 1, 1), (pair(newline, newline), 2, 2), (pair(newline, heading), 2, 1)):
        found = _last_before(mark)[np.clip(stop - np.int32(width), 0, n - 1)]
        end = np.where(found - here > limit // 2, found + np.int32(keeps), end)
    end = np.where(last, ends, np.maximum(end, here + 1)).astype(np.int32)
    back = np.maximum(end - np.int32(overlap), here + 1)
    back = np.where(border[np.minimum(back, n - 1)], back, before[np.minimum(back, n - 1)])
    back = np.maximum(back, here)  # stays behind the start even where one character is all there is
    behind = _next_after(space)[np.minimum(back, n - 1)] + 1
    start = np.where((behind <= end) & (behind > here), behind, end)
    return end, np.where(last, here, start).astype(np.int32)


def starts_of_all(first: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """Marks every start reachable from `first`, by pointer doubling."""
    marked = np.zeros(len(succ), dtype=bool)
    marked[first] = True
    known, jump = first, succ
    while True:
        reached = jump[known]
        new = np.unique(reached[~marked[reached]])
        if not len(new):
            return marked
        marked[new] = True
        known = np.concatenate([known, new])
        jump = jump[jump]


def split_group(texts: list[bytes], limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end and page of every piece of some texts. Blank pages have none, but in a text of blanks alone."""
    raw = np.frombuffer(b"\f".join(texts) + b"\f", dtype=np.uint8)  # each text and each page ends with a form feed
    feeds = np.flatnonzero(raw == 12).astype(np.int32)
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int32)
    begins = np.concatenate([[0], feeds[:-1] + 1]).astype(np.int32)
    inked = np.concatenate([[0], np.cumsum(~SPACES[raw])])
    of_page = np.searchsorted(base, begins, side="right") - 1
    unwritten = inked[base[1:] - 1] == inked[base[:-1]]  # texts of blanks alone are cut like any other
    full = (feeds > begins) & ((inked[feeds] > inked[begins]) | unwritten[of_page])
    ends = feeds[np.searchsorted(feeds, np.arange(len(raw), dtype=np.int32))]
    end, succ = successors(raw, ends, limit, overlap)
    marked = np.flatnonzero(starts_of_all(begins[full], succ)).astype(np.int32) if full.any() else np.zeros(0, np.int32)
    page = np.searchsorted(begins, marked, side="right") - 1
    owner = of_page[page]
    first_page = np.searchsorted(begins, base[:-1])
    number = page - first_page[owner] + 1
    stop = end[marked]
    blank = np.setdiff1d(np.flatnonzero(np.diff(base) > 1), owner)
    owner, start, stop, number = (np.concatenate(x) for x in ((owner, blank), (marked - base[owner], 0 * blank), (stop - base[owner], np.minimum(np.diff(base)[blank] - 1, limit)), (number, 0 * blank + 1)))
    order = np.lexsort((start, owner))
    return owner[order], start[order], stop[order], number[order]


def _pieces(texts: pa.Array, limit: int, overlap: int) -> pa.Array:
    raws = [text.encode("utf-8", "replace") if text else b"" for text in texts.to_pylist()]
    counts, fields = np.zeros(len(raws), dtype=np.int64), []
    at = 0
    while at < len(raws):
        upto, size = at, 0
        while upto < len(raws) and (upto == at or size + len(raws[upto]) <= GROUP_BYTES):
            size += len(raws[upto])
            upto += 1
        owner, *piece = split_group(raws[at:upto], limit, overlap)
        counts[at:upto] = np.bincount(owner, minlength=upto - at)
        fields.append(piece)
        at = upto
    start, end, page = (np.concatenate(x).astype(np.int32) for x in zip(*fields)) if fields else (np.zeros(0, np.int32),) * 3
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(start), pa.array(end), pa.array(page)], fields=list(_PIECES.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def piece_spans(text: Column | str, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """ARRAY of (start, end, page) in UTF-8 bytes, in order. Null or empty text: an empty array."""
    return arrow_column(functools.partial(_pieces, limit=limit, overlap=overlap), PIECES, text)


def split_oversized(df: DataFrame, text: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The rows of `df` whose text is longer than `limit` bytes of UTF-8, with their `pieces`. No shuffle.

    Null, empty and short texts have no row: they need no cutting. Ties and repeated rows are cut alike and kept. Very
    long texts are cut whole. A text of blanks alone is cut like any other; one of form feeds alone has one piece, cut at the limit. An empty table gives an
    empty table. Columns `n_bytes` and `pieces` of the input, if any, are replaced; other columns are untouched.
    """
    long = df.withColumn("n_bytes", F.octet_length(F.col(text))).where(F.col("n_bytes") > limit)
    return long.withColumn("pieces", piece_spans(F.col(text), limit, overlap))


def explode_pieces(split: DataFrame, text: str = "content") -> DataFrame:
    """One row a piece: `ordinal`, `start`, `end`, `page` and its text as `piece`."""
    raw = F.encode(F.col(text), "UTF-8")
    return (
        split.select("*", F.posexplode("pieces").alias("ordinal", "span"))
        .withColumn("start", F.col("span.start")).withColumn("end", F.col("span.end")).withColumn("page", F.col("span.page"))
        .withColumn("piece", F.decode(F.substring(raw, F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8"))
        .drop("span", "pieces")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_oversized(table(spark, sf_dir, "records").select("record_id", "content"))
    return split.where(F.size("pieces") > 0).select("record_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = explode_pieces(split_oversized(table(spark, sf_dir, "records").select("record_id", "content")))
    return pieces.select("record_id", "ordinal", "page", "start", "end", "piece")


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each oversized content: whether its pieces, overlaps left out, hold all of it but blanks; all under the limit; none across a page."""
    held = p4_pieces(spark, sf_dir).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end", "piece"))).alias("p"))
    seen = lambda p, i: F.when(i == 0, 0).otherwise(F.greatest(F.get("p", i - 1)["end"] - p["start"], F.lit(0)))
    new = F.transform("p", lambda p, i: F.decode(F.substring(F.encode(p["piece"], "UTF-8"), seen(p, i) + 1, F.lit(1 << 30)), "UTF-8"))
    bare = lambda text: F.regexp_replace(text, r"[ \t-\r]", "")
    contents = table(spark, sf_dir, "records").select("record_id", "content")
    met = held.join(contents, "record_id")
    small = F.forall("p", lambda p: F.octet_length(p["piece"]) <= LIMIT)
    return met.select("record_id", (bare(F.array_join(new, "")) == bare(F.col("content"))).alias("whole"), small.alias("small"), F.forall("p", lambda p: ~F.contains(p["piece"], F.lit("\f"))).alias("paged"))
