"""Long exact spans that texts share (problem 8).

1. Exact copies are one text: all work below is done once for each different text.
2. Of the windows of `WINDOW` characters of a text, those with the least hash among `LENGTH - WINDOW + 1` neighbours are
   anchors. Any stretch of `LENGTH` characters contains an anchor that depends on its characters alone, so two texts that
   share such a stretch share an anchor at the same place of it. Anchors are written once, as narrow rows.
3. Count-min prefilter: each partition counts its anchors in a sketch (cells seen, cells seen again), the sketches are merged
   by adding, a few at a time in a tree. A merged count is never too low, so anchors estimated once are unique and go. The
   cells are four times as many as the anchors, so about 5 % of the unique ones stay, whatever the input: where that would
   be more than `MOST_CELLS`, the anchors are split by ranges of their hash, each with a sketch of its own.
4. A second pass keeps only the places of anchors estimated repeated. These are grouped exactly, and those in several texts
   get the characters around them that a stretch of `LENGTH` through them could cover.
5. Pairs: within a group, the window's own characters are compared, then those to its left and right: they decide which
   texts share how much. Spans through different anchors overlap, and their union is the whole shared stretch.
6. Coverage needs no pairs: occurrences with the same surroundings are one class; a class of several texts is shared
   whole, other classes of a window are compared with each other, and where they are many their stretches are counted.

A hot window (boilerplate in a third of all texts) is never gathered in one task: occurrences are cut into blocks, blocks
meet each other by a join.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrow import arrow_column
from weftline.plans.lineage import cut
from weftline.plans.sizes import small_side
from weftline.sources.tables import table

LENGTH, WINDOW = 200, 120
#: Rows of the sketch, cells of a row for each anchor, and the most cells of a row: 32 MB are broadcast at most, whatever the input.
ROWS, CELLS_PER_ANCHOR, MOST_CELLS = 2, 4, 1 << 27
#: Cells of a block that is merged on its own, how many sketches of a block meet in one task, and anchors counted before a task passes its sketch on.
BLOCK, FAN_IN, FLUSH = 1 << 16, 64, 1 << 22
#: Characters hashed at once, to bound memory; a longer text is hashed alone.
GROUP_CHARS = 1 << 20
#: Texts of a block of one window's occurrences; a window in more texts is compared block against block.
OCCURRENCES = 64

_SAME = T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, base, dtype=np.uint64))]) for base in (_ODD, inverse))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, in two sweeps over blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def anchors(texts: list[str], length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and hash of every anchor of some texts of at least `length` characters each."""
    near = length - window + 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    size = 1 << max(20, (n - 1).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(codes + np.uint64(1)) * power[:n])])
        hashes = _mixed((sums[window:] - sums[:-window]) * inverse[: n - window + 1])
    bits = np.uint64(max(1, (n - 1).bit_length()))
    index = np.arange(len(hashes), dtype=np.uint64)
    least = _least(((hashes >> bits) << bits) | index, near)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    inside = np.ones(len(least), dtype=bool)  # neighbours that lie in one text
    for bound in bounds[1:-1]:
        inside[max(0, bound - length + 1) : bound] = False
    at = np.unique(least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.searchsorted(bounds, at, side="right") - 1
    return owner, at - bounds[owner], hashes[at]


def _grouped(texts: list[str | None], length: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at] or "") <= GROUP_CHARS):
            if texts[at] is not None and len(texts[at]) >= length:
                group.append(at)
                size += len(texts[at])
            at += 1
        if group:
            owner, start, hashes = anchors([texts[i] for i in group], length, window)
            yield np.array(group)[owner], start, hashes


def _places(batches: Iterator[pa.RecordBatch], length: int, window: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """The anchors of texts: where they stand, their hash, its range, and whether the text has the window for the first time."""
    for batch in batches:
        ids = batch.column(0)
        for owner, start, hashes in _grouped(batch.column(1).to_pylist(), length, window):
            order = np.lexsort((start, hashes, owner))
            again = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
            first = np.ones(len(owner), dtype=bool)
            first[order[1:][again]] = False
            bands = (_mixed(hashes) % np.uint64(ranges)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(start, type=pa.int32()), pa.array(hashes.view(np.int64)), pa.array(first), pa.array(bands)], names=["text_id", "start", "window", "first", "band"])


def _cells(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    return [((hashes >> np.uint64(row * 32)) & np.uint64(cells - 1)).astype(np.int64) for row in range(ROWS)]


def _packed(offsets: np.ndarray, block: int) -> bytes:
    """Places in a block: a list while that is shorter than one bit each."""
    if len(offsets) * 16 < block:
        return offsets.astype(np.uint16).tobytes()
    bits = np.zeros(block, dtype=bool)
    bits[offsets] = True
    return np.packbits(bits).tobytes()


def _add(bits: np.ndarray, packed: bytes) -> None:
    """Sets the places that `_packed` has."""
    if len(packed) * 8 < len(bits):
        bits[np.frombuffer(packed, np.uint16)] = True
    else:
        bits |= np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)


def _sketch(batches: Iterator[pa.RecordBatch], cells: int, block: int) -> Iterator[pa.RecordBatch]:
    """A partition's sketch, as the blocks in use: cells seen, and cells seen again. A window counts once a text."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        numbers, seen, again = [], [], []
        for row, places in enumerate(_cells(np.concatenate(held), cells)):
            used, counts = np.unique(places + row * cells, return_counts=True)
            bounds = np.append(np.flatnonzero(np.diff(used // block, prepend=-1)), len(used))
            for start, end in zip(bounds[:-1], bounds[1:]):
                offsets = used[start:end] % block
                numbers.append(int(used[start] // block))
                seen.append(_packed(offsets, block))
                again.append(_packed(offsets[counts[start:end] > 1], block))
        return pa.RecordBatch.from_arrays([pa.array(numbers, type=pa.int64()), pa.array([part] * len(numbers), type=pa.int32()), pa.array(seen, type=pa.binary()), pa.array(again, type=pa.binary())], names=["block", "part", "seen", "again"])

    held, size = [], 0
    for batch in batches:
        hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        if len(hashes):
            held.append(hashes)
            size += len(hashes)
        if size >= FLUSH:
            yield counted(held)
            held, size = [], 0
    if held:
        yield counted(held)


def _merge(key: tuple, parts: pa.Table, block: int) -> pa.Table:
    """Some sketches of a block added: cells seen, and those seen twice or more, in one of them or in several."""
    seen, again, one = (np.zeros(block, dtype=bool) for _ in range(3))
    for once, more in zip(parts.column("seen").to_pylist(), parts.column("again").to_pylist()):
        one[:] = False
        _add(one, once)
        again |= seen & one
        seen |= one
        _add(again, more)
    number, part = (k.as_py() for k in key)
    return pa.table({"block": pa.array([number], pa.int64()), "part": pa.array([part], pa.int32()), "seen": pa.array([_packed(np.flatnonzero(seen), block)], pa.binary()), "again": pa.array([_packed(np.flatnonzero(again), block)], pa.binary())})


def merged_sketch(places: DataFrame, cells: int, block: int = BLOCK, fan_in: int = FAN_IN) -> bytes:
    """One bit a cell, row by row: whether it is estimated to be counted twice or more.

    `places` has window, one row for each text that has it. A block's sketches are added a few at a time, level by level, so no
    task sees one entry a partition. What reaches the driver is the merged sketch, of a bounded size.
    """
    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        return _merge(key, parts, block)

    blocks = places.select("window").mapInArrow(functools.partial(_sketch, cells=cells, block=block), _BLOCKS)
    parts = places.rdd.getNumPartitions()
    while True:
        parts = -(-parts // fan_in)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("block", "part").applyInArrow(merge, _BLOCKS)
        if parts <= 1:
            break
    sketch = np.zeros(ROWS * cells // 8, dtype=np.uint8)
    for row in blocks.select("block", "again").toLocalIterator():
        bits = np.zeros(block, dtype=bool)
        _add(bits, bytes(row["again"]))
        sketch[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.packbits(bits)
    return sketch.tobytes()


def _repeated(batches: Iterator[pa.RecordBatch], sketch, cells: int) -> Iterator[pa.RecordBatch]:
    """Of the anchors, those that the sketch counts more than once."""
    again = np.frombuffer(sketch.value, np.uint8)
    for batch in batches:
        keep = np.ones(batch.num_rows, dtype=bool)
        for row, places in enumerate(_cells(batch.column("window").to_numpy(zero_copy_only=False).view(np.uint64), cells)):
            places += row * cells
            keep &= (again[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 > 0
        if keep.any():
            yield batch.filter(pa.array(keep))


def _common(a: str, b: str) -> int:
    """Characters that two strings have in common at their starts."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _compare(pairs: pa.Array, window: int) -> pa.Array:
    """Common characters left and right of the window of two occurrences; -1 where the windows themselves differ."""
    lefts, rights = [], []
    columns = [pairs.field(i).to_pylist() for i in range(4)]
    for a, at, b, bt in zip(*columns):
        if a[at : at + window] != b[bt : bt + window]:
            lefts.append(-1)
            rights.append(-1)
        else:
            lefts.append(_common(a[:at][::-1], b[:bt][::-1]))
            rights.append(_common(a[at + window :], b[bt + window :]))
    return pa.StructArray.from_arrays([pa.array(lefts, type=pa.int32()), pa.array(rights, type=pa.int32())], names=["left", "right"])


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, text_id of the documents whose text, of `length` characters or more, stands in several documents.

    text_id is the smallest id among the copies. Documents not listed are the only ones with their text.
    """
    long = docs.where(F.length(F.col(text)) >= length).select(F.col(id_column).alias("doc_id"), F.sha2(F.col(text), 256).alias("digest"))
    several = long.groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("copies")).where(F.col("copies") > 1).select("digest", "text_id")
    return long.join(several, "digest").select("doc_id", "text_id")


_BLOCKS = "block long, part int, seen binary, again binary"


def sketch_size(anchors: int, most: int = MOST_CELLS, least: int = BLOCK) -> tuple[int, int]:
    """Cells of a row (a power of two) and ranges of the hash, so that each range has `CELLS_PER_ANCHOR` cells an anchor."""
    wanted = max(least, CELLS_PER_ANCHOR * anchors)
    return min(most, 1 << (wanted - 1).bit_length()), max(1, -(-wanted // most))


def repeated_places(long: DataFrame, length: int = LENGTH, window: int = WINDOW, most_cells: int = MOST_CELLS, block: int = BLOCK) -> DataFrame:
    """text_id, start, window of the anchors of texts (text_id, text) that are estimated to stand in several: none of those is lost."""
    kind = dict(long.dtypes)["text_id"]
    # of so many neighbours' least hash, two in each stretch of neighbours and one more are new
    characters = long.agg(F.sum(F.length("text"))).first()[0] or 0
    cells, ranges = sketch_size(2 * characters // (length - window + 2), most_cells, block)
    every = cut(long.mapInArrow(functools.partial(_places, length=length, window=window, ranges=ranges), f"text_id {kind}, start int, window long, first boolean, band int"), *(("band",) if ranges > 1 else ()))
    kept = None
    for band in range(ranges):
        places = every.where(F.col("band") == band) if ranges > 1 else every
        shared = long.sparkSession.sparkContext.broadcast(merged_sketch(places.where("first"), cells, block))
        found = places.select("text_id", "start", "window").mapInArrow(functools.partial(_repeated, sketch=shared, cells=cells), f"text_id {kind}, start int, window long")
        found = cut(found)
        shared.unpersist()
        kept = found if kept is None else kept.unionByName(found)
    return kept


def occurrences(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """text_id, start, window, before, around, blocks: windows that stand in several rows, and what surrounds them.

    The places estimated repeated are grouped exactly, and characters are fetched for those left. So even where more windows
    pass the sketch than it can tell apart, what is shuffled for them is a few bytes each.
    """
    long = docs.where(F.length(F.col(text)) >= length).select(F.col(id_column).alias("text_id"), F.col(text).alias("text"))
    places = repeated_places(long, length, window)
    several = places.groupBy("window").agg(F.min("text_id").alias("least"), F.max("text_id").alias("most"), F.count("*").alias("n")).where("least <> most")
    several = cut(several.select("window", F.ceil(F.col("n") / OCCURRENCES).cast("int").alias("blocks")))
    places = cut(places.join(small_side(several), "window"))
    wanted = small_side(cut(places.select("text_id").distinct()))
    side = length - window
    before = F.least("start", F.lit(side))
    around = F.substring("text", F.col("start") - before + 1, before + length)
    return long.join(wanted, "text_id", "left_semi").join(places, "text_id").select("text_id", "start", "window", before.alias("before"), around.alias("around"), "blocks")


def windows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """`occurrences` among the different texts of some documents, and the membership of exact copies (`classes`)."""
    docs = docs.where(F.col(id_column).isNotNull())
    copies = cut(classes(docs, id_column, text, length))
    others = copies.where("doc_id <> text_id").select(F.col("doc_id").alias(id_column))
    return cut(occurrences(docs.select(id_column, text).join(small_side(others), id_column, "left_anti"), id_column, text, length, window)), copies


def shared_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Spans shared by different texts, and the membership of exact copies (`classes`).

    Spans: text_id_a, text_id_b, start_a, start_b, n_chars, at least `length` characters each. A stretch longer than
    2 * `length` - `window` comes out as several overlapping spans whose union is the stretch.

    Null, empty and shorter texts share nothing. Rows with a null id are ignored. Repeated rows and copies are one text,
    named by its smallest id. Long texts are read whole. Empty tables give empty results; other columns are ignored.
    """
    found, copies = windows(docs, id_column, text, length, window)
    blocked = found.withColumn("block", F.pmod(F.xxhash64("text_id", "start"), F.col("blocks")).cast("int"))
    side = lambda name, i, j: blocked.select("window", i.alias("i"), j.alias("j"), *(F.col(c).alias(f"{c}_{name}") for c in ("text_id", "start", "before", "around")))
    left = side("a", F.col("block"), F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("block"))), F.col("block"))
    met = left.join(right, ["window", "i", "j"]).where(((F.col("i") < F.col("j")) & (F.col("text_id_a") != F.col("text_id_b"))) | ((F.col("i") == F.col("j")) & (F.col("text_id_a") < F.col("text_id_b"))))
    same = arrow_column(functools.partial(_compare, window=window), _SAME, F.struct("around_a", "before_a", "around_b", "before_b"))
    met = met.withColumn("same", same).where((F.col("same.left") >= 0) & (F.col("same.left") + F.col("same.right") + window >= length))
    straight = F.col("text_id_a") < F.col("text_id_b")
    place = lambda own, other: F.when(straight, F.col(own)).otherwise(F.col(other))
    spans = met.select(
        place("text_id_a", "text_id_b").alias("text_id_a"), place("text_id_b", "text_id_a").alias("text_id_b"),
        (place("start_a", "start_b") - F.col("same.left")).alias("start_a"), (place("start_b", "start_a") - F.col("same.left")).alias("start_b"),
        (F.col("same.left") + F.col("same.right") + window).alias("n_chars"),
    )
    return spans, copies


def document_pairs(spans: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b of every two documents that share a span, copies included.

    Copies multiply with their partners because every pair of documents is asked for; `spans` and `copies` say the same
    in less space. A large class of copies is paired block against block, never in one task.
    """
    texts = spans.select(F.col("text_id_a").alias("a"), F.col("text_id_b").alias("b")).distinct()
    member = lambda name: copies.select(F.col("text_id").alias(name), F.col("doc_id").alias(f"doc_{name}"))
    across = texts.join(member("a"), "a", "left").join(member("b"), "b", "left").select(F.coalesce("doc_a", "a").alias("a"), F.coalesce("doc_b", "b").alias("b"))
    blocks = copies.groupBy("text_id").agg(F.ceil(F.count("*") / OCCURRENCES).cast("int").alias("blocks"))
    placed = copies.join(blocks, "text_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    left = placed.select("text_id", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("doc_id").alias("a"))
    right = placed.select("text_id", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("doc_id").alias("b"))
    within = left.join(right, ["text_id", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))).select("a", "b")
    both = across.unionByName(within)
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).where("doc_id_a < doc_id_b")


def _stretches(rows: pa.Array, length: int, window: int) -> pa.Array:
    """Hashes of all stretches of `length` characters through a window, in order of their start."""
    out = []
    for around, before in zip(*(rows.field(i).to_pylist() for i in range(2))):
        n = max(0, min(before + 1, len(around) - length + 1))
        out.append([int.from_bytes(hashlib.blake2b(around[i : i + length].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for i in range(n)])
    return pa.array(out, type=pa.list_(pa.int64()))


def coverage(found: DataFrame, length: int = LENGTH, window: int = WINDOW, most: int = OCCURRENCES) -> DataFrame:
    """text_id, shared_chars: characters of a text that lie in stretches shared with other texts (their union). `found`: see `windows`.

    Occurrences of a window with the same surroundings are one class. A class of several texts is shared as far as its
    surroundings go. Up to `most` classes of a window are compared with each other; where there are more, all stretches
    through the window are counted instead. So the work grows with the occurrences, not with their pairs.
    """
    label = F.xxhash64("window", "before", "around")
    told = found.select("text_id", "start", "window", "before", "around", label.alias("label"))
    rows = told.groupBy("window", "label").agg(F.min("text_id").alias("least"), F.max("text_id").alias("most"), F.any_value("before").alias("before"), F.any_value("around").alias("around"))
    rows = cut(rows)
    many = rows.groupBy("window").agg(F.count("*").alias("n"), F.min("least").alias("first"), F.max("most").alias("last"))
    several = F.col("least") != F.col("most")
    whole = rows.where(several).select("window", "label", F.col("before").alias("left"), (F.length("around") - F.col("before") - window).alias("right"))
    sole = rows.where(~several).join(many.where("n > 1 and first <> last").select("window", "n"), "window")
    # few classes: each single one against the others
    other = rows.select("window", F.col("label").alias("other"), F.col("least").alias("other_least"), F.col("most").alias("other_most"), F.col("around").alias("around_b"), F.col("before").alias("before_b"))
    few = sole.where(F.col("n") <= most).join(other, "window").where((F.col("label") != F.col("other")) & ((F.col("least") != F.col("other_least")) | (F.col("least") != F.col("other_most"))))
    same = arrow_column(functools.partial(_compare, window=window), _SAME, F.struct(F.col("around").alias("around_a"), F.col("before").alias("before_a"), "around_b", "before_b"))
    few = few.withColumn("same", same).where((F.col("same.left") >= 0) & (F.col("same.left") + F.col("same.right") + window >= length))
    few = few.groupBy("window", "label").agg(F.max("same.left").alias("left"), F.max("same.right").alias("right"))
    # many classes: stretches that stand in several texts
    hot = many.where(F.col("n") > most).select("window")
    keys = arrow_column(functools.partial(_stretches, length=length, window=window), T.ArrayType(T.LongType()), F.struct("around", "before"))
    stretches = rows.join(hot, "window", "left_semi").select("window", "label", "least", "most", "before", F.posexplode(keys).alias("at", "stretch"))
    common = stretches.groupBy("window", "stretch").agg(F.min("least").alias("a"), F.max("most").alias("b")).where("a <> b").select("window", "stretch")
    met = stretches.where(~several).join(common, ["window", "stretch"], "left_semi")
    met = met.groupBy("window", "label").agg(F.max(F.col("before") - F.col("at")).alias("left"), F.max(F.col("at") + length - window - F.col("before")).alias("right"))
    reach = whole.unionByName(few).unionByName(met)
    ranges = told.select("text_id", "start", "window", "label").join(reach, ["window", "label"]).select("text_id", (F.col("start") - F.col("left")).alias("start"), (F.col("start") + window + F.col("right")).alias("end"))
    ranges = ranges.groupBy("text_id", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("text_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    added = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    return ranges.withColumn("added", added).groupBy("text_id").agg(F.sum("added").alias("shared_chars"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pairs(*shared_spans(_documents(spark, sf_dir)))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's characters, how many of them stand elsewhere too, and the class of its text."""
    docs = _documents(spark, sf_dir)
    found, copies = windows(docs)
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).join(copies, "doc_id", "left")
    own = sizes.select("doc_id", "n_chars", F.coalesce("text_id", "doc_id").alias("text_id"), F.col("text_id").isNotNull().alias("copied"))
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0))).cast("bigint")
    return own.join(coverage(found), "text_id", "left").select("doc_id", "text_id", "n_chars", shared.alias("shared_chars"))
