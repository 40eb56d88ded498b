"""From a question to evidence and an answer: embeddings shared by equal texts, retrieval modes, and pluggable models."""

from __future__ import annotations

import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as X
from weftline.functions.arrow import arrow_column
from weftline.functions.dates import _folded
from weftline.operators import evidence as E
from weftline.operators import search as R
from weftline.operators.filters import appearing
from weftline.plans.lineage import cut

#: Fixed value: cues, in folded text, that a question asks for what happened around something.
AROUND_CUES = r"\b(antes|depois|logo apos|em seguida|na mesma hora|before|after|around|meanwhile)\b"
MODES = ("hybrid", "vector", "lexical")


class Embedder(Protocol):
    """Texts to vectors, a batch at a time. Must be picklable: it runs on executors."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    """A prompt to a reply, on the driver."""

    def __call__(self, prompt: str) -> str: ...


def embedded(chunks: DataFrame, model: Embedder, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Chunks with `embedding`: every distinct text meets the model once, and none that is known already."""

    def run(texts: pa.Array) -> pa.Array:
        rows = np.asarray(model(texts.to_pylist()), dtype=np.float32)
        return pa.array(list(rows), type=pa.list_(pa.float32()))

    hashed = chunks.withColumn("_text_hash", X.content_hash(F.col(text)))
    new = hashed.select("_text_hash", text).dropDuplicates(["_text_hash"])
    if known is not None:
        new = new.join(known.select("_text_hash"), "_text_hash", "left_anti")
    made = new.select("_text_hash", arrow_column(run, T.ArrayType(T.FloatType()), F.col(text)).alias("embedding"))
    made = made if known is None else made.unionByName(known.select("_text_hash", "embedding"))
    return hashed.join(made, "_text_hash").drop("_text_hash")


def sibling_counts(chunks: DataFrame) -> DataFrame:
    """source, content_hash, n_chunks: how many chunks a text has."""
    return chunks.groupBy("source", "content_hash").agg(F.count("*").alias("n_chunks"))


def in_period_chunks(chunks: DataFrame, events: DataFrame, when: Column) -> DataFrame:
    """Chunks of texts that some event in a period has: a semi-join, each chunk once."""
    return chunks.join(events.where(when).select("source", X.content_hash(F.col("content")).alias("content_hash")), ["source", "content_hash"], "left_semi")


def capped_count(events: DataFrame, most: int) -> int:
    """How many events there are, counted up to a limit."""
    return events.limit(most).count()


def linked_to(events: DataFrame, links: DataFrame, keys: list[str], key: str = "record_id") -> DataFrame:
    """Events linked to any of some entities."""
    return events.join(links.where(F.col("entity_key").isin(*keys)).select(key), key, "left_semi")


def appearing_names(chunks: DataFrame, names: list[str]) -> list[str]:
    """The names, one after the other, that leave something to find: a name without any text with it and those before is dropped."""
    kept, scope = [], chunks
    for name in names:
        narrowed = scope.join(appearing(chunks, name), ["source", "content_hash"], "left_semi")
        if narrowed.limit(1).count():
            kept.append(name)
            scope = narrowed
    return kept


def on_topic(hits: DataFrame, max_distance: float = E.MAX_DISTANCE) -> DataFrame:
    """Events near enough to a topic, in order of time again."""
    return hits.where(F.col("distance") <= max_distance).orderBy("occurred_at", "record_id")


def outdated(images: DataFrame, described: DataFrame, model: str, prompt: str) -> DataFrame:
    """Images whose description was made by another model or prompt, unknown ones included."""
    met = images.join(described.select("sha256", "model", "prompt"), "sha256")
    return met.where(~(F.col("model").eqNullSafe(F.lit(model)) & F.col("prompt").eqNullSafe(F.lit(prompt))))


def pages(events: DataFrame, key: str = "record_id", text: str = "content") -> DataFrame:
    """key, page, text, state of paged texts: pages with text are read, blank ones wait to be described."""
    split = events.where(F.contains(F.col(text), F.lit("\f"))).select(key, F.posexplode(F.split(F.col(text), "\f")).alias("at", "text"))
    return split.select(key, (F.col("at") + 1).alias("page"), "text", F.when(F.col("text").rlike(r"\S"), "read").otherwise("pending").alias("state"))


def in_scope(url: Column, patterns: list[str]) -> Column:
    """Whether an address matches an allow-list, where * stands for any part."""
    kept = F.lit(False)
    for pattern in patterns:
        kept = kept | url.rlike("^" + ".*".join(map(re.escape, pattern.split("*"))) + "$")
    return kept


def slot_statistics(blocks: DataFrame, slots: int = 1024) -> DataFrame:
    """One row: blocks, slots, used ones, and the share a compaction would free. Blocks: (live) vectors of each."""
    totals = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("live"), F.lit(0)).alias("used"))
    needed = F.ceil(F.col("used") / slots)
    return totals.withColumn("slots", F.col("blocks") * slots).withColumn("reclaimable", F.when(F.col("blocks") > 0, (F.col("blocks") - needed) / F.col("blocks")).otherwise(0.0))


def rank_for(question: str, chunks: DataFrame, vector: list[float], top_k: int, mode: str = "hybrid", key: str = "chunk_id") -> DataFrame:
    """key, rank, distance: the chunks that answer a question.

    Identifiers a question names are looked up as words and nothing else; else vectors, keywords or both, fused. Keyword hits
    have the distance of their own vector, so gates judge all alike.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}, expected one of {MODES}")
    asked = R.identifier_terms(question)
    terms = [w for words in asked for w in words] if asked else R.content_words(question)
    wanted = F.array(*(F.lit(float(x)) for x in vector))
    measured = chunks.withColumn("distance", R.V.cosine_distance(F.col("embedding"), wanted))
    if asked or mode != "vector":
        index, corpus = R.postings(chunks, key, terms=terms)
        if asked:
            found = None
            for words in asked:
                hit = R.phrase(index, words, key)
                found = hit if found is None else found.unionByName(hit)
            hits = measured.join(found.distinct(), key, "left_semi").orderBy("distance", key).limit(top_k)
            return R.ranked(hits, 0, F.col("distance"), F.col(key)).select(key, "rank", "distance")
        words = R.bm25(index, corpus, terms, key).orderBy(F.desc("score"), key).limit(R.LEXICAL_HEADROOM * top_k)
        lexical = R.ranked(words, 1, F.desc("score"), F.col(key)).where(F.col("rank") <= top_k).select(key, "list_no", "rank")
        if mode == "lexical":
            return lexical.join(measured.select(key, "distance"), key).select(key, "rank", "distance")
    near = measured.orderBy("distance", key).limit(R.VECTOR_HEADROOM * top_k)
    dense = R.ranked(near, 0, F.col("distance"), F.col(key)).where(F.col("rank") <= top_k).select(key, "list_no", "rank")
    fused = R.fuse(dense if mode == "vector" else dense.unionByName(lexical), key)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.col("list_no"), F.col("first_rank"))
    best = fused.withColumnRenamed("rank", "first_rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return best.join(measured.select(key, "distance"), key).select(key, "rank", "distance")


def prompt(question: str, notes: list[str]) -> str:
    """What a model is asked: the question below its numbered evidence."""
    return "\n".join([*notes, "", f"Responda só com base nas notas acima, citando [n]; se não respondem, diga {NOT_FOUND}.", question])


#: What a model is told to reply where the notes do not answer.
NOT_FOUND = "NÃO ENCONTRADO"


def answer(question: str, hits: DataFrame, generate: Generator | None = None) -> tuple[str, list[int], list[str]]:
    """Reply, valid citations and the notes shown. Without a model, or without evidence, the notes stand for themselves.

    A reply that begins with the marker of nothing found is empty and cites nothing.

    `hits` are at most top_k events in rank order, so they are read to the driver.
    """
    rows = hits.orderBy("rank").select("rank", E.note(F.col("rank")).alias("note")).collect()
    notes = [r["note"] for r in rows]
    if generate is None or not notes:
        return "", [], notes
    reply = generate(prompt(question, notes))
    if reply.strip().upper().startswith(NOT_FOUND):
        return "", [], notes
    cited = sorted({int(n) for n in re.findall(r"\[(\d+)\]", reply)})
    return reply, [n for n in cited if 1 <= n <= len(notes)], notes


def asks_around(question: str) -> bool:
    """Whether neighbours in time belong to the evidence."""
    return bool(re.search(AROUND_CUES, _folded(question)))


def retrieve(question: str, chunks: DataFrame, events: DataFrame, vector: list[float], top_k: int = 6, scoped: bool = False, own_only: bool = False, mode: str = "hybrid", key: str = "record_id") -> DataFrame:
    """Ranked events for a question. Chunks: chunk_id, `key`, text, embedding of the events that the question's filter leaves.

    Gates are skipped for scoped questions and identifiers; neighbours in time follow if the question asks for them.
    """
    hits = rank_for(question, chunks, vector, top_k * R.VECTOR_HEADROOM, mode)
    hits = cut(hits)  # a few rows: what led to them is not done again for the gates and the neighbours
    met = hits.join(F.broadcast(chunks.join(F.broadcast(hits.select("chunk_id")), "chunk_id", "left_semi").select("chunk_id", key)), "chunk_id")
    met = cut(events.join(F.broadcast(met), key))
    met = E.best_chunk(met, key, "rank", "chunk_id")
    kept = E.collapse_repeats(E.usable(met, own_only), F.coalesce(F.sha2("content", 256), F.col(key).cast("string")), "rank", key)
    if not (scoped or R.identifier_terms(question)):
        kept = E.gates(kept)
    order = Window.partitionBy(F.lit(1)).orderBy("rank", key)
    best = cut(kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k))
    if not asks_around(question):
        return best
    near = E.neighbours(best.where("rank = 1"), events.join(best.select(key), key, "left_anti"), key=key)
    more = events.join(near.select(key, (F.col("rank") + top_k).alias("rank")), key)
    return best.unionByName(more, allowMissingColumns=True)

