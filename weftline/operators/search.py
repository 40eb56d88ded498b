"""Retrieval: vectors, keywords, and the fusion of both."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.functions.chunking import chunk_spans

#: The constant of reciprocal rank fusion, and the parameters of BM25.
RRF_K, BM25_K1, BM25_B = 60, 1.2, 0.75
#: Query vectors sent to the executors at once.
QUERY_BLOCK = 16_384
#: Neighbours and keyword hits fetched for each result wanted, as chatter and repeats go later.
VECTOR_HEADROOM, LEXICAL_HEADROOM = 3, 12
#: Words that match everything and rank nothing.
STOPWORDS = """
o a os as um uma de do da dos das em no na nos nas por para pra pro com sem sobre que quem qual quais quando onde como
eu me meu minha meus minhas voce foi era fiz fez tem ter ja isso esse essa este esta ao aos e ou se mais
the a an of in on at to for with about what which who when where how did do does was were is are i my me it this that and or
ontem hoje yesterday today semana week mes month
""".split()


def text_chunks(events: DataFrame) -> DataFrame:
    """source, content_hash, ordinal, start, end, page, text: chunks of every distinct text, shared by all events that have it."""
    texts = events.where(F.length("content") > 0).groupBy("source", X.content_hash(F.col("content")).alias("content_hash")).agg(F.any_value("content").alias("content"))
    spans = texts.select("source", "content_hash", "content", F.posexplode(chunk_spans(F.col("content"))).alias("ordinal", "s"))
    piece = F.decode(F.substring(F.encode("content", "UTF-8"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), "UTF-8")
    return spans.select("source", "content_hash", "ordinal", "s.start", "s.end", "s.page", piece.alias("text"))


def chunk_dates(events: DataFrame) -> DataFrame:
    """source, content_hash, first_at, last_at, n_events of every distinct text."""
    return events.where(F.length("content") > 0).groupBy("source", X.content_hash(F.col("content")).alias("content_hash")).agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count("*").alias("n_events"))


def nearest(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k nearest rows by cosine distance, filtered first: exact, with a top-k on every partition before the last one."""
    kept = vectors if where is None else vectors.where(where)
    wanted = F.array(*(F.lit(float(x)) for x in query))
    return kept.withColumn("distance", V.cosine_distance(F.col(vector), wanted)).orderBy("distance", tie).limit(k)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, key, distance, rank: the k nearest rows of every query vector.

    A stated set of queries against all rows, in blocks: QUERY_BLOCK queries at a time are sent to the executors, each Arrow
    batch of rows is multiplied with them, and only k candidates a query leave a partition. More queries make more rounds over
    the rows, never a larger broadcast.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[key]
    rounds = max(1, -(-queries.count() // QUERY_BLOCK))
    near = None
    for one in range(rounds):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == one).select("query_id", vector).collect()
        matrix = np.array([list(r[vector]) for r in rows], dtype=np.float64).reshape(len(rows), -1)
        shared = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], matrix))
        part = vectors.select(key, vector).mapInArrow(functools.partial(_nearest_in_batches, shared=shared, k=k, key=key), f"query_id {kinds[0]}, {key} {kinds[1]}, distance double")
        near = part if near is None else near.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_in_batches(batches: Iterator[pa.RecordBatch], shared, k: int, key: str) -> Iterator[pa.RecordBatch]:
    """The k nearest of a whole partition for every query: a running list each, passed on once."""
    ids, matrix = shared.value
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        if not ids or not batch.num_rows:
            continue
        rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        names = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(ids), 256):
            for i, line in enumerate(1.0 - matrix[at : at + 256] @ rows.T):
                # ties with the k-th stay until names decide
                near = np.flatnonzero(line <= np.partition(line, k - 1)[k - 1]) if len(line) > k else np.arange(len(line))
                known = held.get(at + i)
                named, far = (names[near], line[near]) if known is None else (np.concatenate([known[0], names[near]]), np.concatenate([known[1], line[near]]))
                best = np.lexsort((named, far))[:k]
                held[at + i] = named[best], far[best]
    for at in range(0, len(held), 1024):
        part = [(ids[i], *held[i]) for i in range(at, min(at + 1024, len(held)))]
        counts = [len(names) for _, names, _ in part]
        asked = pa.array([q for q, _, _ in part]).take(pa.array(np.repeat(np.arange(len(part)), counts)))
        yield pa.RecordBatch.from_arrays([asked, pa.array(np.concatenate([n for _, n, _ in part])), pa.array(np.concatenate([d for *_, d in part]))], names=["query_id", key, "distance"])


def postings(texts: DataFrame, key: str, text: str = "text", terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, key, tf, positions, length of the text) of every word, and one row (n, mean) of how many texts there are and how long.

    With `terms`, words that none of them means are left out. A term ending in * means every word it begins. The words are cut
    down inside their arrays, before anything is exploded, and combined inside their text before the shuffle.
    """
    words = texts.select(key, X.word_tokens(F.col(text)).alias("words"))
    corpus = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    if terms is not None:
        whole = [t for t in terms if not t.endswith("*")]

        def meant(spot: Column) -> Column:
            found = spot["term"].isin(*whole) if whole else F.lit(False)
            for start in (t[:-1] for t in terms if t.endswith("*")):
                found = found | spot["term"].startswith(start)
            return found

        placed = F.filter(placed, meant)
    spots = words.select(key, F.size("words").alias("length"), F.explode(placed).alias("s")).select(key, "length", "s.term", "s.at")
    return spots.groupBy("term", key, "length").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("positions")), corpus


#: Texts for each folder of a stored index, and the fewest and most folders.
TEXTS_A_FOLDER, FOLDERS = 5_000, (4, 4_096)


class KeywordIndex:
    """Postings kept as a table, one folder for each share of the terms, sorted by term: a search reads its terms and no more."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self._corpus = spark.read.parquet(f"{path}/corpus")
        self.folders: int = self._corpus.select("folders").first()[0]

    @classmethod
    def build(cls, texts: DataFrame, path: str, key: str, text: str = "text") -> KeywordIndex:
        """An index of all words of some texts, written once."""
        index, corpus = postings(texts, key, text)
        folders = F.greatest(F.lit(FOLDERS[0]), F.least(F.lit(FOLDERS[1]), F.ceil(F.col("n") / TEXTS_A_FOLDER))).cast("int")
        corpus.withColumn("folders", folders).write.mode("overwrite").parquet(f"{path}/corpus")
        count = texts.sparkSession.read.parquet(f"{path}/corpus").first()["folders"]
        folder = F.pmod(F.xxhash64("term"), F.lit(count)).cast("int")
        # a hot term's postings are spread over several files of its folder
        spread = index.withColumn("folder", folder).repartition("folder", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("folder", "term")
        spread.write.mode("overwrite").partitionBy("folder").option("compression", "zstd").parquet(f"{path}/postings")
        return cls(texts.sparkSession, path, key)

    def corpus(self) -> DataFrame:
        """One row: n, mean."""
        return self._corpus.select("n", "mean")

    def _folder(self, term: str) -> int:
        """Where a term's postings are, as `xxhash64` puts them there."""
        number = xxhash.xxh64_intdigest(term.encode(), 42)
        return (number - (1 << 64) if number >> 63 else number) % self.folders

    def postings(self, terms: list[str]) -> DataFrame:
        """Postings of the terms; a term that ends in * may stand in any folder."""
        held = self.spark.read.parquet(f"{self.path}/postings")
        wanted = functools.reduce(lambda a, b: a | b, (F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t for t in terms), F.lit(False))
        if not any(t.endswith("*") for t in terms):
            held = held.where(F.col("folder").isin(*{self._folder(t) for t in terms}))
        return held.where(wanted).drop("folder")


def content_words(question: str) -> list[str]:
    """The words of a question that rank: three bytes or more, no stopwords, once each, folded."""
    from weftline.functions.dates import _folded

    words = re.findall(r"[^\W_]+", _folded(question))
    return list(dict.fromkeys(w for w in words if len(w.encode()) >= 3 and w not in STOPWORDS))


def bm25(index: DataFrame, corpus: DataFrame, terms: list[str], key: str) -> DataFrame:
    """key, score of texts with any of the terms, higher is better. Every posting knows its text's length, so nothing but counts is joined."""
    hits = index.where(F.col("term").isin(*terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(corpus))  # one row a term, and one row
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))
    return scored.groupBy(key).agg(F.sum(part).alias("score"))


def phrase(index: DataFrame, words: list[str], key: str) -> DataFrame:
    """Keys of texts where the words follow each other; a last word ending in * is a prefix.

    The postings of the words alone come together, text by text; whether they follow each other is seen inside their arrays.
    """
    match = [F.col("term").startswith(w[:-1]) if w.endswith("*") else F.col("term") == w for w in words]
    starts = [F.when(m, _shifted(i)) for i, m in enumerate(match)]
    kept = index.where(functools.reduce(lambda a, b: a | b, match))
    gathered = kept.groupBy(key).agg(*(F.flatten(F.collect_list(s)).alias(f"_{i}") for i, s in enumerate(starts)))
    common = functools.reduce(F.array_intersect, (F.col(f"_{i}") for i in range(len(words))))
    return gathered.where(F.size(common) > 0).select(key)


def _shifted(by: int) -> Column:
    """Where a phrase begins whose word number `by` stands at each position."""
    return F.transform("positions", lambda at: at - by)


def identifiers(events: DataFrame, key: str = "record_id") -> DataFrame:
    """key, text: what an event is found by besides its text: a commit's hash, a file's path."""
    found = F.when(F.col("source") == "git", F.try_element_at("metadata", F.lit("hash"))).when(F.col("source") == "file", F.try_element_at("metadata", F.lit("path")))
    return events.select(key, found.alias("text")).where(F.col("text").rlike(r"\S"))


def lexical(indexes: list[tuple[DataFrame, DataFrame]], terms: list[str], key: str, most: int) -> DataFrame:
    """key, score of the best hits of several indexes: each is ranked by its own corpus, then hits are merged by score, each key once."""
    scored = functools.reduce(DataFrame.unionByName, (bm25(index, corpus, terms, key) for index, corpus in indexes))
    return scored.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(most)


def identifier_terms(question: str) -> list[list[str]]:
    """Identifiers a question names, each as words for `phrase`: task codes, commit hashes as prefixes, pull request numbers."""
    terms = [[m[0].lower(), m[1]] for m in re.findall(r"\b([A-Za-z]{2,10})-(\d+)\b", question)]
    for word in re.findall(r"\b[0-9a-f]{7,40}\b", question.lower()):
        if re.search(r"\d", word) and re.search("[a-f]", word):
            terms.append([f"{word}*"])
    for number in re.findall(r"(?i)\b(?:pr|pull request|merge request|mr)\s*#?\s*(\d+)\b", question):
        terms += [["pull", "request", number], ["merge", "request", number], ["pr", number]]
    return terms


def ranked(hits: DataFrame, list_no: int, *order: Column, per: tuple[str, ...] = ()) -> DataFrame:
    """A ranking as (key columns, list_no, rank)."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*per, F.lit(list_no)).orderBy(*order))).withColumn("list_no", F.lit(list_no))


def fuse(rankings: DataFrame, key: str, per: tuple[str, ...] = ()) -> DataFrame:
    """key, score, list_no, rank: reciprocal rank fusion; the copy of the first list stays, ties by first-seen order."""
    first = F.struct("list_no", "rank")
    fused = rankings.groupBy(*per, key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(first).alias("first"))
    return fused.select(*per, key, "score", F.col("first.list_no").alias("list_no"), F.col("first.rank").alias("rank"))
