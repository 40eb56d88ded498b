"""Queries over vectors, keywords, time, tasks, mapped records, measures and loads."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.operators import answer, evidence, ingest, mapping, metrics, tasks, timeline
from weftline.operators import filters as E
from weftline.operators import search as R
from weftline.plans import query as Q
from weftline.plans import sql as S
from weftline.plans.lineage import cut, own_folder
from weftline.plans.queries_events import _CHATTER, _IS_CHATTER, messages, records
from weftline.plans.registry import query
from weftline.sources import events as EV
from weftline.sources.tables import table

QUESTION = "o que falta no lote atrasado da planilha de custos"
_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity stream with its time in microseconds."""
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query(f"SELECT b.vec_id, round(1 - {_DOT}, 5) AS distance FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b ORDER BY 1 - {_DOT}, b.vec_id LIMIT 10")
def r1_knn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.orderBy("vec_id").select("embedding").first()["embedding"]
    return R.nearest(vectors, list(wanted), 10).select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT b.vec_id, round(1 - {_DOT}, 5) AS distance FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b WHERE b.label IN (2, 3) ORDER BY 1 - {_DOT}, b.vec_id LIMIT 10")
def r1_knn_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.orderBy("vec_id").select("embedding").first()["embedding"]
    return R.nearest(vectors, list(wanted), 10, F.col("label").isin(2, 3)).select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - {_DOT}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 5")
def r7_nearest_of_each(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.nearest_of_each(vectors, asked, 5).select("query_id", "vec_id", F.col("rank").cast("bigint"))


@query("WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings) SELECT vec_id, list_sum(list_transform(e, lambda x: round(x * 127.0 / m)))::BIGINT AS total, array_to_string(list_transform(e, lambda x: round(x * 127.0 / m)::INT), ',') AS code FROM m")
def r2_int8(spark, sf_dir):
    code = V.quantize(F.col("embedding"))
    total = F.aggregate(code, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", total.alias("total"), F.array_join(code.cast("array<string>"), ",").alias("code"))


_TERMS = ", ".join(f"'{w}'" for w in R.content_words(QUESTION))
_BM25 = f"""w AS (SELECT doc_id, {S.tokens('text')} AS words FROM documents), l AS (SELECT doc_id, coalesce(len(words), -1) AS length FROM w), c AS (SELECT count(*) AS n, avg(length) AS mean FROM l WHERE length >= 0),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM w) GROUP BY ALL), h AS (SELECT * FROM p WHERE term IN ({_TERMS})), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM h JOIN d USING (term) JOIN l USING (doc_id), c GROUP BY doc_id)"""


_INDEXES: dict[tuple[str, str], R.KeywordIndex] = {}


def indexed(spark: SparkSession, sf_dir: str) -> R.KeywordIndex:
    """The keyword index of the documents: built once a session, then read by its terms."""
    named = spark.sparkContext.applicationId, sf_dir
    if named not in _INDEXES:
        texts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", r"\p{M}", "").alias("text"))
        _INDEXES[named] = R.KeywordIndex.build(texts, own_folder(spark), "doc_id")
    return _INDEXES[named]


@query(f"WITH {_BM25.replace(S.tokens('text'), S.tokens("regexp_replace(text, '\\p{M}', '', 'g')"))} SELECT doc_id, round(score, 4) AS score FROM bm")
def r3_bm25(spark, sf_dir):
    index, terms = indexed(spark, sf_dir), R.content_words(QUESTION)
    return R.bm25(index.postings(terms), index.corpus(), terms, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({S.tokens("regexp_replace(text, '\\p{M}', '', 'g')")}, ' ') || ' ' AS t FROM documents) WHERE contains(t, ' lote atrasado ') AND regexp_matches(t, ' planilha de cust')")
def r3_phrase_prefix(spark, sf_dir):
    index = indexed(spark, sf_dir).postings(["lote", "atrasado", "planilha", "de", "cust*"])
    return R.phrase(index, ["lote", "atrasado"], "doc_id").join(R.phrase(index, ["planilha", "de", "cust*"], "doc_id"), "doc_id", "left_semi")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, terms = indexed(spark, sf_dir), R.content_words(QUESTION)
    words = R.bm25(index.postings(terms), index.corpus(), terms, "doc_id").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(R.LEXICAL_HEADROOM * 6)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    wanted = vectors.orderBy("doc_id").select("embedding").first()["embedding"]
    near = R.nearest(vectors, list(wanted), R.VECTOR_HEADROOM * 6, tie="doc_id")
    lists = R.ranked(near, 0, F.col("distance"), F.col("doc_id")).select("doc_id", "list_no", "rank").unionByName(R.ranked(words, 1, F.col("score").desc(), F.col("doc_id")).select("doc_id", "list_no", "rank"))
    return R.fuse(lists, "doc_id")


@query(f"""WITH {_BM25.replace(S.tokens('text'), S.tokens("regexp_replace(text, '\\p{M}', '', 'g')"))}, lx AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 72),
vx AS (SELECT b.vec_id AS doc_id, row_number() OVER (ORDER BY 1 - {_DOT}, b.vec_id) AS rank FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b QUALIFY rank <= 18),
u AS (SELECT doc_id, 0 AS list_no, rank FROM vx UNION ALL SELECT doc_id, 1, rank FROM lx)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(list_no) AS list_no FROM u GROUP BY doc_id""")
def r5_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"), "list_no")


_LOCATOR = "CASE WHEN source = 'git' THEN 'git:' || coalesce(r.metadata['repository'], '') || '@' || coalesce(r.metadata['hash'], '') WHEN source = 'browser' THEN r.metadata['url'] WHEN source = 'file' THEN 'file://' || r.metadata['path'] ELSE source || ':' || coalesce(r.metadata['conversation_id'], '') || '/' || coalesce(r.metadata['message_id'], '') END"


@query(f"WITH k AS (SELECT record_id, occurred_at, concat_ws('|', source, {_LOCATOR}) AS key FROM records r WHERE NOT (source = 'file' AND {S.filled(S.meta('removed_at'))} IS NOT NULL) AND NOT (source = 'git' AND coalesce({S.meta('authorship')}, '') = 'other') AND NOT ({_IS_CHATTER})) SELECT min(record_id) AS record_id, count(*) - 1 AS repeats, epoch_us(max(occurred_at)) AS latest_us FROM k GROUP BY key")
def r9_usable_evidence(spark, sf_dir):
    events = evidence.usable(records(spark, sf_dir), own_only=True).select("record_id", "source", "occurred_at", EV.locator().alias("locator"))
    return evidence.collapse_repeats(events, F.concat_ws("|", "source", "locator"), "record_id").select("record_id", "repeats", F.unix_micros("latest_at").alias("latest_us"))


@query("SELECT min(doc_id) AS doc_id, count(*) - 1 AS repeats FROM (SELECT doc_id, coalesce(sha256(nullif(text, '')), 'none' || doc_id) AS k FROM documents) GROUP BY k")
def r10_fold_images(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.nullif("text", F.lit("")), 256).alias("image"))
    return evidence.fold_images(docs, "image", "doc_id", "doc_id").select("doc_id", "repeats")


@query(f"WITH n AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - {_DOT} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - {_DOT}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 6) SELECT query_id, vec_id FROM (SELECT *, min(d) OVER (PARTITION BY query_id) AS least FROM n) WHERE least <= 0.61 AND d <= 0.72")
def f23_gates(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = R.nearest_of_each(vectors, asked, 7).where("query_id <> vec_id").where(F.col("rank") <= 7)
    return evidence.gates(hits, per=("query_id",)).select("query_id", "vec_id")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(n, lambda x: x BETWEEN 1 AND 6))), ',') AS valid, array_to_string(list_sort(list_distinct(list_filter(n, lambda x: NOT x BETWEEN 1 AND 6))), ',') AS unknown FROM (SELECT doc_id, list_transform(regexp_extract_all('[2] visto [' || (doc_id % 9) || '] e [2]', '\\[(\\d+)\\]', 1), lambda x: x::INT) AS n FROM documents)")
def r13_citations(spark, sf_dir):
    reply = F.concat(F.lit("[2] visto ["), (F.col("doc_id") % 9).cast("string"), F.lit("] e [2]"))
    cited = evidence.citations(reply, 6)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(cited["valid"].cast("array<string>"), ",").alias("valid"), F.array_join(cited["unknown"].cast("array<string>"), ",").alias("unknown"))


#: Links of the pages in the test data, in place of the trackers and code hosts of `tasks`.
LOCAL_TASKS = ((r"//([\w-]+)\.\w+/tarefas/(\d+)", 2),)
LOCAL_HOSTS = (tasks.CodeHost(r"^https?://([\w.-]+)/pr/(\d+)(?:[/?#].*)?$", r"^https?://([\w.-]+)/busca/"),)


@query("SELECT record_id, regexp_extract(url, '//([\\w-]+)\\.\\w+/tarefas/(\\d+)', 1) || '/' || regexp_extract(url, '//([\\w-]+)\\.\\w+/tarefas/(\\d+)', 2) AS task, regexp_extract(url, '/tarefas/(\\d+)', 1) AS id FROM (SELECT record_id, r.metadata['url'] AS url FROM records r WHERE source = 'browser') WHERE regexp_matches(url, '//([\\w-]+)\\.\\w+/tarefas/(\\d+)')")
def q1_task_refs(spark, sf_dir):
    visits = records(spark, sf_dir).where("source = 'browser'")
    return visits.select("record_id", F.explode(tasks.task_refs(tasks.link_text(), LOCAL_TASKS)).alias("t")).select("record_id", F.col("t.key").alias("task"), F.col("t.id").alias("id"))


@query("SELECT record_id, regexp_extract(url, '^https?://([\\w.-]+)/pr/(\\d+)', 1) AS repo, regexp_extract(url, '^https?://([\\w.-]+)/pr/(\\d+)', 2)::INT AS number FROM (SELECT record_id, r.metadata['url'] AS url FROM records r WHERE source = 'browser') WHERE regexp_matches(url, '^https?://([\\w.-]+)/pr/(\\d+)')")
def q2_pr_refs(spark, sf_dir):
    visits = records(spark, sf_dir).where("source = 'browser'")
    return visits.select("record_id", F.explode(tasks.pr_refs(tasks.link_text(), LOCAL_HOSTS)).alias("pr")).select("record_id", "pr.repo", "pr.number")


@query("""WITH v AS (SELECT r.metadata['url'] AS url, occurred_at FROM records r WHERE source = 'browser' AND occurred_at IS NOT NULL), p AS (SELECT regexp_extract(url, '^https?://([\\w.-]+)/pr/(\\d+)', 1) AS repo, regexp_extract(url, '^https?://([\\w.-]+)/pr/(\\d+)', 2)::INT AS number, min(occurred_at) AS seen FROM v WHERE regexp_matches(url, '^https?://([\\w.-]+)/pr/(\\d+)') GROUP BY 1, 2),
c AS (SELECT regexp_extract(url, '^https?://([\\w.-]+)/busca/', 1) AS repo, occurred_at AS made FROM v WHERE regexp_matches(url, '^https?://([\\w.-]+)/busca/'))
SELECT repo, number, EXISTS (SELECT 1 FROM c WHERE c.repo = p.repo AND seen >= made AND epoch_us(seen) - epoch_us(made) <= 900000000) AS opened_by_me FROM p""")
def j12_opened_after_creation(spark, sf_dir):
    return tasks.pull_requests(records(spark, sf_dir).where("source = 'browser'"), LOCAL_TASKS, LOCAL_HOSTS).select("repo", "number", "opened_by_me")


@query("""WITH c AS (SELECT user_id, epoch_us(ts) AS us, event_id, CASE WHEN event_type = 'purchase' THEN event_id END AS label FROM events), l AS (SELECT user_id, us, min(label) AS label FROM c WHERE label IS NOT NULL GROUP BY 1, 2),
g AS (SELECT c.event_id, c.label AS own, l.label, abs(l.us - c.us) AS gap, l.us FROM c LEFT JOIN l ON l.user_id = c.user_id AND abs(l.us - c.us) <= 1200000000)
SELECT event_id, coalesce(max(own), arg_min(label, gap * 2 + CASE WHEN us > (SELECT us FROM c WHERE c.event_id = g.event_id) THEN 1 ELSE 0 END)) AS near FROM g GROUP BY event_id""")
def j13_nearest(spark, sf_dir):
    label = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return timeline.nearest_cited(clicks(spark, sf_dir).select("event_id", "user_id", "us", "event_type"), label, 20, "user_id").select("event_id", "near")


@query("""SELECT a.event_id, CASE WHEN a.us - b.us <= 7200000000 THEN b.value END AS found FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error') a
ASOF LEFT JOIN (SELECT user_id, epoch_us(ts) AS us, max(event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.us >= b.us""")
def j14_asof_backward(spark, sf_dir):
    seen = clicks(spark, sf_dir)
    left = seen.where("event_type = 'error'").select("event_id", "user_id", "us")
    right = seen.where("event_type = 'view'").groupBy("user_id", "us").agg(F.max("event_id").alias("value"))
    return timeline.as_of(left, right, "user_id", 120).select("event_id", "found")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def t_sessions(spark, sf_dir):
    return timeline.sessions(clicks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "2 hours", "user_id")


MESSAGE_SCHEMA = {
    "version": 2, "target": "message/1", "name": "idb-messages", "source": "chatgpt", "revision": 1,
    "records": {"kind": "indexeddb", "namespace_prefix": "app:", "container": "messages", "each": "$.items[]"},
    "require": [{"path": "^.origin", "in": ["chatgpt", "discord"]}, {"path": "$.text", "kind_not": ["undefined", "null"]}],
    "fields": {
        "message_id": {"paths": ["$.id"]}, "conversation_id": {"paths": ["$.room", "^.origin"]}, "conversation": {"paths": ["$.title"], "default": "sem título"},
        "sender": {"paths": ["$.who.name"], "default": "desconhecido", "transform": "trim"}, "sender_id": {"paths": ["$.who.id"], "split": {"separator": "-", "index": 1}},
        "text": {"paths": ["$.text"], "required": True}, "sent_at": {"paths": ["$.at"], "transform": "unix_ms"}, "sent_by_me": {"paths": ["$.mine"]}, "revision": {"paths": ["$.rev"]},
    },
}


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as dynamic records of a browser database."""
    item = F.struct(
        F.col("message_id").alias("id"), F.col("conversation_id").alias("room"), F.col("conversation").alias("title"), F.struct(F.col("sender").alias("name"), F.col("sender_id").alias("id")).alias("who"),
        "text", F.unix_millis("sent_at").alias("at"), F.col("sent_by_me").alias("mine"), F.col("revision").alias("rev"),
    )
    body = F.to_json(F.struct(F.col("source").alias("origin"), F.array(item).alias("items")), {"ignoreNullFields": "false"})
    return messages(spark, sf_dir).select(F.lit("indexeddb").alias("kind"), F.lit("app:main").alias("namespace"), F.lit("messages").alias("container"), F.col("msg_key").alias("seq"), F.parse_json(body).alias("value"))


_KEPT = "source IN ('chatgpt', 'discord') AND text IS NOT NULL AND text <> '' AND sent_at IS NOT NULL AND epoch_us(sent_at) // 1000 > 0"


@query(f"""SELECT msg_key AS seq, message_id, coalesce(nullif(conversation_id, ''), source) AS conversation_id, coalesce(nullif(conversation, ''), 'sem título') AS conversation, coalesce(nullif(trim(sender, ' '), ''), 'desconhecido') AS sender,
coalesce(nullif(split_part(coalesce(sender_id, ''), '-', 2), ''), '') AS sender_id, text, epoch_us(sent_at) // 1000 AS sent_ms, coalesce(sent_by_me, false) AS sent_by_me, coalesce(revision, '') AS revision FROM idb_messages WHERE {_KEPT}""")
def m_map_records(spark, sf_dir):
    mapped = mapping.apply_schema(json_records(spark, sf_dir), mapping.load_schema(MESSAGE_SCHEMA)).where("kept")
    return mapped.select("seq", "message_id", "conversation_id", "conversation", "sender", "sender_id", "text", F.unix_millis("sent_at").alias("sent_ms"), "sent_by_me", "revision")


@query(f"SELECT count(*) AS records, count(*) AS in_store, count(*) AS items, count(*) FILTER (WHERE {_KEPT}) AS kept FROM idb_messages")
def a11_tally(spark, sf_dir):
    rows, schema = json_records(spark, sf_dir), mapping.load_schema(MESSAGE_SCHEMA)
    return mapping.tally(rows, mapping.apply_schema(rows, schema), schema)


@query("SELECT event_type AS store, unnest(['$', '$.k']) AS path, unnest(['object', 'number']) AS kind, count(*) AS n FROM events GROUP BY 1, 2, 3")
def a12_shape_profile(spark, sf_dir):
    return mapping.shape_profile(table(spark, sf_dir, "events"), "event_type", "props")


@query("SELECT event_type AS store, '$.k' AS path, CASE WHEN event_type = 'error' THEN 'missing' ELSE 'changed' END AS drift FROM events WHERE event_type IN ('error', 'view') GROUP BY event_type")
def a13_shape_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "props")
    changed = rows.withColumn("props", F.when(F.col("event_type") == "error", "{}").when(F.col("event_type") == "view", '{"k": "x"}').otherwise(F.col("props")))
    return mapping.shape_drift(mapping.shape_profile(rows, "event_type", "props"), mapping.shape_profile(changed, "event_type", "props"))


def _remapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = json_records(spark, sf_dir)
    other = MESSAGE_SCHEMA | {"revision": 2, "fields": MESSAGE_SCHEMA["fields"] | {"conversation_id": {"paths": ["$.title", "$.room", "^.origin"]}}}
    return tuple(mapping.apply_schema(rows, mapping.load_schema(s)).where("kept") for s in (MESSAGE_SCHEMA, other))


_UID_A = "sha256('chatgpt' || chr(0) || coalesce(nullif(conversation_id, ''), source) || chr(0) || message_id)"
_UID_B = "sha256('chatgpt' || chr(0) || coalesce(nullif(conversation, ''), nullif(conversation_id, ''), source) || chr(0) || message_id)"


@query(f"WITH a AS (SELECT DISTINCT {_UID_A} AS u FROM idb_messages WHERE {_KEPT}), b AS (SELECT DISTINCT {_UID_B} AS u FROM idb_messages WHERE {_KEPT}), s AS (SELECT count(*) AS n FROM a JOIN b USING (u)) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, n AS shared, n / (SELECT count(*) FROM a) >= 0.9 AS accepted FROM s")
def a14_compare_schemas(spark, sf_dir):
    return mapping.compare_schemas(*_remapped(spark, sf_dir))


@query(f"SELECT DISTINCT {_UID_A} AS old_uid, {_UID_B} AS new_uid FROM idb_messages WHERE {_KEPT} AND {_UID_A} <> {_UID_B}")
def j20_uid_changes(spark, sf_dir):
    return mapping.uid_changes(*_remapped(spark, sf_dir))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a case: those of high priority are relevant, the five dearest are found."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("question")).agg(
        F.array_sort(F.collect_list(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderkey")))).alias("relevant"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")))), lambda x: x["k"]), 1, 5).alias("found"),
        F.lit(None).cast("array<bigint>").alias("groups"),
    )


_CASES = "c AS (SELECT o_custkey AS question, list(o_orderkey) FILTER (WHERE starts_with(o_orderpriority, '1')) AS relevant, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:5] AS found FROM orders GROUP BY 1)"


@query(f"WITH {_CASES} SELECT question, CASE WHEN relevant IS NULL THEN NULL ELSE round(len(list_intersect(relevant, found)) / len(relevant), 6) END AS recall, CASE WHEN relevant IS NULL THEN NULL ELSE round(coalesce(1.0 / list_min(list_filter(list_transform(relevant, lambda r: list_position(found, r)), lambda p: p > 0)), 0), 6) END AS reciprocal_rank FROM c")
def a15_case_scores(spark, sf_dir):
    return metrics.scored_cases(_cases(spark, sf_dir)).select("question", F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(f"WITH {_CASES} SELECT round(avg(CASE WHEN relevant IS NOT NULL THEN len(list_intersect(relevant, found)) / len(relevant) END), 6) AS recall, round(avg(CASE WHEN relevant IS NOT NULL THEN coalesce(1.0 / list_min(list_filter(list_transform(relevant, lambda r: list_position(found, r)), lambda p: p > 0)), 0) END), 6) AS mrr, round(coalesce(avg(CASE WHEN relevant IS NULL THEN CASE WHEN len(found) = 0 THEN 1.0 ELSE 0.0 END END), 1), 6) AS rejection, 0.0::DOUBLE AS redundancy FROM c")
def a16_suite_scores(spark, sf_dir):
    scores = metrics.suite_scores(metrics.scored_cases(_cases(spark, sf_dir)))
    return scores.select(*(F.round(c, 6).alias(c) for c in ("recall", "mrr", "rejection", "redundancy")))


@query(f"""WITH {_CASES}, s AS (SELECT avg(CASE WHEN relevant IS NOT NULL THEN len(list_intersect(relevant, found)) / len(relevant) END) AS recall, avg(CASE WHEN relevant IS NOT NULL THEN coalesce(1.0 / list_min(list_filter(list_transform(relevant, lambda r: list_position(found, r)), lambda p: p > 0)), 0) END) AS mrr FROM c)
SELECT metric, round(value, 6) AS value, floor FROM (SELECT unnest(['recall', 'recall_high', 'mrr']) AS metric, unnest([recall, recall, mrr]) AS value, unnest([0.05, 0.99, 0.9999])::DOUBLE AS floor FROM s) WHERE value < floor""")
def a17_floors(spark, sf_dir):
    scores = metrics.suite_scores(metrics.scored_cases(_cases(spark, sf_dir))).withColumn("recall_high", F.col("recall"))
    return metrics.below_floors(scores, {"recall": 0.05, "recall_high": 0.99, "mrr": 0.9999}).select("metric", F.round("value", 6).alias("value"), "floor")


_NEAR = f"n AS (SELECT a.vec_id, a.label, min(1 - {_DOT}) AS closest FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL)"


@query(f"WITH {_NEAR} SELECT round(max(closest) FILTER (WHERE label < 5), 5) AS answerable, round(min(closest) FILTER (WHERE label >= 5), 5) AS unanswerable, max(closest) FILTER (WHERE label < 5) < min(closest) FILTER (WHERE label >= 5) AS separable FROM n")
def a18_calibration(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = R.nearest_of_each(vectors.select("vec_id", "embedding"), asked, 2).where("query_id <> vec_id").groupBy("query_id").agg(F.min("distance").alias("closest"))
    labels = vectors.select(F.col("vec_id").alias("query_id"), (F.col("label") < 5).alias("answerable"))
    found = metrics.calibration(near.join(labels, "query_id"))
    return found.select(F.round("answerable", 5).alias("answerable"), F.round("unanswerable", 5).alias("unanswerable"), "separable")


@query("WITH c AS (SELECT l_returnflag AS field, count(*) AS trials, count(*) FILTER (WHERE l_linestatus = 'F') AS successes FROM lineitem GROUP BY 1), p AS (SELECT *, successes / trials AS p, 1.96 * 1.96 AS z2 FROM c) SELECT field, trials, successes, round((p + z2 / (2 * trials) - 1.96 * sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))) / (1 + z2 / trials), 6) AS low, round((p + z2 / (2 * trials) + 1.96 * sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))) / (1 + z2 / trials), 6) AS high FROM p")
def a19_wilson(spark, sf_dir):
    judged = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("field"), (F.col("l_linestatus") == "F").alias("right"))
    return metrics.accuracy(judged).select("field", "trials", "successes", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT doc_id, round((CASE WHEN contains(lower(text), 'lote') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'prazo') THEN 1 ELSE 0 END) / 2, 2) AS coverage FROM documents WHERE text IS NOT NULL")
def a23_coverage(spark, sf_dir):
    captions = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("caption"), F.array(F.lit("Lote"), F.lit("prazo")).alias("must_contain"))
    return metrics.coverage(captions).select("doc_id", F.round("coverage", 2).alias("coverage"))


CUT_AT = datetime(2026, 1, 1, tzinfo=UTC)


def _loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "records").select("uid", "source", "occurred_at", "content", "metadata", F.col("record_id").alias("arrival"), "exported_at")
    early = F.col("exported_at") < F.lit(CUT_AT)
    return ingest.winners(rows.where(early)), rows.where(~early)


_REV = "try_cast(r.metadata['revision'] AS DECIMAL(38, 0))"
_LOADS = f"""s AS (SELECT uid, content, {_REV} AS rev, record_id FROM records r WHERE exported_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY {_REV} DESC NULLS LAST, record_id) = 1),
i AS (SELECT uid, content, {_REV} AS rev, record_id FROM records r WHERE exported_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00' AND uid NOT IN (SELECT uid FROM records WHERE source = 'discord') QUALIFY row_number() OVER (PARTITION BY uid ORDER BY {_REV} DESC NULLS LAST, record_id) = 1),
m AS (SELECT coalesce(s.uid, i.uid) AS uid, s.uid IS NULL AS fresh, i.uid IS NOT NULL AND (s.uid IS NULL OR CASE WHEN i.rev IS NULL OR s.rev IS NULL THEN i.content IS DISTINCT FROM s.content ELSE i.rev > s.rev END) AS take, i.record_id AS i_id, s.record_id AS s_id FROM s FULL JOIN i ON s.uid = i.uid)"""


@query(f"WITH {_LOADS} SELECT uid, CASE WHEN take THEN i_id ELSE s_id END AS arrival, CASE WHEN fresh THEN 'inserted' WHEN take THEN 'updated' ELSE 'kept' END AS outcome FROM m")
def i2_upsert(spark, sf_dir):
    stored, incoming = _loads(spark, sf_dir)
    forgotten = table(spark, sf_dir, "records").where("source = 'discord'").select("uid")
    return ingest.upsert(stored.drop("exported_at"), incoming.drop("exported_at"), forgotten).select("uid", "arrival", "outcome")


@query(f"WITH {_LOADS} SELECT n AS collected, inserted, updated, n - inserted - updated AS already FROM (SELECT count(*) FILTER (WHERE fresh) AS inserted, count(*) FILTER (WHERE take AND NOT fresh) AS updated FROM m), (SELECT count(*) AS n FROM records WHERE exported_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00')")
def a10_load_report(spark, sf_dir):
    stored, incoming = _loads(spark, sf_dir)
    forgotten = table(spark, sf_dir, "records").where("source = 'discord'").select("uid")
    return ingest.load_report(ingest.upsert(stored.drop("exported_at"), incoming.drop("exported_at"), forgotten), incoming)


@query("SELECT uid FROM records GROUP BY uid HAVING bool_or(source = 'browser' AND occurred_at < TIMESTAMPTZ '2026-07-03 00:00:00+00') OR bool_or(source = 'teams' AND occurred_at < TIMESTAMPTZ '2026-01-02 00:00:00+00')")
def i7_retention(spark, sf_dir):
    today = F.lit(datetime(2026, 10, 1, tzinfo=UTC))
    return ingest.forget(table(spark, sf_dir, "records"), ingest.expired({"browser": 90, "teams": 272}, today))[1]


@query("SELECT path, CASE WHEN here AND gone THEN 'returned' WHEN here THEN 'present' WHEN gone THEN 'still_removed' ELSE 'removed' END AS state FROM (SELECT path, contains(path, '/notas/') AS here, hash_no % 2 = 0 AS gone FROM (SELECT DISTINCT r.metadata['path'] AS path, length(r.metadata['path']) AS hash_no FROM records r WHERE source = 'file' AND r.metadata['path'] IS NOT NULL))")
def i8_snapshot(spark, sf_dir):
    paths = records(spark, sf_dir).where((F.col("source") == "file") & EV.meta("path").isNotNull()).select(EV.meta("path").alias("path")).distinct()
    stored = paths.withColumn("removed_at", F.when(F.length("path") % 2 == 0, "2026-01-01"))
    return ingest.snapshot(stored, paths.where(F.contains("path", F.lit("/notas/"))), F.lit(CUT_AT)).select("path", "state")


_CHANGES = f"c AS (SELECT DISTINCT {_UID_A} AS o, {_UID_B} AS n FROM idb_messages WHERE {_KEPT} AND {_UID_A} <> {_UID_B}), s AS (SELECT DISTINCT {_UID_A} AS uid FROM idb_messages WHERE {_KEPT}), free AS (SELECT n, min(o) AS o FROM c WHERE o NOT IN (SELECT o FROM c WHERE n IN (SELECT uid FROM s)) GROUP BY n)"


def _rekeyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    old, new = _remapped(spark, sf_dir)
    stored = old.select("uid").distinct()
    gone = stored.where(F.col("uid").substr(1, 1).isin("0", "1", "2"))
    return ingest.rekey(stored, mapping.uid_changes(old, new), gone)


@query(f"WITH {_CHANGES} SELECT coalesce(n, uid) AS uid FROM s LEFT JOIN free ON o = uid")
def i11_rekey(spark, sf_dir):
    return _rekeyed(spark, sf_dir)[0]


@query(f"WITH {_CHANGES} SELECT DISTINCT coalesce(n, uid) AS uid FROM s LEFT JOIN c ON o = uid WHERE uid[1] IN ('0', '1', '2')")
def i11_carried(spark, sf_dir):
    """What is remembered as forgotten, under the new uids."""
    return _rekeyed(spark, sf_dir)[1]


@query(f"WITH {_CHANGES} SELECT (SELECT count(*) FROM c) AS asked, (SELECT count(*) FROM c WHERE n IN (SELECT uid FROM s)) AS conflicts")
def i11_conflicts(spark, sf_dir):
    return _rekeyed(spark, sf_dir)[2]


@query("SELECT record_id FROM records r WHERE length(content) > 0 AND (source, sha256(content)) NOT IN (SELECT DISTINCT source, sha256(content) FROM records WHERE source IN ('git', 'file') AND length(content) > 0)")
def j5_without_chunks(spark, sf_dir):
    events = records(spark, sf_dir)
    chunks = R.text_chunks(events.where(F.col("source").isin("git", "file")))
    return ingest.without_chunks(events, chunks).select("record_id")


_REPRESENTED = "SELECT l_suppkey AS entity, l_returnflag AS modality, l_linestatus AS kind, 'p' || l_partkey || '/' || l_quantity::INT AS content, l_shipdate AS t, CASE WHEN l_linenumber % 3 <> 0 THEN 'p' || l_partkey || '/' || l_quantity::INT END AS vector FROM lineitem"


@query(f"WITH r AS ({_REPRESENTED}), l AS (SELECT entity, modality, kind, max_by(content, (t, content)) AS content FROM r GROUP BY 1, 2, 3), v AS (SELECT entity, modality, kind, max_by(content, (t, content)) AS content FROM r WHERE vector IS NOT NULL GROUP BY 1, 2, 3) SELECT l.*, CASE WHEN l.content = v.content THEN l.content END AS vector FROM l LEFT JOIN v USING (entity, modality, kind)")
def i17_representations(spark, sf_dir):
    """The last representation of each kind; its vector only where it was made from the same content."""
    content = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_quantity").cast("int").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("modality"), F.col("l_linestatus").alias("kind"), content.alias("content"), F.col("l_shipdate").alias("at"), F.when(F.col("l_linenumber") % 3 != 0, content).alias("vector"))
    return ingest.latest_representations(rows)


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.concat("text", F.lit("\f"), F.coalesce("title", F.lit("")), F.lit("\f ")).alias("content"))


@query("SELECT doc_id, unnest(range(1, len(p) + 1)) AS page, unnest(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '\\S') THEN 'read' ELSE 'pending' END)) AS state FROM (SELECT doc_id, string_split(text || chr(12) || coalesce(title, '') || chr(12) || ' ', chr(12)) AS p FROM documents WHERE text IS NOT NULL)")
def s8_pages(spark, sf_dir):
    return answer.pages(_paged(spark, sf_dir), "doc_id").select("doc_id", F.col("page").cast("bigint"), "state")


@query("SELECT record_id, regexp_matches(r.metadata['url'], '^https://.*\\.example/docs/.*$') AS allowed FROM records r WHERE source = 'browser'")
def s26_in_scope(spark, sf_dir):
    return records(spark, sf_dir).where("source = 'browser'").select("record_id", answer.in_scope(EV.meta("url"), ["https://*.example/docs/*"]).alias("allowed"))


@query("SELECT least(count(*), 700) AS n FROM records WHERE source = 'teams'")
def a1_capped_count(spark, sf_dir):
    return spark.createDataFrame([(answer.capped_count(records(spark, sf_dir).where("source = 'teams'"), 700),)], "n bigint")


@query(f"WITH {S.PEOPLE} SELECT DISTINCT record_id FROM people WHERE role IN ('sender', 'author', 'mentioned') AND name_key IN ('natalia zazitafe', 'bruno tezavajo')")
def f13_linked_entities(spark, sf_dir):
    from weftline.operators import graph

    events = records(spark, sf_dir)
    return answer.linked_to(events, graph.entity_links(events), ["natalia zazitafe", "bruno tezavajo"]).select("record_id")


@query("SELECT l_partkey AS image, l_returnflag AS model FROM lineitem WHERE l_returnflag <> 'A' OR l_linestatus IS DISTINCT FROM 'F' GROUP BY l_partkey, l_returnflag")
def j10_outdated(spark, sf_dir):
    described = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sha256"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("prompt")).distinct()
    images = described.select("sha256").distinct()
    return answer.outdated(images, described, "A", "F").select(F.col("sha256").alias("image"), "model").distinct()


@query("WITH b AS (SELECT vec_id // 100 AS block, count(*) AS live FROM embeddings GROUP BY 1) SELECT count(*) AS blocks, sum(live)::BIGINT AS used, count(*) * 128 AS slots, round((count(*) - ceil(sum(live) / 128)) / count(*), 6) AS reclaimable FROM b")
def a22_slots(spark, sf_dir):
    blocks = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 100).alias("block")).agg(F.count("*").alias("live"))
    found = answer.slot_statistics(blocks, 128)
    return found.select("blocks", "used", "slots", F.round("reclaimable", 6).alias("reclaimable"))


@query(f"SELECT vec_id FROM (SELECT b.vec_id, round(1 - {_DOT}, 9) AS d FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b) WHERE d <= 0.72")
def f22_on_topic(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.orderBy("vec_id").select("embedding").first()["embedding"]
    distance = F.round(V.cosine_distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in wanted))), 9)
    return answer.on_topic(vectors.select("vec_id", distance.alias("distance"), F.col("vec_id").alias("record_id"), F.col("vec_id").alias("occurred_at"))).select("vec_id")


_ASKED = "o que houve depois do lote atrasado?"
_R4_TERMS = ", ".join(f"'{w}'" for w in R.content_words(_ASKED))


@query(f"""WITH ch AS (SELECT vec_id AS id, embedding, coalesce(text, '') AS text FROM embeddings JOIN documents ON vec_id = doc_id), w AS (SELECT id, {S.tokens('text')} AS words FROM ch), c AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
p AS (SELECT id, term, len(words) AS length, count(*) AS tf FROM (SELECT id, words, unnest(words) AS term FROM w) WHERE term IN ({_R4_TERMS}) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
lx AS (SELECT id, 1 AS list_no, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM p JOIN d USING (term), c GROUP BY 1) QUALIFY rank <= 18),
far AS (SELECT b.id, 1 - {_DOT} AS distance FROM (SELECT * FROM ch ORDER BY id LIMIT 1) a, ch b), vx AS (SELECT id, 0 AS list_no, row_number() OVER (ORDER BY distance, id) AS rank FROM far QUALIFY rank <= 18),
summed AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 1000 + rank) AS first FROM (SELECT * FROM vx UNION ALL SELECT * FROM lx) GROUP BY id), fused AS (SELECT id, row_number() OVER (ORDER BY score DESC, first) AS rank FROM summed QUALIFY rank <= 18),
hit AS (SELECT f.id, f.rank, distance, source, text AS content, {S.headline('text')} AS head FROM fused f JOIN far USING (id) JOIN documents ON doc_id = f.id),
kept AS (SELECT * FROM hit WHERE NOT (source IS NOT DISTINCT FROM 'teams' AND len(list_filter({S.tokens("CASE WHEN starts_with(head, ':') THEN substr(head, 2) ELSE head END")}, lambda x: NOT list_contains({_CHATTER}, x))) = 0) QUALIFY row_number() OVER (PARTITION BY coalesce(sha256(content), id::VARCHAR) ORDER BY rank, id) = 1),
near AS (SELECT * FROM kept WHERE distance <= 0.72 AND (SELECT min(distance) FROM kept) <= 0.61), best AS (SELECT id, source, place AS rank FROM (SELECT id, source, row_number() OVER (ORDER BY rank, id) AS place FROM near) WHERE place <= 6),
anchor AS (SELECT id, epoch_us(created_at) AS us FROM best JOIN documents ON doc_id = id WHERE rank = 1),
beside AS (SELECT doc_id, source, row_number() OVER (ORDER BY abs(epoch_us(created_at) - us), doc_id) + 6 AS place FROM documents, anchor WHERE doc_id NOT IN (SELECT id FROM best) AND epoch_us(created_at) >= us - 7200000000 AND epoch_us(created_at) < us + 7200000000 QUALIFY place <= 10)
SELECT id AS record_id, rank, source FROM best UNION ALL SELECT doc_id, place, source FROM beside""")
def r4_retrieve(spark, sf_dir):
    """The whole way from a question to ranked events: documents as events, the test vectors as their chunks' embeddings."""
    docs = table(spark, sf_dir, "documents")
    events = docs.select(F.col("doc_id").alias("record_id"), "source", F.col("created_at").alias("occurred_at"), F.col("text").alias("content"), F.create_map(F.lit("title"), F.coalesce("title", F.lit(""))).alias("metadata"))
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding").join(docs.select(F.col("doc_id").alias("record_id"), F.coalesce("text", F.lit("")).alias("text")), "record_id").withColumn("chunk_id", F.col("record_id"))
    wanted = chunks.orderBy("chunk_id").select("embedding").first()["embedding"]
    found = answer.retrieve(_ASKED, chunks, events, list(wanted))
    return found.select("record_id", F.col("rank").cast("bigint"), "source")


QUESTIONS = ("liste os commits de ontem", "mensagens que recebi semana passada", "resumo de hoje", "tarefas pendentes desta semana", "what did I do yesterday", "quem falou do lote atrasado?", "commits e mensagens de ontem")


@query("SELECT * FROM (VALUES ('liste os commits de ontem', true, 'list', 'git', 'any', 'ontem'), ('mensagens que recebi semana passada', true, 'list', 'teams', 'received', 'semana passada'), ('resumo de hoje', true, 'answer', '', 'any', 'hoje'), ('tarefas pendentes desta semana', false, 'answer', '', 'any', ''), ('what did I do yesterday', true, 'answer', '', 'any', 'yesterday'), ('quem falou do lote atrasado?', false, 'answer', '', 'any', ''), ('commits e mensagens de ontem', false, 'answer', '', 'any', '')) t(question, by_rules, mode, source, direction, period)")
def l1_plan_rules(spark, sf_dir):
    rows = []
    for question in QUESTIONS:
        plan = Q.plan_by_rules(question, date(2026, 9, 26)) or Q.Plan()
        rows.append((question, plan.by_rules, plan.mode, plan.source, plan.direction, plan.period))
    return spark.createDataFrame(rows, "question string, by_rules boolean, mode string, source string, direction string, period string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: keywords and vectors fused, the documents beside their scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "source", X.headline(F.col("text")).alias("headline"))
    return cut(_hybrid(spark, sf_dir)).join(docs, "doc_id").select("doc_id", "score", "list_no", "rank", "title", "source", "headline").orderBy(F.desc("score"), "list_no", "rank")
