"""Queries over paths and values of dynamic records, markup, and the sources that records come from."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import mapping as M
from weftline.operators import tasks
from weftline.plans import sql as S
from weftline.plans.queries_events import messages, records
from weftline.plans.registry import query
from weftline.sources import events as V
from weftline.sources import teams
from weftline.sources.tables import table


def _variant(*fields) -> F.Column:
    return F.parse_json(F.to_json(F.struct(*fields)))


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as values with arrays, maps, sets, dates, big integers and keys that are data."""
    body = F.concat(
        F.lit('{"items":['), F.to_json(F.struct(F.col("text").alias("t"))), F.lit(","), F.to_json(F.struct(F.col("sender").alias("t"))), F.lit('],"map":{"$map":[["k",'), F.to_json(F.struct("sender_id")), F.lit('],["l",'), F.to_json(F.struct("conversation_id")),
        F.lit(']]},"set":{"$set":['), F.col("msg_key").cast("string"), F.lit(']},"big":{"$bigint":"9007199254740993'), F.col("msg_key").cast("string"), F.lit('"},"byId":{"'), F.lpad(F.col("msg_key").cast("string"), 7, "0"), F.lit('":'), F.to_json(F.struct("revision")), F.lit(',"plain":{"revision":"no"}}}'),
    )
    return messages(spark, sf_dir).select("msg_key", F.parse_json(body).alias("v"))


@query("""SELECT msg_key, coalesce(text, sender, '') AS item, coalesce(sender_id, '') AS first_of_map, msg_key::VARCHAR AS member, '9007199254740993' || msg_key AS big, coalesce(revision, '') AS by_id,
len(list_filter([text, sender], lambda x: x IS NOT NULL)) AS n_items, 'undefined,map,set,bigint,object,array' AS kinds FROM idb_messages""")
def m4_paths(spark, sf_dir):
    v = F.col("v")
    kinds = F.concat_ws(",", *(M.kind_of(M.first_at(v, p)) for p in ("$.none", "$.map", "$.set", "$.big", "$.byId", "$.items")))
    # an entry of a map without the key is an empty object, and the first value counts
    first = F.get(M.reached(v, "$.map{}"), F.lit(0))
    return shaped(spark, sf_dir).select(
        "msg_key", M.scalar(v, "$.items[].t").alias("item"), M.scalar(first, "$.sender_id").alias("first_of_map"), M.scalar(v, "$.set<>").alias("member"), M.scalar(v, "$.big").alias("big"), M.scalar(v, "$.byId.<id>.revision").alias("by_id"),
        F.size(M.reached(v, "$.items[].t")).cast("bigint").alias("n_items"), kinds.alias("kinds"),
    )


@query("SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN '0' WHEN e >= 0 THEN k || repeat('0', e) ELSE rtrim(rtrim(w || '.' || lpad((k % (10 ** -e)::BIGINT)::VARCHAR, -e, '0'), '0'), '.') END AS text FROM (SELECT l_orderkey, l_linenumber, l_orderkey AS k, l_linenumber * 4 - 12 AS e, CASE WHEN l_linenumber < 3 THEN l_orderkey // (10 ** (12 - l_linenumber * 4))::BIGINT END AS w FROM lineitem)")
def m10_number_text(spark, sf_dir):
    """Numbers from 1e-8 to beyond 1e20 times the order's key."""
    literal = F.concat(F.col("l_orderkey").cast("string"), F.lit("e"), (F.col("l_linenumber") * 4 - 12).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.parse_json(literal).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", M.scalar(F.col("v"), "$").alias("text")).distinct()


_MS = "epoch_us(sent_at) // 1000"


@query(f"SELECT msg_key, CASE WHEN {_MS} > 0 THEN {_MS} END AS date_ms, NULL::BIGINT AS bare_ms, CASE WHEN {_MS} > 0 THEN {_MS} END AS unix_ms, CASE WHEN {_MS} > 0 THEN {_MS} END AS unix_s, {_MS} AS iso_ms FROM idb_messages")
def m8_times(spark, sf_dir):
    ms = F.unix_millis("sent_at")
    date = F.concat(F.lit('{"$date":'), ms.cast("string"), F.lit("}"))
    seconds = F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))
    iso = F.concat(F.lit('"'), F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))
    read = lambda text, transform: F.unix_millis(M.read_time(F.parse_json(text), transform))
    return messages(spark, sf_dir).select("msg_key", read(date, "").alias("date_ms"), read(ms.cast("string"), "").alias("bare_ms"), read(ms.cast("string"), "unix_ms").alias("unix_ms"), read(seconds, "unix_s").alias("unix_s"), read(iso, "iso8601").alias("iso_ms"))


@query("SELECT msg_key, coalesce(sent_by_me, false) AS plain, false AS quoted, coalesce(sent_by_me, false) AS segment FROM idb_messages")
def m9_flags(spark, sf_dir):
    me = F.col("sent_by_me").cast("string")
    read = lambda text, rule: M.read_flag(F.parse_json(text), rule)
    plain, cut = M.FieldRule(("$",)), M.FieldRule(("$",), split=("_", 0))
    quoted = F.concat(F.lit('"'), me, F.lit('"'))
    composite = F.concat(F.lit('"'), me, F.lit("_"), F.col("message_id"), F.lit('"'))
    return messages(spark, sf_dir).select("msg_key", F.coalesce(read(me, plain), F.lit(False)).alias("plain"), F.coalesce(read(quoted, plain), F.lit(False)).alias("quoted"), F.coalesce(read(composite, cut), F.lit(False)).alias("segment"))


_BARE = "regexp_replace(coalesce(sender, 'ninguém'), '[&;#]', '', 'g')"


@query(f"SELECT msg_key, '— ' || {_BARE} || ' <é> & ' || chr(8364) || chr(128512) || chr(65533) || ' &nada; R' || chr(38) || 'D ©' AS text FROM idb_messages")
def m11_entities(spark, sf_dir):
    bare = F.regexp_replace(F.coalesce("sender", F.lit("ninguém")), "[&;#]", "")
    for plain, entity in (("a", "&#97;"), ("ã", "&atilde;"), ("é", "&#233;"), ("ç", "&#xE7;"), ("í", "&iacute")):
        bare = F.replace(bare, F.lit(plain), F.lit(entity))
    return messages(spark, sf_dir).select("msg_key", X.unescape_entities(F.concat(F.lit("&mdash; "), bare, F.lit(" &lt;&eacute;&gt; &amp; &#128;&#x1F600;&#0; &nada; R&D &copy"))).alias("text"))


@query("SELECT DISTINCT conversation_id, CASE WHEN regexp_matches(conversation_id, '^[0-9]{6,}$') THEN '<n>' ELSE regexp_replace(regexp_replace(regexp_replace(n, g, '<guid>', 'g'), '[^\\s@:]+@[^\\s@:]+', '<email>', 'g'), '\\d{6,}', '<n>', 'g') END AS masked, n[1:least(coalesce(nullif(strpos(n, m), 0), 1000) , 1000) - 1] AS prefix FROM (SELECT conversation_id, 'Store:' || conversation_id || ':' || 'ana@corp.example' || ':v2' AS n, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}' AS g, regexp_extract('Store:' || conversation_id || ':' || 'ana@corp.example' || ':v2', '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[^\\s@:]+@[^\\s@:]+|\\d{6,}') AS m FROM chats)")
def m5_mask_name(spark, sf_dir):
    name = F.concat(F.lit("Store:"), F.col("conversation_id"), F.lit(":ana@corp.example:v2"))
    return table(spark, sf_dir, "chats").select("conversation_id", X.mask_name(name).alias("masked"), X.stable_prefix(name).alias("prefix")).distinct()


@query("SELECT doc_id, 1 + least(2, doc_id % 4) AS page FROM documents")
def w7_page_of(spark, sf_dir):
    """The page of a byte offset in a text of three pages with characters of two bytes."""
    text = F.lit("é" * 10 + "\f" + "ç" * 10 + "\f" + "ã" * 10)
    return table(spark, sf_dir, "documents").select("doc_id", X.page_of(text, F.least(F.lit(2), F.col("doc_id") % 4) * 21 + 4).cast("bigint").alias("page"))


@query("SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'git.lab.example/g/p!7 acme/site!9' ELSE 'acme/site!9 git.lab.example/g/p!7' END AS refs FROM records")
def q2_pr_order(spark, sf_dir):
    """Links to two hosts, in the order of the text."""
    links = "https://git.lab.example/g/p/-/merge_requests/7", "https://github.com/acme/site/pull/9/files"
    text = F.when(F.col("record_id") % 2 == 0, F.lit(f"vi {links[0]} e {links[1]}")).otherwise(F.lit(f"vi {links[1]} e {links[0]}"))
    found = F.transform(tasks.pr_refs(text), lambda pr: F.concat(pr["repo"], F.lit("!"), pr["number"].cast("string")))
    return records(spark, sf_dir).select("record_id", F.array_join(found, " ").alias("refs"))


#: How the test's chats stand for the client's types of conversations.
_TYPES = {"chat": "Chat", "canal": "Topic", "reunião": "Meeting", "conversa": "Other"}


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test's messages and chats as a chat client stores them: a chain a message, a record a conversation, a profile a sender."""
    key = F.col("msg_key")
    kind = F.when(key % 7 == 3, "Event/Call").when(key % 2 == 0, "Text").otherwise("RichText/Html")
    thread = F.when(key % 11 == 5, "streamofcalllogs").otherwise("chat")
    deleted = F.when(key % 13 == 4, F.struct(F.lit(1).alias("at")))
    image = F.when(key % 3 == 0, '<img itemtype="http://schema/AMSImage" src="https://media.example/v1/objects/0-a/views/imgo">').otherwise("")
    message = F.to_json(F.struct(
        F.col("message_id").alias("id"), F.col("conversation_id").alias("conversationId"), kind.alias("messageType"), thread.alias("threadType"), F.when(key % 4 == 0, F.concat(F.lit(" "), F.col("sender"))).alias("imDisplayName"),
        F.coalesce("sender_id", F.lit("")).alias("creator"), F.concat(F.coalesce("text", F.lit("")), image).alias("content"), F.unix_millis("sent_at").alias("originalArrivalTime"), F.unix_millis("captured_at").alias("clientArrivalTime"), F.col("sent_by_me").alias("isSentByCurrentUser"), F.col("revision").alias("version"), deleted.alias("deletionInfo"),
    ))
    held = messages(spark, sf_dir)
    shape = lambda df, place, seq, body: df.select(F.lit("indexeddb").alias("kind"), F.lit("https_chat").alias("origin"), F.lit(place[0] + "x").alias("namespace"), F.lit(place[1]).alias("container"), seq.cast("bigint").alias("seq"), F.parse_json(body).alias("value"))
    chains = shape(held, teams.CHAINS, key, F.concat(F.lit('{"messageMap":{"'), key.cast("string"), F.lit('":'), message, F.lit("}}")))
    chats = table(spark, sf_dir, "chats")
    topic = F.create_map(F.lit("topic"), F.when(F.col("chat_id") % 2 == 0, F.col("subject")), F.lit("spaceThreadTopic"), F.when(F.col("chat_id") % 5 == 0, F.concat(F.lit("Time "), F.col("chat_id").cast("string"))))
    title = F.struct(F.when(F.col("chat_id") % 3 == 0, F.lit(" Título longo ")).alias("longTitle"), F.transform(F.array(*(F.lit(n) for n in ("Ana", " ", "Bea", "Caio", "Davi", "Eva"))), lambda n: F.struct(n.alias("displayName"))).alias("avatarUsersInfo"))
    types = F.create_map(*(F.lit(x) for pair in _TYPES.items() for x in pair))
    body = F.to_json(F.struct(F.col("conversation_id").alias("id"), types[F.col("kind")].alias("type"), F.col("conversation_id").alias("teamId"), topic.alias("threadProperties"), title.alias("chatTitle")))
    rooms = shape(chats, teams.CONVERSATIONS, F.col("chat_id"), body)
    named = held.where("sender_id is not null and sender is not null")
    people = shape(named, teams.PROFILES, key, F.to_json(F.struct(F.col("sender_id").alias("mri"), F.col("sender").alias("displayName"))))
    return chains.unionByName(rooms).unionByName(people)


_CLEAN = "nullif(trim({0}, ' '), '')"
_TITLE = f"""titles AS (SELECT conversation_id, CASE kind WHEN 'conversa' THEN 'conversa' ELSE kind END AS kind, coalesce(CASE kind
 WHEN 'canal' THEN CASE WHEN chat_id % 5 = 0 THEN 'Time ' || chat_id || ' › ' ELSE '' END || coalesce(topic, 'Geral') WHEN 'reunião' THEN coalesce(topic, long) WHEN 'chat' THEN coalesce(topic, long, 'Ana, Bea, Caio, Davi') ELSE topic END, '') AS title
 FROM (SELECT *, CASE WHEN chat_id % 2 = 0 THEN {_CLEAN.format('subject')} END AS topic, CASE WHEN chat_id % 3 = 0 THEN 'Título longo' END AS long FROM chats))"""


@query(f"WITH {_TITLE} SELECT conversation_id, kind AS conversation_kind, title AS conversation FROM titles")
def s14_titles(spark, sf_dir):
    return teams.titles(chat_records(spark, sf_dir))


_AT = "CASE WHEN epoch_us(sent_at) // 1000 > 0 THEN sent_at ELSE captured_at END"


@query(f"""WITH {_TITLE}, p AS (SELECT sender_id, arg_max(n, msg_key) AS name FROM (SELECT sender_id, {_CLEAN.format('sender')} AS n, msg_key FROM idb_messages WHERE sender_id <> '' AND sender IS NOT NULL) WHERE n IS NOT NULL GROUP BY 1),
w AS (SELECT * FROM idb_messages WHERE msg_key % 7 <> 3 AND msg_key % 11 <> 5 AND msg_key % 13 <> 4 AND message_id <> '' AND conversation_id <> '' AND (coalesce(text, '') <> '' OR msg_key % 3 = 0))
SELECT sha256('teams' || chr(0) || w.conversation_id || chr(0) || message_id) AS uid, epoch_us({_AT}) // 1000 AS ms, coalesce(CASE WHEN msg_key % 4 = 0 THEN {_CLEAN.format('sender')} END, p.name, 'desconhecido') AS sender, coalesce(t.title, '') AS conversation, coalesce(t.kind, 'conversa') AS kind,
coalesce(sent_by_me, false)::VARCHAR AS mine, coalesce(revision, '') AS revision, CASE WHEN msg_key % 3 = 0 THEN 'https://media.example/v1/objects/0-a/views/imgo' END AS images FROM w LEFT JOIN titles t ON t.conversation_id = w.conversation_id LEFT JOIN p ON p.sender_id = w.sender_id""")
def s12_teams(spark, sf_dir):
    found = teams.from_teams(chat_records(spark, sf_dir))
    told = lambda name, to: V.meta(name).alias(to)
    return found.select("uid", F.unix_millis("occurred_at").alias("ms"), told("sender", "sender"), told("conversation", "conversation"), told("conversation_kind", "kind"), told("sent_by_me", "mine"), told("revision", "revision"), told("image_urls", "images"))


@query("SELECT (SELECT count(*) FROM idb_messages) * 1 + (SELECT count(*) FROM chats) + (SELECT count(*) FROM idb_messages WHERE sender_id IS NOT NULL AND sender IS NOT NULL) AS records, (SELECT count(*) FROM idb_messages) AS chains, (SELECT count(*) FROM idb_messages) AS messages, (SELECT count(*) FROM idb_messages WHERE conversation_id IS NOT NULL) AS known")
def s16_check(spark, sf_dir):
    return teams.check(chat_records(spark, sf_dir))


@query("SELECT msg_key, CASE WHEN msg_key % 3 = 0 THEN 'https://m.example/v1/objects/a_1/views/imgo' WHEN msg_key % 3 = 1 THEN 'https://m.example/v1/objects/b/views/imgpsh_fullsize|https://m.example/v1/objects/a_1/views/imgo' ELSE '' END AS urls FROM idb_messages")
def s17_image_urls(spark, sf_dir):
    tag = lambda src, kind="AMSImage": f'<IMG alt="" src="{src}" itemtype="http://schema.example/{kind}">'
    one, two = "https://m.example/v1/objects/a_1/views/imgo", "https://m.example/v1/objects/b/views/imgpsh_fullsize"
    key = F.col("msg_key") % 3
    body = F.when(key == 0, tag(one) + tag(one) + tag("https://m.example/x", "Emoji")).when(key == 1, tag(two) + "<p>x</p>" + tag(one)).otherwise(tag("https://m.example/page?x=1") + tag(one, "Sticker"))
    return messages(spark, sf_dir).select("msg_key", F.array_join(teams.image_urls(body), "|").alias("urls"))


@query("SELECT msg_key, CASE WHEN msg_key % 3 = 0 THEN 'uma planilha' ELSE 'resposta solta' END AS description, CASE WHEN msg_key % 3 = 0 THEN coalesce(sender, '?') ELSE '' END AS visible_text FROM idb_messages")
def s11_caption(spark, sf_dir):
    reply = F.when(F.col("msg_key") % 3 == 0, F.concat(F.lit("Description: uma planilha\nVisible text: "), F.coalesce("sender", F.lit("?")))).otherwise(" resposta solta ")
    told = V.caption(reply)
    return messages(spark, sf_dir).select("msg_key", told["description"].alias("description"), told["visible_text"].alias("visible_text"))


@query("""WITH f AS (SELECT doc_id AS path, sha256(coalesce(text, '')) AS sha, coalesce(strlen(text), 0) AS size FROM documents WHERE doc_id % 10 <> 1 OR doc_id % 4 = 0), k AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 3 = 0),
n AS (SELECT path, row_number() OVER (ORDER BY path) AS r FROM f WHERE sha NOT IN (SELECT sha FROM k) AND size <= 900) SELECT f.path, CASE WHEN size > 900 THEN 'unreadable' WHEN f.sha IN (SELECT sha FROM k) THEN 'reuse' WHEN n.r <= 50 THEN 'describe' ELSE 'pending' END AS action FROM f LEFT JOIN n ON n.path = f.path""")
def s9_image_plan(spark, sf_dir):
    """Images above a limit, stored already, known by their bytes, or new; every tenth is settled but where its file changed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).alias("revision"))
    known = docs.where("path % 3 = 0").select("sha256", F.lit("descrita").alias("description")).distinct()
    stored = docs.where("path % 10 = 1").select("path", F.lit(1).alias("revision"), F.when(F.col("path") % 20 == 1, "described").otherwise("unreadable").alias("status"))
    return V.image_plan(docs, known, 50, 900, stored).select("path", "action")


@query("""WITH f AS (SELECT doc_id, coalesce(strlen(text), 0) AS size, 1 + doc_id % 7 AS n FROM documents WHERE doc_id % 11 <> 2 AND NOT (doc_id % 5 = 1 AND doc_id % 4 <> 0)),
s AS (SELECT *, CASE WHEN size > 2000 OR n > 6 THEN 'unreadable' WHEN doc_id % 3 = 0 AND n > 1 THEN 'pending' ELSE 'read' END AS status FROM f)
SELECT doc_id AS path, status, CASE WHEN status = 'unreadable' THEN 0 ELSE n END AS pages, CASE WHEN status = 'pending' THEN n - 1 ELSE 0 END AS pending_pages,
md5(CASE WHEN status = 'unreadable' THEN '' ELSE array_to_string(list_transform(range(1, n + 1), lambda p: CASE WHEN doc_id % 3 = 0 AND p > 1 THEN '' ELSE 'p' || p END), chr(12)) END) AS text FROM s""")
def s8_page_plan(spark, sf_dir):
    """Documents of one to seven pages; in every third all pages but the first are scans; some are forgotten, some stored already."""
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), (key % 7 + 1).cast("int").alias("n"))
    files = docs.select(key.alias("path"), F.concat(F.lit("u"), key.cast("string")).alias("uid"), "size", F.when(key % 4 == 0, 2).otherwise(1).alias("revision"))
    each = docs.select(key.alias("path"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    scanned = (F.col("path") % 3 == 0) & (F.col("page") > 1)
    pages = each.select("path", "page", F.when(~scanned, F.concat(F.lit("p"), F.col("page").cast("string"))).alias("text"), scanned.alias("scanned"))
    stored = files.where("path % 5 = 1").select("path", F.lit(1).alias("revision"), F.element_at(F.array(F.lit("read"), F.lit("unreadable"), F.lit("pending")), (F.col("path") % 3 + 1).cast("int")).alias("status"))
    plan = V.page_plan(files, pages, stored, files.where("path % 11 = 2").select("uid"), 2000, 6)
    return plan.select("path", "status", F.col("pages").cast("bigint"), F.col("pending_pages").cast("bigint"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT sum(2 + doc_id % 3)::BIGINT AS n FROM documents")
def s3_git_estimate(spark, sf_dir):
    logs = table(spark, sf_dir, "documents").select(F.repeat(F.lit("r\x1fabc\x1f2026-01-01T00:00:00Z\x1fA\x1fa@x\x1fm\x1f\x1e\n"), (F.col("doc_id") % 3 + 2).cast("int")).alias("value"))
    return V.commits_in(logs)


@query("SELECT record_id, regexp_matches(p, '(^|/)nota-[^/]*$') OR regexp_matches(p, '\\.csv$') AS ignored FROM (SELECT record_id, r.metadata['path'] AS p FROM records r WHERE r.source = 'file' AND r.metadata['path'] IS NOT NULL)")
def s6_globs(spark, sf_dir):
    files = records(spark, sf_dir).where((F.col("source") == "file") & V.meta("path").isNotNull())
    return files.select("record_id", V.matches_glob(V.meta("path"), ("nota-*", "*.csv")).alias("ignored"))


@query("SELECT record_id, CASE WHEN content IS NOT NULL AND record_id % 5 <> 4 THEN md5(content) END AS body FROM records")
def s26_http_body(spark, sf_dir):
    """Responses under two layers of encoding, one after the other; an unknown encoding cannot be read."""
    import zlib

    import pyarrow as pa
    from pyspark.sql import types as T

    from weftline.functions.arrow import arrow_column

    def packed(texts: pa.Array, ways: pa.Array) -> pa.Array:
        import gzip

        import zstandard

        tools = {0: lambda b: b, 1: gzip.compress, 2: zlib.compress, 3: lambda b: gzip.compress(zstandard.compress(b)), 4: lambda b: b}
        return pa.array([None if t is None else tools[w](t.encode()) for t, w in zip(texts.to_pylist(), ways.to_pylist())], type=pa.binary())

    way = (F.col("record_id") % 5).cast("int")
    names = F.element_at(F.array(*map(F.lit, ("", "gzip", "Deflate", "zstd, gzip", "what"))), way + 1)
    rows = records(spark, sf_dir).select("record_id", arrow_column(packed, T.BinaryType(), F.col("content"), way).alias("raw"), names.alias("encoding"))
    return rows.select("record_id", F.md5(V.http_body(F.col("raw"), F.col("encoding"))).alias("body"))


_STORED = "SELECT record_id, epoch_us(occurred_at) AS us FROM records WHERE source = 'whatsapp' AND occurred_at IS NOT NULL"


@query(f"WITH s AS ({_STORED}), m AS (SELECT min(us) AS a, max(us) AS b FROM s WHERE record_id % 4 = 1 AND us > 1700000000000000) SELECT record_id FROM s, m WHERE us >= a - 3600000000 AND us < b + 3600000000")
def s21_stored_period(spark, sf_dir):
    stored = records(spark, sf_dir).where("source = 'whatsapp'")
    told = stored.where((F.col("record_id") % 4 == 1) & (F.unix_micros("occurred_at") > 1_700_000_000_000_000))
    return V.in_stored_period(stored, told).select("record_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, t IN (0, 1, 2, 3, 4, 5, 9, 13, 16, 20, 25, 27, 28, 42, 43, 57, 62, 66, 99) OR (t <> 7 AND l_orderkey % 2 = 0) AS kept FROM (SELECT *, l_partkey % 100 AS t FROM lineitem) GROUP BY ALL")
def f25_message_types(spark, sf_dir):
    kind = F.col("l_partkey") % 100
    text = F.when(F.col("l_orderkey") % 2 == 0, "texto").otherwise("")
    return table(spark, sf_dir, "lineitem").withColumn("kept", V.is_message(kind, text)).groupBy("l_orderkey", "l_linenumber", "kept").agg(F.count("*").alias("n"))


@query("SELECT r.uid, CASE WHEN record_id % 3 = 0 AND r.metadata['message_id'] IS NOT NULL THEN 'texto ' || (SELECT min(record_id) FROM records x WHERE x.metadata['message_id'] = r.metadata['message_id']) ELSE content END AS content, record_id FROM records r WHERE source = 'whatsapp'")
def s19_complete_text(spark, sf_dir):
    """Stored messages completed from a phone's store that knows every third one's chat, under one of its two names."""
    rows = records(spark, sf_dir)
    stored = rows.where("source = 'whatsapp'").select(F.col("record_id").cast("string").alias("uid"), F.col("uid").alias("own"), "record_id", F.lit(0).alias("from_me"), F.concat(F.coalesce(V.meta("message_id"), F.lit("?")), F.lit("/"), F.col("record_id").cast("string")).alias("key_id"), V.meta("message_id").alias("mid"), F.lit("c").alias("chat"), "content")
    least = rows.where(V.meta("message_id").isNotNull()).groupBy(V.meta("message_id").alias("mid")).agg(F.min("record_id").alias("least"))
    store = stored.join(least, "mid").select("from_me", "key_id", F.when(F.col("record_id") % 3 == 0, "c").otherwise("other").alias("chat"), F.lit("lid").alias("lid"), F.concat(F.lit("texto "), F.col("least").cast("string")).alias("text"))
    return V.complete_text(stored.select("uid", "from_me", "key_id", "chat", "content", "own", "record_id"), store).select(F.col("own").alias("uid"), "content", "record_id")


@query(f"SELECT r.metadata['conversation_id'] AS id, arg_max({S.meta('sender')}, (occurred_at IS NOT NULL, occurred_at, uid)) AS name FROM records r WHERE r.metadata['conversation_id'] IS NOT NULL AND {S.filled(S.meta('sender'))} IS NOT NULL GROUP BY 1")
def s20_learned_names(spark, sf_dir):
    told = records(spark, sf_dir)
    known = told.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: k != "sender_id"), F.map_filter(F.create_map(F.lit("sender_id"), V.meta("conversation_id")), lambda _, v: v.isNotNull())))
    return V.learned_names(known)


@query(f"SELECT msg_key, coalesce(sender, '?') AS sender, sha256(source || chr(0) || coalesce(m.conversation_id, '') || chr(0) || message_id) AS uid, coalesce({S.filled('conversation')}, {S.filled('trim(subject)')}) AS title, epoch_us(coalesce(sent_at, captured_at)) AS us FROM idb_messages m LEFT JOIN (SELECT conversation_id, subject FROM chats) c USING (conversation_id)")
def s12_mapped_messages(spark, sf_dir):
    """Messages mapped from browser storage as events."""
    held = messages(spark, sf_dir)
    marked = held.withColumn("revision", F.col("msg_key").cast("string"))
    found = V.from_messages(marked, table(spark, sf_dir, "chats"))
    return found.select(V.meta("revision").cast("bigint").alias("msg_key"), F.coalesce(V.meta("sender"), F.lit("?")).alias("sender"), "uid", V.meta("conversation").alias("title"), F.unix_micros("occurred_at").alias("us"))


@query(f"SELECT record_id, sha256(content) AS content_hash, {S.DIRECTION} AS direction, CASE WHEN source = 'git' THEN 'git:' || coalesce(r.metadata['repository'], '') || '@' || coalesce(r.metadata['hash'], '') WHEN source = 'browser' THEN r.metadata['url'] WHEN source = 'file' THEN 'file://' || r.metadata['path'] ELSE source || ':' || coalesce(r.metadata['conversation_id'], '') || '/' || coalesce(r.metadata['message_id'], '') END AS locator FROM records r")
def s1_derived(spark, sf_dir):
    return V.with_derived(records(spark, sf_dir)).select("record_id", "content_hash", "direction", "locator")


