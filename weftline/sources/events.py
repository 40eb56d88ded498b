"""Sources of the event relation: every activity as (uid, source, occurred_at, content, metadata), plus derived columns.

`SOURCES` names a normaliser for each shape of input. All of them are lazy plans over DataFrames; reading files is left to
Spark's own readers, so filters and columns chosen later reach the scan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as X
from weftline.functions.arrow import arrow_column

GIT, BROWSER, FILE, TEAMS, WHATSAPP = "git", "browser", "file", "teams", "whatsapp"
#: Microseconds from 1601, where Chromium counts from, to 1970.
CHROMIUM_EPOCH = 11_644_473_600_000_000
#: Folders and sizes of the file tree scan.
IGNORED_FOLDERS = (".git", "node_modules", ".venv", "vendor", "target", "dist", "build", "__pycache__")
MAX_TEXT_BYTES = 1 << 20
#: Types of a message store's rows that people write, and the type of the system's own.
CONTENT_TYPES, SYSTEM_TYPE = (0, 1, 2, 3, 4, 5, 9, 13, 16, 20, 25, 27, 28, 42, 43, 57, 62, 66, 99), 7
#: The line of a message's text that tells its direction.
SENT_LINE, CHANNEL_LINE, RECEIVED_LINE = "Enviada por você", "Publicada no canal (não enviada diretamente a você)", "Recebida por você"
#: Most bytes of a decoded response.
MAX_BODY_BYTES = 64 << 20
#: Hours that stored messages may lie before the first and behind the last message of a store, to be paired with it.
PAIRING_HOURS = 1
#: Columns that tell whose history a table of visits is: the flavour by a column that only it has.
FLAVOURS = {"firefox": "visit_date", "chromium": "visit_time"}


def meta(name: str) -> Column:
    """A metadata value; null where the key is missing."""
    return F.try_element_at(F.col("metadata"), F.lit(name))


def filled(value: Column) -> Column:
    """Null for null and blank."""
    return F.when(value.rlike(r"\S"), value)


def direction() -> Column:
    """sent, channel or received for a Teams message; null for anything else."""
    return F.when(F.col("source") == TEAMS, F.when(meta("sent_by_me") == "true", "sent").when(meta("conversation_kind") == "canal", "channel").otherwise("received"))


def locator() -> Column:
    """Where an event can be looked up, by its source."""
    return (
        F.when(F.col("source") == GIT, F.concat(F.lit("git:"), F.coalesce(meta("repository"), F.lit("")), F.lit("@"), F.coalesce(meta("hash"), F.lit(""))))
        .when(F.col("source") == BROWSER, meta("url"))
        .when(F.col("source") == FILE, F.concat(F.lit("file://"), meta("path")))
        .otherwise(F.concat(F.col("source"), F.lit(":"), F.coalesce(meta("conversation_id"), F.lit("")), F.lit("/"), F.coalesce(meta("message_id"), F.lit(""))))
    )


def with_derived(events: DataFrame) -> DataFrame:
    """Events with content_hash, direction and locator."""
    return events.withColumn("content_hash", X.content_hash(F.col("content"))).withColumn("direction", direction()).withColumn("locator", locator())


def _event(df: DataFrame, source: Column | str, uid: Column, at: Column, content: Column, **metadata: Column) -> DataFrame:
    pairs = [x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))]
    kept = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return df.select(uid.alias("uid"), (F.lit(source) if isinstance(source, str) else source).alias("source"), at.alias("occurred_at"), content.alias("content"), kept.alias("metadata"))


def from_records(records: DataFrame) -> DataFrame:
    """Export lines are events already; record_id is kept as the order of arrival."""
    return records.select("record_id", "uid", "source", "occurred_at", "content", "metadata", "people")


def from_git_log(log: DataFrame) -> DataFrame:
    """Commits from the text of `git log` in a column `value`: records end with \\x1e, fields with \\x1f.

    Fields: repository, hash, RFC 3339 date, name, address, body, files by line.
    """
    fields = log.select(F.explode(F.split("value", "\x1e")).alias("commit")).where(F.col("commit").rlike(r"\S")).select(F.split(F.ltrim(F.regexp_replace("commit", r"^\s+", "")), "\x1f").alias("f"))
    get = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    files = F.filter(F.split(F.trim(get(6)), "\n"), lambda x: x != "")
    body = F.regexp_replace(get(5), r"\s+$", "")
    content = F.concat(body, F.when(F.size(files) > 0, F.concat(F.lit("\n\nArquivos alterados: "), F.array_join(files, ", "))).otherwise(""))
    return _event(fields, GIT, X.stable_id(F.lit(GIT), get(1)), F.to_timestamp(get(2)), content, repository=get(0), hash=get(1), author=get(3), email=get(4), files=F.array_join(files, "\n"))


def flavour(visits: DataFrame) -> str:
    """Which browser kept a table of visits, by a column that only it has."""
    found = [name for name, column in FLAVOURS.items() if column in visits.columns]
    if not found:
        raise ValueError(f"no known history: columns {visits.columns}")
    return found[0]


def commits_in(log: DataFrame) -> DataFrame:
    """One row, n: how many commits a log holds, without taking them apart."""
    return log.agg(F.coalesce(F.sum(F.regexp_count("value", F.lit("\x1e"))), F.lit(0)).alias("n"))


def from_browser(visits: DataFrame, urls: DataFrame, flavor: str | None = None) -> DataFrame:
    """One event a visit, whatever the browser. Visits: url_id and the browser's own time column; urls: id, url, title."""
    flavor = flavor or flavour(visits)
    at = F.col(FLAVOURS["firefox" if flavor == "firefox" else "chromium"])
    micros = at - F.lit(0 if flavor == "firefox" else CHROMIUM_EPOCH)
    met = visits.join(urls, visits["url_id"] == urls["id"]).withColumn("url", X.strip_url(F.col("url")))
    uid = X.stable_id(F.lit(BROWSER), F.lit(flavor), F.col("url"), micros.cast("string"))
    content = F.concat_ws("\n", filled(F.col("title")), F.col("url"))
    return _event(met, BROWSER, uid, F.timestamp_micros(micros), content, browser=F.lit(flavor), url=F.col("url"), title=F.col("title"))


def matches_glob(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path's name, or the path itself, fits one of some patterns, where * stands for any part of a name."""
    fits = F.lit(False)
    for pattern in patterns:
        shape = "[^/]*".join(map(re.escape, pattern.split("*")))
        fits = fits | path.rlike(f"(^|/){shape}$")
    return fits


def from_files(spark: SparkSession, root: str, ignore: tuple[str, ...] = IGNORED_FOLDERS, max_bytes: int = MAX_TEXT_BYTES, globs: tuple[str, ...] = ()) -> DataFrame:
    """Files under a folder, but for ignored folders and globs: text of valid UTF-8 without NUL up to a size, else the name alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:(//)?", "")
    inside = F.size(F.array_intersect(F.split("path", "/"), F.array(*map(F.lit, ignore)))) == 0
    raw = F.when(F.col("length") <= max_bytes, F.try_validate_utf8(F.col("content").cast("string")))
    text = F.when(~F.contains(raw, F.lit("\0")), raw)
    return _event(files.where(inside & ~matches_glob(path, globs)), FILE, X.stable_id(F.lit(FILE), path), F.col("modificationTime"), F.concat_ws("\n", X.basename(path), filled(text)), path=path, size=F.col("length"), revision=(F.unix_micros("modificationTime") * 1000))


def message_content(sender: Column, text: Column, conversation: Column, kind: Column, mine: Column) -> Column:
    """How a message is laid out as text: sender, conversation line, direction line."""
    where = F.when(filled(conversation).isNotNull() | filled(kind).isNotNull(), F.concat(F.lit("Conversa: "), F.concat_ws(" ", filled(kind), filled(conversation))))
    way = F.when(mine, SENT_LINE).when(kind == "canal", CHANNEL_LINE).otherwise(RECEIVED_LINE)
    return F.concat_ws("\n", F.concat(F.coalesce(filled(sender), F.lit("desconhecido")), F.lit(": "), text), where, way)


def from_messages(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages mapped from browser storage, with the titles of their conversations; markup becomes text."""
    titles = chats.select("conversation_id", F.trim("subject").alias("subject"), "kind")
    named = messages.join(titles, "conversation_id", "left")
    text = F.when(F.col("text").rlike("<[a-zA-Z/]"), X.html_to_text(F.col("text"))).otherwise(F.col("text"))
    title = F.coalesce(filled(F.col("conversation")), filled(F.col("subject")))
    uid = X.stable_id(F.col("source"), F.coalesce("conversation_id", F.lit("")), F.col("message_id"))
    content = message_content(F.col("sender"), text, title, F.col("kind"), F.col("sent_by_me"))
    return _event(
        named, F.col("source"), uid, F.coalesce("sent_at", "captured_at"), content,
        conversation_id=F.col("conversation_id"), conversation=title, conversation_kind=F.col("kind"), message_id=F.col("message_id"),
        sender=F.col("sender"), sent_by_me=F.col("sent_by_me"), revision=F.col("revision"), text=text,
    )


def is_message(kind: Column, text: Column) -> Column:
    """Whether a row of a message store was written by a person: by its type, or by any text that isn't the system's."""
    return kind.isin(*CONTENT_TYPES) | ((kind != SYSTEM_TYPE) & (F.coalesce(text, F.lit("")) != ""))


def from_message_store(message: DataFrame, chat: DataFrame, jid: DataFrame, jid_map: DataFrame, media: DataFrame) -> DataFrame:
    """Messages of a relational store (message, chat, jid, jid_map, message_media), senders' aliases resolved once each."""
    alias = jid_map.groupBy("lid_row_id").agg(F.min("jid_row_id").alias("jid_row_id"))
    names = jid.select(F.col("_id").alias("jid_id"), "raw_string")
    rooms = chat.join(names, chat["jid_row_id"] == names["jid_id"]).select(F.col("_id").alias("chat_id"), "subject", F.col("raw_string").alias("room"))
    sender = message.join(alias, message["sender_jid_row_id"] == alias["lid_row_id"], "left").withColumn("sender_id", F.coalesce(alias["jid_row_id"], message["sender_jid_row_id"])).select(message["*"], "sender_id")
    met = (
        sender.join(rooms, sender["chat_row_id"] == rooms["chat_id"]).join(names.select(F.col("jid_id").alias("sender_id"), F.col("raw_string").alias("sender")), "sender_id", "left")
        .join(media.select(F.col("message_row_id").alias("_id"), "media_name"), "_id", "left")
    )
    shown = met.where(is_message(F.col("message_type"), F.col("text_data")))
    mine = F.col("from_me") == 1
    text = F.concat_ws(" ", F.col("text_data"), F.concat(F.lit("["), F.col("media_name"), F.lit("]")))
    uid = X.stable_id(F.lit(WHATSAPP), F.col("room"), F.col("key_id"))
    content = message_content(F.when(mine, "eu").otherwise(F.col("sender")), text, F.col("subject"), F.lit(None).cast("string"), mine)
    return _event(shown, WHATSAPP, uid, F.timestamp_millis("timestamp"), content, conversation_id=F.col("room"), conversation=F.col("subject"), message_id=F.col("key_id"), sender=F.col("sender"), sent_by_me=mine, attachment=F.col("media_name"))


def in_stored_period(stored: DataFrame, messages: DataFrame, hours: int = PAIRING_HOURS) -> DataFrame:
    """Stored events between the first and the last of some messages, an hour wider: the period is read first, so it reaches the scan."""
    first, last = messages.agg(F.min("occurred_at"), F.max("occurred_at")).first()
    if first is None:
        return stored.limit(0)
    return stored.where((F.col("occurred_at") >= F.lit(first - timedelta(hours=hours))) & (F.col("occurred_at") < F.lit(last + timedelta(hours=hours))))


def _decoded(bodies: pa.Array, encodings: pa.Array) -> pa.Array:
    out = []
    for body, encoding in zip(bodies.to_pylist(), encodings.to_pylist()):
        try:
            for name in reversed([n.strip().lower() for n in (encoding or "").split(",")]):
                if body is not None and name not in ("", "identity"):
                    body = _inflated(body, name)
            out.append(body)
        except (ValueError, zlib.error, EOFError, OSError):
            out.append(None)
    return pa.array(out, type=pa.binary())


def _inflated(body: bytes, name: str) -> bytes:
    if name in ("gzip", "deflate"):
        for width in (31,) if name == "gzip" else (15, -15):  # some servers send deflate without its frame
            try:
                found = zlib.decompressobj(width)
                plain = found.decompress(body, MAX_BODY_BYTES + 1)
                break
            except zlib.error:
                if width in (31, -15):
                    raise
    elif name == "zstd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(body) as stream:
            plain = stream.read(MAX_BODY_BYTES + 1)
    else:
        raise ValueError(name)
    if len(plain) > MAX_BODY_BYTES:
        raise ValueError("too large")
    return plain


def http_body(body: Column, encoding: Column) -> Column:
    """A response as it was before its content encodings (gzip, deflate, zstd, in any number); null where it cannot be read or is too large."""
    return arrow_column(_decoded, T.BinaryType(), body, encoding)


def complete_text(stored: DataFrame, store: DataFrame) -> DataFrame:
    """Stored web messages with the text of the phone's store: paired by direction and key, the earliest stored match.

    `stored`: uid, from_me, key_id, chat, content. `store`: from_me, key_id, chat, lid, text.
    """
    pairs = stored.join(store, ["from_me", "key_id"]).where((stored["chat"] == store["chat"]) | (stored["chat"] == store["lid"]))
    text = pairs.groupBy("uid").agg(F.min(store["text"]).alias("completed"))
    return stored.join(text, "uid", "left").withColumn("content", F.coalesce("completed", "content")).drop("completed")


def learned_names(events: DataFrame) -> DataFrame:
    """id, name: the last name each sender id was stored with."""
    named = events.where(meta("sender_id").isNotNull() & filled(meta("sender")).isNotNull())
    return named.groupBy(meta("sender_id").alias("id")).agg(F.max_by(meta("sender"), F.struct("occurred_at", "uid")).alias("name"))


def caption(reply: Column) -> Column:
    """STRUCT of description and visible text from a labelled reply."""
    part = lambda label, rest: F.trim(F.regexp_extract(reply, rf"(?is){label}:\s*(.*?)\s*(?:{rest}|$)", 1))
    labelled = reply.rlike(r"(?i)description:")
    return F.struct(F.when(labelled, part("description", "visible text:")).otherwise(F.trim(reply)).alias("description"), part("visible text", r"\z").alias("visible_text"))


def image_plan(files: DataFrame, described: DataFrame, cap: int, max_bytes: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """path, sha256, action of images: `reuse` a description of the same bytes, `describe` up to `cap` new ones in path order, `pending`.

    With `max_bytes`, images (size) above it are `unreadable`. With `stored` (path, revision, status), images (revision) stored
    as they are and described or unreadable are left out, as no new reading could tell more.
    """
    if stored is not None:
        settled = stored.where(F.col("status").isin("described", "unreadable")).select("path", "revision")
        files = files.join(settled, ["path", "revision"], "left_anti")
    large = F.col("size") > max_bytes if max_bytes is not None else F.lit(False)
    known = files.withColumn("large", large).join(described.select("sha256", "description"), "sha256", "left")
    new = known.where("description is null and not large").select("path").orderBy("path").limit(cap).withColumn("now", F.lit(True))
    action = F.when(F.col("large"), "unreadable").when(F.col("description").isNotNull(), "reuse").when(F.col("now"), "describe").otherwise("pending")
    return known.join(new, "path", "left").select("path", "sha256", action.alias("action"))


def page_plan(files: DataFrame, pages: DataFrame, stored: DataFrame, forgotten: DataFrame, max_bytes: int, max_pages: int, describes: bool = False) -> DataFrame:
    """path, status, pages, pending_pages, text of paged documents that are worth reading: `read`, `pending` or `unreadable`.

    Files: path, uid, size, revision. Pages: path, page, text, scanned. Stored: path, revision, status. Forgotten uids are left out,
    and so are files stored as they are, unless they wait for descriptions and somebody describes now. Files above a limit are
    unreadable. The text is that of all pages, set apart by form feeds; scanned pages wait where nobody describes them.
    """
    final = stored.where(F.col("status").isin("read", "unreadable") | ((F.col("status") == "pending") & F.lit(not describes)))
    open_files = files.join(forgotten.select("uid").distinct(), "uid", "left_anti").join(final.select("path", "revision"), ["path", "revision"], "left_anti")
    counted = pages.groupBy("path").agg(F.count("*").alias("pages"), F.count_if("scanned").alias("scanned"))
    met = open_files.select("path", "size").join(counted, "path", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    met = met.withColumn("status", F.when((F.col("size") > max_bytes) | (F.col("pages") > max_pages), "unreadable").when((F.col("scanned") > 0) & F.lit(not describes), "pending").otherwise("read"))
    # only documents under the limit come together: at most `max_pages` pages each
    told = pages.join(met.where("status <> 'unreadable'").select("path"), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["text"]), "\f")
    readable = F.col("status") != "unreadable"
    return met.join(told, "path", "left").select(
        "path", "status", F.when(readable, F.col("pages")).otherwise(0).alias("pages"), F.when(F.col("status") == "pending", F.col("scanned")).otherwise(0).alias("pending_pages"), F.coalesce(text, F.lit("")).alias("text"),
    )


def distractors(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """n made-up events: commits, messages and visits by turns, the same for the same seed."""
    pick = lambda salt, *options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(len(options))) + 1).cast("int"))
    text = F.concat_ws(" ", pick(1, "ajusta", "corrige", "revisa"), pick(2, "cadastro", "relatório", "painel", "fila"), pick(3, "de clientes", "de pedidos", "de estoque"))
    source = F.element_at(F.array(F.lit(GIT), F.lit(TEAMS), F.lit(BROWSER)), (F.col("id") % 3 + 1).cast("int"))
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64(F.lit(seed), F.lit(4), F.col("id")), F.lit(180 * 86_400)) * 1_000_000)
    return _event(spark.range(n), source, X.stable_id(source, F.col("id").cast("string")), at, text, number=F.col("id"))


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "records": from_records, GIT: from_git_log, BROWSER: from_browser, FILE: from_files, "messages": from_messages, WHATSAPP: from_message_store, "distractors": distractors,
}
