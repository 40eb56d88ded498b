"""Messages that a chat client keeps in a browser database: three stores of dynamic records, joined to events.

Records are (kind, origin, namespace, container, seq, value VARIANT), as `operators.mapping` reads them. Reply chains hold the
messages, conversations their titles, profiles the names behind sender ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.mapping import child, text_of
from weftline.plans.sizes import small_side
from weftline.sources.events import TEAMS, _event, filled, message_content

#: Stores and the prefixes of their databases, types of messages that people write, streams that repeat others.
CHAINS, CONVERSATIONS, PROFILES = ("Teams:replychain-manager:", "replychains"), ("Teams:conversation-manager:", "conversations"), ("Teams:profiles:", "profiles")
WRITTEN, REPEATING = ("RichText/Html", "Text"), ("streamofnotifications", "streamofcalllogs")
ARRIVALS, SENDER_FIELDS, NEEDED = ("originalArrivalTime", "clientArrivalTime"), ("imDisplayName", "fromDisplayNameInToken"), ("id", "conversationId", "messageType", "content")
#: What marks a picture in a message's markup, and where pictures are served from.
IMAGE_TAG, IMAGE_TYPE, IMAGE_SOURCE = r"(?i)<img\b[^>]*>", r"""(?i)\bitemtype\s*=\s*"[^"]*/AMSImage\"""", r"""(?i)\bsrc\s*=\s*"([^"]+)\""""
IMAGE_ADDRESS = r"^https://[a-z0-9.-]+/v1/objects/[A-Za-z0-9_-]+/views/[a-z_]+$"
GENERAL, MOST_NAMES = "Geral", 4


def store(records: DataFrame, place: tuple[str, str]) -> DataFrame:
    """Records of one store, whoever's database it is."""
    return records.where(F.col("namespace").startswith(place[0]) & (F.col("container") == place[1]))


def _text(value: Column, *path: str) -> Column:
    for name in path:
        value = child(value, name)
    return F.nullif(F.trim(text_of(value)), F.lit(""))


def titles(records: DataFrame) -> DataFrame:
    """conversation_id, conversation_kind, conversation: what a conversation is and is called; its last record counts.

    Channels are called `team › channel` after the conversation that has the team's id; chats without a topic or a title of
    their own after their first members.
    """
    value = F.col("value")
    held = store(records, CONVERSATIONS).select("seq", _text(value, "id").alias("id"), "value").where("id is not null")
    last = held.groupBy("id").agg(F.max_by("value", "seq").alias("value"))
    topic, team_topic, long = _text(value, "threadProperties", "topic"), _text(value, "threadProperties", "spaceThreadTopic"), _text(value, "chatTitle", "longTitle")
    members = F.coalesce(child(child(value, "chatTitle"), "avatarUsersInfo", "array<variant>"), F.array().cast("array<variant>"))
    names = F.filter(F.transform(members, lambda m: _text(m, "displayName")), lambda n: n.isNotNull())
    told = last.select("id", _text(value, "type").alias("type"), _text(value, "teamId").alias("team_id"), topic.alias("topic"), team_topic.alias("team_topic"), long.alias("long"), F.nullif(F.array_join(F.slice(names, 1, MOST_NAMES), ", "), F.lit("")).alias("members"))
    teams = told.where("team_topic is not null").select(F.col("id").alias("team_id"), F.col("team_topic").alias("team"))
    met = told.join(small_side(teams), "team_id", "left")
    channel = lambda team: F.concat_ws(" › ", team, F.coalesce("topic", F.lit(GENERAL)))
    kind = F.col("type")
    title = (
        F.when(kind == "Topic", channel(F.col("team"))).when(kind == "Space", channel(F.col("team_topic"))).when(kind == "Meeting", F.coalesce("topic", "long"))
        .when(kind.isin("Chat", "StreamOfNotes"), F.coalesce("topic", "long", "members")).otherwise(F.col("topic"))
    )
    name = F.when(kind.isin("Topic", "Space"), "canal").when(kind == "Meeting", "reunião").when(kind.isin("Chat", "StreamOfNotes"), "chat").otherwise("conversa")
    return met.select(F.col("id").alias("conversation_id"), name.alias("conversation_kind"), F.coalesce(title, F.lit("")).alias("conversation"))


def profiles(records: DataFrame) -> DataFrame:
    """sender_mri, profile: the name last stored for an id."""
    named = store(records, PROFILES).select("seq", text_of(child(F.col("value"), "mri")).alias("sender_mri"), _text(F.col("value"), "displayName").alias("name"))
    return named.where("sender_mri <> '' and name is not null").groupBy("sender_mri").agg(F.max_by("name", "seq").alias("profile"))


def image_urls(body: Column) -> Column:
    """Addresses of the pictures in a message's markup, in order, each once; emoji and pages elsewhere are none."""
    tags = F.filter(F.regexp_extract_all(body, F.lit(f"({IMAGE_TAG})"), F.lit(1)), lambda tag: tag.rlike(IMAGE_TYPE))
    urls = F.transform(tags, lambda tag: F.replace(F.regexp_extract(tag, IMAGE_SOURCE, 1), F.lit("&amp;"), F.lit("&")))
    return F.array_distinct(F.filter(urls, lambda url: url.rlike(IMAGE_ADDRESS)))


def entries(records: DataFrame) -> DataFrame:
    """origin, message: every message of every reply chain."""
    origin = F.col("origin") if "origin" in records.columns else F.lit("")
    held = F.map_values(F.coalesce(child(F.col("value"), "messageMap", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return store(records, CHAINS).select(origin.alias("origin"), F.explode(held).alias("message"))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages that people wrote and that still stand, with text or a picture; one row each."""
    m = F.col("message")
    number = lambda name: F.when(F.schema_of_variant(child(m, name)).rlike("BIGINT|DOUBLE|DECIMAL"), child(m, name, "double"))
    millis = F.coalesce(*(F.when(number(name) > 0, number(name)) for name in ARRIVALS))
    deleted = F.coalesce(F.schema_of_variant(child(m, "deletionInfo")).startswith("OBJECT"), F.lit(False))
    html = text_of(child(m, "content"))
    mine = F.coalesce(F.when(F.schema_of_variant(child(m, "isSentByCurrentUser")) == "BOOLEAN", child(m, "isSentByCurrentUser", "boolean")), F.lit(False))
    rows = messages.where(text_of(child(m, "messageType")).isin(*WRITTEN) & ~text_of(child(m, "threadType")).isin(*REPEATING) & ~deleted).select(
        "origin", text_of(child(m, "id")).alias("message_id"), text_of(child(m, "conversationId")).alias("conversation_id"), F.coalesce(*(_text(m, name) for name in SENDER_FIELDS)).alias("said_by"),
        text_of(child(m, "creator")).alias("sender_mri"), X.html_to_text(html).alias("text"), image_urls(html).alias("images"), F.timestamp_millis(F.floor(millis)).alias("sent_at"), mine.alias("sent_by_me"), text_of(child(m, "version")).alias("revision"),
    )
    return rows.where("message_id <> '' and conversation_id <> '' and sent_at is not null and (text <> '' or size(images) > 0)")


def check(records: DataFrame) -> DataFrame:
    """One row: records, chains, messages, known. An error where there are records without a chain, or messages none of which has the fields needed."""
    m = F.col("message")
    known = F.lit(True)
    for name in NEEDED:
        known = known & child(m, name).isNotNull()
    known = known & (child(m, ARRIVALS[0]).isNotNull() | child(m, ARRIVALS[1]).isNotNull())
    counts = records.agg(F.count("*").alias("records"), F.count_if(F.col("namespace").startswith(CHAINS[0]) & (F.col("container") == CHAINS[1])).alias("chains"))
    seen = counts.join(entries(records).agg(F.count("*").alias("messages"), F.count_if(known).alias("known")))
    fault = F.when((F.col("records") > 0) & (F.col("chains") == 0), "no store of reply chains in these records").when((F.col("messages") > 0) & (F.col("known") == 0), "no message has the fields that are read")
    return seen.withColumn("known", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("known")))


def from_teams(records: DataFrame) -> DataFrame:
    """Events of all messages. Nothing is joined but names: titles and profiles are looked up once for each conversation and sender."""
    told = parsed(entries(records)).join(small_side(titles(records)), "conversation_id", "left").join(small_side(profiles(records)), "sender_mri", "left")
    sender = F.coalesce("said_by", "profile", F.lit("desconhecido"))
    kind, title = F.coalesce("conversation_kind", F.lit("conversa")), F.coalesce("conversation", F.lit(""))
    uid = X.stable_id(F.lit(TEAMS), F.col("conversation_id"), F.col("message_id"))
    content = message_content(sender, F.col("text"), title, kind, F.col("sent_by_me"))
    return _event(
        told, TEAMS, uid, F.col("sent_at"), content, conversation_id=F.col("conversation_id"), conversation=title, conversation_kind=kind, message_id=F.col("message_id"), sender=sender,
        sender_mri=F.col("sender_mri"), sent_by_me=F.col("sent_by_me"), origin=F.col("origin"), revision=F.col("revision"), text=F.col("text"), image_urls=F.nullif(F.array_join("images", "\n"), F.lit("")),
    )


def with_captions(events: DataFrame, captions: DataFrame) -> DataFrame:
    """Events with the descriptions (url, sha256, description) of their pictures in their text; the first one is the event's image."""
    shown = events.where("metadata['image_urls'] is not null").select("uid", F.posexplode(F.split(F.col("metadata")["image_urls"], "\n")).alias("at", "url"))
    met = shown.join(small_side(captions), "url").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "sha256", "description"))).alias("pictures"))
    joined = events.join(met, "uid", "left")
    texts = F.filter(F.transform("pictures", lambda p: p["description"]), lambda d: filled(d).isNotNull())
    first = F.create_map(F.lit("image_sha256"), F.get("pictures", F.lit(0))["sha256"])
    metadata = F.when(F.col("pictures").isNotNull() & F.try_element_at("metadata", F.lit("image_sha256")).isNull(), F.map_concat("metadata", first)).otherwise(F.col("metadata"))
    return joined.withColumn("content", F.concat_ws("\n", "content", texts)).withColumn("metadata", metadata).drop("pictures").select(events.columns)


