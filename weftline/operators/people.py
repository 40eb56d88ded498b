"""People of events: who is named in which role, and selections by person and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.sources.events import GIT, TEAMS, direction, filled, meta

SENDER, AUTHOR, CONVERSATION, MENTIONED = "sender", "author", "conversation", "mentioned"
ROLES = {"received": (SENDER, AUTHOR), "sent": (CONVERSATION,), "any": (SENDER, AUTHOR, CONVERSATION)}


def people_index(events: DataFrame, key: str = "record_id") -> DataFrame:
    """key, role, name, name_key: sender or author, author's alias, conversation, and the first words behind @ in Teams."""
    sender = filled(meta("sender"))
    entry = lambda role, name: F.struct(role.alias("role"), name.alias("name"))
    named = F.array(
        entry(F.when(sender.isNotNull(), SENDER).otherwise(AUTHOR), F.coalesce(sender, filled(meta("author")))),
        entry(F.lit(AUTHOR), filled(meta("author_alias"))),
        entry(F.lit(CONVERSATION), filled(meta("conversation"))),
    )
    called = F.when(F.col("source") == TEAMS, F.transform(X.mentions(F.coalesce("content", F.lit(""))), lambda m: entry(F.lit(MENTIONED), m))).otherwise(F.array().cast("array<struct<role:string,name:string>>"))
    rows = events.select(key, F.explode(F.concat(named, called)).alias("p")).where(F.col("p.name").isNotNull())
    return rows.select(key, "p.role", F.array_join(X.letter_words(F.col("p.name")), " ").alias("name"), X.name_key(F.col("p.name")).alias("name_key")).where("name_key <> ''")


def of_direction(wanted: str) -> Column:
    """Rows of a direction; those without one always pass."""
    return F.lit(True) if wanted == "any" else (direction().isNull() | (direction() == wanted))


def by_people(events: DataFrame, names: list[str], wanted: str = "any", key: str = "record_id") -> DataFrame:
    """Events that name any of the people, in the roles that the direction asks for: a semi-join on the index."""
    index = people_index(events, key).where(F.col("role").isin(*ROLES[wanted]))
    hit = F.lit(False)
    for name in names:
        hit = hit | X.has_name(F.col("name_key"), X.name_key(F.lit(name)))
    return events.join(index.where(hit).select(key), key, "left_semi")


def resolved_names(events: DataFrame, names: list[str], wanted: str = "any", key: str = "record_id") -> dict[str, str | None]:
    """For each name the form that finds someone: in full, else its first word, else none. One pass over the index."""
    index = people_index(events, key).where(F.col("role").isin(*ROLES[wanted]))
    probes = {}
    for i, name in enumerate(names):
        probes[f"full{i}"] = F.max(X.has_name(F.col("name_key"), X.name_key(F.lit(name))))
        probes[f"first{i}"] = F.max(X.has_name(F.col("name_key"), X.name_key(F.element_at(F.split(F.trim(F.lit(name)), " "), 1))))
    row = index.agg(*(c.alias(n) for n, c in probes.items())).first()
    return {name: name if row[f"full{i}"] else name.split()[0] if row[f"first{i}"] else None for i, name in enumerate(names)}


def addressed_to_others(events: DataFrame, key: str = "record_id") -> DataFrame:
    """Keys of Teams messages whose every mention is a known sender and none the user."""
    teams = events.where(F.col("source") == TEAMS)
    senders = teams.select(X.first_name(meta("sender")).alias("first"), (meta("sent_by_me") == "true").alias("me")).where("first is not null")
    known = senders.groupBy("first").agg(F.max("me").alias("me"))
    someone = known.agg(F.max("me").alias("knows_me"))
    called = teams.select(key, F.explode(X.mentions(F.coalesce("content", F.lit("")))).alias("first")).join(known, "first", "left")
    judged = called.groupBy(key).agg(F.every(F.col("me").isNotNull() & ~F.coalesce("me", F.lit(False))).alias("others"))
    return judged.where("others").join(F.broadcast(someone.where("knows_me")), how="left_semi").select(key)


def received(events: DataFrame, key: str = "record_id") -> DataFrame:
    """Events received, without messages addressed to others."""
    return events.where(of_direction("received")).join(addressed_to_others(events, key), key, "left_anti")


def person_keys(events: DataFrame, name: str, key: str = "record_id") -> DataFrame:
    """Distinct name keys of senders and authors that hold a name, in order."""
    index = people_index(events, key).where(F.col("role").isin(SENDER, AUTHOR))
    return index.where(X.has_name(F.col("name_key"), X.name_key(F.lit(name)))).select("name_key").distinct().orderBy("name_key")


def events_of_person(events: DataFrame, person: str, key: str = "record_id") -> DataFrame:
    """Events a person wrote or is mentioned in by first name, and every message of conversations with nobody else."""
    index = people_index(events, key)
    wrote = index.where(F.col("role").isin(SENDER, AUTHOR) & (F.col("name_key") == person)).select(key)
    called = index.where((F.col("role") == MENTIONED) & (F.col("name_key") == F.split(F.lit(person), " ")[0])).select(key)
    chats = events.where(meta("conversation_id").isNotNull() & (F.coalesce(meta("sent_by_me"), F.lit("")) != "true"))
    senders = index.where(F.col("role") == SENDER).select(key, "name_key")
    alone = chats.select(key, meta("conversation_id").alias("conversation_id")).join(senders, key, "left").groupBy("conversation_id").agg(F.every(F.coalesce(F.col("name_key") == person, F.lit(False))).alias("alone")).where("alone")
    inside = events.select(key, meta("conversation_id").alias("conversation_id")).join(alone, "conversation_id", "left_semi").select(key)
    return events.join(wrote.unionByName(called).unionByName(inside).distinct(), key, "left_semi")


def with_authorship(events: DataFrame, addresses: list[str]) -> DataFrame:
    """Commits marked mine or other by their author's address; without addresses nothing is marked."""
    if not addresses:
        return events
    mine = F.when(F.lower(meta("email")).isin(*(a.lower() for a in addresses)), "mine").otherwise("other")
    marked = F.map_concat(F.map_filter("metadata", lambda k, _: k != "authorship"), F.create_map(F.lit("authorship"), mine))
    return events.withColumn("metadata", F.when(F.col("source") == GIT, marked).otherwise(F.col("metadata")))


def with_email_alias(events: DataFrame) -> DataFrame:
    """Commits with the name their author's address spells, where it differs from the author's."""
    alias = F.nullif(X.name_from_email(F.coalesce(meta("email"), F.lit(""))), F.lit(""))
    differs = alias.isNotNull() & ~(X.name_key(alias) == X.name_key(F.coalesce(meta("author"), F.lit(""))))
    marked = F.map_concat(F.map_filter("metadata", lambda k, _: k != "author_alias"), F.create_map(F.lit("author_alias"), alias))
    return events.withColumn("metadata", F.when((F.col("source") == GIT) & differs, marked).otherwise(F.col("metadata")))
