"""The entity graph: entities of events, links, stated relations, and what can be reached over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.people import AUTHOR, MENTIONED, SENDER, people_index
from weftline.plans.lineage import cut
from weftline.plans.sizes import BROADCAST_ROWS
from weftline.sources.events import FILE, GIT, filled, meta

PERSON, FILE_ENTITY, IMAGE = "person", "file", "image"
MOST_HOPS = 3


def shown_images(events: DataFrame, key: str = "record_id") -> DataFrame:
    """key, role, type, entity_key, name: the images that events show."""
    return events.where(filled(meta("image_sha256")).isNotNull()).select(key, F.lit("shows").alias("role"), F.lit(IMAGE).alias("type"), meta("image_sha256").alias("entity_key"), X.basename(F.coalesce(meta("path"), F.lit(""))).alias("name"))


def entity_links(events: DataFrame, key: str = "record_id") -> DataFrame:
    """key, role, type, entity_key, name: persons, changed files, the file itself, the image shown; once a role."""
    persons = people_index(events, key).where(F.col("role").isin(SENDER, AUTHOR, MENTIONED)).select(key, "role", F.lit(PERSON).alias("type"), F.col("name_key").alias("entity_key"), "name")
    changed = events.where(F.col("source") == GIT).select(key, F.concat_ws("/", filled(meta("repository")), F.lit("")).alias("repo"), F.explode(F.split(F.coalesce(meta("files"), F.lit("")), "\n")).alias("file")).where(F.col("file").rlike(r"\S"))
    changed = changed.select(key, F.lit("changed").alias("role"), F.lit(FILE_ENTITY).alias("type"), F.concat("repo", "file").alias("entity_key"), F.col("file").alias("name"))
    subject = events.where((F.col("source") == FILE) & filled(meta("path")).isNotNull()).select(key, F.lit("subject").alias("role"), F.lit(FILE_ENTITY).alias("type"), meta("path").alias("entity_key"), X.basename(meta("path")).alias("name"))
    return reduce(DataFrame.unionByName, (persons, changed, subject, shown_images(events, key))).dropDuplicates([key, "role", "type", "entity_key"])


def entities(links: DataFrame, key: str = "record_id") -> DataFrame:
    """type, entity_key, name: each entity under the spelling that came first."""
    return links.groupBy("type", "entity_key").agg(F.min_by("name", F.struct(key, "role", "name")).alias("name"))


def changed_relations(links: DataFrame, key: str = "record_id") -> DataFrame:
    """from_key, to_key, key: the first author of a commit changed each of its files."""
    author = links.where(F.col("role").isin(AUTHOR) & (F.col("type") == PERSON)).groupBy(key).agg(F.min("entity_key").alias("from_key"))
    files = links.where(F.col("role") == "changed").select(key, F.col("entity_key").alias("to_key"))
    return author.join(files, key).select("from_key", F.lit("changed").alias("relation"), "to_key", key)


def orphans(all_entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities that no event is linked to."""
    return all_entities.join(links, ["type", "entity_key"], "left_anti")


def reachable(edges: DataFrame, start: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """node, hops: nodes within a few hops of the start nodes, over edges (a, b) in both directions.

    One join a hop over the frontier alone; nodes known already are left out, so hot nodes are entered once. Each frontier is
    written, so no hop is computed again for the next one, and a small one is sent to the edges instead of moving them.
    """
    edges = cut(edges.select("a", "b"))
    known = frontier = start.select(F.col("node"), F.lit(0).alias("hops")).distinct()
    size = frontier.limit(BROADCAST_ROWS + 1).count()
    sent = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    total = size
    for hop in range(1, min(hops, MOST_HOPS) + 1):
        there = sent(frontier.select("node"), size)
        ahead = edges.join(there.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node"))
        back = edges.join(there.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node"))
        frontier = cut(ahead.unionByName(back).distinct().join(sent(known.select("node"), total), "node", "left_anti").withColumn("hops", F.lit(hop)))
        size = frontier.count()
        if not size:
            break
        known, total = known.unionByName(frontier), total + size
    return known


def in_reach_order(found: DataFrame, named: DataFrame) -> DataFrame:
    """hops, type, entity_key, name of reachable entities, nearest first, then by type and key."""
    return found.join(named, found["node"] == named["entity_key"]).select("hops", "type", "entity_key", "name").orderBy("hops", "type", "entity_key")


def attachment_links(events: DataFrame, key: str = "record_id") -> DataFrame:
    """key, path: messages whose attachment is the end of a file's path. Joined on the base name, then checked."""
    sent = events.where(filled(meta("attachment")).isNotNull()).select(key, meta("attachment").alias("attachment")).withColumn("base", X.basename(F.col("attachment")))
    files = events.where(F.col("source") == FILE).select(meta("path").alias("path")).distinct().withColumn("base", X.basename(F.col("path")))
    return sent.join(files, "base").where(F.col("path").endswith(F.concat(F.lit("/"), F.col("attachment"))) | (F.col("path") == F.col("attachment"))).select(key, "path")


def widen(links: DataFrame, relations: DataFrame, people: DataFrame, key: str = "record_id") -> DataFrame:
    """key, entity_key: events linked to what the people are related to, one hop away and no person."""
    near = relations.join(people.select(F.col("entity_key").alias("from_key")), "from_key", "left_semi").select(F.col("to_key").alias("entity_key")).distinct()
    return links.where(F.col("type") != PERSON).join(near, "entity_key", "left_semi").select(key, "entity_key").distinct()


def star(relations: DataFrame, named: DataFrame, relation: str | None = None) -> DataFrame:
    """Relations with the names of both ends."""
    end = lambda side: named.select(F.col("entity_key").alias(f"{side}_key"), F.col("name").alias(f"{side}_name"))
    kept = relations if relation is None else relations.where(F.col("relation") == relation)
    return kept.join(end("from"), "from_key").join(end("to"), "to_key")
