"""Sinks: events as JSON lines with all that is known about them, in pages or per person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.people import events_of_person


def denormalised(events: DataFrame, people: DataFrame, links: DataFrame, relations: DataFrame, key: str = "record_id") -> DataFrame:
    """One record an event with its people, entities and relations as sorted arrays; vectors are left out."""
    gather = lambda rows, name, *columns: rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias(name))
    out = events
    for rows, name, columns in ((people, "named", ("role", "name")), (links, "entities", ("type", "entity_key", "role")), (relations, "relations", ("from_key", "relation", "to_key"))):
        out = out.join(gather(rows, name, *columns), key, "left")
    return out


def json_lines(records: DataFrame, path: str) -> None:
    """Written by partition, all at once; nothing passes the driver."""
    records.write.mode("overwrite").option("compression", "gzip").json(path)


def page(events: DataFrame, after: int, size: int, key: str = "record_id") -> tuple[DataFrame, bool]:
    """The next events behind a key, and whether the walk is done. (An interactive page; exports write partitions.)"""
    rows = events.where(F.col(key) > after).orderBy(key).limit(size + 1)
    return rows.limit(size), rows.count() <= size


def person(events: DataFrame, key: str, path: str) -> None:
    """All events of one person as JSON lines."""
    json_lines(events_of_person(events, key), path)


def answer_report(hits: DataFrame) -> DataFrame:
    """Hits of every question as one JSON document each, in rank order."""
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "key", "distance")))
    return hits.groupBy("question").agg(by_rank.alias("hits")).select("question", F.to_json(F.struct("question", "hits")).alias("report"))
