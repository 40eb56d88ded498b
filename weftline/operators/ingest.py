"""Ingestion: what replaces what, tombstones, retention, snapshots of files, and renamed identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.operators import filters as E
from weftline.operators import people as P
from weftline.plans.lineage import cut
from weftline.sources.events import BROWSER, FILE, TEAMS, filled, message_content


def meta_of(alias: str, name: str) -> Column:
    """A metadata value of one side of a join."""
    return F.try_element_at(F.col(f"{alias}.metadata"), F.lit(name))


def cleaned(events: DataFrame, redact: bool = True) -> DataFrame:
    """Addresses of visits without secrets, always; credentials out of contents and metadata, if asked."""
    url = F.try_element_at("metadata", F.lit("url"))
    stripped = F.when((F.col("source") == BROWSER) & url.isNotNull(), F.map_concat(F.map_filter("metadata", lambda k, _: k != "url"), F.create_map(F.lit("url"), X.strip_url(url)))).otherwise(F.col("metadata"))
    out = events.withColumn("metadata", stripped)
    if redact:
        out = out.withColumn("content", X.redact_credentials(F.col("content"))).withColumn("metadata", F.transform_values("metadata", lambda _, v: X.redact_credentials(X.strip_url(v))))
    return out


def revision(alias: str) -> Column:
    """A revision as a number; null where there is none."""
    return meta_of(alias, "revision").try_cast("decimal(38,0)")


def replaces(incoming: str = "i", stored: str = "s") -> Column:
    """Whether an incoming event takes a stored one's place: a later revision; the same with a caption, a newer text layer or
    schema; without revisions a different content. A text known only from a backup never replaces a live one."""
    advance = (filled(meta_of(incoming, "caption")).isNotNull() & filled(meta_of(stored, "caption")).isNull()) | F.coalesce(
        meta_of(incoming, "schema_revision").try_cast("int") > F.coalesce(meta_of(stored, "schema_revision").try_cast("int"), F.lit(0)), F.lit(False)
    ) | F.coalesce(meta_of(incoming, "pdf_version").try_cast("int") > F.coalesce(meta_of(stored, "pdf_version").try_cast("int"), F.lit(0)), F.lit(False))
    newer = F.when(revision(incoming).isNull() | revision(stored).isNull(), ~(F.col(f"{incoming}.content").eqNullSafe(F.col(f"{stored}.content")))).otherwise((revision(incoming) > revision(stored)) | ((revision(incoming) == revision(stored)) & advance))
    backup = (F.coalesce(meta_of(incoming, "from_backup"), F.lit("")) == "true") & filled(F.col(f"{stored}.content")).isNotNull()
    return newer & ~backup


def winners(incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One row a uid: the greatest revision, the first to arrive among equals. `arrival` is unique.

    The winner's arrival is found over narrow rows, combined before the shuffle; then its row is fetched.
    """
    rev = F.try_element_at("metadata", F.lit("revision")).try_cast("decimal(38,0)")
    order = F.struct(rev.alias("revision"), (-F.col(arrival)).alias("first"))
    best = incoming.groupBy("uid").agg(F.max_by(arrival, order).alias(arrival))
    return incoming.join(best, ["uid", arrival], "left_semi")


def upsert(stored: DataFrame, incoming: DataFrame, forgotten: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The stored events after a load, with `outcome`: inserted, updated or kept. Forgotten uids never come back."""
    columns = [c for c in stored.columns]
    fresh = winners(incoming.join(forgotten.select("uid").distinct(), "uid", "left_anti"), arrival).select(columns)
    met = stored.alias("s").join(fresh.alias("i"), "uid", "full")
    has_s, has_i = F.col("s.source").isNotNull(), F.col("i.source").isNotNull()
    take = has_i & (~has_s | replaces())
    chosen = [F.when(take, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns if c != "uid"]
    outcome = F.when(~has_s, "inserted").when(take, "updated").otherwise("kept")
    return met.select("uid", *chosen, outcome.alias("outcome"))


def load_report(merged: DataFrame, collected: DataFrame) -> DataFrame:
    """One row: collected, inserted, updated, already there."""
    counts = merged.agg(F.count_if(F.col("outcome") == "inserted").alias("inserted"), F.count_if(F.col("outcome") == "updated").alias("updated"))
    return collected.agg(F.count("*").alias("collected")).join(counts).withColumn("already", F.col("collected") - F.col("inserted") - F.col("updated"))


def deleted(events: DataFrame, uids: DataFrame, tables: dict[str, DataFrame] | None = None, key: str = "record_id") -> dict[str, DataFrame]:
    """Everything that knows of some events (uid), without them: `events`, the `forgotten` uids to remember, and of `tables`

    `people` and `links` (by `key`), `chunks` (source, content_hash: those of a text that no event has any more), `entities`
    (those without a link) and `file_history` (path: of files that are gone).
    """
    gone = events.join(uids.select("uid").distinct(), "uid", "left_semi")
    kept = events.join(uids.select("uid").distinct(), "uid", "left_anti")
    out = {"events": kept, "forgotten": gone.select("uid").distinct()}
    tables = tables or {}
    for name in ("people", "links"):
        if name in tables:
            out[name] = tables[name].join(gone.select(key), key, "left_anti")
    if "chunks" in tables:
        out["chunks"] = released(tables["chunks"], kept)
    if "entities" in tables and "links" in out:
        out["entities"] = tables["entities"].join(out["links"], ["type", "entity_key"], "left_semi")
    if "file_history" in tables:
        out["file_history"] = tables["file_history"].join(gone.where(F.col("source") == FILE).select(F.try_element_at("metadata", F.lit("path")).alias("path")), "path", "left_anti")
    return out


def containing(events: DataFrame, text: str, source: str = "", start=None, end=None) -> DataFrame:
    """uid of events that hold a text, of a source and a period."""
    return events.where(E.contains_text(text) & E.of_source(source) & E.in_period(start, end)).select("uid")


def before(events: DataFrame, source: str, when) -> DataFrame:
    """uid of a source's events before a time."""
    return events.where((F.col("source") == source) & (F.col("occurred_at") < F.lit(when))).select("uid")


def of_person(events: DataFrame, person: str, key: str = "record_id") -> DataFrame:
    """uid of all that a person wrote, is called in or said to the user alone."""
    return P.events_of_person(events, person, key).select("uid")


def without_source(events: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The events of other sources, and no uid to remember: a source that is read again starts anew."""
    return events.where(F.col("source") != source), events.select("uid").limit(0)


def released(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """Chunks of texts that some event still has: shared ones stay until the last event goes."""
    held = events.where(F.length("content") > 0).select("source", X.content_hash(F.col("content")).alias("content_hash"))
    return chunks.join(held.distinct(), ["source", "content_hash"], "left_semi")


def reindexed(events: DataFrame, chunks: DataFrame, split) -> DataFrame:
    """Chunks of all texts: those there are, and new ones for the texts without any. Run again after a loss, it goes on where it was."""
    return released(chunks, events).unionByName(split(without_chunks(events, chunks).drop("content_hash")).select(chunks.columns))


def compacted(vectors: DataFrame, live: DataFrame, slots: int = 1024, key: str = "chunk_id") -> DataFrame:
    """Vectors of live chunks alone, each with its `block` and `slot` in blocks that are full but for the last.

    Numbers follow the key's order over all partitions; how many stand before a partition is one row each.
    """
    kept = vectors.join(live.select(key).distinct(), key, "left_semi").repartitionByRange(key).sortWithinPartitions(key)
    placed = cut(kept.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    parts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    start = parts.withColumn("_start", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    number = F.col("_start") + F.col("_at")
    return placed.join(F.broadcast(start), "_part").withColumn("block", F.floor(number / slots)).withColumn("slot", number % slots).drop("_part", "_at", "_start")


def collapsed_versions(events: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """Migration: files kept once a version become one event a path, under the path's own uid, and a history (path, modified_ms, size)."""
    files = events.where((F.col("source") == FILE) & F.try_element_at("metadata", F.lit("path")).isNotNull())
    path = F.try_element_at("metadata", F.lit("path"))
    history = files.select(path.alias("path"), F.unix_millis("occurred_at").alias("modified_ms"), F.try_element_at("metadata", F.lit("size")).try_cast("bigint").alias("size")).groupBy("path", "modified_ms").agg(F.min("size").alias("size"))
    last = files.groupBy(path.alias("_path")).agg(F.max_by(key, F.struct("occurred_at", key)).alias(key)).select(key)
    stamp = F.create_map(F.lit("revision"), (F.unix_millis("occurred_at") * 1_000_000).cast("string"))
    kept = files.join(last, key, "left_semi").withColumn("uid", X.stable_id(F.lit(FILE), path)).withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: k != "revision"), F.map_filter(stamp, lambda _, v: v.isNotNull())))
    return events.where(~((F.col("source") == FILE) & path.isNotNull())).unionByName(kept), history


def shared_chunks(chunks: DataFrame, events: DataFrame, key: str = "record_id") -> DataFrame:
    """Migration: chunks kept once an event become one set a text: those of the first event that has the text."""
    texts = events.select(key, "source", X.content_hash(F.col("content")).alias("content_hash"))
    met = chunks.join(texts, key)
    first = met.groupBy("source", "content_hash").agg(F.min(key).alias(key))
    return met.join(first, ["source", "content_hash", key], "left_semi").drop(key)


def with_own_text(events: DataFrame) -> DataFrame:
    """Migration: messages get their own words as metadata `text`, where content is laid out exactly as it is today."""
    sender, told = F.try_element_at("metadata", F.lit("sender")), F.try_element_at("metadata", F.lit("text"))
    placed = filled(F.try_element_at("metadata", F.lit("conversation"))).isNotNull() | filled(F.try_element_at("metadata", F.lit("conversation_kind"))).isNotNull()
    body = F.when(placed, F.substring_index("content", "\n", -2)).otherwise(F.substring_index("content", "\n", -1))  # lines below the words
    words = F.substring("content", F.length(sender) + 3, F.length("content") - F.length(body) - F.length(sender) - 3)
    laid_out = message_content(sender, words, F.try_element_at("metadata", F.lit("conversation")), F.try_element_at("metadata", F.lit("conversation_kind")), F.try_element_at("metadata", F.lit("sent_by_me")) == "true")
    recovered = (F.col("source") == TEAMS) & told.isNull() & (laid_out == F.col("content"))
    return events.withColumn("metadata", F.when(recovered, F.map_concat("metadata", F.create_map(F.lit("text"), words))).otherwise(F.col("metadata")))


def redacted_store(events: DataFrame) -> DataFrame:
    """Migration: what is stored already, without credentials."""
    return cleaned(events)


def forget(events: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """The events that stay, and the tombstones of those that go."""
    gone = F.coalesce(which, F.lit(False))
    return events.where(~gone), events.where(gone).select("uid").distinct()


def expired(days: dict[str, int], today: Column) -> Column:
    """Events older than their source's retention; sources without one keep everything."""
    old = F.lit(False)
    for source, kept in days.items():
        old = old | ((F.col("source") == source) & (F.col("occurred_at") < today - F.make_dt_interval(days=F.lit(kept))))
    return old


def snapshot(stored: DataFrame, present: DataFrame, at: Column) -> DataFrame:
    """path, state of stored files against those present now: present, removed, returned, and removed_at as it becomes."""
    now = present.select("path").distinct().withColumn("here", F.lit(True))
    met = stored.join(now, "path", "left")
    here, gone = F.col("here").isNotNull(), filled(F.col("removed_at")).isNotNull()
    state = F.when(here & gone, "returned").when(here, "present").when(gone, "still_removed").otherwise("removed")
    return met.select("path", state.alias("state"), F.when(here, F.lit(None).cast("string")).when(gone, F.col("removed_at")).otherwise(at.cast("string")).alias("removed_at"))


def rekey(stored: DataFrame, changes: DataFrame, forgotten: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events under their new uids, tombstones carried over, and one row of counts; a uid that is taken is not given twice."""
    taken = changes.join(stored.select(F.col("uid").alias("new_uid")), "new_uid", "left_semi")
    free = changes.join(taken.select("old_uid"), "old_uid", "left_anti").groupBy("new_uid").agg(F.min("old_uid").alias("old_uid"))
    renamed = stored.join(free.select(F.col("old_uid").alias("uid"), "new_uid"), "uid", "left").withColumn("uid", F.coalesce("new_uid", "uid")).drop("new_uid")
    carried = forgotten.join(changes.select(F.col("old_uid").alias("uid"), "new_uid"), "uid", "left").select(F.coalesce("new_uid", "uid").alias("uid")).distinct()
    counts = changes.agg(F.count("*").alias("asked")).join(taken.agg(F.count("*").alias("conflicts")))
    return renamed, carried, counts


def without_chunks(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Events with text of which no chunk is stored."""
    hashed = events.where(F.length("content") > 0).withColumn("content_hash", X.content_hash(F.col("content")))
    return hashed.join(chunks.select("source", "content_hash").distinct(), ["source", "content_hash"], "left_anti")


def latest_representations(rows: DataFrame) -> DataFrame:
    """One row an (entity, modality, kind): the last one; a vector stays only if the content it was made from does."""
    last = rows.groupBy("entity", "modality", "kind").agg(F.max_by(F.struct("content", "at"), F.struct("at", "content")).alias("r"), F.max_by(F.struct("content", "vector"), F.when(F.col("vector").isNotNull(), F.struct("at", "content"))).alias("v"))
    return last.select("entity", "modality", "kind", "r.content", F.when(F.col("v.content") == F.col("r.content"), F.col("v.vector")).alias("vector"))


def nearest_representations(rows: DataFrame, vector: list[float], kind: str, k: int) -> DataFrame:
    """The k representations of a kind nearest to a vector; those without a vector are left out. The kind is filtered first."""
    wanted = F.array(*(F.lit(float(x)) for x in vector))
    held = rows.where((F.col("kind") == kind) & F.col("vector").isNotNull())
    return held.withColumn("distance", V.cosine_distance(F.col("vector"), wanted)).orderBy("distance", "entity", "modality").limit(k)
