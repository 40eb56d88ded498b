"""One surviving record for each activity that several records tell (problem 1).

Grouping. A record is identified by what its source names it by: the message id, the commit hash (an abbreviated one is
completed by the full hash it begins), the path (slashes normalised) or the page and the microsecond of its visit. Records
under one uid are one activity. A message exported without any id joins the message of the same conversation whose
words are the same (but for typing errors, accents, case and a cut end) and whose revision is the same or else whose time
is nearest: equal, or cut to seconds, or a time zone off, or within the skew of two clocks. By how much zones are off is
learned from the messages themselves (`clock_offsets`). Equal words sent twice stay two messages: one of them is taken.

Best row: greatest numeric revision, then most filled metadata, then latest time, then smallest id.

Fusion, field by field, by currency: values dated by a revision or a time follow each other within their group; every
such step of one value to another is counted over all groups, and a step seen more often than its reverse is a learned
precedence, and so is what such steps lead to. In a group, dated values are ordered by date and undated ones by the
learned precedences only; of this partial order a maximal value survives (a value that no other value of its group
follows). Activities told once keep what is filled.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrow import arrow_column
from weftline.plans.lineage import cut
from weftline.plans.sizes import small_side
from weftline.sources.tables import table

#: Parameters: seconds that clocks of two exports may differ, the share of common 4-grams that makes words the same, and letters below which words say too little.
SKEW_S, SAME, LEAST_LETTERS = 120, 0.6, 12
#: Zones differ by whole quarters of an hour, up to so many either way; an offset counts if seen at least so often as this share of the most frequent one.
QUARTER_S, MOST_QUARTERS, OFFSET_SHARE = 900, 56, 0.1
#: What the layout of an exported message begins a line with, below the words themselves.
CONVERSATION_LINE = "Conversa: "
#: Sources whose activities are messages.
CHATS = ("teams", "whatsapp", "discord", "chatgpt")
#: Times before this are no times (the epoch and its neighbourhood).
FIRST_TIME = "1971-01-01"
#: Times a learned step must have been seen.
SUPPORT = 2


def _filled(value: Column) -> Column:
    return F.when(value.rlike(r"\S"), value)


def _meta(name: str) -> Column:
    return _filled(F.try_element_at(F.col("metadata"), F.lit(name)))


def _time() -> Column:
    return F.when(F.col("occurred_at") >= F.lit(FIRST_TIME).cast("timestamp"), F.col("occurred_at"))


def identity() -> Column:
    """What the source itself calls the activity; null where the record doesn't say."""
    message, commit, path, url = _meta("message_id"), F.lower(_meta("hash")), _meta("path"), _meta("url")
    place = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    place = F.when(place.rlike("^[A-Za-z]:/"), F.lower(place)).otherwise(place)
    page = F.concat_ws("|", F.regexp_replace(url, "#.*$", ""), F.unix_micros(_time()).cast("string"))
    return (
        F.when(message.isNotNull(), F.concat_ws("|", F.lit("m"), "source", message))
        .when(commit.rlike("^[0-9a-f]{7,}$"), F.concat(F.lit("g|"), commit))
        .when(path.isNotNull(), F.concat(F.lit("f|"), place))
        .when(url.isNotNull() & _time().isNotNull(), F.concat(F.lit("v|"), page))
    )


def _letters(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if c.isalnum())


def _bodies(rows: pa.Array) -> pa.Array:
    """A message's own words: without sender, conversation and direction lines, folded to letters and digits."""
    out = []
    for content, sender in zip(*(rows.field(i).to_pylist() for i in range(2))):
        words = _letters(re.split(rf"\n+{CONVERSATION_LINE}", content or "")[0])
        name = _letters(sender or "")
        out.append(words[len(name) :] if name and words.startswith(name) and len(words) > len(name) else words)
    return pa.array(out, type=pa.string())


def _alike(pairs: pa.Array) -> pa.Array:
    """Share of the shorter text's 4-grams found in the other; short texts must be equal."""
    out = []
    for a, b in zip(*(pairs.field(i).to_pylist() for i in range(2))):
        if a == b or min(len(a), len(b)) < 12:
            out.append(float(a == b))
            continue
        x, y = ({t[i : i + 4] for i in range(len(t) - 3)} for t in (a, b))
        out.append(len(x & y) / min(len(x), len(y)))
    return pa.array(out, type=pa.float64())


def _full_hashes(named: DataFrame) -> DataFrame:
    """Abbreviated commit keys with the one full hash that begins with them."""
    commits = named.where(F.col("key").startswith("g|")).select("key").distinct().withColumn("start", F.substring("key", 1, 9))
    full = commits.where(F.length("key") == 42).select("start", F.col("key").alias("full"))
    met = commits.where(F.length("key") < 42).join(full, "start").where(F.col("full").startswith(F.col("key")))
    return met.groupBy("key").agg(F.min("full").alias("full"), F.count("*").alias("n")).where("n = 1").drop("n")


def _digest(text: Column) -> Column:
    """16 bytes that stand for a text in shuffles."""
    return F.unhex(F.md5(text.cast("binary")))


def _uid() -> Column:
    return _digest(F.coalesce("uid", F.concat(F.lit("row|"), F.col("record_id").cast("string"))))


def _own_words() -> Column:
    return arrow_column(_bodies, T.StringType(), F.struct("content", F.coalesce(_meta("sender"), F.lit("")).alias("sender")))


def _said(records: DataFrame, ids: DataFrame) -> DataFrame:
    """id, words: the messages' own words of some records; only these contents travel."""
    wanted = records.join(small_side(ids.withColumnRenamed("id", "record_id")), "record_id", "left_semi")
    return wanted.select(F.col("record_id").alias("id"), _own_words().alias("words"))


def _telling_revision() -> Column:
    """A revision long enough to be a time, which two different messages hardly share; null for a short count."""
    revision = _meta("revision")
    return F.when(revision.rlike(r"\A[0-9]{10,}\z"), revision)


def clock_offsets(chats: DataFrame) -> list[int]:
    """Seconds by which messages without an id are off the message they repeat: 0 and the zones that the data show.

    Learned from messages whose words stand in one message with an id of their conversation: how often each whole quarter of
    an hour lies between the two. What comes to the driver is a histogram of at most 2 * MOST_QUARTERS + 1 bins.
    """
    dated = chats.where(F.col("ms").isNotNull() & (F.col("letters") >= LEAST_LETTERS))
    named = dated.where(F.col("key").isNotNull()).groupBy("room", "words").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min("ms").alias("there")).where("first = last")
    off = dated.where(F.col("key").isNull()).join(named, ["room", "words"]).select(((F.col("ms") - F.col("there")) / 1000).alias("s"))
    quarter = F.round(F.col("s") / QUARTER_S).cast("int")
    seen = off.select("s", quarter.alias("q")).where((F.abs("q") <= MOST_QUARTERS) & (F.abs(F.col("s") - F.col("q") * QUARTER_S) <= SKEW_S)).groupBy("q").count()
    bins = {r["q"]: r["count"] for r in seen.collect() if r["q"]}
    return [0, *sorted(q * QUARTER_S for q, n in bins.items() if n >= OFFSET_SHARE * max(bins.values()))]


def _adopted(records: DataFrame, keyed: DataFrame) -> DataFrame:
    """(u, adopted) for the uids of messages without an id: what the activity they repeat is called."""
    said = F.get(F.filter("people", lambda p: p["role"] == "conversation"), F.lit(0))["name"]
    room = F.lower(F.trim(F.coalesce(_meta("conversation"), _filled(said), _filled(F.regexp_extract("content", rf"\n{CONVERSATION_LINE}\S+ ([^\n]*)", 1)))))
    chats = records.where(F.col("source").isin(*CHATS) | _meta("message_id").isNotNull() | _meta("conversation").isNotNull())
    chats = chats.select(F.col("record_id").alias("id"), _uid().alias("u"), _digest(F.concat_ws("|", "source", room)).alias("room"), F.unix_millis(_time()).alias("ms"), _telling_revision().alias("revision"), room.isNotNull().alias("roomed"), _own_words().alias("own"))
    chats = chats.where("roomed").select("id", "u", "room", "ms", "revision", _digest(F.col("own")).alias("words"), F.length("own").alias("letters"))
    chats = cut(chats.join(keyed.select("u", _digest(F.col("key")).alias("key")), "u", "left"))
    offsets = clock_offsets(chats)
    width = 2 * SKEW_S * 1000
    lost = chats.where(F.col("key").isNull()).select("id", "u", "room", "ms", "revision")
    other = chats.select(F.col("id").alias("other_id"), F.col("u").alias("other"), F.col("key").alias("other_key"), "room", F.col("ms").alias("other_ms"), F.col("revision").alias("other_revision"))
    probes = F.array_distinct(F.array(*(F.floor((F.col("ms") - (zone + skew) * 1000) / width) for zone in offsets for skew in (-SKEW_S, SKEW_S))))
    beside = lost.where("ms is not null").withColumn("slot", F.explode(probes)).join(other.where("other_ms is not null").withColumn("slot", F.floor(F.col("other_ms") / width)), ["room", "slot"]).drop("slot")
    revised = lost.where("revision is not null").join(other.where("other_revision is not null").withColumn("revision", F.col("other_revision")), ["room", "revision"])
    # how far the times are from a known offset; an offset of 0 is the likeliest
    apart = F.least(*(F.abs(F.col("ms") - F.col("other_ms") - zone * 1000) + (1000 if zone else 0) for zone in offsets), F.lit(1 << 60))
    met = beside.unionByName(revised.select(beside.columns)).where(F.col("u") != F.col("other")).withColumn("apart", apart).withColumn("same_revision", F.coalesce(F.col("revision") == F.col("other_revision"), F.lit(False)))
    met = cut(met.where(F.col("same_revision") | (F.col("apart") <= SKEW_S * 1000 + 1000)).select("id", "u", "other_id", "other", "other_key", "apart", "same_revision").distinct())
    said = cut(_said(records, met.select("id").unionByName(met.select(F.col("other_id").alias("id"))).distinct()))
    met = met.join(said, "id").join(said.select(F.col("id").alias("other_id"), F.col("words").alias("other_words")), "other_id")
    met = met.withColumn("alike", arrow_column(_alike, T.DoubleType(), F.struct("words", "other_words"))).where(F.col("alike") >= SAME)
    rank = F.struct(F.col("other_key").isNull(), ~F.col("same_revision"), F.col("apart"), -F.col("alike"), F.coalesce("other_key", "other"))
    # two uids without an id meet under the smaller one
    best = met.groupBy("u").agg(F.min_by(F.coalesce("other_key", F.least("u", "other")), rank).alias("adopted"))
    # undated ones: the only other message of their conversation with the same words; counted once for all that say them
    undated = chats.where("key is null and ms is null").select("room", "words").distinct()
    same = chats.where(F.col("letters") >= LEAST_LETTERS).join(undated, ["room", "words"], "left_semi").groupBy("room", "words", F.coalesce("key", "u").alias("name")).agg(F.max(F.col("key").isNotNull()).alias("named"))
    only = same.groupBy("room", "words").agg(F.count("*").alias("names"), F.min_by("name", F.struct(~F.col("named"), F.col("name"))).alias("adopted")).where("names = 2")
    lone = chats.where(F.col("key").isNull() & F.col("ms").isNull()).select("u", "room", "words").distinct().join(only, ["room", "words"]).select("u", "adopted")
    return best.unionByName(lone).groupBy("u").agg(F.min("adopted").alias("adopted"))


def _revision() -> Column:
    """A revision of digits as (length, digits), which sorts as the number of any length; null for anything else."""
    digits = F.regexp_replace(F.try_element_at("metadata", F.lit("revision")), "^0+(?=.)", "")
    return F.when(digits.rlike(r"\A[0-9]+\z"), F.struct(F.length(digits).alias("n"), digits.alias("digits")))


def groups(records: DataFrame) -> DataFrame:
    """record_id, activity (16 bytes, the same for all rows that tell one activity) and what the choice among rows needs.

    A null uid makes a row an activity of its own unless the source names it (rows without even a record_id are one). Rows
    repeated in full are one activity.
    """
    filled = F.coalesce(F.size(F.filter(F.map_values("metadata"), lambda v: v.rlike(r"\S"))), F.lit(0))
    rows = records.select("record_id", _uid().alias("u"), identity().alias("key"), _revision().alias("revision"), filled.alias("filled"), "occurred_at", _time().alias("time"), "exported_at")
    named = cut(rows.where("key is not null").groupBy("u").agg(F.min("key").alias("key")))
    completed = named.join(_full_hashes(named), "key", "left").select("u", F.coalesce("full", "key").alias("key"))
    called = completed.select("u", _digest(F.col("key")).alias("activity")).unionByName(_adopted(records, completed).select("u", F.col("adopted").alias("activity")))
    called = called.groupBy("u").agg(F.min("activity").alias("activity"))
    return rows.drop("key").join(called, "u", "left").withColumn("activity", F.coalesce("activity", "u")).drop("u")


def best_rows(grouped: DataFrame) -> DataFrame:
    """activity, record_id of its best row, n_rows. One aggregation with map-side combine, whatever the group's size."""
    order = F.struct("revision", "filled", "occurred_at", (-F.col("record_id")).alias("id"))
    return grouped.groupBy("activity").agg(F.max_by("record_id", order).alias("record_id"), F.count("*").alias("n_rows"))


def stamped(grouped: DataFrame) -> DataFrame:
    """Rows with `at`: revision, time and export, in this order; null where neither revision nor time is known."""
    dated = F.col("revision").isNotNull() | F.col("time").isNotNull()
    return grouped.select("record_id", "activity", "time", F.when(dated, F.struct("revision", "time", "exported_at")).alias("at"))


def _kept(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda _, v: v.rlike(r"\S"))


def cells(told: DataFrame, records: DataFrame) -> DataFrame:
    """activity, field, value, at: the filled metadata of every row told more than once."""
    held = records.where(F.size("metadata") > 0).select("record_id", "metadata").join(small_side(told), "record_id")
    return held.select("activity", "at", F.explode(_kept(F.col("metadata"))).alias("field", "value"))


def learned_steps(values: DataFrame) -> DataFrame:
    """field, value, next: steps between dated values seen in several groups, and more often than their reverse.

    A step seen in several groups is one between values that stand in several groups, so the others are left out first:
    what is sorted within a group is its recurring values, not its rows.
    """
    recurring = values.groupBy("field", "value").agg(F.count("*").alias("groups")).where(F.col("groups") >= SUPPORT).select("field", "value")
    by_date = Window.partitionBy("activity", "field").orderBy("at", "value")
    steps = values.where("at is not null").join(recurring, ["field", "value"], "left_semi").withColumn("next", F.lead("value").over(by_date)).where("next is not null")
    counts = steps.groupBy("field", "value", "next").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    back = counts.select("field", F.col("value").alias("next"), F.col("next").alias("value"), F.col("n").alias("back"))
    return counts.join(back, ["field", "value", "next"], "left").where("n > coalesce(back, 0)").select("field", "value", "next")


def closed(steps: DataFrame) -> DataFrame:
    """field, value, next of the learned steps and of all that they lead to; values that lead to each other have no order but the steps'."""
    steps = reach = cut(steps)
    before, n = -1, reach.count()
    while n > before:
        further = reach.join(reach.select("field", F.col("value").alias("next"), F.col("next").alias("last")), ["field", "next"]).select("field", "value", F.col("last").alias("next"))
        reach = cut(reach.unionByName(further).distinct())
        before, n = n, reach.count()
    back = reach.select("field", F.col("next").alias("value"), F.col("value").alias("next"))
    return steps.unionByName(reach.join(back, ["field", "value", "next"], "left_anti")).distinct()


def fused(told: DataFrame, records: DataFrame) -> DataFrame:
    """activity, metadata: the surviving value of every field."""
    values = cut(cells(told, records).groupBy("activity", "field", "value").agg(F.max("at").alias("at"), F.count("*").alias("n")))
    # only fields with an undated value among several need the learned precedences
    unsure = values.groupBy("activity", "field").agg(F.count("*").alias("values"), F.max(F.col("at").isNull()).alias("undated")).where("values > 1 and undated")
    unsure = cut(values.join(unsure.select("activity", "field"), ["activity", "field"], "left_semi"))
    steps = closed(learned_steps(values).join(unsure.select("field").distinct(), "field", "left_semi"))
    after = unsure.join(steps, ["field", "value"]).select("activity", "field", "value", "at", "next")
    followed = after.join(unsure.select("activity", "field", F.col("value").alias("next"), F.col("at").alias("next_at")), ["activity", "field", "next"])
    followed = cut(followed.where("at is null or next_at is null").select("activity", "field", "value").distinct().withColumn("followed", F.lit(True)))
    order = F.struct(F.col("followed").isNull(), F.col("at"), F.col("n"), F.length("value"), F.col("value"))
    chosen = values.join(small_side(followed), ["activity", "field", "value"], "left").groupBy("activity", "field").agg(F.max_by("value", order).alias("value"))
    return chosen.groupBy("activity").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("metadata"))


#: Most activities told once whose ids (16 bytes each) are sent to all executors, so that their contents need not move.
SENT_IDS = 1_000_000


def survivors(records: DataFrame, least_rows: int = 1, contents: bool = False) -> DataFrame:
    """One row an activity told by `least_rows` rows or more: record_id of the best row, n_rows, the fused occurred_at and
    metadata, and content_id, the record whose content survives; or with `contents` the content itself in its place.

    `records` has record_id, uid, source, occurred_at, content, metadata, people, exported_at. Nulls in any column: see
    `groups`; a null or empty map, blank values and null contents add nothing. Ties end at the smallest record_id and the
    greatest value. Very long contents are compared whole. An empty table gives an empty result; other columns are ignored.
    A group's fields, not its rows, come together in one map.
    """
    grouped = cut(groups(records))
    best = cut(best_rows(grouped).where(F.col("n_rows") >= least_rows))
    several = best.where("n_rows > 1")
    told = cut(stamped(grouped.join(several.select("activity"), "activity", "left_semi")))
    lengths = records.where(F.col("content").rlike(r"\S")).select("record_id", F.length("content").alias("length"))
    written = lengths.join(small_side(told), "record_id").groupBy("activity").agg(F.max_by("record_id", F.struct("at", "length", -F.col("record_id"))).alias("content_id"))
    timed = told.groupBy("activity").agg(F.max_by("time", "at").alias("occurred_at"))
    fused_rows = several.join(timed, "activity", "left").join(written, "activity", "left").join(fused(told, records), "activity", "left").select("record_id", "n_rows", "content_id", "occurred_at", "metadata")
    if contents:
        fused_rows = with_contents(fused_rows, records)
    if least_rows > 1:
        return fused_rows
    return fused_rows.unionByName(_told_once(best.where("n_rows = 1").select("record_id", "n_rows"), records).select(fused_rows.columns))


def _told_once(ids: DataFrame, records: DataFrame) -> DataFrame:
    """Activities of one row: there is nothing to choose, so they keep what is filled."""
    written = F.col("content").rlike(r"\S")
    own = records.select("record_id", F.when(written, F.col("record_id")).alias("content_id"), F.when(written, F.col("content")).alias("content"), _time().alias("occurred_at"), F.when(F.size(_kept(F.col("metadata"))) > 0, _kept(F.col("metadata"))).alias("metadata"))
    unnamed = ids.where("record_id is null")
    named = own.join(small_side(ids.where("record_id is not null"), SENT_IDS), "record_id")
    return named.unionByName(unnamed, allowMissingColumns=True)


def with_contents(survived: DataFrame, records: DataFrame) -> DataFrame:
    """`survivors` with the surviving content. Contents move only where their ids are too many to be sent."""
    survived = cut(survived)
    contents = records.select(F.col("record_id").alias("content_id"), "content")
    wanted = contents.join(small_side(survived.where("content_id is not null").select("content_id"), SENT_IDS), "content_id", "left_semi")
    joined = survived.join(wanted, "content_id", "left")
    return joined.select("record_id", "n_rows", "occurred_at", "content", "metadata")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "records"), least_rows=2).select("record_id")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "records"), contents=True)
