"""Chronological listings, what happened around an event, and versions of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.dates import DayRange
from weftline.operators.filters import in_period
from weftline.sources.events import FILE, meta


def of_days(events: DataFrame, days: DayRange, zone: str = "UTC", key: str = "record_id") -> DataFrame:
    """Events of civil days, in order of time and arrival."""
    return events.where(in_period(*days.instants(zone))).orderBy("occurred_at", key)


def around(events: DataFrame, anchor: DataFrame, minutes: int, key: str = "record_id") -> DataFrame:
    """Events within a window around one event, both ends included. The anchor's time is read first, so the window reaches the scan."""
    row = anchor.where("occurred_at is not null").select(F.unix_micros("occurred_at")).first()
    if row is None:
        return events.limit(0)
    end = lambda shift: F.timestamp_micros(F.lit(row[0] + shift * minutes * 60_000_000))
    return events.where((F.col("occurred_at") >= end(-1)) & (F.col("occurred_at") <= end(1))).orderBy("occurred_at", key)


def in_bins(events: DataFrame, at: str, width: int, back: int, ahead: int) -> DataFrame:
    """Rows in bins of time of their own (`owned`), and as context in bins that they reach into.

    A row at t is seen from `back` before its bin's start to `ahead` behind its end, so windows over time can be cut into
    bins, however hot a key is.
    """
    low, own, high = (F.floor((F.col(at) + shift) / width) for shift in (-ahead, 0, back))
    return events.withColumn("bin", F.explode(F.sequence(low, high))).withColumn("owned", F.col("bin") == own)


def counts_around(events: DataFrame, minutes: int, *by: str) -> DataFrame:
    """Events with how many of their group lie within a window around them: a range frame inside bins, no join."""
    width = minutes * 60 * 1_000_000
    rows = in_bins(events.where("occurred_at is not null").withColumn("_us", F.unix_micros("occurred_at")), "_us", 16 * width, width, width)
    frame = Window.partitionBy(*by, "bin").orderBy("_us").rangeBetween(-width, width)
    return rows.withColumn("n_around", F.count("*").over(frame)).where("owned").drop("_us", "bin", "owned")


def latest_versions(events: DataFrame, key: str = "record_id") -> DataFrame:
    """The last version of every file: its key is found by an aggregation over narrow rows, then its row is fetched."""
    files = events.where((F.col("source") == FILE) & meta("path").isNotNull())
    last = files.groupBy(meta("path").alias("_path")).agg(F.max_by(key, F.struct("occurred_at", key)).alias(key)).select(key)
    return files.join(last, key, "left_semi")


def file_versions(current: DataFrame, history: DataFrame) -> DataFrame:
    """path, at, current: stored files and their earlier versions, a version with the time of a stored file only once."""
    now = current.select("path", F.unix_millis("at").alias("ms")).distinct().withColumn("current", F.lit(True))
    past = history.select("path", F.unix_millis("at").alias("ms")).distinct().join(now, ["path", "ms"], "left_anti").withColumn("current", F.lit(False))
    return now.unionByName(past)


def sessions(events: DataFrame, gap: str, *by: str, at: str = "ts") -> DataFrame:
    """Stretches of activity with no pause longer than `gap`. (An extension: the activity model has no sessions of its own.)"""
    return events.groupBy(*by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("w.end").cast("timestamp")).alias("end_us"), "n")


def nearest_cited(events: DataFrame, cited: Column, minutes: int, *by: str, at: str = "us", key: str = "event_id") -> DataFrame:
    """Events with `near`: the label of the nearest labelled one within the time, before or after; the earlier on a tie.

    Two passes of a window over time in bins, no join: the last label before and the first label after.
    """
    limit = minutes * 60 * 1_000_000
    rows = in_bins(events.withColumn("_cited", cited), at, 16 * limit, limit, limit)
    labelled = F.when(F.col("_cited").isNotNull(), F.struct(F.col(at).alias("at"), F.col("_cited").alias("label")))
    first_of_time = F.first(labelled, ignorenulls=True).over(Window.partitionBy(*by, "bin", at).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = rows.withColumn("_label", first_of_time)
    order = Window.partitionBy(*by, "bin").orderBy(at)
    before = F.last("_label", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_label", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    spanned = marked.withColumn("_before", before).withColumn("_after", after).where("owned")
    back, ahead = F.col(at) - F.col("_before.at"), F.col("_after.at") - F.col(at)
    near = F.when((back <= limit) & (ahead.isNull() | (back <= ahead)), F.col("_before.label")).when(ahead <= limit, F.col("_after.label"))
    return spanned.withColumn("near", F.coalesce("_cited", near)).drop("_label", "_before", "_after", "_cited", "bin", "owned")


def as_of(left: DataFrame, right: DataFrame, by: str, minutes: int, at: str = "us") -> DataFrame:
    """`left` with `found`: the latest row of `right` (by, at, value) at or before its time and within the tolerance.

    Both are merged by time inside bins and carried forward: a hot key is spread over its bins, and no pairs are formed.
    """
    limit = minutes * 60 * 1_000_000
    values = right.select(by, at, F.col("value").alias("_value")).withColumn("_left", F.lit(0))
    both = left.withColumn("_value", F.lit(None).cast(dict(right.dtypes)["value"])).withColumn("_left", F.lit(1)).unionByName(values, allowMissingColumns=True)
    rows = in_bins(both, at, 16 * limit, limit, 0).where("owned or _left = 0")
    order = Window.partitionBy(by, "bin").orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_left") == 0, F.struct(F.col(at).alias("at"), F.col("_value").alias("value"))), ignorenulls=True).over(order)
    carried = rows.withColumn("_last", last).where("_left = 1")
    return carried.withColumn("found", F.when(F.col(at) - F.col("_last.at") <= limit, F.col("_last.value"))).drop("_value", "_left", "_last", "bin", "owned")
