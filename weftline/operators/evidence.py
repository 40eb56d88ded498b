"""From hits to evidence: one hit an event, repeats collapsed, gates, neighbours in time, notes and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import filters as E
from weftline.operators.timeline import in_bins

#: Distances above which no hit counts, and above which the best hit means that nothing was found.
MAX_DISTANCE, MAX_BEST = 0.72, 0.61
NEIGHBOUR_MINUTES, NEIGHBOURS = 120, 4


def best_chunk(hits: DataFrame, event: str = "record_id", distance: str = "distance", ordinal: str = "ordinal") -> DataFrame:
    """The nearest chunk of every event: an aggregation, combined before the shuffle."""
    row = F.struct(*hits.columns)
    return hits.groupBy(event).agg(F.min_by(row, F.struct(distance, ordinal)).alias("_row")).select("_row.*")


def usable(events: DataFrame, own_only: bool = False) -> DataFrame:
    """Events that are evidence: no chatter, no removed files, only own commits if asked."""
    kept = events.where(~E.is_chatter() & E.present_files())
    return kept.where(E.own_commits()) if own_only else kept


def collapse_repeats(hits: DataFrame, key: Column, *order: str, at: str = "occurred_at") -> DataFrame:
    """The first hit of every key, with how many others it stands for and the latest time.

    An aggregation, combined before the shuffle: a key of a third of all hits is no burden to one task.
    """
    row = F.struct(*hits.columns)
    kept = hits.groupBy(key.alias("repeat_key")).agg(F.min_by(row, F.struct(*order)).alias("_row"), (F.count("*") - 1).alias("repeats"), F.max(at).alias("latest_at"))
    return kept.select("_row.*", "repeat_key", "repeats", "latest_at")


def gates(hits: DataFrame, max_distance: float = MAX_DISTANCE, max_best: float = MAX_BEST, per: tuple[str, ...] = ()) -> DataFrame:
    """Hits near enough; none of a question's if even its nearest is too far. The nearest is one row a question, looked up."""
    if not per:
        least = hits.agg(F.min("distance").alias("_least")).where(F.col("_least") <= max_best)
        return hits.where(F.col("distance") <= max_distance).join(F.broadcast(least.select(F.lit(True).alias("_open"))), how="left_semi")
    least = hits.groupBy(*per).agg(F.min("distance").alias("_least")).where(F.col("_least") <= max_best)
    return hits.where(F.col("distance") <= max_distance).join(least, list(per), "left_semi")


def neighbours(anchors: DataFrame, events: DataFrame, minutes: int = NEIGHBOUR_MINUTES, most: int = NEIGHBOURS, key: str = "record_id", at: str = "occurred_at") -> DataFrame:
    """anchor, key, gap_us, rank: the nearest events around every anchor, within the time; the anchors themselves left out.

    Events are numbered by time inside wide bins, and every anchor counts those before it: it then looks up the few numbers on
    either side. No pairs of anchors and events are formed, however busy a time is.
    """
    width = minutes * 60 * 1_000_000
    a = anchors.select(F.col(key).alias("anchor"), F.unix_micros(at).alias("us")).where("us is not null").withColumn("bin", F.floor(F.col("us") / (16 * width)))
    e = in_bins(events.select(key, F.unix_micros(at).alias("us")).where("us is not null"), "us", 16 * width, width, width).select("bin", "us", key)
    # earlier ones by their number from the front, where the smallest key stands last; later ones where it stands first
    numbered = e.withColumn("no", F.row_number().over(Window.partitionBy("bin").orderBy("us", F.col(key).desc()))).withColumn("then", F.row_number().over(Window.partitionBy("bin").orderBy("us", key)))
    both = e.select("bin", "us", F.lit(None).cast(dict(anchors.dtypes)[key]).alias("anchor"), F.lit(1).alias("event")).unionByName(a.select("bin", "us", "anchor", F.lit(0).alias("event")))
    before = F.coalesce(F.sum("event").over(Window.partitionBy("bin").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = both.withColumn("before", before).where("event = 0").select("bin", "anchor", F.col("us").alias("anchor_us"), "before")
    earlier = placed.withColumn("no", F.explode(F.sequence(F.col("before") - most + 1, F.col("before")))).join(numbered.select("bin", "no", key, "us"), ["bin", "no"])
    later = placed.withColumn("then", F.explode(F.sequence(F.col("before") + 1, F.col("before") + most + 1))).join(numbered.select("bin", "then", key, "us"), ["bin", "then"])
    columns = ["anchor", "anchor_us", key, "us"]
    near = earlier.select(columns).unionByName(later.select(columns)).where((F.col("us") >= F.col("anchor_us") - width) & (F.col("us") < F.col("anchor_us") + width) & (F.col("anchor") != F.col(key)))
    order = Window.partitionBy("anchor").orderBy("gap_us", key)
    return near.select("anchor", key, F.abs(F.col("us") - F.col("anchor_us")).alias("gap_us")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def fold_images(hits: DataFrame, image: str, event: str, *order: str) -> DataFrame:
    """One hit an image, with how many events share it; hits without an image stay as they are."""
    key = F.coalesce(F.col(image).cast("string"), F.concat(F.lit("\0"), F.col(event).cast("string")))
    return collapse_repeats(hits.withColumn("_folded", key), F.col("_folded"), *order, at=event).drop("_folded", "latest_at", "repeat_key")


def citations(reply: Column, sources: int) -> Column:
    """STRUCT of valid and unknown numbers cited as [n], sorted, once each."""
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(reply, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))))
    valid = lambda n: (n >= 1) & (n <= sources)
    return F.struct(F.filter(numbers, valid).alias("valid"), F.filter(numbers, lambda n: ~valid(n)).alias("unknown"))


def note(index: Column) -> Column:
    """An event as numbered evidence: time, source, text; a text that gives orders is withheld and marked."""
    body = F.when(E.gives_orders(), F.lit("(NÃO CONFIÁVEL: contém ordens ao assistente)")).otherwise(F.coalesce("content", F.lit("")))
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd HH:mm"), F.lit("?")), F.lit(" "), F.col("source"), F.lit(": "), body)
