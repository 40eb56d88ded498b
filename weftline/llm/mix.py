"""Mixing of sources to target weights, in tokens of a public vocabulary (problem 7).

Every document gets a 64-bit hash. Tokens are summed by source and hash bucket; the budget of a source is then a
threshold on the hash: documents below it are used once more than those above. Only the bucket that holds the threshold
is split further (by the next bits of the hash), so three small histograms place it to 1/2^36 of the hash range and the
documents are filtered, never sorted. Thresholds of a larger budget lie above those of a smaller one, so mixes nest.

Size of the mix: where `total_tokens` is not given, the largest at which every source with any text still reaches its
share within its repeats; where it is given, a source that cannot fill its share gives all it may and the rest goes to
the others in proportion. Sources without text get nothing; the shares of the others grow in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.tokenize import token_count
from weftline.plans.lineage import cut
from weftline.plans.sizes import small_side
from weftline.sources.tables import table

#: Bits of the hash that one histogram resolves, and how many histograms refine each other.
BITS, LEVELS = 12, 3


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned(F.col("_hash"), 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def _prefix(level: int) -> Column:
    return F.shiftrightunsigned(F.col("_hash"), 64 - BITS * level) if level else F.lit(0).cast("bigint")


def sized(docs: DataFrame, id_column: str, source: str, text: str, path: str | None = None) -> DataFrame:
    """Id, source, tokens and hash of every document, written once: the text is not needed again."""
    return cut(docs.select(
        F.col(id_column).alias("_id"), F.col(source).alias("_source"), token_count(F.col(text), path).alias("_tokens"),
        F.xxhash64(F.lit("mix"), F.col(id_column)).alias("_hash"),
    ))


def budgets(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a target: tokens available and wanted, full passes over the source, and tokens of the last, partial pass."""
    have = docs.groupBy("_source").agg(F.sum("_tokens").alias("_have"))
    everything = Window.partitionBy(F.lit(1))  # the targets alone, one row a source
    plan = (
        targets.select(F.col("source").alias("_source"), F.col("target_share").alias("_target"), F.greatest(F.col("max_repeats"), F.lit(0)).alias("_max"))
        .join(have, "_source", "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
        .withColumn("_cap", F.col("_have") * F.coalesce("_max", F.lit(1)))
        .withColumn("_weight", F.when((F.col("_cap") > 0) & (F.col("_target") > 0), F.col("_target")).otherwise(0.0))
        .withColumn("_weight", F.coalesce(F.col("_weight") / F.nullif(F.sum("_weight").over(everything), F.lit(0.0)), F.lit(0.0)))
        .withColumn("_fill", F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")))
    )
    if total_tokens is None:
        plan = plan.withColumn("_want", F.col("_weight") * F.coalesce(F.min("_fill").over(everything), F.lit(0.0)))
    else:
        # sources fill up in order of _fill: those that fill before the level is reached give their cap
        order = Window.partitionBy(F.lit(1)).orderBy(F.col("_fill").asc_nulls_last(), "_source")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        left = F.lit(float(total_tokens)) - F.coalesce(F.sum(F.when(F.col("_fill").isNotNull(), F.col("_cap"))).over(before), F.lit(0))
        open_weight = F.lit(1.0) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
        plan = plan.withColumn("_level", F.when(F.col("_fill").isNotNull(), left / F.greatest(open_weight, F.lit(1e-12))))
        plan = plan.withColumn("_rank", F.row_number().over(order))
        reached = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_rank", "_level"))).over(everything)["_level"]
        plan = plan.withColumn("_want", F.when(F.col("_weight") > 0, F.least(F.col("_cap").cast("double"), F.col("_weight") * F.coalesce(reached, F.lit(1e300)))).otherwise(0.0))
    plan = plan.withColumn("_want", F.least(F.round("_want").cast("bigint"), F.col("_cap").cast("bigint")))
    passes = F.when(F.col("_have") > 0, F.floor(F.col("_want") / F.col("_have"))).otherwise(0)
    return plan.select("_source", "_target", "_have", "_want", passes.cast("int").alias("_passes"), (F.col("_want") - passes * F.col("_have")).alias("_rest"))


def thresholds(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """`plan` with `_upto`: the prefix of the hash below which a document is used once more."""
    plan = cut(plan.withColumn("_upto", F.lit(0).cast("bigint")))
    for level in range(LEVELS):
        inside = docs.join(small_side(plan.select("_source", "_rest", "_upto")), "_source").where(_prefix(level) == F.col("_upto"))
        sums = inside.groupBy("_source", "_rest", _bucket(level).alias("_bucket")).agg(F.sum("_tokens").alias("_sum"))
        by_bucket = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = sums.withColumn("_upper", F.sum("_sum").over(by_bucket)).where(F.col("_upper") > F.col("_rest"))
        edge = summed.groupBy("_source").agg(F.min("_bucket").alias("_edge"), F.min(F.col("_upper") - 0).alias("_first"), F.min_by("_sum", "_bucket").alias("_inside"))
        # without an edge the bucket is taken whole (a rest that only rounding left over)
        plan = cut(
            plan.join(edge, "_source", "left")
            .withColumn("_rest", F.when(F.col("_edge").isNotNull(), F.col("_rest") - (F.col("_first") - F.col("_inside"))).otherwise(F.col("_rest")))
            .withColumn("_upto", F.col("_upto") * (1 << BITS) + F.coalesce("_edge", F.lit(1 << BITS)))
            .drop("_edge", "_first", "_inside")
        )
    return plan


def mix(docs: DataFrame, targets: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", total_tokens: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix, and the shares really reached.

    The mix has (`id_column`, source, n_tokens, uses) for each document used at least once. The report has one row a target:
    source, target_share, available_tokens, used_tokens, actual_share.

    Null source and sources that are no target: not used. Null or empty text: no tokens, never used. Repeated rows are
    documents of their own that share a hash, so they are used alike. Empty tables give an empty mix and shares of 0.
    Other columns of either table are ignored.
    """
    docs = sized(docs, id_column, source, text, path)
    plan = thresholds(docs, budgets(docs, targets, total_tokens))
    uses = F.col("_passes") + (_prefix(LEVELS) < F.col("_upto")).cast("int")
    used = docs.join(small_side(plan.select("_source", "_passes", "_upto")), "_source").withColumn("uses", uses).where((F.col("uses") > 0) & (F.col("_tokens") > 0))
    sums = used.groupBy("_source").agg(F.sum(F.col("_tokens") * F.col("uses")).alias("_used"))
    total = F.sum(F.coalesce("_used", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    report = plan.join(sums, "_source", "left").select(
        F.col("_source").alias("source"), F.col("_target").alias("target_share"), F.col("_have").alias("available_tokens"),
        F.coalesce("_used", F.lit(0)).alias("used_tokens"), F.coalesce(F.coalesce("_used", F.lit(0)) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("actual_share"),
    )
    return used.select(F.col("_id").alias(id_column), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), "uses"), report


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, table(spark, sf_dir, "mix_targets"))[1]
