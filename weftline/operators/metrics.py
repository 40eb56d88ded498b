"""How good retrieval and planning are: recall, reciprocal rank, rejection, redundancy, intervals, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96


def scored_cases(cases: DataFrame) -> DataFrame:
    """Cases (relevant ARRAY, found ARRAY in order) with recall, reciprocal_rank and passed; answerable if anything is relevant."""
    positions = F.filter(F.transform("relevant", lambda r: F.array_position("found", r)), lambda p: p > 0)
    answerable = F.size("relevant") > 0
    recall = F.when(answerable, F.size(F.array_intersect("relevant", "found")) / F.size("relevant"))
    return cases.withColumn("answerable", answerable).withColumn("recall", recall).withColumn("reciprocal_rank", F.when(answerable, F.coalesce(1.0 / F.array_min(positions), F.lit(0.0)))).withColumn("passed", F.when(answerable, F.col("recall") == 1.0).otherwise(F.size("found") == 0))


def suite_scores(scored: DataFrame) -> DataFrame:
    """One row: mean recall, mean reciprocal rank, rejection (1 without unanswerable cases), redundancy of what was found."""
    repeats = F.size("found") - F.size(F.array_distinct(F.coalesce("groups", "found")))
    return scored.agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(~F.col("answerable"), F.col("passed").cast("double"))), F.lit(1.0)).alias("rejection"),
        F.coalesce(F.sum(repeats) / F.nullif(F.sum(F.size("found")), F.lit(0)), F.lit(0.0)).alias("redundancy"),
    )


def below_floors(scores: DataFrame, floors: dict[str, float], redundancy: float = 0.0) -> DataFrame:
    """metric, value, floor of the metrics that miss their floor."""
    rows = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"), F.lit(float(floor)).alias("floor")) for name, floor in floors.items()), F.struct(F.lit("redundancy").alias("metric"), (-F.col("redundancy")).alias("value"), F.lit(-float(redundancy)).alias("floor")))
    return scores.select(F.explode(rows).alias("m")).select("m.*").where("value < floor")


def calibration(cases: DataFrame) -> DataFrame:
    """One row: the farthest nearest hit of answerable cases, the nearest of unanswerable ones, and the middle as a gate."""
    found = cases.agg(F.max(F.when(F.col("answerable"), F.col("closest"))).alias("answerable"), F.min(F.when(~F.col("answerable"), F.col("closest"))).alias("unanswerable"))
    return found.withColumn("separable", F.col("answerable") < F.col("unanswerable")).withColumn("gate", (F.col("answerable") + F.col("unanswerable")) / 2)


def wilson(successes: Column, trials: Column) -> Column:
    """STRUCT of the ends of the 95 % Wilson interval; (0, 1) without trials."""
    n, p, z2 = trials.cast("double"), successes / trials, Z * Z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.struct(F.when(n == 0, 0.0).otherwise(middle - half).alias("low"), F.when(n == 0, 1.0).otherwise(middle + half).alias("high"))


def accuracy(judged: DataFrame, field: str = "field", right: str = "right") -> DataFrame:
    """field, trials, successes, low, high of judged answers."""
    counts = judged.groupBy(field).agg(F.count("*").alias("trials"), F.count_if(right).alias("successes"))
    return counts.withColumn("interval", wilson(F.col("successes"), F.col("trials"))).select(field, "trials", "successes", "interval.low", "interval.high")


def coverage(captions: DataFrame) -> DataFrame:
    """Captions (caption, must_contain ARRAY) with the share of words they hold, whatever the case."""
    held = F.filter("must_contain", lambda w: F.contains(F.lower("caption"), F.lower(w)))
    return captions.withColumn("coverage", F.when(F.size("must_contain") > 0, F.size(held) / F.size("must_contain")).otherwise(1.0))


def reranked(hits: DataFrame, score: Column, keep: int, question: str, *tie: str) -> DataFrame:
    """Each question's hits by another score, cut."""
    from pyspark.sql import Window

    order = Window.partitionBy(question).orderBy(score.desc(), *tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
