"""Checks of size before a table is sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a narrow table that are ever broadcast (a few MB).
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows, else as it is, to be joined by shuffle.

    The count reads no more than `most` + 1 rows; `df` should be cheap to read (a checkpoint or a small file).
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """`df` marked to be joined by shuffle: a table that grows with the corpus and must never be built in the driver's memory.

    Spark estimates a table by its compressed files, and lists taken apart (`explode`) as if each had one entry, so what it
    takes for small enough to broadcast may be forty times its limit.
    """
    return df.hint("merge")
